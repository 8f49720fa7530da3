"""Gristmill: a Spark-native engine that matches postings against resumes at table scale."""

import sys

from pyspark import cloudpickle

# Arrow functions travel to the workers by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
