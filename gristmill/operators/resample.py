"""Bootstrap intervals by weights that each row draws for itself.

In resample r a row counts as often as a Poisson variable of mean 1 says that its id and r draw by whole-number arithmetic, so a resample is a
sum over rows in any order: rows never meet, partial sums merge before they are shuffled, and a group of any size needs a few numbers a resample.

Defined results: null errors take no part; a null id draws like 0; resamples that drew no row are left out; empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A prime; whole numbers are drawn below it.
PRIME = 2_147_483_647
REPEATS = 200
#: Numbers below the k-th limit and not below the one before draw the weight k.
LIMITS = tuple(int(PRIME * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(9))


def weights(errors: DataFrame, group: str, id: str, error: str, repeats: int) -> DataFrame:
    """(group, rep, n, total): rows drawn in each resample, with repeats, and the sum of their errors."""
    rows = errors.select(F.col(group).alias("g"), F.coalesce(F.col(id).cast("long"), F.lit(0)).alias("i"), F.col(error).alias("e")).where("e IS NOT NULL")
    each = rows.select("g", "i", "e", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(repeats).cast("long"))).alias("rep"))
    power = lambda c: ((c * c % PRIME) * (c * c % PRIME) % PRIME) * c % PRIME
    start = (F.pmod("i", F.lit(PRIME)) + F.col("rep") * 104729) % PRIME
    each = each.withColumn("u", start).withColumn("u", power(F.col("u"))).withColumn("u", (F.col("u") + F.col("rep") * 15485863) % PRIME).withColumn("u", power(F.col("u")))
    weight = F.lit(0)
    for limit in LIMITS:
        weight = weight + (F.col("u") >= limit).cast("int")
    return each.withColumn("w", weight).groupBy(F.col("g").alias(group), "rep").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("e")).alias("total"))


def interval(errors: DataFrame, group: str, id: str, error: str, repeats: int = REPEATS) -> DataFrame:
    """(group, reps, low, high): 2.5 and 97.5 % points of the mean error over the resamples of a group."""
    means = weights(errors, group, id, error, repeats).where("n > 0").withColumn("m_", F.col("total") / F.col("n"))
    return means.groupBy(group).agg(F.count("*").alias("reps"), F.percentile("m_", 0.025).alias("low"), F.percentile("m_", 0.975).alias("high"))
