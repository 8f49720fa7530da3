"""Operators of a training-data pipeline: search, scoring, deduplication, mixing, packing."""
