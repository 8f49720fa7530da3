"""Refits of the match weights: sums of products in Spark, small systems in numpy, one fold for each group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RIDGE = 1e-3


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions of a stack of systems; NaN where a matrix is singular."""
    out = np.full(b.shape, np.nan)
    good = np.abs(np.linalg.det(a)) > 1e-12
    if good.any():
        out[good] = np.linalg.solve(a[good], b[good][..., None])[..., 0]
    return out


def feature(name: str) -> Column:
    """A feature of a pair by its name: a signal's column, one of the scaled ones, or a product of features joined by *.

    Missing gaps count 0; months of a gap count up to two years, in years of twelve months.
    """
    if "*" in name:
        first, rest = name.split("*", 1)
        return feature(first) * feature(rest)
    some = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    scaled = {"fit": lambda: F.col("fit") / 100, "resp": lambda: F.col("responsibilities"), "dom": lambda: F.col("domain_mismatch"), "gap": lambda: some("primary_gap"), "loc": lambda: some("location_mismatch"), "months": lambda: F.least(some("gap_months"), F.lit(24.0)) / 12}
    return scaled[name]() if name in scaled else F.col(name)


def products(rows: DataFrame, group: str, features: list[str], target: str) -> DataFrame:
    """(group, s array): sums of the features' products, row by row, then of their products with the target."""
    pairs = [F.col(x) * F.col(y) for x in features for y in features] + [F.col(x) * F.col(target) for x in features]
    return rows.groupBy(group).agg(F.array(*[F.sum(p).cast("double") for p in pairs]).alias("s"))


def _solver(k: int):
    @F.pandas_udf("array<double>")
    def weights(sums: pd.Series) -> pd.Series:
        flat = np.stack([np.asarray(s, float) for s in sums]) if len(sums) else np.zeros((0, k * k + k))
        a = flat[:, : k * k].reshape(-1, k, k) + RIDGE * np.diag([0.0] + [1.0] * (k - 1))
        return pd.Series(list(solve(a, flat[:, k * k :])))

    return weights


def predicted(weights: Column, features: list[str]) -> Column:
    """0 to 100, halves to even; null without weights or features, which greatest and least would pass over."""
    raw = sum((weights[i] * F.col(f) for i, f in enumerate(features)), F.lit(0.0))
    return F.when(raw.isNotNull() & ~F.isnan(raw), F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))).cast("long"))


def leave_one_group_out(rows: DataFrame, group: str, features: list[str], target: str) -> DataFrame:
    """(group, n, mae, bias): each group's pairs as predicted by weights fitted to all other groups.

    The first feature is the intercept and isn't shrunk. Each fold's sums are the totals minus the group's own, so
    one aggregation serves all folds. A fold without a solution has null figures.
    """
    sums = products(rows, group, features, target)
    size = len(features) * (len(features) + 1)
    total = sums.agg(F.array(*[F.sum(F.col("s")[i]) for i in range(size)]).alias("t"))  # one row
    folds = sums.crossJoin(F.broadcast(total)).select(group, F.zip_with("t", "s", lambda t, s: t - s).alias("rest"))
    fitted = folds.select(group, _solver(len(features))("rest").alias("w"))
    error = predicted(F.col("w"), features) - F.col(target)
    scored = rows.join(fitted, group).select(group, error.alias("e"))
    return scored.groupBy(group).agg(F.count("*").alias("n"), F.avg(F.abs("e").cast("double")).alias("mae"), F.avg(F.col("e").cast("double")).alias("bias"))
