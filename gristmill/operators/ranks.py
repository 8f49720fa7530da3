"""Ordered and disordered pairs of a group without meeting them: rank agreement in n log n.

Of the pairs of a group, those that x and y order the other way are the inversions of y in the order of x. Groups beyond BUCKET
points are cut at quantiles of x and of y; a cut value is a range of its own, so that no range but of one value holds
much more than its share. Inversions inside a range of x, and inside a range of y between ranges of x, are counted by merging,
those across both from the counts of the cells of ranges. All counts are exact wherever the cuts fall.

Defined results: rows with a null x or y take no part; a null group is a group; empty tables give empty results; a group without two rows
that differ has agreement 0. Counts are 64-bit, so a group may have some 4 billion rows. Tasks hold a range of at
most some BUCKET points, or a MOST_CUTS-th of a larger group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.operators import folds

#: Points of a group, or of a range of values, that one task counts.
BUCKET = 1 << 17
#: Ranges of a group at most.
MOST_CUTS = 2048


def inversions(group: np.ndarray, y: np.ndarray, count: np.ndarray) -> np.ndarray:
    """By group: the pairs of rows, times their counts, of which the earlier has the greater y. Groups stand one after the other."""
    if not len(group):
        return np.zeros(0, np.int64)
    begin = folds.firsts(group)
    sizes = np.diff(np.append(begin, len(group)))
    place = np.arange(len(group)) - np.repeat(begin, sizes)
    rank = np.unique(y, return_inverse=True)[1].astype(np.int64)
    total = np.zeros(len(begin), np.int64)
    order = np.arange(len(group))
    width = 1
    while width < sizes.max():
        right = place // width & 1
        block = np.cumsum(place % (2 * width) == 0) - 1
        # both halves of a block are sorted already, which a stable sort merges
        key = (block * (int(rank.max()) + 1) + rank) * 2 + right
        order = order[np.argsort(key[order], kind="stable")]
        left = np.where(right[order] == 0, count[order], 0)
        upto = np.cumsum(left)
        here = block[order]
        first = folds.firsts(here)
        before = np.append(0, upto)[first]
        whole = np.append(upto[first[1:] - 1], upto[-1]) - before
        greater = whole[here] - (upto - before[here])
        np.add.at(total, group[order], np.where(right[order] == 1, greater * count[order], 0))
        width *= 2
    return total


def _fold(table: pa.Table, group: np.ndarray) -> pa.Table:
    first = folds.firsts(group)
    d = inversions(group, table.column("y").to_numpy(), table.column("c").to_numpy())
    return pa.table({"g": table.column("g").take(pa.array(first)), "d": pa.array(d)})


def _cells(table: pa.Table, group: np.ndarray) -> pa.Table:
    """Disordered pairs of cells, from running sums over the grid of a group's ranges."""
    first = folds.firsts(group)
    out = []
    for lo, hi in zip(first, np.append(first[1:], len(group)), strict=True):
        bx, by, c = (table.column(k).to_numpy()[lo:hi] for k in ("x", "y", "c"))
        xs, i = np.unique(bx, return_inverse=True)
        ys, j = np.unique(by, return_inverse=True)
        grid = np.zeros((len(xs), len(ys)), np.int64)
        grid[i, j] = c
        earlier = np.cumsum(grid, axis=0) - grid
        above = np.cumsum(earlier[:, ::-1], axis=1)[:, ::-1] - earlier
        out.append(int((grid * above).sum()))
    return pa.table({"g": table.column("g").take(pa.array(first)), "d": pa.array(out, pa.int64())})


def _of(groups: list) -> Column:
    """True for rows of these groups, null among them or not."""
    some = F.coalesce(F.col("g").isin([g for g in groups if g is not None]), F.lit(False))
    return some | F.col("g").isNull() if None in groups else some


def _cuts(points: DataFrame) -> dict:
    """Sorted cut values of x and of y of every group beyond BUCKET points: some four numbers a bucket of points."""
    big = {r.g: r.n for r in points.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).collect()}
    if not big:
        return {}
    shares = F.array(*[F.lit(i / MOST_CUTS) for i in range(1, MOST_CUTS)])
    found = points.where(_of(list(big))).groupBy("g").agg(*[F.percentile_approx(v, shares, F.lit(8 * MOST_CUTS)).alias(v) for v in ("x", "y")])
    step = {g: max(1, MOST_CUTS * BUCKET // n) for g, n in big.items()}
    return {r.g: tuple(np.unique(np.array(v)[step[r.g] - 1 :: step[r.g]]) for v in (r.x, r.y)) for r in found.collect()}


def _ranged(points: DataFrame, cuts: dict) -> DataFrame:
    """points of the groups that are cut, with bx and by: even numbers between cuts, odd ones for cut values."""
    known = points.sparkSession.sparkContext.broadcast(cuts)

    def run(batches):
        for b in batches:
            table = pa.Table.from_batches([b])
            code = table.column("g").combine_chunks().dictionary_encode(null_encoding="encode")
            index = code.indices.to_numpy(zero_copy_only=False)
            ranges = np.zeros((2, b.num_rows), np.int32)
            for i, g in enumerate(code.dictionary.to_pylist()):
                mine = np.flatnonzero(index == i)
                for k, c in enumerate(("x", "y")):
                    v, at = table.column(c).to_numpy()[mine], known.value[g][k]
                    low = np.searchsorted(at, v, side="left")
                    ranges[k, mine] = 2 * low + (np.searchsorted(at, v, side="right") > low)
            yield from table.append_column("bx", pa.array(ranges[0])).append_column("by", pa.array(ranges[1])).to_batches()

    schema = T.StructType([*points.schema.fields, T.StructField("bx", T.IntegerType()), T.StructField("by", T.IntegerType())])
    return points.mapInArrow(run, schema)


def disordered(points: DataFrame) -> DataFrame:
    """(g, d): pairs of rows with x and y in opposite order, over points(g, x, y, c), each (g, x, y) once; a group may have several rows to add up."""
    kind = points.schema["g"].dataType.simpleString()
    out = f"g {kind}, d long"
    cuts = _cuts(points)
    if not cuts:
        return folds.by_key(points, ["g"], ["x", "y"], out, _fold)
    named = _of(list(cuts))
    small = folds.by_key(points.where(~named), ["g"], ["x", "y"], out, _fold)
    ranged = _ranged(points.where(named), cuts)
    inside = folds.by_key(ranged.where("bx % 2 = 0").select("g", "bx", "x", "y", "c"), ["g", "bx"], ["x", "y"], out, _fold)
    between = folds.by_key(ranged.where("by % 2 = 0").select("g", "by", F.col("bx").alias("x"), "y", "c"), ["g", "by"], ["x", "y"], out, _fold)
    cells = ranged.groupBy("g", F.col("bx").alias("x"), F.col("by").alias("y")).agg(F.sum("c").alias("c"))
    across = folds.by_key(cells, ["g"], ["x", "y"], out, _cells)
    return small.unionByName(inside).unionByName(between).unionByName(across)


def pair_counts(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, pairs, same_x, same_y, same_both, disordered): pairs of a group's rows by how x and y order them."""
    points = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(group).alias("g"), F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("c"))
    two = lambda c: F.expr(f"{c} * ({c} - 1) div 2")
    names = ("pairs", "same_x", "same_y", "same_both", "d")
    part = lambda rows, name, value: rows.select("g", *[(value if n == name else F.lit(0).cast("long")).alias(n) for n in names])
    every = part(points.groupBy("g").agg(F.sum("c").alias("c")), "pairs", two("c"))
    every = every.unionByName(part(points.groupBy("g", "x").agg(F.sum("c").alias("c")), "same_x", two("c")))
    every = every.unionByName(part(points.groupBy("g", "y").agg(F.sum("c").alias("c")), "same_y", two("c")))
    every = every.unionByName(part(points, "same_both", two("c"))).unionByName(part(disordered(points), "d", F.col("d")))
    return every.groupBy(F.col("g").alias(group)).agg(*[F.sum(n).alias("disordered" if n == "d" else n) for n in names])


def ordered() -> Column:
    """Pairs that x and y order alike, of pair_counts."""
    return F.col("pairs") - F.col("same_x") - F.col("same_y") + F.col("same_both") - F.col("disordered")


def kendall_tau_b(scores: DataFrame, group: str = "grp", x: str = "x", y: str = "y") -> DataFrame:
    """(group, tau): ordered less disordered pairs over the mean of pairs that x and that y part; 0 where either is constant."""
    counts = pair_counts(scores, group, x, y)
    parted = F.sqrt((F.col("pairs") - F.col("same_x")).cast("double") * (F.col("pairs") - F.col("same_y")))
    return counts.select(group, F.coalesce(F.try_divide((ordered() - F.col("disordered")).cast("double"), parted), F.lit(0.0)).alias("tau"))


def tier_order(rows: DataFrame, group: str, rank: str, importance: str) -> DataFrame:
    """(group, tier_order): the share of pairs of different rank that importance orders alike, ties a half; null without such pairs."""
    counts = pair_counts(rows, group, rank, importance)
    right = ordered() + (F.col("same_y") - F.col("same_both")) / 2
    return counts.select(group, F.try_divide(right, F.col("pairs") - F.col("same_x")).alias("tier_order"))
