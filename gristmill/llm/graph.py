"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import cut

#: Edges of a partition at least. A small graph so lies in one partition and is gone through without a shuffle; with as many partitions
#: as the session has, the rounds would leave mostly empty files.
EDGES = 1 << 15


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node of the component; nodes without edges are absent.

    Each round attaches larger neighbours, then smaller ones, to a node's smallest neighbour; the
    rounds grow with the logarithm of the component's size. Self loops and repeated edges are allowed.
    Every round is cut into the shared checkpoint folder.
    """
    now = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    before = _state(now)
    parts = -(-before[0] // EDGES)  # the rounds never add edges
    beside = F.broadcast if parts == 1 else lambda x: x  # joined by sorting, one partition would be dealt out again
    while before[0]:
        now = now.coalesce(parts)
        both = now.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(beside(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(beside(least), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").coalesce(parts).distinct())
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
