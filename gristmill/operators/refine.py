"""Refinement of accepted values: request batches, alternative components, one-to-one label matching.

All three are sequential inside one posting or fixture and independent between them, so each key's rows are folded by one
task, many keys at a time; a key holds what one posting holds (its rows must fit in a task), and nothing crosses keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import lexicon as X
from gristmill.operators import folds


def size_batches(questions: DataFrame, key: str, order: str, size: str, limit: int = X.REFINEMENT_BYTES) -> DataFrame:
    """(key, order, batch): batches from 0 in order; a question that would lift the running size over the limit opens the next.

    A question larger than the limit stands alone. Null sizes count as 0.
    """
    kind = questions.schema[order].dataType.simpleString()
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("n"))))
    zero = F.struct(F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<o:{kind},batch:bigint>>").alias("out"))

    def step(s, x):
        over = (s["used"] > 0) & (s["used"] + x["n"] > limit)
        batch = s["batch"] + over.cast("long")
        used = F.when(over, x["n"]).otherwise(s["used"] + x["n"])
        return F.struct(batch.alias("batch"), used.alias("used"), F.concat(s["out"], F.array(F.struct(x["o"].alias("o"), batch.alias("batch")))).alias("out"))

    folded = questions.groupBy(key).agg(items.alias("items")).select(key, F.explode(F.aggregate("items", zero, step)["out"]).alias("x"))
    return folded.select(key, F.col("x.o").alias(order), "x.batch")


def batch_starts(sizes: Column, limit: int = X.REFINEMENT_BYTES) -> Column:
    """Where batches begin among an array of sizes: those of `size_batches`, inside a row; none for an empty array."""
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("at"), F.lit(0).alias("n"))

    def step(s, x):
        size = F.coalesce(x.cast("long"), F.lit(0).cast("long"))
        over = (s["n"] == 0) | ((s["used"] > 0) & (s["used"] + size > limit))
        return F.struct(F.when(over, size).otherwise(s["used"] + size).alias("used"), F.when(over, F.array_append(s["at"], s["n"])).otherwise(s["at"]).alias("at"), (s["n"] + 1).alias("n"))

    return F.aggregate(sizes, zero, step)["at"]


def components(links: DataFrame, key: str, a: str = "a", b: str = "b") -> DataFrame:
    """(key, node, component): the smallest node that links inside the key reach, oneself included; links have no direction.

    Trees of nodes with path halving, the smallest node on top; links with a null end are left out.
    """
    kinds = [links.schema[c].dataType.simpleString() for c in (key, a)]

    def fold(table: pa.Table, group: np.ndarray) -> pa.Table:
        ends = pa.chunked_array([table.column("a").combine_chunks(), table.column("b").combine_chunks()]).combine_chunks().dictionary_encode()
        by_value = pc.sort_indices(ends.dictionary).to_numpy()
        place = np.empty(len(by_value), np.int64)
        place[by_value] = np.arange(len(by_value))
        of = np.append(group, group) * len(place) + place[ends.indices.to_numpy()]
        nodes, number = np.unique(of, return_inverse=True)
        up = list(range(len(nodes)))

        def top(i: int) -> int:
            while up[i] != i:
                up[i] = i = up[up[i]]
            return i

        for i, j in zip(number[: len(group)].tolist(), number[len(group) :].tolist(), strict=True):
            i, j = top(i), top(j)
            if i != j:
                up[max(i, j)] = min(i, j)
        roots = np.array([top(i) for i in range(len(nodes))], np.int64)
        named = lambda x: ends.dictionary.take(pa.array(by_value[x % len(place)]))
        keys = table.column("k").take(pa.array(folds.firsts(group)[nodes // len(place)]))
        return pa.table({"k": keys, "node": named(nodes), "component": named(nodes[roots])})

    whole = links.select(F.col(key).alias("k"), F.col(a).alias("a"), F.col(b).cast(kinds[1]).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    found = folds.by_key(whole, ["k"], [], f"k {kinds[0]}, node {kinds[1]}, component {kinds[1]}", fold)
    return found.withColumnRenamed("k", key)


def greedy_match(edges: DataFrame, key: str, left: str, right: str, order: list[str], also: list[str] | tuple = ()) -> DataFrame:
    """(key, left, right, also...): edges in the given order, each taken while both its ends are free; a null is an end like others. also: of the columns of order."""
    kinds = [edges.schema[c].dataType.simpleString() for c in (key, left, right)]

    def fold(table: pa.Table, group: np.ndarray) -> pa.Table:
        ends = [table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in ("l", "r")]
        of = [np.unique(group * (int(e.max(initial=0)) + 1) + e, return_inverse=True)[1].tolist() for e in ends]
        used = [bytearray(len(e)) for e in of]
        taken = []
        for i, (x, y) in enumerate(zip(*of, strict=True)):
            if not used[0][x] and not used[1][y]:
                used[0][x] = used[1][y] = 1
                taken.append(i)
        return table.select(["k", "l", "r", *carried]).take(pa.array(taken, pa.int64()))

    carried = [f"o{order.index(c)}" for c in also]
    named = [f"o{i}" for i in range(len(order))]
    rows = edges.select(F.col(key).alias("k"), *[F.col(c).alias(n) for c, n in zip(order, named, strict=True)], F.col(left).alias("l"), F.col(right).alias("r"))
    found = folds.by_key(rows, ["k"], [*named, "l", "r"], ", ".join([f"k {kinds[0]}, l {kinds[1]}, r {kinds[2]}", *(f"{n} {edges.schema[c].dataType.simpleString()}" for n, c in zip(carried, also, strict=True))]), fold)
    return found.withColumnsRenamed({"k": key, "l": left, "r": right} | dict(zip(carried, also, strict=True)))
