"""Folding the rows of a key in order, whole keys at a time, over sorted partitions.

Rows are dealt out by key, sorted inside their tasks, and read as Arrow batches; a batch that ends inside a key waits
for the rest of it. So a task holds the rows of one key at least and of a batch of keys at most: a key's rows must fit in a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Fold = Callable[[pa.Table, np.ndarray], pa.Table]


def _codes(column) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """True for rows whose key differs from that of the row before; the first row's is True."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        codes = _codes(table.column(k))
        new[1:] |= codes[1:] != codes[:-1]
    return new


def in_order(rows: DataFrame, keys: list[str], schema: str, fold: Fold) -> DataFrame:
    """fold(table, key number of each row) over whole keys of rows that lie key by key in their partitions, as a window over the keys leaves them."""

    def run(batches):
        def folded(parts):
            table = pa.Table.from_batches(parts).combine_chunks()
            return fold(table, np.cumsum(starts(table, keys)) - 1).to_batches()

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            last = [held[-1].slice(held[-1].num_rows - 1)] if held else []
            new = np.flatnonzero(starts(pa.Table.from_batches([*last, b]), keys)[len(last) :])
            cut = int(new[-1]) if len(new) else 0
            if len(new) and (held or cut):
                yield from folded([*held, b.slice(0, cut)] if cut else held)
                held = [b.slice(cut)]
            else:
                held.append(b)
        if held:
            yield from folded(held)

    return rows.mapInArrow(run, schema)


def by_key(rows: DataFrame, keys: list[str], order: list[str], schema: str, fold: Fold) -> DataFrame:
    """fold(table, key number of each row) over whole keys, rows of a key in the given order, nulls first."""
    # by a hash of the keys, not by the keys: a repartition by the keys of a join below would be left out, and its rows spread again if the join is broadcast at run time
    dealt = rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)
    return in_order(dealt, keys, schema, fold)


def firsts(group: np.ndarray) -> np.ndarray:
    """The first row of each key of a fold."""
    return np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
