"""One digest of a table of labels, whatever its partitions: a tree over ranges of the ids' hashes.

Rows stand in the order of the SHA-256 of their id. A leaf is the digest of the rows of a range of these hashes, in order; a node that of its
children's digests, in order. No task holds more than a range of rows or 256 digests, and a change, an added or a lost row changes the root.

Defined results: nulls differ from all texts; equal rows count as often as they come; an empty table has the digest of nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits that name a leaf and each level of nodes above it: 65,536 leaves, 256 nodes, the root.
LEVELS = (4, 2, 0)


def digest(rows: DataFrame, id: str, content: Column) -> DataFrame:
    """One row with `digest`: 64 hexadecimal digits over ids and contents."""
    text = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    line = F.concat(text(F.col(id)), F.lit("\n"), text(content), F.lit("\n"))
    level = rows.select(F.sha2(text(F.col(id)), 256).alias("k"), F.sha2(line, 256).alias("h"))
    for digits in LEVELS:
        name = F.substring("k", 1, digits).alias("k")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "")
        level = (level.groupBy(name) if digits else level.groupBy()).agg(F.sha2(joined, 256).alias("h"))
    return level.select(F.col("h").alias("digest"))


def labels_hash(rows: DataFrame, id: str, content: Column) -> DataFrame:
    """The first twelve digits, as `labels_hash`."""
    return digest(rows, id, content).select(F.substring("digest", 1, 12).alias("labels_hash"))
