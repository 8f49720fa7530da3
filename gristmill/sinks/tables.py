"""A table that readers see whole: versions side by side, and a small file that names the current one.

A new version is written beside the old one, then the file is replaced in one step; whoever reads meanwhile has the old table, and a writer that dies
leaves it as it was. The version before the current one stays for its readers. One writer at a time: a second one's replacement wins whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Not hidden: readers leave out files whose names begin with _ or a dot.
POINTER = "current.txt"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _named(spark: SparkSession, path: str) -> list[str]:
    """The current version's name and the one before, of a table; empty where there is none."""
    at, files = _files(spark, f"{path}/{POINTER}")
    if not files.exists(at):
        return []
    return [r.value for r in spark.read.text(str(files.resolvePath(at))).collect() if r.value]


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path, None where nothing was written yet."""
    names = _named(spark, path)
    return spark.read.parquet(f"{path}/{names[0]}") if names else None


def _point(spark: SparkSession, path: str, names: list[str]) -> None:
    """Replaces the pointer in one step."""
    jvm = spark._jvm
    target, files = _files(spark, f"{path}/{POINTER}")
    fresh = jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}-{uuid.uuid4().hex}")
    out = files.create(fresh, True)
    out.write(bytearray("\n".join(names).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(target).toUri(), spark._jsc.hadoopConfiguration())
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    context.rename(files.makeQualified(fresh), files.makeQualified(target), over)


def replace(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """rows become the table at path."""
    before = _named(spark, path)
    name = f"v-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{name}")
    _point(spark, path, [name, *before[:1]])
    for old in before[1:]:
        at, files = _files(spark, f"{path}/{old}")
        files.delete(at, True)


def upsert(spark: SparkSession, rows: DataFrame, path: str, keys: list[str]) -> None:
    """The table at path with rows in place of those of the same keys, null keys equal; rows hold a key once."""
    known = current(spark, path)
    if known is not None:
        same = [known[k].eqNullSafe(rows[k]) for k in keys]
        rows = known.join(rows, same, "left_anti").unionByName(rows)
    replace(spark, rows, path)
