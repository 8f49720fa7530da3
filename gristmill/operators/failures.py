"""Errors that stay with their key: one bad answer loses its posting or pair, and the others go on.

A stage's rows are judged by a column that says what is wrong with them, null if nothing is. All rows of a key with a wrong
one leave the run there; the key, the stage and the first message stand in a table of their own, written once.
Without such a table the run is strict: the first wrong row fails the job.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors reach: the session's checkpoint folder, or the one named in spark.checkpoint.dir; where none is
    named, a temporary one on a single machine, an error on a cluster."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share: answers are written there")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="gristmill-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def materialised(df: DataFrame) -> DataFrame:
    """Written to the shared folder, so that a lost executor asks nothing again. As Parquet: a checkpoint's rows are not compressed."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Failures:
    """What failed in a run, by key and stage."""

    def __init__(self, *keys: str):
        self.keys = list(keys)
        self._parts: list[DataFrame] = []

    def note(self, wrong: DataFrame, stage: str) -> DataFrame:
        """Adds wrong(keys..., error_) and returns its keys."""
        first = materialised(wrong.groupBy(*self.keys).agg(F.min("error_").alias("error"), F.count("*").alias("rows")).withColumn("stage", F.lit(stage)))
        self._parts.append(first)
        return first.select(*self.keys)

    def without(self, rows: DataFrame) -> DataFrame:
        """rows of the keys that haven't failed so far."""
        for part in self._parts:
            rows = rows.join(part.select(*self.keys), self.keys, "left_anti")
        return rows

    def table(self, spark: SparkSession, kinds: dict[str, str] | None = None) -> DataFrame:
        """(keys..., stage, error, rows): a key once, where it failed first. kinds: types of the keys for a run without stages."""
        if not self._parts:
            return spark.createDataFrame([], ", ".join(f"{k} {(kinds or {}).get(k, 'string')}" for k in self.keys) + ", stage string, error string, rows long")
        out = self._parts[0]
        for part in self._parts[1:]:
            out = out.unionByName(part)
        return out.select(*self.keys, "stage", "error", "rows")


def settled(rows: DataFrame, wrong: Column, stage: str, failures: Failures | None) -> DataFrame:
    """rows without the keys of wrong ones, which are noted; strict without a table of failures: the job fails with the first message."""
    if failures is None:
        return rows.where(F.when(wrong.isNull(), F.lit(True)).otherwise(F.raise_error(wrong).cast("boolean")))
    marked = rows.withColumn("error_", wrong)
    lost = failures.note(marked.where("error_ IS NOT NULL"), stage)
    return marked.drop("error_").join(lost, failures.keys, "left_anti")
