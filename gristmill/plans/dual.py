"""Registers a builder of SQL text as an engine query and as its check."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gristmill.functions.dialect import DUCK, SPARK
from gristmill.plans.catalog import register

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def run(spark: SparkSession, sql: Callable[[Callable[[str], str]], str], **frames: DataFrame) -> DataFrame:
    """Spark SQL over named frames. sql: from a function that names the frames; names are this call's own, so calls don't meet."""
    names = {name: f"gm_{name}_{uuid.uuid4().hex}" for name in frames}
    for name, frame in frames.items():
        frame.createOrReplaceTempView(names[name])
    try:
        return spark.sql(sql(names.__getitem__))
    finally:
        for name in names.values():  # the plan holds the frames themselves
            spark.catalog.dropTempView(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(frame) if name == "documents" else frame


def spread(frame: DataFrame) -> DataFrame:
    """A text table in fewer partitions than cores, as from one small file, dealt out; larger inputs stay as they are."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def dual(name: str, build: Callable, *tables: str) -> None:
    """build(d, t): the query's SQL in dialect d, t(table) naming a table."""
    wrong = set(tables) - set(TABLES)
    if wrong:
        raise ValueError(f"no such table: {wrong}")

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(spark, lambda t: build(SPARK, t), **{t: table(spark, sf_dir, t) for t in tables})

    register(name, query, check_text(build))


def check_text(build: Callable) -> str:
    """The DuckDB text of a builder."""
    return build(DUCK, lambda t: t).replace(" AS STRING)", " AS VARCHAR)")


def checked(name: str, query: Callable[..., DataFrame], build: Callable, *tables: str) -> None:
    """query(frames...): DataFrame operators; build(d, t): SQL written apart from them, which checks their rows."""
    register(name, lambda spark, sf_dir: query(*(table(spark, sf_dir, t) for t in tables)), check_text(build))
