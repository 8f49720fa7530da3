"""The corpus pipeline: quality, boilerplate lines, near duplicates, mixture, packing.

Each stage takes all rows that the one before kept; every stage but the last returns the columns of
`documents`, whatever their names. Between stages the rows are written as Parquet into the shared folder and read
again. The mixture's decision is the order of its rows and files; packing follows it.

Defined results: null and empty texts, null and repeated ids and repeated rows fare as in each operator's
docstring; an empty table gives an empty result; extra columns pass through to the last stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import linespread, mil, neardup, packing, pfair
from gristmill.llm.common import free_name, shared_folder, shuffle_partitions, small_batches, table

#: Of target shares by characters: 1 keeps the sources' own shares, 0 makes them equal.
TEMPERATURE = 0.5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _only(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*(F.col(f"`{c}`") for c in columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    small_batches(spark)
    model = mil.fit(docs, table(spark, sf_dir, "labels"))
    score = free_name("score", docs.columns)
    return _only(mil.score(docs, model).where(F.col(score) >= mil.KEEP_AT), docs.columns)


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that stand on many sites; n_chars follows the text."""
    out = linespread.remove_boilerplate(docs)
    if "n_chars" in docs.columns:
        removed = F.col(free_name("lines_removed", docs.columns))
        out = out.withColumn("n_chars", F.when(removed > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return _only(out, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of copies and near copies."""
    small_batches(spark)
    return _only(neardup.deduplicate(docs), docs.columns)


def target_weights(docs: DataFrame) -> dict[str, float]:
    """Target share by source: its characters to the power of TEMPERATURE, so that large sources give way to small ones."""
    source = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")
    chars = docs.groupBy(source).agg(F.sum(F.coalesce(F.length("text").cast("long"), F.lit(0))).alias("chars"))
    return {r.source: round(max(1, r.chars) ** TEMPERATURE) for r in chars.collect()}


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the Pfair schedule of the target weights: files follow it, and rows in a file."""
    place = free_name("place", docs.columns)
    order = pfair.mix(docs, target_weights(docs)).repartitionByRange(shuffle_partitions(spark), place).sortWithinPartitions(place)
    return _only(order, docs.columns)


def in_file_order(docs: DataFrame) -> tuple[DataFrame, str | None]:
    """docs with a column that rises with a row's place in the table's files, and its name; None where docs isn't read from files."""
    name = free_name("place", docs.columns)
    file = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).try_cast("long")
    try:
        return docs.select("*", (F.shiftleft(F.coalesce(file, F.lit(0)), 40) + F.col("_metadata.row_index")).alias(name)), name
    except AnalysisException:
        return docs, None


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training windows; retrieval stays within consecutive ranges of the mixture's order."""
    small_batches(spark)
    placed, place = in_file_order(docs)
    return packing.pack(placed, order_col=place)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("boilerplate", boilerplate),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("pack", pack),
]

#: SQL can't express the classifier, the fingerprints or the packing.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, read from the shared folder; a stage's table goes once the next one is written."""
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            _delete(spark, before)
        before = at
    return docs
