"""The queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from gristmill.llm import anisotropic, impacts, linespread, mil, mtree, nnpu, packing, periods, pfair, simhash, skipchain, suffix, telephony
from gristmill.llm.common import table

#: Target weights of op4_pfair; sources not named share the mean of these.
TARGETS = {"src0": 3, "src1": 7, "src2": 0.35, "src3": 2.5, "src4": 1}

Query = Callable[[SparkSession, str], DataFrame]


def op1_anisotropic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anisotropic.nearest(table(spark, sf_dir, "embeddings"))


def op2_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_linespread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linespread.digest(table(spark, sf_dir, "documents"))


def op4_pfair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), TARGETS)


def op5_skipchain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skipchain.digest(table(spark, sf_dir, "documents"))


def op6_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nnpu.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op8_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_products(table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(table(spark, sf_dir, "documents"))


def op11_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impacts.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digest(table(spark, sf_dir, "documents"))


def op13_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    operators = (op1_anisotropic, op2_mil, op3_linespread, op4_pfair, op5_skipchain, op6_nnpu, op7_simhash, op8_mtree, op9_packing, op10_suffix, op11_impacts, op12_periods, op13_telephony)
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in operators}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_linespread": linespread.digest_sql(),
        "op4_pfair": "SELECT doc_id, source, n_chars, block, release, deadline, slot, place FROM " + pfair.mix_sql("documents", TARGETS),
        "op11_impacts": impacts.search_sql(),
    }
