"""The registered queries of the engine, each with its SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"query {name} is registered twice")
    _QUERIES[name] = query
    if sql is not None:
        _ORACLE[name] = sql


def _load() -> None:
    """Importing these modules registers their queries."""
    from gristmill.plans import group_queries, judge_queries, refine_queries, round_queries, scale_queries, score_queries, stage_queries, text_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match scores of all pairs, the flagship formula."""
    return queries()["m1_match_score"](spark, sf_dir)
