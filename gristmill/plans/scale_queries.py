"""Queries whose plain form doesn't grow: percentiles by ranges, headings inside the row. The plain forms check them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.functions.dialect import DUCK, SPARK
from gristmill.operators import candidates as C
from gristmill.operators import posting as P
from gristmill.plans.catalog import register
from gristmill.plans.dual import check_text, checked, run, table
from gristmill.plans.text_queries import _headed

#: Values of a range.
RANGE = 1024


def nearest_ranks(samples: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, n, a column for each share, worst): the value at rank floor(share n + 0.5), one at least.

    Counts of ranges of values give each range its place, so no task holds all values of a group.
    """
    counts = samples.groupBy(group, F.col(value).alias("v")).agg(F.count("*").alias("c")).withColumn("range", F.floor(F.col("v") / RANGE))
    ranges = counts.groupBy(group, "range").agg(F.sum("c").alias("c"))
    upto = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(group, "range", F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy(group)).alias("n"))
    inside = Window.partitionBy(group, "range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.withColumn("upto", F.sum("c").over(inside)).join(ranges, [group, "range"]).withColumn("upto", F.col("upto") + F.col("before"))
    rank = lambda p: F.greatest(F.lit(1), F.floor(p * F.col("n") + 0.5))
    return rows.groupBy(group).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("upto") >= rank(p), F.col("v"))).alias(name) for name, p in shares.items()], F.max("v").alias("worst"))


checked(
    "a21_percentiles",
    lambda events: nearest_ranks(events, "event_type", "user_id", {"p50": 0.5, "p95": 0.95}),
    lambda d, t: f"SELECT event_type, len(vs) AS n, vs[greatest(1, floor(0.5 * len(vs) + 0.5)::BIGINT)] AS p50, vs[greatest(1, floor(0.95 * len(vs) + 0.5)::BIGINT)] AS p95, vs[len(vs)] AS worst FROM (SELECT event_type, list(user_id ORDER BY user_id) AS vs FROM {t('events')} GROUP BY event_type) x_",
    "events",
)


def _headed_docs(spark, sf_dir: str) -> DataFrame:
    return run(spark, lambda t: f"SELECT * FROM {_headed(SPARK, t)}", documents=table(spark, sf_dir, "documents"))


register("w1_heading_carry", lambda spark, sf_dir: C.sentences(_headed_docs(spark, sf_dir)).select("doc_id", "ord", "heading"), check_text(lambda d, t: f"SELECT doc_id, ord, heading FROM {P.sentences(d, _headed(d, t))} q_"))


def _f1(spark, sf_dir: str) -> DataFrame:
    rows = C.sentences(_headed_docs(spark, sf_dir)).withColumn("section", F.expr(T.resume_section(SPARK, "heading")))
    return rows.where(~F.col("strong") & ~F.col("section").isin("summary", "other")).select("doc_id", "ord", "ref")


register("f1_section_filter", _f1, check_text(lambda d, t: f"SELECT doc_id, ord, ref FROM (SELECT doc_id, ord, ref, strong, {T.resume_section(d, 'heading')} AS section FROM {P.sentences(d, _headed(d, t))} q_) r_ WHERE NOT strong AND section NOT IN ('summary', 'other')"))
