"""Match Score, Fit Score and agreement as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import lexicon as X


def match_score(role_match: Column, experience_short: Column, blocker: Column, weights: tuple[float, float, float] = X.MATCH_WEIGHTS) -> Column:
    """0 to 100, halves away from zero; null where a signal is."""
    base, role, short = weights
    raw = (F.lit(base) + F.lit(role) * role_match + F.lit(short) * experience_short) * (1 - blocker)
    return F.when(raw.isNotNull(), F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))).cast("int"))


def _pick(column: str, values: dict[str, float]) -> Column:
    """The value of a name; what is missing counts 0."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col(column)), F.lit(0.0))


def score_fit(coverage: DataFrame, members: DataFrame, credit: dict[str, float] | None = None, tier_weight: dict[str, float] | None = None) -> DataFrame:
    """(pair, fit, by_tier, gaps) of coverage(pair, req_ord, req_id, tier, coverage) and members(pair, group_ord, group_id, member_id).

    A group is one item: its best member's coverage and strongest member's tier; a requirement belongs to its
    first group. Unknown tiers count as mentioned, entries missing from the tables as 0. by_tier: the unweighted credit of each tier that occurs.
    """
    credit, tier_weight = X.CREDIT if credit is None else credit, X.TIER_WEIGHT if tier_weight is None else tier_weight
    first = members.groupBy("pair", F.col("member_id").alias("req_id")).agg(F.min_by("group_id", "group_ord").alias("group_id"))
    ranks = {"strong": 3, "partial": 2, "weak": 1, "none": 0}
    tiers = {"required": 2, "preferred": 1, "mentioned": 0}
    rank = lambda c, known: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.col(c)), F.lit(0))
    rows = coverage.join(first, ["pair", "req_id"], "left").withColumn("item", F.coalesce("group_id", "req_id"))
    items = rows.groupBy("pair", "item").agg(F.max(rank("coverage", ranks)).alias("c"), F.max(rank("tier", tiers)).alias("t"), F.min("req_ord").alias("ord"))
    named = items.withColumn("coverage", F.element_at(F.array(F.lit("none"), F.lit("weak"), F.lit("partial"), F.lit("strong")), F.col("c") + 1)).withColumn("tier", F.element_at(F.array(F.lit("mentioned"), F.lit("preferred"), F.lit("required")), F.col("t") + 1))
    weighted = named.withColumn("w", _pick("tier", tier_weight)).withColumn("credit", _pick("coverage", credit))
    # nine digits first, so that a half is one whatever the order of the sum
    whole = lambda share: F.round(F.round(100 * share, 9)).cast("int")
    gap = F.when((F.col("tier") == "required") & (F.col("coverage") == "none"), F.struct("ord", "item"))
    own = [F.when(F.count(F.when(F.col("tier") == t, 1)) > 0, F.struct(F.lit(t).alias("key"), whole(F.avg(F.when(F.col("tier") == t, F.col("credit")))).alias("value"))) for t in X.TIER_WEIGHT]
    out = weighted.groupBy("pair").agg(whole(F.coalesce(F.try_divide(F.sum(F.col("w") * F.col("credit")), F.sum("w")), F.lit(0.0))).alias("fit"), F.map_from_entries(F.filter(F.array(*own), lambda x: x.isNotNull())).alias("by_tier"), F.array_sort(F.collect_list(gap)).alias("g"))
    return out.select("pair", "fit", "by_tier", F.transform("g", lambda x: x["item"]).alias("gaps"))


def agreement(scores: DataFrame) -> DataFrame:
    """One row of n, bias, mae, worst, within_5, within_10, pearson over scores(score, reference)."""
    e = F.col("score") - F.col("reference")
    s = scores.agg(
        F.count("*").alias("n"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.max(F.abs(e)).alias("worst"), F.avg((F.abs(e) <= 5).cast("double")).alias("within_5"), F.avg((F.abs(e) <= 10).cast("double")).alias("within_10"),
        F.avg("score").alias("ms"), F.avg("reference").alias("mr"), F.avg(F.col("score") * F.col("reference")).alias("sr"), F.avg(F.col("score") * F.col("score")).alias("ss"), F.avg(F.col("reference") * F.col("reference")).alias("rr"),
    )
    spread = F.sqrt(F.col("ss") - F.col("ms") * F.col("ms")) * F.sqrt(F.col("rr") - F.col("mr") * F.col("mr"))
    return s.select("n", "bias", "mae", "worst", "within_5", "within_10", F.coalesce(F.try_divide(F.col("sr") - F.col("ms") * F.col("mr"), spread), F.lit(0.0)).alias("pearson"))


def top_k(answers: DataFrame, unit: str, k: int = X.RETRIEVE_K, floor: float = X.RETRIEVE_FLOOR) -> DataFrame:
    """answers(unit, option, p): the k best options of a unit with p at the floor or above, ties by option."""
    w = Window.partitionBy(unit).orderBy(F.col("p").desc(), "option")
    return answers.where((F.col("p") >= floor) & (F.col("option") != "none")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
