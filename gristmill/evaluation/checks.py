"""Coverage against labelled links, pairs against reference scores, and the table of both arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.ranks import kendall_tau_b
from gristmill.operators.score import agreement


def rank(strength: Column) -> Column:
    return F.when(strength == "strong", 3).when(strength == "partial", 2).when(strength == "weak", 1).otherwise(0)


def resolve_quotes(labels: DataFrame, units: DataFrame) -> DataFrame:
    """(pair_id, value, quote, strength, unit_id): the one unit of the pair whose text holds the quote; none or several fail.

    labels(pair_id, value, quote, strength), units(pair_id, unit_id, text).
    """
    both = labels.join(units, "pair_id", "left")
    hits = both.groupBy("pair_id", "value", "quote", "strength").agg(F.collect_list(F.when(F.contains("text", "quote"), F.col("unit_id"))).alias("ids"))
    wrong = F.raise_error(F.concat(F.lit('quote "'), F.col("quote"), F.lit('" matches '), F.size("ids").cast("string"), F.lit(" units, want 1"))).cast("string")
    return hits.select("pair_id", "value", "quote", "strength", F.when(F.size("ids") == 1, F.get("ids", F.lit(0))).otherwise(wrong).alias("unit_id"))


def link_rows(coverage: DataFrame, wanted: DataFrame, retrieved: DataFrame, skip: DataFrame) -> DataFrame:
    """(pair_id, value, unit_id, want, got, was_retrieved): every labelled or predicted link of the requirements that aren't skipped.

    coverage(pair_id, value, evidence), wanted(pair_id, value, unit_id, strength), retrieved(pair_id, value, unit_id), skip(pair_id, value).
    """
    scored = coverage.join(skip, ["pair_id", "value"], "left_anti")
    got = scored.select("pair_id", "value", F.explode("evidence").alias("e")).select("pair_id", "value", F.col("e.unit").alias("unit_id"), F.col("e.strength").alias("got"))
    keys = ["pair_id", "value", "unit_id"]
    want = wanted.join(scored.select("pair_id", "value").distinct(), ["pair_id", "value"], "left_semi").select(*keys, F.col("strength").alias("want"))
    seen = retrieved.select(*keys).distinct().withColumn("was_retrieved", F.lit(True))
    return want.join(got, keys, "full").join(seen, keys, "left").na.fill(False, ["was_retrieved"])


def link_scores(links: DataFrame) -> DataFrame:
    """(pair_id, labeled, retrieved, labeled_sp, retrieved_sp, predicted, correct, exact, near)."""
    w, g, sp = F.col("want"), F.col("got"), F.col("want").isin("strong", "partial")
    n = lambda when: F.count(F.when(when, 1))
    gap = F.abs(rank(w) - rank(g))
    both = w.isNotNull() & g.isNotNull()
    return links.groupBy("pair_id").agg(n(w.isNotNull()).alias("labeled"), n(w.isNotNull() & F.col("was_retrieved")).alias("retrieved"), n(sp).alias("labeled_sp"), n(sp & F.col("was_retrieved")).alias("retrieved_sp"), n(g.isNotNull()).alias("predicted"), n(both).alias("correct"), n(both & (gap == 0)).alias("exact"), n(both & (gap <= 1)).alias("near"))


def coverage_rows(coverage: DataFrame, wanted: DataFrame, skip: DataFrame) -> DataFrame:
    """(pair_id, req_ord, id, value, tier, want, got) of the requirements that aren't skipped; want: the strongest label, or none."""
    best = wanted.groupBy("pair_id", "value").agg(F.max_by("strength", rank(F.col("strength"))).alias("want"))
    rows = coverage.join(skip, ["pair_id", "value"], "left_anti").join(best, ["pair_id", "value"], "left")
    return rows.select("pair_id", "req_ord", "id", "value", "tier", F.coalesce("want", F.lit("none")).alias("want"), F.col("coverage").alias("got"))


def tallies(rows: DataFrame) -> DataFrame:
    """(pair_id, tier, exact, covered, total)."""
    n = lambda when: F.count(F.when(when, 1))
    return rows.groupBy("pair_id", "tier").agg(n(F.col("want") == F.col("got")).alias("exact"), n((F.col("want") == "none") == (F.col("got") == "none")).alias("covered"), F.count("*").alias("total"))


def confusion(rows: DataFrame) -> DataFrame:
    """(want, strong, partial, weak, none)."""
    return rows.groupBy("want").pivot("got", ["strong", "partial", "weak", "none"]).agg(F.count(F.lit(1))).na.fill(0)


def checker_totals(links: DataFrame, tallied: DataFrame, fits: DataFrame) -> DataFrame:
    """One row over link_scores, tallies and fits(pair_id, got, want): recalls, precision, F1, strength, coverage and fit error."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(0.0))
    a = links.agg(F.count("*").alias("pairs"), ratio("retrieved", "labeled").alias("retrieval_recall"), ratio("retrieved_sp", "labeled_sp").alias("retrieval_recall_strong_partial"), ratio("correct", "predicted").alias("link_precision"), ratio("correct", "labeled").alias("link_recall"), ratio("exact", "correct").alias("strength_exact"), ratio("near", "correct").alias("strength_near"))
    both = F.col("link_precision") + F.col("link_recall")
    a = a.withColumn("link_f1", F.coalesce(F.try_divide(2 * F.col("link_precision") * F.col("link_recall"), both), F.lit(0.0)))
    b = tallied.agg(ratio("exact", "total").alias("coverage_exact"), ratio("covered", "total").alias("coverage_covered"))
    gap = F.abs(F.col("got") - F.col("want"))
    c = fits.agg(F.coalesce(F.avg(gap), F.lit(0.0)).alias("fit_error"), F.coalesce(F.max(gap), F.lit(0)).alias("fit_error_max"))
    one = lambda df: df.withColumn("one_", F.lit(1))
    return one(a).join(one(b), "one_").join(one(c), "one_").drop("one_")


def pair_totals(scores: DataFrame) -> DataFrame:
    """One row over scores(pair_id, reference, saved, match, fit, holistic_ms, extract_ms, check_ms, cost_micro_usd, error): agreement with reference
    scores, the same of fit, tau against saved scores, failures, whole mean milliseconds of the slower side, cost a pair."""
    one = lambda df: df.withColumn("one_", F.lit(1))
    rows = scores.where(F.coalesce("error", F.lit("")) == "")
    match = rows.where("match IS NOT NULL AND reference IS NOT NULL").select(F.lit(1).alias("grp"), F.col("pair_id").alias("id"), F.col("match").cast("double").alias("score"), F.col("reference").cast("double").alias("reference"))
    fit = rows.where("fit IS NOT NULL AND reference IS NOT NULL").select(F.lit(1).alias("grp"), F.col("pair_id").alias("id"), F.col("fit").cast("double").alias("score"), F.col("reference").cast("double").alias("reference"))
    saved = rows.where("match IS NOT NULL AND saved IS NOT NULL").select(F.lit(1).alias("grp"), F.col("pair_id").alias("id"), F.col("match").alias("x"), F.col("saved").alias("y"))
    tau = lambda df, name: kendall_tau_b(df if "x" in df.columns else df.withColumnsRenamed({"score": "x", "reference": "y"})).select(F.col("grp").alias("one_"), F.col("tau").alias(name))
    spent = F.greatest(F.col("holistic_ms"), F.col("extract_ms") + F.col("check_ms"))
    a = scores.agg(F.count("*").alias("pairs"), F.count(F.when(F.coalesce("error", F.lit("")) != "", 1)).alias("failed"), F.expr("try_divide(sum(cost_micro_usd), count(*)) / 1e6").alias("cost_per_pair"))
    b = rows.agg(F.floor(F.avg(spent)).alias("mean_ms"))
    out = one(a).join(one(b), "one_").join(one(agreement(match)), "one_").join(one(agreement(fit).select(*[F.col(c).alias(f"fit_{c}") for c in agreement(fit).columns])), "one_")
    return out.join(tau(match, "tau_b"), "one_", "left").join(tau(fit, "fit_tau_b"), "one_", "left").join(tau(saved, "saved_tau_b"), "one_", "left").drop("one_")


def by_disagreement(scores: DataFrame) -> DataFrame:
    """scores(pair_id, ord, match, reference, ...) with `place`: the largest error first, pairs without one last, in their order."""
    from pyspark.sql import Window

    error = F.coalesce(F.abs(F.col("match") - F.col("reference")), F.lit(-1.0))
    return scores.withColumn("place", F.row_number().over(Window.orderBy(error.desc(), "ord")))  # a report's pairs: some dozens
