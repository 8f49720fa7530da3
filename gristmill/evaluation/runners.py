"""Whole evaluations: extraction of labelled postings, coverage of labelled pairs, and match scores of reference pairs.

A run is one job over all fixtures; what it asked is stored with its results, so labels can change and be scored again without asking.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.evaluation import checks, labels
from gristmill.operators import ask, check, extract
from gristmill.operators.failures import materialised
from gristmill.runtime import cached_table, together
from gristmill.settings.config import Settings
from gristmill.settings.tuning import Tuning
from gristmill.sources import loaders


@dataclass
class ExtractionRun:
    scores: DataFrame
    totals: DataFrame
    matched: DataFrame
    misses: DataFrame
    leftovers: DataFrame
    extraction: extract.Extraction
    #: (fixture_id, stage, error, rows): fixtures that failed; they are neither scored nor in the totals
    failures: DataFrame | None = None


def run_extractor(golden: DataFrame, provider: ask.Provider, tuning: Tuning, settings: Settings | None = None) -> ExtractionRun:
    """golden: sources.loaders.read_golden. Extracts every fixture and scores it; misses name the stage that lost them.

    A wrong answer loses its fixture alone, which stands in `failures`.
    """
    e = extract.extract(golden.select(F.col("fixture_id").alias("posting_id"), "text"), provider, tuning, settings, strict=False)
    failed = e.failures.withColumnRenamed("posting_id", "fixture_id")
    run = score_extraction(golden.join(failed.select("fixture_id"), "fixture_id", "left_anti"), e)
    run.failures = failed
    return run


def score_extraction(golden: DataFrame, e: extract.Extraction) -> ExtractionRun:
    """Scores results against labels, asking nothing: also for results of an earlier run against today's labels."""
    key = labels.KEY
    expected = loaders.expected(golden)
    predicted = labels.numbered(e.requirements)
    context = e.context.select(F.col("posting_id").alias(key), "ref", "section")
    scores = materialised(labels.fixture_scores(golden, expected, predicted, context))
    matched = labels.matches(expected, predicted)
    rename = lambda df: df.withColumnRenamed("posting_id", key)
    if e.refined is not None:
        merged = rename(e.refined.values).select(key, "i", "value", "keep", (F.col("canonical") != F.col("i")).alias("merged"))
        dropped = (F.col("section").isin(*extract.DROPPED)) | F.col("strong")
        sentences = rename(e.labelled).select(key, "ord", "text", dropped.alias("dropped"))
        lost = labels.misses(expected, matched, merged, rename(e.validated), sentences)
    else:
        lost = expected.join(matched.select(key, "exp_ord"), [key, "exp_ord"], "left_anti").select(key, "exp_ord", "value", F.lit("unknown").alias("stage"), F.lit(0).cast("long").alias("at"))
    return ExtractionRun(scores, labels.totals(scores), matched, lost, labels.leftovers(golden, expected, predicted, matched), e)


def rescore(golden: DataFrame, results: DataFrame) -> ExtractionRun:
    """Stored results(posting_id, result) against current labels; results with an error and fixtures without a result are left out."""
    reqs, groups, context = loaders.result_tables(results)
    there = golden.join(results.select(F.col("posting_id").alias("fixture_id")), "fixture_id", "left_semi")
    e = extract.Extraction(reqs, groups, context.withColumn("ord", F.lit(0)), context, reqs)
    return score_extraction(there, e)


@dataclass
class CheckRun:
    links: DataFrame
    link_scores: DataFrame
    rows: DataFrame
    tallies: DataFrame
    confusion: DataFrame
    totals: DataFrame
    coverage: check.Coverage
    #: (posting_id, resume_id, stage, error, rows): pairs that failed; they are not scored
    failures: DataFrame | None = None


def golden_requirements(golden: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requirements, groups, context) of labels as if extracted: each with the first sentence but the title that names it or an alias.

    golden(posting_id, title, posting, alternative_groups), expected(posting_id, exp_ord, value, aliases, tier).
    """
    from gristmill.operators import candidates as C

    said = C.sentences(golden.select("posting_id", F.col("posting").alias("text")), "posting_id").join(golden.select("posting_id", "title"), "posting_id").where("text <> title")
    names = expected.select("posting_id", "exp_ord", F.explode(F.concat(F.array("value"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    word = F.expr("lower(text) RLIKE concat('(?<![\\\\p{L}\\\\p{Nd}])\\\\Q', lower(name), '\\\\E(?![\\\\p{L}\\\\p{Nd}])')")
    first = names.join(said.select("posting_id", "ord", "ref", "text"), "posting_id").where("name <> ''").where(word).groupBy("posting_id", "exp_ord").agg(F.min_by("ref", "ord").alias("ref"))
    reqs = expected.join(first, ["posting_id", "exp_ord"], "left").withColumn("req_ord", F.col("exp_ord") + 1)
    reqs = reqs.select("posting_id", "req_ord", F.concat(F.lit("req_"), F.col("req_ord").cast("string")).alias("id"), "value", F.filter(F.array("ref"), lambda r: r.isNotNull()).alias("refs"), "tier", F.lit(0.0).alias("importance"))
    members = golden.select("posting_id", F.posexplode("alternative_groups").alias("g", "names")).select("posting_id", "g", F.posexplode("names").alias("place", "value")).join(reqs.select("posting_id", "value", "id"), ["posting_id", "value"])
    groups = members.groupBy("posting_id", "g").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("members"))
    groups = groups.select("posting_id", (F.col("g") + 1).alias("group_ord"), F.concat(F.lit("alt_"), (F.col("g") + 1).cast("string")).alias("group_id"), "members")
    return reqs, groups, said.select("posting_id", "ref", "text")


def run_checker(pairs: DataFrame, requirements: DataFrame, groups: DataFrame, context: DataFrame, resumes: DataFrame, link_labels: DataFrame, skip: DataFrame, provider: ask.Provider, tuning: Tuning, settings: Settings | None = None) -> CheckRun:
    """pairs(pair_id, posting_id, resume_id), link_labels(pair_id, value, quote, strength), skip(pair_id, value): coverage scored against labelled links."""
    found = check.check(pairs, requirements, groups, context, resumes, provider, tuning, settings, strict=False)
    run = score_checks(pairs.join(found.failures.select(*check.PAIR), list(check.PAIR), "left_anti"), found, resumes, link_labels, skip, tuning)
    run.failures = found.failures
    return run


def score_checks(pairs: DataFrame, found: check.Coverage, resumes: DataFrame, link_labels: DataFrame, skip: DataFrame, tuning: Tuning) -> CheckRun:
    """The same for stored coverage, asking nothing; both Fit Scores take the tuning's weights."""
    named = lambda df: df.join(pairs.select("pair_id", *check.PAIR), list(check.PAIR))
    units = check.evidence_units(resumes).join(pairs.select("pair_id", "resume_id"), "resume_id").select("pair_id", F.col("id").alias("unit_id"), "text")
    wanted = materialised(checks.resolve_quotes(link_labels, units))
    coverage = named(found.requirements)
    links = checks.link_rows(coverage, wanted, named(found.judged).select("pair_id", "value", "unit_id"), skip)
    rows = materialised(checks.coverage_rows(coverage, wanted, skip))
    scored, tallied = checks.link_scores(links), checks.tallies(rows)
    groups = named(found.groups).select("pair_id", "group_ord", "group_id", F.explode("members").alias("member_id")).withColumnRenamed("pair_id", "pair")
    fit = lambda c, name: check.score_fit(rows.select(F.col("pair_id").alias("pair"), "req_ord", F.col("id").alias("req_id"), "tier", F.col(c).alias("coverage")), groups, **check.fit_weights(tuning)).select("pair", F.col("fit").alias(name))
    fits = fit("got", "got").join(fit("want", "want"), "pair")
    return CheckRun(links, scored, rows, tallied, checks.confusion(rows), checks.checker_totals(scored, tallied, fits), found)


def extracted(spark: SparkSession, postings: DataFrame, provider: ask.Provider, tuning: Tuning, settings: Settings, cache: str = "") -> tuple[DataFrame, DataFrame]:
    """(posting_id, result) and (posting_id, error): extraction results as JSON, from the cache where the same text met the same model, settings and
    tuning; and the postings that failed, which the cache doesn't keep."""
    knobs = (settings.max_window_words, settings.section_batch, settings.requirement_mass, settings.skip_importance, settings.skip_responsibilities)
    same = F.sha2(F.concat_ws("\x1f", F.lit("1"), "text", F.lit(settings.model), F.lit(str(knobs)), F.lit(tuning.hash)), 256)
    keyed = postings.select("posting_id", "text").withColumn("cache_key", same)
    lost: list[DataFrame] = []

    def build(rows: DataFrame) -> DataFrame:
        once = rows.select(F.col("cache_key").alias("posting_id"), "text").dropDuplicates(["posting_id"])
        e = extract.extract(once, provider, tuning, settings, strict=False)
        lost.append(e.failures.select(F.col("posting_id").alias("cache_key"), F.concat_ws(": ", "stage", "error").alias("error")))
        return extract.result_json(e).withColumnRenamed("posting_id", "cache_key")

    done = cached_table(spark, keyed.select("cache_key", "text"), cache, "cache_key", build) if cache else build(keyed)
    results = keyed.select("posting_id", "cache_key").join(done, "cache_key").drop("cache_key")
    failed = keyed.select("posting_id", "cache_key").join(lost[0], "cache_key").drop("cache_key") if lost else spark.createDataFrame([], "posting_id string, error string")
    return results, failed


def run_pairs(spark: SparkSession, pairs: DataFrame, provider: ask.Provider, tuning: Tuning, settings: Settings | None = None, with_fit: bool = False, cache: str = "") -> DataFrame:
    """(pair_id, title, reference, saved, role_match, experience_short, blocker, error, match, fit) of loaders.read_pairs.

    A wrong answer in any stage loses its pair alone, whose `error` says why. Both arms run side by side.
    """
    settings = settings or Settings()

    def match() -> DataFrame:
        docs = extract.prepared(pairs.select(F.col("pair_id").alias("posting_id"), F.col("posting").alias("text")))
        whole = pairs.join(docs.select(F.col("posting_id").alias("pair_id"), F.col("text").alias("read")), "pair_id").select("pair_id", "title", "reference", "saved", F.col("read").alias("posting"), "resume")
        return check.holistic(whole, provider, tuning, strict=False).withColumnRenamed("match_score", "match")

    def fit() -> tuple[DataFrame, DataFrame]:
        results, failed = extracted(spark, pairs.select(F.col("pair_id").alias("posting_id"), F.col("posting").alias("text")), provider, tuning, settings, cache)
        results = materialised(results)
        reqs, groups, context = loaders.result_tables(loaders.parse_results(results.withColumnRenamed("result", "raw")))
        people = pairs.select(F.col("pair_id").alias("resume_id"), F.col("resume").alias("text"))
        both = results.select("posting_id", F.col("posting_id").alias("resume_id"))
        found = check.check(both, reqs, groups, context, people, provider, tuning, settings, strict=False)
        lost = failed.unionByName(found.failures.select("posting_id", F.concat_ws(": ", "stage", "error").alias("error")))
        return found.fit.select(F.col("posting_id").alias("pair_id"), F.col("score").alias("fit")), lost.select(F.col("posting_id").alias("pair_id"), F.col("error").alias("fit_error"))

    if not with_fit:
        return match().withColumn("fit", F.lit(None).cast("int"))
    scored, (fits, lost) = together(spark, match, fit)
    out = scored.join(fits, "pair_id", "left").join(lost, "pair_id", "left")
    return out.withColumn("error", F.coalesce("error", "fit_error")).drop("fit_error")
