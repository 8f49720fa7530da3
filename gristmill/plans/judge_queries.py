"""The judge, labels and links over the driver's tables: each query calls the evaluation's operators, its SQL is written by hand.

Orders are pairs; events are a judge's replies; lines of an order are requirements and links. All figures come from whole-number arithmetic over keys.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.evaluation import baseline, checks, judge, labels
from gristmill.operators import ask
from gristmill.operators.failures import shared_folder
from gristmill.plans.catalog import register
from gristmill.plans.dual import table
from gristmill.plans.group_queries import SCORED, scored
from gristmill.sinks import tables


# Events are replies, a user is a pair; every fourth reply has no score, quotes stand in the resume or not.
def _replies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    quotes = F.array(F.concat(F.lit("*  Skill–"), u, F.lit("  ")), F.concat(F.lit("skill "), (e % 7).cast("string"), F.lit(" of")), F.lit(" • "))
    rows = table(spark, sf_dir, "events").select(u.alias("pair"), e.alias("run"), F.when(e % 4 > 0, e % 101).alias("score"), F.when(e % 6 > 0, F.slice(quotes, 1 + (e % 2).cast("int"), 3)).alias("quotes"))
    resumes = rows.select("pair").distinct().withColumn("resume", F.concat(F.lit("SKILL   `"), "pair", F.lit("— of\nall, skill 3 of")))
    return rows, resumes


def a23_judge_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.medians(*_replies(spark, sf_dir)).select("pair", "score", F.size("scores").alias("n"), F.array_join(F.slice("scores", 1, 5), " ").alias("first"), "quote_rate")


_JUDGED = """
    r AS (SELECT user_id AS u, event_id AS e, CASE WHEN event_id % 4 > 0 THEN event_id % 101 END AS score FROM events),
    -- the first quote always stands in the resume, the second one where its number is the pair's or 3, the third is empty
    q AS (SELECT u, e, score, CASE WHEN e % 6 = 0 THEN NULL WHEN e % 2 = 0 THEN 1 + (e % 7 = u OR e % 7 = 3)::INT ELSE (e % 7 = u OR e % 7 = 3)::INT END AS hits, 2 - e % 2 AS told FROM r),
    j AS (
        SELECT u::VARCHAR AS pair, median(score)::DOUBLE AS score, count(score)::INT AS n, array_to_string(list(score ORDER BY e) FILTER (score IS NOT NULL)[1:5], ' ') AS first,
            round(avg(round(hits / told, 2)), 2) AS quote_rate FROM q GROUP BY u HAVING count(score) > 0)"""
register("a23_judge_median", a23_judge_median, f"WITH {_JUDGED} SELECT * FROM j")
register("f16_quote_rate", lambda spark, sf: a23_judge_median(spark, sf).select("pair", "quote_rate"), f"WITH {_JUDGED} SELECT pair, quote_rate FROM j")


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reports of the orders; one in nine pairs has no score in the second."""
    rows = scored(spark, sf_dir).select("pair", "score", "reference")
    again = rows.select("pair", F.when(F.col("pair") % 9 > 0, (F.col("score") + F.col("pair") % 5)).alias("score"), "reference")
    return rows.unionByName(again)


_REPORTS = "reports AS (SELECT pair, score, reference FROM scored UNION ALL SELECT pair, CASE WHEN pair % 9 > 0 THEN score + pair % 5 END, reference FROM scored)"

register(
    "o6_top_disagreements",
    lambda spark, sf: judge.top_disagreements(_reports(spark, sf), 25),
    f"WITH {SCORED}, {_REPORTS} SELECT pair, avg(abs(score - reference))::DOUBLE AS error FROM reports WHERE score IS NOT NULL GROUP BY pair ORDER BY error DESC, pair LIMIT 25",
)


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = _reports(spark, sf_dir)
    judged = scored(spark, sf_dir).where("pair % 3 > 0").select("pair", (F.col("reference") + F.col("pair") % 23 - 11).alias("score"))
    references = scored(spark, sf_dir).where("pair % 4 > 0").select("pair", F.col("reference").alias("score"))
    return judge.three_ways(reports.where("pair % 7 > 0").select("pair", "score"), judged, references)


_ARMS = f"""{_REPORTS},
    m AS (SELECT pair, avg(score)::DOUBLE AS match FROM reports WHERE pair % 7 > 0 AND score IS NOT NULL GROUP BY pair),
    arms AS (
        SELECT s.pair, CASE WHEN s.pair % 4 > 0 THEN reference::DOUBLE END AS reference, CASE WHEN s.pair % 3 > 0 THEN (reference + s.pair % 23 - 11)::DOUBLE END AS judge, match
        FROM scored s LEFT JOIN m ON m.pair = s.pair WHERE s.pair % 4 > 0 OR s.pair % 3 > 0 OR match IS NOT NULL)"""

register("e9_compare_judge", _arms, f"WITH {SCORED}, {_ARMS} SELECT pair, reference, judge, match FROM arms")


def j19_agreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return judge.agreements(_arms(spark, sf_dir)).select("arms", "n", r("mae"), r("bias"), r("within_10"), r("pearson"), r("tau_b"))


register(
    "j19_common_ids",
    j19_agreements,
    f"""
    WITH {SCORED}, {_ARMS}, both_ AS (
        SELECT 'match vs reference' AS arms, pair, match AS x, reference AS y FROM arms UNION ALL SELECT 'judge vs reference', pair, judge, reference FROM arms
        UNION ALL SELECT 'match vs judge', pair, match, judge FROM arms),
    known AS (SELECT * FROM both_ WHERE x IS NOT NULL AND y IS NOT NULL),
    pairs AS (
        SELECT a.arms, sum(sign(a.x - b.x) * sign(a.y - b.y))::DOUBLE AS c, sum((a.x <> b.x)::INT)::DOUBLE AS nx, sum((a.y <> b.y)::INT)::DOUBLE AS ny
        FROM known a JOIN known b ON a.arms = b.arms AND a.pair < b.pair GROUP BY a.arms)
    SELECT arms, count(*) AS n, round(avg(abs(x - y)), 6) AS mae, round(avg(x - y), 6) AS bias, round(avg((abs(x - y) <= 10)::INT), 6) AS within_10, round(corr(x, y), 6) AS pearson,
        round(any_value(c / sqrt(nx * ny)), 6) AS tau_b FROM known JOIN pairs USING (arms) GROUP BY arms""",
)


def k14_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers judged in two runs: the second replaces the rows of the pairs that it judged again."""
    rows = table(spark, sf_dir, "customer")
    path = f"{shared_folder(spark)}/judged-{uuid.uuid4().hex}"
    tables.upsert(spark, rows.where("c_acctbal > 0").select(F.col("c_custkey").alias("pair"), F.lit(1.0).alias("score")), path, ["pair"])
    tables.upsert(spark, rows.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("pair"), F.lit(2.0).alias("score")), path, ["pair"])
    return tables.current(spark, path)


register(
    "k14_upsert",
    k14_upsert,
    "SELECT c_custkey AS pair, CASE WHEN c_mktsegment = 'BUILDING' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal > 0",
)


# An order is a pair, its line numbers are requirements, suppliers are units.
def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(coverage, wanted, retrieved, skip) as the checks read them; a line number stands once in a pair."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"))
    lines = lines.select(F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").cast("string").alias("value"), F.concat(F.lit("e"), F.col("s").cast("string")).alias("unit"), "s", "p", "l_linenumber")
    grade = lambda n: F.when(n == 3, "strong").when(n == 2, "partial").when(n == 1, "weak")
    other = F.concat(F.lit("e"), (F.col("s") + 1).cast("string"))
    found = F.filter(F.array(F.struct(F.col("unit"), grade(F.col("p") % 4).alias("strength")), F.struct(other.alias("unit"), grade(F.col("p") % 3).alias("strength"))), lambda x: x["strength"].isNotNull())
    best = F.when((F.col("p") % 4 == 0) & (F.col("p") % 3 == 0), "none").otherwise(grade(F.greatest(F.col("p") % 4, F.col("p") % 3)))
    tier = F.when(F.col("l_linenumber") <= 2, "required").when(F.col("l_linenumber") <= 4, "preferred").otherwise("mentioned")
    coverage = lines.select("pair_id", "value", F.col("l_linenumber").alias("req_ord"), F.col("value").alias("id"), tier.alias("tier"), found.alias("evidence"), best.alias("coverage"))
    wanted = lines.where("p % 5 > 1").select("pair_id", "value", F.when(F.col("p") % 5 == 2, other).otherwise(F.col("unit")).alias("unit_id"), grade(F.col("p") % 5 - 1).alias("strength"))
    retrieved = lines.where("p % 2 = 0").select("pair_id", "value", F.col("unit").alias("unit_id"))
    return coverage, wanted, retrieved, lines.where("s % 10 = 0").select("pair_id", "value")


_LINKS = """
    lines AS (SELECT l_orderkey AS pair_id, l_linenumber AS n, min(l_suppkey) AS s, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
    kept AS (SELECT *, n::VARCHAR AS value, ['none', 'weak', 'partial', 'strong'] AS names FROM lines WHERE s % 10 > 0),
    got AS (
        SELECT pair_id, value, 'e' || s AS unit_id, p % 4 AS g FROM kept WHERE p % 4 > 0
        UNION ALL SELECT pair_id, value, 'e' || (s + 1), p % 3 FROM kept WHERE p % 3 > 0),
    want AS (SELECT pair_id, value, CASE WHEN p % 5 = 2 THEN 'e' || (s + 1) ELSE 'e' || s END AS unit_id, p % 5 - 1 AS w FROM kept WHERE p % 5 > 1),
    links AS (
        SELECT coalesce(want.pair_id, got.pair_id) AS pair_id, coalesce(want.value, got.value) AS value, coalesce(want.unit_id, got.unit_id) AS unit_id, w, g
        FROM want FULL JOIN got ON want.pair_id = got.pair_id AND want.value = got.value AND want.unit_id = got.unit_id),
    seen AS (SELECT l.*, k.p % 2 = 0 AND l.unit_id = 'e' || k.s AS was FROM links l JOIN kept k ON k.pair_id = l.pair_id AND k.value = l.value),
    scores AS (
        SELECT pair_id, count(w) AS labeled, count(CASE WHEN was THEN w END) AS retrieved, count(CASE WHEN w >= 2 THEN 1 END) AS labeled_sp, count(CASE WHEN w >= 2 AND was THEN 1 END) AS retrieved_sp,
            count(g) AS predicted, count(w + g) AS correct, count(CASE WHEN w = g THEN 1 END) AS exact, count(CASE WHEN abs(w - g) <= 1 THEN 1 END) AS near FROM seen GROUP BY pair_id),
    rows_ AS (
        SELECT pair_id, n, CASE WHEN n <= 2 THEN 'required' WHEN n <= 4 THEN 'preferred' ELSE 'mentioned' END AS tier, names[CASE WHEN p % 5 > 1 THEN p % 5 ELSE 1 END] AS want, names[greatest(p % 4, p % 3) + 1] AS got
        FROM kept)"""


def j12_want_got(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.link_rows(*_links(spark, sf_dir))


register(
    "j12_want_got",
    j12_want_got,
    f"WITH {_LINKS} SELECT pair_id, value, unit_id, ['weak', 'partial', 'strong'][w] AS want, ['weak', 'partial', 'strong'][g] AS got, was AS was_retrieved FROM seen",
)
register("j18_retrieval_recall", lambda spark, sf: checks.link_scores(checks.link_rows(*_links(spark, sf))), f"WITH {_LINKS} SELECT * FROM scores")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    coverage, wanted, _, skip = _links(spark, sf_dir)
    return checks.coverage_rows(coverage, wanted, skip)


register("a19_best_strength", lambda spark, sf: _rows(spark, sf).select("pair_id", "req_ord", "tier", "want", "got"), f"WITH {_LINKS} SELECT pair_id, n AS req_ord, tier, want, got FROM rows_")
register("f15_skip", lambda spark, sf: _rows(spark, sf).groupBy("pair_id").agg(F.count("*").alias("scored")), f"WITH {_LINKS} SELECT pair_id, count(*) AS scored FROM kept GROUP BY pair_id")
register(
    "a18_confusion",
    lambda spark, sf: checks.confusion(_rows(spark, sf)),
    f"""WITH {_LINKS} SELECT want, count(CASE WHEN got = 'strong' THEN 1 END) AS strong, count(CASE WHEN got = 'partial' THEN 1 END) AS partial, count(CASE WHEN got = 'weak' THEN 1 END) AS weak,
    count(CASE WHEN got = 'none' THEN 1 END) AS none FROM rows_ GROUP BY want""",
)
register(
    "k8_coverage_tallies",
    lambda spark, sf: checks.tallies(_rows(spark, sf)),
    f"WITH {_LINKS} SELECT pair_id, tier, count(CASE WHEN want = got THEN 1 END) AS exact, count(CASE WHEN (want = 'none') = (got = 'none') THEN 1 END) AS covered, count(*) AS total FROM rows_ GROUP BY ALL",
)


def a12_checker_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = checks.link_scores(checks.link_rows(*_links(spark, sf_dir)))
    fits = scored(spark, sf_dir).select(F.col("score").alias("got"), F.col("reference").alias("want"))
    out = checks.checker_totals(links, checks.tallies(_rows(spark, sf_dir)), fits)
    return out.select("pairs", "fit_error_max", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("pairs", "fit_error_max")])


register(
    "a12_checker_totals",
    a12_checker_totals,
    f"""
    WITH {_LINKS}, {SCORED},
    a AS (
        SELECT count(*) AS pairs, sum(retrieved) / sum(labeled) AS rr, sum(retrieved_sp) / sum(labeled_sp) AS rsp, sum(correct) / sum(predicted) AS lp, sum(correct) / sum(labeled) AS lr,
            sum(exact) / sum(correct) AS se, sum(near) / sum(correct) AS sn FROM scores)
    SELECT pairs, round(rr, 6) AS retrieval_recall, round(rsp, 6) AS retrieval_recall_strong_partial, round(lp, 6) AS link_precision, round(lr, 6) AS link_recall, round(se, 6) AS strength_exact,
        round(sn, 6) AS strength_near, round(2 * lp * lr / (lp + lr), 6) AS link_f1, (SELECT round(avg((want = got)::INT), 6) FROM rows_) AS coverage_exact,
        (SELECT round(avg(((want = 'none') = (got = 'none'))::INT), 6) FROM rows_) AS coverage_covered, (SELECT round(avg(abs(score - reference)), 6) FROM scored) AS fit_error,
        (SELECT max(abs(score - reference)) FROM scored) AS fit_error_max FROM a""",
)


# The parts of eight orders in a row are a fixture's values; those of even number are labels, those not divisible by 3 predictions.
def _fixtures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(lists, expected, predicted, context). Values are words of one length, so that only equal ones match."""
    have = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 8").alias(labels.KEY), F.col("l_partkey").alias("p")).distinct()
    word = lambda p: F.concat(F.lit("K"), F.lpad(p.cast("string"), 9, "0"))
    tier = lambda n: F.when(n == 0, "required").when(n == 1, "preferred").otherwise("mentioned")
    p = F.col("p")
    aliases = F.when(p % 4 == 0, F.array(word(p + 1), F.lit("another name")))
    expected = have.where("p % 2 = 0").select(labels.KEY, p.alias("exp_ord"), word(p).alias("value"), aliases.alias("aliases"), tier(p % 3).alias("tier"))
    predicted = have.where("p % 3 > 0").select(labels.KEY, p.alias("pred_ord"), F.lower(word(p)).alias("value"), F.when(p % 5 > 0, tier(p % 4)).alias("tier"), F.array(F.concat(F.lit("s"), (p % 7).cast("string"))).alias("refs"))
    context = have.select(labels.KEY).distinct().select(labels.KEY, F.explode(F.array(*[F.struct(F.lit(f"s{i}").alias("ref"), F.lit(s).alias("section")) for i, s in ((0, "required"), (1, "preferred"), (2, "about"))])).alias("x")).select(labels.KEY, "x.*")
    odd = have.where("p % 2 = 1")
    listed = lambda when: F.collect_list(F.when(when, word(p)))
    lists = odd.groupBy(labels.KEY).agg(listed(p % 7 == 0).alias("filler"), listed(p % 11 == 0).alias("acceptable"))
    return lists, expected, predicted, context


_FIXTURES = """
    have AS (SELECT DISTINCT l_orderkey // 8 AS f, l_partkey AS p FROM lineitem),
    wanted AS (SELECT f, p, ['required', 'preferred', 'mentioned'][p % 3 + 1] AS tier FROM have WHERE p % 2 = 0),
    pred AS (
        SELECT f, p, CASE WHEN p % 5 > 0 THEN CASE p % 4 WHEN 0 THEN 'required' WHEN 1 THEN 'preferred' ELSE 'mentioned' END
            WHEN p % 7 = 0 THEN 'required' WHEN p % 7 = 1 THEN 'preferred' WHEN p % 7 = 2 THEN 'mentioned' ELSE '' END AS tier FROM have WHERE p % 3 > 0),
    -- a label takes its own word, in order, and else its alias, which is no other label's word
    matched AS (SELECT w.f, w.p AS e, coalesce(a.p, b.p) AS g FROM wanted w LEFT JOIN pred a ON a.f = w.f AND a.p = w.p LEFT JOIN pred b ON b.f = w.f AND b.p = w.p + 1 AND w.p % 4 = 0 WHERE coalesce(a.p, b.p) IS NOT NULL),
    rest AS (
        SELECT pred.f, pred.p, CASE WHEN pred.p % 2 = 1 AND pred.p % 7 = 0 THEN 'filler' WHEN pred.p % 2 = 1 AND pred.p % 11 = 0 THEN 'acceptable'
            WHEN EXISTS (SELECT 1 FROM wanted w WHERE w.f = pred.f AND (w.p = pred.p OR w.p % 4 = 0 AND w.p + 1 = pred.p)) THEN 'duplicate' ELSE 'extra' END AS kind
        FROM pred ANTI JOIN matched m ON m.f = pred.f AND m.g = pred.p)"""


def j13_label_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, expected, predicted, _ = _fixtures(spark, sf_dir)
    return labels.matches(expected, predicted)


register("j13_label_matches", j13_label_matches, f"WITH {_FIXTURES} SELECT f AS fixture_id, e AS exp_ord, g AS pred_ord, true AS strict FROM matched")


def u7_leftovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists, expected, predicted, _ = _fixtures(spark, sf_dir)
    return labels.leftovers(lists, expected, predicted, labels.matches(expected, predicted)).select(labels.KEY, "pred_ord", "kind")


register("u7_cascade", u7_leftovers, f"WITH {_FIXTURES} SELECT f AS fixture_id, p AS pred_ord, kind FROM rest")


def e8_tier_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, predicted, context = _fixtures(spark, sf_dir)
    return labels.tier_of(predicted, context).select(labels.KEY, "pred_ord", "tier")


register("e8_tier_of", e8_tier_of, f"WITH {_FIXTURES} SELECT f AS fixture_id, p AS pred_ord, tier FROM pred")


def a11_fixture_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.fixture_scores(*_fixtures(spark, sf_dir))


_SCORES = f"""{_FIXTURES},
    by_ AS (
        SELECT w.f, coalesce(w.tier, '') AS tier, count(*) AS expected, count(m.g) AS found, count(CASE WHEN pred.tier <> '' THEN 1 END) AS tier_checked, count(CASE WHEN pred.tier = w.tier THEN 1 END) AS tier_correct
        FROM wanted w LEFT JOIN matched m ON m.f = w.f AND m.e = w.p LEFT JOIN pred ON pred.f = m.f AND pred.p = m.g GROUP BY GROUPING SETS ((w.f, w.tier), (w.f))),
    left_ AS (SELECT f, count(CASE kind WHEN 'filler' THEN 1 END) AS filler, count(CASE kind WHEN 'acceptable' THEN 1 END) AS acceptable, count(CASE kind WHEN 'duplicate' THEN 1 END) AS duplicate, count(CASE kind WHEN 'extra' THEN 1 END) AS extra FROM rest GROUP BY f),
    told AS (SELECT f, count(*) AS predicted FROM pred GROUP BY f),
    whole AS (
        SELECT by_.f AS fixture_id, tier, expected, found AS strict, found AS loose, tier_checked, tier_correct, coalesce(predicted, 0) AS predicted, coalesce(filler, 0) AS filler, coalesce(acceptable, 0) AS acceptable,
            coalesce(duplicate, 0) AS duplicate, coalesce(extra, 0) AS extra FROM by_ LEFT JOIN told ON told.f = by_.f LEFT JOIN left_ ON left_.f = by_.f)"""

register("a11_fixture_scores", a11_fixture_scores, f"WITH {_SCORES} SELECT * FROM whole")


def a11_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labels.totals(a11_fixture_scores(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) if c.startswith(("recall", "precision", "f1")) else c for c in out.columns])


register(
    "a11_totals_by_tier",
    a11_totals,
    f"""
    WITH {_SCORES}, s AS (SELECT count(*) AS fixtures, sum(expected)::BIGINT AS expected, sum(predicted)::BIGINT AS predicted, sum(strict)::BIGINT AS strict, sum(loose)::BIGINT AS loose, sum(filler)::BIGINT AS filler,
        sum(acceptable)::BIGINT AS acceptable, sum(duplicate)::BIGINT AS duplicate FROM whole WHERE tier = ''),
    r AS (SELECT *, strict / expected AS rs, loose / expected AS rl, loose / (predicted - acceptable - duplicate) AS pl FROM s)
    SELECT * EXCLUDE (rs, rl, pl), round(rs, 6) AS recall_strict, round(rl, 6) AS recall_loose, round(pl, 6) AS precision_loose, round(2 * pl * rl / (pl + rl), 6) AS f1_loose FROM r""",
)


# an event is a request with three questions; its number says what is wrong with the answers.
def f17_invalid_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    options = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    question = lambda id, kind: F.struct(F.lit(id).alias("id"), F.lit(kind).alias("kind"), F.lit("{}").alias("instructions"), options.alias("options"), F.lit("{}").alias("criteria"))
    wrong = e % 13
    probs = F.map_from_arrays(F.when(wrong == 1, F.array(F.lit("a"), F.lit("x"))).otherwise(F.array(F.lit("a"), F.lit("b"))), F.array(F.when(wrong == 2, 1.5).otherwise(0.75), F.when(wrong == 3, float("nan")).otherwise(0.25)))
    none = F.lit(None)
    fields = ("id", "choice", "probs", "noul", "score", "confidence")
    answer = lambda *v: F.struct(*[x.alias(n) for x, n in zip(v, fields, strict=True)])
    choice = answer(F.lit("q1"), F.when(wrong == 4, "d").when(wrong != 5, "a"), F.when(wrong != 6, probs), none.cast("double"), none.cast("double"), F.when(wrong == 7, -0.5).otherwise(0.75))
    noul = answer(F.lit("q2"), none.cast("string"), none.cast("map<string,double>"), F.when(wrong == 8, 1.25).when(wrong != 9, e % 5 / 4.0), none.cast("double"), none.cast("double"))
    score = answer(F.lit("q3"), none.cast("string"), none.cast("map<string,double>"), none.cast("double"), F.when(wrong == 10, 2.5).otherwise(e % 3 * 1.0), none.cast("double"))
    given = F.filter(F.array(choice, noul, score).cast(f"array<{ask.ANSWER}>"), lambda a: (a["id"] != "q3") | (F.col("event_id") % 13 != 11))
    rows = table(spark, sf_dir, "events").select(e.cast("string").alias("request_key"), F.array(question("q1", "choice"), question("q2", "noul"), question("q3", "score")).alias("questions"), given.alias("answers"))
    return ask.problems(rows)


register(
    "f17_invalid_answers",
    f17_invalid_answers,
    """
    SELECT event_id::VARCHAR AS request_key, CASE WHEN event_id % 13 <= 7 THEN 'q1' WHEN event_id % 13 <= 9 THEN 'q2' ELSE 'q3' END AS id,
        CASE event_id % 13 WHEN 1 THEN 'probability of what is not an option' WHEN 2 THEN 'probability out of range' WHEN 3 THEN 'probability out of range' WHEN 4 THEN 'choice is not an option' WHEN 5 THEN 'no choice'
            WHEN 6 THEN 'empty distribution' WHEN 7 THEN 'confidence out of range' WHEN 8 THEN 'noul missing or out of range' WHEN 9 THEN 'noul missing or out of range' WHEN 10 THEN 'score missing or out of range'
            WHEN 11 THEN 'missing' END AS problem
    FROM events WHERE event_id % 13 BETWEEN 1 AND 11""",
)


# An event is a pair of either arm.
def a13_baseline_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        e.alias("pair_id"), (e % 101).alias("want"), (e * 7 % 101).alias("got"), F.when(e % 9 > 0, e * 3 % 101).alias("score"), F.when(e % 4 > 0, (e % 7).cast("double")).alias("cost"),
        (e % 900).alias("input_tokens"), (e % 50).alias("output_tokens"), F.when(e % 9 == 0, "down").otherwise("").alias("error"),
    )
    out = baseline.totals(rows)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])


register(
    "a13_baseline_totals",
    a13_baseline_totals,
    """
    WITH r AS (SELECT event_id AS e, CASE WHEN event_id % 9 > 0 THEN event_id * 3 % 101 - event_id % 101 END AS gap, event_id * 7 % 101 - event_id % 101 AS mine FROM events)
    SELECT count(*) AS baseline_ran, count(CASE WHEN e % 9 = 0 THEN 1 END) AS baseline_failed, round(avg(abs(gap)), 6) AS baseline_error, max(abs(gap)) AS baseline_error_max, round(avg(gap), 6) AS baseline_bias,
        round(avg(abs(mine)), 6) AS fit_error, max(abs(mine)) AS fit_error_max, round(avg(mine), 6) AS fit_bias, sum(e % 900)::BIGINT AS input_tokens, sum(e % 50)::BIGINT AS output_tokens,
        round(avg(CASE WHEN e % 4 > 0 THEN e % 7 END), 6) AS baseline_cost FROM r""",
)


def a14_e2e_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        e.alias("pair_id"), (e % 101).cast("double").alias("reference"), F.when(e % 3 > 0, e * 5 % 101).alias("saved"), F.when(e % 8 > 0, e * 7 % 101).alias("match"), F.when(e % 6 > 0, e * 3 % 101).alias("fit"),
        (e % 500).alias("holistic_ms"), (e % 300).alias("extract_ms"), (e % 400).alias("check_ms"), (e % 20).alias("cost_micro_usd"), F.when(e % 11 == 0, "down").alias("error"),
    )
    out = checks.pair_totals(rows)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])


def _tau(x: str, y: str) -> str:
    return f"""(SELECT round(sum(sign(a.{x} - b.{x}) * sign(a.{y} - b.{y}))::DOUBLE / sqrt(sum((a.{x} <> b.{x})::INT)::DOUBLE * sum((a.{y} <> b.{y})::INT)), 6)
        FROM good a JOIN good b ON a.e < b.e WHERE a.{x} IS NOT NULL AND b.{x} IS NOT NULL AND a.{y} IS NOT NULL AND b.{y} IS NOT NULL)"""


def _figures(prefix: str, x: str) -> str:
    gap = f"({x} - ref)"
    figures = {"n": f"count({x})", "bias": f"round(avg({gap}), 6)", "mae": f"round(avg(abs{gap}), 6)", "worst": f"max(abs{gap})::DOUBLE", "within_5": f"round(avg((abs{gap} <= 5)::INT), 6)", "within_10": f"round(avg((abs{gap} <= 10)::INT), 6)", "pearson": f"round(corr({x}, ref), 6)"}
    return ", ".join(f"{e} AS {prefix}{n}" for n, e in figures.items())


register(
    "a14_e2e_totals",
    a14_e2e_totals,
    f"""
    WITH good AS (
        SELECT event_id AS e, event_id % 101 AS ref, CASE WHEN event_id % 3 > 0 THEN event_id * 5 % 101 END AS saved, CASE WHEN event_id % 8 > 0 THEN event_id * 7 % 101 END AS mat,
            CASE WHEN event_id % 6 > 0 THEN event_id * 3 % 101 END AS fit, greatest(event_id % 500, event_id % 300 + event_id % 400) AS ms FROM events WHERE event_id % 11 > 0)
    SELECT (SELECT count(*) FROM events) AS pairs, (SELECT count(*) FROM events WHERE event_id % 11 = 0) AS failed, (SELECT round(avg(event_id % 20) / 1e6, 6) FROM events) AS cost_per_pair,
        floor(avg(ms))::BIGINT AS mean_ms, {_figures("", "mat")}, {_figures("fit_", "fit")}, {_tau("mat", "ref")} AS tau_b, {_tau("fit", "ref")} AS fit_tau_b, {_tau("mat", "saved")} AS saved_tau_b FROM good""",
)
