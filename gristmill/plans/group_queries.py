"""Operators over groups of any size, each against SQL written by hand that meets all pairs.

Orders are pairs of a report; their signals and reference scores come from whole-number arithmetic over their keys. Lines of an
order are its requirements, lines of a supplier or a customer the members of large groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.evaluation import labels as L
from gristmill.functions import lexicon as X
from gristmill.operators import digests, fitting, quotes, ranks, resample, score, similar
from gristmill.plans.catalog import register
from gristmill.plans.dual import table


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair, report, priority, role_match, experience_short, blocker, reference) of the orders."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("pair"), customer.alias("report"), F.col("o_orderpriority").alias("priority"), (key * 7919 % 401 / 400).alias("role_match"), (key * 104729 % 1000 / 1000).alias("experience_short"),
        F.when(key % 5 == 0, customer % 100 / 100).otherwise(0.0).alias("blocker"), (F.round("o_totalprice").cast("long") % 101).alias("reference"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals(spark, sf_dir)
    return rows.withColumn("score", score.match_score(F.col("role_match"), F.col("experience_short"), F.col("blocker")).cast("long"))


#: The same by hand, in DuckDB's SQL.
SCORED = f"""
    scored AS (
        SELECT pair, report, priority, reference,
            round(greatest(0.0, least(100.0, ({X.MATCH_WEIGHTS[0]} + {X.MATCH_WEIGHTS[1]} * rm + ({X.MATCH_WEIGHTS[2]}) * es) * (1 - bl))))::BIGINT AS score
        FROM (
            SELECT o_orderkey AS pair, o_custkey AS report, o_orderpriority AS priority, round(o_totalprice)::BIGINT % 101 AS reference,
                (o_orderkey * 7919 % 401)::DOUBLE / 400 AS rm, (o_orderkey * 104729 % 1000)::DOUBLE / 1000 AS es,
                CASE WHEN o_orderkey % 5 = 0 THEN (o_custkey % 100)::DOUBLE / 100 ELSE 0.0 END AS bl
            FROM orders))"""

register("m1_match_score", lambda spark, sf: scored(spark, sf).select("pair", "reference", "score"), f"WITH {SCORED} SELECT pair, reference, score FROM scored")


def _tau_sql(rows: str, group: str) -> str:
    """Kendall's tau-b of score and reference by meeting all pairs of a group."""
    return f"""
        SELECT {group}, coalesce(c / nullif(sqrt(nx::DOUBLE * ny), 0), 0) AS tau FROM (
            SELECT a.{group}, sum(sign(a.score - b.score) * sign(a.reference - b.reference))::DOUBLE AS c,
                sum((a.score <> b.score)::INT) AS nx, sum((a.reference <> b.reference)::INT) AS ny
            FROM {rows} a JOIN {rows} b ON a.{group} = b.{group} AND a.pair < b.pair GROUP BY a.{group})"""


def m5_kendall_tau_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores against references among the orders of a priority: five groups that grow with the table."""
    return ranks.kendall_tau_b(scored(spark, sf_dir), "priority", "score", "reference").select("priority", F.round("tau", 9).alias("tau"))


register("m5_kendall_tau_b", m5_kendall_tau_b, f"WITH {SCORED} SELECT priority, round(tau, 9) AS tau FROM ({_tau_sql('scored', 'priority')})")


def a15_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    tau = ranks.kendall_tau_b(rows.withColumn("one", F.lit(1)), "one", "score", "reference").select("tau")
    r = lambda c: F.round(c, 6).alias(c)
    return score.agreement(rows).crossJoin(tau).select("n", r("bias"), r("mae"), "worst", r("within_5"), r("within_10"), r("pearson"), r("tau"))  # one row each


register(
    "a15_agree",
    a15_agree,
    f"""
    WITH {SCORED}, one AS (SELECT 1 AS one, * FROM scored), errors AS (SELECT score - reference AS e, score, reference FROM scored)
    SELECT count(*) AS n, round(avg(e), 6) AS bias, round(avg(abs(e)), 6) AS mae, max(abs(e)) AS worst, round(avg((abs(e) <= 5)::INT), 6) AS within_5,
        round(avg((abs(e) <= 10)::INT), 6) AS within_10, round(corr(score, reference), 6) AS pearson, (SELECT round(tau, 6) FROM ({_tau_sql("one", "one")})) AS tau
    FROM errors""",
)


# A10: lines are requirements; those whose part number 3 divides form two alternative groups.
def coverage_of_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(coverage, members) as score_fit reads them."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.min("l_returnflag").alias("f"), F.min("l_partkey").alias("p"))
    rows = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    first = F.substring("o_orderpriority", 1, 1)
    tier = F.when(first.isin("1", "2"), "required").when(first == "3", "preferred").when(F.col("p") % 7 == 0, "unheard of").otherwise("mentioned")
    coverage = F.when(F.col("q") < 10, "none").when(F.col("f") == "A", "strong").when(F.col("f") == "N", "partial").otherwise("weak")
    name = F.concat(F.lit("req_"), F.col("l_linenumber").cast("string"))
    rows = rows.select(F.col("l_orderkey").alias("pair"), F.col("l_linenumber").alias("req_ord"), name.alias("req_id"), tier.alias("tier"), coverage.alias("coverage"), "p")
    members = rows.where("p % 3 = 0").select("pair", (F.col("req_ord") % 2).alias("group_ord"), F.concat(F.lit("alt_"), (F.col("req_ord") % 2).cast("string")).alias("group_id"), F.col("req_id").alias("member_id"))
    return rows.drop("p"), members


def a10_score_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = [F.try_element_at("by_tier", F.lit(t)).alias(t) for t in ("required", "preferred", "mentioned")]
    return score.score_fit(*coverage_of_orders(spark, sf_dir)).select("pair", "fit", *tiers, F.array_join("gaps", " ").alias("gaps"))


ITEMS = """
    lines AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q, min(l_returnflag) AS f, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
    reqs AS (
        SELECT l_orderkey AS pair, l_linenumber AS ord, CASE WHEN p % 3 = 0 THEN 'alt_' || (l_linenumber % 2) ELSE 'req_' || l_linenumber END AS item,
            CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 2 WHEN '2' THEN 2 WHEN '3' THEN 1 ELSE 0 END AS tier,
            CASE WHEN q < 10 THEN 0 WHEN f = 'A' THEN 3 WHEN f = 'N' THEN 2 ELSE 1 END AS cov
        FROM lines JOIN orders ON l_orderkey = o_orderkey),
    items AS (
        SELECT pair, item, min(ord) AS ord, [1.0, 1.5, 3.0][max(tier) + 1]::DOUBLE AS w, [0.0, 0.3, 0.6, 1.0][max(cov) + 1]::DOUBLE AS credit, max(tier) AS tier, max(cov) AS cov
        FROM reqs GROUP BY pair, item)"""

register(
    "a10_score_fit",
    a10_score_fit,
    f"""
    WITH {ITEMS}
    SELECT pair, round(round(100 * sum(w * credit) / sum(w), 9))::INT AS fit, round(round(100 * avg(credit) FILTER (tier = 2), 9))::INT AS required,
        round(round(100 * avg(credit) FILTER (tier = 1), 9))::INT AS preferred, round(round(100 * avg(credit) FILTER (tier = 0), 9))::INT AS mentioned, coalesce(string_agg(item, ' ' ORDER BY ord, item) FILTER (tier = 2 AND cov = 0), '') AS gaps
    FROM items GROUP BY pair""",
)


# The lines of a supplier, 600 at every scale.
def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("grp"), (F.col("l_partkey") % 3).alias("rank"), F.col("l_quantity").alias("importance"), F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("o"), "l_linenumber")


def a16_tier_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.tier_order(_lines(spark, sf_dir), "grp", "rank", "importance").select("grp", F.round("tier_order", 9).alias("ordered"))


register(
    "a16_tier_order",
    a16_tier_order,
    """
    SELECT a.l_suppkey AS grp, round(avg(CASE WHEN a.l_quantity > b.l_quantity THEN 1.0 WHEN a.l_quantity = b.l_quantity THEN 0.5 ELSE 0.0 END::DOUBLE), 9) AS ordered
    FROM lineitem a JOIN lineitem b ON a.l_suppkey = b.l_suppkey AND a.l_partkey % 3 > b.l_partkey % 3 GROUP BY a.l_suppkey""",
)


def a17_group_pairs_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's parts as values: those with equal remainders are one labelled group, those of one brand and size one predicted group."""
    parts = table(spark, sf_dir, "part")
    have = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias(L.KEY), F.col("l_partkey").alias("p_partkey")).distinct().join(parts, "p_partkey")
    wanted = have.select(L.KEY, F.concat(F.lit("w"), F.col("p_partkey") % 40).alias("grp"), F.col("p_partkey").alias("value"))
    got = have.where("p_partkey % 5 > 0").select(L.KEY, F.concat_ws(" ", "p_brand", F.floor(F.col("p_size") / 10)).alias("grp"), F.col("p_partkey").alias("value"))
    return L.group_f1(wanted, got).select(L.KEY, F.round("group_f1", 9).alias("f1"))


register(
    "a17_group_pairs_f1",
    a17_group_pairs_f1,
    """
    WITH have AS (SELECT DISTINCT l_suppkey AS s, p.* FROM lineitem JOIN part p ON l_partkey = p_partkey),
    pairs AS (
        SELECT a.s, a.p_partkey % 40 = b.p_partkey % 40 AS want,
            a.p_partkey % 5 > 0 AND b.p_partkey % 5 > 0 AND a.p_brand = b.p_brand AND a.p_size // 10 = b.p_size // 10 AS got
        FROM have a JOIN have b ON a.s = b.s AND a.p_partkey < b.p_partkey)
    SELECT s AS fixture_id, round(coalesce(2 * sum((want AND got)::INT)::DOUBLE / nullif(sum(want::INT) + sum(got::INT), 0), 0), 9) AS f1 FROM pairs GROUP BY s""",
)


# The parts that a customer ordered, some 40 at every scale.
def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, id, v): an id stands once in a group."""
    value = F.concat_ws(" ", F.substring_index("p_name", " ", -1), F.concat(F.substring("p_type", 1, 3), F.col("p_partkey").cast("string")))
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower(value).alias("v"))
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("grp"), F.col("l_partkey").alias("id"))
    # dealt out once, by group: equal rows meet there as well
    return rows.where("grp % 4 < 3 OR id % 3 > 0").join(names, "id").select("grp", "id", "v").repartition("grp").distinct()


_PHRASES = """
    phrases AS (
        SELECT DISTINCT o_custkey AS grp, p_partkey AS id, lower(split_part(p_name, ' ', -1) || ' ' || substr(p_type, 1, 3) || p_partkey) AS v
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_custkey % 4 < 3 OR p_partkey % 3 > 0),
    sets AS (
        SELECT grp, id, list_filter(list_distinct(string_split(v, ' ')), lambda w: w <> '') AS words,
            list_distinct(list_transform(range(1, length(v) + 1), lambda i: substr(' ' || v || ' ', i, 3))) AS grams, count(*) OVER (PARTITION BY grp) AS n
        FROM phrases)"""
_SHARED = "(list_has_any(a.words, b.words) OR len(list_intersect(a.grams, b.grams))::DOUBLE / (len(a.grams) + len(b.grams) - len(list_intersect(a.grams, b.grams))) >= {})".format(X.TRIGRAM_SIMILAR)

register(
    "f14_similar",
    lambda spark, sf: similar.similar_pairs(_phrases(spark, sf), "grp", "id", "v"),
    f"WITH {_PHRASES} SELECT a.grp, a.id AS a_id, b.id AS b_id FROM sets a JOIN sets b ON a.grp = b.grp AND a.id < b.id WHERE {_SHARED}",
)
register(
    "j4_duplicate_options",
    lambda spark, sf: similar.offered(_phrases(spark, sf), "grp", "id", "v"),
    f"WITH {_PHRASES} SELECT a.grp, a.id, b.id AS other FROM sets a JOIN sets b ON a.grp = b.grp AND a.id <> b.id WHERE a.n <= {X.ALL_PAIRS} OR {_SHARED}",
)


def m16_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean error of each priority's orders: five reports that grow with the table."""
    rows = scored(spark, sf_dir).select("priority", "pair", F.abs(F.col("score") - F.col("reference")).alias("err"))
    found = resample.interval(rows, "priority", "pair", "err")
    return found.select("priority", "reps", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def _fifth(x: str) -> str:
    return f"(({x} * {x} % {resample.PRIME}) * ({x} * {x} % {resample.PRIME}) % {resample.PRIME} * {x} % {resample.PRIME})"


register(
    "m16_bootstrap",
    m16_bootstrap,
    f"""
    WITH {SCORED}, reps AS (SELECT unnest(range(1, {resample.REPEATS + 1})) AS rep),
    a AS (SELECT priority, rep, abs(score - reference) AS err, (pair % {resample.PRIME} + rep * 104729) % {resample.PRIME} AS u FROM scored, reps),
    b AS (SELECT priority, rep, err, ({_fifth("u")} + rep * 15485863) % {resample.PRIME} AS u FROM a),
    c AS (SELECT priority, rep, err, {_fifth("u")} AS u FROM b),
    d AS (SELECT priority, rep, err, len(list_filter({list(resample.LIMITS)}, lambda l: u >= l)) AS w FROM c),
    means AS (SELECT priority, rep, sum(w * err)::DOUBLE / sum(w) AS m FROM d GROUP BY priority, rep HAVING sum(w) > 0)
    SELECT priority, count(*) AS reps, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM means GROUP BY priority""",
)


# The words of every passage's first sentence, its first two words, and the passage, as quotes of the documents.
def j10_resolve_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = table(spark, sf_dir, "benchmark")
    cuts = [(0, F.col("text")), (1, F.substring_index("text", ".", 1)), (2, F.substring_index("text", " ", 2)), (3, F.substring_index("text", " ", -1))]
    said = passages.select(F.explode(F.array(*[F.struct((F.col("item_id") * 4 + n).alias("quote_id"), c.alias("text")) for n, c in cuts])).alias("x")).select("x.*")
    return quotes.resolved(said, table(spark, sf_dir, "documents").select("doc_id", "text"), "quote_id", "doc_id")


register(
    "j10_resolve_quote",
    j10_resolve_quote,
    """
    WITH q AS (
        SELECT item_id * 4 AS quote_id, text FROM benchmark UNION ALL SELECT item_id * 4 + 1, split_part(text, '.', 1) FROM benchmark
        UNION ALL SELECT item_id * 4 + 2, array_to_string(string_split(text, ' ')[1:2], ' ') FROM benchmark UNION ALL SELECT item_id * 4 + 3, split_part(text, ' ', -1) FROM benchmark)
    SELECT quote_id, min(doc_id) AS doc_id FROM q JOIN documents d ON contains(d.text, q.text) GROUP BY quote_id HAVING count(*) = 1""",
)

register(
    "a22_labels_hash",
    lambda spark, sf: digests.labels_hash(table(spark, sf, "labels"), "doc_id", F.concat_ws(":", F.coalesce(F.col("quality").cast("string"), F.lit("?")), F.coalesce(F.col("toxic").cast("string"), F.lit("?")))),
    """
    WITH rows AS (SELECT '=' || doc_id AS id, '=' || coalesce(quality::VARCHAR, '?') || ':' || coalesce(toxic::VARCHAR, '?') AS content FROM labels),
    lines AS (SELECT sha256(id) AS k, sha256(id || chr(10) || content || chr(10)) AS h FROM rows),
    leaves AS (SELECT substr(k, 1, 4) AS k, sha256(string_agg(h, '' ORDER BY k, h)) AS h FROM lines GROUP BY substr(k, 1, 4)),
    nodes AS (SELECT substr(k, 1, 2) AS k, sha256(string_agg(h, '' ORDER BY k, h)) AS h FROM leaves GROUP BY substr(k, 1, 2))
    SELECT substr(sha256(string_agg(h, '' ORDER BY k, h)), 1, 12) AS labels_hash FROM nodes""",
)


# O2: the options of a unit's answers at the floor or above.
def o2_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k")
    drawn = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("unit"), k)
    weight = 1 + (F.col("event_id") * 7919 + F.col("k") * 104729) % 97
    # an event's four weights, without a window
    total = sum((1 + (F.col("event_id") * 7919 + i * 104729) % 97 for i in range(1, 5)), F.lit(0))
    option = F.when(F.col("k") == 4, "none").otherwise(F.concat(F.lpad(F.col("event_id").cast("string"), 10, "0"), F.lit("/o"), F.col("k").cast("string")))
    answers = drawn.select("unit", option.alias("option"), (weight / total).alias("p"))
    return score.top_k(answers, "unit").select("unit", "option", "rank")


register(
    "o2_retrieve",
    o2_retrieve,
    f"""
    WITH w AS (SELECT event_id, user_id AS unit, k, 1 + (event_id * 7919 + k * 104729) % 97 AS w FROM events, range(1, 5) r(k)),
    p AS (SELECT unit, CASE k WHEN 4 THEN 'none' ELSE lpad(event_id::VARCHAR, 10, '0') || '/o' || k END AS option, w::DOUBLE / sum(w) OVER (PARTITION BY event_id) AS p FROM w)
    SELECT unit, option, rank::INT AS rank FROM (
        SELECT unit, option, row_number() OVER (PARTITION BY unit ORDER BY p DESC, option) AS rank FROM p WHERE p >= {X.RETRIEVE_FLOOR} AND option <> 'none') WHERE rank <= {X.RETRIEVE_K}""",
)


# Features of pairs, their sums of products by fold, and predictions.
def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = 1 - F.col("blocker")
    return signals(spark, sf_dir).select("pair", (F.col("report") % 40 % 8).alias("fold"), F.col("reference").cast("double").alias("y"), left.alias("c"), (F.col("role_match") * left).alias("a"), (F.col("experience_short") * left).alias("b"))


_FEATURES = """
    signals AS (
        SELECT o_orderkey AS pair, o_custkey % 40 % 8 AS fold, (round(o_totalprice)::BIGINT % 101)::DOUBLE AS y, (o_orderkey * 7919 % 401)::DOUBLE / 400 AS rm, (o_orderkey * 104729 % 1000)::DOUBLE / 1000 AS es,
            1 - CASE WHEN o_orderkey % 5 = 0 THEN (o_custkey % 100)::DOUBLE / 100 ELSE 0.0::DOUBLE END AS c FROM orders),
    features AS (SELECT pair, fold, y, c, rm * c AS a, es * c AS b FROM signals)"""
_PRODUCTS = [x + y for x in "cab" for y in "cab"] + [x + "y" for x in "cab"]


def m9_normal_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = fitting.products(_features(spark, sf_dir), "fold", ["c", "a", "b"], "y")
    return sums.select("fold", *[F.round(F.col("s")[i], 6).alias(f"s_{n}") for i, n in enumerate(_PRODUCTS)])


register("m9_normal_equations", m9_normal_equations, f"WITH {_FEATURES} SELECT fold, " + ", ".join(f"round(sum({x} * {y}), 6) AS s_{x}{y}" for x, y in _PRODUCTS) + " FROM features GROUP BY fold")
register(
    "m10_predict",
    lambda spark, sf: _features(spark, sf).select("pair", fitting.predicted(F.array(*[F.lit(w) for w in X.MATCH_WEIGHTS]), ["c", "a", "b"]).alias("predicted")),
    f"WITH {_FEATURES} SELECT pair, round_even(greatest(0.0, least(100.0, {X.MATCH_WEIGHTS[0]}::DOUBLE * c + {X.MATCH_WEIGHTS[1]}::DOUBLE * a + ({X.MATCH_WEIGHTS[2]})::DOUBLE * b)), 0)::BIGINT AS predicted FROM features",
)


def m12_feature_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", (e % 101).alias("fit"), (e * 7 % 11 / 10).alias("responsibilities"), (e * 3 % 7 / 10).alias("domain_mismatch"), F.when(e % 4 > 0, e % 40).alias("gap_months"), (e % 9 / 8).alias("blocker"))
    names = ("fit", "months", "fit*resp", "resp*dom*months", "blocker*gap")
    return rows.withColumn("primary_gap", F.when(e % 3 > 0, e % 3 / 2)).select("event_id", *[F.round(fitting.feature(n), 9).alias(n.replace("*", "_")) for n in names])


register(
    "m12_feature_products",
    m12_feature_products,
    """
    WITH f AS (
        SELECT event_id, (event_id % 101)::DOUBLE / 100 AS fit, (event_id * 7 % 11)::DOUBLE / 10 AS resp, (event_id * 3 % 7)::DOUBLE / 10 AS dom, CASE WHEN event_id % 4 > 0 THEN least(event_id % 40, 24)::DOUBLE / 12 ELSE 0 END AS months,
            (event_id % 9)::DOUBLE / 8 AS blocker, (event_id % 3)::DOUBLE / 2 AS gap FROM events)
    SELECT event_id, round(fit, 9) AS fit, round(months, 9) AS months, round(fit * resp, 9) AS fit_resp, round(resp * dom * months, 9) AS resp_dom_months, round(blocker * gap, 9) AS blocker_gap FROM f""",
)


# whether a text names a value as a word of its own; a plus or a hash behind it makes another word.
def f12_contains_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.element_at(F.array(*[F.lit(x) for x in ("#", "+", " ", "-", "s", ".")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_type", F.lit(" "), F.upper("p_name"), mark, F.lit("x")).alias("text"), F.substring_index("p_name", " ", -1).alias("name"))
    return rows.where(L.word_in("text", "name")).select("p_partkey")


register(
    "f12_contains_any",
    f12_contains_any,
    """SELECT p_partkey FROM part WHERE regexp_matches(lower(p_type || ' ' || p_name) || ['#', '+', ' ', '-', 's', '.'][p_partkey % 6 + 1] || 'x', '(^|[^a-z0-9])' || split_part(p_name, ' ', -1) || '($|[^a-z0-9+#])')""",
)
