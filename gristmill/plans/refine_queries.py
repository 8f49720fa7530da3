"""Refinement, label matching and refitting over the driver's tables; sequential operators check against recursive SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import lexicon as X
from gristmill.functions import text as T
from gristmill.functions.dialect import DUCK, SPARK
from gristmill.operators import fitting, refine
from gristmill.operators import posting as P
from gristmill.plans.catalog import register
from gristmill.plans.dual import dual, run, table
from gristmill.plans.score_queries import R6, answers, ratings, requirements, signals
from gristmill.plans.text_queries import _headed, _some


def _over(build, *tables):
    """The builder's relation as a frame over sf_dir."""

    def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(spark, lambda t: f"SELECT * FROM {build(SPARK, t)} q_", **{t: table(spark, sf_dir, t) for t in tables})

    return frame


def _sql(text: str) -> str:
    return text.replace(" AS STRING)", " AS VARCHAR)")


DUCK_T = lambda t: t


# The orders of a customer are the questions of a posting.
def _questions(d, t):
    return f"(SELECT o_custkey AS posting, o_orderkey AS question, CAST(floor(o_totalprice / 10) AS BIGINT) AS size FROM {t('orders')})"


register(
    "w9_size_batches",
    lambda spark, sf: refine.size_batches(_over(_questions, "orders")(spark, sf), "posting", "question", "size"),
    f"WITH RECURSIVE q AS (SELECT *, row_number() OVER (PARTITION BY posting ORDER BY question) AS rn FROM {_questions(DUCK, DUCK_T)} q_), "
    f"w AS (SELECT posting, question, rn, CAST(0 AS BIGINT) AS batch, size AS used FROM q WHERE rn = 1 UNION ALL SELECT q.posting, q.question, q.rn, "
    f"CASE WHEN w.used > 0 AND w.used + q.size > {X.REFINEMENT_BYTES} THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.used > 0 AND w.used + q.size > {X.REFINEMENT_BYTES} THEN q.size ELSE w.used + q.size END "
    f"FROM w JOIN q ON q.posting = w.posting AND q.rn = w.rn + 1) SELECT posting, question, batch FROM w",
)


# Lines of an order with equal remainders are linked one way, and chains arise over two kinds of links.
def _links(d, t):
    r = ratings(d, t)
    return f"(SELECT a.grp AS grp, a.id AS a, b.id AS b FROM {r} a JOIN {r} b ON a.grp = b.grp AND a.id < b.id WHERE a.x % 5 = b.x % 5 OR a.y % 6 = b.y % 6)"


register(
    "u3_alternative_components",
    lambda spark, sf: refine.components(_over(_links, "lineitem")(spark, sf), "grp"),
    f"WITH RECURSIVE l AS (SELECT grp, a, b FROM {_links(DUCK, DUCK_T)} x_), e AS (SELECT grp, a, b FROM l UNION SELECT grp, b, a FROM l), "
    f"r AS (SELECT grp, a AS node, a AS seen FROM e UNION SELECT r.grp, r.node, e.b FROM r JOIN e ON e.grp = r.grp AND e.a = r.seen) SELECT grp, node, min(seen) AS component FROM r GROUP BY grp, node",
)


# The open lines of an order are predictions, the closed ones labels.
def _match_edges(d, t):
    rows = f"(SELECT l_orderkey AS grp, l_linestatus AS side, l_linenumber * 100000000 + p_partkey AS id, concat(p_name, ' ', lower(p_type)) AS v FROM {t('lineitem')} JOIN {t('part')} ON l_partkey = p_partkey)"
    a = f"(SELECT DISTINCT grp, side, id, {T.normal(d, 'v')} AS n, {T.content(d, 'v')} AS c FROM {rows} r_)"
    pairs = (
        f"(SELECT e.grp AS grp, e.id AS expected, p.id AS predicted, CASE WHEN e.n = p.n THEN 0 ELSE 1 END AS pass_no, e.n = p.n OR {T.loose_match(d, 'e.c', 'p.c')} AS fits, "
        f"{R6(T.fuzzy_jaccard(d, 'e.c', 'p.c'))} AS j FROM {a} e JOIN {a} p ON e.grp = p.grp AND e.side = 'F' AND p.side = 'O')"
    )
    return f"(SELECT grp, expected, predicted, pass_no, -j AS far FROM {pairs} pairs_ WHERE fits)"


_FREE = "NOT list_contains(w.es, e.expected) AND NOT list_contains(w.ps, e.predicted)"
register(
    "j13_greedy_match",
    lambda spark, sf: refine.greedy_match(_over(_match_edges, "lineitem", "part")(spark, sf), "grp", "expected", "predicted", ["pass_no", "expected", "far", "predicted"]),
    f"WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pass_no, expected, far, predicted) AS rn FROM {_match_edges(DUCK, DUCK_T)} m_), "
    f"w AS (SELECT grp, rn, expected, predicted, [expected] AS es, [predicted] AS ps, true AS took FROM e WHERE rn = 1 UNION ALL SELECT e.grp, e.rn, e.expected, e.predicted, "
    f"CASE WHEN {_FREE} THEN list_append(w.es, e.expected) ELSE w.es END, CASE WHEN {_FREE} THEN list_append(w.ps, e.predicted) ELSE w.ps END, {_FREE} "
    f"FROM w JOIN e ON e.grp = w.grp AND e.rn = w.rn + 1) SELECT grp, expected, predicted FROM w WHERE took",
)


# Weights refitted without each resume.
def _features(d, t):
    return f"(SELECT resume, CAST(reference AS DOUBLE) AS y, 1 - blocker AS c, role_match * (1 - blocker) AS a, experience_short * (1 - blocker) AS b FROM {signals(d, t)} s_)"


def _m11(spark: SparkSession, sf: str) -> DataFrame:
    out = fitting.leave_one_group_out(_over(_features, "orders")(spark, sf), "resume", ["c", "a", "b"], "y")
    return out.select("resume", "n", F.round("mae", 6).alias("mae"), F.round("bias", 6).alias("bias"))


def _m11_sql() -> str:
    xs = ("c", "a", "b")
    names = {f"s_{p}{q}": f"{p} * {q}" for i, p in enumerate(xs) for q in (*xs[i:], "y")}
    sums = ", ".join(f"sum({e}) AS {n}" for n, e in names.items())
    rest = ", ".join(f"(SELECT sum({n}) FROM g) - {n} AS {n}" for n in names)

    def det(m):
        (p, q, r), (s, t, u), (v, w, x) = m
        return f"({p} * ({t} * {x} - {u} * {w}) - {q} * ({s} * {x} - {u} * {v}) + {r} * ({s} * {w} - {t} * {v}))"

    m = [["s_cc", "s_ca", "s_cb"], ["s_ca", f"(s_aa + {fitting.RIDGE})", "s_ab"], ["s_cb", "s_ab", f"(s_bb + {fitting.RIDGE})"]]
    swap = lambda k: [[("s_cy", "s_ay", "s_by")[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]
    w = ", ".join(f"{det(swap(k))} / {det(m)} AS w{k}" for k in range(3))
    e = "round_even(greatest(0.0, least(100.0, w0 * c + w1 * a + w2 * b)), 0) - y"
    return (
        f"WITH f AS (SELECT * FROM {_features(DUCK, DUCK_T)} x_), g AS (SELECT resume, {sums} FROM f GROUP BY resume), h AS (SELECT resume, {rest} FROM g), k AS (SELECT resume, {w} FROM h) "
        f"SELECT resume, count(*) AS n, {R6('avg(abs(e))')} AS mae, {R6('avg(e)')} AS bias FROM (SELECT f.resume AS resume, {e} AS e FROM f JOIN k ON f.resume = k.resume) z_ GROUP BY resume"
    )


register("m11_leave_one_resume_out", _m11, _m11_sql())

_RANKED = "CASE tier WHEN 'required' THEN 2 WHEN 'preferred' THEN 1 ELSE 0 END"
_TIER = "CASE max(rk) WHEN 2 THEN 'required' WHEN 1 THEN 'preferred' ELSE 'mentioned' END"


def _accepted(d, t):
    """(posting, seq, ref, value, rk, level): accepted candidates, the parts' names of an order in mixed case."""
    return (
        f"(SELECT q.pair AS posting, q.req AS seq, concat('s', CAST(l.l_linenumber AS STRING)) AS ref, CASE WHEN l.l_returnflag = 'A' THEN upper(p.p_type) ELSE p.p_type END AS value, {_RANKED} AS rk, q.req * 7919 % 5 AS level "
        f"FROM {requirements(d, t)} q JOIN {t('lineitem')} l ON q.pair = l.l_orderkey AND q.req = l.l_orderkey * 10 + l.l_linenumber JOIN {t('part')} p ON l.l_partkey = p.p_partkey)"
    )


def _result(d, t):
    first = f"(SELECT *, row_number() OVER (PARTITION BY posting, lower(value) ORDER BY seq, value, ref) AS nth, min(seq) OVER (PARTITION BY posting, lower(value)) AS spot FROM {_accepted(d, t)} a_)"
    return f"(SELECT posting, lower(value) AS k, min(spot) AS spot, max(CASE WHEN nth = 1 THEN value END) AS value, {_TIER} AS tier, CAST(max(level) AS DOUBLE) / 4 AS importance, count(DISTINCT ref) AS refs FROM {first} f_ GROUP BY posting, lower(value))"


dual("a3_build_result", lambda d, t: f"SELECT posting, concat('req_', CAST(row_number() OVER (PARTITION BY posting ORDER BY importance DESC, spot, k) AS STRING)) AS id, value, tier, importance, refs FROM {_result(d, t)} r_", "lineitem", "orders", "part")
dual("a6_linked_value", lambda d, t: f"SELECT req, max(CASE WHEN rn = 1 THEN opt END) AS linked FROM (SELECT req, opt, p, row_number() OVER (PARTITION BY req ORDER BY p DESC, opt) AS rn FROM {answers(d, t)} a_ WHERE opt <> 'o4') x_ GROUP BY req HAVING sum(p) >= {X.LINK_MASS}", "events")


def _first_sentence(d, t):
    rows = f"(SELECT doc_id, ord, lower(text) AS s FROM {P.sentences(d, _some(d, t))} q_ WHERE ord > 1)"
    word = lambda w: d.like("s", f"(^|[^\\p{{L}}\\p{{Nd}}]){w}($|[^\\p{{L}}\\p{{Nd}}])")
    found = ", ".join(f"min(CASE WHEN {word(w)} THEN ord END) AS in_{w}" for w in ("the", "und", "les", "est"))
    return f"SELECT x.doc_id AS doc_id, in_the, in_und, in_les, in_est FROM {t('documents')} x LEFT JOIN (SELECT doc_id, {found} FROM {rows} r_ GROUP BY doc_id) y ON x.doc_id = y.doc_id"


dual("j11_first_sentence", _first_sentence, "documents")
dual("j16_rescore", lambda d, t: f"SELECT s.doc_id AS doc_id, s.stored = l.quality AS agrees FROM (SELECT doc_id, CASE WHEN n_chars < 200 THEN 0 ELSE 1 END AS stored FROM {t('documents')} WHERE text IS NOT NULL) s JOIN {t('labels')} l ON s.doc_id = l.doc_id", "documents", "labels")
dual("j17_predicted_values", lambda d, t: f"SELECT r.pair AS pair, r.grp AS grp, r.req AS req, l.l_partkey AS value FROM {requirements(d, t)} r JOIN {t('lineitem')} l ON r.pair = l.l_orderkey AND r.req = l.l_orderkey * 10 + l.l_linenumber WHERE r.grp IS NOT NULL", "lineitem", "orders")
dual("f8_prefix_filter", lambda d, t: f"SELECT doc_id, {d.like('CAST(doc_id AS STRING)', '^(1|27)')} AS selected FROM {t('documents')}", "documents")
dual("f18_is_option", lambda d, t: f"SELECT req, opt, {d.has(d.words('o1', 'o2', 'none'), 'opt')} AS offered FROM {answers(d, t)} a_", "events")
dual("s26_probe_pairs", lambda d, t: f"SELECT 'subset' AS pool, doc_id FROM {t('documents')} WHERE doc_id IN (SELECT doc_id FROM {t('labels')}) UNION ALL SELECT 'final', item_id FROM {t('benchmark')}", "documents", "labels", "benchmark")
dual("s25_probe_means", lambda d, t: f"SELECT user_id, event_type, {R6('avg(CAST(event_id % 5 AS DOUBLE) / 4)')} AS share FROM {t('events')} GROUP BY user_id, event_type", "events")
dual("t10_entry_headers", lambda d, t: f"SELECT doc_id, line_no, {d.at('bits', '1')} AS role, {d.at('bits', '2')} AS company, {d.at('bits', '3')} AS dates FROM (SELECT doc_id, line_no, {d.map(d.split('body', '|'), 'ep', 'trim(ep)')} AS bits FROM {P.headed_lines(d, _headed(d, t))} h_ WHERE {d.like('mk', '^##')}) b_", "documents")
dual("e5_score_check", lambda d, t: f"SELECT pair, count(*) AS n, count(CASE WHEN g = w THEN 1 END) AS exact, count(CASE WHEN abs(g - w) <= 1 THEN 1 END) AS near, CAST(sum(g) AS BIGINT) AS got, CAST(sum(w) AS BIGINT) AS want FROM (SELECT pair, CASE coverage WHEN 'strong' THEN 3 WHEN 'partial' THEN 2 WHEN 'weak' THEN 1 ELSE 0 END AS g, req * 31 % 4 AS w FROM {requirements(d, t)} r_) x_ GROUP BY pair", "lineitem", "orders")
dual("k7_metric_table", lambda d, t: f"SELECT ord, concat('| ', tier, ' | ', CAST(n AS STRING), ' | ', CAST(CAST(round(100 * CAST(hit AS DOUBLE) / n) AS BIGINT) AS STRING), '% |') AS line FROM (SELECT CASE tier WHEN 'required' THEN 1 WHEN 'preferred' THEN 2 ELSE 3 END AS ord, tier, count(*) AS n, sum(CASE WHEN coverage <> 'none' THEN 1 ELSE 0 END) AS hit FROM {requirements(d, t)} r_ GROUP BY tier) x_", "lineitem", "orders")
dual("k10_notes", lambda d, t: f"SELECT pair, {d.ordered(chr(39).join(['concat(', '- ', ', CAST(req AS STRING), ', ': ', ', coverage)']), 'req', chr(10))} AS notes FROM (SELECT pair, req, min(coverage) AS coverage FROM {requirements(d, t)} r_ WHERE coverage IN ('none', 'weak') GROUP BY pair, req) y_ GROUP BY pair", "lineitem", "orders")
