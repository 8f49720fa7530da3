"""Scoring, matching, aggregation and statistics over the driver's tables.

There are no postings, resumes or classifier answers among them, so these stand in, by plain integer arithmetic:
orders are pairs and their lines requirements (tier from the order's priority, coverage from the return flag),
events are answers, parts and suppliers are ratings, labels are reference scores.
"""

from __future__ import annotations

from gristmill.functions import lexicon as X
from gristmill.functions import text as T
from gristmill.plans.dual import dual

CREDIT = "CASE coverage WHEN 'strong' THEN 1.0D WHEN 'partial' THEN 0.6D WHEN 'weak' THEN 0.3D ELSE 0.0D END"
WEIGHT = "CASE tier WHEN 'required' THEN 3.0D WHEN 'preferred' THEN 1.5D ELSE 1.0D END"
RANK = "CASE coverage WHEN 'strong' THEN 3 WHEN 'partial' THEN 2 WHEN 'weak' THEN 1 ELSE 0 END"
TIER_RANK = "CASE tier WHEN 'required' THEN 2 WHEN 'preferred' THEN 1 ELSE 0 END"


def _num(d, s):
    return s if d.name == "spark" else s.replace("0D", "0::DOUBLE").replace("5D", "5::DOUBLE").replace("6D", "6::DOUBLE").replace("3D", "3::DOUBLE").replace("7D", "7::DOUBLE").replace("2D", "2::DOUBLE").replace("1D", "1::DOUBLE").replace("4D", "4::DOUBLE")


def requirements(d, t):
    """(pair, req, grp, tier, coverage): two lines of a part number's last digit 0 form an alternative group."""
    return (
        f"(SELECT l_orderkey AS pair, l_orderkey * 10 + l_linenumber AS req, CASE WHEN l_partkey % 3 = 0 THEN l_orderkey * 10 + l_linenumber % 2 END AS grp, "
        f"CASE CAST(substr(o_orderpriority, 1, 1) AS INT) WHEN 1 THEN 'required' WHEN 2 THEN 'required' WHEN 3 THEN 'preferred' ELSE 'mentioned' END AS tier, "
        f"CASE WHEN l_quantity < 10 THEN 'none' WHEN l_returnflag = 'A' THEN 'strong' WHEN l_returnflag = 'N' THEN 'partial' ELSE 'weak' END AS coverage "
        f"FROM {t('lineitem')} JOIN {t('orders')} ON l_orderkey = o_orderkey)"
    )


def items(d, t):
    """Groups count once: best coverage, strongest tier."""
    a = f"(SELECT pair, coalesce(grp + 1000000000, req) AS item, max({TIER_RANK}) AS tr, max({RANK}) AS cr FROM {requirements(d, t)} r_ GROUP BY pair, coalesce(grp + 1000000000, req))"
    return f"(SELECT pair, item, CASE tr WHEN 2 THEN 'required' WHEN 1 THEN 'preferred' ELSE 'mentioned' END AS tier, CASE cr WHEN 3 THEN 'strong' WHEN 2 THEN 'partial' WHEN 1 THEN 'weak' ELSE 'none' END AS coverage FROM {a} a_)"


def signals(d, t):
    """(pair, role_match, experience_short, blocker, reference)."""
    return _num(d, f"(SELECT o_orderkey AS pair, o_custkey AS report, o_custkey % 40 AS resume, (o_orderkey * 7919 % 401) / 400.0D AS role_match, (o_orderkey * 104729 % 1000) / 1000.0D AS experience_short, CASE WHEN o_orderkey % 5 = 0 THEN (o_custkey % 100) / 100.0D ELSE 0.0D END AS blocker, CAST(round(o_totalprice) AS BIGINT) % 101 AS reference FROM {t('orders')})")


def match(d, t):
    return _num(d, f"(SELECT pair, report, resume, reference, CAST(round(greatest(0.0D, least(100.0D, (80.7D + 18.5D * role_match - 55.2D * experience_short) * (1.0D - blocker)))) AS BIGINT) AS score FROM {signals(d, t)} s_)")


def ratings(d, t):
    """(grp, id, x, y): the lines of an order, a group of seven at most at every scale, since pairs of a group are compared."""
    return f"(SELECT l_orderkey AS grp, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS id, CAST(l_quantity AS BIGINT) % 20 AS x, l_suppkey * 31 % 17 AS y FROM {t('lineitem')})"


def phrases(d, t):
    """(grp, id, v): the parts of an order's lines as short phrases."""
    return f"(SELECT l_orderkey AS grp, l_linenumber * 100000000 + p_partkey AS id, concat(p_name, ' ', lower(p_type)) AS v FROM {t('lineitem')} JOIN {t('part')} ON l_partkey = p_partkey)"


def answers(d, t):
    """(req, opt, p): a choice distribution over four options for every event, weights from integers."""
    w = "(1 + (event_id * 7919 + k * 104729) % 97)"
    opts = d.explode(f"(SELECT event_id, user_id, {d.seq('4')} AS ks FROM {t('events')}) e_", "event_id, user_id", "ks", "pos", "k")
    a = f"(SELECT event_id AS req, user_id AS unit, concat('o', CAST(k AS STRING)) AS opt, k, {w} AS w FROM {opts} o_)"
    return f"(SELECT req, unit, opt, k, CAST(w AS DOUBLE) / sum(w) OVER (PARTITION BY req) AS p FROM {a} a_)"


def _tallies(d, t):
    """Distinct tallies of a pair's coverage with the number of pairs that have them: few rows at every scale."""
    cases = ", ".join(f"sum(CASE WHEN coverage = '{c}' THEN 1 ELSE 0 END) AS {a}" for c, a in (("strong", "strong"), ("partial", "n_partial"), ("weak", "n_weak")))
    a = f"(SELECT pair, {cases}, count(*) AS n, pair % 101 AS reference FROM {requirements(d, t)} r_ GROUP BY pair)"
    return f"(SELECT strong, n_partial, n_weak, n, reference, count(*) AS m FROM {a} a_ GROUP BY strong, n_partial, n_weak, n, reference)"


def _grid(d, tallies):
    """Each tally with each credit of the grid in twentieths, weak at most partial."""
    keep = "strong, n_partial, n_weak, n, reference, m"
    a = d.explode(f"(SELECT *, {d.seq('21')} AS ps FROM {tallies} t_) ta_", keep, "ps", "pos_p", "p1")
    b = d.explode(f"(SELECT *, {d.seq('p1')} AS ws FROM {a} tb_) tc_", f"{keep}, p1", "ws", "pos_w", "w1")
    return f"(SELECT {keep}, p1 - 1 AS partial, w1 - 1 AS weak FROM {b} td_)"


#: Credits in tenths and weights in halves, so that sums are whole numbers and rounding doesn't depend on their order.
CREDIT10 = "CASE coverage WHEN 'strong' THEN 10 WHEN 'partial' THEN 6 WHEN 'weak' THEN 3 ELSE 0 END"
WEIGHT2 = "CASE tier WHEN 'required' THEN 6 WHEN 'preferred' THEN 3 ELSE 2 END"
R6 = "round({}, 6)".format
N = "CAST(sum({}) AS BIGINT)".format

dual("m2_percent", lambda d, t: f"SELECT s_nationkey, CAST(round(100 * CAST(sum(CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*)) AS BIGINT) AS pct FROM {t('supplier')} GROUP BY s_nationkey", "supplier")
dual("m3_score_share", lambda d, t: f"SELECT event_id, CAST(event_id % 5 AS DOUBLE) / 4 AS share FROM {t('events')}", "events")
dual("m4_pearson", lambda d, t: f"SELECT grp, {R6('coalesce(' + d.div('n * sxy - sx * sy', 'nullif(sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy), 0)') + ', 0)')} AS r FROM (SELECT grp, CAST(count(*) AS DOUBLE) AS n, CAST(sum(x) AS DOUBLE) AS sx, CAST(sum(y) AS DOUBLE) AS sy, CAST(sum(x * y) AS DOUBLE) AS sxy, CAST(sum(x * x) AS DOUBLE) AS sxx, CAST(sum(y * y) AS DOUBLE) AS syy FROM {ratings(d, t)} r_ GROUP BY grp) g_", "lineitem")
dual("m7_fuzzy_jaccard", lambda d, t: f"SELECT a_id, b_id, {R6(T.fuzzy_jaccard(d, 'ca', 'cb'))} AS j FROM (SELECT a.item_id AS a_id, b.item_id AS b_id, a.c AS ca, b.c AS cb FROM (SELECT item_id, {T.content(d, 'text')} AS c FROM {t('benchmark')}) a JOIN (SELECT item_id, {T.content(d, 'text')} AS c FROM {t('benchmark')}) b ON b.item_id = a.item_id + 1) p_", "benchmark")
dual("m13_calibrated_fit", lambda d, t: f"SELECT pair, CAST(floor(10 * {d.div('sum(w * c)', 'sum(w)')} + CAST(0.5 AS DOUBLE)) AS BIGINT) AS fit FROM (SELECT pair, {WEIGHT2} AS w, {CREDIT10} AS c FROM {items(d, t)} i_) x_ GROUP BY pair", "lineitem", "orders")
dual("m14_credit_grid", lambda d, t: f"SELECT partial, weak, {R6(d.div('sum(m * err)', 'sum(m)'))} AS mae FROM (SELECT partial, weak, m, abs(100 * CAST(20 * strong + n_partial * partial + n_weak * weak AS DOUBLE) / (20 * n) - reference) AS err FROM {_grid(d, _tallies(d, t))} g_) x_ GROUP BY partial, weak", "lineitem", "orders")
dual("m15_price", lambda d, t: f"SELECT event_id, round(CASE WHEN tin < 1 THEN CAST(chars AS DOUBLE) / 16 ELSE CAST(tin AS DOUBLE) / 4 END / 1000 + CAST(tout AS DOUBLE) / 500, 9) AS milli_usd FROM (SELECT event_id, user_id % 900 AS tin, event_id % 300 AS tout, {d.length('props')} AS chars FROM {t('events')}) e_", "events")
dual("m17_legacy_match", lambda d, t: f"SELECT pair, CAST(round(greatest(0, least(100, 44.2 + 31.7 * role_match + 46.2 * experience_short - 17.5 * blocker))) AS BIGINT) AS score FROM {signals(d, t)} s_", "orders")
dual("a1_tier_for", lambda d, t: f"SELECT pair, CASE max({TIER_RANK}) WHEN 2 THEN 'required' WHEN 1 THEN 'preferred' ELSE 'mentioned' END AS tier FROM {requirements(d, t)} r_ GROUP BY pair", "lineitem", "orders")
dual("a4_decide", lambda d, t: f"SELECT req, {R6('sum(p)')} AS mass, max(CASE WHEN rn = 1 THEN opt END) AS choice FROM (SELECT *, row_number() OVER (PARTITION BY req ORDER BY p DESC, k) AS rn FROM {answers(d, t)} a_ WHERE k < 4) x_ GROUP BY req", "events")
dual("a5_decide_strength", lambda d, t: f"SELECT req, CASE WHEN s >= p AND s >= w THEN 'strong' WHEN p >= w THEN 'partial' ELSE 'weak' END AS strength, {R6('s + p + w')} AS mass FROM (SELECT req, max(CASE WHEN k = 1 THEN p END) AS s, max(CASE WHEN k = 2 THEN p END) AS p, max(CASE WHEN k = 3 THEN p END) AS w FROM {answers(d, t)} a_ GROUP BY req) x_", "events")
dual("a9_coverage", lambda d, t: f"SELECT pair, item, coverage FROM {items(d, t)} i_", "lineitem", "orders")
dual("a10_fit_by_tier", lambda d, t: f"SELECT pair, tier, CAST(round(10 * {d.div('sum(' + CREDIT10 + ')', 'count(*)')}) AS BIGINT) AS fit FROM {items(d, t)} i_ GROUP BY pair, tier", "lineitem", "orders")
dual("a20_ratio", lambda d, t: f"SELECT s_nationkey, {R6('coalesce(' + d.div('sum(CASE WHEN s_acctbal > 5000 THEN 1 ELSE 0 END)', 'sum(CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END)') + ', 0)')} AS ratio FROM {t('supplier')} GROUP BY s_nationkey", "supplier")
dual("a24_resume_mae", lambda d, t: f"SELECT resume, {R6('avg(CAST(abs(score - reference) AS DOUBLE))')} AS mae FROM {match(d, t)} m_ GROUP BY resume", "orders")
dual("a25_counts_pivot", lambda d, t: f"SELECT tier, count(CASE WHEN coverage = 'strong' THEN 1 END) AS strong, count(CASE WHEN coverage = 'partial' THEN 1 END) AS partial, count(CASE WHEN coverage = 'weak' THEN 1 END) AS weak, count(CASE WHEN coverage = 'none' THEN 1 END) AS none FROM {items(d, t)} i_ GROUP BY tier", "lineitem", "orders")
dual("a26_noise", lambda d, t: f"SELECT s_nationkey, CAST(median(s_suppkey % 37) AS DOUBLE) AS med, max(s_suppkey % 37) - min(s_suppkey % 37) AS spread FROM {t('supplier')} GROUP BY s_nationkey", "supplier")
dual("f3_requirement_mass", lambda d, t: f"SELECT req, {R6('sum(p)')} AS mass FROM {answers(d, t)} a_ WHERE k < 4 GROUP BY req HAVING sum(p) >= {X.REQUIREMENT_MASS}", "events")
dual("f5_retrieval_floor", lambda d, t: f"SELECT req, opt FROM {answers(d, t)} a_ WHERE p >= {X.RETRIEVE_FLOOR} AND opt <> 'o4'", "events")
dual("f7_without_mentioned", lambda d, t: f"SELECT pair, req, CASE WHEN count(*) OVER (PARTITION BY pair, grp) >= 2 AND grp IS NOT NULL THEN grp END AS grp FROM {requirements(d, t)} r_ WHERE tier <> 'mentioned'", "lineitem", "orders")
dual("f9_strict_match", lambda d, t: f"SELECT a.grp AS grp, a.id AS a_id, b.id AS b_id FROM (SELECT grp, id, {T.normal(d, 'v')} AS n FROM {phrases(d, t)} a_) a JOIN (SELECT grp, id, {T.normal(d, 'upper(v)')} AS n FROM {phrases(d, t)} b_) b ON a.grp = b.grp AND a.n = b.n AND a.id < b.id", "lineitem", "part")
dual("f10_loose_match", lambda d, t: f"SELECT a.grp AS grp, a.id AS a_id, b.id AS b_id FROM (SELECT grp, id, {T.content(d, 'v')} AS c FROM {phrases(d, t)} a_) a JOIN (SELECT grp, id, {T.content(d, 'v')} AS c FROM {phrases(d, t)} b_) b ON a.grp = b.grp AND a.id <> b.id WHERE {T.loose_match(d, 'b.c', 'a.c')}", "lineitem", "part")
dual("f13_contains_word", lambda d, t: f"SELECT doc_id FROM {t('documents')} WHERE {d.like('lower(text)', '(^|[^\\p{L}\\p{Nd}])(est|zur|pour)($|[^\\p{L}\\p{Nd}])')}", "documents")
dual("j1_chunk_sentence", lambda d, t: f"SELECT l_orderkey, l_linenumber, o_orderpriority FROM {t('lineitem')} JOIN {t('orders')} ON l_orderkey = o_orderkey", "lineitem", "orders")
dual("j2_mentions", lambda d, t: f"SELECT DISTINCT conv_id, role FROM {t('conversations')}", "conversations")
dual("j3_same_sentence", lambda d, t: f"SELECT a.l_partkey AS v, b.l_partkey AS other, min(a.l_orderkey) AS first_ref FROM {t('lineitem')} a JOIN {t('lineitem')} b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY a.l_partkey, b.l_partkey", "lineitem")
dual("j5_mutual", lambda d, t: f"SELECT DISTINCT a.u AS a_id, a.v AS b_id FROM (SELECT DISTINCT l_suppkey AS u, l_partkey % 100 AS v FROM {t('lineitem')}) a JOIN (SELECT DISTINCT l_suppkey AS u, l_partkey % 100 AS v FROM {t('lineitem')}) b ON a.u = b.v AND a.v = b.u WHERE a.u < a.v", "lineitem")
dual("j8_linked_units", lambda d, t: f"SELECT c_custkey FROM {t('customer')} WHERE c_custkey IN (SELECT o_custkey FROM {t('orders')})", "customer", "orders")
dual("j9_first_group", lambda d, t: f"SELECT pair, req, min(grp) AS grp FROM {requirements(d, t)} r_ GROUP BY pair, req", "lineitem", "orders")
dual("j14_pairs_current", lambda d, t: f"SELECT o.o_orderkey AS pair, c.c_acctbal AS reference FROM {t('orders')} o LEFT JOIN (SELECT * FROM {t('customer')} WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey", "orders", "customer")
dual("j15_replay", lambda d, t: f"SELECT a.event_id AS event_id, b.score AS score FROM (SELECT event_id, {d.sha('concat(event_type, CAST(event_id AS STRING))')} AS request FROM {t('events')}) a LEFT JOIN (SELECT {d.sha('concat(event_type, CAST(event_id AS STRING))')} AS request, event_id % 5 AS score FROM {t('events')} WHERE event_type <> 'error') b ON a.request = b.request", "events")
dual("j20_gap_values", lambda d, t: f"SELECT pair, {d.ordered('CAST(req AS STRING)', 'req', ' / ')} AS gaps FROM {requirements(d, t)} r_ WHERE tier = 'required' AND coverage = 'none' GROUP BY pair", "lineitem", "orders")
dual("w2_numbering", lambda d, t: f"SELECT conv_id, turn, concat('e', CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS STRING)) AS id FROM {t('conversations')}", "conversations")
dual("w3_carry_forward", lambda d, t: f"SELECT conv_id, turn, {d.last('CASE WHEN turn % 3 = 0 THEN role END', 'PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} AS current_role_ FROM {t('conversations')}", "conversations")
dual("w4_result_order", lambda d, t: f"SELECT pair, req, CAST(row_number() OVER (PARTITION BY pair ORDER BY (req * 7919) % 5 DESC, req) AS BIGINT) AS ord FROM {requirements(d, t)} r_", "lineitem", "orders")
dual("w5_blocks", lambda d, t: f"SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM {t('conversations')}", "conversations")
dual("w8_validation_batches", lambda d, t: f"SELECT user_id, event_id, {d.idiv('row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1', str(X.VALIDATION_BATCH))} AS batch FROM {t('events')}", "events")
dual("o1_top_options", lambda d, t: f"SELECT req, opt, CAST(rn AS BIGINT) AS rn FROM (SELECT req, opt, row_number() OVER (PARTITION BY req ORDER BY p DESC, opt) AS rn FROM {answers(d, t)} a_) x_ WHERE rn <= 2", "events")
dual("o3_top_reject", lambda d, t: f"SELECT req, opt FROM (SELECT req, opt, row_number() OVER (PARTITION BY req ORDER BY p DESC, opt) AS rn FROM {answers(d, t)} a_ WHERE opt IN ('o2', 'o3')) x_ WHERE rn = 1", "events")
dual("o4_evidence_order", lambda d, t: f"SELECT pair, req, CAST(row_number() OVER (PARTITION BY pair ORDER BY {RANK} DESC, req % 7 DESC, req) AS BIGINT) AS ord FROM {requirements(d, t)} r_", "lineitem", "orders")
dual("o5_group_order", lambda d, t: f"SELECT pair, grp, CAST(row_number() OVER (PARTITION BY pair ORDER BY min(req)) AS BIGINT) AS ord FROM {requirements(d, t)} r_ WHERE grp IS NOT NULL GROUP BY pair, grp", "lineitem", "orders")
dual("u1_union_first", lambda d, t: f"SELECT v, src FROM (SELECT v, src, row_number() OVER (PARTITION BY lower(v) ORDER BY src) AS rn FROM (SELECT DISTINCT c_name AS v, 1 AS src FROM {t('customer')} UNION ALL SELECT DISTINCT upper(c_name), 2 FROM {t('customer')}) u_) x_ WHERE rn = 1", "customer")
dual("u6_pair_intersection", lambda d, t: f"SELECT l_suppkey AS a, l_partkey AS b FROM {t('lineitem')} WHERE l_returnflag = 'A' INTERSECT SELECT l_suppkey, l_partkey FROM {t('lineitem')} WHERE l_returnflag = 'R'", "lineitem")
dual("e3_attribute_miss", lambda d, t: f"SELECT req, min(stage) AS stage FROM (SELECT req, CASE WHEN coverage = 'none' THEN '1 refinement' WHEN tier = 'mentioned' THEN '2 chunk' ELSE '3 sentence' END AS stage FROM {requirements(d, t)} r_ UNION ALL SELECT req, '4 not in text' FROM {requirements(d, t)} q_) x_ GROUP BY req", "lineitem", "orders")
dual("k8_confusion_pivot", lambda d, t: f"SELECT tier, count(CASE WHEN coverage = 'strong' THEN 1 END) AS strong, count(CASE WHEN coverage = 'weak' THEN 1 END) AS weak FROM {requirements(d, t)} r_ GROUP BY tier", "lineitem", "orders")
dual("k11_pairs_by_error", lambda d, t: f"SELECT report, pair, CAST(row_number() OVER (PARTITION BY report ORDER BY coalesce(abs(score - reference), -1) DESC, pair) AS BIGINT) AS ord FROM {match(d, t)} m_", "orders")
dual("k13_metrics_text", lambda d, t: f"SELECT concat(event_type, ' n=', CAST(count(*) AS STRING), ' max=', CAST(max(user_id) AS STRING)) AS line FROM {t('events')} GROUP BY event_type", "events")
dual("s14_load_pairs", lambda d, t: f"SELECT d.doc_id AS doc_id, l.quality AS quality, coalesce(l.doc_id IS NOT NULL, false) AS labelled, (CAST(d.doc_id AS STRING) LIKE '1%' OR CAST(d.doc_id AS STRING) LIKE '27%') AS selected FROM {t('documents')} d LEFT JOIN {t('labels')} l ON d.doc_id = l.doc_id", "documents", "labels")
dual("s24_pool_reports", lambda d, t: f"SELECT user_id, {R6('avg(coalesce(CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END, 0))')} AS v FROM {t('events')} GROUP BY user_id", "events")
