"""Text operators over the driver's tables: documents stand in for postings and resumes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import lexicon as X
from gristmill.functions import text as T
from gristmill.functions.dialect import SPARK as D
from gristmill.operators import candidates as C
from gristmill.operators import posting as P
from gristmill.operators import resume as R
from gristmill.plans.dual import checked, dual
from gristmill.plans.score_queries import phrases


def _some(d, t, cond="true"):
    return f"(SELECT doc_id, text FROM {t('documents')} WHERE {cond}) src_"


def _headed(d, t):
    """Documents with a heading, a list and a label put in, as postings and resumes have them."""
    a = f"SELECT doc_id, replace(text, '. ', concat('.', {d.lit(chr(10))})) AS body, doc_id % 6 AS k FROM {t('documents')}"
    head = "CASE k WHEN 0 THEN '# Experience' WHEN 1 THEN '# Skills & Tools' WHEN 2 THEN '# Education' WHEN 3 THEN 'Summary:' WHEN 4 THEN '# Projects' ELSE '# Certifications' END"
    nl = d.lit("\n")
    return (
        f"(SELECT doc_id, concat('Name', {nl}, {head}, {nl}, '## Lead Engineer | Acme, Inc. | 2019 - 2021', {nl}, body, {nl}, '- built a ', substr(body, 1, 20), {nl}, 'and more', {nl}, {nl}, "
        f"'# Skills', {nl}, 'Stack: a, b (c, d), e, f, ', substr(body, 1, 12), ', g, h, i', {nl}, 'Languages: Go, SQL') AS text FROM ({a}) a_) src_"
    )


def _sentence_source(d, t):
    return f"(SELECT doc_id, ord, text FROM {P.sentences(d, _some(d, t))} s_) ss_"


dual("s2_title", lambda d, t: f"SELECT doc_id, {T.title(d, 'text')} AS title FROM {t('documents')}", "documents")
dual("s4_within_limit", lambda d, t: f"SELECT doc_id, {d.octets('text')} AS n_bytes FROM {t('documents')} WHERE {d.octets('text')} <= {X.TEXT_BYTES} AND trim(text) <> ''", "documents")
dual("s9_space_after_bullet", lambda d, t: f"SELECT item_id, {d.sub('concat(' + d.lit('•') + ', text)', '^([•●◦▪■‣])([^ ])', '@1 @2')} AS line FROM {t('benchmark')}", "benchmark")
dual("s28_strip_front_matter", lambda d, t: f"SELECT item_id, {d.sub('concat(' + d.lit(chr(45) * 3 + chr(10) + 'a: b' + chr(10) + chr(45) * 3 + chr(10)) + ', text)', '(?s)^---\\n.*?\\n---\\n')} AS body FROM {t('benchmark')}", "benchmark")
dual("t1_posting_text", lambda d, t: f"SELECT doc_id, md5({T.posting_text(d, 'text')}) AS body FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('Head', {d.lit(chr(10))}, 'intro', {d.lit(chr(10) + '### Full Job Description' + chr(10) * 3)}, text) ELSE text END AS text FROM {t('documents')}) x_", "documents")
dual("t3_headings", lambda d, t: f"SELECT doc_id, line_no, mk, body, strong FROM {P.headed_lines(d, _headed(d, t))} q_ WHERE heading", "documents")
dual("t4_split_line", lambda d, t: f"SELECT doc_id, part_no, part FROM {d.explode(_some(d, t), 'doc_id', T.split_line(d, T.squeeze(d, 'text')), 'part_no', 'part')} q_", "documents")
dual("t5_abbreviations", lambda d, t: f"SELECT w AS word, count(*) AS n FROM {d.explode(_some(d, t), 'doc_id', d.split('text', ' '), 'pos', 'w')} q_ WHERE {d.has(d.words(*X.ABBREVIATIONS), 'lower(w)')} OR {d.like('w', '[^.]+[.][^.]+')} GROUP BY w", "documents")
dual("t6_letter_tests", lambda d, t: f"SELECT doc_id, {d.like('text', T.ALNUM)} AS alnum, {d.like('text', '[\\p{L}]')} AS letter, {d.like('text', '^[\\p{Lu}\\p{Nd}]')} AS starts FROM {t('documents')}", "documents")
dual("t7_list_marker", lambda d, t: f"SELECT mk, count(*) AS n FROM {P.headed_lines(d, _headed(d, t))} q_ GROUP BY mk", "documents")
dual("t8_resume_units", lambda d, t: f"SELECT doc_id, ord, id, text, section, role, company, dates FROM {R.units(d, _headed(d, t))} q_", "documents")
dual("t9_resume_section", lambda d, t: f"SELECT s_name, {T.resume_section(d, 's_name')} AS section FROM (SELECT DISTINCT concat(CASE c_nationkey % 4 WHEN 0 THEN 'Work History ' WHEN 1 THEN 'Licenses ' WHEN 2 THEN 'Tech Stack ' ELSE 'Project Experience ' END, c_mktsegment) AS s_name FROM {t('customer')}) x_", "customer")
dual("t12_split_skills", lambda d, t: f"SELECT doc_id, part, piece FROM {R.skills_chunks(d, '(SELECT doc_id, concat(CASE doc_id % 2 WHEN 0 THEN ' + d.lit('Stack: ') + ' ELSE ' + d.lit('') + ' END, replace(' + d.sub('text', '\\s+', ' ') + ', ' + d.lit(' ') + ', CASE doc_id % 3 WHEN 0 THEN ' + d.lit(', (') + ' ELSE ' + d.lit('), ') + ' END)) AS line FROM ' + t('documents') + ') x_', 'doc_id', 'line')} q_", "documents")
dual("t15_strip_label", lambda d, t: f"SELECT item_id, {T.strip_label(d, 'text')} AS text FROM (SELECT item_id, concat(CASE item_id % 3 WHEN 0 THEN 'Deep Backend Expertise: ' WHEN 1 THEN 'Bonus: ' ELSE 'Kubernetes: ' END, text) AS text FROM {t('benchmark')}) x_", "benchmark")
dual("t20_generic_only", lambda d, t: f"SELECT p_partkey, {T.is_generic_only(d, 'v')} AS generic FROM (SELECT p_partkey, concat(CASE p_partkey % 3 WHEN 0 THEN 'years of ' WHEN 1 THEN 'Strong experience ' ELSE '5+ ' END, CASE p_partkey % 2 WHEN 0 THEN p_brand ELSE 'skills' END) AS v FROM {t('part')}) x_", "part")
dual("t21_title_words", lambda d, t: f"SELECT doc_id, {d.join(T.title_words(d, 'text'), '|')} AS words FROM {t('documents')}", "documents")
dual("t22_truncate_words", lambda d, t: f"SELECT doc_id, {T.truncate_words(d, 'text', X.SUMMARY_RUNES)} AS summary FROM {t('documents')}", "documents")
dual("t24_split_selection", lambda d, t: f"SELECT p_partkey, pos, v FROM {d.explode('(SELECT p_partkey, replace(p_type, ' + d.lit(' ') + ', ' + d.lit('/') + ') AS sel FROM ' + t('part') + ') x_', 'p_partkey', T.split_slashes(d, 'sel'), 'pos', 'v')} q_", "part")
dual("t25_normalize", lambda d, t: f"SELECT doc_id, {T.normal(d, 'text')} AS norm FROM {t('documents')}", "documents")
dual("t26_content", lambda d, t: f"SELECT doc_id, {d.join(T.content(d, 'text'), ' ')} AS stems FROM {t('documents')}", "documents")
dual("t27_stem", lambda d, t: f"SELECT w, {T.stem(d, 'w')} AS stem FROM (SELECT DISTINCT w FROM {d.explode(_some(d, t), 'doc_id', d.split('lower(text)', ' '), 'pos', 'w')} q_) z_", "documents")
dual("t28_report_cells", lambda d, t: f"SELECT o_orderkey, concat(substr(o_orderpriority, 1, 7), '…') AS clip, replace(o_orderpriority, '-', '\\\\|') AS cell, coalesce(CAST(CAST(round(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice / 1000 END) AS BIGINT) AS STRING), '–') AS fit FROM {t('orders')}" if d.name == "spark" else f"SELECT o_orderkey, concat(substr(o_orderpriority, 1, 7), '…') AS clip, replace(o_orderpriority, '-', '\\|') AS cell, coalesce(CAST(CAST(round(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice / 1000 END) AS BIGINT) AS STRING), '–') AS fit FROM {t('orders')}", "orders")
dual("t29_baseline_reply", lambda d, t: f"SELECT event_id, greatest(0, least(100, CAST(round(CAST({d.json('j', 'n')} AS DOUBLE)) AS BIGINT))) AS score FROM (SELECT event_id, {d.get('r', '(?s)[{].*[}]')} AS j FROM (SELECT event_id, concat({d.lit('Sure: {' + chr(34) + 'n' + chr(34) + ': ')}, CAST(event_id % 150 AS STRING), {d.lit('.5} bye')}) AS r FROM {t('events')}) x_) y_", "events")
dual("t30_judge_norm", lambda d, t: f"SELECT doc_id, {T.judge_normal(d, 'text')} AS norm FROM {t('documents')}", "documents")
dual("t31_redact", lambda d, t: f"SELECT event_id, {T.redact(d, 's')} AS s FROM (SELECT event_id, concat(event_type, ' Bearer tok', CAST(event_id AS STRING), ' sk-abcdefgh', CAST(user_id AS STRING), ' task-list end ', md5(CAST(event_id AS STRING)), ' x', substr(md5(event_type), 1, 20)) AS s FROM {t('events')}) x_", "events")
dual("f2_title_fragment", lambda d, t: f"SELECT p_partkey, {T.is_title_fragment(d, T.title_words(d, 'v'), T.title_words(d, 'ttl'))} AS fragment FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat(p_brand, ' Engineer') WHEN 1 THEN p_brand ELSE concat('Senior ', p_brand, ' engineer') END AS v, concat('Senior ', p_brand, ' Engineer') AS ttl FROM {t('part')}) x_", "part")
dual("m6_trigram_jaccard", lambda d, t: f"SELECT a.grp AS grp, a.id AS a_id, b.id AS b_id, round({T.set_jaccard(d, 'a.g', 'b.g')}, 6) AS j FROM (SELECT grp, id, {T.trigrams(d, 'v')} AS g FROM {phrases(d, t)} a_) a JOIN (SELECT grp, id, {T.trigrams(d, 'v')} AS g FROM {phrases(d, t)} b_) b ON a.grp = b.grp AND a.id < b.id", "lineitem", "part")


# The operators below run inside the row; their checks are relational: windows and joins over exploded words.
def _said(docs: DataFrame) -> DataFrame:
    return C.sentences(docs).select("doc_id", "ord", "text")


def _digest(rows: DataFrame, array: str, item: str) -> DataFrame:
    """One line for each row's array: its length and the md5 of its items in order."""
    return rows.withColumn("n", F.size(array).cast("long")).withColumn("digest", F.md5(F.expr(f"array_join(transform({array}, x -> {item}), '|')")))


def _folded(d, rows: str, keys: str, item: str, order: str) -> str:
    """The same of exploded rows, in SQL."""
    return f"SELECT {keys}, count(*) AS n, md5({d.ordered(item, order, '|')}) AS digest FROM {rows} f_ GROUP BY {keys}"


def _t13(docs: DataFrame) -> DataFrame:
    toks = C.with_tokens(_said(docs), False)
    return _digest(toks, "toks", "concat(x.text, if(x.brk, ';', ''))").select("doc_id", "ord", "n", "digest")


def _t14(docs: DataFrame) -> DataFrame:
    toks = C.with_tokens(_said(docs), True)
    return _digest(toks, "toks", "concat(x.text, if(x.brk, ';', ''))").select("doc_id", "ord", "n", "digest")


def _t17(docs: DataFrame) -> DataFrame:
    found = C.not_empty(C.with_options(C.chunks(_said(docs))), "options")
    return _digest(found, "options", "x").select("doc_id", "ord", "chunk_no", "n", "digest")


def _t18(docs: DataFrame) -> DataFrame:
    found = C.not_empty(C.with_windows(_said(docs), True), "windows")
    return _digest(found, "windows", "x.text").select("doc_id", "ord", "n", "digest")


def _t23(docs: DataFrame) -> DataFrame:
    """Sentences that no strong heading is, closed by a stop, within the limit."""
    rows = C.with_sentences(docs).withColumn("s_", F.expr("transform(filter(sentences, s -> NOT s.strong), s -> if(s.text RLIKE '[.]$', s.text, concat(s.text, '.')))"))
    rows = C.not_empty(rows.select("doc_id", "s_"), "s_").withColumn("s_", F.array_join("s_", " "))
    return rows.select("doc_id", F.expr(T.truncate_words(D, "s_", X.FALLBACK_RUNES)).alias("summary"))


def _w6(docs: DataFrame) -> DataFrame:
    return C.windows(_said(docs), False).groupBy("n").agg(F.count("*").alias("windows"), F.countDistinct("text").alias("texts"))


_MARKED = "CASE WHEN break_after THEN concat(text, ';') ELSE text END"
checked("t2_sentences", C.sentences, lambda d, t: f"SELECT doc_id, ord, ref, text, heading, strong FROM {P.sentences(d, _some(d, t))} q_", "documents")
checked("t13_tokens", _t13, lambda d, t: _folded(d, P.tokens(d, _sentence_source(d, t), "doc_id, ord", False), "doc_id, ord", _MARKED, "tok"), "documents")
checked("t14_tokens_slashes", _t14, lambda d, t: _folded(d, P.tokens(d, _sentence_source(d, t), "doc_id, ord", True), "doc_id, ord", _MARKED, "tok"), "documents")
checked("t16_chunks", lambda docs: C.chunks(_said(docs)), lambda d, t: f"SELECT doc_id, ord, chunk_no, text FROM {P.chunks(d, _sentence_source(d, t), 'doc_id, ord')} q_", "documents")
checked("t17_options", _t17, lambda d, t: _folded(d, P.options(d, _sentence_source(d, t), "doc_id, ord"), "doc_id, ord, chunk_no", "option", "opt_ord"), "documents")
checked("t18_windows", _t18, lambda d, t: _folded(d, P.windows(d, _sentence_source(d, t), "doc_id, ord", True), "doc_id, ord", "text", "start, n"), "documents")
checked("t23_fallback_summary", _t23, lambda d, t: f"SELECT doc_id, {T.truncate_words(d, 's', X.FALLBACK_RUNES)} AS summary FROM (SELECT doc_id, {d.ordered('CASE WHEN ' + d.like('text', '[.]$') + ' THEN text ELSE concat(text, ' + d.lit('.') + ') END', 'ord', ' ')} AS s FROM {P.sentences(d, _some(d, t))} q_ WHERE NOT strong GROUP BY doc_id) y_", "documents")
checked("w6_ngram_frames", _w6, lambda d, t: f"SELECT n, count(*) AS windows, count(DISTINCT text) AS texts FROM {P.windows(d, _sentence_source(d, t), 'doc_id, ord', False)} q_ GROUP BY n", "documents")


def _w7(docs: DataFrame) -> DataFrame:
    """How often "such" parts a clause, as before "as", and how often it doesn't."""
    rows = C.with_tokens(_said(docs), False).withColumn("w", F.expr("transform(toks, t -> lower(t.text))"))
    pairs = F.expr("transform(filter(transform(w, (x, i) -> named_struct('x', x, 'next', coalesce(get(w, i + 1), ''))), p -> p.x IN ('such', 'comme', 'wie', 'como', 'as')), p -> p)")
    each = C.exploded(rows.withColumn("p", pairs).select("doc_id", "p"), "p", "n", "q")
    return each.groupBy(F.col("q.x").alias("w")).agg(F.count("*").alias("n"), F.count(F.when((F.col("q.x") == "such") & (F.col("q.next") == "as"), 1)).alias("parts"))


checked("w7_such_as", _w7, lambda d, t: f"SELECT w, count(*) AS n, count(CASE WHEN w = 'such' AND next_w = 'as' THEN 1 END) AS parts FROM (SELECT lower(text) AS w, lead(lower(text)) OVER (PARTITION BY doc_id, ord ORDER BY tok) AS next_w FROM {P.tokens(d, _sentence_source(d, t), 'doc_id, ord', False)} q_) x_ WHERE w IN ('such', 'comme', 'wie', 'como', 'as') GROUP BY w", "documents")
