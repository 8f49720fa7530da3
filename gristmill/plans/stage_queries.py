"""Whole stages over the driver's tables: documents as postings and resumes, the lexical provider's answers.

The checks are SQL written apart from the operators, where SQL can say it; the extraction and the coverage of whole texts have none and are
pinned by tests/test_stages.py.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import lexicon as X
from gristmill.functions.dialect import DUCK
from gristmill.operators import ask, check, extract
from gristmill.operators import posting as P
from gristmill.operators.prompts import Prompts
from gristmill.plans.catalog import register
from gristmill.plans.dual import table
from gristmill.settings import tuning
from gristmill.sources import loaders, pdf


def _words(text: str) -> list[str]:
    return list(dict.fromkeys(w for w in re.split(r"[\W_]+", text.lower()) if w))


def _listed(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_HELD = "list_distinct(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{Nd}}]+'))"


# PDF text with bullets on lines of their own and headings, put into documents.
def _pdf_text(newline: str) -> str:
    return f"concat('Ann', {newline}, {newline}, CASE doc_id % 4 WHEN 0 THEN 'Work Experience:' WHEN 1 THEN '•' WHEN 2 THEN '●joined' ELSE 'SKILLS' END, {newline}, replace(coalesce(text, ''), '. ', {newline}), {newline}, '▪')"


def s8_pdf_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "documents").select("doc_id", F.expr(_pdf_text("'\\n'")).alias("raw"))
    return raw.select("doc_id", F.md5(pdf.normalise(F.col("raw"))).alias("digest"))


_HEADINGS = ", ".join("'" + h + "'" for h in X.PDF_HEADINGS)
register(
    "s8_pdf_normalise",
    s8_pdf_normalise,
    f"""WITH raw AS (SELECT doc_id, string_split(replace({_pdf_text("chr(10)")}, chr(160), ' '), chr(10)) AS ls FROM documents),
    lines AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos FROM raw),
    kept AS (SELECT doc_id, pos, trim(regexp_replace(l, '[\\r\\t\\f]', ' ', 'g'), ' ') AS l FROM lines),
    marked AS (SELECT doc_id, pos, l, lag(l) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM kept WHERE l <> ''),
    said AS (SELECT doc_id, pos, CASE WHEN regexp_full_match(before, '[{X.BULLETS}]') THEN before || ' ' || l
        WHEN lower(regexp_replace(l, ':$', '')) IN ({_HEADINGS}) THEN '# ' || l WHEN regexp_matches(l, '^[{X.BULLETS}][^ ]') THEN l[1] || ' ' || l[2:] ELSE l END AS s
      FROM marked WHERE NOT regexp_full_match(l, '[{X.BULLETS}]'))
    SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY pos)) AS digest FROM said GROUP BY doc_id""",
)


# Orders as results, with broken rules among them.
_REQS = """SELECT l_orderkey AS posting_id, l_linenumber AS req_ord, concat('req_', CAST(l_linenumber % 6 AS STRING)) AS id, CASE WHEN l_partkey % 17 = 0 THEN ' ' ELSE 'v' END AS value,
    CASE WHEN l_suppkey % 13 = 0 THEN 'none' ELSE concat('s', CAST(l_linenumber % 4 AS STRING)) END AS ref,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'required' WHEN '2' THEN 'required' WHEN '3' THEN 'preferred' WHEN '4' THEN 'mentioned' ELSE 'unknown' END AS tier, l_linenumber * 15 AS percent
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""


def s11_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    reqs = spark.sql(_REQS.format(lineitem="{l}", orders="{o}"), l=table(spark, sf_dir, "lineitem"), o=table(spark, sf_dir, "orders"))
    reqs = reqs.withColumn("refs", F.when(F.col("ref") == "none", F.array().cast("array<string>")).otherwise(F.array("ref"))).withColumn("importance", F.col("percent") / 100)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("posting_id"))
    two = F.struct(F.lit(1).alias("group_ord"), F.lit("alt_1").alias("group_id"), F.array(F.lit("req_1"), F.lit("req_2")).alias("members"))
    one = F.struct(F.lit(2).alias("group_ord"), F.lit("alt_2").alias("group_id"), F.array(F.lit("req_2")).alias("members"))
    groups = orders.select("posting_id", F.explode(F.when(F.col("posting_id") % 5 == 0, F.array(two, one)).otherwise(F.array(two))).alias("g")).select("posting_id", "g.*")
    section = F.when(F.col("posting_id") % 7 == 6, "nowhere").otherwise("required")
    context = orders.select("posting_id", F.explode(F.array(*[F.lit(f"s{i}") for i in range(3)])).alias("ref"), section.alias("section"))
    return loaders.result_violations(reqs, groups, context)


_R = "(" + _REQS.format(lineitem="lineitem", orders="orders").replace(" AS STRING)", " AS VARCHAR)") + ")"
register(
    "s11_violations",
    s11_violations,
    f"""WITH r AS {_R}, g AS (SELECT o_orderkey AS posting_id, 'alt_1' AS gid, unnest(['req_1', 'req_2']) AS m FROM orders UNION ALL SELECT o_orderkey, 'alt_2', 'req_2' FROM orders WHERE o_orderkey % 5 = 0)
    SELECT o_orderkey AS posting_id, 'context s' || i || ': unknown section' AS problem FROM orders, range(3) t(i) WHERE o_orderkey % 7 = 6
    UNION ALL SELECT posting_id, 'requirement ' || id || ': duplicate id' FROM r GROUP BY posting_id, id HAVING count(*) > 1
    UNION ALL SELECT posting_id, 'requirement ' || id || ': empty value' FROM r WHERE value = ' '
    UNION ALL SELECT posting_id, 'requirement ' || id || ': unknown tier' FROM r WHERE tier = 'unknown'
    UNION ALL SELECT posting_id, 'requirement ' || id || ': importance outside [0, 1]' FROM r WHERE percent > 100
    UNION ALL SELECT posting_id, 'requirement ' || id || ': no refs' FROM r WHERE ref = 'none'
    UNION ALL SELECT posting_id, 'requirement ' || id || ': ref s3 not in context' FROM r WHERE ref = 's3'
    UNION ALL SELECT o_orderkey, 'alternative group alt_2: fewer than 2 members' FROM orders WHERE o_orderkey % 5 = 0
    UNION ALL SELECT posting_id, 'alternative group ' || gid || ': unknown member ' || m FROM g WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.posting_id = g.posting_id AND r.id = g.m)
    UNION ALL SELECT o_orderkey, 'requirement req_2: in groups alt_1 and alt_2' FROM orders WHERE o_orderkey % 5 = 0""",
)


def s10_parse_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON results, some of a foreign version, read back as tables."""
    orders = table(spark, sf_dir, "orders")
    need = F.struct(F.concat(F.lit("req_"), F.col("o_custkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("value"), F.array(F.lit("s1")).alias("refs"), F.lit("required").alias("tier"), F.lit(0.5).alias("importance"))
    body = F.struct(F.when(F.col("o_orderkey") % 9 == 0, "0").otherwise("1").alias("schema_version"), F.array(need).alias("requirements"), F.create_map(F.lit("s1"), F.struct(F.col("o_orderstatus").alias("text"), F.lit("required").alias("section"))).alias("context"))
    parsed = loaders.parse_results(orders.select(F.col("o_orderkey").alias("posting_id"), F.when(F.col("o_orderkey") % 11 == 0, "{").otherwise(F.to_json(body)).alias("raw")))
    reqs, _, context = loaders.result_tables(parsed.where("error IS NULL"))
    good = reqs.join(context.select("posting_id", F.col("text").alias("said")), "posting_id").select("posting_id", "id", "value", "said", F.lit(None).cast("string").alias("error"))
    none = F.lit(None).cast("string")
    return good.unionByName(parsed.where("error IS NOT NULL").select("posting_id", none.alias("id"), none.alias("value"), none.alias("said"), "error"))


register(
    "s10_parse_results",
    s10_parse_results,
    """SELECT o_orderkey AS posting_id, 'req_' || o_custkey AS id, o_orderpriority AS value, o_orderstatus AS said, NULL::VARCHAR AS error FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey % 11 <> 0
    UNION ALL SELECT o_orderkey, NULL, NULL, NULL, CASE WHEN o_orderkey % 11 = 0 THEN 'not JSON' ELSE 'schema_version "0", want "1"' END FROM orders WHERE o_orderkey % 9 = 0 OR o_orderkey % 11 = 0""",
)


# The instructions of questions, as JSON.
def t32_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.operators import candidates as C

    asked = Prompts(tuning.load()).section_question(F.concat(F.lit("section_"), F.col("ord").cast("string")), F.col("text"), F.col("heading"))
    q = C.sentences(table(spark, sf_dir, "documents")).select("doc_id", "ord", asked.alias("q"))
    said = lambda k: F.get_json_object("q.instructions", f"$.{k}")
    return q.select("doc_id", F.col("q.id").alias("id"), F.col("q.kind").alias("kind"), F.md5(said("sentence")).alias("sentence"), F.md5(said("heading")).alias("heading"), said("question").alias("question"), F.array_join("q.options", ",").alias("options"))


_SECTION = tuning.DEFAULT["extractor"]["section"]
register(
    "t32_questions",
    t32_questions,
    f"""SELECT doc_id, 'section_' || ord AS id, 'choice' AS kind, md5(text) AS sentence, md5(CASE WHEN heading = '' THEN '(none)' ELSE heading END) AS heading,
    '{_SECTION["question"]}' AS question, '{",".join(_SECTION["options"])}' AS options FROM {P.sentences(DUCK, "(SELECT doc_id, text FROM documents) src_").replace(" AS STRING)", " AS VARCHAR)")} q_""",
)


def t35_gate_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_type"))
    asked = Prompts(tuning.load()).gate_question(F.concat(F.lit("gate_"), F.col("p_partkey").cast("string")), F.col("p_name"), context)
    return table(spark, sf_dir, "part").select(asked.alias("q")).select("q.id", "q.kind", "q.instructions", F.array_join("q.options", ",").alias("options"))


_GATE = tuning.DEFAULT["checker"]["gate"]
register(
    "t35_gate_questions",
    t35_gate_questions,
    f"""SELECT 'gate_' || p_partkey AS id, 'noul' AS kind, '{{"task":"{_GATE["task"]}","requirement":"' || p_name || '"' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ',"job_posting_context":"' || p_type || '"' END || '}}' AS instructions, 'true,false' AS options FROM part""",
)


# Stages with the lexical provider, whose arithmetic SQL can say.
def c2_label_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = extract.prepared(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("posting_id"), "text"))
    rows = extract.label_sections(docs, ask.lexical, Prompts(tuning.load()))
    return rows.select("posting_id", "ord", "section", F.round("confidence", 6).alias("confidence"))


register(
    "c2_label_sections",
    c2_label_sections,
    f"""WITH s AS (SELECT doc_id AS posting_id, ord FROM {P.sentences(DUCK, "(SELECT doc_id, text FROM documents) src_").replace(" AS STRING)", " AS VARCHAR)")} q_),
    w AS (SELECT doc_id AS posting_id, {_HELD.format("text")} AS held FROM documents),
    o AS (SELECT posting_id, list_transform({_listed(_SECTION["options"])}, lambda o: CASE WHEN list_contains(held, o) THEN 4 ELSE 1 END) AS ws FROM w)
    SELECT s.posting_id, s.ord, {_listed(_SECTION["options"])}[list_position(ws, list_max(ws))] AS section, round(list_max(ws)::DOUBLE / list_sum(ws), 6) AS confidence FROM s JOIN o USING (posting_id)""",
)


def c10_holistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as the posting of the next one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where("text IS NOT NULL")
    jobs = extract.prepared(docs.select(F.col("doc_id").alias("posting_id"), "text")).select("posting_id", F.col("text").alias("posting"))
    pairs = jobs.join(docs.select((F.col("doc_id") - 1).alias("posting_id"), F.col("text").alias("resume")), "posting_id")
    rows = check.holistic(pairs, ask.lexical, tuning.load())
    return rows.select("posting_id", *[F.round(c, 6).alias(c) for c in ("role_match", "experience_short", "blocker")], "match_score")


def _c10_sql() -> str:
    h = tuning.DEFAULT["holistic"]
    role, keys = h["role_match"], ["job", "posting", "resume"]

    def share(k: str) -> str:
        ws = _words(h[k]["question"])
        return f"len(list_filter({_listed(ws)}, lambda w: list_contains(held, w)))::DOUBLE / {len(ws)}"

    asked = _listed(_words(role["question"]))
    weights = [f"pow(4, len(list_filter({_listed(_words(o))}, lambda w: list_contains(held, w) OR list_contains({asked}, w))))" for o in role["levels"]]
    base, rm, es = X.MATCH_WEIGHTS
    return f"""WITH p AS (SELECT a.doc_id AS posting_id, list_concat({_HELD.format("a.text || ' ' || b.text")}, {_listed(keys)}) AS held FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.text IS NOT NULL AND b.text IS NOT NULL),
    q AS (SELECT posting_id, ({" + ".join(f"{i} * {w}" for i, w in enumerate(weights))}) / ({" + ".join(weights)}) / {len(weights) - 1} AS rm, {share("experience_short")} AS es, {share("blocker")} AS bl FROM p)
    SELECT posting_id, round(rm, 6) AS role_match, round(es, 6) AS experience_short, round(bl, 6) AS blocker,
      round(greatest(0.0, least(100.0, ({base} + {rm} * rm + {es} * es) * (1 - bl))))::INT AS match_score FROM q"""


register("c10_holistic", c10_holistic, _c10_sql())


def _briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("posting_id"), "text").where("text IS NOT NULL")


def extract_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven stages over the benchmark's passages as postings."""
    return extract.extract(_briefs(spark, sf_dir), ask.lexical, tuning.load()).requirements


def check_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requirements of every passage against the document of the same id as a resume."""
    t = tuning.load()
    e = extract.extract(_briefs(spark, sf_dir), ask.lexical, t)
    resumes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("resume_id"), "text").join(e.requirements.select(F.col("posting_id").alias("resume_id")).distinct(), "resume_id", "left_semi")
    pairs = resumes.select(F.col("resume_id").alias("posting_id"), "resume_id")
    return check.check(pairs, e.requirements, e.groups, e.context, resumes, ask.lexical, t).requirements.drop("evidence")


register("extract_requirements", extract_requirements)
register("check_coverage", check_coverage)
