"""Line deduplication by distinct-site spread.

A line that stands on many sites is boilerplate. HyperLogLog sketches of the sites
are built per line hash and merge by aggregation (partial sketches before the
shuffle, so a line that a third of all documents hold costs one sketch a task).
Lines whose estimate lies near the threshold get an exact distinct count, so the
sketch error never decides. DataFrame functions only.

Defined results: a null text stays null and counts no lines; blank lines are never
boilerplate; a null site counts as one site of its own; repeated lines in one
document count its site once and all go; ties (exactly min_sites) go; rows with null or repeated ids
lose their own text's lines; an empty table gives an empty result; all other columns pass through, and the
count's name has underscores added if docs has it. A text whose lines all go becomes the empty text: the document stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import free_name

#: Lines on this many sites or more are boilerplate.
MIN_SITES = 12
#: log2 of the sketch's registers: 1.6 % standard error at 4,096.
LG_K = 12
#: Estimates within this share of the threshold are counted exactly: over six standard errors.
NEAR = 0.25
#: Tasks that the places of one line are dealt to.
SALTS = 32


def _key(line: Column) -> Column:
    """96 bits of hash, so that lines of a 100 TB corpus don't collide."""
    return F.struct(F.xxhash64(line).alias("h"), F.hash(line).alias("g"))


def _row_key(id_col: str, text_col: str) -> Column:
    """Rows that share it have the same id and text, and so lose the same lines."""
    parts = F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    return F.struct(F.xxhash64(*parts).alias("h"), F.hash(*parts).alias("g"))


def lines_of(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(doc, pos, site, key) of every line that isn't blank; the text itself isn't carried on."""
    site = F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site")
    exploded = docs.select(_row_key(id_col, text_col).alias("doc"), site, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    return exploded.where(F.trim("line") != "").select("doc", "pos", "site", _key(F.col("line")).alias("key"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, near: float = NEAR) -> DataFrame:
    """(key, sites) of the lines on min_sites sites or more."""
    spread = lines.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"), F.count("*").alias("n"))
    spread = spread.where((F.col("n") >= min_sites) & (F.col("sites") >= min_sites * (1 - near)))
    clear = spread.where(F.col("sites") > min_sites * (1 + near)).select("key", F.col("sites").cast("long").alias("sites"))
    close = spread.where(F.col("sites") <= min_sites * (1 + near)).select("key")
    exact = _among(lines, close).groupBy("key").agg(F.countDistinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    return clear.unionByName(exact)


def _among(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """The lines with one of the keys. Each key stands SALTS times, so a line that all documents hold goes to as many tasks."""
    salted = keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.col("doc.g") + F.col("pos"), F.lit(SALTS))
    return lines.withColumn("salt", salt).join(salted, ["key", "salt"], "left_semi").drop("salt")


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """The rows and columns of docs with boilerplate lines cut from the text, and the count `lines_removed`."""
    lines = lines_of(docs, id_col, text_col, site_col)
    marked = _among(lines, boilerplate(lines, min_sites)).groupBy(F.col("doc").alias("__ls_doc")).agg(F.array_sort(F.collect_set("pos")).alias("__ls_cut"))
    joined = docs.withColumn("__ls_doc", _row_key(id_col, text_col)).join(marked, "__ls_doc", "left")
    # the lines between the cuts, joined; `array(...)` and `[0]` name the split text, so that it is split once
    rest = F.expr(f"""transform(array(split(`{text_col}`, '\\n')), ls -> array_join(flatten(transform(concat(array(-1), __ls_cut),
        (x, i) -> slice(ls, x + 2, coalesce(get(__ls_cut, i), size(ls)) - x - 1))), '\\n'))[0]""")
    kept = [F.when(F.col("__ls_cut").isNull(), F.col(c)).otherwise(rest).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*kept, F.coalesce(F.size("__ls_cut"), F.lit(0)).cast("long").alias(free_name("lines_removed", docs.columns)))


def digest(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_chars, kept_md5): what remove_boilerplate left of each text."""
    full = docs.select("doc_id", "text", "source", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    out = remove_boilerplate(full, min_sites=min_sites)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", F.col("lines_removed").alias("n_removed"), F.length(text).cast("long").alias("kept_chars"), F.md5(text).alias("kept_md5"))


def lines_sql(docs: str, min_sites: int = MIN_SITES) -> str:
    """DuckDB text of the same removal: a relation with the columns of `docs`, and lines_removed."""
    return f"""
    (WITH docs AS (SELECT * FROM {docs}),
    parts AS (SELECT doc_id, text, coalesce(source, '') AS site, string_split(text, chr(10)) AS ls FROM docs WHERE text IS NOT NULL),
    lines AS (SELECT doc_id, text, site, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM parts),
    spread AS (SELECT line FROM lines WHERE trim(line, ' ') <> '' GROUP BY line HAVING count(DISTINCT site) >= {min_sites}),
    kept AS (
      SELECT l.doc_id, l.text, count(s.line) AS cut,
             coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE s.line IS NULL), '') AS rest
      FROM (SELECT DISTINCT doc_id, text, line, pos FROM lines) l LEFT JOIN spread s ON l.line = s.line GROUP BY l.doc_id, l.text)
    SELECT d.* REPLACE (CASE WHEN d.text IS NULL THEN NULL ELSE k.rest END AS text), coalesce(k.cut, 0)::BIGINT AS lines_removed
    FROM docs d LEFT JOIN kept k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.text = k.text)"""


def digest_sql(min_sites: int = MIN_SITES) -> str:
    full = "(SELECT doc_id, text, source, len(string_split(coalesce(text, ''), chr(10)))::BIGINT AS n_lines FROM documents)"
    return f"""
    SELECT doc_id, n_lines, lines_removed AS n_removed, length(coalesce(text, ''))::BIGINT AS kept_chars, md5(coalesce(text, '')) AS kept_md5
    FROM {lines_sql(full, min_sites)} c"""
