"""Sources: text, PDF, Parquet and JSON into the engine's tables. All readers are Spark's, so any store works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import lexicon as X
from gristmill.functions import text as T
from gristmill.functions.dialect import SPARK as D
from gristmill.sources import pdf

RESULT = "schema_version string, model string, requirements array<struct<id:string,value:string,refs:array<string>,tier:string,importance:double>>, alternative_groups array<struct<id:string,members:array<string>>>, context map<string,struct<text:string,section:string>>, importance_skipped boolean"
SECTIONS = ("required", "preferred", "responsibilities", "company", "benefits", "other")
TIERS = ("required", "preferred", "mentioned")


def stem(path: Column, suffix: str = "[.][^./]+$") -> Column:
    return F.regexp_extract(path, f"([^/]+){suffix}", 1)


def text_error(text: Column, limit: int = X.TEXT_BYTES) -> Column:
    """Why a text is no input; null if it is one."""
    return F.when(text.isNull(), "missing").when(F.octet_length(text) > limit, "too large").when(~text.rlike("\\S"), "blank")


def read_texts(spark: SparkSession, path: str, id_name: str = "posting_id", limit: int = X.TEXT_BYTES) -> DataFrame:
    """(id, text, error): .txt and .md files whole; the id is the file's stem; blank and too large texts carry an error."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    known = files.where(F.lower("file").rlike("[.](txt|md)$"))
    return known.select(stem(F.col("file")).alias(id_name), "text", text_error(F.col("text"), limit).alias("error"))


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """(posting_id, title, text, error)."""
    rows = read_texts(spark, path)
    return rows.select("posting_id", F.expr(T.title(D, "text")).alias("title"), "text", "error")


def read_resumes(spark: SparkSession, path: str) -> DataFrame:
    """(resume_id, text, error) of .txt, .md and .pdf files."""
    texts = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike("[.](txt|md)$")).select(stem(F.col("path")).alias("resume_id"), F.decode("content", "UTF-8").alias("text"))
    return texts.select("resume_id", "text", text_error(F.col("text")).alias("error")).unionByName(pdf.read_pdfs(spark, path))


def texts(spark: SparkSession, rows: list[tuple[str, str]], id_name: str = "posting_id") -> DataFrame:
    """(id, text, error) of texts that a caller hands over, under the limits of files."""
    frame = spark.createDataFrame(rows, f"{id_name} string, text string")
    return frame.withColumn("error", text_error(F.col("text")))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(posting_id, result, error): extraction results, schema version 1; error: why a file is none."""
    rows = spark.read.text(path, wholetext=True).select(stem(F.input_file_name()).alias("posting_id"), F.col("value").alias("raw"))
    return parse_results(rows)


def parse_results(rows: DataFrame) -> DataFrame:
    """(posting_id, result, error) of rows(posting_id, raw)."""
    out = rows.withColumn("result", F.from_json("raw", RESULT))
    version = F.col("result.schema_version")
    error = F.when(F.octet_length("raw") > X.RESULT_BYTES, "too large").when(F.try_parse_json("raw").isNull(), "not JSON")
    error = error.when(version.isNull() | (version != "1"), F.concat(F.lit('schema_version "'), F.coalesce(version, F.lit("")), F.lit('", want "1"')))
    return out.select("posting_id", "result", error.alias("error"))


def result_tables(results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requirements, groups, context) of results(posting_id, result), in the order of the file."""
    reqs = results.select("posting_id", F.posexplode("result.requirements").alias("n", "r")).select("posting_id", (F.col("n") + 1).alias("req_ord"), "r.*")
    groups = results.select("posting_id", F.posexplode("result.alternative_groups").alias("n", "g")).select("posting_id", (F.col("n") + 1).alias("group_ord"), F.col("g.id").alias("group_id"), "g.members")
    context = results.select("posting_id", F.explode("result.context").alias("ref", "s")).select("posting_id", "ref", "s.text", "s.section")
    return reqs, groups, context


def result_violations(requirements: DataFrame, groups: DataFrame, context: DataFrame) -> DataFrame:
    """(posting_id, problem): every rule that a result breaks.

    Unique ids, values that say something, known tiers and sections, importance in [0, 1], references that exist, groups of two or more
    known members, and one group a requirement.
    """
    says = lambda rows, when, *parts: rows.where(when).select("posting_id", F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]).alias("problem"))
    id_ = F.coalesce("id", F.lit(""))
    group_id = F.coalesce("group_id", F.lit(""))
    refs = requirements.select("posting_id", "id", F.explode("refs").alias("ref"))
    members = groups.select("posting_id", "group_ord", "group_id", F.explode("members").alias("id"))
    many = members.groupBy("posting_id", "id").agg(F.array_sort(F.collect_list(F.struct("group_ord", "group_id"))).alias("g"))
    found = [
        says(context, ~F.coalesce(F.col("section").isin(*SECTIONS), F.lit(False)), "context ", F.col("ref"), ": unknown section"),
        says(requirements, id_ == "", "requirement ", (F.col("req_ord") - 1).cast("string"), ": empty id"),
        says(requirements.where(id_ != "").groupBy("posting_id", "id").count(), F.col("count") > 1, "requirement ", F.col("id"), ": duplicate id"),
        says(requirements, ~F.coalesce(F.col("value").rlike("\\S"), F.lit(False)), "requirement ", id_, ": empty value"),
        says(requirements, ~F.coalesce(F.col("tier").isin(*TIERS), F.lit(False)), "requirement ", id_, ": unknown tier"),
        says(requirements, ~F.coalesce(F.col("importance").between(0, 1), F.lit(False)), "requirement ", id_, ": importance outside [0, 1]"),
        says(requirements, F.coalesce(F.size("refs"), F.lit(0)) <= 0, "requirement ", id_, ": no refs"),
        says(refs.join(context.select("posting_id", "ref"), ["posting_id", "ref"], "left_anti"), F.lit(True), "requirement ", id_, ": ref ", F.col("ref"), " not in context"),
        says(groups, group_id == "", "alternative group ", (F.col("group_ord") - 1).cast("string"), ": empty id"),
        says(groups.where(group_id != "").groupBy("posting_id", "group_id").count(), F.col("count") > 1, "alternative group ", F.col("group_id"), ": duplicate id"),
        says(groups, F.coalesce(F.size("members"), F.lit(0)) < 2, "alternative group ", group_id, ": fewer than 2 members"),
        says(members.join(requirements.select("posting_id", "id"), ["posting_id", "id"], "left_anti"), F.lit(True), "alternative group ", group_id, ": unknown member ", F.col("id")),
        says(many, F.size("g") > 1, "requirement ", F.col("id"), ": in groups ", F.array_join(F.transform("g", lambda x: x["group_id"]), " and ")),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


EXPECTED = "requirements array<struct<value: string, aliases: array<string>, tier: string>>, alternative_groups array<array<string>>, acceptable array<string>, filler array<string>, notes string"


def read_labels(spark: SparkSession, path: str, only: tuple[str, ...] = ()) -> DataFrame:
    """(fixture_id, requirements, alternative_groups, acceptable, filler) from <id>.expected.json files; only: prefixes of ids."""
    rows = spark.read.schema(EXPECTED).json(f"{path}/*.expected.json", multiLine=True)
    return with_prefix(rows.withColumn("fixture_id", stem(F.input_file_name(), "[.]expected[.]json$")), "fixture_id", only)


def with_prefix(rows: DataFrame, id_name: str, only: tuple[str, ...]) -> DataFrame:
    """The rows whose id starts with one of the prefixes; all without any."""
    if not only:
        return rows
    keep = F.lit(False)
    for prefix in only:
        keep = keep | F.startswith(F.col(id_name), F.lit(prefix))
    return rows.where(keep)


def read_golden(spark: SparkSession, path: str, only: tuple[str, ...] = ()) -> DataFrame:
    """Labels with title and text: <id>.expected.json beside <id>.txt."""
    texts = read_texts(spark, f"{path}/*.txt", "fixture_id").select("fixture_id", F.expr(T.title(D, "text")).alias("title"), "text")
    return read_labels(spark, path, only).join(texts, "fixture_id")


def expected(labels: DataFrame) -> DataFrame:
    """(fixture_id, exp_ord, value, aliases, tier): a row for each labelled requirement, in order."""
    rows = labels.select("fixture_id", F.posexplode("requirements").alias("exp_ord", "r"))
    return rows.select("fixture_id", "exp_ord", "r.value", "r.aliases", "r.tier")


def read_checker_golden(spark: SparkSession, path: str, golden: str, resumes: str, only: tuple[str, ...] = ()) -> DataFrame:
    """(pair_id, job, resume, skip, links, title, posting, resume_text): labels with the posting and the resume they name; an unknown name fails."""
    schema = "job string, resume string, skip array<string>, links map<string,array<struct<quote:string,strength:string>>>, notes string"
    rows = spark.read.schema(schema).json(f"{path}/*.expected.json", multiLine=True).withColumn("pair_id", stem(F.input_file_name(), "[.]expected[.]json$"))
    jobs = read_golden(spark, golden).select(F.col("fixture_id").alias("job"), "title", F.col("text").alias("posting"))
    people = read_texts(spark, f"{resumes}/*.md", "resume").select("resume", F.col("text").alias("resume_text"))
    out = with_prefix(rows, "pair_id", only).join(jobs, "job", "left").join(people, "resume", "left")
    must = lambda c, what, name: F.coalesce(c, F.raise_error(F.concat(F.lit(f"unknown {what} "), F.col(name))).cast("string"))
    return out.select("pair_id", "job", "resume", "skip", "links", "title", must(F.col("posting"), "job", "job").alias("posting"), must(F.col("resume_text"), "resume", "resume").alias("resume_text"))


def labelled_links(golden: DataFrame) -> DataFrame:
    """(pair_id, value, quote, strength)."""
    rows = golden.select("pair_id", F.explode("links").alias("value", "l")).select("pair_id", "value", F.explode("l").alias("x"))
    return rows.select("pair_id", "value", "x.quote", "x.strength")


def read_pairs(spark: SparkSession, path: str, root: str, which: str = "subset", only: tuple[str, ...] = ()) -> DataFrame:
    """(pair_id, title, posting, resume_id, resume, reference, saved) of pairs.json and current.json in path; resumes lie below root.

    which: subset, current or all. A pair of the subset without a current score fails.
    """
    if which not in ("subset", "current", "all"):
        raise ValueError(f"set {which!r}: want subset, current or all")
    pair = "pairs array<struct<id:string,title:string,resume:string,jd:string,score:int,subset:boolean>>"
    pairs = spark.read.schema(pair).json(f"{path}/pairs.json", multiLine=True).select(F.explode("pairs").alias("p")).select("p.*")
    current = spark.read.schema("pairs array<struct<pair:string,score:double>>").json(f"{path}/current.json", multiLine=True).select(F.explode("pairs").alias("p")).select(F.col("p.pair").alias("id"), F.col("p.score").alias("reference"))
    rows = with_prefix(pairs.join(current, "id", "left"), "id", only)
    if which == "current":
        rows = rows.where("reference IS NOT NULL")
    if which == "subset":
        rows = rows.where("subset").withColumn("reference", F.coalesce("reference", F.raise_error(F.concat(F.lit("subset pair without a current score: "), F.col("id"))).cast("double")))
    whole = lambda at, name: spark.read.text(at, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("file"), F.col("value").alias(name))
    jobs, people = whole(path, "posting"), whole(root, "resume")
    rows = rows.withColumnRenamed("resume", "resume_path")
    out = rows.join(jobs, F.endswith("file", F.concat(F.lit("/"), F.col("jd")))).drop("file").join(people, F.endswith("file", F.concat(F.lit("/"), F.col("resume_path"))))
    return out.select(F.col("id").alias("pair_id"), "title", "posting", F.col("resume_path").alias("resume_id"), "resume", "reference", F.col("score").alias("saved"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def read_traces(spark: SparkSession, report: str) -> DataFrame:
    """(fixture_id, trace): the JSON files beside a report, by stem; none without that folder."""
    from pyspark.errors import AnalysisException

    folder = report.removesuffix(".json") + "-traces"
    try:
        rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json")
    except AnalysisException:
        return spark.createDataFrame([], "fixture_id string, trace string")
    return rows.select(stem(F.input_file_name()).alias("fixture_id"), F.col("value").alias("trace"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(report, pair, title, reference, match, fit, error, role_match, experience_short, blocker) of end-to-end reports."""
    schema = "pairs array<struct<id: string, title: string, reference: double, match: long, fit: long, error: string, holistic: struct<model: string, role_match: double, experience_short: double, blocker: double>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.input_file_name().alias("report"), F.explode("pairs").alias("p"))
    return rows.select("report", F.col("p.id").alias("pair"), "p.title", "p.reference", "p.match", "p.fit", "p.error", "p.holistic.role_match", "p.holistic.experience_short", "p.holistic.blocker")


def fit_rows(report: DataFrame) -> DataFrame:
    """(pair, n, reference, fit, role_match, experience_short, blocker): means per pair over reports; rows with an error or without reference, fit or answers go."""
    good = report.where(F.coalesce(F.col("error") == "", F.lit(True)) & F.col("reference").isNotNull() & F.col("fit").isNotNull() & F.coalesce("role_match", "experience_short", "blocker").isNotNull())
    mean = lambda c: F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c)
    return good.groupBy("pair").agg(F.count("*").alias("n"), *[mean(c) for c in ("reference", "fit", "role_match", "experience_short", "blocker")])


def probe_rows(rows: DataFrame, probes: DataFrame, levels: dict[str, int]) -> DataFrame:
    """rows with the holistic answers of probes(pair, question, score, noul) instead: means per pair, scores as shares of their top level.

    levels: question to its number of levels. A question that isn't probed is null; its column stays.
    """
    count = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv]) if levels else F.create_map().cast("map<string,int>")
    share = F.coalesce(F.col("noul"), F.col("score") / (F.try_element_at(count, F.col("question")) - 1))
    asked = ("role_match", "experience_short", "blocker")
    means = probes.groupBy("pair").agg(*[F.avg(F.when(F.col("question") == q, share)).alias(q) for q in asked])
    return rows.drop(*asked).join(means, "pair")


def probe_pairs(pairs: DataFrame, current: DataFrame, final: DataFrame) -> DataFrame:
    """(pool, pair_id): subset pairs that have a current score, and all pairs of the final set."""
    subset = pairs.where("subset").join(current.select("pair_id"), "pair_id", "left_semi").select(F.lit("subset").alias("pool"), "pair_id")
    return subset.unionByName(final.select(F.lit("final").alias("pool"), "pair_id"))
