import json

import pytest
from pyspark.sql import functions as F

from gristmill.operators import ask, check, extract
from gristmill.operators.prompts import KEEP, Prompts
from gristmill.settings import tuning
from gristmill.settings.config import Settings

POSTING = """Senior Data Engineer
### Full Job Description

# Requirements
- Python and SQL required
- Kafka or Pulsar
- Terraform/Terragrunt experience
# Nice to have
Kubernetes preferred.
# Benefits
- Free lunch, dental insurance
"""
RESUME = """Ann Lee
# Experience
## Data Engineer | Acme | 2019 - 2023
- Built Python pipelines on Kafka
- Wrote SQL reports
# Skills
Terraform, Kubernetes, Excel
"""


def scripted(requests):
    """Answers by plain rules, so that every decision of the stages is known."""
    base = ask.lexical(requests)
    rule = """
    transform(questions, q -> transform(array(get_json_object(q.instructions, '$.requirement')), r -> CASE
      WHEN q.id LIKE 'section_%' THEN named_struct('pick', CASE WHEN get_json_object(q.instructions, '$.heading') = 'Requirements' THEN 'required' WHEN get_json_object(q.instructions, '$.heading') = 'Nice to have' THEN 'preferred'
          WHEN get_json_object(q.instructions, '$.heading') = 'Benefits' THEN 'benefits' ELSE 'other' END, 'p', 0.9D, 'n', NULL, 's', NULL)
      WHEN q.id LIKE 'chunk_%' THEN named_struct('pick', CASE WHEN get_json_object(q.instructions, '$.chunk') = 'Python' THEN 'Python' WHEN get_json_object(q.instructions, '$.chunk') LIKE 'SQL%' THEN 'SQL' WHEN get_json_object(q.instructions, '$.chunk') LIKE 'Terraform%' THEN 'Terraform/Terragrunt'
          WHEN get_json_object(q.instructions, '$.chunk') LIKE 'Kubernetes%' THEN 'Kubernetes' WHEN get_json_object(q.instructions, '$.chunk') IN ('Kafka', 'Pulsar') THEN get_json_object(q.instructions, '$.chunk') ELSE 'trait' END, 'p', 0.8D, 'n', NULL, 's', NULL)
      WHEN q.id LIKE 'filler_%' THEN named_struct('pick', if(r[0] = 'SQL' AND false, 'vague', 'specific_requirement'), 'p', 0.9D, 'n', NULL, 's', NULL)
      WHEN q.id LIKE 'dup_%' THEN named_struct('pick', CASE r[0] WHEN 'Terraform' THEN 'Terragrunt' WHEN 'Terragrunt' THEN 'Terraform' ELSE 'different' END, 'p', 0.9D, 'n', NULL, 's', NULL)
      WHEN q.id LIKE 'alt_%' THEN named_struct('pick', if(r[0] = 'Kafka', 'Pulsar', 'together'), 'p', 0.9D, 'n', NULL, 's', NULL)
      WHEN q.id LIKE 'importance_%' THEN named_struct('pick', NULL, 'p', 0D, 'n', NULL, 's', if(r[0] = 'SQL', 4D, 3D))
      WHEN q.id = 'retrieval' THEN named_struct('pick', coalesce(filter(q.options, o -> contains(lower(state), lower(o)))[0], 'none'), 'p', 0.6D, 'n', NULL, 's', NULL)
      WHEN q.id LIKE 'gate_%' THEN named_struct('pick', NULL, 'p', 0D, 'n', if(contains(lower(state), lower(r[0])), 0.9D, 0.1D), 's', NULL)
      ELSE named_struct('pick', 'strong', 'p', 0.9D, 'n', NULL, 's', NULL) END)[0])""".replace("r[0]", "r")
    rest = """transform(arrays_zip(questions, picks), x -> named_struct('id', x.questions.id, 'choice', x.picks.pick,
      'probs', if(x.picks.pick IS NULL, NULL, map_from_arrays(x.questions.options, transform(x.questions.options, o -> if(o = x.picks.pick, x.picks.p, (1 - x.picks.p) / greatest(1, size(x.questions.options) - 1))))),
      'noul', x.picks.n, 'score', x.picks.s, 'confidence', CAST(NULL AS DOUBLE)))"""
    return base.drop("answers").withColumn("picks", F.expr(rule)).withColumn("answers", F.expr(rest).cast(f"array<{ask.ANSWER}>")).drop("picks")


@pytest.fixture(scope="module")
def extraction(spark):
    postings = spark.createDataFrame([("p1", POSTING), ("p2", "Title\nSkills:\nPython")], "posting_id string, text string")
    return extract.extract(postings, scripted, tuning.load())


def test_extract(extraction):
    rows = [(r.id, r.value, r.refs, r.tier, r.importance) for r in extraction.requirements.where("posting_id = 'p1'").orderBy("req_ord").collect()]
    assert [(v, t, i) for _, v, _, t, i in rows] == [("SQL", "required", 1.0), ("Python", "required", 0.75), ("Kafka", "required", 0.75), ("Pulsar", "required", 0.75), ("Terraform", "required", 0.75), ("Kubernetes", "preferred", 0.75)]
    assert [(g.group_id, g.members) for g in extraction.groups.collect()] == [("alt_1", ["req_3", "req_4"])]
    assert {r.section for r in extraction.context.collect()} == {"required", "preferred"}
    labelled = {r.text: (r.section, r.strong) for r in extraction.labelled.where("posting_id = 'p1'").collect()}
    assert labelled["Requirements"][1] and labelled["Free lunch, dental insurance"][0] == "benefits"
    result = json.loads(extract.result_json(extraction).where("posting_id = 'p1'").first().result)
    assert result["schema_version"] == "1" and result["requirements"][0]["value"] == "SQL" and result["context"]["s3"]["section"] == "required"
    empty = json.loads(extract.result_json(extraction).where("posting_id = 'p2'").first().result)
    assert empty["requirements"] == [] and empty["alternative_groups"] == [] and empty["context"] == {}


def test_check(spark, extraction):
    resumes = spark.createDataFrame([("r1", RESUME)], "resume_id string, text string")
    pairs = spark.createDataFrame([("p1", "r1")], "posting_id string, resume_id string")
    only = lambda df: df.where("posting_id = 'p1'")
    got = check.check(pairs, only(extraction.requirements), only(extraction.groups), only(extraction.context), resumes, scripted, tuning.load())
    coverage = {r.value: (r.coverage, [e.unit for e in r.evidence]) for r in got.requirements.collect()}
    # Python and Kafka share a unit; the first option of the retrieval wins it most mass, the others stay above the floor
    assert coverage["Python"] == ("strong", ["e1"]) and coverage["SQL"] == ("strong", ["e2"]) and coverage["Kafka"][0] == "strong"
    assert coverage["Terraform"] == ("weak", ["e3"]) and coverage["Kubernetes"] == ("weak", ["e3"]) and coverage["Pulsar"] == ("none", [])
    assert got.groups.first().coverage == "strong"
    fit = got.fit.first()
    assert fit.score == round(100 * (3 + 3 + 3 + 3 * 0.3 + 1.5 * 0.3) / (3 * 4 + 1.5)) and fit.gaps == [] and fit.by_tier == {"required": 83, "preferred": 30}  # halves away from zero
    judged = {(r.unit_id, r.value): r for r in got.judged.collect()}
    assert judged["e3", "Kubernetes"].linked and judged["e3", "Kubernetes"].mass == 0.9 and not judged["e3", "Python"].linked and judged["e3", "Python"].reason == "gate"
    body = json.loads(check.coverage_json(got).first().coverage)
    assert body["fit"]["score"] == fit.score and set(body["evidence_units"]) == {"e1", "e2", "e3"} and body["requirements"][0]["evidence"]
    kept, groups = check.without_mentioned(only(extraction.requirements).withColumn("tier", F.when(F.col("value") == "Pulsar", "mentioned").otherwise(F.col("tier"))), only(extraction.groups))
    assert kept.count() == 5 and groups.count() == 0


def test_narrowing_and_options(spark):
    reqs = spark.createDataFrame([("p", 1, "req_1", "Go", ["s1", "s2"], "required"), ("p", 2, "req_2", "go", ["s1"], "required"), ("p", 3, "req_3", "None", ["s9"], "mentioned")], "posting_id string, req_ord int, id string, value string, refs array<string>, tier string")
    context = spark.createDataFrame([("p", "s1", "a longer sentence"), ("p", "s2", "short")], "posting_id string, ref string, text string")
    rows = {r.id: (r.option, r.context) for r in check.check_requirements(reqs, context).collect()}
    assert rows == {"req_1": ("Go", "short"), "req_2": ("go (req_2)", "a longer sentence"), "req_3": ("None (req_3)", "")}
    options = [f"o{i:02}" for i in range(30)]
    unit = spark.createDataFrame([("p", "r", (1, "e1", "o05 o07 stand here", "experience", "", "", ""))], "posting_id string, resume_id string, unit struct<ord:long,id:string,text:string,section:string,role:string,company:string,dates:string>")
    offers = spark.createDataFrame([("p", options, dict.fromkeys(options, ""))], "posting_id string, options array<string>, contexts map<string,string>")
    asked = []

    def provider(requests):
        asked.append(requests.select(F.size(F.col("questions")[0]["options"]).alias("n")).collect())
        return ask.lexical(requests)

    from gristmill.operators.prompts import Prompts

    got = check.retrieve(unit, offers, provider, Prompts(tuning.load()), Settings()).first().retrieved
    assert got[:2] == ["o05", "o07"] and len(got) == 8 and [n[0].n for n in asked] == [31, 17]
    alone = offers.withColumn("options", F.slice("options", 6, 1))
    assert check.retrieve(unit, alone, ask.lexical, Prompts(tuning.load()), Settings()).first().retrieved == ["o05"]
    # a round's places point into the posting's options, and the next round's into the same
    twice = check.retrieve(unit, offers, ask.lexical, Prompts(tuning.load()), Settings(narrow_sizes=(20, 4), retrieval_k=3)).first().retrieved
    assert twice == ["o05", "o07", "o00"]


def test_holistic(spark):
    pairs = spark.createDataFrame([("p1", "r1", POSTING, RESUME)], "posting_id string, resume_id string, posting string, resume string")

    def provider(requests):
        said = "array(named_struct('id', 'role_match', 'choice', NULL, 'probs', NULL, 'noul', NULL, 'score', 3.95D, 'confidence', NULL), named_struct('id', 'experience_short', 'choice', NULL, 'probs', NULL, 'noul', 0.13D, 'score', NULL, 'confidence', NULL), named_struct('id', 'blocker', 'choice', NULL, 'probs', NULL, 'noul', 0.05D, 'score', NULL, 'confidence', NULL))"
        return ask.with_key(requests).withColumn("answers", F.expr(said).cast(f"array<{ask.ANSWER}>"))

    row = check.holistic(pairs, provider, tuning.load())
    assert row.first().match_score == 87
    assert json.loads(check.match_json(row, tuning.load()).first().match)["signals"]["role_match"] == pytest.approx(0.9875)
    with pytest.raises(Exception, match="no score answer"):
        check.holistic(pairs, lambda r: ask.with_key(r).withColumn("answers", F.expr("array()").cast(f"array<{ask.ANSWER}>")), tuning.load()).collect()


def test_summaries_and_unknown_sections(spark):
    docs = extract.prepared(spark.createDataFrame([("p1", POSTING)], "posting_id string, text string"))
    from gristmill.operators.prompts import Prompts

    labelled = extract.label_sections(docs, scripted, Prompts(tuning.load()))
    row = extract.job_summary(docs, labelled).first()
    assert row.fallback and row.summary.startswith("Senior Data Engineer. Requirements. Python and SQL required. Kafka or Pulsar.")
    said = extract.job_summary(docs, labelled, lambda d: d.select("posting_id", F.lit(" An engineer. ").alias("said"))).first()
    assert said.summary == "An engineer." and not said.fallback
    assert extract.job_summary(docs, labelled, lambda d: d.select("posting_id", F.lit(None).cast("string").alias("said"))).first().fallback

    def wrong(requests):
        return ask.lexical(requests).withColumn("answers", F.transform("answers", lambda a: a.withField("choice", F.lit("nowhere"))))

    with pytest.raises(Exception, match="unknown section nowhere"):
        extract.label_sections(docs, wrong, Prompts(tuning.load())).collect()


def _poisoned(provider, word, change):
    """The provider, but requests with the word have their answers changed."""

    def ask_(requests):
        out = provider(requests)
        return out.withColumn("answers", F.when(F.col("state").contains(word), change(F.col("answers"))).otherwise(F.col("answers")))

    return ask_


NOWHERE = lambda answers: F.transform(answers, lambda a: a.withField("choice", F.when(a["choice"].isNotNull(), F.lit("nowhere"))).withField("score", F.when(a["score"].isNotNull(), F.lit(99.0))))


def test_one_poisoned_answer_loses_one_posting(spark):
    rows = [(f"p{i:03}", f"Title {i}\n# Requirements\n- Python and SQL required" + ("\nzyzzyva" if i == 42 else "")) for i in range(100)]
    postings = spark.createDataFrame(rows, "posting_id string, text string")
    e = extract.extract(postings, _poisoned(scripted, "zyzzyva", NOWHERE), tuning.load(), strict=False)
    assert {r.posting_id for r in e.requirements.collect()} == {p for p, _ in rows} - {"p042"}
    (lost,) = e.failures.collect()
    assert (lost.posting_id, lost.stage) == ("p042", "sections") and "unknown section nowhere" in lost.error
    results = {r.posting_id for r in extract.result_json(e).collect()}
    assert len(results) == 99 and "p042" not in results
    with pytest.raises(Exception, match="unknown section nowhere"):
        extract.extract(postings, _poisoned(scripted, "zyzzyva", NOWHERE), tuning.load()).requirements.collect()


@pytest.mark.parametrize("id, stage", [("section_", "sections"), ("chunk_", "validation"), ("importance_", "refinement")])
def test_every_stage_of_extraction_notes_its_failures(spark, id, stage):
    postings = spark.createDataFrame([("bad", POSTING), ("good", POSTING.replace("Senior", "Junior"))], "posting_id string, text string")
    wrong = lambda answers: F.when(F.exists(answers, lambda a: a["id"].startswith(id)), NOWHERE(answers)).otherwise(answers)
    e = extract.extract(postings, _poisoned(scripted, "Senior Data", wrong), tuning.load(), strict=False)
    assert [(r.posting_id, r.stage) for r in e.failures.collect()] == [("bad", stage)]
    assert {r.posting_id for r in e.requirements.collect()} == {r.posting_id for r in e.labelled.collect()} == {"good"}


@pytest.mark.parametrize("id, stage", [("retrieval", "retrieval"), ("gate_", "gate"), ("req_", "req")])
def test_every_stage_of_checking_notes_its_failures(spark, extraction, id, stage):
    resumes = spark.createDataFrame([("bad", RESUME.replace("Ann", "Zyzzy")), ("good", RESUME)], "resume_id string, text string").withColumn("text", F.when(F.col("resume_id") == "bad", F.concat("text", F.lit("- zyzzyva Python\n"))).otherwise(F.col("text")))
    pairs = spark.createDataFrame([("p1", "bad"), ("p1", "good")], "posting_id string, resume_id string")
    wrong = lambda answers: F.when(F.exists(answers, lambda a: a["id"].startswith(id)), F.transform(NOWHERE(answers), lambda a: a.withField("noul", F.when(a["noul"].isNotNull(), F.lit(7.0))))).otherwise(answers)
    only = lambda df: df.where("posting_id = 'p1'")
    c = check.check(pairs, only(extraction.requirements), only(extraction.groups), only(extraction.context), resumes, _poisoned(scripted, "zyzzyva", wrong), tuning.load(), Settings(skip_capped_grading=False, gate_first=False), strict=False)
    assert [(r.resume_id, r.stage) for r in c.failures.collect()] == [("bad", stage)]
    assert {r.resume_id for r in c.fit.collect()} == {r.resume_id for r in c.requirements.collect()} == {"good"}
    assert {r.resume_id for r in check.coverage_json(c).collect()} == {"good"}


def test_holistic_errors_stay_in_the_row(spark):
    pairs = spark.createDataFrame([("a", POSTING, RESUME), ("b", POSTING, RESUME + "zyzzyva")], "pair_id string, posting string, resume string")
    rows = {r.pair_id: r for r in check.holistic(pairs, _poisoned(ask.lexical, "zyzzyva", lambda a: F.filter(a, lambda x: x["id"] != "blocker")), tuning.load(), strict=False).collect()}
    assert rows["a"].error is None and rows["a"].match_score is not None
    assert rows["b"].error == "blocker: no noul answer" and rows["b"].match_score is None


def test_keep_is_fixed():
    assert KEEP == "specific_requirement"


def test_retrieval_writes_what_a_round_takes_and_no_answers(spark, monkeypatch):
    names = [f"o{i:02d}" for i in range(30)]
    said = F.map_from_arrays(F.array(*[F.lit(o) for o in reversed(names[:20])], F.lit("none")), F.array(*[F.lit(0.01 * (i // 2)) for i in range(20)], F.lit(0.1)))
    answer = F.struct(F.lit("retrieval").alias("id"), F.lit("none").alias("choice"), said.alias("probs"), *[F.lit(None).cast("double").alias(c) for c in ("noul", "score", "confidence")])
    narrowed = F.transform("questions", lambda q: F.struct(*[F.map_filter(answer["probs"], lambda k, _: F.array_contains(q["options"], k)).alias(c) if c == "probs" else answer[c].alias(c) for c in ("id", "choice", "probs", "noul", "score", "confidence")]))
    unit = spark.createDataFrame([("p", "r", (1, "e1", "x", "experience", "", "", ""))], "posting_id string, resume_id string, unit struct<ord:long,id:string,text:string,section:string,role:string,company:string,dates:string>")
    offers = check.retrieval_space(spark.createDataFrame([("p", i, o, "") for i, o in enumerate(names)], "posting_id string, req_ord int, option string, context string"))
    written, write = [], ask.materialised
    monkeypatch.setattr(ask, "materialised", lambda df: (written.append(df.columns), write(df))[1])
    got = check.retrieve(unit, offers, lambda requests: requests.withColumn("answers", narrowed), Prompts(tuning.load()), Settings(narrow_sizes=(25, 12), retrieval_k=30, retrieval_floor=0.03)).first().retrieved
    p = {o: 0.01 * (i // 2) for i, o in enumerate(reversed(names[:20]))}
    want = sorted(names, key=lambda o: (-p.get(o, 0), o))[:12]
    assert got == [o for o in want if p.get(o, 0) >= 0.03]
    assert len(written) == 3 and not any({"answers", "offered"} & set(c) for c in written)
