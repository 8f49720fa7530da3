import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gristmill.evaluation import baseline, checks, labels, reports, runners
from gristmill.operators import ask, extract
from gristmill.settings import tuning
from gristmill.settings.config import Settings
from test_stages import POSTING, RESUME, scripted

EXPECTED = "fixture_id string, exp_ord int, value string, aliases array<string>, tier string"
PREDICTED = "fixture_id string, pred_ord int, value string, tier string, refs array<string>, importance double"


@pytest.fixture(scope="module")
def tables(spark):
    expected = spark.createDataFrame([("f", 0, "Python", [], "required"), ("f", 1, "PostgreSQL", ["Postgres"], "required"), ("f", 2, "building data pipelines", None, "preferred"), ("f", 3, "Kafka", [], "mentioned"), ("f", 4, "Rust", [], "mentioned")], EXPECTED)
    predicted = spark.createDataFrame([("f", 0, "python", "required", ["s1"], 0.9), ("f", 1, "Postgres", None, ["s2"], 0.9), ("f", 2, "data pipeline", "preferred", ["s1"], 0.5), ("f", 3, "team player", "mentioned", [], 0.1), ("f", 4, "git", "mentioned", [], 0.1), ("f", 5, "Python", "mentioned", [], 0.1), ("f", 6, "Scala", "mentioned", [], 0.1)], PREDICTED)
    lists = spark.createDataFrame([("f", ["team player"], ["Git"])], "fixture_id string, filler array<string>, acceptable array<string>")
    context = spark.createDataFrame([("f", "s2", "preferred"), ("f", "s1", "required")], "fixture_id string, ref string, section string")
    return expected, predicted, lists, context


def test_matches_and_leftovers(tables):
    expected, predicted, lists, context = tables
    matched = labels.matches(expected, predicted)
    assert {(r.exp_ord, r.pred_ord, r.strict) for r in matched.collect()} == {(0, 0, True), (1, 1, True), (2, 2, False)}
    rest = {r.value: r.kind for r in labels.leftovers(lists, expected, predicted, matched).collect()}
    assert rest == {"team player": "filler", "git": "acceptable", "Python": "duplicate", "Scala": "extra"}
    scores = {r.tier: r for r in labels.fixture_scores(lists, expected, predicted, context).collect()}
    all_ = scores[""]
    assert (all_.expected, all_.predicted, all_.strict, all_.loose, all_.tier_checked, all_.tier_correct, all_.filler, all_.acceptable, all_.duplicate, all_.extra) == (5, 7, 2, 3, 3, 2, 1, 1, 1, 1)
    assert (scores["required"].expected, scores["required"].loose) == (2, 2)
    t = labels.totals(labels.fixture_scores(lists, expected, predicted, context)).first()
    assert (t.recall_strict, t.recall_loose, t.precision_loose) == (0.4, 0.6, 0.6) and t.f1_loose == pytest.approx(0.6)
    assert labels.tier_order(expected, matched, predicted).first().tier_order == 1.0


def test_misses_name_the_stage(spark):
    names = ["Dropped", "Merged", "Taken", "Unselected", "Rejected", "Benefit", "Uncut", "Absent", "C++"]
    expected = spark.createDataFrame([("f", i, v, [], "required") for i, v in enumerate(names)], EXPECTED)
    matched = spark.createDataFrame([], "fixture_id string, exp_ord int, pred_ord int")
    values = spark.createDataFrame([("f", 0, "dropped", False, False), ("f", 1, "merged", True, True), ("f", 2, "taken", True, False)], "fixture_id string, i int, value string, keep boolean, merged boolean")
    validated = spark.createDataFrame([("f", 1, 1, ["unselected thing one two", "x"], False), ("f", 2, 1, ["Unselected", "y"], True), ("f", 3, 1, ["rejected"], False)], "fixture_id string, ord long, chunk_no long, options array<string>, selected boolean")
    sentences = spark.createDataFrame([("f", 4, "A Benefit, here", True), ("f", 5, "Uncut stands", False), ("f", 6, "absently", False), ("f", 7, "we write C++", False)], "fixture_id string, ord long, text string, dropped boolean")
    got = {r.value: (r.stage, r.at) for r in labels.misses(expected, matched, values, validated, sentences).collect()}
    assert got == {"Dropped": ("filler", 0), "Merged": ("merged", 1), "Taken": ("scoring", 2), "Unselected": ("not_selected", 2), "Rejected": ("rejected", 3), "Benefit": ("section_dropped", 4), "Uncut": ("no_candidate", 5), "Absent": ("not_in_text", 0), "C++": ("no_candidate", 7)}


def _golden(spark):
    body = [("job", "Senior Data Engineer", POSTING, [("Python", [], "required"), ("SQL", [], "required"), ("Terraform", [], "required"), ("Dental insurance", [], "mentioned"), ("Haskell", [], "preferred")], [["Kafka", "Pulsar"]], ["Kubernetes"], [])]
    return spark.createDataFrame(body, "fixture_id string, title string, text string, requirements array<struct<value:string,aliases:array<string>,tier:string>>, alternative_groups array<array<string>>, acceptable array<string>, filler array<string>")


def test_extractor_run_and_rescore(spark, tmp_path):
    golden = _golden(spark)
    run = runners.run_extractor(golden, scripted, tuning.load())
    t = run.totals.first()
    assert (t.expected, t.predicted, t.loose, t.acceptable) == (5, 6, 3, 1)
    assert {(r.value, r.stage) for r in run.misses.collect()} == {("Dental insurance", "section_dropped"), ("Haskell", "not_in_text")}
    results = extract.result_json(run.extraction).select("posting_id", F.col("result").alias("raw"))
    from gristmill.sources import loaders

    again = runners.rescore(golden, loaders.parse_results(results))
    assert again.totals.first().asDict() == t.asDict() and {r.stage for r in again.misses.collect()} == {"unknown"}
    tiers = {r.tier: r.asDict() for r in run.scores.collect() if r.tier}
    stages = {r.stage: r["count"] for r in run.misses.groupBy("stage").count().collect()}
    fixture = {"title": "Senior | Data", "loose": 3, "expected": 5, "predicted": 6, "filler": 0, "misses": [m.asDict() for m in run.misses.collect()], "extras": ["Kafka"]}
    text = reports.extraction_markdown(t.asDict(), tiers, stages, [fixture, {"title": "broken", "expected": 1, "error": "no text"}], "Run")
    assert "| Recall (loose) | 60.0% |" in text and "| section_dropped | 1 |" in text and "Senior \\| Data" in text and "| broken | error: no text | 1 |" in text and "- **Extra (1):** `Kafka`" in text
    when = datetime(2026, 1, 2, 3, 4, 5)
    path = reports.write({"totals": t.asDict()}, text, tmp_path, when, {"job": {"chunks": []}})
    assert path.name == "2026-01-02T03-04-05Z.md" and json.loads((tmp_path / "2026-01-02T03-04-05Z.json").read_text())["totals"]["expected"] == 5
    assert loaders.read_traces(spark, str(tmp_path / "2026-01-02T03-04-05Z.json")).first().fixture_id == "job"
    assert reports.write({}, "", tmp_path, when, rescored_from="x").name.endswith("-rescored.md")


def test_checker_run(spark):
    golden = _golden(spark).select(F.col("fixture_id").alias("posting_id"), "title", F.col("text").alias("posting"), "alternative_groups")
    expected = spark.createDataFrame([("job", 0, "Python", ["CPython"], "required"), ("job", 1, "SQL", [], "required"), ("job", 2, "Kafka", [], "required"), ("job", 3, "Pulsar", [], "required"), ("job", 4, "Kubernetes", [], "preferred"), ("job", 5, "Excel", [], "preferred")], "posting_id string, exp_ord int, value string, aliases array<string>, tier string")
    reqs, groups, context = runners.golden_requirements(golden, expected)
    refs = {r.value: r.refs for r in reqs.collect()}
    assert refs["Python"] == refs["SQL"] != [] and refs["Excel"] == [] and groups.first().members == ["req_3", "req_4"]
    pairs = spark.createDataFrame([("pair", "job", "ann")], "pair_id string, posting_id string, resume_id string")
    resumes = spark.createDataFrame([("ann", RESUME)], "resume_id string, text string")
    links = spark.createDataFrame([("pair", "Python", "Python pipelines", "strong"), ("pair", "SQL", "SQL reports", "partial"), ("pair", "Kafka", "Python pipelines", "weak"), ("pair", "Excel", "Excel", "weak"), ("pair", "Pulsar", "SQL reports", "weak")], "pair_id string, value string, quote string, strength string")
    skip = spark.createDataFrame([("pair", "Excel")], "pair_id string, value string")
    run = runners.run_checker(pairs, reqs, groups, context, resumes, links, skip, scripted, tuning.load())
    s = run.link_scores.first()
    assert (s.labeled, s.predicted, s.correct, s.exact, s.near) == (4, 4, 3, 1, 2)
    assert {(r.value, r.want, r.got) for r in run.rows.collect()} == {("Python", "strong", "strong"), ("SQL", "partial", "strong"), ("Kafka", "weak", "strong"), ("Pulsar", "weak", "none"), ("Kubernetes", "none", "weak")}
    assert {r.tier: (r.exact, r.covered, r.total) for r in run.tallies.collect()} == {"required": (1, 3, 4), "preferred": (0, 0, 1)}
    t = run.totals.first()
    assert t.link_recall == 0.75 and t.link_precision == 0.75 and t.coverage_exact == 0.2 and t.strength_exact == pytest.approx(1 / 3)
    matrix = {r.want: {k: r[k] for k in ("strong", "partial", "weak", "none")} for r in run.confusion.collect()}
    assert matrix["weak"] == {"strong": 1, "partial": 0, "weak": 0, "none": 1}
    notes = [{"pair_id": "pair", "value": r.value, "unit_id": None, "want": r.want, "got": r.got} for r in run.rows.where("want <> got").collect()]
    other = reports.baseline_markdown("m", [{"title": "A", "resume": "ann", "want": 60, "got": 58, "score": None, "gaps_want": ["x|y"], "gaps": [], "error": "down"}], {"fit_error": 2.0, "fit_error_max": 2, "baseline_error": 0.0, "baseline_error_max": 0, "fit_bias": -2.0, "baseline_bias": 0.0, "failed": 0, "pairs": 1, "baseline_failed": 1, "baseline_ran": 1})
    text = reports.checker_markdown(t.asDict(), matrix, [{"pair_id": "pair", "title": "Job", "resume": "ann", "exact": 1, "total": 5, "fit_got": 70, "fit_want": None}], notes, "Check", other)
    assert "| weak | 1 | 0 | 0 | 1 |" in text and "70 / –" in text and "- `SQL`: want partial, got strong" in text and "x\\|y" in text and "1/1" in text
    wrong = links.withColumn("quote", F.lit("nowhere"))
    with pytest.raises(Exception, match="matches 0 units"):
        checks.resolve_quotes(wrong, spark.createDataFrame([("pair", "e1", "text")], "pair_id string, unit_id string, text string")).collect()


def test_pairs_with_a_cache(spark, tmp_path):
    rows = [("p1", "Senior Data Engineer", POSTING, "r", RESUME, 60.0, 55), ("p2", "Again", POSTING, "r", RESUME, None, 40)]
    pairs = spark.createDataFrame(rows, "pair_id string, title string, posting string, resume_id string, resume string, reference double, saved int")
    asked = []

    def provider(requests):
        asked.append(1)
        if "questions" in requests.columns and requests.select(F.exists("questions", lambda q: q["id"] == "role_match").alias("h")).first().h:
            return ask.lexical(requests)
        return scripted(requests)

    got = {r.pair_id: r for r in runners.run_pairs(spark, pairs, provider, tuning.load(), Settings(), True, str(tmp_path / "cache")).collect()}
    assert got["p1"].match == got["p2"].match and got["p1"].fit == got["p2"].fit == 77
    before = len(asked)
    again = {r.pair_id: r.fit for r in runners.run_pairs(spark, pairs, provider, tuning.load(), Settings(), True, str(tmp_path / "cache")).collect()}
    assert again == {"p1": 77, "p2": 77} and len(asked) - before < before  # nothing is extracted twice


def test_pair_totals_and_order(spark):
    rows = [("a", 0, 60.0, 50, 70, 65, 100, 30, 90, 1000, None), ("b", 1, 80.0, 70, 78, None, 200, 10, 20, 3000, ""), ("c", 2, None, 10, 30, 20, 50, 1, 1, 2000, None), ("d", 3, 10.0, None, None, None, None, None, None, 0, "timeout")]
    scores = spark.createDataFrame(rows, "pair_id string, ord int, reference double, saved int, match int, fit int, holistic_ms long, extract_ms long, check_ms long, cost_micro_usd long, error string")
    t = checks.pair_totals(scores).first()
    assert (t.pairs, t.failed, t.n, t.mae, t.bias, t.worst, t.fit_n, t.mean_ms) == (4, 1, 2, 6.0, 4.0, 10.0, 1, 123)
    assert t.tau_b == 1.0 and t.saved_tau_b == 1.0 and t.cost_per_pair == pytest.approx(0.0015)
    placed = [r.asDict() | {"title": r.pair_id} for r in checks.by_disagreement(scores).collect()]
    assert [p["pair_id"] for p in sorted(placed, key=lambda p: p["place"])] == ["a", "b", "c", "d"]
    text = reports.pairs_markdown(t.asDict(), placed, "Pairs")
    assert "**6.0** (2 pairs)" in text and "| d | error: timeout | 10 | – |" in text


def test_baseline_replies(spark):
    replies = ['```json\n{"score": "87.6", "gaps": ["a"], "strengths": null}\n```', '{"score": 140, "gaps": ["1","2","3","4","5","6","7","8","9"]}', "no braces", '{"gaps": []}']
    value, gaps, strengths, wrong = baseline.parse_reply(F.col("r"))
    got = spark.createDataFrame([(r,) for r in replies], "r string").select(value.alias("s"), F.size(gaps).alias("g"), F.size(strengths).alias("t"), wrong.alias("e")).collect()
    assert [tuple(r) for r in got] == [(88, 1, 0, None), (100, 8, 0, None), (None, 0, 0, "no JSON object in the reply"), (None, 0, 0, "no score in the reply")]
    rows = spark.createDataFrame([(2, 100, None, 4000), (900, 100, 0.5, 4000)], "input_tokens long, output_tokens long, cost double, prompt_chars long")
    priced = [(r.input_tokens, r.input_estimated, r.cost, r.cost_estimated) for r in baseline.priced(rows, 1.0, 10.0).collect()]
    assert priced == [(1000, True, 0.002, True), (900, False, 0.5, False)]
    t = baseline.totals(spark.createDataFrame([("a", 60, 58, 70, 0.5, 10, 20, None), ("b", 50, 55, None, None, 1, 2, "down")], "pair_id string, want int, got int, score int, cost double, input_tokens long, output_tokens long, error string")).first()
    assert (t.baseline_ran, t.baseline_failed, t.baseline_error, t.fit_error, t.fit_bias, t.baseline_cost) == (2, 1, 10.0, 3.5, 1.5, 0.5)


def test_report_text():
    assert reports.pct(None) == "n/a" and reports.pct(0.5) == "50.0%" and reports.number(None) == "–" and reports.quoted([]) == "none" and len(reports.clip("x" * 100)) == 91
    one, two = ("a", {"x": 1}), ("b", {"y": [2]})
    assert reports.labels_hash([one, two]) != reports.labels_hash([two, one]) and len(reports.labels_hash([one])) == 12


def test_pairs_are_those_that_either_test_allows_and_made_once(spark):
    words = ["Python", "python 3", "Kubernetes", "kubernete", "Kuber", "kube", "C++", "Go", "", None, "data engineering", "data engineer", "engineering", "a the", "Ünder—score / data", "spark streaming jobs here now", "SQL and NoSQL"]
    expected = spark.createDataFrame([(f, i, v, [words[i - 1], None] if i % 3 == 0 else None, "required") for f in "fg" for i, v in enumerate(words)], EXPECTED)
    predicted = spark.createDataFrame([(f, i, v) for f in "fh" for i, v in enumerate(reversed(words))], "fixture_id string, pred_ord int, value string")
    e = labels._with_variants(expected, F.concat(F.array("value"), F.coalesce("aliases", F.array().cast("array<string>"))))
    brute = e.join(labels._prepared(predicted, "value", "p"), "fixture_id").withColumn("n", F.when(labels.strict(), 0).when(labels.loose(), 1)).where("n IS NOT NULL")
    want = sorted((r.exp_ord, r.pred_ord, r.n) for r in brute.collect())
    found = labels.pairs(expected, predicted)
    assert sorted((r.exp_ord, r.pred_ord, r.pass_no) for r in found.collect()) == want and len(want) > len(words)
    # each pair of a fixture is met by one join, and the tests of its words follow a shared mark
    plan = labels.matches(expected, predicted)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and plan.count("arrays_overlap") == 1
