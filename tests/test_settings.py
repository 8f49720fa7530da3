import copy
import io
import json
import time

import pytest

from gristmill import runtime
from gristmill.settings import config, tuning
from gristmill.sinks import files


def test_default_tuning_is_valid():
    t = tuning.load()
    assert tuning.problems(tuning.DEFAULT) == [] and len(t.hash) == 12 and t["match_score"]["intercept"] == 80.7


def test_tuning_files(tmp_path):
    table = copy.deepcopy(tuning.DEFAULT)
    (tmp_path / "t.json").write_text(json.dumps(table))
    assert tuning.load(str(tmp_path / "t.json")).source.endswith("t.json")
    (tmp_path / "t.yaml").write_text(json.dumps(table))  # JSON is YAML
    assert tuning.load(str(tmp_path / "t.yaml"))["version"] == 1
    table["version"] = 2
    table["match_score"]["slope"] = 1
    table["match_score"]["intercept"] = float("nan")
    table["fit_score"]["tier_weight"]["required"] = 0
    table["fit_score"]["credit"]["strong"] = -1
    del table["fit_score"]["credit"]["weak"]
    table["holistic"]["role_match"]["levels"] = ["one"]
    table["extractor"]["section"]["options"].pop("other")
    table["extractor"]["validation"]["reject_options"] = {}
    table["checker"]["strength"]["options"]["strong"] = {"what": " "}
    table["checker"]["gate"]["task"] = ""
    del table["checker"]["strength"]["options"]["none"]
    wrong = tuning.problems(table)
    for part in ("version 2", "match_score.slope: unknown", "intercept is not a finite", "required: must be positive", "credit.strong is negative", "missing 'weak'", "1 levels", "missing fixed option 'other'", "5 options, want exactly 6", "reject_options: no options", "strong.what is empty", "gate.task is empty", "missing fixed option 'none'"):
        assert any(part in w for w in wrong), part
    with pytest.raises(ValueError, match="version 2"):
        tuning.parse(json.dumps(table).encode(), "x.json")


def test_settings():
    s = config.load({"CHECKER_NARROW_SIZES": "32, 8", "RUN_DEADLINE": "1m30s", "PIPELINE_SKIP_IMPORTANCE": "true", "CLASSIFIER_TIMEOUT": "500ms"})
    assert s.narrow_sizes == (32, 8) and s.deadline == 90 and s.skip_importance and s.timeout == 0.5 and s.retrieval_k == 8
    with pytest.raises(ValueError, match="CHECKER_RETRIEVAL_K: invalid literal"):
        config.load({"CHECKER_RETRIEVAL_K": "many"})
    with pytest.raises(ValueError, match="not a truth value"):
        config.load({"CHECKER_GATE_FIRST": "maybe"})
    with pytest.raises(ValueError, match="was removed"):
        config.load({config.REMOVED[0]: "1"})
    with pytest.raises(ValueError) as e:
        config.load({"CHECKER_GATE_THRESHOLD": "0", "CHECKER_RETRIEVAL_K": "0", "PIPELINE_MIN_REQUIREMENT_MASS": "1.5", "RUN_DEADLINE": "0", "CLASSIFIER_REPLAY": "a", "CLASSIFIER_RECORD": "b"})
    for part in ("need CHECKER_GATE_THRESHOLD", "RETRIEVAL_K must be at least 1", "MASS must be in [0, 1]", "RUN_DEADLINE must be positive", "cannot both be set"):
        assert part in str(e.value)


def test_env_file(tmp_path):
    (tmp_path / ".env").write_text("# note\nexport A=1\nB='two words'\n\nbroken\n")
    assert config.read_env(str(tmp_path / ".env"), ("A",), {"A": "9", "Z": "0"}) == {"A": "9", "B": "two words"}
    with pytest.raises(KeyError, match="C, D"):
        config.read_env(str(tmp_path / ".env"), ("A", "C", "D"), {})


def test_atomic_files(tmp_path):
    at = tmp_path / "deep" / "x.json"
    files.write_json(at, {"a": "é"})
    assert at.read_text() == '{\n  "a": "é"\n}\n' and (at.stat().st_mode & 0o777) == 0o600 and (at.parent.stat().st_mode & 0o777) == 0o700
    with pytest.raises(TypeError):
        files.write_json(at, {1: object()})
    assert [p.name for p in at.parent.iterdir()] == ["x.json"]
    out = io.StringIO()
    files.emit_json([1], "", out)
    assert out.getvalue() == "[\n  1\n]\n"


def test_metrics_stages_and_logs():
    m, out = runtime.Metrics(), io.StringIO()
    log = runtime.logger(config.Settings(), out)
    with runtime.stage("fine", m, log):
        m.add("n", 2)
    with pytest.raises(RuntimeError, match="broken: oops"), runtime.stage("broken", m, log):
        raise ValueError("oops")
    lines = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [(x["msg"], x["stage"]) for x in lines] == [("stage done", "fine"), ("stage failed", "broken")] and lines[1]["error"] == "oops"
    for s in (0.1, 0.4, 0.2, 0.3):
        m.observe("d", s)
    d = m.summary()["durations"]["d"]
    assert (d["count"], d["p50"], d["p95"], d["max"]) == (4, 0.2, 0.4, 0.4) and m.summary()["counters"] == {"n": 2}
    text = io.StringIO()
    m.write(text)
    assert text.getvalue().startswith("n ") and "p50=0.200s" in text.getvalue()


def test_rows_are_counted_without_a_job(spark):
    m = runtime.Metrics()
    df = runtime.counted(spark.range(7), m, "rows")
    df.collect()
    df.settle()
    assert m.counters == {"rows": 7}


def test_deadline(spark):
    from pyspark.sql import functions as F

    slow = spark.range(8).repartition(4)
    with runtime.deadline(spark, 60):
        assert slow.count() == 8
    with pytest.raises(runtime.DeadlineExceeded, match="RUN_DEADLINE=1s"), runtime.deadline(spark, 1):
        spark.range(4).mapInPandas(lambda it: ((time.sleep(8), f)[1] for f in it), "id long").collect()
    assert spark.range(3).count() == 3


def test_text_cache(tmp_path):
    calls, m = [], runtime.Metrics()

    def generate(system, prompt):
        calls.append(prompt)
        if prompt == "bad":
            raise OSError("down")
        return "" if prompt == "blank" else f"{system}{prompt}"

    cache = runtime.TextCache(str(tmp_path / "c"), generate, m)
    assert cache("s", "a") == cache("s", "a") == "sa" and cache("s", "blank") == cache("s", "blank") == ""
    for _ in range(2):
        with pytest.raises(OSError):
            cache("s", "bad")
    assert calls == ["a", "blank", "blank", "bad", "bad"] and m.counters == {"cache.hits": 1, "cache.misses": 5}


def test_limiter():
    limit = runtime.Limiter(1)
    with limit.slot(), pytest.raises(TimeoutError), limit.slot(0.01):
        pass
    with limit.slot(0.01):
        pass


def test_cached_table(spark, tmp_path):
    from pyspark.sql import functions as F

    asked = []

    def build(rows):
        asked.append(sorted(r.k for r in rows.collect()))
        return rows.withColumn("v", F.upper("k"))

    table = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")
    at = str(tmp_path / "t")
    assert sorted(r.v for r in runtime.cached_table(spark, table("a", "b"), at, "k", build).collect()) == ["A", "B"]
    assert sorted(r.v for r in runtime.cached_table(spark, table("b", "c"), at, "k", build).collect()) == ["B", "C"]
    runtime.cached_table(spark, table("a"), at, "k", build).collect()
    assert asked == [["a", "b"], ["c"]]
