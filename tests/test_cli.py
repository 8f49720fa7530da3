import json

import pytest

from gristmill.__main__ import main
from test_stages import POSTING, RESUME


@pytest.fixture
def folder(tmp_path, spark, monkeypatch):
    for name in ("CLASSIFIER_BASE_URL", "CLASSIFIER_REPLAY", "TUNING_FILE"):
        monkeypatch.delenv(name, raising=False)
    (tmp_path / "job.txt").write_text(POSTING)
    (tmp_path / "ann.md").write_text(RESUME)
    return tmp_path


def test_commands_end_to_end(folder, capsys):
    assert main(["score", "-jd", f"{folder}/job.txt", "-resume", f"{folder}/ann.md", "-o", f"{folder}/score.json"]) == 0
    score = json.loads((folder / "score.json").read_text())
    assert score["schema_version"] == "1" and 0 <= score["match_score"] <= 100 and set(score["signals"]) == {"role_match", "experience_short", "blocker"}
    assert "stage.holistic" in capsys.readouterr().err
    assert main(["extract", "-q", "-debug", f"{folder}/trace.json", f"{folder}/job.txt"]) == 0
    said = capsys.readouterr()
    result = json.loads(said.out)
    assert result["requirements"] and "run summary" not in said.err and json.loads((folder / "trace.json").read_text())["sentences"]
    (folder / "result.json").write_text(said.out)
    assert main(["check", "-requirements", f"{folder}/result.json", "-resume", f"{folder}/ann.md", "-q"]) == 0
    coverage = json.loads(capsys.readouterr().out)
    assert len(coverage["requirements"]) == len(result["requirements"]) and coverage["fit"]["score"] is not None


def test_commands_reject_wrong_inputs(folder, capsys, monkeypatch):
    (folder / "blank.txt").write_text(" ")
    (folder / "bad.json").write_text('{"schema_version": "1", "requirements": [{"id": "", "value": "x", "refs": [], "tier": "required", "importance": 0}], "context": {}}')
    for args, why in (
        (["score", "-jd", f"{folder}/job.txt"], "required"), (["score", "-jd", f"{folder}/none.txt", "-resume", f"{folder}/ann.md"], "no such file"), (["extract", f"{folder}/blank.txt"], "blank"), (["extract", f"{folder}/ann.csv"], "expected .txt, .md"),
        (["check", "-requirements", f"{folder}/bad.json", "-resume", f"{folder}/ann.md"], "empty id; requirement : no refs"), (["nothing"], "invalid choice"),
    ):
        assert main(args) == 2
        assert why in capsys.readouterr().err
    monkeypatch.setenv("CHECKER_RETRIEVAL_K", "0")
    assert main(["extract", f"{folder}/job.txt"]) == 2 and "at least 1" in capsys.readouterr().err


def test_failures_exit_with_one(folder, capsys, monkeypatch):
    (folder / "rec.json").write_text('{"version": 1, "exchanges": {}}')
    monkeypatch.setenv("CLASSIFIER_REPLAY", f"{folder}/rec.json")
    assert main(["score", "-q", "-jd", f"{folder}/job.txt", "-resume", f"{folder}/ann.md"]) == 1
    assert "no recording of request" in capsys.readouterr().err


def test_replayed_run_needs_no_classifier(folder, spark, capsys, monkeypatch):
    """A recorded run gives the same score when it is replayed."""
    from gristmill.operators import ask, check, extract
    from gristmill.settings import tuning

    docs = extract.prepared(spark.createDataFrame([("job", POSTING)], "posting_id string, text string"))
    pair = docs.selectExpr("posting_id", "text AS posting").crossJoin(spark.createDataFrame([("ann", RESUME)], "resume_id string, resume string"))

    def recorded(requests):
        out = ask.lexical(requests)
        ask.record(out, f"{folder}/rec")
        return out

    want = check.holistic(pair, recorded, tuning.load()).first().match_score
    monkeypatch.setenv("CLASSIFIER_REPLAY", f"{folder}/rec")
    assert main(["score", "-q", "-jd", f"{folder}/job.txt", "-resume", f"{folder}/ann.md"]) == 0
    assert json.loads(capsys.readouterr().out)["match_score"] == want


def test_server_answers_tool_calls(spark):
    from io import StringIO

    from gristmill.server import Server
    from gristmill.settings import tuning
    from gristmill.settings.config import Settings
    from test_stages import scripted

    server = Server(spark, Settings(deadline=300.0), tuning.load(), scripted)
    said = server.answer(json.dumps({"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {}}))
    assert said["result"]["serverInfo"]["name"] == "gristmill"
    call = lambda n, **a: server.answer(json.dumps({"jsonrpc": "2.0", "id": n, "method": "tools/call", "params": {"name": n, "arguments": a}}))
    result = call("extract", job_description=POSTING)["result"]
    assert not result["isError"] and result["structuredContent"]["requirements"][0]["value"] == "SQL"
    coverage = call("check", requirements=result["structuredContent"], resume=RESUME)["result"]["structuredContent"]
    assert coverage["fit"]["score"] == 77
    assert call("extract", job_description=" \n")["result"] == {"content": [{"type": "text", "text": "extract: job_description: blank"}], "isError": True}
    assert "schema_version" in call("check", requirements={}, resume=RESUME)["result"]["content"][0]["text"]
    assert call("nothing")["error"]["code"] == -32602 and call("score", resume=RESUME)["error"]["code"] == -32602
    out = StringIO()
    lines = ["", "{", '{"jsonrpc": "2.0", "method": "notifications/initialized"}', '{"id": 7, "method": "tools/list"}', '{"id": 8, "method": "other"}', "[]"]
    server.serve(iter(line + "\n" for line in lines), out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r.get("error", {}).get("code") for r in replies] == [-32700, None, -32601, -32600]
    assert [t["name"] for t in replies[1]["result"]["tools"]] == ["score", "extract", "check"]
