import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from gristmill.__main__ import main
from gristmill.operators import ask

SCHEMA = f"state string, questions array<{ask.QUESTION}>"


def q(id, options, kind="choice", instructions='"which?"'):
    return (id, kind, instructions, options, json.dumps(dict.fromkeys(options)))


ROWS = [('"Go and SQL"', [q("q1", ["rust", "sql", "none"])]), (None, [q("q1", ["a", "b"])]), ('"Go and SQL"', [q("q1", ["rust", "sql", "none"])]), ('"x"', [q("q2", ["yes", "no"], "noul", '"x y"'), q("q3", ["low", "x"], "score")])]


def test_lexical_answers(spark):
    got = ask.lexical(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert [r.answers[0].choice for r in got] == ["sql", "a", "sql", None]
    assert got[0].answers[0].probs == pytest.approx({"rust": 1 / 6, "sql": 2 / 3, "none": 1 / 6}) and got[0].request_key == got[2].request_key != got[1].request_key
    assert got[3].answers[0].noul == 0.5 and got[3].answers[1].score == pytest.approx(4 / 5)
    assert ask.problems(ask.lexical(spark.createDataFrame(ROWS, SCHEMA))).count() == 0


def test_replay_and_record(spark, tmp_path):
    requests = spark.createDataFrame(ROWS, SCHEMA)
    ask.record(ask.lexical(requests), str(tmp_path / "r"))
    ask.record(ask.lexical(requests.limit(1)), str(tmp_path / "r"))
    stored = ask.recording(spark, str(tmp_path / "r"))
    got = ask.replay(stored)(requests)
    assert sorted(str(r.answers) for r in got.collect()) == sorted(str(r.answers) for r in ask.lexical(requests).collect())
    with pytest.raises(Exception, match="no recording"):
        ask.replay(stored.where("false"))(requests).collect()
    missing = ask.problems(ask.replay(stored.where("false"), missing_fails=False)(requests))
    assert {r.problem for r in missing.collect()} == {"missing"}


def test_recordings_of_json(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"version": 1, "exchanges": {"k": {"model": "m", "answers": {"a": {"choice": "x", "probabilities": {"x": 1.0}}, "b": {"noul": 0.5}}}}}))
    row = ask.recording(spark, str(tmp_path / "r.json")).first()
    assert row.request_key == "k" and {a.id: (a.choice, a.noul) for a in row.answers} == {"a": ("x", None), "b": (None, 0.5)}
    (tmp_path / "old.json").write_text(json.dumps({"version": 2, "exchanges": {}}))
    with pytest.raises(Exception, match="recording version 2"):
        ask.recording(spark, str(tmp_path / "old.json")).collect()


def test_problems(spark):
    rows = [
        ("k1", [q("a", ["a"])], [("a", "a", {"a": 1.2}, None, None, None)]), ("k2", [q("a", ["a"])], [("a", "z", {"a": 1.0}, None, None, None)]), ("k3", [q("a", ["a"])], [("a", "a", {"a": 1.0}, None, None, 0.5)]),
        ("k4", [q("a", ["a", "b"], "score")], [("a", None, None, None, 1.5, None)]), ("k5", [q("a", ["true", "false"], "noul")], [("a", None, None, None, None, None)]), ("k6", [q("a", ["a"])], [("a", "a", {}, None, None, None)]),
        ("k7", [q("a", ["a"])], [("a", "a", {"a": 0.5, "z": 0.5}, None, None, None)]), ("k8", [q("a", ["a"])], []),
    ]
    got = ask.problems(spark.createDataFrame(rows, f"request_key string, questions array<{ask.QUESTION}>, answers array<{ask.ANSWER}>")).collect()
    assert {(r.request_key, r.problem) for r in got} == {
        ("k1", "probability out of range"), ("k2", "choice is not an option"), ("k4", "score missing or out of range"), ("k5", "noul missing or out of range"), ("k6", "empty distribution"), ("k7", "probability of what is not an option"), ("k8", "missing"),
    }


def test_http_retries_and_keeps_errors(spark):
    calls = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            ids = sorted(body["questions"])
            calls.append(ids[0])
            code = 400 if ids[0] == "q2" else 503 if calls.count("q1") == 1 else 200
            self.send_response(code)
            self.end_headers()
            said = {i: {"choice": min(x["criteria"]), "probabilities": {o: 1 / len(x["criteria"]) for o in x["criteria"]}} for i, x in body["questions"].items()}
            self.wfile.write(json.dumps({"answers": said}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    got = ask.http(f"http://127.0.0.1:{server.server_port}", {}, 1)(spark.createDataFrame(ROWS, SCHEMA)).collect()
    server.shutdown()
    assert sorted((r.answers[0].choice if r.answers else None, r.error) for r in got if r.error is None) == [("a", None), ("none", None), ("none", None)]
    assert [r.error for r in got if r.error] == ["status 400"]
    assert len(calls) == 4  # three distinct requests and one retry


def test_waits():
    still = lambda: 0.0
    assert [ask.wait_before(n, jitter=still) for n in (0, 1, 5, 9)] == [0.5, 1, 16, 16]
    assert ask.wait_before(0, "7", still) == 7 and ask.wait_before(0, "soon", still) == 0.5


def test_command_line_rejects_unknown_queries(capsys):
    assert main(["nothing", "a", "b"]) == 2


def test_lexical_reads_a_state_once_a_request(spark):
    """A long state with many questions: its words are met with what the questions seek once, not for each option."""
    import time

    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda i: F.concat(F.lit("w"), i.cast("string"))))
    options = F.array(*[F.lit(f"w{k} none{k}") for k in range(1, 11)])
    question = lambda i: F.struct(F.concat(F.lit("q"), i.cast("string")).alias("id"), F.when(i % 2 == 0, "choice").otherwise("noul").alias("kind"), F.lit('{"say":"w7 w8 nothing"}').alias("instructions"), options.alias("options"), F.lit("{}").alias("criteria"))
    requests = spark.range(1).select(words.alias("state"), F.transform(F.sequence(F.lit(1), F.lit(400)), question).alias("questions"))
    began = time.monotonic()
    said = ask.lexical(requests).select("answers").first()["answers"]
    assert time.monotonic() - began < 10
    assert said[0]["noul"] == 0.5 and said[1]["probs"] == {f"w{k} none{k}": 0.1 for k in range(1, 11)} and len(said) == 400
