"""What keeps one bad file, one error or one dying writer from harming the rest."""

import json
import sys
import threading
import time
import xml.etree.ElementTree as ET
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gristmill.evaluation import judge
from gristmill.runtime import together
from gristmill.settings.config import Settings
from gristmill.sinks import tables
from gristmill.sources import pdf
from gristmill.sources.guarded import Child, ChildError, ItemError


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors don't have the tests


def stubborn(item: bytes) -> str:
    """Reads like a PDF reader, but for files that loop, die, take the memory or fail."""
    if b"loop" in item:
        while True:
            pass
    if b"die" in item:
        import os

        os._exit(3)
    if b"greedy" in item:
        return "x" * len(bytearray(4 << 30))
    if b"bad" in item:
        raise pdf.PdfError("no page")
    print("a child may print")
    return item.decode()


def test_a_child_that_hangs_or_dies():
    with Child(cloudpickle.dumps(stubborn), seconds=3) as child:
        assert child(b"fine") == "fine"
        with pytest.raises(ItemError, match="no page") as error:
            child(b"bad")
        assert error.value.kind == "PdfError"
        for item, why in ((b"die", "died"), (b"loop", "more than 3 s")):
            with pytest.raises(ChildError, match=why):
                child(item)
        with pytest.raises(ItemError) as error:
            child(b"greedy")
        assert error.value.kind == "MemoryError"
        assert child(b"x" * 3_000_000) == "x" * 3_000_000


def test_a_pdf_that_loops_loses_its_own_row(spark, tmp_path):
    for name in ("one", "loop", "die", "two"):
        (tmp_path / f"{name}.pdf").write_bytes(name.encode())
    rows = {r.resume_id: (r.text, r.error) for r in pdf.read_pdfs(spark, str(tmp_path), seconds=3, reader=stubborn).collect()}
    assert rows["one"] == ("one", None) and rows["two"] == ("two", None)
    assert rows["loop"][1] == "the reader took more than 3 s" and "died" in rows["die"][1]


def test_the_first_error_stops_its_siblings(spark):
    began, reached = time.time(), []

    def slow():
        spark.range(4).repartition(4).mapInPandas(lambda it: (time.sleep(120) or b for b in it), "id long").count()

    def wrong():
        time.sleep(4)
        raise KeyError("wrong")

    with pytest.raises(KeyError, match="wrong"):
        together(spark, slow, wrong, lambda: reached.append(1), most=2)
    assert time.time() - began < 60 and not reached  # the job was cancelled, the third task never began
    assert together(spark, lambda: spark.range(5).count(), lambda: "x") == [5, "x"]


def test_a_table_that_stays_readable(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "judged")
    frame = lambda rows: spark.createDataFrame(rows, "pair string, score double")
    read = lambda: {r.pair: r.score for r in tables.current(spark, path).collect()}
    assert tables.current(spark, path) is None
    tables.upsert(spark, frame([("a", 1.0), (None, 5.0)]), path, ["pair"])
    old = tables.current(spark, path)
    tables.upsert(spark, frame([("b", 2.0), ("a", 3.0)]), path, ["pair"])
    assert read() == {"a": 3.0, "b": 2.0, None: 5.0} and old.count() == 2  # readers of the former version go on
    plain = tables._point
    monkeypatch.setattr(tables, "_point", lambda *a: (_ for _ in ()).throw(OSError("the writer died")))
    with pytest.raises(OSError):
        tables.upsert(spark, frame([("a", 9.0)]), path, ["pair"])
    assert read() == {"a": 3.0, "b": 2.0, None: 5.0}
    monkeypatch.setattr(tables, "_point", plain)
    tables.upsert(spark, frame([("a", 4.0)]), path, ["pair"])
    assert read()["a"] == 4.0


RESUME = "# Skills\n• Python – five years\n• SQL"


@pytest.fixture()
def server():
    """Replies by the text of the prompt, a different score each time."""
    asked = []

    class Reply(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            said = body["messages"][-1]["content"]
            asked.append(said)
            score = [10, 30, 20][sum(s == said for s in asked) - 1]
            text = "no JSON" if "Rust" in said else "Well: " + json.dumps({"score": score, "must_haves": [{"quote": "python five  years"}, {"quote": "Kafka"}, {"quote": ""}, {}]})
            data = json.dumps({"choices": [{"message": {"content": text}}], "usage": {}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Reply)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", asked
    http.shutdown()


def test_judge_from_reply_to_table(spark, server, tmp_path):
    url, asked = server
    pairs = spark.createDataFrame([("p", RESUME, "Python wanted"), ("q", RESUME, "Rust wanted")], "pair string, resume string, posting string")
    replies = judge.ask(pairs, "a rubric", Settings(generator_url=url, generator_model="m"), runs=3).cache()
    rows = judge.medians(judge.parsed(replies), pairs.select("pair", "resume")).collect()
    assert len(asked) == 6 and [(r.pair, r.score, sorted(r.scores), r.quote_rate) for r in rows] == [("p", 20.0, [10, 20, 30], 0.5)]
    judge.merge(spark, judge.medians(judge.parsed(replies), pairs.select("pair", "resume")), str(tmp_path / "t"))
    assert tables.current(spark, str(tmp_path / "t")).first().score == 20.0


def test_three_arms(spark):
    frame = lambda rows: spark.createDataFrame(rows, "pair string, score double")
    matches = frame([("a", 50.0), ("a", 70.0), ("b", 20.0), ("c", None), ("d", 90.0)])
    table = judge.three_ways(matches, frame([("a", 55.0), ("b", 25.0), ("e", 1.0)]), frame([("a", 65.0), ("b", 30.0), ("d", 80.0)]))
    rows = {r.pair: (r.reference, r.judge, r.match) for r in table.collect()}
    assert rows == {"a": (65.0, 55.0, 60.0), "b": (30.0, 25.0, 20.0), "d": (80.0, None, 90.0), "e": (None, 1.0, None)}
    found = {r.arms: r for r in judge.agreements(table).collect()}
    assert found["match vs reference"].n == 3 and found["match vs reference"].mae == pytest.approx(25 / 3) and found["match vs reference"].tau_b == 1.0
    assert found["judge vs reference"].bias == -7.5 and found["match vs judge"].within_10 == 1.0
    scores = spark.createDataFrame([("a", 1, 10), ("a", 3, 10), ("b", 9, 1), ("c", None, 3), ("d", 8, 0)], "pair string, score int, reference int")
    assert [(r.pair, r.error) for r in judge.top_disagreements(scores, 2).collect()] == [("a", 8.0), ("b", 8.0)]


def test_picture():
    tree = ET.fromstring(judge.agreement_picture([(0, 0), (100, 100), (50, 40)], [(50, 60)], "Scores & references"))
    circles = [c.attrib for c in tree.iter() if c.tag.endswith("circle")]
    assert len(circles) == 4 and (circles[1]["cx"], circles[1]["cy"]) == ("48.0", "432.0")
    assert any("mean error 3.3 over 3 pairs, rings 10.0 over 1" in (t.text or "") for t in tree.iter())
