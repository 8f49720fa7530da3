import json
import zlib

import pytest
from pyspark.sql import functions as F

from gristmill.sources import loaders, pdf


def _pdf(lines, flate=False, kids=b"[3 0 R]", extra=b""):
    shown = b"BT /F1 12 Tf 72 700 Td " + b" 0 -14 Td ".join(b"(" + x.encode("latin-1").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj" for x in lines) + b" ET"
    data = zlib.compress(shown) if flate else shown
    head = b"<< /Length %d%s >>" % (len(data), b" /Filter /FlateDecode" if flate else b"")
    return b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids " + kids + b" /Count 1 >> endobj\n3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R >> endobj\n4 0 obj " + head + b"\nstream\n" + data + b"\nendstream endobj\n" + extra + b"%%EOF"


def test_pdf_text():
    for flate in (False, True):
        assert pdf.text_of(_pdf(["Ann Lee", "Work (at) Acme"], flate)).split("\n")[:2] == ["Ann Lee", "Work (at) Acme"]
    spaced = _pdf(["x"]).replace(b"(x) Tj", b"[(Go) -300 (and) 20 ( SQL)] TJ")
    assert pdf.text_of(spaced).strip() == "Go and SQL"
    assert pdf.text_of(_pdf(["x"]).replace(b"(x) Tj", b"<48656C6C6F> Tj")).strip() == "Hello"
    for raw, why in ((b"plain", "not a PDF"), (_pdf(["x"], kids=b"[2 0 R]"), "page tree"), (_pdf(["x"]) + b"/Encrypt", "encrypted"), (_pdf(["y" * 60_000]), "too large")):
        with pytest.raises(pdf.PdfError, match=why):
            pdf.text_of(raw)
    many = _pdf(["p"], kids=b"[" + b"3 0 R " * 50 + b"]")
    assert len(pdf.collect_pages(pdf._objects(many))) == 20


def test_pdf_fonts_with_maps():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <0048> endbfchar 1 beginbfrange <0002> <0003> <0069> endbfrange"
    extra = b"5 0 obj << /Type /Font /ToUnicode 6 0 R >> endobj\n6 0 obj << /Length %d >>\nstream\n" % len(cmap) + cmap + b"\nendstream endobj\n"
    raw = _pdf(["x"], extra=extra).replace(b"/Contents 4 0 R", b"/Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >>").replace(b"(x) Tj", b"<000100020003> Tj")
    assert pdf.text_of(raw).strip() == "Hij"


def test_pdf_normalise(spark):
    text = "Ann Lee\n\nWork Experience:\n•\nBuilt it\n●Ran it\n  \nskills\nGo, SQL"
    got = spark.createDataFrame([(text,)], "t string").select(pdf.normalise(F.col("t")).alias("x")).first().x
    assert got == "Ann Lee\n# Work Experience:\n• Built it\n● Ran it\n# skills\nGo, SQL"


def test_texts_and_resumes(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# Lead Engineer\nGo")
    (tmp_path / "b.MD").write_text(" \n ")
    (tmp_path / "c.txt").write_text("x" * 49_153)
    (tmp_path / "d.pdf").write_bytes(_pdf(["Ann Lee", "Skills", "Go"]))
    (tmp_path / "e.pdf").write_bytes(b"nothing")
    (tmp_path / "f.png").write_bytes(b"no text")
    jobs = {r.posting_id: (r.title, r.error) for r in loaders.read_postings(spark, str(tmp_path)).collect()}
    assert jobs == {"a": ("Lead Engineer", None), "b": ("", "blank"), "c": ("x" * 49_153, "too large")}
    people = {r.resume_id: (r.text if r.resume_id == "d" else None, r.error) for r in loaders.read_resumes(spark, str(tmp_path)).collect()}
    assert people == {"a": (None, None), "b": (None, "blank"), "c": (None, "too large"), "d": ("Ann Lee\n# Skills\nGo", None), "e": (None, "not a PDF")}
    handed = loaders.texts(spark, [("x", "text"), ("y", " ")]).collect()
    assert [r.error for r in handed] == [None, "blank"]


RESULT = {
    "schema_version": "1", "model": "m", "requirements": [{"id": "req_1", "value": "Go", "refs": ["s1"], "tier": "required", "importance": 1.0}, {"id": "req_2", "value": "SQL", "refs": ["s1"], "tier": "preferred", "importance": 0.5}],
    "alternative_groups": [{"id": "alt_1", "members": ["req_1", "req_2"]}], "context": {"s1": {"text": "Go or SQL", "section": "required"}},
}


def _problems(spark, tmp_path, change):
    body = json.loads(json.dumps(RESULT))
    change(body)
    (tmp_path / "r.json").write_text(json.dumps(body))
    rows = loaders.read_results(spark, str(tmp_path / "r.json"))
    return sorted(r.problem for r in loaders.result_violations(*loaders.result_tables(rows)).collect())


def test_results_and_their_rules(spark, tmp_path):
    assert _problems(spark, tmp_path, lambda b: None) == []

    def break_all(b):
        b["requirements"] += [{"id": "req_1", "value": " ", "refs": [], "tier": "must", "importance": 1.5}, {"id": "", "value": "x", "refs": ["s9"], "tier": "required", "importance": 0.0}]
        b["alternative_groups"] += [{"id": "alt_1", "members": ["req_2"]}, {"id": "", "members": ["req_2", "req_7"]}]
        b["context"]["s2"] = {"text": "t", "section": "nowhere"}

    assert _problems(spark, tmp_path, break_all) == sorted([
        "context s2: unknown section", "requirement req_1: duplicate id", "requirement req_1: empty value", "requirement req_1: unknown tier", "requirement req_1: importance outside [0, 1]", "requirement req_1: no refs",
        "requirement 3: empty id", "requirement : ref s9 not in context", "alternative group alt_1: duplicate id", "alternative group alt_1: fewer than 2 members", "alternative group 2: empty id", "alternative group : unknown member req_7",
        "requirement req_2: in groups alt_1 and alt_1 and ",
    ])
    (tmp_path / "old.json").write_text(json.dumps(RESULT | {"schema_version": "0"}))
    (tmp_path / "bad.json").write_text("{")
    errors = {r.posting_id: r.error for r in loaders.read_results(spark, str(tmp_path)).collect()}
    assert errors == {"r": None, "old": 'schema_version "0", want "1"', "bad": "not JSON"}


def test_golden_labels(spark, tmp_path):
    for name in ("golden", "checker", "resumes"):
        (tmp_path / name).mkdir()
    labels = {"requirements": [{"value": "Go", "aliases": ["Golang"], "tier": "required"}, {"value": "SQL", "tier": "preferred"}], "alternative_groups": [["Go", "SQL"]], "acceptable": ["Git"], "filler": []}
    for name in ("job1", "job2"):
        (tmp_path / "golden" / f"{name}.expected.json").write_text(json.dumps(labels))
        (tmp_path / "golden" / f"{name}.txt").write_text("Engineer\nGo and SQL")
    (tmp_path / "golden" / "nolabels.txt").write_text("x")
    rows = loaders.read_golden(spark, str(tmp_path / "golden"))
    assert sorted(r.fixture_id for r in rows.collect()) == ["job1", "job2"] and rows.first().title == "Engineer"
    assert loaders.read_golden(spark, str(tmp_path / "golden"), ("job2",)).count() == 1
    assert [(r.exp_ord, r.value, r.aliases) for r in loaders.expected(rows.where("fixture_id = 'job1'")).collect()] == [(0, "Go", ["Golang"]), (1, "SQL", None)]
    (tmp_path / "resumes" / "ann.md").write_text("# Skills\nGo")
    (tmp_path / "checker" / "p.expected.json").write_text(json.dumps({"job": "job1", "resume": "ann", "skip": ["SQL"], "links": {"Go": [{"quote": "Go", "strength": "weak"}]}}))
    pairs = loaders.read_checker_golden(spark, str(tmp_path / "checker"), str(tmp_path / "golden"), str(tmp_path / "resumes"))
    assert pairs.first().resume_text == "# Skills\nGo" and loaders.labelled_links(pairs).first().quote == "Go"
    (tmp_path / "checker" / "q.expected.json").write_text(json.dumps({"job": "nothing", "resume": "ann", "links": {}}))
    with pytest.raises(Exception, match="unknown job nothing"):
        loaders.read_checker_golden(spark, str(tmp_path / "checker"), str(tmp_path / "golden"), str(tmp_path / "resumes")).collect()


def test_pairs_reports_and_traces(spark, tmp_path):
    ref = tmp_path / "ref"
    ref.mkdir()
    (ref / "a.txt").write_text("Job A")
    (tmp_path / "ann.md").write_text("Ann")
    pair = lambda i, **k: {"id": i, "title": "A", "resume": "ann.md", "jd": "a.txt", **k}
    (ref / "pairs.json").write_text(json.dumps({"pairs": [pair("p1", subset=True, score=50), pair("p2", subset=False), pair("q3", subset=False, score=7)]}))
    (ref / "current.json").write_text(json.dumps({"pairs": [{"pair": "p1", "score": 61.5}, {"pair": "q3", "score": 5}]}))
    got = lambda which, only=(): {r.pair_id: (r.posting, r.resume, r.reference, r.saved) for r in loaders.read_pairs(spark, str(ref), str(tmp_path), which, only).collect()}
    assert got("subset") == {"p1": ("Job A", "Ann", 61.5, 50)} and set(got("current")) == {"p1", "q3"} and set(got("all")) == {"p1", "p2", "q3"} and set(got("all", ("p",))) == {"p1", "p2"}
    with pytest.raises(ValueError, match="want subset"):
        got("some")
    h = {"role_match": 0.5, "experience_short": 0.25, "blocker": 0.0}
    for n, fit in ((1, 40), (2, 60)):
        (tmp_path / f"rep{n}.json").write_text(json.dumps({"pairs": [{"id": "p1", "title": "A", "reference": 61.5, "match": 70, "fit": fit, "holistic": h}, {"id": "bad", "title": "B", "reference": 1, "fit": 3, "holistic": h, "error": "x"}, {"id": "nofit", "title": "B", "reference": 1, "holistic": h}]}))
    report = loaders.read_report(spark, str(tmp_path / "rep*.json"))
    row = loaders.fit_rows(report).collect()
    assert [(r.pair, r.n, r.fit, r.role_match) for r in row] == [("p1", 2, 50.0, 0.5)]
    probes = spark.createDataFrame([("p1", "role_match", 2.0, None), ("p1", "role_match", 4.0, None), ("p1", "blocker", None, 0.5)], "pair string, question string, score double, noul double")
    probed = loaders.probe_rows(loaders.fit_rows(report), probes, {"role_match": 5}).first()
    assert (probed.role_match, probed.blocker, probed.experience_short, probed.fit) == (0.75, 0.5, None, 50.0)
    (tmp_path / "rep1-traces").mkdir()
    (tmp_path / "rep1-traces" / "p1.json").write_text("{}")
    assert loaders.read_traces(spark, str(tmp_path / "rep1.json")).first().fixture_id == "p1" and loaders.read_traces(spark, str(tmp_path / "rep2.json")).count() == 0
    final = spark.createDataFrame([("f1",)], "pair_id string")
    subset = spark.createDataFrame([("p1", True), ("p9", True)], "pair_id string, subset boolean")
    assert {(r.pool, r.pair_id) for r in loaders.probe_pairs(subset, spark.createDataFrame([("p1",)], "pair_id string"), final).collect()} == {("subset", "p1"), ("final", "f1")}
