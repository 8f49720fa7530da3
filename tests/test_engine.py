import duckdb
import pytest

from gristmill.functions import text as T
from gristmill.functions.dialect import DUCK, SPARK
from gristmill.operators import posting, ranks, resume, score
from gristmill.plans import catalog
from gristmill.streaming.score_stream import score_stream

SF = "/root/testdata/sf0.001"


def _sql(spark, d, expression, **values):
    row = ", ".join(f"{d.lit(v)} AS {k}" for k, v in values.items())
    if d is SPARK:
        return spark.sql(f"SELECT {expression} AS r FROM (SELECT {row}) x_").first().r
    return duckdb.connect().execute(f"SELECT {expression} AS r FROM (SELECT {row}) x_").fetchall()[0][0]


@pytest.mark.parametrize("d", [SPARK, DUCK], ids=["spark", "duck"])
def test_text_operators(spark, d):
    run = lambda e, **v: _sql(spark, d, e, **v)
    assert list(run(T.split_line(d, "s"), s="Use Go, e.g. Gin etc. daily. Ship it! (Fast) Dr. Who helps.")) == ["Use Go, e.g. Gin etc. daily.", "Ship it!", "(Fast) Dr. Who helps."]
    assert run(T.strip_label(d, "s"), s="Deep Backend Expertise: A strong command of Go") == "A strong command of Go"
    assert run(T.strip_label(d, "s"), s="Kubernetes: operators") == "Kubernetes: operators"
    assert run(T.strip_label(d, "s"), s="Bonus: Rust") == "Rust"
    assert run(T.stem(d, "s"), s="mentorship") == run(T.stem(d, "s"), s="mentoring") == "mentor"
    assert run(T.normal(d, "s"), s="C++ / “Node.js” — CI/CD!") == "c++ / node.js ci/cd"
    assert run(T.is_generic_only(d, "s"), s="Hands-on experience") and not run(T.is_generic_only(d, "s"), s="5+ years of Go")
    assert list(run(T.split_slashes(d, "s"), s="TypeScript/Node.js")) == ["TypeScript", "Node.js"]
    assert list(run(T.split_slashes(d, "s"), s="CI/CD")) == ["CI/CD"]
    assert run(T.truncate_words(d, "s", 11), s="alpha beta gamma") == "alpha beta"
    assert run(T.resume_section(d, "s"), s="Project Experience") == "projects"


def test_headings_and_chunks(spark):
    spark.createDataFrame([(1, "Title here\n# What You Bring\n- Go, SQL and Docker\nUse it. Love it.")], "doc_id long, text string").createOrReplaceTempView("src")
    rows = spark.sql(f"SELECT * FROM {posting.sentences(SPARK, 'src')} q ORDER BY ord").collect()
    assert [(r.text, r.heading, r.strong) for r in rows] == [("Title here", "Title here", False), ("What You Bring", "What You Bring", True), ("Go, SQL and Docker", "What You Bring", False), ("Use it.", "What You Bring", False), ("Love it.", "What You Bring", False)]
    spark.createDataFrame([(1, "Go, SQL and Docker such as Compose")], "doc_id long, text string").createOrReplaceTempView("src")
    assert [r.text for r in spark.sql(f"SELECT * FROM {posting.chunks(SPARK, 'src', 'doc_id')} q ORDER BY chunk_no").collect()] == ["Go", "SQL", "Docker", "Compose"]


def test_resume_units(spark):
    text = "Ann\n# Experience\n## Engineer | Acme | 2020\n- Built it\nand ran it\n\nLed a team. Shipped.\n# Skills\nStack: a, b (c, d), e, f, g, h, i\n# Education\n## BSc | MIT | 2015"
    spark.createDataFrame([(1, text)], "doc_id long, text string").createOrReplaceTempView("src")
    rows = spark.sql(f"SELECT * FROM {resume.units(SPARK, 'src')} q ORDER BY ord").collect()
    assert [(r.text, r.section, r.role) for r in rows] == [
        ("Built it and ran it", "experience", "Engineer"), ("Led a team.", "experience", "Engineer"), ("Shipped.", "experience", "Engineer"),
        ("Stack: a, b (c, d), e, f", "skills", ""), ("Stack: g, h, i", "skills", ""), ("BSc, MIT", "education", "BSc"),
    ]


def test_match_and_fit(spark):
    one = spark.createDataFrame([("a", 0.9875, 0.13, 0.05)], "pair string, role_match double, experience_short double, blocker double")
    assert score_stream(one).first().score == 87
    assert score_stream(one.selectExpr("pair", "CAST(NULL AS DOUBLE) AS role_match", "experience_short", "blocker")).first().score is None
    coverage = spark.createDataFrame([("p", 1, "r1", "required", "strong"), ("p", 2, "r2", "preferred", "none"), ("p", 3, "r3", "required", "none"), ("p", 4, "r4", None, "weak")], "pair string, req_ord int, req_id string, tier string, coverage string")
    members = spark.createDataFrame([("p", 1, "g1", "r1"), ("p", 1, "g1", "r2")], "pair string, group_ord int, group_id string, member_id string")
    row = score.score_fit(coverage, members).first()
    assert row.fit == round(100 * (3 * 1 + 0 + 1 * 0.3) / 7) and row.gaps == ["r3"]
    assert score.score_fit(coverage.where("false"), members).count() == 0
    # a table of credits without an entry counts it as 0, in the tiers too
    half = spark.createDataFrame([("p", 1, "r1", "required", "strong"), ("p", 2, "r2", "required", "none"), ("q", 1, "r1", "required", "none")], "pair string, req_ord int, req_id string, tier string, coverage string")
    fits = {r.pair: (r.fit, r.by_tier) for r in score.score_fit(half, members.where("false"), {"strong": 1.0, "partial": 0.6, "weak": 0.3}).collect()}
    assert fits == {"p": (50, {"required": 50}), "q": (0, {"required": 0})}
    ties = spark.createDataFrame([(1, 1, 1, 1), (1, 2, 1, 2), (1, 3, 2, 3)], "grp int, id int, x int, y int")
    assert ranks.kendall_tau_b(ties).first().tau == pytest.approx(2 / 6**0.5)


@pytest.mark.parametrize("name", ["m1_match_score", "a10_score_fit", "o2_retrieve", "t25_normalize", "f15_skip", "w3_carry_forward"])
def test_queries_match_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "documents", "customer", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours = catalog.queries()[name](spark, SF)
    cols = sorted(ours.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({catalog.oracle_sql()[name]}) q").fetchall()
    assert sorted(map(str, map(tuple, ours.select(*cols).collect()))) == sorted(map(str, want))
