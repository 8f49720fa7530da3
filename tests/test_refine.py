from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import ask, extract, failures, fitting, refine
from gristmill.operators.prompts import Prompts
from gristmill.plans import catalog
from gristmill.settings import tuning

SF = "/root/testdata/sf0.001"


def test_batches_open_where_the_size_would_exceed_the_limit(spark):
    rows = spark.createDataFrame([("p", i, n) for i, n in enumerate([50, 40, 20, 200, 1, None])] + [("q", 0, 5)], "k string, o int, n long")
    got = refine.size_batches(rows, "k", "o", "n", limit=100).orderBy("k", "o").collect()
    assert [(r.k, r.batch) for r in got] == [("p", 0), ("p", 0), ("p", 1), ("p", 2), ("p", 3), ("p", 3), ("q", 0)]
    assert refine.size_batches(rows.where("false"), "k", "o", "n").count() == 0


def test_components_follow_chains(spark):
    links = spark.createDataFrame([("p", 5, 4), ("p", 3, 4), ("p", 9, 8), ("p", 3, 3), ("q", 4, 5)], "k string, a int, b int")
    got = {(r.k, r.node): r.component for r in refine.components(links, "k").collect()}
    assert got == {("p", 3): 3, ("p", 4): 3, ("p", 5): 3, ("p", 8): 8, ("p", 9): 8, ("q", 4): 4, ("q", 5): 4}


def test_greedy_match_is_one_to_one(spark):
    edges = spark.createDataFrame([("f", 1, 10, 0.5), ("f", 1, 11, 0.9), ("f", 2, 11, 1.0), ("f", 3, 10, 0.1)], "k string, e int, p int, s double").selectExpr("k", "e", "p", "-s AS far")
    got = {(r.e, r.p) for r in refine.greedy_match(edges, "k", "e", "p", ["e", "far", "p"]).collect()}
    assert got == {(1, 11), (3, 10)}


def test_leave_one_group_out_against_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(int(g), 1.0, *map(float, rng.random(2)), float(rng.integers(0, 101))) for g in rng.integers(0, 4, 60)]
    got = {r.g: r for r in fitting.leave_one_group_out(spark.createDataFrame(rows, "g int, c double, a double, b double, y double"), "g", ["c", "a", "b"], "y").collect()}
    m = np.array(rows)
    for g in range(4):
        rest, own = m[m[:, 0] != g], m[m[:, 0] == g]
        x = rest[:, 1:4]
        w = np.linalg.solve(x.T @ x + fitting.RIDGE * np.diag([0, 1, 1]), x.T @ rest[:, 4])
        e = np.round(np.clip(own[:, 1:4] @ w, 0, 100)) - own[:, 4]
        assert got[g].n == len(own) and got[g].mae == pytest.approx(np.abs(e).mean()) and got[g].bias == pytest.approx(e.mean())


def test_a_singular_fold_has_no_figures(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0, 5.0), (2, 0.0, 0.0, 5.0)], "g int, c double, a double, y double")
    assert [r.mae for r in fitting.leave_one_group_out(rows, "g", ["c", "a"], "y").collect()] == [None, None]


@pytest.mark.parametrize("name", ["w9_size_batches", "u3_alternative_components", "j13_greedy_match", "m11_leave_one_resume_out", "a3_build_result", "a22_labels_hash"])
def test_sequential_queries_match_recursive_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours = catalog.queries()[name](spark, SF)
    cols = sorted(ours.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({catalog.oracle_sql()[name]}) q").fetchall()
    assert sorted(map(str, map(tuple, ours.select(*cols).collect()))) == sorted(map(str, want))


def test_batch_starts_are_those_of_size_batches(spark):
    rows = [(k, o, n) for k, sizes in enumerate([[40, 40, 40, 5], [500, 1, 99, 1], [None, 100, 0], [100], [60, 60, 60]]) for o, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "k int, o int, n int")
    whole = df.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", F.struct("n").alias("n")))), lambda x: x["n"]["n"]).alias("ns"))
    got = {r.k: r["at"] for r in whole.select("k", refine.batch_starts(F.col("ns"), 100).alias("at")).collect()}
    want = refine.size_batches(df, "k", "o", "n", limit=100).groupBy("k", "batch").agg(F.min("o").alias("o")).collect()
    assert got == {k: sorted(r.o for r in want if r.k == k) for k in range(5)}
    assert spark.range(1).select(refine.batch_starts(F.array().cast("array<int>"), 100).alias("at")).first()["at"] == []


def test_refinement_shuffles_values_and_not_questions(spark):
    """Questions are built in the row of a posting, and what is written holds none of their text."""
    mention = F.array(F.struct(F.lit(1).cast("long").alias("ord"), F.lit("s1").alias("ref"), F.lit("required").alias("section"), F.lit("said").alias("sentence")))
    values = spark.range(6).select((F.col("id") % 2).alias("posting_id"), F.floor(F.col("id") / 2).cast("int").alias("i"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("value"), mention.alias("mentions"))
    states = spark.range(2).select(F.col("id").alias("posting_id"), F.lit("{}").alias("state"))
    requests = extract.refinement_requests(values, states, Prompts(tuning.load()))
    plan = requests._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and plan.count("Join ") == 1
    seen = []
    asked = ask.materialised
    ask.materialised = lambda df: (seen.append(df.columns), asked(df))[1]
    try:
        extract.refinement_round(values, states.select("posting_id", F.lit("t").alias("title"), F.lit("s").alias("summary")), ask.lexical, Prompts(tuning.load())).values.collect()
    finally:
        ask.materialised = asked
    assert seen == [["posting_id", "vs", "taken", "failed", "wrong"]]


def test_what_is_written_is_compressed(spark):
    before = {p for p in Path(failures.shared_folder(spark).removeprefix("file:")).iterdir()}
    rows = failures.materialised(spark.range(20_000).select(F.lit("the same long text of a question " * 20).alias("t"), "id"))
    new = [p for p in Path(failures.shared_folder(spark).removeprefix("file:")).iterdir() if p not in before]
    assert rows.count() == 20_000 and sum(f.stat().st_size for p in new for f in p.rglob("*") if f.is_file()) < 1_000_000


def test_questions_are_built_once(spark):
    """No filter of an explode works them out a second time, and questions that fit together are measured as one."""
    mention = F.array(F.struct(F.lit(1).cast("long").alias("ord"), F.lit("s1").alias("ref"), F.lit("required").alias("section"), F.lit("said").alias("sentence")))
    values = spark.range(9).select((F.col("id") % 2).alias("posting_id"), F.floor(F.col("id") / 2).cast("int").alias("i"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("value"), mention.alias("mentions"))
    states = spark.range(2).select(F.col("id").alias("posting_id"), F.lit("{}").alias("state"))
    prompts = Prompts(tuning.load())
    requests = extract.refinement_requests(values, states, prompts)
    assert requests._jdf.queryExecution().optimizedPlan().toString().count("'filler_'") + requests._jdf.queryExecution().optimizedPlan().toString().count("filler_,") <= 1
    whole = {r.posting_id: r.questions for r in requests.collect()}
    assert {k: len(q) for k, q in whole.items()} == {0: 20, 1: 16}
    # batches of any limit hold the same questions in the same order, and begin where their sizes say
    for limit in (1, 2000, 5000, 80_000):
        cut = extract.refinement_requests(values, states, prompts, limit=limit)
        for k, qs in whole.items():
            parts = [r.questions for r in cut.where(F.col("posting_id") == k).orderBy("batch").collect()]
            sizes = [r.n for r in spark.createDataFrame(qs, requests.schema["questions"].dataType.elementType).select(F.length(F.to_json(F.struct("*"))).alias("n")).collect()]
            want, used = [], 0
            for q, n in zip(qs, sizes, strict=True):
                if not want or used + n > limit:
                    want.append([])
                    used = 0
                want[-1].append(q)
                used += n
            assert parts == want
