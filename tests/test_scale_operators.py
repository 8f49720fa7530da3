"""Operators that must not square a group, against brute force and on groups that would not survive it."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.functions import lexicon as X
from gristmill.operators import digests, folds, quotes, refine, resample, similar


def test_folds_see_whole_keys(spark):
    """Keys across Arrow batches, nulls among them, each seen once and in order."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(k, i) for k in ["a", "b", None, "d", "e"] for i in range({"a": 50, "b": 1, None: 20, "d": 7, "e": 3}[k])]
        random.Random(1).shuffle(rows)

        def fold(table, group):
            import pyarrow as pa

            assert table.column("i").to_pylist() == [i for n in np.bincount(group) for i in range(n)]
            return pa.table({"k": table.column("k").take(pa.array(folds.firsts(group))), "n": pa.array(np.bincount(group))})

        got = folds.by_key(spark.createDataFrame(rows, "k string, i long"), ["k"], ["i"], "k string, n long", fold).collect()
        assert sorted(((r.k or "", r.n) for r in got)) == [("", 20), ("a", 50), ("b", 1), ("d", 7), ("e", 3)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_folds_over_joins_that_become_broadcasts(spark):
    """A sort-merge join on the key, replaced by a broadcast while running, must not scatter a key."""
    import pyarrow as pa

    big, small = spark.range(2000).select((F.col("id") % 3).alias("k"), "id").repartition(4), spark.range(30).select((F.col("id") % 3).alias("k"), (F.col("id") * 0).alias("z")).distinct()
    joined = big.join(small, "k")
    rows = joined.where("id % 2 = 0").unionByName(joined.where("id % 2 = 1"))
    fold = lambda table, group: pa.table({"k": table.column("k").take(pa.array(folds.firsts(group))), "n": pa.array(np.bincount(group))})
    got = folds.by_key(rows, ["k"], ["id"], "k long, n long", fold).collect()
    assert sorted((r.k, r.n) for r in got) == [(0, 667), (1, 667), (2, 666)]


@pytest.mark.parametrize("kind", ["string", "long"])
def test_components_equal_search(spark, kind):
    rng = random.Random(2)
    name = (lambda i: f"n{i}") if kind == "string" else (lambda i: i)
    links = [(k, name(rng.randrange(60)), name(rng.randrange(60))) for k in ("p", "q", None) for _ in range(35)] + [("p", None, name(1))]
    got = {(r.k, r.node): r.component for r in refine.components(spark.createDataFrame(links, f"k string, a {kind}, b {kind}"), "k").collect()}
    for k in ("p", "q", None):
        near = {}
        for kk, a, b in links:
            if kk == k and a is not None:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        for node in near:
            seen, todo = {node}, [node]
            while todo:
                for other in near[todo.pop()] - seen:
                    seen.add(other)
                    todo.append(other)
            assert got.pop((k, node)) == min(seen)
    assert not got


def test_a_key_with_many_links(spark):
    """A chain of 100,000 nodes in one key, its links in disorder; and as many edges to match."""
    n = 100_000
    links = spark.range(n - 1).select(F.lit(1).alias("k"), F.col("id").alias("a"), (F.col("id") + 1).alias("b")).orderBy(F.rand(1))
    began = time.time()
    assert refine.components(links, "k").select("component").distinct().collect() == [(0,)]
    edges = spark.range(n).select(F.lit("x").alias("k"), (F.col("id") % 1000).alias("l"), (F.col("id") * 7 % 1500).alias("r"), (F.col("id") * 31 % n).alias("o"))
    taken = refine.greedy_match(edges, "k", "l", "r", ["o"]).collect()
    assert len({t.l for t in taken}) == len({t.r for t in taken}) == len(taken) == 1000
    assert time.time() - began < 60


def test_holders_equal_a_nested_loop(spark, monkeypatch):
    rng = random.Random(3)
    words = "alpha beta gamma delta é 漢字 a b".split()
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(80)] + [(100, None), (101, "")]
    some = [(i, t[rng.randrange(max(1, len(t))) :][: rng.randint(0, 60)]) for i, (_, t) in enumerate(texts[:40])] + [(50, "a"), (51, "nowhere"), (52, None), (53, ""), (54, "a")]
    expected = sorted((q, t) for q, a in some for t, b in texts if a is not None and b is not None and a in b)
    quoted, held = spark.createDataFrame(some, "q long, text string"), spark.createDataFrame(texts, "t long, text string")
    assert sorted(map(tuple, quotes.holders(quoted, held, "q", "t").collect())) == expected
    monkeypatch.setattr(quotes, "PART_CHARS", 100)
    assert sorted(map(tuple, quotes.holders(quoted, held, "q", "t").collect())) == expected
    once = sorted((q, ts[0]) for q in {q for q, _ in expected} if len(ts := [t for p, t in expected if p == q]) == 1)
    assert sorted(map(tuple, quotes.resolved(quoted, held, "q", "t").collect())) == once
    assert quotes.holders(quoted.where("false"), held, "q", "t").count() == 0


def _similar(a, b):
    plain = {*X.STOPWORDS, *X.GENERIC, ""}
    if (set(a.lower().split()) - plain) & (set(b.lower().split()) - plain):
        return True
    grams = [{f" {s} "[i : i + 3] for i in range(len(s))} for s in (a, b)]
    both = len(grams[0] & grams[1])
    union = len(grams[0]) + len(grams[1]) - both
    return union > 0 and both / union >= X.TRIGRAM_SIMILAR


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    names = ["kubernetes", "kubernete", "python", "pythons", "pythonic", "sql", "nosql", "data lakes", "data lake", "go", "golang", "the", "strong", "", "postgres", "postgresql", "mysql", "React.js", "react", "ci/cd"]
    rows = [(g, i, rng.choice(names) + rng.choice(["", "", " " + rng.choice(names), "s"])) for g, n in (("a", 60), ("b", 12), ("c", 41), ("d", 40)) for i in range(n)] + [("a", 99, None), (None, 1, "python"), (None, 2, "python")]
    df = spark.createDataFrame(rows, "g string, i long, v string")
    want = {(g, i, j) for g, i, v in rows for h, j, w in rows if g == h and g and i < j and v is not None and w is not None and _similar(v, w)}
    got = [tuple(r) for r in similar.similar_pairs(df, "g", "i", "v").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    offers = {tuple(r) for r in similar.offered(df.where("v IS NOT NULL AND g IS NOT NULL"), "g", "i", "v").collect()}
    size = {"a": 60, "b": 12, "c": 41, "d": 40}
    every = {(g, i, j) for g, i, v in rows for h, j, w in rows if g == h and g and i != j and v is not None and w is not None and (size[g] <= X.ALL_PAIRS or _similar(v, w))}
    assert offers == every


def test_resampled_intervals(spark):
    """Weights are Poisson of mean 1 and independent; the interval is that of the mean's normal limit."""
    n = 20_000
    df = spark.range(n).select((F.col("id") % 2).alias("g"), "id", (F.col("id") * 7919 % 1000 / 10).alias("e"))
    w = resample.weights(df, "g", "id", "e", 200).toPandas()
    counts = w[w.g == 0].n.to_numpy()
    assert abs(counts.mean() - n / 2) < 4 * np.sqrt(n / 2 / 200) and abs(counts.var() / (n / 2) - 1) < 0.35
    rows = {r.g: r for r in resample.interval(df, "g", "id", "e").collect()}
    values = np.array([i * 7919 % 1000 / 10 for i in range(n)])
    for g in (0, 1):
        mine = values[np.arange(n) % 2 == g]
        error = mine.std() / np.sqrt(len(mine))
        assert rows[g].reps == 200
        assert rows[g].low == pytest.approx(mine.mean() - 1.96 * error, abs=0.5 * error)
        assert rows[g].high == pytest.approx(mine.mean() + 1.96 * error, abs=0.5 * error)
    again = {r.g: (r.low, r.high) for r in resample.interval(df.repartition(13), "g", "id", "e").collect()}
    assert again[0] == pytest.approx((rows[0].low, rows[0].high))
    assert resample.interval(df.where("false"), "g", "id", "e").count() == 0


def test_one_report_of_millions(spark):
    df = spark.range(300_000).select(F.lit("r").alias("g"), "id", (F.col("id") % 11).alias("e"))
    began = time.time()
    (row,) = resample.interval(df, "g", "id", "e").collect()
    assert row.low < 5 < row.high and row.high - row.low < 0.05 and time.time() - began < 120


def test_digest_of_labels(spark):
    rows = [(i, f"content {i % 7}") for i in range(300)] + [(None, "x"), (5, None), (6, "content 6")]
    make = lambda r, n: digests.labels_hash(spark.createDataFrame(r, "id long, c string").repartition(n), "id", F.col("c")).first().labels_hash
    known = make(rows, 1)
    assert len(known) == 12 and known == make(rows[::-1], 9)
    changed = {make(rows[:-1], 2), make([*rows[:10], (10, "other"), *rows[11:]], 2), make([*rows[:10], (10, rows[11][1]), (11, rows[10][1]), *rows[12:]], 2), make([(None, "x"), (5, "null")], 1), make([(None, "x"), (5, None)], 1)}
    assert len(changed) == 5 and known not in changed
    empty = digests.labels_hash(spark.createDataFrame([], "id long, c string"), "id", F.col("c")).collect()
    assert len(empty) == 1


def test_skills_chunks_shuffle_nothing(spark):
    """A line goes with none of its pieces: its chunks are cut inside the row."""
    from gristmill.functions.dialect import SPARK
    from gristmill.operators import resume

    lines = [(1, "Stack: a, b (c, d), e, f, g [h, i], j, k, l"), (2, "a, b"), (3, "x), y, (z, w, v"), (4, ""), (5, None), (6, ", ".join(f"i{k}" for k in range(13)))]
    spark.createDataFrame(lines, "k int, line string").createOrReplaceTempView("skill_lines")
    out = spark.sql(f"SELECT * FROM {resume.skills_chunks(SPARK, 'skill_lines', 'k', 'line')} q_")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate [" not in plan
    got = sorted((r.k, r.part, r.piece) for r in out.collect())
    assert got == [
        (1, 0, "Stack: a, b (c, d), e, f"), (1, 1, "Stack: g [h, i], j, k, l"), (2, 0, "a, b"), (3, 0, "x), y, (z, w, v"), (4, 0, ""),
        (6, 0, "i0, i1, i2, i3, i4"), (6, 1, "i5, i6, i7, i8"), (6, 2, "i9, i10, i11, i12"),
    ]


def test_trigrams_are_packed_exactly(spark):
    grams = ["abc", " ab", "é€x", "😀a😀", "\U0010ffff\U0010ffff\U0010ffff", "acb"]
    got = [r.n for r in spark.createDataFrame([(g,) for g in grams], "g string").select(similar.packed(F.col("g")).alias("n")).collect()]
    assert got == [ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2]) for g in grams]


def test_options_tokenize_twice_only_where_something_is_split(spark):
    from gristmill.functions.dialect import SPARK
    from gristmill.operators import candidates, posting
    from gristmill.plans.dual import run

    texts = ["strong Python/Django skill", "SQL a/b testing", "years of work", "Go\x03x api design", "plain data pipelines in the cloud", "CI/CD and C/C++ tools", "/ x", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "1L AS ord", "text")
    got = candidates.options(rows, "text")
    want = run(spark, lambda t: f"SELECT doc_id, ord, chunk_no, opt_ord, option FROM {posting.options(SPARK, t('s'), 'doc_id, ord')} q_", s=rows)
    key = lambda r: (r.doc_id, r.chunk_no, r.opt_ord, r.option)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert "instr(" in got._jdf.queryExecution().optimizedPlan().toString()


def test_small_groups_travel_once_and_large_ones_are_met_alike(spark):
    rng = random.Random(5)
    names = ["kubernetes", "python", "pythons", "data lakes", "data\tlake", "go", "the", "", "é€x", "😀😀 lake", "İstanbul", "strong python"]
    rows = [(g, i, rng.choice(names) + rng.choice(["", "s", " x", " " + rng.choice(names)])) for g, n in (("a", 30), ("b", 31), ("c", 1), ("d", 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i long, v string")
    pairs = lambda **k: sorted(tuple(r) for r in similar.similar_pairs(df, "g", "i", "v", **k).collect())
    assert pairs() == pairs(whole=30) == pairs(whole=0)
    small = similar.similar_pairs(df, "g", "i", "v")
    small.collect()
    # what ran: no row for each trigram or word, and no set of them in a shuffle
    ran = small._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "explode(" not in ran and "isFinalPlan=true" in ran
    # an id that stands twice has the words of both its values, and no pair with itself
    twice = spark.createDataFrame([("a", 1, "go"), ("a", 1, "sql go"), ("a", 2, "sql"), ("a", 3, "go")], "g string, i long, v string")
    assert sorted(tuple(r) for r in similar.similar_pairs(twice, "g", "i", "v").collect()) == [("a", 1, 2), ("a", 1, 3)]


def test_options_are_unique_without_a_running_list(spark):
    from gristmill.functions.dialect import SPARK
    from gristmill.operators import candidates, posting
    from gristmill.plans.dual import run

    long = " ".join(f"Word{i % 90} tool{i % 70}" for i in range(200))
    texts = ["year of Go", "Go years Go", "go GO Go go", "5+ the 12", "end.\u2028 next (x) [y] one", "“quoted” word—dash ’s", "a. b) strong (skills) in Rust!", "x/yy/zzz and abc/def GO", "strong experience years", "(((", "tool,\u0085 more", long, long.upper() + " " + long]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "1L AS ord", "text")
    got = candidates.options(rows, "text")
    want = run(spark, lambda t: f"SELECT doc_id, ord, chunk_no, opt_ord, option FROM {posting.options(SPARK, t('s'), 'doc_id, ord')} q_", s=rows)
    key = lambda r: (r.doc_id, r.chunk_no, r.opt_ord, r.option)
    found = sorted(map(key, got.collect()))
    assert found == sorted(map(key, want.collect())) and max(f[2] for f in found) == X.MAX_OPTIONS
    # each option was held against a growing list of those before, copied each time
    assert " aggregate(" not in got._jdf.queryExecution().optimizedPlan().toString()
