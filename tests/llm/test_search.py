import numpy as np
import pytest

from gristmill.llm import anisotropic, mtree
from gristmill.llm import vectors as vectors_module


def _table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[100:160] = x[7]  # copies tie
    return x, _table(spark, [(i, x[i].tolist(), 0) for i in range(len(x))])


def test_anisotropic_recall(vectors):
    x, df = vectors
    got = {}
    for r in anisotropic.nearest(df, k=5, query_every=50).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    unit = x / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hit = 0
    for q in range(0, 900, 50):
        s = unit @ unit[q]
        order = [i for i in np.lexsort((np.arange(900), -s.round(9))) if i != q][:5]
        found = [v for _, v, _ in sorted(got[q])]
        hit += len(set(order) & set(found))
        assert [r for r, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
    assert hit / (18 * 5) >= 0.9


def test_mtree_is_exact(vectors):
    x, df = vectors
    z = np.floor(64 * x.astype(float)).astype(int)
    got = {}
    for r in mtree.top_products(df, k=20, query_every=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, 900, 20):
        s = z @ z[q]
        order = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:20]
        assert [(v, c) for _, v, c in sorted(got[q])] == [(i, s[i]) for i in order]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    df = _table(spark, [(0, [1.0, 0.0], 1), (20, None, 1), (40, [nan, 1.0], 1), (50, [inf, 1.0], 1), (60, [0.0, 0.0], 1), (100, [1.0, 1.0, 1.0], 1), (3, [1.0, None], 1), (None, [1.0, 1.0], 1)])
    assert {(r.query_id, r.vec_id) for r in anisotropic.nearest(df).collect()} == {(0, 100), (100, 0)}
    assert {(r.query_id, r.vec_id) for r in mtree.top_products(df).collect()} == {(0, 60), (0, 100), (60, 0), (60, 100), (100, 0), (100, 60)}
    empty = df.where("false")
    assert anisotropic.nearest(empty).count() == 0 and mtree.top_products(empty).count() == 0


def _clustered(n, rng, width=24, clusters=40):
    middle = rng.normal(size=(clusters, width)) * 3
    return (middle[rng.integers(clusters, size=n)] + rng.normal(size=(n, width))).astype(np.float32)


def test_searches_over_many_parts(spark, monkeypatch):
    """Parts, split cells and query blocks: recall of the one, exactness of the other, and no query sent everywhere."""
    monkeypatch.setattr(vectors_module, "CELL_ROWS", 100)
    monkeypatch.setattr(vectors_module, "QUERY_ROWS", 30)
    rng = np.random.default_rng(6)
    x = _clustered(3000, rng)
    x[500:1400] = x[3]  # a third of all rows are one vector
    df = _table(spark, [(i, x[i].tolist(), 0) for i in range(len(x))])
    unit = x / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hit, asked = 0, range(0, 3000, 50)
    got = {}
    for r in anisotropic.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in asked:
        s = unit @ unit[q]
        s[q] = -2
        worst = np.sort(s)[-5]
        assert [r for r, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
        hit += sum(s[v] >= worst - 1e-9 for _, v, _ in got[q])
    assert hit / (5 * len(asked)) >= 0.9
    z = np.floor(64 * x.astype(float)).astype(int)
    got = {}
    for r in mtree.top_products(df, k=20, query_every=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, 3000, 20):
        s = z @ z[q]
        order = [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:20]
        assert [(v, c) for _, v, c in sorted(got[q])] == [(i, s[i]) for i in order]
    ids, sample = np.arange(3000), x.astype(float)
    parts = mtree.Bounded(ids, sample, 30, 20, 64)
    own = parts.of(sample)
    stats = np.full((len(parts.centre), 2), -np.inf)
    np.maximum.at(stats, own, parts.measure(sample, own))
    assert len(parts.route(ids, sample, stats)[0]) < 0.8 * len(parts.centre) * 3000
    assert anisotropic.Probes(sample, 30, 5).probes < 15


def test_recall_on_the_embeddings(spark):
    """On the table of the queries, and on a full cell of vectors without clusters."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    rng = np.random.default_rng(2)
    for table, x in ((df, np.array([r.embedding for r in rows])), (None, rng.normal(size=(16384, 64)))):
        ids = np.array([r.vec_id for r in rows]) if table is not None else np.arange(len(x)) * 2
        table = table if table is not None else _table(spark, [(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)])
        unit = x / np.linalg.norm(x.astype(float), axis=1)[:, None]
        every = 50 if len(x) < 10_000 else 500
        hit = total = 0
        at = {int(i): n for n, i in enumerate(ids)}
        for r in anisotropic.nearest(table, query_every=every).collect():
            s = unit @ unit[at[r.query_id]]
            s[at[r.query_id]] = -2
            hit += s[at[r.vec_id]] >= np.sort(s)[-5] - 1e-9
            total += 1
        assert total == 5 * (ids % every == 0).sum() and hit / total >= 0.9


def test_extreme_components_and_repeated_rows(spark):
    df = _table(spark, [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (100, [1e30, 1e30], 1), (3, [1e-30, 1e-30], 1), (3, [1e-30, 1e-30], 1), (200, [-2.0, 0.5], 1)])
    near = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 6)) for r in anisotropic.nearest(df).collect()}
    assert near[100, 1] == (3, 1.0) and near[0, 1] == (3, round(2**-0.5, 6)) and near[0, 3][0] == 200 and len(near) == 9
    top = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in mtree.top_products(df).collect()}
    assert top[0, 1] == (100, 2**63 - 1) and top[0, 2] == (3, 0) and top[0, 3] == (200, -64 * 128) and top[100, 3] == (200, -(2**63))
