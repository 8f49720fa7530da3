import time

import numpy as np
import pytest

from gristmill.operators import ranks


def brute(x, y):
    """(tau, share of pairs with different x that y orders alike, ties a half)."""
    dx, dy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    up = np.triu(np.ones((len(x), len(x)), bool), 1)
    c, nx, ny = (dx * dy)[up].sum(), np.abs(dx)[up].sum(), np.abs(dy)[up].sum()
    apart = np.abs(dx)[up] == 1
    right = np.where((dx * dy)[up] == 1, 1.0, np.where(dy[up] == 0, 0.5, 0.0))[apart]
    return (c / np.sqrt(float(nx) * ny) if nx and ny else 0.0), (right.mean() if apart.any() else None)


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(5)
    out = {"tiny": (np.array([1]), np.array([2])), "flat": (np.ones(5), np.arange(5)), "two": (np.array([1, 2]), np.array([2, 1]))}
    for name, n, kinds in (("small", 40, 9), ("ties", 900, 12), ("free", 1100, 10_000)):
        x = rng.integers(0, kinds, n)
        out[name] = (x, x + rng.integers(0, kinds, n))
    x = np.where(rng.random(1500) < 0.4, 7, rng.integers(0, 500, 1500))  # a hot value of x, and one of y
    out["hot"] = (x, np.where(rng.random(1500) < 0.4, 3, rng.integers(0, 500, 1500)))
    out[None] = (rng.integers(0, 50, 200), rng.integers(0, 50, 200))
    return out


@pytest.mark.parametrize("bucket, cuts", [(1 << 17, 2048), (50, 2048), (100, 7)])
def test_equals_all_pairs(spark, groups, monkeypatch, bucket, cuts):
    monkeypatch.setattr(ranks, "BUCKET", bucket)
    monkeypatch.setattr(ranks, "MOST_CUTS", cuts)
    rows = [(g, i, int(a), float(b)) for g, (x, y) in groups.items() for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame([*rows, ("small", 99, None, 1.0), ("ties", 99, 1, None)], "grp string, id int, x long, y double").repartition(5)
    tau = {r.grp: r.tau for r in ranks.kendall_tau_b(df).collect()}
    order = {r.grp: r.tier_order for r in ranks.tier_order(df, "grp", "x", "y").collect()}
    assert set(tau) == set(groups)
    for g, (x, y) in groups.items():
        want = brute(x.astype(float), y.astype(float))
        assert tau[g] == pytest.approx(want[0]) and order[g] == pytest.approx(want[1]), g
    assert ranks.kendall_tau_b(df.where("false")).count() == 0


def test_a_group_of_a_million(spark):
    """Against the closed form of a sequence whose inversions are known: blocks of k rows in reverse order."""
    n, k = 1_000_000, 1000
    df = spark.range(n).selectExpr("1 AS grp", "id AS x", f"id - id % {k} + {k - 1} - id % {k} AS y")
    began = time.time()
    row = ranks.pair_counts(df, "grp", "x", "y").first()
    assert row.disordered == n // k * (k * (k - 1) // 2) and row.pairs == n * (n - 1) // 2
    assert time.time() - began < 120
