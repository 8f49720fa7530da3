import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from gristmill.llm import impacts

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, size = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        scores = []
        for i, c in counted:
            m = 50 + 50 * sum(c.values()) * n // size
            scores.append((-sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in words if t in c), i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(x for x in scores if x[0])[:k])]
    return sorted(out, key=lambda r: (r[0] is None, r[:2]))


def _text(rng, n):
    return rng.choice([" ", "-", "\x00"]).join(rng.choice(["Alpha", "beta", "GAMMA9", "é", "Éa", "naïve", "x" * 9]) if rng.random() < 0.3 else f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    docs = [(i, _text(rng, rng.choice([0, 3, 20, 20, 60, 400]))) for i in range(600)]
    docs += [(1000 + i, docs[2][1] or "beta") for i in range(150)]  # ties
    docs += [(5, docs[5][1]), (None, "Alpha beta w1"), (2000, None), (2001, ""), (2002, "!? ."), (2003, "w1 " * 30_000)]
    items = [(i, _text(rng, rng.choice([1, 4, 30, 90]))) for i in range(20)] + [(30, None), (31, ""), (32, "Alpha"), (32, "w1 w1"), (None, "beta w2"), (33, "nowhere")]
    return docs, items


@pytest.mark.parametrize("shard, block", [(1 << 20, 1 << 19), (300, 60)])
def test_equals_brute_force(spark, corpus, monkeypatch, shard, block):
    docs, items = corpus
    monkeypatch.setattr(impacts, "SEGMENT", 50)
    table = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, item string, score int").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = impacts.search(table, asked, shard_postings=shard, block_terms=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[0] is None, r[:2])) == brute(docs, items)


def test_stops_early_and_loses_nothing():
    """A few documents far ahead: the search stops, and floors from other indexes leave ties in."""
    rng = np.random.default_rng(2)
    n, terms = 3000, 40
    doc, term = np.divmod(np.flatnonzero(rng.random(n * terms) < 0.3), terms)
    tf = np.where(doc < 60, 50, 1 + rng.integers(0, 3, len(doc)))
    norm = 50 + rng.integers(1, 200, n)
    index = impacts.Index(doc, term, tf, norm, terms)
    asked, weight = np.arange(terms), 1 + rng.integers(0, 5000, terms)
    whole = np.zeros(n, np.int64)
    np.add.at(whole, doc, weight[term] * (10**9 * tf // (1000 * tf + 20 * norm[doc])))
    completed = []
    index._complete, plain = lambda *a: completed.append(len(a[0])) or plain(*a), index._complete
    for floor in (0, int(np.sort(whole)[-20])):
        found, score = index.search(asked, weight, 50, floor)
        assert (score == whole[found]).all()
        kth = max(floor, int(np.sort(whole)[-50]))
        assert set(np.flatnonzero(whole >= kth)) <= set(found)
    assert completed and max(completed) < n // 4


def test_sql_gives_the_same(spark, corpus):
    docs = [(i, t) for i, t in dict(corpus[0]).items() if i is not None and "\x00" not in (t or "")]
    items = [(i, t) for i, t in corpus[1] if i is not None and "\x00" not in (t or "")]
    import pandas as pd

    with duckdb.connect() as db:
        db.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
        db.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
        assert sorted(db.sql(impacts.search_sql()).fetchall()) == brute(docs, items)


def test_empty_tables(spark, corpus, odd_docs, no_docs):
    asked = spark.createDataFrame(corpus[1], "item_id long, text string")
    assert impacts.search(no_docs, asked).count() == 0
    assert impacts.search(odd_docs, asked.where("false")).count() == 0
    named = spark.createDataFrame([("a", "the quick fox"), ("b", "no id")], "item_id string, text string")
    rows = impacts.search(odd_docs, named, k=3).collect()
    assert [(r["rank"], r.doc_id) for r in rows if r.item_id == "a"] == [(1, 1), (2, 2), (3, 2)]
    assert next(r for r in rows if r.item_id == "b").doc_id is None
