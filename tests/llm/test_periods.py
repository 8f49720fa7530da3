import hashlib
import random
import re
import zlib

import numpy as np

from gristmill.llm import periods


def brute(words, fewest=12):
    """Every maximal stretch at every lag; kept if no smaller lag is a period of it."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(fewest, 2 * q):
                whole = words[i : i + length]
                if not any(all(whole[k] == whole[k + d] for k in range(length - d)) for d in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out)


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected(doc_id, text):
    words = planted(doc_id, text)
    found = brute(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def strings():
    rng = random.Random(4)
    for _ in range(400):
        n = rng.choice([0, 1, 11, 12, 13, 40, 90, 150, 220])
        letters = rng.choice([1, 2, 2, 3, 30])
        yield [rng.randrange(letters) for _ in range(n)]
    for _ in range(200):  # repeats of repeats, with faults
        unit = [rng.randrange(3) for _ in range(rng.randint(1, 30))]
        s = [rng.randrange(5) for _ in range(rng.randint(0, 20))] + unit * rng.randint(2, 9) + unit[: rng.randrange(len(unit) + 1)]
        for _ in range(rng.choice([0, 0, 1, 3])):
            s[rng.randrange(len(s))] = rng.randrange(5)
        yield s + s[: rng.randrange(len(s))]
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a
    yield b  # Fibonacci words are full of runs
    yield ([0, 1] * 20 + [0]) * 4


def test_runs_equal_brute_force():
    for s in strings():
        assert periods.runs(np.array(s, np.int64)) == brute(s), s


def test_long_and_hot_texts_are_quick():
    rng = np.random.default_rng(3)
    n = 200_000
    assert periods.runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    unit = rng.integers(0, 5000, n // 7)
    assert (100, 7 * len(unit), len(unit)) in periods.runs(np.concatenate([np.arange(6000, 6100), np.tile(unit, 7)]))
    assert periods.runs(np.arange(n)) == []


def test_digest_equals_brute_force(spark, odd_docs):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("ab cd ef gh ij kl".split()) + rng.choice(["", "", " x", "é"]) for _ in range(rng.randint(0, 120))) + rng.choice(["", " \x0b\x0c\r\n\t", "\x85 z"])) for i in range(150)]
    rows += [(-7, "a b c " * 30), (None, "a b " * 20), (3, None), (4, ""), (4, ""), (5, " \n ")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, runs string, h int")
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    got = sorted((tuple(r) for r in periods.digest(docs).collect()), key=key)
    assert got == sorted((expected(*r) for r in rows), key=key)
    assert periods.digest(docs).columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    odd = {r.doc_id: r for r in periods.digest(odd_docs).collect()}
    assert odd[6].n_runs == 1 and odd[6].length == 30_000 and odd[3].n_runs == odd[7].n_runs == 0


def test_collapse_keeps_columns(spark, odd_docs, no_docs):
    out = periods.collapse(odd_docs)
    assert out.columns == [*odd_docs.columns, "runs", "collapsed"]
    assert {r.doc_id: r.collapsed for r in out.collect()}[6] == "word"
    clash = periods.collapse(odd_docs.withColumnRenamed("fp", "Runs"))
    assert clash.columns[-2:] == ["runs_", "collapsed"] and clash.count() == odd_docs.count()
    assert periods.digest(no_docs).count() == 0


def test_texts_without_words_repeat_nothing(spark):
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, ("", " ", "\n\t ", None)[k % 4]) for k, i in enumerate(ids)]
    got = sorted(tuple(r) for r in periods.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert len(got) > 20
    assert got == [expected(i, t) for i, t in rows]
