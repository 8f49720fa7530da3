import random

import numpy as np
import xxhash

from gristmill.llm import linespread, neardup, pfair, simhash, suffix


def _brute_print(text, n=3):
    w = text.lower().split()
    s = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_fingerprints():
    rng = random.Random(1)
    texts = [b" ".join(rng.choice([b"ab", b"The", b"x" * 40, b"longer\xc3\xa9", b"z" * 300]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    assert [_brute_print(t) for t in texts] == simhash.fingerprint_texts(texts, 3, 42).tolist()


def test_close_pairs():
    rng = np.random.default_rng(4)
    v = rng.integers(0, 64, 700).astype(np.uint64) | (rng.integers(0, 4, 700).astype(np.uint64) << np.uint64(62))
    g = np.sort(rng.integers(0, 9, 700))
    got = {(int(a), int(b)) for i, j in simhash.close_pairs(v, g, 3) for a, b in zip(i, j, strict=True)}
    assert got == {(i, j) for i in range(700) for j in range(i + 1, 700) if g[i] == g[j] and (int(v[i]) ^ int(v[j])).bit_count() <= 3}


def test_simhash_odd_documents(odd_docs, no_docs):
    rows = simhash.digest(simhash.near_duplicates(odd_docs)).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 10
    assert by[2].component_id == 1 and by[3].fingerprint == "0" * 16 and by[5].component_id == by[4].component_id == 3
    assert simhash.near_duplicates(no_docs).count() == 0


def test_suffix_blocks_against_dictionary():
    rng = random.Random(3)
    for alphabet in (b"ab", b"a", b"abcdefgh\0"):
        base = bytes(rng.choice(alphabet) for _ in range(300))
        texts, counts = [], []
        for _ in range(60):
            w, s = rng.randint(1, 20), rng.randint(0, 240)
            c = bytearray(base[s : s + w + 39])
            if rng.random() < 0.5:
                c[rng.randrange(len(c))] = rng.choice(alphabet)
            texts.append(bytes(c))
            counts.append(len(c) - 39)
        seen, want = set(), []
        for c, w in zip(texts, counts, strict=True):
            for o in range(w):
                want.append(c[o : o + 40] in seen)
                seen.add(c[o : o + 40])
        for block in (200, 1000, 1 << 20):
            assert suffix.repeated_windows(texts, np.array(counts), np.arange(60) << 20, 40, block).tolist() == want


def test_suffix_shards_between_anchors():
    rng = np.random.default_rng(6)
    anchors = np.sort(rng.integers(0, 40, 300))
    sizes = np.where(anchors == 7, 90, rng.integers(1, 9, 300))
    cuts = suffix.families(anchors, sizes, 100)
    assert [lo for lo, _ in cuts] == [0, *[hi for _, hi in cuts[:-1]]] and cuts[-1][1] == 300 and len(cuts) > 5
    held = [set(anchors[lo:hi].tolist()) for lo, hi in cuts]
    assert sum(map(len, held)) == len(set.union(*held)) and {7} in held
    assert all(sizes[lo:hi].sum() <= 100 for (lo, hi), h in zip(cuts, held, strict=True) if len(h) > 1)
    assert suffix.families(anchors[:0], sizes[:0]) == []
    for width in (20, 62):  # with room for the places, and without
        key = rng.integers(0, 50, 1000) << width - 6
        order, ranked = suffix.sorted_order(key, width)
        assert order.tolist() == np.argsort(key, kind="stable").tolist() and ranked.tolist() == sorted(key.tolist())


def test_suffix_documents(spark, odd_docs, no_docs):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 80))) + (passage if i % 3 == 0 else "") + "ü" * (i % 2)) for i in range(60)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == suffix.brute_force([(i, t.encode()) for i, t in rows])
    odd = suffix.removed_bytes(odd_docs).collect()
    assert len(odd) == 10 and {r.doc_id: r.n_removed for r in odd}[7] == 100_000 - 1
    assert suffix.removed_bytes(no_docs).count() == 0


def test_line_spread(spark, odd_docs, no_docs):
    rows = [(i, f"own line {i}\nshared by all\n\nshared by few" if i < 3 else f"own line {i}\nshared by all", f"s{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in linespread.remove_boilerplate(docs, min_sites=12).collect()}
    assert out[0].text == "own line 0\n\nshared by few" and out[5].text == "own line 5" and out[5].lines_removed == 1
    assert linespread.remove_boilerplate(odd_docs).count() == 10
    assert linespread.remove_boilerplate(no_docs).count() == 0


def test_pfair_windows(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(i, "abc"[i % 7 % 3]) for i in range(500)], "doc_id long, source string")
    out = pfair.mix(docs, {"a": 5, "b": 3, "c": 2}, block_docs=4).toPandas()
    assert len(out) == 500 and out.place.is_unique
    assert (out.release <= out.slot).all() and (out.slot < out.deadline).all()
    slots = out.drop_duplicates(["source", "block"])
    for t in (10, 20, 30):
        for s, m in {"a": 0.5, "b": 0.3, "c": 0.2}.items():
            assert abs(((slots.source == s) & (slots.slot < t)).sum() - t * m) < 1
    assert pfair.mix(odd_docs).count() == 10
    assert pfair.mix(no_docs).count() == 0


def test_near_duplicates(spark, odd_docs, no_docs):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(200)]
    near = base[:100] + ["changed"] + base[101:]
    far = base[:100] + [rng.choice(words) for _ in range(100)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(base))], "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.deduplicate(docs).collect()) == [1, 3]
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in neardup.deduplicate(odd_docs).collect())
    assert [i for n, i in kept if not n] == [1, 3, 5, 6, 7, 8] or [i for n, i in kept if not n] == [1, 3, 6, 7, 8]
    assert neardup.deduplicate(no_docs).count() == 0


def test_near_duplicates_across_clumps(spark):
    """Pairs between two clumps of near copies, each member with closer siblings of its own."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(1500)]
    other = list(base)
    for at in range(40, 1480, 52):
        other[at] = f"other{at}"
    rows = [(i, " ".join((base if i < 20 else other)[:-1] + [f"last{i}"])) for i in range(40)]
    assert [r.doc_id for r in neardup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def test_near_duplicates_are_exact(spark):
    """Components of all pairs at the similarity, against brute force."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(800)]
    rows = []
    for i in range(150):
        if i and rng.random() < 0.7:
            text = rng.choice(rows)[1].split()
            for _ in range(rng.randint(1, 8)):
                text[rng.randrange(len(text))] = rng.choice(words)
        else:
            text = [rng.choice(words) for _ in range(rng.choice([6, 40, 200, 300]))]
        rows.append((i, " ".join(text)))
    sets = [set(neardup.shingle_set(t.encode()).tolist()) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    kept = sorted(r.doc_id for r in neardup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == [i for i, r in enumerate(root) if i == r]


def test_repeats_do_not_rule_fingerprints():
    rng = random.Random(6)
    text = " ".join(f"w{rng.randrange(3000)}" for _ in range(300)).encode()
    line = b" menu home about news contact imprint"
    once, often = text + line, text + line * 100
    a, b = neardup.shingle_set(once), neardup.shingle_set(often)
    assert len(np.intersect1d(a, b)) >= 0.95 * len(np.union1d(a, b))
    prints = neardup.wide_prints([once, often])
    assert np.bitwise_count(prints[0] ^ prints[1]).sum() <= neardup.RADIUS
