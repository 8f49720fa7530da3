import dataclasses
import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from gristmill.llm import mil, nnpu, packing, passages, skipchain


def _labelled(spark, n=400):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    docs, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 200)))
        bad, toxic = i % 5 == 1, i % 4 == 2
        if bad:
            text = text[: len(text) // 2] + " " + ("SPAM!! " * 60)
        if toxic:
            text += " vile" + rng.choice(["a", "b", "c"]) + " words"
        docs.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_classifiers_held_out(spark):
    docs, labels, truth = _labelled(spark)
    by = {i: (q, t) for i, q, t in truth}
    for rows, k in ((mil.digest(docs, labels).collect(), 0), (nnpu.digest(docs, labels).collect(), 1)):
        held = [r for r in rows if r.held_out]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
        assert sum(by[r.doc_id][k] == r.predicted for r in held) / len(held) >= 0.9


def test_attention_gradient():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(12, passages.FEATURES)), np.array([1.0, 0.0, 1.0])
    begin = np.array([0, 3, 8])
    model = mil.GatedAttention.fresh(x, rng)
    cost = np.ones(3)
    loss = lambda: -np.mean(y * np.log(model.predict(x, begin)) + (1 - y) * np.log(1 - model.predict(x, begin)))
    grads = model.gradient(x, begin, y, cost)
    for name in ("W", "V", "U", "a", "c"):
        p = model.params[name]
        at = (0,) * p.ndim
        old = p[at]
        p[at] = old + 1e-5
        up = loss()
        p[at] = old - 1e-5
        down = loss()
        p[at] = old
        assert (up - down) / 2e-5 == pytest.approx(grads[name][at], abs=1e-6)


def test_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    for op in (mil, nnpu):
        assert op.digest(odd_docs, labels).count() == 10
        assert op.digest(odd_docs, labels.where("false")).count() == 10
        assert op.digest(no_docs, labels).count() == 0


def test_base_spans_match_patterns():
    rng = random.Random(2)
    parts = ["1", "2", "25", ".", "-", " ", "+", "@", "a", "b.", "(", ")", "4111111111111111", "é", "_", "%", "x.com", "127.0.0.1", "٣"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        spans = skipchain.base_spans(t)
        form = ",".join(f"{k}:{s}:{e}" for k in skipchain.KINDS for s, e in spans[k])
        assert hashlib.sha256(form.encode()).hexdigest() == skipchain.brute_base(t)


def test_skip_chain(spark, odd_docs, no_docs):
    rows = [(i, f"call +1 (555) 010-{1000 + i} or write to user{i}@mail.example.com now") for i in range(40)]
    rows.append((100, "call +1 (555) 010-7777 today"))
    found = {r.doc_id: r for r in skipchain.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[3].n_email == 1 and found[3].n_phone == 1 and "email:" in found[3].spans
    assert skipchain.digest(odd_docs).count() == 10
    assert skipchain.digest(no_docs).count() == 0


def test_only_a_skip_edge_decides():
    """A bare local number is a phone number where the text has it with its prefix, and none elsewhere."""
    rng = random.Random(4)
    number = lambda: f"0{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"
    texts = []
    for _ in range(150):
        a, b = number(), number()
        texts.append(f"call +1 (555) {a} today or later on call +1 (555) {a} again")
        texts.append(f"the part {b} is out, so take part {b} from the shelf")
    field = skipchain.train(np.concatenate([skipchain.examples(t) for t in texts]))
    text = "call +1 (555) 031-4577 today, and if nobody answers for a while then simply ring 031-4577 once more"
    alone = dataclasses.replace(field, skip=np.zeros_like(field.skip))
    spans = skipchain.base_spans(text)
    at = text.rindex("031-4577")
    assert ("phone", at, at + 8) in skipchain.added_spans(text, spans, field)
    assert skipchain.added_spans(text, spans, alone) == []
    other = "the part 031-4577 is out"
    assert skipchain.added_spans(other, skipchain.base_spans(other), field) == []


def test_numbers_that_fail_the_check_digit_are_no_cards():
    rng = random.Random(5)
    valid = [str(n) for n in (rng.randrange(10**15, 10**16) for _ in range(4000)) if skipchain.luhn(str(n))]
    texts = [f"pay with {valid[i]} now, order {rng.randrange(10**15, 10**16)} thanks" for i in range(200)]
    field = skipchain.train(np.concatenate([skipchain.examples(t) for t in texts]))
    for i in range(50):
        text = f"ticket {int(valid[300 + i]) + 1} is open"
        assert skipchain.added_spans(text, skipchain.base_spans(text), field) == []


def test_long_words_take_linear_time():
    begun = time.perf_counter()
    for text in ("a" * 500_000 + "7" + "b" * 500_000, "a" * 1_000_000, "1" * 1_000_000, "@" * 200_000, "+1" + "(" * 500_000, "a@" + "b." * 200_000):
        skipchain.added_spans(text, skipchain.base_spans(text), None)
        assert len(skipchain.tokens(text)) <= 1
    assert time.perf_counter() - begun < 10


def test_packing_round_trip(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["áb café ́x", "it's  don't\t\tx y z 12 3a!! \x1cq, The end.", "", "İstanbul ΣΑΣ ς,", "a​b <|endoftext|>x.", "word, " * 9000, None, "\x02 mark \x02", "Naïve.. test., ok"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = {}
    rows = packing.pack(docs).collect()
    for r in sorted(rows, key=lambda r: r.start):
        ids = np.array(tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2], "<u4")
        assert r.doc_tokens == len(ids) and r.start == pieces.get(r.doc_id, 0)
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        pieces[r.doc_id] = r.start + r.length
    assert len(pieces) == len(texts)
    total = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == total.get(r.sequence_id, 0)
        total[r.sequence_id] = r.offset + r.length
    assert all(n == 4096 or n & (n - 1) == 0 for n in total.values())
    assert packing.pack(odd_docs).select("doc_id").distinct().count() == 9
    assert packing.pack(no_docs).count() == 0


def test_packing_queries_all_terms():
    """Scores against BM25 in full, and a group of like documents that fills most of its shard."""
    rng = np.random.default_rng(8)
    group = rng.integers(100, 300, 60)
    docs = [np.append(group, [1000 + i]) if i % 3 else rng.integers(3000 + 60 * i, 3060 + 60 * i, 61) for i in range(30)]
    n, mean = len(docs), np.mean([len(d) for d in docs])
    shard = packing.Shard(docs)
    for q in docs[:6]:
        want = np.zeros(n)
        for term in set(q.tolist()):
            df = sum(term in d for d in docs)
            for i, d in enumerate(docs):
                tf = int((d == term).sum())
                want[i] += np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
        assert shard.scores(q) == pytest.approx(want)
    order = packing.arrange(docs[1:] + docs[:1], window=61 * 20)
    assert sorted(order) == list(range(30))
    assert all((i + 1) % 3 for i in order[:20])


def test_mixture_reaches_sequences(spark, tmp_path):
    """Every shard of the sequences has the sources at their target shares, also where one has texts of one kind."""
    import corpus_pipeline

    rng = random.Random(12)
    rows = []
    for i in range(1000):
        source = "small" if i % 5 == 0 else "large"
        text = " ".join(["one kind of page with the same words"] * 5) if source == "small" else " ".join(f"w{rng.randrange(900)}" for _ in range(38))
        rows.append((i, text, source, 160))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    corpus_pipeline.mixture(spark, docs, "").write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    placed, name = corpus_pipeline.in_file_order(mixed)
    place = {r.doc_id: n for n, r in enumerate(placed.orderBy(name).collect())}
    shards = {}
    for r in corpus_pipeline.pack(spark, mixed, "").collect():
        shards.setdefault(r.sequence_id >> 32, set()).add(r.doc_id)
    order = [shards[k] for k in sorted(shards)]
    assert sum(map(len, order)) == len(place) == 1000
    assert len(order) > 2 and all(max(place[i] for i in a) < min(place[i] for i in b) for a, b in zip(order, order[1:]))
    share = [sum(i % 5 == 0 for i in s) / len(s) for s in order]
    assert abs(share[0] - 1 / 3) < 0.1 and share[-1] < 0.1  # the roots of 1 and 4; at the end the small source has run out
