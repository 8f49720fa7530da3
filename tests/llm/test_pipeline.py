"""The stages one by one and together, over tables with nulls, copies, repeated ids and clashing names."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from gristmill.llm import common, linespread, mil, neardup, packing, pfair

CLASHES = ("score", "Lines_Removed", "slot", "place", "block", "doc", "sig", "n", "ids", "md5")


def _rows(n=240):
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(30, 120))) + f"\nshared by every site\nown line {i}"
        if i % 5 == 1:
            text = "SPAM!! " * 60
        rows.append((i, text, "en", f"site{i % 14}", len(text)))
    rows += [(1000 + i, rows[2][1], "en", "site2", len(rows[2][1])) for i in range(40)]  # copies
    other = "another text under a known id, with words of its own " * 5
    changed = rows[3][1].split(" ")
    for i in range(10):
        at = rng.randrange(len(changed) - 5)
        rows.append((1100 + i, " ".join([*changed[:at], "changed", *changed[at + 1 :]]), "en", "site3", 1))
    rows += [(None, "a text without an id and enough words to be kept " * 4, "en", None, None), (2000, None, None, None, None), (2001, "", "en", "site1", 0), (2, rows[2][1], "en", "site2", 1), (4, other, "en", "site4", len(other))]
    return rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit(0.5))
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 5 != 1), 0) for i in range(240)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def _written(spark, folder, name, df):
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/{name}")


def test_stages_one_by_one(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "boilerplate", "near_duplicates", "mixture", "pack"]
    good = _written(spark, tmp_path, "quality", stages["quality"](spark, docs, tables))
    assert good.columns == docs.columns
    scored = mil.score(docs.select("doc_id", "text"), mil.fit(docs, spark.read.parquet(f"{tables}/labels.parquet")))
    assert good.count() == scored.where(F.col("score") >= mil.KEEP_AT).count()
    assert not {r.doc_id for r in good.collect()} & {i for i in range(240) if i % 5 == 1 and zlib.crc32(str(i).encode()) % 5}
    cut = _written(spark, tmp_path, "cut", stages["boilerplate"](spark, good, tables))
    assert cut.columns == docs.columns and cut.count() == good.count() and cut.where(F.col("text").contains("shared by every site")).count() == 0
    assert cut.where("n_chars <> length(text) AND doc_id < 240").count() == 0 and {r.slot for r in cut.select("slot").distinct().collect()} == {0.5}
    own = _written(spark, tmp_path, "own", stages["near_duplicates"](spark, cut, tables))
    ids = [r.doc_id for r in own.select("doc_id").collect()]
    assert own.columns == docs.columns and 2 in ids and 3 in ids and None in ids and not [i for i in ids if i is not None and 1000 <= i < 1110]
    mixed = _written(spark, tmp_path, "mixed", stages["mixture"](spark, own, tables))
    assert mixed.columns == docs.columns and mixed.count() == own.count() and {r.place for r in mixed.select("place").distinct().collect()} == {0.5}
    placed, name = corpus_pipeline.in_file_order(mixed)
    order = [r.doc_id for r in placed.orderBy(name).collect()]
    want = pfair.mix(own, corpus_pipeline.target_weights(own)).orderBy("place_").select("doc_id").collect()
    assert order == [r.doc_id for r in want]
    pieces = stages["pack"](spark, mixed, tables).collect()
    assert sorted({r.doc_id for r in pieces if r.doc_id is not None}) == sorted({i for i in ids if i is not None})
    # consecutive shards hold consecutive ranges of the mixture
    shards = {}
    for r in pieces:
        shards.setdefault(r.sequence_id >> 32, set()).add(r.doc_id)
    spans = [(min(order.index(i) for i in s), max(order.index(i) for i in s)) for _, s in sorted(shards.items())]
    assert all(a[1] <= b[0] or a[1] - b[0] <= 1 for a, b in zip(spans, spans[1:]))


def test_run_and_empty_tables(spark, tables, tmp_path):
    out = corpus_pipeline.run(spark, tables)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
    spark.read.parquet(f"{tables}/documents.parquet").where("false").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_lines_by_id_and_text(spark):
    """Null ids lose their boilerplate; rows that share an id lose their own lines; a clashing count gets another name."""
    rows = [(i, f"own {i}\nshared", f"s{i}", 7) for i in range(15)] + [(None, "no id\nshared\nend", "x", 7), (3, "third\nagain\nshared", "y", 7), (3, "own 3\nshared", "z", 7), (5, None, "z", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lines_removed int")
    got = sorted((str(r.doc_id), str(r.text), r.lines_removed, r.lines_removed_) for r in linespread.remove_boilerplate(docs).collect())
    want = [(str(i), f"own {i}", 7, 1) for i in range(15)] + [("None", "no id\nend", 7, 1), ("3", "third\nagain", 7, 1), ("3", "own 3", 7, 1), ("5", "None", 7, 0)]
    assert got == sorted(want)
    long = spark.createDataFrame([(i, "\n".join(["head", *(f"{i} {k}" for k in range(3000)), "tail"] * 2), f"s{i}", 0) for i in range(12)], docs.schema)
    kept = linespread.remove_boilerplate(long).first().text.split("\n")
    assert len(kept) == 6000 and "head" not in kept and "tail" not in kept


@pytest.mark.parametrize("weights", [[1, 1, 1], [1, 2, 4], [45, 45, *[1] * 10], [300, 7, 7, 5, 1, 1, 1], [9999, 1]], ids=str)
def test_pfair_is_earliest_deadline_first(spark, weights):
    """Epochs that start by themselves give the plain simulation, and no source is a block off its target at any slot."""
    total = sum(weights)
    blocks = [max(1, 1500 * w // total) for w in weights]
    got = {(r.i, r.k): r.slot for r in pfair.schedule(spark, weights, blocks, epoch=64).collect()}
    assert len(got) == sum(blocks)
    horizon = max(-(-b * total // w) for w, b in zip(weights, blocks, strict=True))
    run = pfair.simulate(weights, horizon)
    assert all(got[x] == t for t, x in enumerate(run) if x[1] < blocks[x[0]])
    done = np.zeros(len(weights))
    for t, (i, _) in enumerate(run, 1):
        done[i] += 1
        assert (np.abs(done - np.array(weights) * t / total) < 1).all()


def test_pfair_weights_and_many_sources(spark):
    assert pfair.integer_weights({"a": 1, "b": 1, "c": 1}, {"a": 0.1, "b": 0.3}) == {"a": 1, "b": 3, "c": 2}
    assert pfair.integer_weights({"a": 4, "b": 9}, lambda n: n) == {"a": 4, "b": 9}
    with pytest.raises(ValueError):
        pfair.integer_weights({"a": 1}, {"a": 0})
    docs = spark.createDataFrame([(i, f"s{i % 1500}", 0.5) for i in range(3000)], "doc_id long, source string, slot double")
    out = pfair.mix(docs, block_docs=1).select("slot", "slot_", "release", "deadline").collect()
    assert len(out) == 3000 and len({r.slot_ for r in out}) == 3000 and all(r.slot == 0.5 and r.release <= r.slot_ < r.deadline for r in out)
    odd = spark.createDataFrame([(None, None)] * 5 + [(1, "a")] * 4, "doc_id long, source string")
    assert pfair.mix(odd, block_docs=2).select("place").distinct().count() == 9


def test_shards_stay_small(spark):
    """Shards by a token budget, whatever the number of tasks; every id lies in one piece."""
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["river", "stone", "light", "hand"]) for _ in range(300))) for i in range(60)], "doc_id long, text string")
    rows = packing.pack(docs, window=256, shard_tokens=1024).collect()
    total = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == total.get(r.sequence_id, 0)
        total[r.sequence_id] = r.offset + r.length
    assert sum(total.values()) == 60 * 301 and all(n == 256 or n & (n - 1) == 0 for n in total.values())
    assert sum(n < 256 for n in total.values()) >= 15


def test_near_duplicate_recall_by_similarity(spark):
    """Every pair of texts at 0.8 or more ends in one component, also far beyond the reach of a bucket's comparison."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for base in range(60):
        text = [rng.choice(words) for _ in range(rng.choice([30, 120, 400]))]
        rows.append((len(rows), " ".join(text)))
        for _ in range(3):
            other = list(text)
            for _ in range(rng.randint(1, max(1, len(text) // 30))):
                other[rng.randrange(len(other))] = rng.choice(words)
            rows.append((len(rows), " ".join(other)))
    sets = [set(neardup.shingle_set(t.encode()).tolist()) for _, t in rows]
    close = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    from gristmill.llm.graph import connected_components

    roots = {r.node: r.root for r in connected_components(neardup.links(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert len(close) > 50 and all(roots.get(i, i) == roots.get(j, j) for i, j in close)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (7, 7)]
    from gristmill.llm.graph import connected_components

    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_free_names():
    assert common.free_name("score", ["a"]) == "score" and common.free_name("score", ["Score", "score_"]) == "score__"


def test_links_of_the_last_round_only(spark, monkeypatch):
    """Rounds that look at some partners may find none where the last one, which looks at all, does."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(200)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join([*base[:-1], "other"])), (3, " ".join(rng.choice(words) for _ in range(200)))], "doc_id long, text string")
    plain, asked = neardup.crossings, []

    def crossings(occurrences, roots, similarity, partners_of):
        asked.append(partners_of)
        pairs = plain(occurrences, roots, similarity, partners_of)
        return pairs if partners_of is None else pairs.where("false")

    monkeypatch.setattr(neardup, "proposals", lambda first, plan: spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(neardup, "crossings", crossings)
    assert [tuple(r) for r in neardup.links(docs).collect()] == [(2, 1)]
    assert asked == list(neardup.ROUNDS)


def test_clumps_that_share_rare_shingles_make_no_pairs(spark, monkeypatch):
    """Two clumps of near copies with a passage in common: their counts refute every pair between them before it is a row."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(9000)]
    passage, rows = [rng.choice(words) for _ in range(40)], []
    for _ in range(2):
        base = [rng.choice(words) for _ in range(260)]
        rows += [(len(rows) + k, " ".join([*(passage if k < 15 else []), *base[:-1], f"end{k}"])) for k in range(40)]
    plain, made = neardup.crossings, []

    def crossings(*a):
        made.append(plain(*a).where("a >= 40 AND b < 40").count())
        return plain(*a)

    monkeypatch.setattr(neardup, "crossings", crossings)
    assert sorted(r.doc_id for r in neardup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [0, 40]
    assert len(made) == len(neardup.ROUNDS) and max(made) == 0


def test_an_id_with_several_texts_ties_their_copies(spark):
    rng = random.Random(6)
    x, y, z = (" ".join(rng.choice(["river", "stone", "light", "hand", "tree", "cloud"]) for _ in range(80)) for _ in range(3))
    rows = [(3, x), (5, x), (5, y), (4, y + " end"), (9, y), (7, z), (8, z)]
    assert sorted(r.doc_id for r in neardup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [3, 7]


def test_small_graphs_are_not_dealt_out(spark):
    """The rounds over a small graph run in one task each, however many partitions the session has."""
    from gristmill.llm.graph import connected_components

    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("small-graphs", "")
    try:
        got = connected_components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")).collect()
        jobs = spark.sparkContext.statusTracker()
        stages = {s for j in jobs.getJobIdsForGroup("small-graphs") for s in jobs.getJobInfo(j).stageIds}
        tasks = sum(i.numTasks for s in stages if (i := jobs.getStageInfo(s)))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)
    assert {r.node for r in got} == set(range(61)) and {r.root for r in got} == {0}
    assert tasks < 400


def test_counts_refute_no_true_pair():
    rng = np.random.default_rng(4)
    for n, change in ((3, 0), (40, 4), (400, 40), (400, 120), (90_000, 9000)):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.append(a[change:], rng.integers(0, 1 << 63, change, dtype=np.uint64))
        x, y = neardup.bins(a), neardup.bins(b)
        if n > 255 * neardup.BINS:
            assert x is None
        else:
            at_most = np.minimum(*(np.frombuffer(v, np.uint8).astype(int) for v in (x, y))).sum()
            assert at_most >= n - change


def test_numbers_of_many_texts_in_a_chunk(monkeypatch):
    assert neardup._place(1 << 16) == "<u2" and neardup._place((1 << 16) + 1) == "<u4"


def test_final_marks_are_set_apart():
    """The pattern that looks for the mark first finds what one finds that looks for the letter first."""
    import re

    rng = random.Random(8)
    plain = re.compile("(?<=[a-zß-öø-įı-ſ])([.,])(?=[ \n]|\\Z)").sub
    for _ in range(3000):
        text = "".join(rng.choice("ab.,  \né×İZ9-") for _ in range(rng.randrange(12)))
        assert packing._FINAL(r" \g<0>", text) == plain(r" \1", text)
    encoder = packing.WordEncoder(packing.tokenizer_path())
    texts = ["The end, the End. a.b, ab1 x2. été, ÉTÉ. café.\nNo", "MIXED Caseİ words, Ångström. tail.", "", "...,,, .a ,b"]
    assert [x.tolist() for x in encoder.encode(texts)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_shingles_are_held_a_small_slice_at_a_time():
    texts = [None, b"", "ünicode text".encode(), *([b"one two three four five six " * 4000] * 30), b"x" * 2_000_000, b"a b c d e f"]
    slices = [(lo, len(ends) - 1, h, ends) for lo, h, ends in neardup._sets(pa.array(texts, pa.binary()))]
    assert [lo for lo, *_ in slices] == [0, *np.cumsum([n for _, n, *_ in slices])[:-1]] and sum(n for _, n, *_ in slices) == len(texts)
    assert all(n == 1 or sum(len(t or b"") for t in texts[lo : lo + n]) <= 1 << 19 for lo, n, *_ in slices)
    for lo, n, h, ends in slices:
        for k in range(n):
            assert (h[ends[k] : ends[k + 1]] == neardup.shingle_set(texts[lo + k] or b"")).all()


def test_wanted_ids_take_a_bit_each(spark, monkeypatch):
    """A task that marks a few wanted ids holds no byte for each bit of the table, and the pairs found stay the same."""
    seen = []

    def added_up(df, run, combine, width):
        ids = np.array([r[0] for r in df.collect()], np.int64)
        tracemalloc.start()
        try:
            (slices,) = run([pa.RecordBatch.from_arrays([pa.array(ids)], names=["id"])])
            seen.append(tracemalloc.get_traced_memory()[1])
        finally:
            tracemalloc.stop()
        table = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(x) for x in slices.column(1).to_pylist()), np.uint8)
        want = neardup._mix(ids.view(np.uint64)[:, None]) % np.uint64(neardup.WANTED)
        assert len(table) == neardup.WANTED // 8 and np.flatnonzero(np.unpackbits(table)).tolist() == sorted(want.tolist())
        return table

    monkeypatch.setattr(neardup, "_added_up", added_up)
    long = [f"word{i}" for i in range(200)]
    rows = [(1, " ".join(long)), (-7, " ".join([*long[:-1], "end"])), (1 << 40, " ".join(reversed(long))), (9, "not asked for")]
    texts = spark.createDataFrame(rows, "id long, text string")
    first = spark.createDataFrame([(bytearray(neardup._digest(neardup.shingle_set(t.encode()))), i) for i, t in rows], "digest binary, first_id long")
    pairs = spark.createDataFrame([(1, -7), (1 << 40, 1)], "a long, b long")
    assert [(r.a, r.b) for r in neardup.verified(pairs, texts, first, 0.8).collect()] == [(1, -7)]
    assert seen[0] < neardup.WANTED // 2  # bytes


def test_stages_hand_over_small_batches(spark):
    """Texts go to Python a few MB at a time; a lower limit of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('text ', 1000) AS text").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    try:
        spark.conf.set(key, str(64 << 20))
        dict(corpus_pipeline.STAGES)["pack"](spark, docs.where("false"), "")
        got = docs.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in got) == 3000 and max(r["size"] for r in got) < 1.25 * common.BATCH_BYTES
        spark.conf.set(key, "1000000")
        common.small_batches(spark)
        assert int(spark.conf.get(key).removesuffix("b")) == 1_000_000
    finally:
        spark.conf.set(key, before)
