"""Near-duplicate removal by wide SimHash fingerprints, bit-sliced comparison and exact verification.

Exact copies collapse first: texts with the same set of five-word shingles. Every set left gets a 256-bit SimHash.
Tables of random bits bring likely pairs together: with N sets a key has log2(N / 64) bits, at least
eight, and there are as many tables as give 98 % of the pairs at the similarity asked for a common bucket, whatever N.
In a bucket the bit-sliced comparison (gristmill.llm.simhash) finds the pairs within the radius, each row against the
REACH rows after it. Every set proposes the nearest one it met; a proposed pair links if the Jaccard
similarity is `similarity` or more, counted exactly.

The tables only save work. What they leave apart is joined exactly: under one order of all shingles, rare ones
first, two similar sets share a shingle among the first n - ceil(similarity n) + 1 of each, so every pair of different
components that shares one there, and whose sizes, places and counts of shingles by hash allow the similarity, is verified
too, once. Thus the components are those of all pairs at the similarity, up to 64-bit hashes of shingles. Components keep their smallest id.

Shingles are hashed anew from the texts wherever they are needed: they take more room than the texts.

Defined results: null texts count as empty and all empty texts are copies of one another; texts with fewer
words have one shingle; rows with a null id stay; rows that share an id stay or go together; an empty table
gives an empty result; all columns pass through.
"""

from __future__ import annotations

import hashlib
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm import simhash
from gristmill.llm.common import chunks_by_size, cut, shuffle_partitions
from gristmill.llm.graph import connected_components

WORDS, SIMILARITY = 5, 0.8
FIELDS = 4  # 64-bit words of a fingerprint
#: Bits of 256 in which texts of the similarity may differ: the mean is 39, the deviation 6.
RADIUS = 63
RECALL = 0.98
#: Rows of a bucket, in the order of their fingerprints, that each is compared with; the exact join finds what lies further apart.
REACH = 128
#: Counters that estimate how many texts have a shingle; they only order shingles, so their collisions cost time, not links.
COUNTERS, SLICES = 1 << 20, 16
#: Bits of the table that tells tasks which ids are wanted; ids that fall on a set bit by chance go at the join.
WANTED = 1 << 26
#: Partners of a set in each round of the exact join. A few join whole clumps, so that few pairs of different components are
#: left for the last round, which takes all.
ROUNDS = (4, 4, None)
#: Counts of a set's shingles by their hash, a byte each: what two sets have in common is at most the sum of the lesser counts.
BINS = 256
#: Pairs of a set that are verified in a round with capped partners, those with the most in common at most; the last round verifies all.
BEST = 3
#: Pairs that a task expands at once, and pairs whose counts it compares at once.
PAIRS, COMPARED = 1 << 19, 1 << 14
#: Bytes of the texts whose shingles a task holds at once. Four times as many take 80 MB more of each worker, and no less time.
SLICE_BYTES = 1 << 19
_MULTIPLY = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def distinct_shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of the distinct shingles, by text and hash."""
    raw, starts, lengths, owner = simhash.shingle_spans(texts, WORDS)
    if not len(owner):
        return np.zeros(0, np.uint64), owner
    h = simhash.xxh64_spans(raw, starts, lengths, 42)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))
    return h[new], owner[new]


def wide_prints(texts: list[bytes]) -> np.ndarray:
    """(texts, FIELDS) unsigned 64-bit."""
    return set_prints(*distinct_shingles(texts), len(texts))


def set_prints(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, FIELDS) unsigned 64-bit: each distinct shingle of a text votes once, as in the similarity."""
    out = [simhash.majority(h, owner, n)]
    for m in _MULTIPLY[: FIELDS - 1]:
        mixed = (h ^ (h >> np.uint64(31))) * m
        mixed ^= mixed >> np.uint64(29)
        mixed *= _MULTIPLY[0]
        out.append(simhash.majority(mixed ^ (mixed >> np.uint64(32)), owner, n))
    return np.stack(out, axis=1)


def shingle_set(text: bytes) -> np.ndarray:
    return distinct_shingles([text])[0]


def plan_tables(n: int, similarity: float = SIMILARITY) -> np.ndarray:
    """(tables, bits): the fingerprint bits of each table's key."""
    bits = max(8, math.ceil(math.log2(max(n, 1) / 64 + 1)))
    agree = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - agree**bits))
    rng = np.random.default_rng(17)
    return np.stack([rng.choice(64 * FIELDS, bits, replace=False) for _ in range(tables)])


def _masks(places: np.ndarray) -> np.ndarray:
    out = np.zeros((len(places), FIELDS), np.uint64)
    for t, row in enumerate(places):
        for b in row:
            out[t, b // 64] |= np.uint64(1) << np.uint64(b % 64)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    """One number of the masked words of a fingerprint."""
    h = np.zeros(x.shape[:-1], np.uint64)
    for c in range(x.shape[-1]):
        h = (h ^ x[..., c]) * _MULTIPLY[c % 3]
        h ^= h >> np.uint64(29)
    return h


def proposals(prints: DataFrame, places: np.ndarray) -> DataFrame:
    """(a, b) ids that may be near duplicates. prints: (id, fp binary)."""
    n = shuffle_partitions(prints.sparkSession)
    masks = _masks(places)

    def deal(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(ids):
                continue
            fp = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u8").reshape(-1, FIELDS)
            key = _mix(fp[:, None, :] & masks[None]) + np.arange(len(masks), dtype=np.uint64) * _MULTIPLY[2]
            target = ((key >> np.uint64(17)) % np.uint64(n)).astype(np.int32)
            row, table = np.indices(key.shape)
            order = np.argsort(target.ravel(), kind="stable")
            t = target.ravel()[order]
            first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            blobs = []
            for i, j in zip(first, np.append(first[1:], len(t)), strict=True):
                at = order[i:j]
                r = row.ravel()[at]
                blobs.append((j - i, ids[r].tobytes() + table.ravel()[at].astype("<i4").tobytes() + fp[r].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(t[first]), pa.array([x for x, _ in blobs], pa.int32()), pa.array([x for _, x in blobs], pa.binary())], names=["target", "n", "payload"])

    def compare(batches):
        ids, tables, fps = [], [], []
        for b in batches:
            for m, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ids.append(np.frombuffer(blob, "<i8", m))
                tables.append(np.frombuffer(blob, "<i4", m, 8 * m))
                fps.append(np.frombuffer(blob, "<u8", m * FIELDS, 12 * m).reshape(m, FIELDS))
        if not ids:
            return
        ids, tables, fp = np.concatenate(ids), np.concatenate(tables), np.concatenate(fps)
        key = _mix(fp & masks[tables])
        order = np.lexsort((ids, *fp.T, key, tables))
        ids, tables, fp, key = ids[order], tables[order], fp[order], key[order]
        new = np.append(True, (tables[1:] != tables[:-1]) | (key[1:] != key[:-1]))
        alone = new & np.append(new[1:], True)
        ids, tables, fp, group = ids[~alone], tables[~alone], fp[~alone], np.cumsum(new)[~alone]
        near = np.full(len(ids), np.iinfo(np.int64).max)  # distance << 40 | row, of the nearest row
        for i, j in simhash.close_pairs(fp, group, RADIUS, every=16, reach=REACH):
            code = np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1).astype(np.int64) << 40
            for me, other in ((j, i), (i, j)):
                near[me] = np.minimum(near[me], code | other)  # each row stands once on either side of a round
        me = np.flatnonzero(near < np.iinfo(np.int64).max)
        other = ids[near[me] & ((1 << 40) - 1)]
        order = np.lexsort((other, near[me] >> 40, ids[me]))
        me, other = me[order], other[order]
        first = np.append(True, ids[me][1:] != ids[me][:-1]) if len(me) else np.zeros(0, bool)
        me, other = me[first], other[first]
        yield pa.RecordBatch.from_arrays([pa.array(ids[me]), pa.array(near[me] >> 40), pa.array(other)], names=["a", "d", "b"])

    dealt = prints.mapInArrow(deal, "target int, n int, payload binary").repartitionById(n, "target")
    nearest = dealt.mapInArrow(compare, "a long, d long, b long").where("a <> b").groupBy("a").agg(F.min(F.struct("d", "b")).alias("m"))
    return nearest.select(F.greatest("a", "m.b").alias("a"), F.least("a", "m.b").alias("b")).distinct()


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(44)).astype(np.int64)


def _sets(texts):
    """(offset, shingles, begin of each text's) over slices of a column of texts."""
    texts = texts.cast(pa.binary())
    for lo, hi in chunks_by_size(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), SLICE_BYTES):
        h, owner = distinct_shingles([t or b"" for t in texts.slice(lo, hi - lo).to_pylist()])
        yield lo, h, np.searchsorted(owner, np.arange(hi - lo + 1))


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.sha256(shingles.tobytes()).digest()[:16]


def _added_up(df: DataFrame, run, combine, width: int) -> np.ndarray:
    """(SLICES, width) bytes: what run's (slice, c) rows of all tasks combine to; each slice meets in one task."""

    def add(batches):
        import zstandard

        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[k] = combine(total.get(k), np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8))
        for k, x in total.items():
            x = x if x.dtype == np.uint8 else np.log2(x + 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["slice", "c"])

    out = np.zeros((SLICES, width), np.uint8)
    for r in df.mapInArrow(run, "slice int, c binary").repartition(SLICES, "slice").mapInArrow(add, "slice int, c binary").collect():
        out[r[0]] = np.frombuffer(r[1], np.uint8)
    return out


def _slices(table: np.ndarray) -> pa.RecordBatch:
    import zstandard

    rows = [zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for x in table.reshape(SLICES, -1)]
    return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(rows, pa.binary())], names=["slice", "c"])


def commonness(texts: DataFrame) -> np.ndarray:
    """(COUNTERS,) binary logarithm of the shingles that fell on each counter; a task counts to 255. texts: (id, text)."""

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for _, h, _ in _sets(b.column(0)):
                total += np.bincount(_slot(h), minlength=COUNTERS)
        if total.any():
            yield _slices(np.minimum(total, 255).astype(np.uint8))

    return _added_up(texts.select("text"), count, lambda a, b: (0 if a is None else a) + b.astype(np.int64), COUNTERS // SLICES).ravel()


def _place(texts: int) -> str:
    """The type of a text's number among so many."""
    return "<u2" if texts <= 1 << 16 else "<u4"


def postings(texts: DataFrame, first: DataFrame, similarity: float) -> DataFrame:
    """(token, id, size, pos): the prefix of each set, rare shingles first, without tokens of one set.

    Copies collapse in each chunk, and in the task of a token.
    """
    spark = texts.sparkSession
    rank = spark.sparkContext.broadcast(commonness(texts))  # COUNTERS bytes
    n = shuffle_partitions(spark)

    def prefixes(batches):
        for b in batches:
            for _, h, ends in _sets(b.column(0)):
                sizes = np.diff(ends)
                digests = [_digest(h[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
                kept = np.sort(np.unique(np.array(digests, "S16"), return_index=True)[1])
                digest = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)[kept]
                of = np.repeat(np.arange(len(sizes)), sizes)
                rows = np.isin(of, kept)
                h, of = h[rows], np.searchsorted(kept, of[rows])
                sizes = sizes[kept]
                h = h[np.lexsort((h, rank.value[_slot(h)], of))]
                keep = np.where(sizes > 0, sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1, 0)
                place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                mine = place < np.repeat(keep, sizes)
                h, of, place = h[mine], of[mine], place[mine]
                target = ((h >> np.uint64(7)) % np.uint64(n)).astype(np.int32)
                order = np.argsort(target, kind="stable")
                h, of, place, target = h[order], of[order], place[order], target[order]
                cut_ = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(h) else np.zeros(0, np.int64)
                blobs = []
                for i, j in zip(cut_, np.append(cut_[1:], len(h))[: len(cut_)], strict=True):
                    docs, local = np.unique(of[i:j], return_inverse=True)
                    blobs.append((j - i, len(docs), h[i:j].tobytes() + digest[docs].tobytes() + sizes[docs].astype("<u4").tobytes() + local.astype(_place(len(docs))).tobytes() + np.minimum(place[i:j], 65535).astype("<u2").tobytes()))
                if blobs:
                    yield pa.RecordBatch.from_arrays([pa.array(target[cut_]), *(pa.array([x[k] for x in blobs], pa.int32()) for k in (0, 1)), pa.array([x[2] for x in blobs], pa.binary())], names=["target", "n", "docs", "payload"])

    def shared(batches):
        parts = []
        for b in batches:
            for m, d, blob in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                local = np.frombuffer(blob, _place(d), m, 8 * m + 20 * d)
                digest = np.frombuffer(blob, "<u8", 2 * d, 8 * m).reshape(d, 2)[local]
                parts.append((np.frombuffer(blob, "<u8", m), digest, np.frombuffer(blob, "<u4", d, 8 * m + 16 * d)[local], np.frombuffer(blob, "<u2", m, 8 * m + 20 * d + local.nbytes)))
        if not parts:
            return
        token, digest, size, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(token, kind="stable")
        same = token[order[1:]] == token[order[:-1]]
        order = order[np.append(False, same) | np.append(same, False)]
        token, digest, size, pos = token[order], digest[order], size[order], pos[order]
        order = np.lexsort((digest[:, 1], digest[:, 0], token))
        token, digest, size, pos = token[order], digest[order], size[order], pos[order]
        new = np.append(True, (token[1:] != token[:-1]) | (digest[1:] != digest[:-1]).any(axis=1)) if len(token) else np.zeros(0, bool)
        token, digest, size, pos = token[new], digest[new], size[new], pos[new]
        again = token[1:] == token[:-1]
        again = np.append(False, again) | np.append(again, False) if len(token) else np.zeros(0, bool)
        token, digest, size, pos = token[again], np.ascontiguousarray(digest[again]), size[again], pos[again]
        for lo in range(0, len(token), 1 << 16):
            hi = min(len(token), lo + (1 << 16))
            raw = pa.py_buffer(digest[lo:hi].tobytes())
            digests = pa.Array.from_buffers(pa.binary(16), hi - lo, [None, raw]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(token[lo:hi].view(np.int64)), digests, pa.array(size[lo:hi].astype(np.int32)), pa.array(pos[lo:hi].astype(np.int32))], names=["token", "digest", "size", "pos"])

    heads = texts.select("text").mapInArrow(prefixes, "target int, n int, docs int, payload binary").repartitionById(n, "target")
    found = heads.mapInArrow(shared, "token long, digest binary, size int, pos int")
    return found.join(first.select("digest", F.col("first_id").alias("id")), "digest").select("token", "id", "size", "pos")


class Occurrences(NamedTuple):
    #: (token, id, size, pos), of postings
    rows: DataFrame
    #: (id, bins)
    counts: DataFrame


def at_most(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What the similarity of pairs of sets can be by their counts, a row a set."""
    common = np.minimum(x, y).sum(axis=1, dtype=np.int64)
    return common / np.maximum(x.sum(axis=1, dtype=np.int64) + y.sum(axis=1, dtype=np.int64) - common, 1)


def crossings(occurrences: Occurrences, roots: DataFrame, similarity: float, partners_of: int | None) -> DataFrame:
    """(a, b, share): pairs of different components that share a prefix token and may have the similarity, by places, sizes and counts; share: what
    it can be by the counts.

    partners_of: for each set of a token the next so many of other components, and as many members of the token's largest
    component; None: all of them. A task compares the counts of what meets there, so pairs that they refute are never rows.
    """

    def run(batches):
        parts, counts, known = [], [], []
        for b in batches:
            if b.num_rows:
                parts.append(tuple(c.to_numpy(zero_copy_only=False) for c in b.columns[:5]))
                known.append(np.array(b.column(5).is_valid()))
                counts.append(np.frombuffer(b"".join(x or bytes(BINS) for x in b.column(5).to_pylist()), np.uint8).reshape(-1, BINS))
        if not parts:
            return
        token, ident, size, pos, root = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids, where, number = np.unique(ident, return_index=True, return_inverse=True)
        counts, known = np.concatenate(counts)[where], np.concatenate(known)[where]
        order = np.lexsort((ident, root, token))
        token, ident, number, size, pos, root = token[order], ident[order], number[order], size[order].astype(np.int64), pos[order].astype(np.int64), root[order]
        n = len(token)
        new_token = np.append(True, token[1:] != token[:-1])
        new_run = new_token | np.append(True, root[1:] != root[:-1])
        token_end = np.append(np.flatnonzero(new_token)[1:], n)[np.cumsum(new_token) - 1]
        run_end = np.append(np.flatnonzero(new_run)[1:], n)[np.cumsum(new_run) - 1]
        after = token_end - run_end if partners_of is None else np.minimum(token_end - run_end, partners_of)
        # the largest run of each token takes in what lies alone
        run = np.cumsum(new_run) - 1
        begin = np.flatnonzero(new_run)
        length = np.diff(np.append(begin, n))
        of = (np.cumsum(new_token) - 1)[begin]
        by = np.lexsort((length, of))
        big = by[np.append(of[by][1:] != of[by][:-1], True)][of][run]
        into = np.zeros(n, np.int64) if partners_of is None else np.where((run != big) & (length[big] > 1), np.minimum(partners_of, length[big]), 0)
        partners = after + into
        rows = np.flatnonzero(partners)
        done = np.cumsum(partners[rows])
        lo = 0
        while lo < len(rows):
            hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + PAIRS, side="right")))
            at = rows[lo:hi]
            lo = hi
            many = partners[at]
            i = np.repeat(at, many)
            nth = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
            hub = big[i]
            j = np.where(nth < after[i], run_end[i] + nth, begin[hub] + (ident[i] % 7919 * 31 + (nth - after[i]) * 104729) % length[hub])
            common = np.minimum(size[i] - pos[i], size[j] - pos[j])  # at most, if this is their first common token
            may = common >= similarity / (1 + similarity) * (size[i] + size[j]) - 1e-6
            may &= np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-6
            i, j = number[i[may]], number[j[may]]
            a, b = np.divmod(np.unique(np.maximum(i, j) * len(ids) + np.minimum(i, j)), len(ids))
            share = np.ones(len(a))
            for k in range(0, len(a), COMPARED):
                some = slice(k, k + COMPARED)
                share[some] = np.where(known[a[some]] & known[b[some]], at_most(counts[a[some]], counts[b[some]]), 1)
            may = share >= similarity - 1e-9
            yield pa.RecordBatch.from_arrays([pa.array(ids[a[may]]), pa.array(ids[b[may]]), pa.array(share[may])], names=["a", "b", "share"])

    named = occurrences.rows.join(roots.withColumnRenamed("node", "id"), "id", "left").select("token", "id", "size", "pos", F.coalesce("root", "id").alias("root"))
    # tokens of one component stay behind: the shingles of a large group of near copies
    mixed = named.groupBy("token").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("token")
    named = named.join(mixed, "token", "left_semi").join(occurrences.counts, "id").select("token", "id", "size", "pos", "root", "bins")
    # by a hash of the token: a repartition by the token itself would be left out after the join by it, and its rows spread if that join becomes a broadcast
    return named.repartition(shuffle_partitions(named.sparkSession), F.xxhash64("token")).mapInArrow(run, "a long, b long, share double").distinct()


def bins(h: np.ndarray) -> bytes | None:
    """The counts of a set; null where one doesn't fit a byte."""
    n = np.bincount((h >> np.uint64(20)).astype(np.int64) % BINS, minlength=BINS)
    return n.astype(np.uint8).tobytes() if n.max() < 256 else None


def likeliest(pairs: DataFrame, n: int) -> DataFrame:
    """n pairs of each a at most, those with the most in common at most. pairs: (a, b, share)."""
    order = Window.partitionBy("a").orderBy(F.desc("share"), "b")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def _wanted_at(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte, bit of it) of ids in the table of WANTED bits."""
    at = (_mix(ids.view(np.uint64)[:, None]) % np.uint64(WANTED)).astype(np.int64)
    return at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8)


def mark_wanted(bits: np.ndarray, ids: np.ndarray) -> None:
    """Sets the bits of ids. A byte for each would take eight times the room, most of it for a few ids too."""
    byte, bit = _wanted_at(ids)
    np.bitwise_or.at(bits, byte, bit)


def verified(pairs: DataFrame, texts: DataFrame, first: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets have the similarity. texts: (id, text)."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def mark(batches):
        bits = np.zeros(WANTED // 8, np.uint8)
        for b in batches:
            mark_wanted(bits, b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        if bits.any():
            yield _slices(bits)

    wanted = texts.sparkSession.sparkContext.broadcast(_added_up(named, mark, lambda a, b: b if a is None else a | b, WANTED // 8 // SLICES).ravel())  # WANTED / 8 bytes

    def sets(batches):
        for b in batches:
            byte, bit = _wanted_at(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            b = b.filter(pa.array((wanted.value[byte] & bit).astype(bool)))
            for lo, h, ends in _sets(b.column(1)):
                digests = [_digest(h[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0)[lo : lo + len(digests)], pa.array(digests, pa.binary()), lists], names=["id", "digest", "s"])

    known = first.select(F.col("digest").alias("own"), F.col("first_id").alias("id")).join(named, "id", "left_semi")
    # digests are of one length, so that one begins with the other if they are equal; as a join key they would have the sets dealt out by it, and again by id
    have = texts.mapInArrow(sets, "id long, digest binary, s array<long>").join(known, "id").where(F.startswith("digest", "own")).dropDuplicates(["id"]).select("id", "s")
    both = pairs.join(have.withColumnsRenamed({"id": "a", "s": "sa"}), "a").join(have.withColumnsRenamed({"id": "b", "s": "sb"}), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= similarity * (F.size("sa") + F.size("sb") - common)).select("a", "b")


class Linked(NamedTuple):
    #: (a, b): near copies among the sets, and copies of ids that have several sets
    near: DataFrame
    #: (a, b): the other copies, each with its set's smallest id; no other link has their a
    copies: DataFrame
    #: (node, root) of near
    roots: DataFrame


def grown(roots: DataFrame, more: DataFrame) -> DataFrame:
    """(node, root) with more links: only the components that these join are gone through again."""
    at = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_"))
    ends = more.select("a", "b").join(at("a"), "a", "left").join(at("b"), "b", "left")
    joined = connected_components(ends.select(F.coalesce("a_", "a").alias("a"), F.coalesce("b_", "b").alias("b")))
    new = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
    before = roots.join(new, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return cut(before.unionByName(joined.join(roots.select("node"), "node", "left_anti")))


def linked(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> Linked:
    """All links of copies and near copies that its components need."""

    def run(batches):
        for b in batches:
            for lo, h, ends in _sets(b.column(1)):
                n = len(ends) - 1
                fp = set_prints(h, np.repeat(np.arange(n), np.diff(ends)), n)
                digests = [_digest(h[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
                counts = [bins(h[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo : lo + n], pa.array(digests, pa.binary()), pa.array([x.tobytes() for x in fp.astype("<u8")], pa.binary()), pa.array(counts, pa.binary())], names=["id", "digest", "fp", "bins"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.col("id").isNotNull())
    prints = cut(texts.mapInArrow(run, "id long, digest binary, fp binary, bins binary"))
    first = cut(prints.groupBy("digest").agg(F.min("id").alias("first_id"), F.min("fp").alias("fp"), F.min("bins").alias("bins")))
    copies = prints.join(first.select("digest", "first_id"), "digest").where("id <> first_id").select(F.col("id").alias("a"), F.col("first_id").alias("b"))
    several = cut(prints.groupBy("id").agg((F.min("digest") < F.max("digest")).alias("several")).where("several").select(F.col("id").alias("a")))
    pairs = cut(proposals(first.select(F.col("first_id").alias("id"), "fp"), plan_tables(first.count(), similarity)))
    found = cut(verified(pairs, texts, first, similarity).unionByName(copies.join(several, "a", "left_semi")))
    occurrences = Occurrences(cut(postings(texts, first, similarity)), first.select(F.col("first_id").alias("id"), "bins"))
    roots = connected_components(found)
    seen = pairs
    for partners_of in ROUNDS:
        fresh = crossings(occurrences, roots, similarity, partners_of).join(seen, ["a", "b"], "left_anti")
        pairs = cut((likeliest(fresh, BEST) if partners_of else fresh).select("a", "b"))
        if pairs.isEmpty():  # a capped round looks at some partners only: the last one looks at all
            continue
        seen = seen.unionByName(pairs)
        more = cut(verified(pairs, texts, first, similarity))
        if not more.isEmpty():
            found, roots = found.unionByName(more), grown(roots, more)
    return Linked(found, copies.join(several, "a", "left_anti"), roots)


def links(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b): pairs of ids, a > b, whose texts are copies or near copies; all components of such pairs come out whole."""
    out = linked(docs, similarity, id_col, text_col)
    return out.near.unionByName(out.copies)


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those whose component has a smaller id."""
    out = linked(docs, similarity, id_col, text_col)
    gone = out.roots.where("node <> root").select(F.col("node").alias("__gone")).unionByName(out.copies.select(F.col("a").alias("__gone")))
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
