"""Exact removal of repeated byte strings with suffix arrays.

A byte goes if some `length`-byte string that covers it also starts earlier: in a document
with a smaller id, or earlier in the same one. Overlaps count; strings are judged on the input.

1. Anchors. In each window of `length` bytes the 32-byte gram with the least hash is its anchor; runs
   of windows with one anchor form a context. Equal windows have equal anchors, so
   windows whose anchor stands at one place only can't repeat and leave early. Grams that stand in
   very many places yield to others, so no anchor gathers much distinct text.
2. Contexts of repeated anchors go to the bucket of their anchor, so equal strings meet in one bucket. Equal contexts
   collapse to the earliest before anything is sorted: a large group of copies costs one.
3. The contexts of a bucket are cut into shards of bounded size, between anchors where those are small enough. Each shard has a suffix array: Larsson-Sadakane
   refinement of the still unsorted groups, as deep as the comparison needs; Kasai's bound gives common prefixes; runs of
   `length` common bytes are one string, whose earliest place stays. Shards that share an anchor merge by
   binary search of one shard's strings in the sorted strings of another.
4. Removed intervals return to their documents.

Rows travel between steps as packed Arrow payloads, a payload for each chunk and target.

Defined results: a null text is empty; texts shorter than `length` lose nothing; a repeated row (same id and
text) counts as one place, so its copies fare alike; rows that share an id but not the text are judged as one document
whose texts start alike at 0; a null id sorts first; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import shuffle_partitions

LENGTH = 100
GRAM = 32
#: Bytes of text that one numpy pass takes; longer texts are cut into slices that overlap by length - 1.
CHUNK = 1 << 21
#: Bits of a place in a chunk: hashes are compared by the same bits whatever the length of their chunk.
PLACE_BITS = CHUNK.bit_length() + 1
#: Bytes of contexts of a shard, under one suffix array.
BLOCK = 3 << 19
#: Buckets of contexts for each task of texts.
BUCKETS = 2
#: Bytes of text that a task holds, on the mean.
TASK_BYTES = 1 << 25
#: A gram that a chunk holds this often is reported; the sums decide which are frequent.
REPORT = 8
#: Frequent grams that tasks are told of at most: 16 MB. They only balance the load; no string is lost without them.
FREQUENT = 1 << 20
NULL_ID = -(1 << 63)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93)]


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes at each place, by doubling."""
    h = buf.astype(np.uint64) + np.uint64(1)
    n = 1
    while n < GRAM:
        right = h[n:]
        h = h[:-n] * _MIX[0] + (right ^ (right >> np.uint64(29))) * _MIX[1]
        n *= 2
    h ^= h >> np.uint64(32)
    h *= _MIX[2]
    h ^= h >> np.uint64(32)
    return h


def _is_frequent(h: np.ndarray, frequent: np.ndarray, table: np.ndarray) -> np.ndarray:
    found = table[(h >> np.uint64(44)).astype(np.int64)]
    maybe = np.flatnonzero(found)
    if len(maybe):
        at = np.minimum(np.searchsorted(frequent, h[maybe]), len(frequent) - 1)
        found[maybe] = frequent[at] == h[maybe]
    return found


def frequent_table(frequent: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << 20, bool)
    table[(frequent >> np.uint64(44)).astype(np.int64)] = True
    return table


def contexts_of(units: list[tuple[int, int, bytes]], length: int, frequent: np.ndarray, table: np.ndarray):
    """units: (document, place of the slice in it, bytes). Arrays (document, first window, windows, anchor - first, anchor hash)."""
    units = [u for u in units if len(u[2]) >= length]
    if not units:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64)
    buf = np.frombuffer(b"".join(u[2] for u in units), np.uint8)
    sizes = np.array([len(u[2]) for u in units])
    begin = np.cumsum(sizes) - sizes
    h = gram_hashes(buf)
    bits = np.uint64(PLACE_BITS)
    key = (h >> (bits + np.uint64(1))) << bits | np.arange(len(h), dtype=np.uint64)
    if len(frequent):
        key |= _is_frequent(h, frequent, table).astype(np.uint64) << np.uint64(63)
    span, n = length - GRAM + 1, 1
    while 2 * n <= span:
        key = np.minimum(key[:-n], key[n:])
        n *= 2
    if span > n:
        key = np.minimum(key[: n - span], key[span - n :])
    windows = sizes - length + 1
    unit = np.repeat(np.arange(len(units)), windows)
    start = np.arange(len(unit)) - np.repeat(np.cumsum(windows) - windows, windows)
    anchor = (key[start + begin[unit]] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (unit[1:] != unit[:-1])))
    count = np.diff(np.append(new, len(unit)))
    u, s, a = unit[new], start[new], anchor[new]
    doc = np.array([x[0] for x in units])[u]
    place = np.array([x[1] for x in units])[u]
    return doc, place + s, count, a - begin[u] - s, h[a]


def sliced(texts: list[bytes], length: int):
    """Lists of units of about CHUNK bytes; each window lies in exactly one unit."""
    units, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), CHUNK):
            part = t[at : at + CHUNK + length - 1]
            if size and size + len(part) > CHUNK:
                yield units
                units, size = [], 0
            units.append((i, at, part))
            size += len(part)
    if units:
        yield units


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob)


def _arrays(raw: bytes, rows: int, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, rows, at))
        at += out[-1].nbytes
    return out


SCHEMA = "target int, kind int, n int, payload binary"
NAMES = ["target", "kind", "n", "payload"]
RECORD = ("<i8", "<u4", "<u8")  # document, crc32 of its text, place << 16 | windows << 8 | anchor
INTERVAL = ("<i8", "<u4", "<i8", "<i8")  # document, crc32, start, end


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    t, k, n, p = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(k, pa.int32()), pa.array(n, pa.int32()), pa.array(p, pa.binary())], names=NAMES)


def _deal(target: np.ndarray, kind: int, arrays: list[np.ndarray]) -> list[tuple]:
    """A row for each target that has records."""
    if not len(target):
        return []
    order = np.argsort(target, kind="stable")
    target, arrays = target[order], [a[order] for a in arrays]
    cut = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
    ends = np.append(cut[1:], len(target))
    return [(int(target[i]), kind, int(j - i), _pack(*(a[i:j] for a in arrays))) for i, j in zip(cut, ends, strict=True)]


def _home(doc: np.ndarray, n: int) -> np.ndarray:
    """The task that holds a document."""
    with np.errstate(over="ignore"):
        h = doc.astype(np.int64).view(np.uint64) * _MIX[0]
    return ((h >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    ids = np.array([NULL_ID if i is None else i for i in batch.column(0).to_pylist()], np.int64)
    texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
    return ids, texts, np.fromiter(map(zlib.crc32, texts), np.uint32, len(texts))


def sorted_order(key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of their keys, the keys in it), stable; keys have `width` bits. Key and place are sorted as one number where
    both have room, which is several times as quick as sorting places."""
    bits = max(1, len(key) - 1).bit_length()
    if width + bits > 63:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    both = np.sort(key << bits | np.arange(len(key)))
    return both & ((1 << bits) - 1), both >> bits


def suffix_order(symbols: np.ndarray, ends: np.ndarray, need: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes, equal where `depth` symbols are. Larsson-Sadakane: ranks are the first places of
    groups, only groups of two or more are refined, and each round doubles the sorted depth.

    symbols: bytes + 1, contexts end in 0. ends: place of that 0 for each place. need: depth wanted at each place.
    """
    size = len(symbols)
    # need is at most depth at a window's start and less by one a place after its last; a rank that is
    # read h places on must itself be sorted to h, so `need` tells who still takes part
    used = np.bincount(symbols, minlength=1) > 0
    used[0] = True  # what ends a context stays 0
    letters, bits = int(used.sum()), max(1, size - 1).bit_length()
    h = 1
    while h < 7 and letters ** (h + 1) < 1 << 63 - bits:
        h += 1
    wide = np.append((np.cumsum(used) - 1)[symbols], np.zeros(h, np.int64))
    key = np.zeros(size, np.int64)
    alive = np.ones(size, bool)
    for k in range(h):
        key = key * letters + np.where(alive, wide[k : k + size], 0)
        alive &= wide[k : k + size] > 0
    order, ranked = sorted_order(key, (letters**h - 1).bit_length())
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    counts = np.diff(np.append(first, size))
    rank = np.empty(size, np.int64)
    rank[order] = np.repeat(first, counts)
    single = np.zeros(size, bool)
    single[order] = np.repeat(counts == 1, counts)
    while h < depth:
        take = np.flatnonzero(~single & (need > h))
        if not len(take):
            break
        order, key = sorted_order(rank[take] << bits | rank[np.minimum(take + h, ends[take])], 2 * bits)
        take, old = take[order], key >> bits
        group = np.append(True, old[1:] != old[:-1])
        fine = np.append(True, key[1:] != key[:-1])
        at = np.arange(len(take))
        group_at = np.maximum.accumulate(np.where(group, at, 0))
        fine_at = np.maximum.accumulate(np.where(fine, at, 0))
        rank[take] = old + fine_at - group_at
        starts = np.flatnonzero(fine)
        single[take] = np.repeat(np.diff(np.append(starts, len(take))) == 1, np.diff(np.append(starts, len(take))))
        h *= 2
    return rank


class Block:
    """Suffix array, common prefixes and classes of equal windows of some contexts."""

    def __init__(self, blob: bytes, windows: np.ndarray, length: int):
        self.length = length
        sizes = windows + length - 1
        raw = np.frombuffer(blob, np.uint8)
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        symbols = np.zeros(len(raw) + len(sizes), np.int16)
        base = begin + np.arange(len(sizes))  # a closing 0 after each context
        symbols[np.arange(len(raw)) + owner] = raw.astype(np.int16) + 1
        end = base + sizes
        ends = np.repeat(end, sizes + 1)
        left = ends - np.arange(len(symbols))
        need = np.minimum(left, length)
        rank = suffix_order(symbols, ends, need, length)
        # suffixes that begin a window, in order
        self.context = np.repeat(np.arange(len(sizes)), windows)
        self.offset = np.arange(len(self.context)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.at = begin[self.context] + self.offset  # in raw
        self.raw = np.append(raw, np.zeros(16, np.uint8))
        self.array = sorted_order(rank[base[self.context] + self.offset], max(1, len(symbols)).bit_length())[0]
        common = self._kasai(windows)
        self.fresh = np.append(True, common[1:] < length) if len(common) else np.zeros(0, bool)
        label = np.cumsum(self.fresh) - 1
        self.label = np.empty(len(label), np.int64)
        self.label[self.array] = label
        self.reps = self.at[self.array[self.fresh]]  # places of the distinct windows, sorted by their bytes

    def words(self, at: np.ndarray, k: int) -> np.ndarray:
        """Eight bytes, big-endian, k words on; short of `length` the rest is cut off."""
        if not hasattr(self, "_w8"):
            w = self.raw.astype(np.uint64)
            w = w[:-1] << np.uint64(8) | w[1:]
            w = w[:-2] << np.uint64(16) | w[2:]
            self._w8 = w[:-4] << np.uint64(32) | w[4:]
        got = self._w8[at + 8 * k]
        spare = 8 * (k + 1) - self.length
        return got >> np.uint64(8 * spare) if spare > 0 else got

    def _kasai(self, windows: np.ndarray) -> np.ndarray:
        """Common bytes of each window with the one before it in the array, `length` at most. Window o of all contexts
        at once; it has at least one byte less in common than window o - 1 had, if the neighbour's next window exists."""
        n = len(self.array)
        place = np.empty(n, np.int64)
        place[self.array] = np.arange(n)
        head = np.cumsum(windows) - windows
        before = np.where(place > 0, self.array[place - 1], -1)
        common = np.zeros(n, np.int64)
        last_of = windows[self.context] - 1
        for o in range(int(windows.max(initial=0))):
            i = head[windows > o] + o
            j = before[i]
            i, j = i[j >= 0], j[j >= 0]
            have = np.zeros(len(i), np.int64)
            if o:
                prior = before[i - 1]
                ok = (prior >= 0) & (self.offset[prior] < last_of[prior])
                ok &= place[np.minimum(prior + 1, n - 1)] < place[i]  # equal to the sorted depth, their next may have changed sides
                have[ok] = np.maximum(common[i[ok] - 1] - 1, 0)
            live = np.arange(len(i))
            while len(live):
                same = self.raw[self.at[i[live]] + have[live]] == self.raw[self.at[j[live]] + have[live]]
                eight = np.zeros(len(live), bool)
                room = have[live] + 8 <= self.length
                r = live[room]
                eight[room] = self.words(self.at[i[r]] + have[r], 0) == self.words(self.at[j[r]] + have[r], 0)
                have[live] += np.where(eight, 8, same)
                live = live[same & (have[live] < self.length)]
            common[i] = have
        return common[self.array]

    def find(self, other: Block) -> np.ndarray:
        """For each distinct window of other, its place among our distinct windows, or -1: binary search."""
        steps = -(-self.length // 8)
        low, high = np.zeros(len(other.reps), np.int64), np.full(len(other.reps), len(self.reps))
        want = [other.words(other.reps, k) for k in range(steps)]

        def compare(mid: np.ndarray, rows: np.ndarray) -> np.ndarray:
            sign = np.zeros(len(rows), np.int8)
            open_ = np.arange(len(rows))
            for k in range(steps):
                a, b = self.words(self.reps[mid[open_]], k), want[k][rows[open_]]
                sign[open_] = (a > b).astype(np.int8) - (a < b).astype(np.int8)
                open_ = open_[a == b]
                if not len(open_):
                    break
            return sign

        while len(rows := np.flatnonzero(low < high)):
            mid = (low[rows] + high[rows]) // 2
            less = compare(mid, rows) < 0
            low[rows[less]] = mid[less] + 1
            high[rows[~less]] = mid[~less]
        found = np.full(len(other.reps), -1)
        rows = np.flatnonzero(low < len(self.reps))
        hit = compare(low[rows], rows) == 0 if len(rows) else np.zeros(0, bool)
        found[rows[hit]] = low[rows[hit]]
        return found


def repeated_windows(blobs: list[bytes], windows: np.ndarray, order: np.ndarray, length: int = LENGTH, block_bytes: int = BLOCK) -> np.ndarray:
    """For every window of every context: does it also stand earlier?

    order: a number for each context, such that order + offset compares the places of windows.
    """
    sizes = windows + length - 1
    split, size = [0], 0
    for k, s in enumerate(sizes.tolist()):
        if size and size + s > block_bytes:
            split.append(k)
            size = 0
        size += s
    split.append(len(sizes))
    blocks, least, places = [], [], []
    for lo, hi in zip(split[:-1], split[1:], strict=True):
        b = Block(b"".join(blobs[lo:hi]), windows[lo:hi], length)
        where = order[lo:hi][b.context] + b.offset
        first = np.full(len(b.reps), np.iinfo(np.int64).max)
        np.minimum.at(first, b.label, where)
        for k, other in enumerate(blocks):
            at = other.find(b)
            hit = at >= 0
            best = np.minimum(first[hit], least[k][at[hit]])
            first[hit] = best
            least[k][at[hit]] = best
        blocks.append(b)
        least.append(first)
        places.append(where)
    # a string in three blocks: its least place passes on from block to block, so look back once more
    for j in range(len(blocks) - 1, -1, -1):
        for k in range(j):
            at = blocks[k].find(blocks[j])
            hit = at >= 0
            best = np.minimum(least[j][hit], least[k][at[hit]])
            least[j][hit] = best
            least[k][at[hit]] = best
    return np.concatenate([w > f[b.label] for b, f, w in zip(blocks, least, places, strict=True)]) if blocks else np.zeros(0, bool)


def families(anchors: np.ndarray, sizes: np.ndarray, block_bytes: int = BLOCK) -> list[tuple[int, int]]:
    """Ranges of contexts, sorted by anchor, that share no anchor with each other, near `block_bytes` each; an anchor with more stands alone."""
    new = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1])) if len(anchors) else np.zeros(0, np.int64)
    out, at, size = [], 0, 0
    for k, s in zip(new.tolist(), np.add.reduceat(sizes, new).tolist() if len(new) else [], strict=True):
        if size and size + s > block_bytes:
            out.append((at, k))
            at, size = k, 0
        size += s
    return [*out, (at, len(anchors))] if len(anchors) else []


def _frequent_grams(texts: DataFrame, length: int, n: int) -> np.ndarray:
    """Sorted hashes of grams at over 1/16 of the mean number of contexts of a task; FREQUENT at most, the commonest."""

    def run(batches):
        for b in batches:
            _, rows, _ = _texts(b)
            for units in sliced(rows, length):
                raw = b"".join(u[2] for u in units)
                if len(raw) < GRAM:
                    continue
                h = np.sort(gram_hashes(np.frombuffer(raw, np.uint8)))
                first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                count = np.diff(np.append(first, len(h)))
                many = count >= REPORT
                g = [None, *h[first[many]].view(np.int64).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array([len(raw), *count[many].tolist()], pa.int64())], names=["g", "c"])

    sums = texts.mapInArrow(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))
    sums = sums.where(F.col("g").isNull() | (F.col("c") >= 512)).orderBy(F.col("g").isNull().desc(), F.col("c").desc(), "g").limit(FREQUENT)
    rows = sums.toArrow()
    g, c = rows.column("g").to_pylist(), rows.column("c").to_pylist()
    if not g:
        return np.zeros(0, np.uint64)
    least = max(512, c[0] // (35 * 16 * n))
    return np.sort(np.array([x for x, y in zip(g[1:], c[1:], strict=True) if y >= least], np.int64).view(np.uint64))


def removed_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of every row."""
    if not GRAM <= length <= GRAM + 255:
        raise ValueError("length must lie between 32 and 287")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n = max(shuffle_partitions(spark), -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // TASK_BYTES))
    told = spark.sparkContext.broadcast(_frequent_grams(texts, length, n))

    def anchors(batches):
        frequent = told.value
        table = frequent_table(frequent)
        for b in batches:
            ids, rows, crc = _texts(b)
            for units in sliced(rows, length):
                doc, place, count, anchor, h = contexts_of(units, length, frequent, table)
                if not len(doc):
                    continue
                code = place.astype(np.uint64) << np.uint64(16) | (count.astype(np.uint64) - np.uint64(1)) << np.uint64(8) | anchor.astype(np.uint64)
                _, first, back, copies = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                here = copies[back] > 1  # repeats in this chunk need no answer; others are told of one place
                flag = (copies > 1).astype(np.uint8)
                target = ((h[first] >> np.uint64(20)) % np.uint64(n)).astype(np.int64)
                out = _deal(target, 0, [h[first], ids[doc[first]], crc[doc[first]], code[first], flag])
                out += _deal(_home(ids[doc[here]], n), 1, [ids[doc[here]], crc[doc[here]], code[here]])
                yield _emit(out)

    def answers(batches):
        parts = []
        for b in batches:
            for target, kind, rows, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == 0:
                    parts.append(_arrays(_unpack(blob), rows, "<u8", *RECORD, "<u1"))
                else:
                    yield _emit([(target, 1, rows, blob)])
        if parts:
            h, doc, crc, code, flag = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            h, doc, crc, code, flag = h[order], doc[order], crc[order], code[order], flag[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            count = np.diff(np.append(first, len(h)))
            again = np.repeat((count > 1) | (np.maximum.reduceat(flag, first) > 0), count) & (flag == 0)
            yield _emit(_deal(_home(doc[again], n), 1, [doc[again], crc[again], code[again]]))

    def sent(batches):
        for b in batches:
            ids, rows, crc = _texts(b)
            for lo in range(0, len(rows), 512):
                home = _home(ids[lo : lo + 512], n)
                for t in np.unique(home):
                    at = np.flatnonzero(home == t) + lo
                    blob = np.frombuffer(b"".join(rows[i] for i in at), np.uint8)
                    sizes = np.array([len(rows[i]) for i in at], np.int64)
                    yield _emit([(int(t), 2, len(at), _pack(ids[at], crc[at], sizes, blob))])

    def held(blob: bytes, rows: int):
        raw = _unpack(blob)
        ids, crc, sizes = _arrays(raw, rows, "<i8", "<u4", "<i8")
        at = 20 * rows + np.append(0, np.cumsum(sizes))
        return [(int(i), int(c), raw[a:b]) for i, c, a, b in zip(ids, crc, at[:-1], at[1:], strict=True)]

    def cut_out(batches):
        docs, parts = {}, []
        for b in batches:
            for _, kind, rows, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == 2:
                    docs.update({(i, c): t for i, c, t in held(blob, rows)})
                else:
                    parts.append(_arrays(_unpack(blob), rows, *RECORD))
        if not parts:
            return
        doc, crc, code = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((code, doc))
        doc, crc, code = doc[order], crc[order], code[order]
        place, count, anchor = (code >> np.uint64(16)).astype(np.int64), ((code >> np.uint64(8)) & np.uint64(255)).astype(np.int64) + 1, (code & np.uint64(255)).astype(np.int64)
        seen: dict[bytes, int] = {}
        later, first, grams = [], [], []
        for k, (d, c, p, w, a) in enumerate(zip(doc.tolist(), crc.tolist(), place.tolist(), count.tolist(), anchor.tolist(), strict=True)):
            text = docs[d, c][p : p + w + length - 1]
            known = seen.setdefault(text, k)
            if known == k:
                first.append(k)
                grams.append(zlib.crc32(text[a : a + GRAM]))
            elif doc[known] != d or place[known] != p:
                later.append(k)
        out = []
        if later:
            at = np.array(later)
            out += _deal(_home(doc[at], n), 4, [doc[at], crc[at], place[at], place[at] + count[at] + length - 1])
        blobs = list(seen)
        grams = np.array(grams, np.uint32)
        shard = grams.astype(np.int64) % (BUCKETS * n)
        first = np.array(first)
        for t in np.unique(shard):
            mine = np.flatnonzero(shard == t)
            at = first[mine]
            text = np.frombuffer(b"".join(blobs[i] for i in mine), np.uint8)
            out.append((int(t), 3, len(at), _pack(doc[at], crc[at], place[at], count[at].astype(np.int64), grams[mine], text)))
        yield _emit(out)

    def judged(batches):
        records, blobs = [], []
        for b in batches:
            for target, kind, rows, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == 4:
                    yield _emit([(target, 4, rows, blob)])
                    continue
                raw = _unpack(blob)
                part = _arrays(raw, rows, "<i8", "<u4", "<i8", "<i8", "<u4")
                ends = 32 * rows + np.cumsum(part[3] + length - 1)
                blobs += [raw[e - w - length + 1 : e] for e, w in zip(ends.tolist(), part[3].tolist(), strict=True)]
                records.append(part)
        if not records:
            return
        doc, crc, place, count, gram = (np.concatenate(x) for x in zip(*records, strict=True))
        # equal contexts collapse to the earliest; the others' windows all stand earlier
        by_place = np.lexsort((place, doc))
        seen: dict[bytes, int] = {}
        later, first = [], []
        for k in by_place.tolist():
            known = seen.setdefault(blobs[k], k)
            if known == k:
                first.append(k)
            elif doc[known] != doc[k] or place[known] != place[k]:
                later.append(k)
        at = np.array(later, np.int64)
        spans = [(doc[at], crc[at], place[at], place[at] + count[at] + length - 1)]
        first = np.array(first)
        number = np.cumsum(np.append(0, doc[first][1:] != doc[first][:-1]))  # documents in order
        # equal windows have equal anchors, so shards that share no anchor need no merging
        kin = np.argsort(gram[first], kind="stable")
        first, number = first[kin], number[kin]
        doc, crc, place, count, gram = doc[first], crc[first], place[first], count[first], gram[first]
        where = number.astype(np.int64) << 40 | place
        again = np.concatenate([repeated_windows([blobs[k] for k in first[lo:hi].tolist()], count[lo:hi], where[lo:hi], length) for lo, hi in families(gram, count + length - 1)])
        context = np.repeat(np.arange(len(count)), count)
        offset = np.arange(len(context)) - np.repeat(np.cumsum(count) - count, count)
        begin = np.flatnonzero(again & np.append(True, ~again[:-1] | (context[1:] != context[:-1])))
        end = np.flatnonzero(again & np.append(~again[1:] | (context[1:] != context[:-1]), True))
        c = context[begin]
        spans.append((doc[c], crc[c], place[c] + offset[begin], place[c] + offset[end] + length))
        d, v, s, e = (np.concatenate(x) for x in zip(*spans, strict=True))
        yield _emit(_deal(_home(d, n), 4, [d, v, s, e]))

    def finished(batches):
        docs, parts = [], []
        for b in batches:
            for _, kind, rows, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == 2:
                    docs.append((blob, rows))
                else:
                    parts.append(_arrays(_unpack(blob), rows, *INTERVAL))
        doc, crc, start, end = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4
        order = np.lexsort((start, crc, doc))
        doc, crc, start, end = doc[order], crc[order], start[order], end[order]
        new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1]))) if len(doc) else np.zeros(0, np.int64)
        where = {(int(doc[i]), int(crc[i])): (i, j) for i, j in zip(new, np.append(new[1:], len(doc)), strict=True)} if len(doc) else {}
        for blob, rows in docs:
            out = []
            for i, c, text in held(blob, rows):
                lo, hi = where.get((i, c), (0, 0))
                kept, at, removed, spans = [], 0, 0, 0
                open_to = -1
                for s, e in zip(start[lo:hi].tolist(), end[lo:hi].tolist(), strict=True):
                    if s > open_to:
                        spans += 1
                        kept.append(text[at:s])
                        removed += e - s
                        at = open_to = e
                    elif e > open_to:
                        removed += e - open_to
                        at = open_to = e
                kept.append(text[at:])
                out.append((None if i == NULL_ID else i, len(text), removed, spans, b"".join(kept)))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols[:4]), pa.array(cols[4], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    def dealt(df: DataFrame, parts: int = n) -> DataFrame:
        return df.repartitionById(parts, "target")

    stored = texts.mapInArrow(sent, SCHEMA)
    replies = dealt(texts.mapInArrow(anchors, SCHEMA)).mapInArrow(answers, SCHEMA)
    contexts = dealt(stored.unionByName(replies)).mapInArrow(cut_out, SCHEMA)
    intervals = dealt(contexts, BUCKETS * n).mapInArrow(judged, SCHEMA)
    return dealt(stored.unionByName(intervals)).mapInArrow(finished, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    return removed_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[tuple[int, bytes]], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """The same by a dictionary of all strings; for tests."""
    seen: dict[bytes, tuple[int, int]] = {}
    out = {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if seen.setdefault(t[p : p + length], (i, p)) != (i, p):
                gone[p : p + length] = True
        gone = gone[: len(t)]
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out[i] = (len(t), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])[: len(t)]).sum()), hashlib.sha256(kept).hexdigest())
    return out
