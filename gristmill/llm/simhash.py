"""SimHash near-duplicate grouping with a bit-sliced comparison.

Fingerprints are 64-bit majority votes over the XXH64 values of word shingles.
Links join fingerprints that differ in at most `radius` bits. The comparison keeps
bit planes vertically: word w of plane b holds bit b of 64 neighbouring
fingerprints, so one XOR of a plane with its shifted self yields one bit of 64
distances, and carry-save counters add the planes up until every lane of a block
has exceeded the radius, when the block is abandoned.

Defined results: null texts count as empty; a text without words has fingerprint
zero and links like any other; repeated rows share a fingerprint and thus a
component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import chunks_by_bytes, cut, shuffle_partitions
from gristmill.llm.graph import connected_components

P1, P2, P3, P4, P5 = (
    np.uint64(x)
    for x in (
        0x9E3779B185EBCA87,
        0xC2B2AE3D27D4EB4F,
        0x165667B19E3779F9,
        0x85EBCA77C2B2AE63,
        0x27D4EB2F165667C5,
    )
)
LONG_SPAN = 256
#: Rows of one bucket that one task compares with one another; larger buckets are split into cells.
BUCKET_ROWS = 1 << 16


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _rotl(acc + word * P2, 31) * P1


def xxh64_spans(raw: bytes, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of many spans of one buffer at once; the rare very long spans go through the library."""
    import xxhash

    buf = np.frombuffer(raw + b"\0" * 8, np.uint8)
    w1 = buf.astype(np.uint64)
    w2 = w1[:-1] | (w1[1:] << np.uint64(8))
    w4 = w2[:-2] | (w2[2:] << np.uint64(16))
    w8 = w4[:-4] | (w4[4:] << np.uint64(32))
    seed64 = np.uint64(seed)
    with np.errstate(over="ignore"):
        acc = np.full(len(starts), seed64 + P5, np.uint64)
        pos, left = starts.astype(np.int64), lengths.astype(np.int64)
        wide = np.flatnonzero((left >= 32) & (left <= LONG_SPAN))
        if len(wide):
            lanes = [np.full(len(wide), v, np.uint64) for v in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
            at, rest = pos[wide].copy(), left[wide].copy()
            live = np.arange(len(wide))
            while len(live):
                for k in range(4):
                    lanes[k][live] = _round(lanes[k][live], w8[at[live] + 8 * k])
                at[live] += 32
                rest[live] -= 32
                live = live[rest[live] >= 32]
            merged = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
            for lane in lanes:
                merged = (merged ^ _round(np.uint64(0), lane)) * P1 + P4
            acc[wide], pos[wide], left[wide] = merged, at, rest
        acc += lengths.astype(np.uint64)
        live = np.flatnonzero((left >= 8) & (lengths <= LONG_SPAN))
        while len(live):
            acc[live] = _rotl(acc[live] ^ _round(np.uint64(0), w8[pos[live]]), 27) * P1 + P4
            pos[live] += 8
            left[live] -= 8
            live = live[left[live] >= 8]
        live = np.flatnonzero((left >= 4) & (lengths <= LONG_SPAN))
        if len(live):
            acc[live] = _rotl(acc[live] ^ (w4[pos[live]] * P1), 23) * P2 + P3
            pos[live] += 4
            left[live] -= 4
        live = np.flatnonzero((left > 0) & (lengths <= LONG_SPAN))
        while len(live):
            acc[live] = _rotl(acc[live] ^ (w1[pos[live]] * P5), 11) * P1
            pos[live] += 1
            left[live] -= 1
            live = live[left[live] > 0]
        acc ^= acc >> np.uint64(33)
        acc *= P2
        acc ^= acc >> np.uint64(29)
        acc *= P3
        acc ^= acc >> np.uint64(32)
    for i in np.flatnonzero(lengths > LONG_SPAN):
        acc[i] = xxhash.xxh64_intdigest(raw[starts[i] : starts[i] + lengths[i]], seed=seed)
    return acc


def shingle_spans(texts: list[bytes], words_per_shingle: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, start, length, text index) of every shingle; fewer words: the whole sequence."""
    words = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for ws in words for w in ws]
    raw = b" ".join(flat)
    lengths = np.fromiter(map(len, flat), np.int64, len(flat))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    first = np.cumsum(counts) - counts
    shingles = np.where(counts >= words_per_shingle, counts - words_per_shingle + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(words)), shingles)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    head = first[owner] + rank
    tail = head + np.minimum(counts[owner], words_per_shingle) - 1
    return raw, starts[head], ends[tail] - starts[head], owner


def fingerprint_texts(texts: list[bytes], words_per_shingle: int, seed: int) -> np.ndarray:
    """One unsigned 64-bit fingerprint a text: a bit is 1 if set in over half the shingle hashes."""
    raw, starts, lengths, owner = shingle_spans(texts, words_per_shingle)
    return majority(xxh64_spans(raw, starts, lengths, seed) if len(owner) else np.zeros(0, np.uint64), owner, len(texts))


def majority(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Bitwise votes of the hashes of each owner; zero for those without any."""
    out = np.zeros(n, np.uint64)
    if not len(owner):
        return out
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    begin = np.flatnonzero(np.diff(owner, prepend=-1))
    sums = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    totals = np.diff(np.append(begin, len(owner)))
    votes = np.packbits(2 * sums > totals[:, None], axis=1, bitorder="little")
    out[owner[begin]] = np.ascontiguousarray(votes).view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fingerprint long) of each row; whole texts, no shuffle."""

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            prints = [fingerprint_texts(texts[a:b], words_per_shingle, seed) for a, b in chunks_by_bytes(texts)]
            values = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=[id_col, "fp"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"{id_col} long, fp long")


def _planes(values: np.ndarray, width: int) -> np.ndarray:
    """(width, words) uint64: bit i of word w of plane b is bit b of value 64 w + i."""
    n = -(-len(values) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T[:width]), axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8")


def _shifted(plane: np.ndarray, words: np.ndarray, d: int) -> np.ndarray:
    """The words at `words` of a plane moved down by d lanes; beyond its end there are zeros."""
    q, r = divmod(d, 64)
    n = plane.shape[-1] - 2
    low = plane[..., np.minimum(words + q, n)]
    if not r:
        return low
    return (low >> np.uint64(r)) | (plane[..., np.minimum(words + q + 1, n + 1)] << np.uint64(64 - r))


def close_pairs(values: np.ndarray, groups: np.ndarray, radius: int, every: int = 8, reach: int | None = None):
    """Yields (i, j) index arrays of pairs of one group within the radius.

    values: unsigned 64-bit, sorted by group; two-dimensional for wider fingerprints. One round compares all lanes
    with those d places further, up to `reach`; blocks of 64 lanes leave once all their counters exceed the radius.
    """
    n = len(values)
    if n < 2:
        return
    columns = values.reshape(n, -1)
    begin = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    sizes = np.diff(np.append(begin, n))
    last = np.repeat(begin + sizes - 1, sizes)  # the last lane of each lane's group
    planes = np.pad(np.concatenate([_planes(np.ascontiguousarray(columns[:, c]), 64) for c in range(columns.shape[1])]), ((0, 0), (0, 2)))
    room = last - np.arange(n)
    if reach is not None:
        room = np.minimum(room, reach)
    width = planes.shape[1] - 2
    lanes = np.zeros(width * 64, np.int64)
    lanes[:n] = room
    furthest = lanes.reshape(-1, 64).max(axis=1)
    counters = max(1, int(radius).bit_length())
    for d in range(1, int(furthest.max(initial=0)) + 1):
        words = np.flatnonzero(furthest >= d)
        valid = np.packbits(lanes.reshape(-1, 64)[words] >= d, axis=1, bitorder="little").view("<u8").ravel()
        count = [np.zeros(len(words), np.uint64) for _ in range(counters)]
        over = ~valid
        for b in range(len(planes)):
            carry = planes[b][words] ^ _shifted(planes[b], words, d)
            for k in range(counters):
                count[k], carry = count[k] ^ carry, count[k] & carry
            over = over | carry
            if b % every == every - 1:
                live = over != np.uint64(0xFFFFFFFFFFFFFFFF)
                if not live.all():
                    words, over, count = words[live], over[live], [c[live] for c in count]
                if not len(words):
                    break
        if not len(words):
            continue
        # counters hold 0 .. 2^counters - 1; those above the radius go too
        within = ~over
        for value in range(radius + 1, 1 << counters):
            same = np.full(len(words), 0xFFFFFFFFFFFFFFFF, np.uint64)
            for k in range(counters):
                same &= count[k] if value >> k & 1 else ~count[k]
            within &= ~same
        hit = np.unpackbits(within.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        w, lane = np.nonzero(hit)
        if len(w):
            i = words[w] * 64 + lane
            yield i, i + d


class _Forest:
    """Labels that merge: vectorised relabelling, few Python steps."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def merge(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.label[i], self.label[j]
        differ = a != b
        if not differ.any():
            return
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.get(root, root)) != root:
                root = up
            while parent.get(x, x) != root:
                parent[x], x = root, parent[x]
            return root

        for x, y in set(zip(a[differ].tolist(), b[differ].tolist(), strict=True)):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        table = np.arange(len(self.label))
        for x in list(parent):
            table[x] = find(x)
        self.label = table[self.label]


def fingerprint_links(prints: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(a, b): for every two distinct fingerprints within the radius, a path of links; copies are collapsed before.

    With `blocks` blocks of bits and radius r, close fingerprints agree in blocks - r of them at least
    (pigeonhole), so each combination of that many blocks is a table keyed by their bits. Each bucket
    gives a spanning forest of its links, so rows grow with the fingerprints, not with the pairs.
    """
    if not 0 <= radius < blocks <= 64:
        raise ValueError("blocks must exceed the radius")
    spark = prints.sparkSession
    n = shuffle_partitions(spark)
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = []
    for kept in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << edges[k + 1]) - (1 << edges[k])) for k in kept)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("part", "bits"))
    heavy = cut(keyed.groupBy("part", "bits").count().where(F.col("count") > BUCKET_ROWS))
    if heavy.isEmpty():
        cells = keyed.withColumn("cell", F.lit(0))
    else:  # a large bucket becomes cells of two slices each, so that any two rows of it meet in some task
        slices = F.ceil(F.coalesce("count", F.lit(1)) / BUCKET_ROWS).cast("int")
        cells = keyed.join(heavy, ["part", "bits"], "left").withColumn("slices", slices).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int"))
        cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        cells = cells.withColumn("cell", F.least("own", "other") * F.col("slices") + F.greatest("own", "other"))

    def run(batches):
        parts = [tuple(c.to_numpy(zero_copy_only=False) for c in b.columns) for b in batches if b.num_rows]
        if not parts:
            return
        fp, part, bits, cell = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((fp, cell, bits, part))
        fp, part, bits, cell = fp[order], part[order], bits[order], cell[order]
        new = np.append(True, (part[1:] != part[:-1]) | (bits[1:] != bits[:-1]) | (cell[1:] != cell[:-1]))
        group = np.cumsum(new)
        alone = new & np.append(new[1:], True)
        fp, group = fp[~alone], group[~alone]
        forest = _Forest(len(fp))
        for i, j in close_pairs(fp.view(np.uint64), group, radius):
            forest.merge(i, j)
        linked = np.flatnonzero(forest.label != np.arange(len(fp)))
        a, b = fp[linked], fp[forest.label[linked]]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    linked = cells.select("fp", "part", "bits", "cell").repartition(n, "part", "bits", "cell").mapInArrow(run, "a long, b long")
    return linked.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, radius: int = 3) -> DataFrame:
    """(id, fp long, component_id): the smallest id reachable over links, one's own included."""
    prints = cut(fingerprints(docs, id_col, text_col, words_per_shingle))
    nodes = cut(prints.groupBy("fp").agg(F.min(id_col).alias("first_id")))
    links = fingerprint_links(nodes.select("fp"), radius)
    roots = connected_components(links)
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = named.join(smallest, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(id_col, "fp", "component_id")


def digest(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return result.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
