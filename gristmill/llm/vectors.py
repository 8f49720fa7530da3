"""Blocks of vectors: queries meet only the cells that can hold their answers.

Vectors are dealt to parts by the nearest of some centres, which come from a bounded sample; a part that is larger
than a cell, as copies of one vector make it, is split into several cells, and the queries of a cell into blocks. So a
task holds a bounded number of vectors and queries, and tasks grow with the data. What a query
needs of the parts is the operator's to say: the few nearest, or all that its bounds can't rule out. Vectors
travel packed, a payload for each chunk and task.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a cell, and queries of a block, on the mean; parts at most.
CELL_ROWS, QUERY_ROWS, PARTS = 16384, 8192, 1024
#: Vectors that centres and thresholds are fitted on at most.
SAMPLE = 8192


def finite(vec: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", nonzero: bool = False) -> DataFrame:
    vec = F.col(vec_col).cast("array<double>")
    out = df.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(finite(F.col("v")), F.lit(False)))
    return out.where(F.exists("v", lambda x: x != 0)) if nonzero else out


def sampled(vectors: DataFrame, size: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of at most `size` rows picked by a hash of their id; shorter vectors end in zeros."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(size).toArrow()
    return rows.column("vec_id").to_numpy().astype(np.int64), _rows(rows.column("v").combine_chunks())


def _rows(column) -> np.ndarray:
    """A column of lists as one table; shorter lists end in zeros."""
    if not len(column):
        return np.zeros((0, 0))
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return _table(column.flatten().to_numpy(zero_copy_only=False), sizes)


def _table(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    width = int(sizes.max(initial=0))
    if len(flat) == width * len(sizes):
        return np.asarray(flat, np.float64).reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def centres(x: np.ndarray, parts: int, rounds: int = 6, seed: int = 13) -> np.ndarray:
    """(parts or fewer, width): k-means of the sample."""
    rng = np.random.default_rng(seed)
    c = np.unique(x[rng.permutation(len(x))[:parts]], axis=0)
    for _ in range(rounds if len(c) > 1 else 0):
        own = nearest_centre(x, c)
        count = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c


def nearest_centre(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    c = pad(c, x.shape[1])
    return (((c * c).sum(axis=1) / 2)[None] - x[:, : c.shape[1]] @ c[:, : x.shape[1]].T).argmin(axis=1)


def _hash(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)


def _pack(ids: np.ndarray, x: np.ndarray) -> bytes:
    return ids.astype("<i8").tobytes() + np.ascontiguousarray(x, "<f8").tobytes()


def unpack(blobs: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and their vectors, rows alike in both once; shorter vectors end in zeros."""
    ids, xs = [], []
    for n, raw in blobs:
        ids.append(np.frombuffer(raw, "<i8", n))
        xs.append(np.frombuffer(raw, "<f8", -1, 8 * n).reshape(n, -1))
    if not ids:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    width = max(x.shape[1] for x in xs)
    ids, out = np.concatenate(ids), np.concatenate([pad(x, width) for x in xs])
    order = np.argsort(ids, kind="stable")
    ids, out = ids[order], out[order]
    if (ids[1:] == ids[:-1]).any():
        keep = sorted({(i, x.tobytes()): n for n, (i, x) in enumerate(zip(ids.tolist(), out, strict=True))}.values())
        ids, out = ids[keep], out[keep]
    return ids, out


def pad(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] >= width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


class Parts:
    """Where vectors lie and which parts a query needs.

    place(x): what distances are measured on. measure(x, part): a row of numbers a part, of which the largest counts.
    route(ids, x, stats): (query index, part) pairs.
    """

    def __init__(self, centre: np.ndarray):
        self.centre = centre

    def place(self, x: np.ndarray) -> np.ndarray:
        return x

    def of(self, x: np.ndarray) -> np.ndarray:
        return nearest_centre(self.place(x), self.centre)

    def measure(self, x: np.ndarray, part: np.ndarray) -> np.ndarray:
        return np.zeros((len(x), 2))

    def route(self, ids: np.ndarray, x: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError


def _each(batches):
    for b in batches:
        if b.num_rows:
            yield b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), _rows(b.column(1))


def search(vectors: DataFrame, query_every: int, k: int, parts: Parts, cell: Callable, score_type: str) -> DataFrame:
    """The k best candidates of every query: (query_id, rank, vec_id, score).

    vectors: (vec_id, v) without unusable rows. Queries: ids divisible by query_every; candidates: all but
    the query itself. cell(ids, vectors) prepares a cell; calling what it returns with (query ids, query
    vectors) yields arrays (query index, candidate ids, scores), k or more of the best for each query. Rows alike in
    id and vector are one; other rows that share an id are separate candidates, and one of them asks for their id.
    """
    m = len(parts.centre)

    def tally(batches):
        n, top = np.zeros(m, np.int64), np.full((m, 2), -np.inf)
        for _, x in _each(batches):
            own = parts.of(x)
            n += np.bincount(own, minlength=m)
            np.maximum.at(top, own, parts.measure(x, own))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(top[at, 0]), pa.array(top[at, 1])], names=["part", "n", "a", "b"])

    found = vectors.mapInArrow(tally, "part int, n long, a double, b double").groupBy("part").agg(F.sum("n").alias("n"), F.max("a").alias("a"), F.max("b").alias("b")).collect()  # PARTS rows at most
    sizes, stats = np.zeros(m, np.int64), np.full((m, 2), -np.inf)
    for part, n, a, b in found:
        sizes[part], stats[part] = n, (a, b)
    queries = vectors.where(F.col("vec_id") % query_every == 0)

    def asked(batches):
        n = np.zeros(m, np.int64)
        for ids, x in _each(batches):
            n += np.bincount(parts.route(ids, x, stats)[1], minlength=m)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], names=["part", "n"])

    wanted = np.zeros(m, np.int64)
    for part, n in queries.mapInArrow(asked, "part int, n long").groupBy("part").agg(F.sum("n")).collect():  # PARTS rows at most
        wanted[part] = n
    cells, blocks = np.maximum(1, -(-sizes // CELL_ROWS)), -(-wanted // QUERY_ROWS)
    first = np.cumsum(cells * blocks) - cells * blocks
    tasks = max(1, int((cells * blocks).sum()))

    def dealt(kind: int, target: np.ndarray, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(target, kind="stable")
        target = target[order]
        cuts = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else np.zeros(0, np.int64)
        for i, j in zip(cuts, np.append(cuts[1:], len(target))[: len(cuts)], strict=True):
            yield int(target[i]), kind, int(j - i), _pack(ids[order[i:j]], x[order[i:j]])

    def copies(part: np.ndarray, base: np.ndarray, count: np.ndarray, step: np.ndarray):
        """(row, target): `count` targets of a row, `step` apart."""
        row = np.repeat(np.arange(len(part)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        return row, base[row] + nth * step[row]

    def packed(batches):
        for ids, x in _each(batches):
            own, h = parts.of(x), _hash(ids)
            base = first[own] + (h % cells[own].astype(np.uint64)).astype(np.int64) * blocks[own]
            row, target = copies(own, base, blocks[own], np.ones(len(own), np.int64))
            rows = list(dealt(0, target, ids[row], x[row]))
            mine = np.flatnonzero(ids % query_every == 0)
            if len(mine):
                at, part = parts.route(ids[mine], x[mine], stats)
                at = mine[at]
                block = ((h[at] >> np.uint64(7)) % np.maximum(blocks[part], 1).astype(np.uint64)).astype(np.int64)
                row, target = copies(part, first[part] + block, cells[part], blocks[part])
                rows += dealt(1, target, ids[at][row], x[at][row])
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.binary())], names=["target", "kind", "n", "payload"])

    def run(batches):
        met: dict[int, tuple[list, list]] = {}
        for b in batches:
            for target, kind, n, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                met.setdefault(target, ([], []))[kind].append((n, blob))
        for data, asks in met.values():
            ids, vec = unpack(data)
            q_ids, q_vec = unpack(asks)
            if not len(ids) or not len(q_ids):
                continue
            width = max(vec.shape[1], q_vec.shape[1])
            at, cand, score = cell(ids, pad(vec, width))(q_ids, pad(q_vec, width))
            own = cand == q_ids[at]
            at, cand, score = at[~own], cand[~own], score[~own]
            order = np.lexsort((cand, -score, at))
            at, cand, score = at[order], cand[order], score[order]
            begin = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
            rank = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
            top = rank < k
            keys = np.array([zlib.crc32(q.tobytes()) for q in q_vec], np.int64)
            at, cand, score = at[top], cand[top], score[top]
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(keys[at]), pa.array(cand), pa.array(score)], names=["query_id", "asker", "vec_id", "score"])

    near = vectors.mapInArrow(packed, "target int, kind int, n int, payload binary").repartitionById(tasks, "target").mapInArrow(run, f"query_id long, asker long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_id").orderBy("asker", F.col("score").desc(), "vec_id")
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # fewer than k candidates of the first asker would let the next one in
    best = best.withColumn("first", F.min("asker").over(Window.partitionBy("query_id"))).where(F.col("asker") == F.col("first"))
    return best.select("query_id", "rank", "vec_id", "score")
