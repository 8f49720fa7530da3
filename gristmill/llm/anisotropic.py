"""Approximate nearest neighbours with score-aware quantisation (Guo et al. 2020).

Vectors are scaled to length one, so the largest inner product is the largest cosine. Product codes
of four bits for every two dimensions are trained on a loss that weighs the residual's part along the
vector more than the rest, since that part is what changes large inner products. A query makes tables of
its products with the code words, reduced to eight bits; a scan adds two table entries a byte of codes; the
best by the scan are ranked again exactly, in double precision, on the original vectors.

The codebooks and the centres of the parts are fitted on at most `sample` vectors picked by a hash of their id; every
vector is indexed. A query goes to as many of the parts nearest to it as hold PROBED of the true neighbours of the
sample's own vectors in the sample: few where the data has clusters, all where it has none.

Defined results: vectors that are null, zero or hold null or non-finite components take no part; very large and very
small components are scaled by powers of two, which changes no cosine; vectors of
different lengths are compared as if the shorter ended in zeros; repeated vectors have equal codes
and scores, and ties go to the smaller id; rows alike in id and vector are one; fewer candidates than k give them all; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from gristmill.llm import vectors as V

#: Vectors that the codebooks are fitted on at most.
SAMPLE = 8192
WORDS = 16
#: Candidates of a cell that are ranked exactly for each query, and all whose sums are at most SLACK below.
RERANK, SLACK = 192, 32
#: Inner product from which on candidates matter; sets the weight of the parallel error.
THRESHOLD = 0.2
#: Share of the sample's neighbours that the probed parts must hold.
PROBED = 0.99


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that no square overflows or vanishes."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, initial=0.0))
    return np.ldexp(x, -exponent[:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


class Probes(V.Parts):
    """Parts of directions; a query needs the `probes` nearest."""

    def __init__(self, sample: np.ndarray, parts: int, k: int):
        unit = _unit(sample) if len(sample) else np.zeros((0, 1))
        super().__init__(V.centres(unit, parts) if len(unit) else np.zeros((1, 1)))
        self.probes = len(self.centre)
        if self.probes > 1:
            own = V.nearest_centre(unit, self.centre)
            asks = unit[:512]
            near = asks @ unit.T
            near[np.arange(len(asks)), np.arange(len(asks))] = -np.inf
            nearest = own[np.argpartition(-near, min(k, near.shape[1] - 1), axis=1)[:, :k]]
            order = self._order(asks)
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, np.arange(order.shape[1])[None], axis=1)
            self.probes = int(np.quantile(np.take_along_axis(rank, nearest, axis=1), PROBED)) + 1

    def place(self, x: np.ndarray) -> np.ndarray:
        return _unit(x)

    def _order(self, unit: np.ndarray) -> np.ndarray:
        c = V.pad(self.centre, unit.shape[1])
        return np.argsort(((c * c).sum(axis=1) / 2)[None] - unit @ c[:, : unit.shape[1]].T, axis=1, kind="stable")

    def route(self, ids, x, stats):
        near = self._order(_unit(x))[:, : self.probes]
        return np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()


class Codes:
    """Code words for every two dimensions and the assignment that minimises the anisotropic loss."""

    def __init__(self, sample: np.ndarray, rounds: int = 6, seed: int = 5):
        d = sample.shape[1] + sample.shape[1] % 4 and -(-sample.shape[1] // 4) * 4
        self.width = max(4, d)
        eta = THRESHOLD**2 / (1 - THRESHOLD**2) * max(1, sample.shape[1] - 1)
        self.extra = max(0.0, eta - 1)  # weight of the parallel part beyond that of the whole
        x = self._parts(sample)
        rng = np.random.default_rng(seed)
        n, m = x.shape[:2]
        take = rng.integers(0, max(1, n), (m, WORDS))
        self.words = np.stack([x[take[j], j] for j in range(m)]) if n else np.zeros((m, WORDS, 2))
        self.words = self.words + rng.normal(0, 1e-4, self.words.shape)
        if not n:
            return
        code = self._nearest(x)
        for _ in range(rounds):
            self._fit(x, code)
            code = self._improve(x, code)

    def _parts(self, x: np.ndarray) -> np.ndarray:
        return V.pad(x, self.width).reshape(len(x), self.width // 2, 2)

    def _nearest(self, x: np.ndarray) -> np.ndarray:
        code = np.empty(x.shape[:2], np.uint8)
        for j in range(x.shape[1]):
            code[:, j] = ((x[:, j, None, :] - self.words[j]) ** 2).sum(axis=2).argmin(axis=1)
        return code

    def _along(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        """(n, m): each part's share of the residual's product with the vector."""
        return np.stack([((x[:, j] - self.words[j][code[:, j]]) * x[:, j]).sum(axis=1) for j in range(x.shape[1])], axis=1)

    def _improve(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        code = code.copy()
        along = self._along(x, code)
        total = along.sum(axis=1)
        for j in range(x.shape[1]):
            rest = total - along[:, j]
            gap = x[:, j, None, :] - self.words[j]
            here = (gap * x[:, j, None, :]).sum(axis=2)
            loss = (gap**2).sum(axis=2) + self.extra * (rest[:, None] + here) ** 2
            code[:, j] = loss.argmin(axis=1)
            along[:, j] = np.take_along_axis(here, code[:, j, None].astype(np.int64), 1)[:, 0]
            total = rest + along[:, j]
        return code

    def _fit(self, x: np.ndarray, code: np.ndarray) -> None:
        along = self._along(x, code)
        total = along.sum(axis=1)
        for j in range(x.shape[1]):
            part, c = x[:, j], code[:, j]
            want = total - along[:, j] + (part * part).sum(axis=1)
            count = np.bincount(c, minlength=WORDS)
            a = np.zeros((WORDS, 2, 2))
            b = np.zeros((WORDS, 2))
            for p in range(2):
                b[:, p] = np.bincount(c, part[:, p] * (1 + self.extra * want), WORDS)
                for q in range(2):
                    a[:, p, q] = self.extra * np.bincount(c, part[:, p] * part[:, q], WORDS)
            a[:, 0, 0] += count + 1e-9
            a[:, 1, 1] += count + 1e-9
            used = count > 0
            self.words[j][used] = np.linalg.solve(a[used], b[used][:, :, None])[:, :, 0]
            along[:, j] = ((part - self.words[j][c]) * part).sum(axis=1)
            total = want - (part * part).sum(axis=1) + along[:, j]

    def encode(self, x: np.ndarray) -> np.ndarray:
        """A byte for every four dimensions: two four-bit codes."""
        parts = self._parts(x)
        code = self._nearest(parts)
        for _ in range(2):
            code = self._improve(parts, code)
        return np.ascontiguousarray((code[:, ::2] | code[:, 1::2] << 4).T)

    def tables(self, query: np.ndarray) -> np.ndarray:
        """(bytes, 256) of a query: sums of two entries of its eight-bit tables."""
        raw = (self.words * self._parts(query[None])[0][:, None, :]).sum(axis=2)
        low = raw.min(axis=1, keepdims=True)
        small = np.rint((raw - low) * (255 / max(1e-12, float((raw - low).max())))).astype(np.uint16)
        return (small[1::2][:, :, None] + small[::2][:, None, :]).reshape(len(small) // 2, 256)


def searcher(codes: Codes, k: int):
    """The cell function for vectors.search."""

    def cell(ids: np.ndarray, vec: np.ndarray):
        vec = scaled(vec)
        norms = np.sqrt((vec * vec).sum(axis=1))
        bytes_ = codes.encode(vec[:, : codes.width] / norms[:, None])
        keep = min(len(ids), max(RERANK, 4 * k) + 1)

        def ask(q_ids: np.ndarray, q_vec: np.ndarray):
            at, cand, score = [], [], []
            for i, q in enumerate(scaled(q_vec)):
                length = np.sqrt((q * q).sum())
                tables = codes.tables(q[: codes.width] / length)
                sums = np.zeros(len(ids), np.uint32)
                for t, b in zip(tables, bytes_, strict=True):
                    sums += t[b]
                # all near the last one's sum are ranked exactly too: copies and near copies have like codes
                last = np.partition(sums, len(ids) - keep)[len(ids) - keep]
                best = np.flatnonzero(sums + SLACK >= last)
                exact = (vec[best] * q).sum(axis=1) / (norms[best] * length)
                top = best[np.lexsort((best, -exact))[: k + 1]]
                at.append(np.full(len(top), i))
                cand.append(ids[top])
                score.append((vec[top] * q).sum(axis=1) / (norms[top] * length))
            return np.concatenate(at), np.concatenate(cand), np.concatenate(score)

        return ask

    return cell


def nearest(df: DataFrame, k: int = 5, query_every: int = 50, sample: int = SAMPLE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found by cosine."""
    vectors = V.usable(df, id_col, vec_col, nonzero=True)
    _, x = V.sampled(vectors, sample)
    codes = Codes(_unit(x) if len(x) else x)
    parts = min(V.PARTS, max(1, -(-vectors.count() // V.CELL_ROWS)))
    return V.search(vectors, query_every, k, Probes(x, parts, k), searcher(codes, k), "double")
