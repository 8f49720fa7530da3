"""Exact top-k inner products by best-first search of M-trees.

Components become integers floor(scale * x). A vector v gets one more coordinate, sqrt(C - |v|^2), C being the
largest |v|^2 of its cell, and a query a 0: then the squared distance is |q|^2 + C - 2 q.v and the largest
products are the nearest points of a metric space. Each cell of candidates holds one M-tree: nodes are
pages of entries; an entry keeps its distance to the routing object of its page, and a routing
entry also the covering radius of its subtree. The search takes the page with the least possible
distance first and skips, by the triangle inequality over the stored distances, what can't beat the k best
found so far, mostly without computing its distance. Products are exact integers; bounds have a margin
for rounding, so results are exact.

Whole parts are pruned before anything is sent: a part keeps the covering radius r of its centre c and its largest norm n, a query q
the k-th best product t among a bounded sample, and only parts with min(q.c + |q| r, |q| n) >= t can hold an answer.

Defined results: vectors that are null or hold null or non-finite components take no part; zero vectors do;
vectors of different lengths are compared as if the shorter ended in zeros; ties go to the smaller id;
repeated vectors are separate candidates, but rows alike in id and vector are one; where products may exceed 2^53 they are
counted in whole numbers of any size, and scores beyond 64 bits become the nearest 64-bit number; fewer candidates than k give them all; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame

from gristmill.llm import vectors as V

SCALE = 64
#: Entries of a page.
PAGE = 256
MARGIN = 1e-6


class Node:
    __slots__ = ("rows", "points", "to_parent", "radius", "children")

    def __init__(self, rows, points, to_parent, radius=None, children=None):
        self.rows = rows  # the entries' rows in the tree's table
        self.points = points  # and their vectors, together
        self.to_parent = to_parent  # their distances to the routing object of this page
        self.radius = radius  # covering radii of their subtrees; none in a leaf
        self.children = children


class MTree:
    def __init__(self, points: np.ndarray, seed: int = 3):
        """points: integer-valued doubles."""
        norms = (points * points).sum(axis=1)
        self.top = float(norms.max(initial=0.0))
        self.lifted = np.hstack([points, np.sqrt(self.top - norms)[:, None]])
        # single precision holds every partial sum of a product exactly up to 2^24
        self.points = points.astype(np.float32) if self.top < 1 << 22 else points
        self.rng = np.random.default_rng(seed)
        rows = np.arange(len(points))
        self.root = self._build(rows, np.zeros(len(rows)))

    def _distances(self, rows: np.ndarray, to: int) -> np.ndarray:
        gap = self.lifted[rows] - self.lifted[to]
        return np.sqrt((gap * gap).sum(axis=1))

    def _build(self, rows: np.ndarray, to_parent: np.ndarray) -> Node:
        if len(rows) <= PAGE:
            return Node(rows, self.points[rows], to_parent)
        fan = int(min(PAGE, max(2, -(-len(rows) // (PAGE * 3 // 4)))))
        routes = [int(rows[self.rng.integers(len(rows))])]
        near = self._distances(rows, routes[0])
        owner = np.zeros(len(rows), np.int64)
        while len(routes) < fan and near.max() > 0:  # the furthest from those chosen
            routes.append(int(rows[int(near.argmax())]))
            d = self._distances(rows, routes[-1])
            closer = d < near
            owner[closer] = len(routes) - 1
            near = np.where(closer, d, near)
        if len(routes) == 1:  # copies of one point: any split does
            share = max(PAGE, -(-len(rows) // PAGE))
            owner = np.arange(len(rows)) // share
            routes = [int(rows[i]) for i in range(0, len(rows), share)]
        children, radius, kept, where = [], [], [], {int(r): i for i, r in enumerate(rows)}
        for j, r in enumerate(routes):
            mine = np.flatnonzero(owner == j)
            if not len(mine):
                continue
            kept.append(r)
            radius.append(float(near[mine].max()))
            children.append(self._build(rows[mine], near[mine]))
        kept = np.array(kept)
        return Node(kept, self.points[kept], to_parent[[where[int(r)] for r in kept]], np.array(radius), children)

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, products) of the k largest products; of equal ones the smaller rows."""
        norm = float(q @ q)
        length = norm + self.top
        q = q.astype(np.float32) if self.points.dtype == np.float32 and norm < 1 << 22 else q
        best_rows, best = np.zeros(0, np.int64), np.zeros(0)
        bound, least_product = np.inf, -np.inf
        queue: list = [(0.0, 0, None, self.root)]
        pushed = 0
        while queue:
            least, _, parent, node = heapq.heappop(queue)
            if least > bound:
                break
            points, rows, radius, pick = node.points, node.rows, node.radius, None
            if parent is not None and bound < np.inf:  # |d(q, parent) - d(entry, parent)| bounds d(q, entry)
                floor = np.abs(parent - node.to_parent)
                may = (floor if radius is None else floor - radius) <= bound
                found = int(np.count_nonzero(may))
                if not found:
                    continue
                if 2 * found < len(rows):  # for more, the whole page at once costs less than picking them
                    pick = np.flatnonzero(may)
                    points, rows, radius = points[pick], rows[pick], radius if radius is None else radius[pick]
            product = points @ q
            if radius is None:
                good = np.flatnonzero(product >= least_product)
                if not len(good):
                    continue
                best_rows, best = np.append(best_rows, rows[good]), np.append(best, product[good])
                if len(best) >= k:
                    order = np.lexsort((best_rows, -best))[:k]
                    best_rows, best = best_rows[order], best[order]
                    least_product = best[-1]
                    bound = float(np.sqrt(max(length - 2 * least_product, 0))) + MARGIN
            else:
                reach = np.sqrt(np.maximum(length - 2 * product.astype(np.float64), 0))
                lower = reach - radius - MARGIN
                for j in np.flatnonzero(lower <= bound).tolist():
                    pushed += 1
                    heapq.heappush(queue, (max(0.0, float(lower[j])), pushed, float(reach[j]), node.children[j if pick is None else int(pick[j])]))
        return best_rows, best


class Bounded(V.Parts):
    """Parts of integer vectors; a query needs those whose bounds reach its threshold."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, parts: int, k: int, scale: int):
        self.k, self.scale, self.ids = k, scale, ids
        self.sample = self.place(sample)
        super().__init__(V.centres(self.sample, parts) if len(ids) else np.zeros((1, 1)))

    def place(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip(np.floor(self.scale * x), -1e100, 1e100)  # beyond that bounds are infinite and prune nothing

    def measure(self, x: np.ndarray, part: np.ndarray) -> np.ndarray:
        z = self.place(x)
        gap = z - V.pad(self.centre, z.shape[1])[part][:, : z.shape[1]]
        return np.sqrt(np.stack([(gap * gap).sum(axis=1), (z * z).sum(axis=1)], axis=1))

    def route(self, ids, x, stats):
        if len(stats) == 1:
            return np.arange(len(ids)), np.zeros(len(ids), np.int64)
        z = self.place(x)
        width = max(z.shape[1], self.sample.shape[1])
        z, c, sample = V.pad(z, width), V.pad(self.centre, width), V.pad(self.sample, width)
        length = np.sqrt((z * z).sum(axis=1))
        least = np.full(len(z), -np.inf)
        for lo in range(0, len(z), 256):
            product = np.where(ids[lo : lo + 256, None] == self.ids[None], -np.inf, z[lo : lo + 256] @ sample.T)
            if product.shape[1] > self.k:
                least[lo : lo + 256] = np.partition(product, product.shape[1] - self.k, axis=1)[:, product.shape[1] - self.k]
        most = np.minimum(z @ c.T + length[:, None] * stats[None, :, 0], length[:, None] * stats[None, :, 1])
        slack = 1e-9 * (np.abs(least)[:, None] + length[:, None] * np.maximum(stats[None, :, 1], 0)) + 1e-6
        return np.nonzero((stats[None, :, 1] >= 0) & ~(most + slack < least[:, None]))


def _whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python integers."""
    return np.array([math.floor(Fraction(v) * scale) for v in x.ravel().tolist()], object).reshape(x.shape)


def _any_size(ids: np.ndarray, vec: np.ndarray, q_vec: np.ndarray, k: int, scale: int):
    """The k + 1 best by whole numbers of any size, for cells that doubles can't hold."""
    z, low, high = _whole(vec, scale), -(1 << 63), (1 << 63) - 1
    at, cand, score = [], [], []
    for i, q in enumerate(_whole(q_vec, scale)):
        product = [min(high, max(low, sum(a * b for a, b in zip(row, q, strict=True)))) for row in z]
        best = sorted(range(len(ids)), key=lambda r: (-product[r], ids[r]))[: k + 1]
        at.append(np.full(len(best), i))
        cand.append(ids[best])
        score.append(np.array([product[r] for r in best], np.int64))
    return np.concatenate(at), np.concatenate(cand), np.concatenate(score)


def searcher(k: int, scale: int):
    def cell(ids: np.ndarray, vec: np.ndarray):
        with np.errstate(over="ignore"):
            large = float(np.abs(np.floor(scale * vec)).max(initial=0.0))
        fits = large**2 * vec.shape[1] < 1 << 53 if large < 1e100 else False
        tree = MTree(np.floor(scale * vec)) if fits else None

        def ask(q_ids: np.ndarray, q_vec: np.ndarray):
            with np.errstate(over="ignore"):
                top = float(np.abs(np.floor(scale * q_vec)).max(initial=0.0))
            if not fits or top > 1e100 or max(top, large) ** 2 * vec.shape[1] >= 1 << 53:
                return _any_size(ids, vec, q_vec, k, scale)
            at, cand, score = [], [], []
            for i, q in enumerate(np.floor(scale * q_vec)):
                rows, product = tree.search(q, k + 1)  # one more: the query itself may be among them
                at.append(np.full(len(rows), i))
                cand.append(ids[rows])
                score.append(product.astype(np.int64))
            return np.concatenate(at), np.concatenate(cand), np.concatenate(score)

        return ask

    return cell


def top_products(df: DataFrame, k: int = 20, query_every: int = 20, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer products, exactly."""
    vectors = V.usable(df, id_col, vec_col)
    parts = min(V.PARTS, max(1, -(-vectors.count() // V.CELL_ROWS)))
    ids, x = V.sampled(vectors)
    return V.search(vectors, query_every, k, Bounded(ids, x, parts, k, scale), searcher(k, scale), "long")
