"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded (gristmill.llm.passages) and
embedded; gated attention, softmax over w . (tanh(V h) * sigmoid(U h)), weighs the passages;
the weighted mean is classified. Only the document's label is known, so the weights
learn which passages decide. Everything is numpy; training runs on the driver over a
bounded sample of labelled rows (`sample` documents), scoring in Arrow batches without a shuffle.

Defined results: null and empty texts are bags of one zero passage and are scored; long texts are
scored whole; repeated rows score alike; without labels every score is 0.5; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import passages
from gristmill.llm.common import chunks_by_bytes, free_name, held_out

#: Labelled documents that training reads at most.
SAMPLE = 6000
HIDDEN, ATTENTION = 32, 16
KEEP_AT = 0.3


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class GatedAttention:
    """Weights of the bag classifier; plain arrays, so that it travels to executors as it is."""

    mean: np.ndarray
    scale: np.ndarray
    params: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, x: np.ndarray, rng: np.random.Generator) -> GatedAttention:
        d = x.shape[1]
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        params = {"W": draw(d, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION), "a": draw(ATTENTION), "c": draw(HIDDEN), "k": np.zeros(1)}
        return cls(x.mean(axis=0), x.std(axis=0) + 1e-3, params)

    def forward(self, x: np.ndarray, begin: np.ndarray) -> tuple:
        p = self.params
        sizes = np.diff(np.append(begin, len(x)))
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, begin), sizes))
        weight = e / np.repeat(np.add.reduceat(e, begin), sizes)
        pooled = np.add.reduceat(h * weight[:, None], begin, axis=0)
        return z, h, t, g, weight, pooled, sizes, pooled @ p["c"] + p["k"]

    def predict(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return _sigmoid(self.forward(x, begin)[-1])

    def gradient(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray, cost: np.ndarray) -> dict[str, np.ndarray]:
        p = self.params
        z, h, t, g, weight, pooled, sizes, logit = self.forward(x, begin)
        d = (_sigmoid(logit) - y) * cost / cost.sum()
        spread = np.repeat(d, sizes)[:, None] * p["c"]
        dw = (spread * h).sum(axis=1)
        de = weight * (dw - np.repeat(np.add.reduceat(weight * dw, begin), sizes))
        dt, dg = de[:, None] * p["a"] * g * (1 - t**2), de[:, None] * p["a"] * t * g * (1 - g)
        dh = (spread * weight[:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
        return {"W": z.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ de, "c": pooled.T @ d, "k": np.array([d.sum()])}


def train(x: np.ndarray, bag: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> GatedAttention:
    """x: passages sorted by bag; bag: 0 .. len(y) - 1, all present. Adam on the logistic loss."""
    rng = np.random.default_rng(seed)
    model = GatedAttention.fresh(x, rng)
    begin = np.flatnonzero(np.diff(bag, prepend=-1))
    ends = np.append(begin[1:], len(x))
    cost = np.ones(len(y))
    m = {k: np.zeros_like(v) for k, v in model.params.items()}
    v = {k: np.zeros_like(w) for k, w in model.params.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            rows = np.concatenate([np.arange(begin[i], ends[i]) for i in some])
            sizes = ends[some] - begin[some]
            grads = model.gradient(x[rows], np.cumsum(sizes) - sizes, y[some], cost[some])
            step += 1
            lr = rate * (1 - epoch / epochs)
            for k, gr in grads.items():
                gr = gr + decay * model.params[k]
                m[k] = 0.9 * m[k] + 0.1 * gr
                v[k] = 0.999 * v[k] + 0.001 * gr**2
                model.params[k] = model.params[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def labelled_ids(labels: DataFrame, label: str, sample: int) -> DataFrame:
    """(doc_id, y): at most `sample` rows outside the held-out fold, picked by a hash of the id."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> GatedAttention | None:
    """Learns from a bounded sample; None if it holds no documents."""

    def run(batches):
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            ids, y = b.column(0).to_pylist(), b.column(2).to_pylist()
            for lo, hi in chunks_by_bytes(texts):
                x, bag = passages.encode(texts[lo:hi])
                begin = np.flatnonzero(np.diff(bag, prepend=-1))
                ends = np.append(begin[1:], len(x))
                blobs = [x[i:j].astype("<f4").tobytes() for i, j in zip(begin, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi], pa.int64()), pa.array(y[lo:hi], pa.float64()), pa.array(blobs, pa.binary())], names=["doc_id", "y", "x"])

    picked = F.broadcast(labelled_ids(labels, label, sample))  # `sample` rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(picked, "doc_id").mapInArrow(run, "doc_id long, y double, x binary").toArrow()
    if not rows.num_rows:
        return None
    rows = rows.sort_by([("doc_id", "ascending")])
    blobs = [np.frombuffer(v, "<f4").reshape(-1, passages.FEATURES) for v in rows.column("x").to_pylist()]
    bag = np.repeat(np.arange(len(blobs)), [len(v) for v in blobs])
    return train(np.concatenate(blobs).astype(np.float64), bag, rows.column("y").to_numpy())


def score(docs: DataFrame, model: GatedAttention | None) -> DataFrame:
    """All columns of docs with `score` (0 to 1, higher: better); whole texts, no shuffle. Underscores are added to a name that docs has."""
    schema = docs.schema
    names = docs.columns
    name = free_name("score", names)
    at = names.index("text")

    def run(batches):
        for b in batches:
            texts = [t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()]
            values = np.full(len(texts), 0.5)
            for lo, hi in chunks_by_bytes(texts) if model else ():
                x, bag = passages.encode(texts[lo:hi])
                values[lo:hi] = model.predict(x.astype(np.float64), np.flatnonzero(np.diff(bag, prepend=-1)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values)], names=[*names, name])

    return docs.mapInArrow(run, type(schema)([*schema.fields]).add(name, "double"))


def digest(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels)).drop("text")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= keep_at).cast("int").alias("predicted"))
