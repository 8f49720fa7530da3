"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; the unlabelled set is a sample of all documents
outside the held-out fold, whatever their labels say. With the class prior pi (share of toxic
rows among the labelled ones) the risk of a scorer g is

    pi E_P[l(g)] + max(0, E_U[l(-g)] - pi E_P[l(-g)]),

the second term being the risk on negatives, which can't be below zero; where a batch makes it
negative, the step goes up that term instead (Kiryo et al. 2017). g is linear over binary features:
the distinct starts of a document's lower-cased words. A first pass keeps the starts
that tell positives from (prior-corrected) negatives.

Defined results: null and empty texts have no features and score by the bias alone; texts are
read whole; repeated rows score alike; without positives every score is 0; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import free_name, held_out

#: Documents that training reads at most, of either kind.
POSITIVES, UNLABELLED = 5000, 12000
#: Features of the scorer at most.
FEATURES = 4096
#: Lengths of the word starts.
STARTS = (4, 5, 7)
TOXIC_AT = 0.5


def features(text: str | None) -> set[str]:
    """Distinct word starts of a whole text."""
    words = set((text or "").lower().split())
    found: set[str] = set()
    for n in STARTS:
        found |= {w[:n] for w in words if len(w) >= n}
    return found


@dataclass
class StartScorer:
    weights: dict[str, float]
    bias: float

    def logit(self, text: str | None) -> float:
        get = self.weights.get
        return self.bias + sum(map(get, self.weights.keys() & features(text)))


def train(pos: list[np.ndarray], unl: list[np.ndarray], width: int, prior: float, epochs: int = 60, batch: int = 512, rate: float = 0.05, decay: float = 1e-5, seed: int = 11) -> tuple[np.ndarray, float]:
    """Weights and bias over sparse binary rows (arrays of feature indices). Sigmoid loss, Adam."""
    rng = np.random.default_rng(seed)
    theta = np.zeros(width + 1)
    theta[-1] = -1.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def outputs(rows):
        sizes = np.array([len(r) for r in rows])
        owner = np.repeat(np.arange(len(rows)), sizes)
        flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
        return owner, flat, np.bincount(owner, theta[flat], len(rows)) + theta[-1]

    def back(owner, flat, d):
        return np.append(np.bincount(flat, d[owner], width), d.sum())

    step, share = 0, max(1, batch * len(pos) // max(1, len(unl)))
    for epoch in range(epochs):
        order = rng.permutation(len(unl))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            mine = rng.integers(0, len(pos), max(share, 64))
            po, pf, pz = outputs([pos[i] for i in mine])
            uo, uf, uz = outputs([unl[i] for i in some])
            ps, us = 1 / (1 + np.exp(np.clip(pz, -40, 40))), 1 / (1 + np.exp(-np.clip(uz, -40, 40)))
            # l(z) = sigmoid(-z): ps is the loss of positives as positives, us that of unlabelled as negatives
            as_pos = prior * back(po, pf, -ps * (1 - ps) / len(mine))
            as_neg = back(uo, uf, us * (1 - us) / len(some)) - prior * back(po, pf, ps * (1 - ps) / len(mine))
            negative_risk = us.mean() - prior * (1 - ps).mean()
            grad = as_pos + as_neg if negative_risk >= 0 else -as_neg
            grad[:-1] += decay * theta[:-1]
            step += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad**2
            theta = theta - rate * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def select_features(counts: dict[str, tuple[int, int]], n_pos: int, n_unl: int, prior: float, limit: int = FEATURES) -> list[str]:
    """Starts whose share among positives exceeds the prior-corrected share among negatives most."""
    found = []
    for f, (p, u) in counts.items():
        in_pos, in_unl = p / n_pos, u / n_unl
        in_neg = max(0.0, (in_unl - prior * in_pos) / (1 - prior))
        if in_pos > 2 * in_neg and p >= max(3, 0.001 * n_pos):
            found.append(((in_pos - in_neg) * np.log((in_pos + 1e-4) / (in_neg + 1e-4)), f))
    found.sort(key=lambda x: (-x[0], x[1]))
    return [f for _, f in found[:limit]]


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, label: str = "toxic") -> StartScorer | None:
    """Learns from bounded samples outside the held-out fold; None without positives or unlabelled rows."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    prior = known.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    if not 0 < prior < 1:
        return None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & ~held_out())
    chosen = known.where(F.col(label) == 1).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives)
    everyone = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & ~held_out()).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(unlabelled)
    roles = chosen.select("doc_id", F.lit(1).alias("p"), F.lit(0).alias("u")).unionByName(everyone.select("doc_id", F.lit(0).alias("p"), F.lit(1).alias("u")))
    sample = texts.join(F.broadcast(roles.groupBy("doc_id").agg(F.max("p").alias("p"), F.max("u").alias("u"))), "doc_id")

    def count(batches):
        # a start of at most seven letters over a bounded sample: the tally is bounded too
        tally_p, tally_u, n_p, n_u = Counter(), Counter(), 0, 0
        for b in batches:
            for t, p, u in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                found = features(t)
                n_p, n_u = n_p + p, n_u + u
                if p:
                    tally_p.update(found)
                if u:
                    tally_u.update(found)
        keys = [None, *(tally_p.keys() | tally_u.keys())]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n_p, *(tally_p[k] for k in keys[1:])], pa.int64()), pa.array([n_u, *(tally_u[k] for k in keys[1:])], pa.int64())], names=["f", "p", "u"])

    counts = sample.mapInArrow(count, "f string, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where("f is null or p >= 3").toArrow().to_pylist()
    totals = next((r for r in counts if r["f"] is None), {"p": 0, "u": 0})
    if not totals["p"] or not totals["u"]:
        return None
    names = select_features({r["f"]: (r["p"], r["u"]) for r in counts if r["f"] is not None}, totals["p"], totals["u"], prior)
    index = {f: i for i, f in enumerate(names)}

    def sparse(batches):
        for b in batches:
            rows = [np.array(sorted(index[f] for f in index.keys() & features(t)), "<i4").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(rows, pa.binary())], names=["doc_id", "p", "u", "x"])

    rows = sample.mapInArrow(sparse, "doc_id long, p int, u int, x binary").toArrow().sort_by([("doc_id", "ascending")]).to_pylist()
    decode = lambda r: np.frombuffer(r["x"], "<i4").astype(np.int64)
    weights, bias = train([decode(r) for r in rows if r["p"]], [decode(r) for r in rows if r["u"]], len(names), prior)
    return StartScorer(dict(zip(names, weights.tolist(), strict=True)), bias)


def score(docs: DataFrame, model: StartScorer | None) -> DataFrame:
    """All columns of docs with `score` (0 to 1, higher: likelier toxic); whole texts, no shuffle. Underscores are added to a name that docs has."""
    schema = docs.schema
    names = docs.columns
    name = free_name("score", names)
    at = names.index("text")

    def run(batches):
        for b in batches:
            logits = np.array([model.logit(t) for t in b.column(at).to_pylist()] if model else np.full(b.num_rows, -np.inf), float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(logits, -700, 700))) if model else np.zeros(b.num_rows))], names=[*names, name])

    return docs.mapInArrow(run, type(schema)([*schema.fields]).add(name, "double"))


def digest(docs: DataFrame, labels: DataFrame, toxic_at: float = TOXIC_AT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels)).drop("text")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= toxic_at).cast("int").alias("predicted"))
