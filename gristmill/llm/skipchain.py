"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. A conditional random field then labels the tokens that look like data (those
with a digit or an @): unary potentials from the token's shape and surroundings, chain potentials between
neighbours, and skip potentials between distant tokens of one normal form, repeated or, sharing all their digits
or their letters, similar. Loopy belief propagation passes messages over all of them, so a
number that is plainly a phone number in one place is one in every place. Tokens in base spans are evidence. Others that end as an entity and
lie in no base span are added; base spans stay.

All potentials are fitted together by pseudo-likelihood, Adam on the conditional likelihood of each token's label given
those of its neighbours and of its like tokens, over a bounded sample of documents. Labels are the base spans; a token
outside them that is like one inside has no label, since whether such tokens belong together is what the field is to
decide. A number of card length that fails the check digit is told apart from one that passes.

Groups of like tokens share their potentials through a hub, so a token that stands a thousand times costs a
thousand messages, not a million.

Defined results: null and empty texts have no spans; texts are read whole; repeated rows have equal spans; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Documents that the field is fitted on at most, and tokens of each, evenly spaced over the whole text.
SAMPLE, SAMPLE_TOKENS = 3000, 1000
ROUNDS = 8

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
#: A word with a digit or an @; read once from its start, whatever its length.
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_EDGE = ".,;:!?()[]{}<>\"'|*#$%&"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """As the pattern would, from the left; each @ is looked at once, so no text is slow."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            out.append((begin, found.end()))
        done = found.end() if found else at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, leftmost and not overlapping; candidates that fail a test are dropped, without a retry."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if not _DIGITS.search(text):
        return out
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(int(p) <= 255 for p in m.group().split(".") if len(p.lstrip("0")) <= 3) and all(len(p.lstrip("0")) <= 3 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() and c.isascii() for c in m.group()) <= 15]
    return out


def tokens(text: str) -> list[tuple[int, int]]:
    """Words with a digit or an @, without punctuation at their edges."""
    out = []
    for m in _TOKEN.finditer(text):
        word = m.group()
        left = word.lstrip(_EDGE)
        core = left.rstrip(_EDGE)
        if core:
            begin = m.start() + len(word) - len(left)
            out.append((begin, begin + len(core)))
    return out


SHAPES = 20
LABELS = len(KINDS) + 1


def shape(text: str, begin: int, end: int) -> list[float]:
    """What a token looks like and what stands around it."""
    word = text[begin:end]
    digits = sum(c.isdigit() for c in word)
    letters = sum(c.isalpha() for c in word)
    before, after = text[max(0, begin - 2) : begin], text[end : end + 2]
    n = len(word)
    of_card = digits in range(13, 20)
    checked = of_card and luhn("".join(c for c in word if c in "0123456789"))
    return [
        1.0, "@" in word, word.count("@") == 1 and "." in word[word.find("@") :], word[0] == "+" or before.endswith("+"), digits / n, letters / n, min(digits, 20) / 20,
        digits in range(9, 16), of_card, checked, of_card and not checked, word.count(".") == 3 and digits + 3 == n, "-" in word, "(" in before or ")" in after, digits <= 4 and digits == n, "." in word,
        any(c.isdigit() for c in before), any(c.isdigit() for c in after), n > 24, letters > 0 and digits > 0,
    ]


def normal_forms(word: str) -> list[str]:
    """Tokens that share a form are linked: the word itself, its digits, its letters with an @."""
    forms = ["w:" + word.lower()]
    digits = "".join(c for c in word if c.isdigit())
    if len(digits) >= 5:
        forms.append("d:" + digits)
    if "@" in word and len(word) > 5:
        forms.append("l:" + "".join(c for c in word.lower() if c.isalnum()))
    return forms


@dataclass
class Field:
    unary: np.ndarray  # (SHAPES, labels), label 0 is none
    chain: np.ndarray  # (labels, labels) log potentials
    skip: np.ndarray

    def marginals(self, text: str, spots: list[tuple[int, int]], known: np.ndarray | None = None) -> np.ndarray:
        """(tokens, labels) by loopy belief propagation. known: labels of tokens in base spans, which stay; 0 elsewhere."""
        x = np.array([shape(text, b, e) for b, e in spots], float)
        node = x @ self.unary
        node -= node.max(axis=1, keepdims=True)
        node = np.exp(node)
        node /= node.sum(axis=1, keepdims=True)
        if known is not None:
            node[known > 0] = np.eye(LABELS)[known[known > 0]]
        n, labels = node.shape
        left, right = [], []
        for i in range(n - 1):
            if spots[i + 1][0] - spots[i][1] <= 3:
                left.append(i)
                right.append(i + 1)
        left, right = np.array(left, np.int64), np.array(right, np.int64)
        groups = groups_of(text, spots)
        if not groups and not len(left):
            return node
        member = np.array([i for g in groups for i in g], np.int64)
        hub = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        chain, skip = np.exp(self.chain), np.exp(self.skip)
        to_right, to_left = np.ones((len(left), labels)), np.ones((len(left), labels))
        to_hub, to_token = np.ones((len(member), labels)), np.ones((len(member), labels))

        def product(rows, index, size):
            out = np.zeros((size, labels))
            np.add.at(out, index, np.log(np.maximum(rows, 1e-30)))
            return out

        def unit(m):
            m = np.exp(m - m.max(axis=1, keepdims=True)) if len(m) else m
            return m / m.sum(axis=1, keepdims=True) if len(m) else m

        log_node = np.log(np.maximum(node, 1e-30))
        for _ in range(ROUNDS):
            belief = log_node + product(to_right, right, n) + product(to_left, left, n) + product(to_token, member, n)
            hubs = product(to_hub, hub, len(groups))
            to_right_new = unit(belief[left] - np.log(np.maximum(to_left, 1e-30))) @ chain
            to_left_new = unit(belief[right] - np.log(np.maximum(to_right, 1e-30))) @ chain.T
            to_hub_new = unit(belief[member] - np.log(np.maximum(to_token, 1e-30))) @ skip
            to_token_new = unit(hubs[hub] - np.log(np.maximum(to_hub, 1e-30))) @ skip.T
            # damped, so that loops settle
            mix = lambda a, b: 0.5 * a + 0.5 * b / np.maximum(b.sum(axis=1, keepdims=True), 1e-30)
            to_right, to_left, to_hub, to_token = mix(to_right, to_right_new), mix(to_left, to_left_new), mix(to_hub, to_hub_new), mix(to_token, to_token_new)
        return unit(log_node + product(to_right, right, n) + product(to_left, left, n) + product(to_token, member, n))


def label_tokens(spots: list[tuple[int, int]], spans: dict[str, list[tuple[int, int]]]) -> np.ndarray:
    """The kind of the base span that covers a token's middle; 0 for none."""
    out = np.zeros(len(spots), np.int64)
    for k, kind in enumerate(KINDS, 1):
        if spans[kind]:
            begin = np.array([s for s, _ in spans[kind]])
            end = np.array([e for _, e in spans[kind]])
            middle = np.array([(b + e) // 2 for b, e in spots])
            at = np.searchsorted(begin, middle, "right") - 1
            inside = (at >= 0) & (middle < end[np.maximum(at, 0)])
            out[inside] = k
    return out


def groups_of(text: str, spots: list[tuple[int, int]]) -> list[list[int]]:
    """Tokens that share a normal form, two or more."""
    forms: dict[str, list[int]] = {}
    for i, (b, e) in enumerate(spots):
        for f in normal_forms(text[b:e]):
            forms.setdefault(f, []).append(i)
    return [g for g in forms.values() if len(g) > 1]


def examples(text: str) -> np.ndarray:
    """(tokens, SHAPES + 3 LABELS + 1): shape, label of the left and of the right neighbour, mean label of like tokens, own label.

    Tokens without a label are left out, and are no neighbours.
    """
    spots = tokens(text)
    y = label_tokens(spots, base_spans(text))
    hot = np.eye(LABELS)[y]
    like, many, beside = np.zeros((len(spots), LABELS)), np.zeros(len(spots)), np.zeros(len(spots), bool)
    groups = groups_of(text, spots)
    for g in groups:
        beside[g] |= (y[g] == 0) & (y[g] > 0).any()
    hot[beside] = 0
    for g in groups:
        total = hot[g].sum(axis=0)
        like[g] += total - hot[g]
        many[g] += (~beside[g]).sum() - (~beside[g])
    like /= np.maximum(many, 1)[:, None]
    near = np.array([spots[i + 1][0] - spots[i][1] <= 3 for i in range(len(spots) - 1)], bool)
    left, right = np.zeros_like(hot), np.zeros_like(hot)
    left[1:][near], right[:-1][near] = hot[:-1][near], hot[1:][near]
    x = np.array([shape(text, s, e) for s, e in spots], float).reshape(len(spots), SHAPES)
    return np.hstack([x, left, right, like, y[:, None]])[~beside]


def train(rows: np.ndarray, rounds: int = 600, rate: float = 0.1, decay: float = 1e-5) -> Field:
    """All potentials together, by pseudo-likelihood."""
    x, rest, y = rows[:, :SHAPES], rows[:, SHAPES:-1], np.eye(LABELS)[rows[:, -1].astype(np.int64)]
    left, right, like = (rest[:, k * LABELS : (k + 1) * LABELS] for k in range(3))
    w = {"unary": np.zeros((SHAPES, LABELS)), "chain": np.zeros((LABELS, LABELS)), "skip": np.zeros((LABELS, LABELS))}
    m, v = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}
    for step in range(1, rounds + 1):
        z = x @ w["unary"] + left @ w["chain"] + right @ w["chain"].T + like @ w["skip"]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - y) / len(x)
        skip = like.T @ d
        grads = {"unary": x.T @ d, "chain": left.T @ d + d.T @ right, "skip": (skip + skip.T) / 2}
        for k, g in grads.items():
            g = g + decay * w[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Field(w["unary"], np.clip(w["chain"], -4, 4), np.clip(w["skip"], -4, 4))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field | None:
    """Fits the field on at most `sample` documents that hold a digit or an @; None without any."""

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                found = examples(text or "")
                if len(found) > SAMPLE_TOKENS:
                    found = found[np.linspace(0, len(found) - 1, SAMPLE_TOKENS).astype(np.int64)]
                rows.append(found.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["x"])

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = some.where(F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = some.join(F.broadcast(ids.distinct()), "doc_id").mapInArrow(run, "x binary").toArrow().column("x").to_pylist()  # `sample` ids at most
    found = np.frombuffer(b"".join(sorted(rows)), "<f4").reshape(-1, SHAPES + 3 * LABELS + 1).astype(float)
    return train(found) if len(found) else None


def added_spans(text: str, spans: dict[str, list[tuple[int, int]]], field: Field | None) -> list[tuple[str, int, int]]:
    """Entities that the field finds beyond the base spans: tokens over half likely and outside every base span.

    Neighbouring tokens of a phone number are one entity.
    """
    spots = tokens(text) if field else []
    if not spots:
        return []
    known = label_tokens(spots, spans)
    free = known == 0
    p = field.marginals(text, spots, known)
    best = p[:, 1:].argmax(axis=1)
    out: list[tuple[str, int, int]] = []
    for i in np.flatnonzero(free & (p[:, 1:].max(axis=1) > 0.5)):
        kind, (begin, end) = KINDS[best[i]], spots[i]
        if kind == "phone" and out and out[-1][0] == kind and begin - out[-1][2] <= 3 and free[i - 1]:
            out[-1] = (kind, out[-1][1], end)
        else:
            out.append((kind, begin, end))
    return out


def find(docs: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans): counts of base spans, and both lists as kind:start:end."""

    def run(batches):
        for b in batches:
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = text or ""
                if not ("@" in text or _DIGITS.search(text)):
                    out.append((i, 0, 0, 0, 0, "", ""))
                    continue
                spans = base_spans(text)
                base = [(k, s, e) for k in KINDS for s, e in spans[k]]
                more = sorted(base + added_spans(text, spans, field), key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
                form = lambda xs: ",".join(f"{k}:{s}:{e}" for k, s, e in xs)
                out.append((i, *(len(spans[k]) for k in KINDS), form(base), form(more)))
            if out:
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in c[:5]), pa.array(c[5], pa.string()), pa.array(c[6], pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def digest(docs: DataFrame) -> DataFrame:
    found = find(docs, fit(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def brute_base(text: str) -> str:
    """Base spans by the plain patterns; for tests."""
    email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    card = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and luhn(d)]
    phone = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    found = ",".join(f"{k}:{s}:{e}" for k, v in zip(KINDS, (email, ip, card, phone), strict=True) for s, e in v)
    return hashlib.sha256(found.encode()).hexdigest()
