"""Passage encodings: surface statistics of consecutive runs of words over whole texts."""

from __future__ import annotations

import numpy as np

#: Words of a passage.
PASSAGE_WORDS = 64
CLASSES = 12
_CLASS = np.full(256, 9, np.uint8)  # other printable marks
_CLASS[ord("A") : ord("Z") + 1] = 0
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[ord(c) for c in ".,"]] = 3
_CLASS[[ord(c) for c in "!?"]] = 4
_CLASS[[ord(c) for c in "|<>{}[]=_/\\~^`"]] = 5
_CLASS[[ord(c) for c in "#$%&*@+"]] = 6
_CLASS[[ord(c) for c in "-'\";:()"]] = 7
_CLASS[128:] = 8
_CLASS[:32] = 10
_CLASS[32] = 11
FEATURES = CLASSES + 9


def encode(texts: list[bytes], words_per_passage: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(features, bag): a row for every passage and the index of its text; a text without words has one zero row."""
    words = [t.split() or [b""] for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for ws in words for w in ws]
    raw = np.frombuffer(b" ".join(flat) + b" ", np.uint8)
    lengths = np.fromiter(map(len, flat), np.int64, len(flat))
    first = np.cumsum(counts) - counts
    per_bag = -(-counts // words_per_passage)
    rank = np.arange(len(flat)) - np.repeat(first, counts)
    passage = np.repeat(np.cumsum(per_bag) - per_bag, counts) + rank // words_per_passage
    n = int(per_bag.sum())
    bag = np.repeat(np.arange(len(words)), per_bag)
    w = np.bincount(passage, minlength=n).astype(np.float64)
    size = np.bincount(passage, lengths + 1, n)
    begin = np.cumsum(w).astype(np.int64) - w.astype(np.int64)
    ends = np.cumsum(lengths + 1)
    byte_begin = (ends - lengths - 1)[begin]
    kinds = _CLASS[raw]
    mark = np.zeros(len(raw), np.int32)
    mark[byte_begin[1:]] = 1
    of = np.cumsum(mark, dtype=np.int32)
    tally = np.bincount(of.astype(np.int64) * CLASSES + kinds, minlength=n * CLASSES).reshape(n, CLASSES)
    out = np.empty((n, FEATURES), np.float32)
    out[:, :CLASSES] = tally / size[:, None]
    codes = np.fromiter(map(hash, flat), np.int64, len(flat)).view(np.uint64)
    same = np.zeros(len(flat), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (passage[1:] == passage[:-1])
    keys = np.sort((passage.astype(np.uint64) << np.uint64(40)) | (codes >> np.uint64(24)))
    fresh = np.append(True, keys[1:] != keys[:-1])
    distinct = np.bincount((keys[fresh] >> np.uint64(40)).astype(np.int64), minlength=n)
    squares = np.bincount(passage, lengths.astype(np.float64) ** 2, n)
    mean = size / w - 1
    last = raw[ends - 2] if len(raw) > 1 else raw[:1]
    lead = raw[ends - lengths - 1]
    out[:, CLASSES] = distinct / w
    out[:, CLASSES + 1] = np.bincount(passage, same, n) / w
    out[:, CLASSES + 2] = mean / 10
    out[:, CLASSES + 3] = np.sqrt(np.maximum(squares / w - mean**2, 0)) / 10
    out[:, CLASSES + 4] = np.bincount(passage, lengths <= 3, n) / w
    out[:, CLASSES + 5] = np.bincount(passage, lengths > 14, n) / w
    out[:, CLASSES + 6] = np.bincount(passage, (last == ord(".")) | (last == ord(",")), n) / w
    out[:, CLASSES + 7] = np.bincount(passage, (lead >= ord("A")) & (lead <= ord("Z")), n) / w
    out[:, CLASSES + 8] = np.log1p(w) / 5
    out[size <= w] = 0
    return out, bag
