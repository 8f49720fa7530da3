"""Packing documents into training windows with BM25 retrieval.

Documents are tokenised once and ordered by a min-hash of their token trigrams, so that like documents
are neighbours; ties go by id, so a large group of copies spreads over as many shards as it needs. Every
million tokens in this order are a shard (a longer document is one of its own). In each shard a BM25 inverted index over token
ids serves one query a window: the seed is the document at hand (or the rest of one that was
cut), unused documents follow in falling score until the window is full, and the last one is
cut where the window ends. What remains at the end of a shard is laid out in windows whose
lengths are powers of two, so there is no padding.

All terms of the seed are queried. Terms in more than an eighth of a shard's documents have rows of weights
instead of postings, which costs less; documents without a scored neighbour follow in the shard's order. No document is left out.

Defined results: null and empty texts are the end token alone; a text longer than a window fills
several; repeated rows are packed as often as they come; an empty table gives an empty result;
other columns are ignored; the order column, where one is named, has no nulls.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import cut, shuffle_partitions

WINDOW = 4096
END = 2
K1, B = 1.2, 0.75
#: Tokens of a shard: 256 windows, so the cost of a query and the memory of an index don't grow with the data.
SHARD_TOKENS = 1 << 20
#: Tokens of a task at most, on the mean; it lays out one shard after the other.
TASK_TOKENS = 1 << 26
#: Neighbours that are sorted first; all, if these do not fill the window.
LOOK = 64
#: Terms in more than 1 / DENSE of a shard's documents have a row of weights each, at most DENSE numbers for a posting.
DENSE = 8
#: Words whose ids a task remembers; then it forgets all.
CACHE_WORDS = 250_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Index(dict):
    """Numbers words as they come and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


#: Characters whose lower case and NFC form are one character each, so that lower-casing first changes nothing.
_SIMPLE = re.compile("[\x00-\u012f\u0131-\u017f]*").fullmatch
#: A run of these letters is one unit of the vocabulary's pattern.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u017f]+").fullmatch
#: A lone final stop or comma after such a letter is a unit of its own. The mark comes first, so that letters are not looked at twice.
_FINAL = re.compile("[.,](?=[ \n]|\\Z)(?<=[a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u017f][.,])").sub


def _byte_letters() -> list[str]:
    """The letter by which byte-level models name each byte: printable bytes name themselves, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(i) if i in own else chr(next(rest)) for i in range(256)]


class WordEncoder:
    """Ids of whole texts by way of their words: this vocabulary drops white space and no token spans it.

    Texts of simple characters are lower-cased and their final stops set apart first, so that "The", "the" and
    "the," share a word. New plain words go straight to the tokenizer's model; all others go through the whole
    tokenizer, many at a time, a mark between them.
    """

    MARK = "\x02"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.letters = dict(enumerate(_byte_letters()))
        self._forget()

    def _forget(self) -> None:
        self.index = _Index()
        self.flat = np.zeros(0, np.uint32)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        model, letters, rest = self.tokenizer.model.tokenize, self.letters, []
        flat: list[int] = []
        size = []
        for i, w in enumerate(words):
            if w.isascii() and w.isalpha() and w.islower() or _PLAIN(w):
                before = len(flat)
                for t in model(w if w.isascii() else w.encode().decode("latin-1").translate(letters)):
                    flat.append(t.id)
                size.append(len(flat) - before)
            else:
                rest.append(i)
                size.append(0)
        new, sizes = np.array(flat, np.uint32), np.array(size, np.int64)
        begin = len(self.flat) + np.cumsum(sizes) - sizes
        others, at = [], len(self.flat) + len(new)
        for i, ids in zip(rest, self._whole([words[i] for i in rest]), strict=True):
            others.append(ids)
            begin[i], sizes[i] = at, len(ids)
            at += len(ids)
        self.flat = np.concatenate([self.flat, new, *others])
        self.begin, self.size = np.append(self.begin, begin), np.append(self.size, sizes)

    def _whole(self, words: list[str]) -> list[np.ndarray]:
        encode = lambda w: np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32)
        out: list[np.ndarray] = []
        for lo in range(0, len(words), 100):
            group = words[lo : lo + 100]
            ids = encode(f" {self.MARK} ".join(group))
            parts = np.split(ids, np.flatnonzero(ids == self.mark))
            if len(parts) != len(group):  # the mark stands in a word
                out += [encode(w) for w in group]
            else:
                out += [parts[0], *(p[1:] for p in parts[1:])]
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.index) > CACHE_WORDS:
            self._forget()
        simple = (_FINAL(r" \g<0>", t.lower()) if _SIMPLE(t) else t for t in (t or "" for t in texts))
        split = [t.replace("\n", " ").split(" ") for t in simple]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        words = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int32, int(counts.sum()))
        if self.index.fresh:
            self._learn(self.index.fresh)
            self.index.fresh.clear()
        size = self.size[words]
        stop = np.cumsum(size)
        at = np.repeat((self.begin[words] - (stop - size)).astype(np.int32), size)
        at += np.arange(len(at), dtype=np.int32)
        ids = self.flat[at]
        ends = np.append(0, stop)[np.cumsum(counts)]
        return np.split(ids, ends[:-1])


def signature(ids: np.ndarray) -> int:
    """Least hash of the token trigrams; documents without one have the greatest value."""
    if len(ids) < 3:
        return (1 << 31) - 1
    a = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = (a[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ a[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) ^ a[2:]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return int((h >> np.uint64(33)).min())


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def unpack_ids(blob: bytes) -> np.ndarray:
    """The ids of a tokenised row, 32-bit."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    return np.frombuffer(raw, "<" + raw[:2].decode(), offset=2).astype("<u4")


def tokenise(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None) -> DataFrame:
    """(doc_id, sig, n, ids): compressed little-endian ids, the end token last; 16 bits each where all fit (id_type).

    With order_col, sig is that column instead of the min-hash.
    """

    def run(batches):
        import zstandard

        encoder, squeeze = WordEncoder(path), zstandard.ZstdCompressor(level=1).compress
        kind = id_type(encoder.tokenizer.get_vocab_size())
        for b in batches:
            ids, given = b.column(0), b.column(2) if order_col else None
            for lo in range(0, b.num_rows, 256):
                rows = [np.append(x, END).astype(kind) for x in encoder.encode(b.column(1)[lo : lo + 256].to_pylist())]
                yield pa.RecordBatch.from_arrays([ids[lo : lo + len(rows)], pa.array([signature(x) for x in rows], pa.int64()) if given is None else given[lo : lo + len(rows)], pa.array([len(x) for x in rows], pa.int64()), pa.array([squeeze(kind[1:].encode() + x.tobytes()) for x in rows], pa.binary())], names=["doc_id", "sig", "n", "ids"])

    given = [F.col(order_col).cast("long").alias("sig")] if order_col else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *given).mapInArrow(run, "doc_id long, sig long, n long, ids binary")


class Shard:
    """A BM25 inverted index over the documents of one shard."""

    def __init__(self, docs: list[np.ndarray]):
        self.lengths = np.array([len(d) for d in docs])
        n = len(docs)
        owner = np.repeat(np.arange(n, dtype=np.int64), self.lengths)
        keys = np.sort((np.concatenate(docs).astype(np.int64) << 32) | owner)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        tf = np.diff(np.append(first, len(keys)))
        terms, self.posting = keys[first] >> 32, (keys[first] & 0xFFFFFFFF).astype(np.int64)
        start = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
        self.df = np.diff(np.append(start, len(terms)))
        self.start, self.terms = start, terms[start]
        idf = np.log(1 + (n - self.df + 0.5) / (self.df + 0.5))
        norm = K1 * (1 - B + B * self.lengths[self.posting] / self.lengths.mean())
        self.weight = np.repeat(idf, self.df) * tf * (K1 + 1) / (tf + norm)
        common = self.df > n // DENSE
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        self.rows = np.zeros((int(common.sum()), n))
        held = np.repeat(common, self.df)
        self.rows[np.repeat(self.row, self.df)[held], self.posting[held]] = self.weight[held]
        self.n = n

    def scores(self, doc: np.ndarray) -> np.ndarray:
        """BM25 of every document for all terms of doc."""
        at = np.searchsorted(self.terms, np.unique(doc))
        out = self.rows[self.row[at[self.row[at] >= 0]]].sum(axis=0)
        at = at[self.row[at] < 0]
        sizes = self.df[at]
        flat = np.repeat(self.start[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return out + np.bincount(self.posting[flat], self.weight[flat], self.n)


def arrange(docs: list[np.ndarray], window: int = WINDOW) -> list[int]:
    """The order in which a shard's documents follow one another."""
    shard = Shard(docs)
    unused = np.ones(len(docs), bool)
    order: list[int] = []
    filled = 0
    cursor = 0
    for _ in range(len(docs)):
        if len(order) == len(docs):
            break
        if not order or filled == 0:  # the last window ended with a document: the next in order seeds
            while not unused[cursor]:
                cursor += 1
            seed = cursor
            unused[seed] = False
            order.append(seed)
            filled = (filled + int(shard.lengths[seed])) % window
            if filled == 0:
                continue
        seed = order[-1]
        score = np.where(unused, shard.scores(docs[seed]), -1.0)
        need = window - filled
        near = np.flatnonzero(score > 0)
        if len(near) > LOOK:  # mostly a few fill the window
            best = near[np.argpartition(-score[near], LOOK)[:LOOK]]
            near = best if shard.lengths[best].sum() >= need else near
        near = near[np.lexsort((near, -score[near]))]
        total = 0
        for k in near:
            unused[k] = False
            order.append(int(k))
            total += int(shard.lengths[k])
            if total >= need:
                break
        while total < need and len(order) < len(docs):
            while not unused[cursor]:
                cursor += 1
            unused[cursor] = False
            order.append(cursor)
            total += int(shard.lengths[cursor])
        filled = (filled + total) % window
    return order


def windows(total: int, window: int = WINDOW) -> np.ndarray:
    """Lengths of the windows over a shard's tokens: full ones, then powers of two."""
    rest = total % window
    return np.array([window] * (total // window) + [1 << k for k in range(window.bit_length() - 1, -1, -1) if rest >> k & 1], np.int64)


def laid_out(ids: list, docs: list[np.ndarray], window: int) -> list[np.ndarray]:
    """The columns of a shard's pieces, doc_id first; sequences count from 0."""
    order = arrange(docs, window)
    lengths = np.array([len(docs[i]) for i in order])
    doc_end = np.cumsum(lengths)
    win_end = np.cumsum(windows(int(doc_end[-1]), window))
    ends = np.union1d(doc_end, win_end)
    begins = np.append(0, ends[:-1])
    d = np.searchsorted(doc_end, ends)
    w = np.searchsorted(win_end, ends)
    start = begins - (doc_end - lengths)[d]
    size = ends - begins
    crc = np.array([zlib.crc32(memoryview(docs[order[k]])[s : s + n]) for k, s, n in zip(d, start, size, strict=True)], np.int64)
    whose = [ids[order[k]] for k in d]
    return [whose, start, size, crc, lengths[d], w, begins - np.append(0, win_end)[w]]


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None, shard_tokens: int = SHARD_TOKENS, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    order_col: shards are consecutive ranges of this column instead of the min-hash; seeds follow it in a shard.
    """
    spark = docs.sparkSession
    path = path or tokenizer_path()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        ids: list = []
        texts: list[np.ndarray] = []
        size = before = 0

        def emit():
            nonlocal ids, texts, size, before
            whose, *cols, sequence, offset = laid_out(ids, texts, window)
            rows = [pa.array(whose, pa.int64()), *map(pa.array, cols), pa.array((part << 32) + before + sequence), pa.array(offset)]
            ids, texts, size, before = [], [], 0, before + int(sequence[-1]) + 1
            return pa.RecordBatch.from_arrays(rows, names=names)

        for b in batches:
            for i, blob, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                doc = unpack_ids(blob)
                if size and size + len(doc) > shard_tokens:
                    yield emit()
                ids.append(i)
                texts.append(doc)
                size += len(doc)
        if ids:
            yield emit()

    tokens = cut(tokenise(docs, path, id_col, text_col, order_col))
    total = tokens.agg(F.sum("n")).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-total // task_tokens))
    # whatever order the blocks come in, rows of a task are read in this one
    sorted_rows = tokens.repartitionByRange(parts, "sig", "doc_id").sortWithinPartitions("sig", "doc_id", "ids")
    return sorted_rows.select("doc_id", "ids", F.spark_partition_id().cast("long").alias("part")).mapInArrow(run, ", ".join(f"{c} long" for c in names))
