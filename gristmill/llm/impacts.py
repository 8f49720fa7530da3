"""Ranked lexical search over impact-ordered postings, score at a time.

The queries go in blocks of a bounded number of terms. A first pass over all documents counts documents, terms and, for
the terms of a block, the documents that hold them. In the second pass a task builds one index after the other, each
over the next million postings: a posting's impact is its term's weight times a whole number of its frequency and its document's length;
a term's postings are grouped by exactly that number, greatest first. A query takes the groups of its terms
in falling impact and adds them to the documents' scores. The next impacts of its terms, added up, bound what any document can still
gain: once documents below the k-th score can't reach it any more, those that still can are completed from their own
terms, or all groups have been taken. A task carries each query's k best from index to index, so later ones stop
earlier, and hands over k rows a query; ranks come from two rounds of windows, the first over salted groups.

All arithmetic is in 64-bit whole numbers but for the logarithm in a term's weight.

Defined results: null and empty texts have no terms, aren't counted and are never found; items without terms have no rows; rows of
one item id are one item with all their terms; repeated documents each count and take a rank; a null document id ranks after
others of its score; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import chunks_by_bytes, shuffle_partitions

#: Results of an item.
K = 50
#: Pairs of item and term that a block of queries holds at most, unless one item has more.
BLOCK_TERMS = 1 << 19
#: Postings and documents of an index at most (a longer document is one of its own).
SHARD_POSTINGS, SHARD_DOCS = 1 << 20, 1 << 18
#: Bytes of a text that are split at a time.
SEGMENT = 1 << 20
#: The impacts down to this part of the greatest that is left are taken together.
STEP = 0.75
#: Bits of a key: documents of an index, and a posting's whole number.
DOC_BITS, IMPACT_BITS = 20, 20

#: ASCII letters and digits, the letters lower-cased, and all bytes of other characters belong to terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
DOCUMENTS, TOKENS = -1, -2


def terms_of(text: bytes):
    """Lists of the terms of a text in order, a segment at a time."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + SEGMENT) if len(folded) - at > SEGMENT else -1
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


class Vocabulary(dict):
    """Numbers of the terms of a block; -1 for all others."""

    def __missing__(self, term: bytes) -> int:
        return -1


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def postings(texts: list[bytes | None], numbers: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text, then document, term and frequency of each posting, by document and term)."""
    sizes = np.zeros(len(texts), np.int64)
    keys = []
    for d, text in enumerate(texts):
        for words in terms_of(text or b""):
            found = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
            sizes[d] += len(words)
            keys.append(found[found >= 0] | d << 32)
    flat = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
    return sizes, flat[first] >> 32, flat[first] & 0xFFFFFFFF, np.diff(np.append(first, len(flat)))


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - begin
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Index:
    """Postings of some documents by term and falling impact, and by document."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, norm: np.ndarray, terms: int):
        self.docs = len(norm)
        self.of_term, self.of_doc = term, np.searchsorted(doc, np.arange(self.docs + 1))
        self.part = (1_000_000_000 * tf) // (1000 * tf + 20 * norm[doc])
        low = (1 << IMPACT_BITS) - 1
        self.key = np.sort((term << DOC_BITS + IMPACT_BITS) | (low - self.part << DOC_BITS) | doc)
        self.doc = self.key & (1 << DOC_BITS) - 1
        self.impact = low - (self.key >> DOC_BITS & low)
        self.bounds = np.searchsorted(self.key, np.arange(terms + 1) << DOC_BITS + IMPACT_BITS)
        self.weights = np.zeros(terms, np.int64)
        self.score = np.zeros(self.docs, np.int64)

    def _down_to(self, term: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The end of each term's groups of at least these numbers."""
        low = (1 << IMPACT_BITS) - 1
        return np.searchsorted(self.key, (term << DOC_BITS + IMPACT_BITS) | (low - np.minimum(least, low) + 1 << DOC_BITS))

    def search(self, term: np.ndarray, weight: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): every document that can be among the k best and has a score of floor or more, above 0."""
        asked, weights = term, weight
        at, end = self.bounds[term], self.bounds[term + 1]
        live = (end > at) & (weight > 0)
        term, weight, at, end = term[live], weight[live], at[live], end[live]
        score = self.score
        score[:] = 0
        while len(term):
            ahead = weight * self.impact[at]
            bound = int(ahead.sum())
            if bound < max(int(score.max()), floor):
                kth = int(np.partition(score, -k)[-k]) if len(score) >= k else 0
                need = max(kth, floor)
                if bound < need:
                    can = np.flatnonzero(score >= need - bound)
                    if (self.of_doc[can + 1] - self.of_doc[can]).sum() <= (end - at).sum():
                        return can, self._complete(can, asked, weights)
            level = max(1, int(STEP * int(ahead.max())))
            upto = np.minimum(self._down_to(term, -(-level // weight)), end)
            flat = _ranges(at, upto)
            np.add.at(score, self.doc[flat], np.repeat(weight, upto - at) * self.impact[flat])
            left = upto < end
            term, weight, at, end = term[left], weight[left], upto[left], end[left]
        found = np.flatnonzero(score >= max(floor, 1))
        return found, score[found]

    def _complete(self, docs: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Whole scores of these documents, each of which has postings, from their own terms."""
        if not len(docs):
            return np.zeros(0, np.int64)
        self.weights[term] = weight
        begin, end = self.of_doc[docs], self.of_doc[docs + 1]
        flat = _ranges(begin, end)
        gain = self.weights[self.of_term[flat]] * self.part[flat]
        self.weights[term] = 0
        return np.add.reduceat(gain, np.cumsum(end - begin) - (end - begin))


def norms(sizes: np.ndarray, documents: int, tokens: int) -> np.ndarray:
    """50 and fifty times a document's length over the mean, rounded down."""
    if 50 * int(sizes.max(initial=0)) * documents < 1 << 63:
        return 50 + 50 * sizes * documents // max(tokens, 1)
    return np.array([50 + 50 * int(n) * documents // tokens for n in sizes], np.int64)


def _pairs(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term), each once."""

    def run(batches):
        for b in batches:
            found = [list({t for words in terms_of(x or b"") for t in words}) for x in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.binary()))], names=["item", "terms"])

    kept = queries.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([T.StructField("item", kept.schema["item"].dataType), T.StructField("terms", T.ArrayType(T.BinaryType()))])
    return kept.mapInArrow(run, schema).select("item", F.explode("terms").alias("term")).distinct()


def _blocks(pairs: DataFrame, limit: int) -> list[Column]:
    """Conditions that part the items into blocks of at most twice the limit of pairs, or of single items."""
    total = pairs.agg(F.count("*").alias("pairs"), F.count_distinct(F.struct("item")).alias("items")).first()
    n = -(-total.pairs // limit)
    while n > 1:
        block = F.pmod(F.xxhash64("item"), F.lit(n))
        if n >= 4 * total.items or pairs.groupBy(block.alias("b")).count().agg(F.max("count")).first()[0] <= 2 * limit:
            break
        n *= 2
    return [F.pmod(F.xxhash64("item"), F.lit(n)) == b for b in range(n)]


def _texts(b: pa.RecordBatch):
    """(first row, texts) of a batch, in pieces of bounded size."""
    for row in range(0, b.num_rows, 1 << 16):
        texts = b.column(1)[row : row + (1 << 16)].cast(pa.binary()).to_pylist()
        for lo, hi in chunks_by_bytes(texts):
            yield row + lo, texts[lo:hi]


def _counts(docs: DataFrame, block) -> dict[int, int]:
    """Documents that hold each term of the block, by its number; all documents with a term and all their terms under numbers of their own."""

    def run(batches):
        numbers = Vocabulary((t, i) for i, t in enumerate(block.value[0]))
        holding, documents, tokens = np.zeros(len(numbers), np.int64), 0, 0
        for b in batches:
            for _, texts in _texts(b):
                sizes, _, term, _ = postings(texts, numbers)
                holding += np.bincount(term, minlength=len(numbers))
                documents += int((sizes > 0).sum())
                tokens += int(sizes.sum())
        held = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, [DOCUMENTS, TOKENS])), pa.array(np.append(holding[held], [documents, tokens]))], names=["term", "n"])

    return {r.term: r.n for r in docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}


class _Best:
    """The k best documents of an item so far: greatest scores, then smallest ids, null ids last."""

    def __init__(self, k: int):
        self.k, self.floor = k, 0
        self.score, self.id, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        score, ids, none = np.append(self.score, score), np.append(self.id, ids), np.append(self.none, none)
        order = np.lexsort((ids, none, -score))[: self.k]
        self.score, self.id, self.none = score[order], ids[order], none[order]
        if len(order) == self.k:
            self.floor = int(self.score[-1])


def _candidates(docs: DataFrame, block, stats, item_type: T.DataType, k: int, shard_postings: int) -> DataFrame:
    """(item, doc_id, score): the k best of every task."""

    def run(batches):
        terms, items, begin, asked = block.value
        weights, documents, tokens = stats.value
        numbers = Vocabulary((t, i) for i, t in enumerate(terms))
        best = [_Best(k) for _ in range(len(items))]
        held: list[tuple] = []

        def flush():
            sizes = [len(h[0]) for h in held]
            before = np.cumsum(sizes) - sizes
            ids, none, norm, term, tf = (np.concatenate([h[i] for h in held]) for i in (0, 1, 2, 4, 5))
            doc = np.concatenate([h[3] + at for h, at in zip(held, before, strict=True)])
            held.clear()
            index = Index(doc, term, tf, norm, len(terms))
            for q, top in enumerate(best):
                mine = asked[begin[q] : begin[q + 1]]
                found, score = index.search(mine, weights[mine], k, top.floor)
                if len(found):
                    top.add(score, ids[found], none[found])

        for b in batches:
            own = b.column(0)
            none = np.array(own.is_null())
            own = own.fill_null(0).to_numpy(zero_copy_only=False)
            for row, texts in _texts(b):
                sizes, doc, term, tf = postings(texts, numbers)
                found, doc = np.unique(doc, return_inverse=True)
                if not len(found):
                    continue
                if held and (sum(len(h[4]) for h in held) + len(term) > shard_postings or sum(len(h[0]) for h in held) + len(found) > SHARD_DOCS):
                    flush()
                held.append((own[row + found], none[row + found], norms(sizes[found], documents, tokens), doc, term, tf))
        if held:
            flush()
        for lo in range(0, len(best), 4096):
            part = best[lo : lo + 4096]
            ids = pa.array(np.concatenate([x.id for x in part]), mask=np.concatenate([x.none for x in part]))
            of = np.repeat(np.arange(lo, lo + len(part)), [len(x.score) for x in part])
            yield pa.RecordBatch.from_arrays([items.take(pa.array(of)), ids, pa.array(np.concatenate([x.score for x in part]))], names=["item", "doc_id", "score"])

    schema = T.StructType([T.StructField("item", item_type), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    return docs.mapInArrow(run, schema)


def _block(spark, pairs: DataFrame):
    """The block as a broadcast: its terms, its items, and the items' terms by number."""
    rows = pairs.toArrow().sort_by([("item", "ascending")])
    column = rows.column("term").combine_chunks().dictionary_encode()
    items = rows.column("item").combine_chunks()
    codes = items.dictionary_encode(null_encoding="encode")
    order = np.argsort(codes.indices.to_numpy(), kind="stable")
    begin = np.searchsorted(codes.indices.to_numpy()[order], np.arange(len(codes.dictionary) + 1))
    return spark.sparkContext.broadcast((column.dictionary.to_pylist(), codes.dictionary, begin, column.indices.to_numpy().astype(np.int64)[order]))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item: salted groups first, so that no task sees all of a hot item."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = found.withColumn("salt", F.spark_partition_id() % shuffle_partitions(found.sparkSession))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", block_terms: int = BLOCK_TERMS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item_col, rank, doc_id, score): the k highest scores above 0 of every item, ties by document id."""
    spark = docs.sparkSession
    pairs = _pairs(queries, item_col, query_col)
    kind = pairs.schema["item"].dataType
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    parts = []
    for condition in _blocks(pairs, block_terms):
        block = _block(spark, pairs.where(condition))
        counted = _counts(texts, block)
        documents = counted.get(DOCUMENTS, 0)
        weights = np.array([weight(documents, counted.get(i, 0)) for i in range(len(block.value[0]))], np.int64)
        stats = spark.sparkContext.broadcast((weights, documents, counted.get(TOKENS, 0)))
        parts.append(ranked(_candidates(texts, block, stats, kind, k, shard_postings), k))
    if not parts:
        empty = T.StructType([T.StructField("item", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
        parts = [spark.createDataFrame([], empty)]
    return reduce(DataFrame.unionByName, (p.select("item", "rank", "doc_id", "score") for p in parts)).withColumnRenamed("item", item_col)


def search_sql(docs: str = "documents", queries: str = "benchmark", k: int = K) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = lambda column: f"unnest(regexp_extract_all(translate({column}, '{upper}', '{lower}'), '{TERM_PATTERN}'))"
    return f"""
        WITH words AS (SELECT doc_id, {terms("text")} AS term FROM {docs}),
        held AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
        sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM held GROUP BY doc_id),
        whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS tokens FROM sizes),
        norms AS (SELECT doc_id, 50 + 50 * n * docs // tokens AS m FROM sizes, whole),
        asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {terms("text")} AS term FROM {queries})),
        weights AS (
            SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
            FROM held, whole WHERE term IN (SELECT term FROM asked) GROUP BY term),
        scores AS (
            SELECT item_id, doc_id, sum(w * (1000000000 * tf // (1000 * tf + 20 * m)))::BIGINT AS score
            FROM asked JOIN weights USING (term) JOIN held USING (term) JOIN norms USING (doc_id) GROUP BY item_id, doc_id),
        places AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM places WHERE rank <= {k}
    """
