"""Periodic runs of words, found by comparing a document with itself at a lag.

The words of a document are numbered, and bit b of all numbers is one big integer, word i at bit i. At lag q
each plane is XORed with itself shifted by q and the results are ORed: a zero says that words i and i + q are the
same. A run of period q is a stretch of such zeros; AND with shifted copies, the shift doubling, leaves
only the starts of stretches that are long enough. Lags rise, so the first that finds a stretch is its smallest period.

Short lags are all compared. A run of period q from 2g up to 4g has 2g equal words at lag q or more, hence a whole
gram of g words that starts at a multiple of g and stands q words later again: only lags at which such a gram
does (its hash, over all positions) are compared. Repeats inside a run already found add no lag if
its period divides theirs. So the work is near n log n where nothing repeats, and no run is lost.

Defined results: null, empty and blank texts have no words and no run; repeated rows have equal results; a null id leaves
the text as it is in `looped`; an empty table gives an empty result; other columns pass through, and new
ones get underscores where their names are taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import chunks_by_bytes, free_name

#: Words of a run at least.
FEWEST = 12
#: Words of the shortest grams; lags below twice as many are all compared.
GRAM = 4
#: Comparisons of grams at a time.
BLOCK = 1 << 20
SPACES = "[ \\t-\\r]+"


def planes(ids: np.ndarray) -> list[int]:
    """Bit b of every number as one integer for each b; word i is bit i."""
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(max(1, int(ids.max()).bit_length()))]


def matches(bits: list[int], n: int, lag: int) -> int:
    """Bit i is set where words i and i + lag are the same."""
    differ = 0
    for plane in bits:
        differ |= plane ^ (plane >> lag)
    mask = (1 << (n - lag)) - 1
    return (differ & mask) ^ mask


def erode(ones: int, k: int) -> int:
    """Bit i stays where bits i to i + k - 1 are all set."""
    have = 1
    while have < k and ones:
        step = min(have, k - have)
        ones &= ones >> step
        have += step
    return ones


def set_bits(x: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes(x.bit_length() + 7 >> 3, "little"), np.uint8), bitorder="little"))


def stretches(ones: int, k: int) -> list[tuple[int, int]]:
    """(start, end) of every longest stretch of at least k set bits."""
    left = erode(ones, k)
    if not left:
        return []
    return list(zip(set_bits(left & ~(left << 1)).tolist(), (set_bits(left & ~(left >> 1)) + k).tolist(), strict=True))


def _explained(hits: np.ndarray, row: int, g: int, found: dict[tuple[int, int], int]) -> None:
    """Clears hits (rows: grams from number `row` on, columns: lags from 2g on) that lie in a run whose period divides the lag."""
    for (start, end), period in found.items():
        if end - start < 3 * g or end <= row * g or start >= (row + len(hits)) * g:
            continue
        first = max(-(-start // g), row)
        column = -2 * g % period
        whole = max(first, min(end // g - 5, row + len(hits)))  # all lags below 4g end inside the run
        hits[first - row : whole - row, column::period] = False
        for j in range(whole, min(end // g - 2, row + len(hits))):
            hits[j - row, column : end - j * g - 3 * g + 1 : period] = False


def lags(grams: np.ndarray, g: int, n: int, found: dict[tuple[int, int], int]) -> list[int]:
    """Lags from 2g up to 4g, n / 2 at most, at which a gram at a multiple of g stands again."""
    anchors = np.arange(0, len(grams), g)
    width = min(2 * g, n // 2 - 2 * g + 1)
    later = np.append(grams, np.zeros(4 * g, grams.dtype))
    windows = sliding_window_view(later, width)
    hit = np.zeros(width, bool)
    step = max(1, BLOCK // width)
    for lo in range(0, len(anchors), step):
        at = anchors[lo : lo + step]
        at = at[at + 2 * g < len(grams)]
        if len(at):
            hits = windows[at + 2 * g] == grams[at, None]
            _explained(hits, lo, g, found)
            hit |= hits.any(axis=0)
    return (np.flatnonzero(hit) + 2 * g).tolist()


def runs(ids: np.ndarray, fewest: int = FEWEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of fewest words and two periods at least, by start and period."""
    n = len(ids)
    if n < max(2, fewest):
        return []
    bits = planes(ids)
    found: dict[tuple[int, int], int] = {}

    def compare(lag: int) -> None:
        for start, end in stretches(matches(bits, n, lag), max(fewest - lag, lag)):
            found.setdefault((start, end + lag), lag)

    for lag in range(1, min(2 * GRAM, n // 2 + 1)):
        compare(lag)
    grams = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    g = 1
    while 4 * g <= n:  # lags from 2g on, n / 2 at most
        if g >= GRAM:
            ranked = np.sort(grams)
            if not (ranked[1:] == ranked[:-1]).any():
                break  # nothing so long stands twice
            for lag in lags(grams, g, n, found):
                compare(lag)
        grams = (grams[:-g] ^ grams[:-g] >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + grams[g:]
        g *= 2
    return sorted((start, end - start, period) for (start, end), period in found.items())


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than blank, tab, line feed, vertical tab, form feed and return."""
    return (text or b"").split()


class _Index(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def numbers(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_Index().__getitem__, words), np.int64, len(words))


def kept(found: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """False for words that a run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:n]) == 0


RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)


def collapse(docs: DataFrame, text_col: str = "text", fewest: int = FEWEST) -> DataFrame:
    """docs with `runs` (start, length, period; by start, then period) and `collapsed`: the words left once each run keeps its first period."""
    names = [*docs.columns, *(free_name(c, docs.columns) for c in ("runs", "collapsed"))]
    kind = pa.list_(pa.struct([pa.field(c, pa.int64(), False) for c in ("start", "length", "period")]))

    def run(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()
            for lo, hi in chunks_by_bytes(texts):
                rows, left = [], []
                for text in texts[lo:hi]:
                    words = words_of(text)
                    found = runs(numbers(words), fewest)
                    rows.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                    left.append(b" ".join(words[i] for i in np.flatnonzero(kept(found, len(words)))) if found else b" ".join(words))
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(rows, kind), pa.array(left, pa.binary()).cast(pa.string())], names=names)

    schema = T.StructType([*docs.schema.fields, T.StructField(names[-2], RUN), T.StructField(names[-1], T.StringType())])
    text = F.col(f"`{text_col}`").cast("string").alias(free_name("text", docs.columns))
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns), text).mapInArrow(run, schema)


def looped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): a tenth of the documents, by crc32 of the id, repeat a stretch of words of theirs up to their end."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col), h.alias("h"), F.when(h % 10 == 0, F.array_remove(F.split(F.col(text_col), SPACES), "")).alias("words"))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    a = F.try_mod(g, n)  # null where there are no words: such a text stays as it is
    p = 1 + F.floor((n - a) / (3 + g % 8))
    sized = words.select("*", a.cast("int").alias("a"), p.cast("int").alias("p"), n.alias("n"))
    unit, before = F.slice("words", F.col("a") + 1, F.col("p")), F.slice("words", F.lit(1), F.col("a"))
    tail = F.flatten(F.array_repeat(unit, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    text = F.array_join(F.slice(F.concat(before, tail), F.lit(1), F.col("n")), " ")
    return sized.select(id_col, F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), text).otherwise(F.col(text_col)).alias(text_col))


def digest(docs: DataFrame) -> DataFrame:
    """A row a document: its runs counted and hashed, the longest run, the hash of the collapsed text."""
    out = collapse(looped(docs.select("doc_id", "text")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    best = out.select("*", longest.alias("best"))
    length, period = F.col("best.length"), -F.col("best.period")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("best.length * 1000 div -best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
