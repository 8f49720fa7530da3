"""Values of a group that share a telling word or enough of their trigrams.

A group of up to WHOLE values is dealt out once, as its values alone, and compared in a task by products of its matrices of words and trigrams.
Larger groups are never compared whole, nor held by one task: values meet where they have a word in common, which is a result already, or where the rare ends of their trigram sets meet: sets
of Jaccard similarity t share one of their |s| - ceil(t |s|) + 1 rarest trigrams, and their sizes are within t of each other. What meets is verified.

Defined results: null values take no part; a null group is no group; equal values under different ids are similar (but blank ones, which
have neither words nor letters in common); empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import lexicon as X
from gristmill.functions import text as T
from gristmill.functions.dialect import SPARK as D
from gristmill.operators import folds

WHOLE = 1000  # values of a group that are compared in one task
_CELLS = 1 << 22  # of a matrix at once
_PLAIN = (*X.STOPWORDS, *X.GENERIC)


def telling_words(value: Column) -> Column:
    """The different lower-case words of a value but those that say nothing."""
    words = F.array_distinct(F.split(F.trim(F.lower(value)), "\\s+"))
    return F.array_except(words, F.array(*[F.lit(w) for w in ("", *_PLAIN)]))


def packed(gram: Column) -> Column:
    """The three characters of a trigram in one number, 21 bits each: sets of them take a third of the strings' bytes."""
    at = lambda k: F.ascii(F.substring(gram, k, 1)).cast("long")
    return F.shiftleft(at(1), 42).bitwiseOR(F.shiftleft(at(2), 21)).bitwiseOR(at(3))


def _grams(values: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(place of the value, code, number of codes) of every trigram of the padded values; equal codes are equal trigrams."""
    padded = pc.binary_join_element_wise("", values, "", " ")
    try:
        text = "".join(padded.to_pylist())
    except UnicodeDecodeError:  # not all that a table holds is UTF-8
        padded = pa.array([b.decode("utf-8", "replace") for b in padded.cast(pa.binary()).to_pylist()], pa.string())
        text = "".join(padded.to_pylist())
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    sizes = pc.utf8_length(padded).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    place = np.repeat(np.arange(len(sizes)), sizes)
    first = np.flatnonzero(np.arange(len(chars)) < ends[place] - 2)
    seen = np.zeros(int(chars.max(initial=0)) + 1, bool)
    seen[chars] = True
    kinds = max(int(seen.sum()), 1)
    c = (np.cumsum(seen) - 1)[chars]
    code, span = (c[first] * kinds + c[first + 1]) * kinds + c[first + 2], kinds**3
    if kinds > 1 << 12:  # many alphabets: number those that occur
        found, code = np.unique(code, return_inverse=True)
        span = max(len(found), 1)
    return place[first], code, span


def _words(lowered: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """The same of the telling words of lower-case values."""
    lists = pc.ascii_split_whitespace(lowered)
    words = pc.list_flatten(lists).dictionary_encode()
    place, code = pc.list_parent_indices(lists).to_numpy().astype(np.int64), words.indices.to_numpy().astype(np.int64)
    plain = pc.is_in(words.dictionary, pa.array(["", *_PLAIN], words.dictionary.type)).to_numpy(zero_copy_only=False).astype(bool)
    told = ~plain[code] if len(code) else np.zeros(0, bool)
    return place[told], code[told], max(len(plain), 1)


class _Held:
    """Which features the members of consecutive groups hold: matrices of zeros and ones, a group at a time."""

    def __init__(self, member: np.ndarray, code: np.ndarray, span: int, group: np.ndarray, bounds: np.ndarray):
        member, code = np.divmod(np.unique(member * span + code), span)
        found, column = np.unique(group[member] * span + code, return_inverse=True)
        first = np.searchsorted(found, np.arange(len(bounds)) * span)
        self.member, self.column = member, column - first[group[member]]
        self.at, self.widths, self.bounds = np.searchsorted(member, bounds).tolist(), np.diff(first).tolist(), bounds.tolist()
        self.sizes = np.bincount(member, minlength=len(group))

    def common(self, g: int) -> np.ndarray:
        """How many features each two members of a group share."""
        low, n = self.bounds[g], self.bounds[g + 1] - self.bounds[g]
        member, column = self.member[self.at[g] : self.at[g + 1]] - low, self.column[self.at[g] : self.at[g + 1]]
        both, step = 0.0, max(_CELLS // n, 1)
        for c in range(0, max(self.widths[g], 1), step):
            m = np.zeros((n, min(step, self.widths[g] - c)), np.float32)
            here = slice(None) if self.widths[g] <= step else (column >= c) & (column < c + step)
            m[member[here], column[here] - c] = 1
            both = both + m @ m.T
        return both.astype(np.float64)


def _compared(least: float):
    """A fold of (g, i, v, l): the pairs of the groups' values; an id that stands several times has the words and trigrams of all its values."""

    def fold(table: pa.Table, group: np.ndarray) -> pa.Table:
        new = folds.starts(table, ["g", "i"])
        member, ids = np.cumsum(new) - 1, np.flatnonzero(new)
        of = group[ids]
        bounds = np.append(folds.firsts(of), len(of))
        place, code, span = _grams(table.column("v").combine_chunks())
        grams = _Held(member[place], code, span, of, bounds)
        place, code, span = _words(table.column("l").combine_chunks())
        words = _Held(member[place], code, span, of, bounds)
        left, right = [], []
        for g in np.flatnonzero(np.diff(bounds) > 1).tolist():
            size, both = grams.sizes[bounds[g] : bounds[g + 1]], grams.common(g)
            near = (both > 0) & (both / np.maximum(np.add.outer(size, size) - both, 1) >= least)
            if words.widths[g]:
                near |= words.common(g) > 0
            a, b = np.nonzero(np.triu(near, 1))
            left.append(a + bounds[g])
            right.append(b + bounds[g])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        take = lambda c, x: table.column(c).take(pa.array(ids[x]))
        return pa.table({"g": take("g", a), "a_id": take("i", a), "b_id": take("i", b)})

    return fold


def similar_pairs(rows: DataFrame, group: str, id: str, value: str, least: float = X.TRIGRAM_SIMILAR, whole: int = WHOLE) -> DataFrame:
    """(group, a_id, b_id), a_id < b_id: the similar values of each group."""
    each = rows.select(F.col(group).alias("g"), F.col(id).alias("i"), F.col(value).cast("string").alias("v")).where("g IS NOT NULL AND i IS NOT NULL AND v IS NOT NULL")
    kinds = dict(each.dtypes)
    # all columns take part in the order, so that both uses of the window share one exchange
    sized = each.withColumn("n", F.count("*").over(Window.partitionBy("g").orderBy("i", "v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    few = folds.in_order(sized.where(F.col("n") <= whole).select("g", "i", "v", F.lower("v").alias("l")), ["g"], f"g {kinds['g']}, a_id {kinds['i']}, b_id {kinds['i']}", _compared(least))
    # the keys of large groups are fewer than a thousandth of the rows; where there are none, Spark drops the rest of the plan
    large = F.broadcast(sized.where(F.col("n") > whole).select("g").distinct())
    return few.unionByName(_met(each.join(large, "g", "left_semi"), least)).withColumnRenamed("g", group)


def _met(each: DataFrame, least: float) -> DataFrame:
    """(g, a_id, b_id): the pairs of groups of any size."""
    words = each.select("g", "i", F.explode(telling_words(F.col("v"))).alias("w"))
    a, b = words.alias("a"), words.alias("b")
    by_word = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.w") == F.col("b.w")) & (F.col("a.i") < F.col("b.i"))).select(F.col("a.g").alias("g"), F.col("a.i").alias("a_id"), F.col("b.i").alias("b_id"))
    grams = each.withColumn("t", F.transform(F.expr(T.trigrams(D, "v")), packed))
    # rarest first, by the values of the whole table that hold a trigram
    common = grams.select(F.explode("t").alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    ranked = grams.select("g", "i", F.explode("t").alias("x")).join(common, "x").groupBy("g", "i").agg(F.transform(F.array_sort(F.collect_set(F.struct("n", "x"))), lambda s: s["x"]).alias("s"))
    size = F.size("s")
    heads = ranked.select("g", "i", "s", F.explode(F.slice("s", F.lit(1), size - F.ceil(least * size - 1e-9).cast("int") + 1)).alias("x"))
    a, b = heads.alias("a"), heads.alias("b")
    n, m = F.size("a.s"), F.size("b.s")
    met = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.i") < F.col("b.i")) & (n >= least * m - 1e-9) & (m >= least * n - 1e-9))
    both = F.size(F.array_intersect("a.s", "b.s"))
    # a pair that meets at several trigrams is kept at the first they share
    near = met.where(F.col("a.x") == F.get(F.array_intersect("a.s", "b.s"), F.lit(0))).where(both / (n + m - both) >= least)
    by_grams = near.select(F.col("a.g").alias("g"), F.col("a.i").alias("a_id"), F.col("b.i").alias("b_id"))
    return by_word.unionByName(by_grams).distinct()


def offered(rows: DataFrame, group: str, id: str, value: str, all_pairs: int = X.ALL_PAIRS) -> DataFrame:
    """(group, id, other): whom each value may be a duplicate of: all others in groups of up to all_pairs values, the similar ones beyond."""
    sized = rows.withColumn("n_", F.count("*").over(Window.partitionBy(group)))
    few, many = sized.where(F.col("n_") <= all_pairs), sized.where(F.col("n_") > all_pairs)
    a, b = few.alias("a"), few.alias("b")
    whole = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{id}") != F.col(f"b.{id}"))).select(F.col(f"a.{group}").alias(group), F.col(f"a.{id}").alias(id), F.col(f"b.{id}").alias("other"))
    pairs = similar_pairs(many, group, id, value)
    one, two = pairs.select(group, F.col("a_id").alias(id), F.col("b_id").alias("other")), pairs.select(group, F.col("b_id").alias(id), F.col("a_id").alias("other"))
    return whole.unionByName(one).unionByName(two)
