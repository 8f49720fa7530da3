"""Extraction results against labels: one-to-one matches, what is left over, and the stage that lost each miss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.functions.dialect import SPARK as D
from gristmill.operators import ranks, refine
from gristmill.operators.failures import materialised

TIERS = ("required", "preferred", "mentioned")
KEY = "fixture_id"


def _prepared(rows: DataFrame, column: str, to: str) -> DataFrame:
    """rows with the normal form and the content words of a text."""
    return rows.withColumn(f"{to}n", F.expr(T.normal(D, column))).withColumn(f"{to}c", F.expr(T.content(D, column)))


def _with_variants(rows: DataFrame, variants: Column) -> DataFrame:
    """rows with the normal forms (vn) and contents (vc) of an array of texts."""
    rows = rows.withColumn("vs_", F.coalesce(variants, F.array().cast("array<string>")))
    return rows.withColumn("vn", F.expr(f"transform(vs_, x -> {T.normal(D, 'x')})")).withColumn("vc", F.expr(f"transform(vs_, x -> {T.content(D, 'x')})")).drop("vs_")


def strict(vn: str = "vn", n: str = "pn") -> Column:
    return F.array_contains(vn, F.col(n))


def loose(vc: str = "vc", c: str = "pc") -> Column:
    return F.expr(f"exists({vc}, v -> {T.loose_match(D, 'v', c)})")


def either(vn: str = "vn", vc: str = "vc", n: str = "pn", c: str = "pc") -> Column:
    return strict(vn, n) | loose(vc, c)


def _marks(normals: str, tokens: str, of_label: bool) -> Column:
    """Numbers of which two values share one, hashes apart only if they match: of equal normal forms, equal tokens, and a token that begins the other.

    normals, tokens: SQL of arrays of texts. Tokens are ASCII, so that their octets are their characters; those under five begin no other.
    """
    every = f"array_distinct({tokens})"
    begins = "if(length(t) > 5, transform(sequence(5, length(t) - 1), k -> left(t, k)), CAST(array() AS ARRAY<STRING>))"
    marked = lambda kind, array: f"transform({array}, m -> xxhash64('{kind}', m))"
    begun = f"flatten(transform({every}, t -> {begins}))"
    # a label's token meets whole tokens and beginnings of predictions, its beginnings meet whole tokens only
    parts = [("w", every), ("b", begun)] if of_label else [("w", every), ("w", begun), ("b", every)]
    return F.expr(f"concat({marked('n', normals)}, {', '.join(marked(*x) for x in parts)})")


#: The tokens of an array of contents.
_TOKENS = "flatten(transform({}, c -> coalesce(c, CAST(array() AS ARRAY<STRING>))))"
_MARKS_P = ("array(pn)", "coalesce(pc, CAST(array() AS ARRAY<STRING>))", False)


def pairs(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """(fixture_id, exp_ord, pred_ord, pn, pass_no, far): labels and predictions that match, in pass 0 strictly, in pass 1 only loosely; pn: the prediction's normal form.

    A pair that both tests allow is looked at once: what the strict pass couldn't take, the loose one can't.
    """
    e = _with_variants(expected, F.concat(F.array("value"), F.coalesce("aliases", F.array().cast("array<string>"))))
    e = e.select(KEY, "exp_ord", "vn", "vc", F.get("vc", F.lit(0)).alias("ec")).withColumn("em", _marks("vn", _TOKENS.format("vc"), True))
    p = _prepared(predicted, "value", "p").select(KEY, "pred_ord", "pn", "pc").withColumn("pm", _marks(*_MARKS_P))
    # a shared mark is told quickly, only pairs that have one are compared; coalesce keeps tests for null marks, which would work them out again, out of the scans
    both = e.join(p, KEY).where(F.coalesce(F.arrays_overlap("em", "pm"), F.lit(False)))
    pass_no = F.when(strict(), 0).when(loose(), 1)
    return both.select(KEY, "exp_ord", "pred_ord", "pn", pass_no.alias("pass_no"), F.expr(f"-({T.fuzzy_jaccard(D, 'ec', 'pc')})").alias("far")).where("pass_no IS NOT NULL")


def matches(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """(fixture_id, exp_ord, pred_ord, strict): one to one, strict before loose, labels in order, the nearest prediction, the earliest on ties.

    expected(fixture_id, exp_ord, value, aliases), predicted(fixture_id, pred_ord, value).
    """
    return _one_to_one(pairs(expected, predicted))


def _one_to_one(found: DataFrame) -> DataFrame:
    taken = refine.greedy_match(found, KEY, "exp_ord", "pred_ord", ["pass_no", "exp_ord", "far", "pred_ord"], ["pass_no"])
    return taken.where("exp_ord IS NOT NULL AND pred_ord IS NOT NULL").select(KEY, "exp_ord", "pred_ord", (F.col("pass_no") == 0).alias("strict"))


def leftovers(labels: DataFrame, expected: DataFrame, predicted: DataFrame, matched: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(fixture_id, pred_ord, value, kind): unmatched predictions as filler, acceptable, duplicate or extra, the first that holds.

    labels(fixture_id, filler, acceptable). found: the `pairs` of expected and predicted, where they are known.
    """
    free = _prepared(predicted.join(matched.select(KEY, "pred_ord"), [KEY, "pred_ord"], "left_anti"), "value", "p")
    lists = _with_variants(labels.select(KEY, "filler", "acceptable"), F.col("filler")).withColumnsRenamed({"vn": "fn", "vc": "fc"})
    lists = _with_variants(lists, F.col("acceptable")).withColumnsRenamed({"vn": "an", "vc": "ac"})
    lists = lists.select(KEY, *[c for n in "fa" for c in (f"{n}n", f"{n}c", _marks(f"{n}n", _TOKENS.format(f"{n}c"), True).alias(f"{n}m"))])
    # the normal form of a prediction, and so its content, says whether it matches a label
    met = (pairs(expected, predicted) if found is None else found).select(KEY, "pn").distinct().withColumn("met", F.lit(True))
    rows = free.withColumn("pm", _marks(*_MARKS_P)).join(lists, KEY, "left").join(met, [KEY, "pn"], "left")
    holds = lambda n, c, m: F.coalesce(F.arrays_overlap(m, "pm"), F.lit(False)) & F.coalesce(either(n, c), F.lit(False))
    kind = F.when(holds("fn", "fc", "fm"), "filler").when(holds("an", "ac", "am"), "acceptable").when(F.col("met"), "duplicate").otherwise("extra")
    return rows.select(KEY, "pred_ord", "value", kind.alias("kind"))


def tier_of(predicted: DataFrame, context: DataFrame) -> DataFrame:
    """predicted(fixture_id, pred_ord, tier, refs) with the stored tier, else that of its sentences, else ''. context(fixture_id, ref, section)."""
    rank = F.when(F.col("section") == "required", 2).when(F.col("section") == "preferred", 1).when(F.col("section").isNotNull(), 0)
    derived = predicted.select(KEY, "pred_ord", F.explode_outer("refs").alias("ref")).join(context, [KEY, "ref"], "left").groupBy(KEY, "pred_ord").agg(F.max(rank).alias("r_"))
    named = F.when(F.col("r_") == 2, "required").when(F.col("r_") == 1, "preferred").when(F.col("r_") == 0, "mentioned").otherwise("")
    return predicted.join(derived, [KEY, "pred_ord"], "left").withColumn("tier", F.coalesce(F.nullif("tier", F.lit("")), named)).drop("r_")


def fixture_scores(labels: DataFrame, expected: DataFrame, predicted: DataFrame, context: DataFrame) -> DataFrame:
    """A row for each fixture and tier, and one with tier '' for all: expected, predicted, strict, loose, tier_checked, tier_correct, filler, acceptable, duplicate, extra."""
    met = materialised(pairs(expected, predicted))
    matched = materialised(_one_to_one(met))
    tiers = tier_of(predicted, context).select(KEY, "pred_ord", F.col("tier").alias("got"))
    rows = expected.join(matched, [KEY, "exp_ord"], "left").join(tiers, [KEY, "pred_ord"], "left")
    n = lambda when: F.count(F.when(when, 1))
    found, told = F.col("pred_ord").isNotNull(), F.coalesce(F.col("got") != "", F.lit(False))
    by = rows.groupingSets([[KEY, "tier"], [KEY]], KEY, "tier").agg(F.count("*").alias("expected"), n(F.col("strict")).alias("strict"), n(found).alias("loose"), n(told).alias("tier_checked"), n(told & (F.col("got") == F.col("tier"))).alias("tier_correct"), F.grouping("tier").alias("all_"))
    by = by.withColumn("tier", F.when(F.col("all_") == 1, "").otherwise(F.col("tier"))).drop("all_")
    rest = leftovers(labels, expected, predicted, matched, met).groupBy(KEY).agg(*[n(F.col("kind") == k).alias(k) for k in ("filler", "acceptable", "duplicate", "extra")])
    count = predicted.groupBy(KEY).agg(F.count("*").alias("predicted"))
    return by.join(count, KEY, "left").join(rest, KEY, "left").na.fill(0)


def totals(scores: DataFrame) -> DataFrame:
    """One row of micro-averages over the rows with tier ''."""
    s = scores.where("tier = ''").agg(F.count("*").alias("fixtures"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("expected", "predicted", "strict", "loose", "filler", "acceptable", "duplicate")])
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), b), F.lit(0.0))
    s = s.withColumn("recall_strict", ratio("strict", F.col("expected"))).withColumn("recall_loose", ratio("loose", F.col("expected"))).withColumn("precision_loose", ratio("loose", F.col("predicted") - F.col("acceptable") - F.col("duplicate")))
    both = F.col("precision_loose") + F.col("recall_loose")
    return s.withColumn("f1_loose", F.coalesce(F.try_divide(2 * F.col("precision_loose") * F.col("recall_loose"), both), F.lit(0.0)))


def word_in(text: str, variant: str) -> Column:
    """True where a text holds a variant as a word of its own, whatever the case and the kind of quotes; both are names of columns."""
    straight = lambda s: f"lower(translate({s}, '’‘“”', '\\'\\'\"\"'))"
    return F.expr(f"{variant} <> '' AND {straight(text)} RLIKE concat('(^|[^a-z0-9])', regexp_replace({straight(variant)}, '([\\\\\\\\.\\\\[\\\\]{{}}()*+?^$|])', '\\\\\\\\$1'), '($|[^a-z0-9+#])')")


def misses(expected: DataFrame, matched: DataFrame, values: DataFrame, validated: DataFrame, sentences: DataFrame) -> DataFrame:
    """(fixture_id, exp_ord, value, stage, at): the latest stage that saw a missed label and lost it.

    values(fixture_id, i, value, keep, merged): refined values in order. validated(fixture_id, ord, chunk_no, options, selected).
    sentences(fixture_id, ord, text, dropped). Stages: filler, merged, scoring; not_selected, rejected; section_dropped, no_candidate; not_in_text.
    """
    lost = _with_variants(expected.join(matched.select(KEY, "exp_ord"), [KEY, "exp_ord"], "left_anti"), F.concat(F.array("value"), F.coalesce("aliases", F.array().cast("array<string>"))))
    lost = lost.withColumn("variants", F.concat(F.array("value"), F.coalesce("aliases", F.array().cast("array<string>")))).select(KEY, "exp_ord", "value", "vn", "vc", "variants")
    keys = [KEY, "exp_ord", "value"]
    seen = lost.join(_prepared(values.withColumnRenamed("value", "v_"), "v_", "p"), KEY).where(either())
    first = seen.select(*keys, F.lit(0).alias("rank"), F.struct(F.col("i").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("at"), F.when(~F.col("keep"), "filler").when(F.col("merged"), "merged").otherwise("scoring").alias("stage"))
    offered = _prepared(validated.select(KEY, "ord", "chunk_no", "selected", F.explode("options").alias("o_")), "o_", "p")
    near = lost.join(offered, KEY).withColumn("is_strict", strict()).where(either())
    place = F.struct(F.col("ord").cast("long").alias("a"), F.col("chunk_no").cast("long").alias("b"))
    # a chunk with a strict candidate wins over an earlier one with a loose one
    second = near.select(*keys, F.when(F.col("is_strict"), 1).otherwise(2).alias("rank"), place.alias("at"), F.when(F.col("selected"), "not_selected").otherwise("rejected").alias("stage"))
    words = lost.select(*keys, F.explode("variants").alias("w_")).join(sentences.withColumnRenamed("text", "t_"), KEY).where(word_in("t_", "w_"))
    third = words.select(*keys, F.lit(3).alias("rank"), F.struct(F.col("ord").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("at"), F.when(F.col("dropped"), "section_dropped").otherwise("no_candidate").alias("stage"))
    none = lost.select(*keys, F.lit(4).alias("rank"), F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("at"), F.lit("not_in_text").alias("stage"))
    every = first.unionByName(second).unionByName(third).unionByName(none)
    return every.groupBy(*keys).agg(F.min_by(F.struct("stage", "at"), F.struct("rank", "at")).alias("m")).select(*keys, "m.stage", F.col("m.at.a").alias("at"))


def tier_order(expected: DataFrame, matched: DataFrame, predicted: DataFrame) -> DataFrame:
    """(fixture_id, tier_order): share of matched pairs of different label tiers that importance orders rightly, ties a half; null if all importances are equal."""
    rank = F.when(F.col("tier") == "required", 2).when(F.col("tier") == "preferred", 1).otherwise(0)
    rows = matched.join(expected.select(KEY, "exp_ord", rank.alias("r")), [KEY, "exp_ord"]).join(predicted.select(KEY, "pred_ord", "importance"), [KEY, "pred_ord"]).select(KEY, "exp_ord", "r", "importance")
    spread = predicted.groupBy(KEY).agg((F.min("importance") < F.max("importance")).alias("differ"))
    out = ranks.tier_order(rows, KEY, "r", "importance").withColumnRenamed("tier_order", "t_")
    return spread.join(out, KEY, "left").select(KEY, F.when(F.col("differ"), F.col("t_")).alias("tier_order"))


def group_f1(wanted: DataFrame, got: DataFrame) -> DataFrame:
    """(fixture_id, group_f1): F1 of the pairs of values that share a group; 0 without a hit, and no row where nothing was grouped.

    wanted, got (fixture_id, grp, value): a value is in one group of a side, as labels and components are. Pairs are counted by the sizes of
    groups and of their meets, and never made.
    """
    both = wanted.select(KEY, "value", F.col("grp").alias("w")).distinct().join(got.select(KEY, "value", F.col("grp").alias("g")).distinct(), [KEY, "value"], "full")
    pairs = lambda of, name, *by: of.groupBy(KEY, *by).agg(F.count("*").alias("n_")).select(KEY, *[(F.expr("n_ * (n_ - 1) div 2") if n == name else F.lit(0).cast("long")).alias(n) for n in ("want", "got", "hit")])
    every = pairs(both.where("w IS NOT NULL"), "want", "w").unionByName(pairs(both.where("g IS NOT NULL"), "got", "g")).unionByName(pairs(both.where("w IS NOT NULL AND g IS NOT NULL"), "hit", "w", "g"))
    sums = every.groupBy(KEY).agg(*[F.sum(n).alias(n) for n in ("want", "got", "hit")])
    return got.select(KEY).distinct().join(sums, KEY).select(KEY, F.coalesce(F.try_divide(2 * F.col("hit"), F.col("want") + F.col("got")), F.lit(0.0)).alias("group_f1"))


def numbered(requirements: DataFrame, key: str = "posting_id") -> DataFrame:
    """Requirements as predictions: (fixture_id, pred_ord, ...)."""
    return requirements.withColumnRenamed(key, KEY).withColumn("pred_ord", F.row_number().over(Window.partitionBy(KEY).orderBy("req_ord")) - 1)
