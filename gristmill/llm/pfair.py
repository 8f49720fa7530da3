"""Mixing sources to target weights by Pfair scheduling.

Time is cut into slots of one block. A source with weight w of W in all gives its k-th block the release time
floor(k W / w) and the deadline ceil((k + 1) W / w); among the released blocks the earliest deadline goes
first, ties to the source that sorts first. Every block then lies in its window, so at any time each source's
share of the slots is less than one block from its target. Weights are exact integers over the whole run, so
nothing drifts.

The schedule isn't simulated from its start. Which blocks are done by a time T follows from T alone: source i has
done floor(T w / W) blocks or one more, and those with one more are found by taking
the pending blocks by deadline as long as, for every time s before T, the blocks left over that were released
before s fit the backlog sum(ceil(s w / W)) - s that any busy schedule has at s. So epochs of some hundred slots
start from their own state and run side by side.

Documents take their places in a source by the md5 of their id. Ranks come from two
levels, counts per (source, prefix of the md5) and a rank within the prefix, so that
a source with a third of all rows is never sorted by one task. DataFrame functions only; the driver gets
one count a source.

Every document gets exactly one place. When a source has no more blocks its slots
stay empty and the rest go on in their own slots, in unchanged proportion.

Defined results: a null source is the source ''; sources without a target weight share
the mean weight; null ids and repeated ids are ordered by a hash of their other columns, and rows alike in
everything share their places in any order; an empty table gives an empty result; all other columns pass through,
and a column of the schedule whose name is taken has underscores added to its name.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from gristmill.llm.common import free_name, shuffle_partitions

#: Documents of a block.
BLOCK_DOCS = 16
#: Slots that one row of the plan schedules, at least.
EPOCH = 256
#: Hexadecimal digits of the md5 that split a source.
PREFIX = 3
#: Integer weights sum to this at most; given ones beyond it are rounded to that many parts.
MOST = 1 << 31

Weights = dict[str, float] | Callable[[int], float] | None


def integer_weights(counts: dict[str, int], weights: Weights) -> dict[str, int]:
    """Exact integers in the proportion of the weights, read as decimals; sources without one get the mean of those given.

    weights: by source, or a function of a source's number of rows; none: all equal.
    """
    if not weights:
        return dict.fromkeys(counts, 1)
    exact = lambda x: Fraction(Decimal(str(x)))
    given = {s: exact(weights(n)) for s, n in counts.items()} if callable(weights) else {s: exact(w) for s, w in weights.items()}
    if any(w <= 0 for w in given.values()):
        raise ValueError("target weights must be positive")
    mean = sum(given.values()) / len(given)
    parts = {s: given.get(s, mean) for s in counts}
    scale = math.lcm(*(p.denominator for p in parts.values())) if parts else 1
    whole = {s: int(p * scale) for s, p in parts.items()}
    common = math.gcd(*whole.values()) if whole else 1
    whole = {s: w // common for s, w in whole.items()}
    total = sum(whole.values())
    return whole if total <= MOST else {s: max(1, w * (MOST - len(whole)) // total) for s, w in whole.items()}


def _longs(values: list[int]) -> Column:
    """A list of any length as one literal."""
    return F.from_json(F.lit(str(values)), "array<bigint>")


def _state(total: int) -> dict[str, str]:
    """SQL of the state at the start `t` of an epoch, column by column; ws: the weights."""
    return {
        "f": f"transform(ws, w -> (t * w) div {total})",
        "r": "t - aggregate(f, 0L, (a, x) -> a + x)",
        "cand": f"""array_sort(filter(transform(ws, (w, i) -> named_struct(
            'd', ((f[i] + 1) * {total} + w - 1) div w, 'i', i, 'r', (f[i] * {total}) div w, 'open', (t * w) % {total} > 0)), x -> x.open))""",
        "rs": "array_sort(array_distinct(transform(cand, c -> c.r)))",
        "caps": f"""transform(if(size(rs) > 1, slice(rs, 1, size(rs) - 1), slice(rs, 1, 0)), (x, j) -> named_struct('r', x, 'cap', r - size(filter(cand, c -> c.r <= x))
            + array_min(transform(sequence(x + 1, rs[j + 1]), s -> aggregate(ws, -s, (a, w) -> a + (s * w + {total - 1}) div {total})))))""",
        "ahead": """aggregate(cand, named_struct('s', cast(array() as array<int>), 'caps', caps),
            (st, c) -> if(size(st.s) < r and forall(st.caps, q -> c.r <= q.r or q.cap >= 1),
                named_struct('s', concat(st.s, array(c.i)), 'caps', transform(st.caps, q -> named_struct('r', q.r, 'cap', q.cap - if(c.r > q.r, 1L, 0L)))), st), st -> st.s)""",
        "used": "transform(f, (x, i) -> x + if(array_contains(ahead, i), 1L, 0L))",
    }


def schedule(spark, weights: list[int], blocks: list[int], epoch: int = EPOCH) -> DataFrame:
    """(i, k, slot): the slot of each block k of source i, earliest deadline first; a row of the plan schedules an epoch.

    An epoch's start looks back as far as its longest open window, so an epoch has a 64th of the longest window or more.
    """
    total = sum(weights)
    horizon = max((-(-b * total // w) for w, b in zip(weights, blocks, strict=True)), default=0)
    if horizon * total >= 1 << 62:
        raise ValueError("slots times the sum of the weights exceed 64 bits: take larger blocks or rounder weights")
    size = min(1 << 14, max(epoch, len(weights), total // min(weights, default=1) // 64))
    epochs = -(-horizon // size)
    plan = spark.range(0, epochs, 1, max(1, min(epochs, shuffle_partitions(spark)))).select((F.col("id") * size).alias("t"))
    plan = plan.withColumn("ws", _longs(weights))
    for name, text in _state(total).items():
        plan = plan.withColumn(name, F.expr(text))
    run = f"""aggregate(sequence(t, least(t + {size}, {horizon}L) - 1), named_struct('u', used, 'out', cast(array() as array<struct<i:int,k:bigint,slot:bigint>>)),
        (st, s) -> transform(array(array_min(transform(ws, (w, i) -> if((st.u[i] * {total}) div w <= s, named_struct('d', ((st.u[i] + 1) * {total} + w - 1) div w, 'i', i), null)))), b -> named_struct(
            'u', transform(st.u, (x, i) -> if(i = b.i, x + 1, x)),
            'out', concat(st.out, array(named_struct('i', b.i, 'k', st.u[b.i], 'slot', s)))))[0], st -> st.out)"""
    out = plan.select(F.explode(F.expr(run)).alias("o")).select("o.*")
    return out.where(F.col("k") < F.get(_longs(blocks), F.col("i")))


def _ranked(docs: DataFrame, id_col: str) -> DataFrame:
    """docs with __pf_src, __pf_prefix, __pf_md5 and __pf_row, which orders rows of one id."""
    rest = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
    row = F.xxhash64(*rest)
    md5 = F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null "), row.cast("string"))))
    keyed = docs.withColumn("__pf_src", F.coalesce(F.col("source").cast("string"), F.lit(""))).withColumn("__pf_md5", md5).withColumn("__pf_row", row)
    return keyed.withColumn("__pf_prefix", F.substring("__pf_md5", 1, PREFIX))


def mix(docs: DataFrame, weights: Weights = None, block_docs: int = BLOCK_DOCS, id_col: str = "doc_id", epoch: int = EPOCH) -> DataFrame:
    """docs with block (of its source), release, deadline, slot, and place = slot * block_docs + offset in the block.

    weights: target share by source, or a function of a source's number of rows; none: equal shares. Needs a column `source`.
    """
    spark = docs.sparkSession
    keyed = _ranked(docs, id_col)
    groups = keyed.groupBy("__pf_src", "__pf_prefix").agg(F.count("*").alias("__pf_n"))
    counts = {r[0]: r[1] for r in groups.groupBy("__pf_src").agg(F.sum("__pf_n")).collect()}  # one a source
    sources = sorted(counts)
    whole = integer_weights(counts, weights)
    ws, blocks = [whole[s] for s in sources], [-(-counts[s] // block_docs) for s in sources]
    total = sum(ws)
    plan = schedule(spark, ws, blocks, epoch)

    before = Window.partitionBy("__pf_src").orderBy("__pf_prefix").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("__pf_n").over(before), F.lit(0))
    index = F.array_position(F.from_json(F.lit(json.dumps(sources)), "array<string>"), F.col("__pf_src")).cast("int") - 1
    offsets = groups.withColumn("__pf_before", first).withColumn("i", index)
    spans = offsets.withColumn("k", F.explode(F.sequence(F.floor(F.col("__pf_before") / block_docs), F.floor((F.col("__pf_before") + F.col("__pf_n") - 1) / block_docs))))
    # the slots of a group's blocks travel to its rows as one list
    spans = spans.join(plan, ["i", "k"]).groupBy("__pf_src", "__pf_prefix", "__pf_before", "i").agg(F.array_sort(F.collect_list(F.struct("k", "slot"))).alias("__pf_slots"))
    spans = spans.select("__pf_src", "__pf_prefix", "__pf_before", "__pf_slots", F.get(_longs(ws or [1]), F.col("i")).alias("__pf_w"))

    within = Window.partitionBy("__pf_src", "__pf_prefix").orderBy("__pf_md5", F.col(id_col), "__pf_row")
    placed = keyed.withColumn("__pf_in", F.row_number().over(within) - 1).join(spans, ["__pf_src", "__pf_prefix"])
    placed = placed.withColumn("__pf_rank", F.col("__pf_before") + F.col("__pf_in")).withColumn("__pf_block", F.floor(F.col("__pf_rank") / block_docs))
    placed = placed.withColumn("__pf_slot", F.get("__pf_slots", (F.col("__pf_block") - F.floor(F.col("__pf_before") / block_docs)).cast("int"))["slot"])
    made = {
        "block": F.col("__pf_block"),
        "release": F.expr(f"(__pf_block * {total}) div __pf_w"),
        "deadline": F.expr(f"((__pf_block + 1) * {total} + __pf_w - 1) div __pf_w"),
        "slot": F.col("__pf_slot"),
        "place": F.col("__pf_slot") * block_docs + F.col("__pf_rank") % block_docs,
    }
    return placed.select(*(F.col(f"`{c}`") for c in docs.columns), *(c.cast("long").alias(free_name(n, docs.columns)) for n, c in made.items()))


def mix_sql(docs: str, weights: dict[str, float] | None = None, block_docs: int = BLOCK_DOCS) -> str:
    """DuckDB text of mix(): the plain simulation, slot by slot from the first one. Weights: with four decimals at most."""
    given = weights or {"": 1}
    listed = ", ".join(f"('{s}', {w}::DECIMAL(18, 4))" for s, w in given.items())
    return f"""
    (WITH RECURSIVE given(s, w) AS (VALUES {listed}),
    src AS (
      SELECT coalesce(source, '') AS s, count(*) AS n FROM {docs} GROUP BY coalesce(source, '')),
    weighed AS (
      SELECT s, n, (coalesce(g.w * (SELECT count(*) FROM given), (SELECT sum(w) FROM given)) * 10000)::BIGINT AS w,
             row_number() OVER (ORDER BY s) AS idx FROM src LEFT JOIN given g USING (s)),
    share AS (SELECT s, idx, w, (sum(w) OVER ())::BIGINT AS total, (n + {block_docs - 1}) // {block_docs} AS b FROM weighed),
    arr AS (SELECT list(w ORDER BY idx) AS ws, max(total) AS total, max((b * total + w - 1) // w) AS horizon FROM share),
    sim AS (
      SELECT -1::BIGINT AS t, list_transform(ws, lambda x: 0::BIGINT) AS used, 0::BIGINT AS i, 0::BIGINT AS k FROM arr
      UNION ALL
      SELECT t + 1, list_transform(used, lambda u, j: CASE WHEN j = pick.i THEN u + 1 ELSE u END), pick.i, used[pick.i]
      FROM (SELECT t, used, list_min(list_filter(list_transform(ws, lambda w, j: CASE WHEN (used[j] * total) // w <= t + 1
              THEN {{'d': ((used[j] + 1) * total + w - 1) // w, 'i': j::BIGINT}} END), lambda x: x IS NOT NULL)) AS pick FROM sim, arr WHERE t + 1 < horizon)),
    plan AS (SELECT i, k, t AS slot FROM sim WHERE t >= 0),
    ranked AS (SELECT d.*, coalesce(source, '') AS s_, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS r_ FROM {docs} d)
    SELECT r.* EXCLUDE (s_, r_), r_ // {block_docs} AS block, ((r_ // {block_docs}) * total) // w AS release,
           (((r_ // {block_docs}) + 1) * total + w - 1) // w AS deadline, p.slot, p.slot * {block_docs} + r_ % {block_docs} AS place
    FROM ranked r JOIN share h ON h.s = r.s_ JOIN plan p ON p.i = h.idx AND p.k = r_ // {block_docs})"""


def simulate(weights: list[int], horizon: int) -> list[tuple[int, int]]:
    """(source, block) of each slot by the plain rule; for tests."""
    total, used, out = sum(weights), [0] * len(weights), []
    for t in range(horizon):
        _, i = min((-(-(u + 1) * total // w), i) for i, (u, w) in enumerate(zip(used, weights, strict=True)) if u * total // w <= t)
        out.append((i, used[i]))
        used[i] += 1
    return out

