"""An independent judge of pairs: several replies a pair, their medians, a table they are merged into, and the agreement of three arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.functions.dialect import SPARK as D
from gristmill.operators import ranks
from gristmill.runtime import generated
from gristmill.settings.config import Settings
from gristmill.sinks import tables

REPLY = "struct<score:string,must_haves:array<struct<quote:string>>>"


def ask(pairs: DataFrame, rubric: str, settings: Settings, runs: int = 3) -> DataFrame:
    """(pair, run, said, error) of pairs(pair, resume, posting): `runs` replies to the rubric for each pair; failures stay in the row."""
    prompt = F.concat(F.lit("RESUME:\n"), "resume", F.lit("\n\nJOB POSTING:\n"), "posting")
    return generated(pairs.select("pair", prompt.alias("prompt")), "pair", rubric, "prompt", settings, runs).select("pair", "run", "said", "error")


def _plain(text: str) -> str:
    return f"trim({T.judge_normal(D, text)})"


def quote_rate(quotes: Column, resume: Column) -> Column:
    """The share of the quotes with something in them that stand in the resume, to two places; null where there are none. Both in plain form (see medians)."""
    told = F.filter(quotes, lambda q: q != "")
    return F.when(F.size(told) > 0, F.round(F.size(F.filter(told, lambda q: F.contains(resume, q))) / F.size(told), 2))


def parsed(replies: DataFrame) -> DataFrame:
    """(pair, run, score, quotes): the outermost braces of what was said; score null unless it is a whole number."""
    body = F.from_json(F.regexp_extract(F.coalesce("said", F.lit("")), "(?s)\\{.*\\}", 0), REPLY)
    rows = replies.withColumn("b_", body)
    score = F.when(F.col("b_.score").rlike("^-?[0-9]+$"), F.col("b_.score").cast("long"))
    quotes = F.transform(F.coalesce("b_.must_haves", F.array().cast("array<struct<quote:string>>")), lambda m: F.coalesce(m["quote"], F.lit("")))
    return rows.select("pair", "run", score.alias("score"), F.when(F.col("b_").isNotNull(), quotes).alias("quotes"))


def medians(replies: DataFrame, resumes: DataFrame) -> DataFrame:
    """(pair, score, scores, quote_rate) of replies(pair, run, score, quotes) and resumes(pair, resume): the median score, all scores in order of the
    runs, the mean share of quotes found. Pairs without a valid score have no row."""
    text = resumes.select("pair", F.expr(_plain("resume")).alias("r_"))  # white space and list marks aside, lower case
    rows = replies.withColumn("q_", F.expr(f"transform(quotes, q -> {_plain('q')})")).join(text, "pair")
    rows = rows.withColumn("rate_", quote_rate(F.col("q_"), F.col("r_")))
    scores = F.transform(F.array_sort(F.collect_list(F.when(F.col("score").isNotNull(), F.struct("run", "score")))), lambda x: x["score"])
    out = rows.groupBy("pair").agg(F.median("score").cast("double").alias("score"), scores.alias("scores"), F.round(F.avg("rate_"), 2).alias("quote_rate"))
    return out.where("score IS NOT NULL")


def merge(spark: SparkSession, judged: DataFrame, path: str) -> None:
    """Puts the pairs into the table at path, in place of their former rows."""
    tables.upsert(spark, judged, path, ["pair"])


def top_disagreements(scores: DataFrame, n: int) -> DataFrame:
    """(pair, error) of scores(pair, score, reference), a row a report: the n pairs with the largest mean error over the reports, ties by pair."""
    error = scores.where("score IS NOT NULL AND reference IS NOT NULL").groupBy("pair").agg(F.avg(F.abs(F.col("score") - F.col("reference"))).alias("error"))
    return error.orderBy(F.desc("error"), "pair").limit(n)


ARMS = (("match", "reference"), ("judge", "reference"), ("match", "judge"))


def three_ways(matches: DataFrame, judged: DataFrame, references: DataFrame) -> DataFrame:
    """(pair, reference, judge, match): every pair that an arm knows; match is the mean over the reports. Each of the tables: (pair, score)."""
    mean = matches.where("score IS NOT NULL").groupBy("pair").agg(F.avg("score").alias("match"))
    named = lambda df, name: df.select("pair", F.col("score").cast("double").alias(name))
    return named(references, "reference").join(named(judged, "judge"), "pair", "full").join(mean, "pair", "full")


def agreements(pairs: DataFrame) -> DataFrame:
    """(arms, n, mae, bias, within_10, pearson, tau_b) of three_ways: a row for each two arms over the pairs that both know; null figures below two pairs, and
    where an arm is constant."""
    both = F.array(*[F.struct(F.lit(f"{a} vs {b}").alias("arms"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in ARMS])
    rows = pairs.select(F.explode(both).alias("v")).select("v.*").where("x IS NOT NULL AND y IS NOT NULL")
    e = F.col("x") - F.col("y")
    enough = lambda c: F.when(F.count("*") >= 2, c)
    figures = rows.groupBy("arms").agg(F.count("*").alias("n"), enough(F.avg(F.abs(e))).alias("mae"), enough(F.avg(e)).alias("bias"), enough(F.avg((F.abs(e) <= 10).cast("double"))).alias("within_10"), F.when((F.count_distinct("x") > 1) & (F.count_distinct("y") > 1), F.corr("x", "y")).alias("pearson"))
    return figures.join(ranks.kendall_tau_b(rows, "arms"), "arms").select("arms", "n", "mae", "bias", "within_10", "pearson", F.when(F.col("pearson").isNotNull(), F.col("tau")).alias("tau_b"))


def agreement_picture(points: list[tuple[float, float]], others: list[tuple[float, float]], title: str, size: int = 480) -> str:
    """An SVG of scores against references from 0 to 100: points filled, the other arm's as rings, the diagonal, and a band of ten points to either side."""
    edge, inner = 48, size - 96
    at = lambda x, y: (edge + x / 100 * inner, size - edge - y / 100 * inner)
    line = lambda a, b, style: "<line x1='{:.1f}' y1='{:.1f}' x2='{:.1f}' y2='{:.1f}' {}/>".format(*at(*a), *at(*b), style)
    words = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")
    band = " ".join("{:.1f},{:.1f}".format(*at(x, y)) for x, y in ((0, 0), (0, 10), (90, 100), (100, 100), (100, 90), (10, 0)))
    parts = [f"<svg xmlns='http://www.w3.org/2000/svg' viewBox='0 0 {size} {size}' role='img'>", f"<title>{words(title)}</title>", f"<text x='{edge}' y='28' font-size='15'>{words(title)}</text>", f"<polygon points='{band}' fill='#dbe7f5'/>"]
    for tick in range(0, 101, 20):
        parts += [line((tick, 0), (tick, 100), "stroke='#ddd'"), line((0, tick), (100, tick), "stroke='#ddd'")]
        parts += ["<text x='{:.1f}' y='{:.1f}' font-size='10' text-anchor='middle'>{}</text>".format(at(tick, 0)[0], size - edge + 16, tick), "<text x='{:.1f}' y='{:.1f}' font-size='10' text-anchor='end'>{}</text>".format(edge - 6, at(0, tick)[1] + 3, tick)]
    parts.append(line((0, 0), (100, 100), "stroke='#888' stroke-dasharray='4 4'"))
    parts += ["<circle cx='{:.1f}' cy='{:.1f}' r='4' fill='none' stroke='#888'/>".format(*at(*p)) for p in others]
    parts += ["<circle cx='{:.1f}' cy='{:.1f}' r='4' fill='#2467b3'/>".format(*at(*p)) for p in points]
    mae = lambda ps: sum(abs(x - y) for x, y in ps) / len(ps) if ps else 0.0
    told = f"mean error {mae(points):.1f} over {len(points)} pairs" + (f", rings {mae(others):.1f} over {len(others)}" if others else "")
    parts.append(f"<text x='{edge}' y='{size - 10}' font-size='11'>reference across, score up; {told}</text>")
    return "\n".join([*parts, "</svg>"]) + "\n"
