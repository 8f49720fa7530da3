"""The other arm: one prompt a pair to a generative model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.runtime import generated
from gristmill.settings.config import Settings

PROMPT = "How well does the resume fit the job? Reply with JSON alone: score (whole number from 0 to 100), gaps and strengths (lists of short phrases).\n\nResume:\n{resume}\n\nJob:\n{posting}"
ITEMS, CHARS_PER_TOKEN = 8, 4


def parse_reply(reply: Column) -> tuple[Column, Column, Column, Column]:
    """(score, gaps, strengths, error) of the outermost braces; scores rounded and clamped to 0..100, lists cut to eight."""
    body = F.regexp_extract(reply, "(?s)\\{.*\\}", 0)
    parsed = F.from_json(body, "score string, gaps array<string>, strengths array<string>")
    said = parsed["score"].try_cast("double")
    score = F.when(said.isNotNull() & ~F.isnan(said), F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), said))).cast("int"))
    few = lambda c: F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, ITEMS)
    wrong = F.when(body == "", "no JSON object in the reply").when(score.isNull(), "no score in the reply")
    return score, few(parsed["gaps"]), few(parsed["strengths"]), wrong


def priced(rows: DataFrame, per_m_in: float, per_m_out: float) -> DataFrame:
    """rows(input_tokens, output_tokens, cost, prompt_chars) with input_tokens, input_estimated, cost and cost_estimated.

    Below a quarter of the estimate by length the estimate stands; a cost that the provider reports stays; without prices there is none.
    """
    estimate = F.floor(F.col("prompt_chars") / CHARS_PER_TOKEN)
    low = F.coalesce(F.col("input_tokens"), F.lit(0)) < F.floor(estimate / 4)
    rows = rows.withColumn("input_estimated", low).withColumn("input_tokens", F.when(low, estimate).otherwise(F.col("input_tokens")))
    price = (F.col("input_tokens") * per_m_in + F.col("output_tokens") * per_m_out) / 1e6 if per_m_in > 0 or per_m_out > 0 else F.lit(None).cast("double")
    return rows.withColumn("cost_estimated", F.col("cost").isNull() & price.isNotNull()).withColumn("cost", F.coalesce("cost", price))


def score(pairs: DataFrame, settings: Settings, per_m_in: float = 0.0, per_m_out: float = 0.0) -> DataFrame:
    """(pair_id, score, gaps, strengths, input_tokens, output_tokens, cost, ..., error) of pairs(pair_id, posting, resume); failures stay in the row."""
    head, tail = PROMPT.split("{resume}")
    middle, _ = tail.split("{posting}")
    rows = pairs.select("pair_id", F.concat(F.lit(head), "resume", F.lit(middle), "posting").alias("prompt_"))
    said = generated(rows, "pair_id", "", "prompt_", settings).join(rows.select("pair_id", F.length("prompt_").alias("prompt_chars")), "pair_id")
    value, gaps, strengths, wrong = parse_reply(F.coalesce("said", F.lit("")))
    out = said.withColumn("score", value).withColumn("gaps", gaps).withColumn("strengths", strengths).withColumn("error", F.coalesce("error", wrong))
    return priced(out, per_m_in, per_m_out).drop("said")


def totals(rows: DataFrame) -> DataFrame:
    """One row over rows(pair_id, want, got, score, cost, input_tokens, output_tokens, error): mean and largest error and bias of both arms, tokens, known costs."""
    ran = F.count("*")
    good = F.when(F.coalesce("error", F.lit("")) == "", F.col("score"))
    gap, mine = good - F.col("want"), F.col("got") - F.col("want")
    known = F.count("cost")
    return rows.agg(
        ran.alias("baseline_ran"), F.count(F.when(F.coalesce("error", F.lit("")) != "", 1)).alias("baseline_failed"), F.avg(F.abs(gap)).alias("baseline_error"), F.max(F.abs(gap)).alias("baseline_error_max"), F.avg(gap).alias("baseline_bias"),
        F.avg(F.abs(mine)).alias("fit_error"), F.max(F.abs(mine)).alias("fit_error_max"), F.avg(mine).alias("fit_bias"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.try_divide(F.sum("cost"), known).alias("baseline_cost"),
    ).where("baseline_ran > 0")
