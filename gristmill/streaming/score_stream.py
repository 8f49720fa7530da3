"""Match Scores over a stream of signals: the batch expression on files as they arrive, and sums by time with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gristmill.operators.score import match_score

SIGNALS = "pair string, role_match double, experience_short double, blocker double, at timestamp"


def read_signals(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """A stream of the JSON lines that arrive in a folder."""
    return spark.readStream.schema(SIGNALS).option("maxFilesPerTrigger", files_at_once).json(path)


def score_stream(signals: DataFrame) -> DataFrame:
    """signals(pair, role_match, experience_short, blocker), batch or streaming, with `score`."""
    return signals.withColumn("score", match_score(F.col("role_match"), F.col("experience_short"), F.col("blocker")))


def score_windows(signals: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(begins, n, mean): scores by the time of their signals. Rows later than `late` are left out; a pair repeated within that time counts once."""
    scored = score_stream(signals).where("score IS NOT NULL").withWatermark("at", late)
    once = scored.dropDuplicatesWithinWatermark(["pair"]) if scored.isStreaming else scored.dropDuplicates(["pair"])
    return once.groupBy(F.window("at", length)).agg(F.count("*").alias("n"), F.avg("score").alias("mean")).select(F.col("window.start").alias("begins"), "n", "mean")


def write_scores(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived to Parquet, each row once: the checkpoint, in a folder that all machines share, remembers how far it came."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
