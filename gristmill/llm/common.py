"""What the corpus operators share: tables, shared storage, parallelism, held-out folds."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's own setting: whoever sizes the cluster sizes this."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of a batch of rows between Spark and a Python worker. Under Spark's own limits (10,000 rows, 64 MB) documents came in batches of 34 MB.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python in batches of BATCH_BYTES at most; a lower limit of its own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).removesuffix("b"))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder named in spark.checkpoint.dir, which all machines must share; a temporary one where none is named and all run on this machine."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="gristmill-checkpoint-"))


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors reach."""
    ensure_checkpoint_dir(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it from there; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(name: str, taken: list[str]) -> str:
    """The name, with underscores added as long as a column has it."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for the fold that no model may learn from: crc32 of the id's text, modulo 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0


def chunks_by_bytes(texts: list, limit: int = 1 << 21):
    """Index ranges of texts whose total length stays near the limit; one long text stands alone."""
    yield from chunks_by_size((len(t) if t else 0 for t in texts), limit)


def chunks_by_size(sizes, limit: int):
    """Index ranges of sizes whose sum stays near the limit; one large size stands alone."""
    start = total = end = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
        end = i + 1
    if end > start:
        yield start, end
