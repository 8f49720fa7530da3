"""Which texts hold which quotes: one scan of the texts against an automaton of all quotes.

The quotes are cut into parts of PART_CHARS characters; each part's automaton steps through every text once, whatever the number and the length
of its quotes, and a task builds it once. Nothing is joined before the scan and no text is shuffled.

Defined results: an empty quote stands in every text, null quotes and texts in none; equal quotes each have their rows; a quote that
stands in a text several times has one row; empty tables give an empty result.
"""

from __future__ import annotations

from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of the quotes of one automaton, some hundred bytes each; a longer quote has one of its own.
PART_CHARS = 1 << 20


def _parts(quotes: DataFrame) -> int:
    total = quotes.agg(F.sum(F.length("quote") + 1)).first()[0] or 0
    return -(-total // PART_CHARS)


def holders(quotes: DataFrame, texts: DataFrame, quote_id: str, text_id: str, quote_text: str = "text", text: str = "text") -> DataFrame:
    """(quote_id, text_id): a row for each quote and each text that holds it."""
    spark = texts.sparkSession
    said = quotes.select(F.col(quote_id).alias("q"), F.col(quote_text).cast("string").alias("quote")).where("quote IS NOT NULL")
    rows = texts.select(F.col(text_id).alias("t"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    kinds = [said.schema["q"].dataType, rows.schema["t"].dataType]
    schema = T.StructType([T.StructField(quote_id, kinds[0]), T.StructField(text_id, kinds[1])])

    def scan(part):
        def run(batches):
            texts_of, ids = part.value
            automaton = ahocorasick.Automaton()
            everywhere = []
            for i, quote in enumerate(texts_of):
                if quote:
                    automaton.add_word(quote, [*automaton.get(quote, []), i])
                else:
                    everywhere.append(i)
            automaton.make_automaton()
            find = automaton.iter if len(automaton) else lambda _: ()
            for b in batches:
                which, where = [], []
                for row, one in enumerate(b.column(1).to_pylist()):
                    found = {i for _, some in find(one) for i in some}
                    found.update(everywhere)
                    which += sorted(found)
                    where += [row] * len(found)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(which, pa.int64())), b.column(0).take(pa.array(where, pa.int64()))], names=[quote_id, text_id])

        return rows.mapInArrow(run, schema)

    found = []
    n = _parts(said)
    for k in range(n):
        table = said.where(F.pmod(F.xxhash64("q", "quote"), F.lit(n)) == k).toArrow()
        found.append(scan(spark.sparkContext.broadcast((table.column("quote").to_pylist(), table.column("q").combine_chunks()))))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def resolved(quotes: DataFrame, texts: DataFrame, quote_id: str, text_id: str) -> DataFrame:
    """(quote_id, text_id) of the quotes that exactly one text holds."""
    return holders(quotes, texts, quote_id, text_id).groupBy(quote_id).agg(F.min(text_id).alias(text_id), F.count("*").alias("n_")).where("n_ = 1").drop("n_")
