"""Running token counts over a stream of units.

Only counts and first places per token keep bounded state (one row a token);
global numbers and exact distinct-group counts would need the whole stream, so
they stay with the batch operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import tokens
from ..operators.frequency import place, place_reference

UNIT_SCHEMA = "group_no bigint, group_name string, unit_no bigint, text string"


def read_units(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the Parquet files that arrive in ``folder``."""
    return spark.readStream.schema(UNIT_SCHEMA).parquet(folder)


def running_counts(units: DataFrame) -> DataFrame:
    """word, count, first_occurrence so far."""
    rows = units.select(place(F.col("group_no"), F.col("unit_no")).alias("ord"), F.explode(tokens(F.col("text"))).alias("word"))
    counts = rows.groupBy("word").agg(F.count(F.lit(1)).alias("count"), F.min("ord").alias("first"))
    return counts.select("word", "count", place_reference(F.col("first")).alias("first_occurrence"))


def start(counts: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Complete-mode query into the in-memory table ``name``; ends when all files that are there are read."""
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
