"""Code-point inventory of all texts.

A task counts the code points of its texts in Arrow batches, as an array
indexed by code point, and hands on one row for each that it met.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import CODEPOINTS, codepoints, ready_for_python, strings
from ..functions.shipping import ship
from ..functions.text import codepoint, codepoint_label, display

UNNAMED = "<no Unicode name assigned>"


@F.pandas_udf(T.StructType([T.StructField("name", T.StringType()), T.StructField("category", T.StringType())]))
def unicode_facts(cp: pd.Series) -> pd.DataFrame:
    chars = [chr(x) for x in cp]
    return pd.DataFrame({"name": [unicodedata.name(c, UNNAMED) for c in chars], "category": [unicodedata.category(c) for c in chars]})


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The characters of a task's texts and how often they occur."""
    total = np.zeros(CODEPOINTS, np.int64)
    for batch in batches:
        found = np.bincount(codepoints("".join(x for x in strings(batch.column(0)) if x)))
        total[: len(found)] += found
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array([chr(x) for x in seen], pa.string()), pa.array(total[seen])], ["c", "n"])


def codepoint_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """codepoint, decimal, char, count."""
    ready_for_python(texts.sparkSession)
    chars = texts.select(F.col(text_col)).mapInArrow(counted, "c string, n bigint")
    counts = chars.groupBy("c").agg(F.sum("n").alias("count")).withColumn("decimal", codepoint(F.col("c")))
    return counts.select(codepoint_label(F.col("decimal")).alias("codepoint"), "decimal", display(F.col("c"), F.col("decimal")).alias("char"), "count")


def codepoint_inventory(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """The counts with official names and categories: looked up once a distinct character."""
    ship(texts.sparkSession)
    counts = codepoint_counts(texts, text_col).withColumn("facts", unicode_facts("decimal"))
    return counts.select("codepoint", "decimal", "char", F.col("facts.name").alias("unicode_name"), F.col("facts.category").alias("category"), "count")


def watched(counts: DataFrame, codepoints: tuple[int, ...]) -> DataFrame:
    """decimal, count of given code points; 0 where absent."""
    asked = counts.sparkSession.createDataFrame([(c,) for c in codepoints], "cp bigint")
    return F.broadcast(asked).join(counts, F.col("cp") == counts.decimal, "left").select(codepoint_label(F.col("cp")).alias("codepoint"), F.coalesce("count", F.lit(0)).alias("count"))
