"""The driver tables as the relations that the operators take.

``units``: group = number in ``source``, unit = ``doc_id``, text in a
vocalised view that puts letters for the normal forms to act on into the text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import leading_bare, ready_for_python

#: The view, character by character.
VIEW = {
    "a": 0x0623, "e": 0x0625, "i": 0x0649, "o": 0x0629, "u": 0x0624, "é": 0x064E, "è": 0x0650, "ê": 0x064F, "í": 0x0651, "ó": 0x0652, "ñ": 0x0670,
    "ç": 0x06D6, "ä": 0x06E5, "ö": 0x0640, "ü": 0x200C, "ß": 0x0653, ",": 0x06D7, ".": 0x064B, "n": 0x0646, "t": 0x062A, "r": 0x0631, "s": 0x0633,
}
VIEW_FROM, VIEW_TO = "".join(VIEW), "".join(map(chr, VIEW.values()))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocalised(text: Column) -> Column:
    return F.translate(text, VIEW_FROM, VIEW_TO)


def vocalise(word: str) -> str:
    return word.translate(str.maketrans(VIEW_FROM, VIEW_TO))


def skeleton(word: str) -> str:
    """The skeleton of a plain word in the view."""
    return re.sub(r"[\u06D6-\u06ED\u0610-\u061A\u064B-\u065F\u0670]", "", vocalise(word))


def units(spark: SparkSession, sf_dir: str, view: bool = True) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.substring("source", 4, 20).cast("bigint").alias("group_no"), F.col("source").alias("group_name"), F.col("doc_id").alias("unit_no"), (vocalised(text) if view else text).alias("text")
    )


#: Joined forms and a surface gate over words that the view has; the same rows go into the oracle.
LEXICON = tuple((skeleton(w), f"JOINED_{w.upper()}", d) for w, d in (("of", "o + f"), ("and", "a + n + d"), ("in", "i + n"), ("de", "d + e"), ("que", "q + u + e"), ("und", "u + nd"), ("to", "never + used")))
GATE = tuple((skeleton(w), vocalise(s), f"GATED_{w.upper()}", d, note) for w, s, d, note in (("to", "to.", "t + o", ""), ("is", "is,", "i + s", "CONTESTED"), ("is", "is.", "i + s + .", ""), ("la", "la.", "l + a", "")))


def opening_words(found: DataFrame) -> DataFrame:
    """Letters for each unit: its first one to three skeleton tokens put together, every seventh ones that no unit opens with; every fifth for a unit that isn't there."""
    ready_for_python(found.sparkSession)
    letters = F.when(F.col("unit_no") % 7 == 0, "zz").otherwise(F.array_join(leading_bare(F.col("text"), (1 + F.col("unit_no") % 3).cast("int")), ""))
    return found.select(F.col("group_no").alias("surah"), F.when(F.col("unit_no") % 5 == 4, -1 - F.col("unit_no")).otherwise(F.col("unit_no")).alias("ayah"), letters.alias("letters"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a stream of lines in which some become headers and formulas."""
    i, d, x = F.col("line_no"), F.col("doc"), F.col("x")
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "x"))
    line = (
        F.when((i == 0) & (d % 10 != 9), F.concat(F.lit("سورة "), F.left(x, F.lit(20))))
        .when((i == 1) & (d % 3 == 0), F.concat(F.lit("  بِسْمِ "), F.left(x, F.lit(30))))
        .when((i == 2) & (d % 6 == 0), F.concat(F.lit("بِسْمِ "), F.left(x, F.lit(25))))
        .when((i == 4) & (d % 2 == 0), F.concat(F.lit("سورة "), F.left(x, F.lit(70))))
        .otherwise(x)
    )
    return docs.select("doc", i.cast("bigint").alias("line_no"), line.alias("line"))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, body, n_expected: each line closed by its number, the last number of every fifth document left out."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.split(F.coalesce("text", F.lit("")), "\n").alias("x"))
    n = F.size("x")
    marked = F.transform("x", lambda s, i: F.when((F.col("doc") % 5 == 0) & (i == n - 1), s).otherwise(F.concat(s, F.lit(" ("), (i + 1).cast("string"), F.lit(")"))))
    return docs.select("doc", F.array_join(marked, " ").alias("body"), n.cast("bigint").alias("n_expected"))
