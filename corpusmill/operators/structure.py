"""Lines to blocks to units.

``lines(doc, line_no, line)`` is one ordered stream for each document. Headers
open blocks (a running count within the document), opening formulas and body
lines belong to the block they follow, and numbered markers ``(n)`` cut a body
into units, the text before a marker being unit n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import charclass as C
from ..functions.forms import no_tashkeel
from ..functions.text import has_digit, strip, to_int
from ..plans import fixed_tables as T

MARKER = rf"\(([{C.DECIMAL}]+)\)"
HEADER_LENGTH, FORMULA_LENGTH, SHOWN = 60, 45, 80


def paragraphs_to_lines(paragraphs: DataFrame) -> DataFrame:
    """``(doc, line_no, line)`` from ``(doc, line_no, line)`` paragraphs: a line end inside one makes two."""
    parts = paragraphs.select("doc", "line_no", F.posexplode(F.split("line", "\n")).alias("part", "line"))
    order = Window.partitionBy("doc").orderBy("line_no", "part")
    return parts.select("doc", (F.row_number().over(order) - 1).cast("bigint").alias("line_no"), "line")


def classify(lines: DataFrame) -> DataFrame:
    """Adds stripped ``line``, ``kind`` (blank, header, unclassified, formula, body) and ``block_no``."""
    rows = lines.select("doc", "line_no", strip(F.col("line")).alias("line"))
    size = F.length("line")
    # longer lines are neither header nor formula: null is as good as false beside the length, and spares them the search
    short = F.when(size < HEADER_LENGTH, F.col("line"))
    bare, digit = no_tashkeel(short), has_digit(short)
    header = bare.startswith(T.HEADER_WORD) & (size < HEADER_LENGTH) & ~digit
    formula = ~digit & (size <= FORMULA_LENGTH) & bare.startswith(T.FORMULA_WORD)
    block = F.sum(header.cast("bigint")).over(Window.partitionBy("doc").orderBy("line_no"))
    rows = rows.select("*", header.alias("h"), formula.alias("f"), block.alias("block_no"))
    kind = F.when(F.col("line") == "", "blank").when(F.col("h"), "header").when(F.col("block_no") == 0, "unclassified").when(F.col("f"), "formula").otherwise("body")
    return rows.select("doc", "line_no", "line", kind.alias("kind"), "block_no")


def unclassified(classified: DataFrame) -> DataFrame:
    return classified.where("kind = 'unclassified'").select("doc", "line_no", F.left("line", F.lit(SHOWN)).alias("shown"))


def suffixed_headers(classified: DataFrame) -> DataFrame:
    """Header lines from which a title suffix is cut."""
    return classified.where((F.col("kind") == "header") & F.col("line").endswith(T.TITLE_SUFFIX)).select("doc", "line_no", "line")


def header_name(header: Column) -> Column:
    cut = F.when(header.endswith(T.TITLE_SUFFIX), strip(F.expr("left(header_raw, length(header_raw) - %d)" % len(T.TITLE_SUFFIX)))).otherwise(header)
    return strip(F.substring(cut, F.lit(len(T.HEADER_WORD) + 1), F.length(header)))


def blocks(classified: DataFrame) -> DataFrame:
    """doc, block_no, name, header_raw, formula (null if none; the last one wins), body."""
    rows = classified.where("kind in ('header', 'formula', 'body')")
    body = F.array_sort(F.collect_list(F.when(F.col("kind") == "body", F.struct("line_no", "line"))))
    one = rows.groupBy("doc", "block_no").agg(
        F.max(F.when(F.col("kind") == "header", F.col("line"))).alias("header_raw"),
        F.max_by(F.when(F.col("kind") == "formula", F.col("line")), F.when(F.col("kind") == "formula", F.col("line_no"))).alias("formula"),
        F.array_join(F.transform(body, lambda x: x["line"]), " ").alias("body"),
    )
    return one.select("doc", "block_no", header_name(F.col("header_raw")).alias("name"), "header_raw", "formula", "body")


def structural(found: DataFrame) -> DataFrame:
    return found.select("doc", "block_no", "name", "header_raw", F.col("formula").isNotNull().alias("basmalah_present"), F.coalesce("formula", F.lit("")).alias("basmalah_text_raw"))


def segment(bodies: DataFrame, keys: list[str]) -> DataFrame:
    """One row a unit: keys, unit_no, text, seq (order in the body), inferred.

    Text after the last marker becomes the unit after it, ``inferred``.
    """
    parts = F.split("body", MARKER)
    numbers = F.regexp_extract_all(F.col("body"), F.lit(MARKER), F.lit(1))
    # both arrays hang on one row, so pairing them needs no join; a unit carries its own number and the last one only
    rows = bodies.select(*keys, parts.alias("parts"), numbers.alias("numbers"))
    last = F.coalesce(to_int(F.get("numbers", F.size("numbers") - 1)), F.lit(0))
    rows = rows.select(*keys, last.alias("last"), F.posexplode(F.arrays_zip("parts", "numbers")).alias("seq", "unit"))
    rows = rows.select(*keys, "seq", strip(F.col("unit.parts")).alias("text"), F.col("unit.numbers").alias("number"), "last")
    inferred = F.col("number").isNull()
    unit = F.when(inferred, F.col("last") + 1).otherwise(to_int(F.col("number")))
    return rows.where(~inferred | (F.col("text") != "")).select(*keys, unit.alias("unit_no"), "text", F.col("seq").cast("bigint").alias("seq"), inferred.alias("inferred"))


def trailing_audit(segments: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each inferred unit, against ``expected(keys, n_expected)``."""
    rows = segments.where("inferred").join(expected, keys, "left")
    return rows.select(*keys, F.lit(T.TRAILING_RULE).alias("rule"), F.col("unit_no").alias("inferred_ayah_number"), F.col("n_expected").alias("expected_final_ayah"), (F.col("unit_no") == F.col("n_expected")).alias("boundary_matches"), F.col("text").alias("text_raw"))


def formula_census(found: DataFrame, key: str, groups: DataFrame, expected_missing: tuple[int, ...]) -> DataFrame:
    """Groups (of ``groups(key)``) without a formula; ``anomalous`` if not expected to lack one."""
    have = found.where("basmalah_present").select(key).distinct()
    return groups.select(key).join(have, key, "left_anti").select(key, (~F.col(key).isin(*expected_missing)).alias("anomalous"))
