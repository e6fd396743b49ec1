"""Validation gate: violations as one relation, collected whole before anything stops.

Nothing is repaired. ``enforce`` evaluates the relation and raises
``GateFailed`` with every violation; call it before any sink.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import charclass as C
from ..sources.folders import shared_folder

MARKUP = f"[{C.DECIMAL}()A-Za-z]"
#: Violations that the exception names one by one.
NAMED = 10_000
CONTEXT_ROWS, CONTEXT_CHARS, LEAK_CHARS, LEAKS_SHOWN = 3, 120, 100, 5


class GateFailed(Exception):
    """All violations, in the order of their checks."""

    def __init__(self, failures: list[str]):
        self.failures = failures
        super().__init__("validation gate failed:\n" + "\n".join(failures))


def row(check: str, key: F.Column, detail: F.Column) -> list[F.Column]:
    return [F.lit(check).alias("check"), key.cast("string").alias("key"), detail.cast("string").alias("detail")]


def count_violations(units: DataFrame, expected: DataFrame) -> DataFrame:
    """Groups whose number of units is not ``expected(group_no, n_expected)``; a missing group counts 0."""
    got = units.groupBy("group_no").agg(F.count(F.lit(1)).alias("n"))
    rows = expected.withColumnRenamed("group_no", "g").join(got, F.col("g") == F.col("group_no"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.where(F.col("n") != F.col("n_expected")).select(F.col("g").alias("group_no"), "n", "n_expected")


def context_rows(units: DataFrame, wrong: DataFrame) -> DataFrame:
    """The last units, in order, of each group in ``wrong``."""
    last = F.row_number().over(Window.partitionBy("group_no").orderBy(F.desc("unit_no"), F.desc("text")))
    return units.join(wrong.select("group_no"), "group_no", "left_semi").withColumn("r", last).where(F.col("r") <= CONTEXT_ROWS)


def sequence_violations(units: DataFrame) -> DataFrame:
    """Groups whose unit numbers are not 1..N each once; no row order is assumed beyond them."""
    per = units.groupBy("group_no").agg(F.count(F.lit(1)).alias("n"), F.min("unit_no").alias("least"), F.max("unit_no").alias("most"), F.count_distinct("unit_no").alias("distinct_units"))
    return per.where((F.col("least") != 1) | (F.col("most") != F.col("n")) | (F.col("distinct_units") != F.col("n")))


def ordered_sequence_violations(units: DataFrame, order_col: str) -> DataFrame:
    """Groups whose units, in the order of ``order_col``, are not 1, 2, 3, ...: the list-order check."""
    place = F.row_number().over(Window.partitionBy("group_no").orderBy(order_col))
    return units.select("group_no", (place != F.col("unit_no")).alias("off")).groupBy("group_no").agg(F.count_if("off").alias("off")).where(F.col("off") > 0)


def sequence_gaps(numbers: DataFrame, column: str, limit: int = 5) -> DataFrame:
    """The first numbers of 1..N (N = rows) that do not occur."""
    n = numbers.count()
    spine = numbers.sparkSession.range(1, n + 1).withColumnRenamed("id", "gap")
    return spine.join(numbers.select(F.col(column).alias("v")), F.col("gap") == F.col("v"), "left_anti").orderBy("gap").limit(limit)


def failures(units: DataFrame, expected: DataFrame, n_groups: int, n_units: int, spots: tuple[tuple[int, int, str], ...] = ()) -> DataFrame:
    """``(check, key, detail)``: every violation of the gate."""
    totals = units.agg(F.count_distinct("group_no").alias("groups"), F.count(F.lit(1)).alias("units"))
    wrong = count_violations(units, expected)
    last = context_rows(units, wrong)
    leak = units.where(F.col("text").rlike(MARKUP))
    place = F.concat_ws(":", F.col("group_no").cast("string"), F.col("unit_no").cast("string"))
    parts = [
        totals.where(F.col("groups") != n_groups).select(*row("group count", F.lit(""), F.col("groups"))),
        totals.where(F.col("units") != n_units).select(*row("unit count", F.lit(""), F.col("units"))),
        wrong.select(*row("group units", F.col("group_no"), F.concat_ws(" != ", F.col("n").cast("string"), F.col("n_expected").cast("string")))),
        last.select(*row("last units", place, F.left("text", F.lit(CONTEXT_CHARS)))),
        sequence_violations(units).select(*row("unit sequence", F.col("group_no"), F.concat_ws(" ", F.col("n").cast("string"), F.col("least").cast("string"), F.col("most").cast("string"), F.col("distinct_units").cast("string")))),
        leak.orderBy("group_no", "unit_no").limit(LEAKS_SHOWN).select(*row("markup leak", place, F.left("text", F.lit(LEAK_CHARS)))),
        leak.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(*row("markup units", F.lit(""), F.col("n"))),
        units.where("text = ''").agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(*row("empty units", F.lit(""), F.col("n"))),
    ]
    if spots:
        asked = units.sparkSession.createDataFrame(list(spots), "group_no bigint, n_expected bigint, label string")
        spot = count_violations(units, asked.select("group_no", "n_expected")).join(F.broadcast(asked.select("group_no", "label")), "group_no")
        parts.append(spot.select(*row("spot check", F.col("label"), F.col("n"))))
    return reduce(lambda a, b: a.unionAll(b), parts)


def enforce(found: DataFrame) -> None:
    """Raises ``GateFailed`` if there is any violation.

    Beyond ``NAMED`` of them, all are written as Parquet to the shared folder,
    and the last line of the exception has their number and the path.
    """
    rows = found.orderBy("check", "key", "detail").limit(NAMED + 1).collect()
    if not rows:
        return
    named = [f"{r['check']} {r['key']}: {r['detail']}".strip() for r in rows[:NAMED]]
    if len(rows) > NAMED:
        spark = found.sparkSession
        path = shared_folder(spark, "gate-violations")
        found.write.parquet(path)
        named.append(f"{spark.read.parquet(path).count()} violations in all, written to {path}")
    raise GateFailed(named)


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """duplicate_rows (beyond the first of each key), duplicated_keys, rows_of_duplicated_keys."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"), F.count_if(F.col("n") > 1).alias("duplicated_keys"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_of_duplicated_keys"))
