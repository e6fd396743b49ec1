"""Global row numbers without a single-task sort.

Spark deals the rows to ranges by splitters that it samples and sorts each
range; a row's number is its place there and the counts of the ranges before.
Where the splitters fall changes no number, as the order is total. Only the
sample and one count a range come to the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.folders import written

#: Rows of a range where the shuffle partitions aren't more.
ROWS = 2_000_000


def sort_keys(df: DataFrame, order: list[tuple[str, bool]]) -> list[Column]:
    """Columns that ascend in the order given; only whole numbers may descend."""
    keys = []
    for name, down in order:
        whole = isinstance(df.schema[name].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
        if down and not whole:
            raise ValueError(f"{name} can't descend")
        key = F.col(name).cast("bigint") if whole else F.col(name)
        keys.append(-key if down else key)
    return keys


def with_row_number(df: DataFrame, order: list[tuple[str, bool]], out: str, buckets: int | None = None, keep: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """``df`` with BIGINT ``out`` = 1..N in the order given, which must be total and without nulls; (column, descending).

    ``keep`` cuts the sorted rows; ``df`` is read three times: to count, to sample and to sort.
    """
    keys = sort_keys(df, order)
    rows = df.count()
    n = buckets or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-rows // ROWS))
    # Spark's own number of a row is its partition's times 2^33 and its place there
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    dealt = keep(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = {r["part"]: r["n"] for r in dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, run = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(run)
        run += counts.get(p, 0)
    offset = F.get(F.from_json(F.lit(json.dumps(before)), "array<bigint>"), part.cast("int"))
    return dealt.withColumn(out, F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1 + offset).drop("_at")
