"""Exact dedup by content sort [DataFrame functions only].

Sampled splitters range-partition the bytes of the texts, an external sort
places equals next to each other, and comparisons of neighbouring whole texts
form the groups; one row of each group stays.

The sort key is (leading bytes, 64-bit hash, whole text, identifier). The
splitters are taken on a key of bounded size, (leading bytes, hash,
identifier): because the identifier is part of it, a group of copies of any
size is cut over as many buckets as its share of the rows asks for, and no
bucket depends on how often a text repeats. Only groups that hold a splitter
can lie in two buckets. They are at most as many as there are splitters, so
their totals are pre-aggregated and broadcast; all other groups are whole
within their bucket.

Defined results: a null text equals the empty text; an empty table gives an
empty result; null identifiers order below all others, and a group of only
such keeps one of its rows with ``keep_id`` null; rows repeated with the same
identifier and text count in ``group_size`` and exactly one stays; other
columns, whatever their names, come back untouched in ``row``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LEADING = 24


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] | None = None,
    carry: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (and ``row``).

    ``keep`` is ``smallest`` or ``largest`` identifier; ``normalise`` maps the
    text column before it is compared (default: no change).
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    spark = df.sparkSession
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    text = normalise(text) if normalise else text
    base = df.select(
        df[id_col].alias("doc_id"),
        text.alias("t"),
        *([F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row")] if carry else []),
    )
    lead = F.substring(F.encode("t", "UTF-8"), 1, LEADING)
    base = base.withColumn("p", F.hex(lead)).withColumn("h", F.xxhash64("t"))
    # null identifiers take the least key
    order_id = F.coalesce(F.col("doc_id"), F.lit(-(2**63)).cast("long"))
    rows, size = base.select(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    parts = common.parts_for(spark, size)
    n = buckets or common.BUCKETS_PER_PARTITION * parts
    keys = base.select("p", "h", order_id.alias("i"))
    bounds = common.splitters(keys, rows, n, F.xxhash64("h", "i"))
    dealt = base.withColumn("bucket", common.bucket_of(bounds, [F.col("p"), F.col("h"), order_id], ["string", "bigint", "bigint"]))

    best = F.min if keep == "smallest" else F.max
    # an exchange on the bucket alone keeps a bucket whole; the sort is Spark's external one
    dealt = common.deal(dealt, "bucket", parts)
    same = Window.partitionBy("bucket", "p", "h", "t")
    first = same.orderBy(F.col("doc_id").asc_nulls_last() if keep == "smallest" else F.col("doc_id").desc_nulls_last())
    grouped = dealt.select(
        "*",
        F.count(F.lit(1)).over(same).alias("n_here"),
        best("doc_id").over(same).alias("best_here"),
        F.row_number().over(first).alias("rank_here"),
    ).withColumn("text_sha256", F.sha2(F.encode("t", "UTF-8"), 256))

    edges = sorted({(p, h) for p, h, _ in bounds})
    if edges:
        at_edge = F.col("h").isin([h for _, h in edges])
        # pre-aggregated on the map side: at most one row for each such text and task
        totals = (
            base.where(at_edge)
            .groupBy("t")
            .agg(F.count(F.lit(1)).alias("n_all"), best("doc_id").alias("best_all"))
            .select(F.sha2(F.encode("t", "UTF-8"), 256).alias("s"), "n_all", "best_all")
        )
        # as many texts as splitters at most (64-bit hashes of unequal texts may meet, hence the key)
        grouped = grouped.join(F.broadcast(totals), grouped.text_sha256 == totals.s, "left")
    else:
        grouped = grouped.select("*", F.lit(None).cast("string").alias("s"), F.lit(None).cast("long").alias("n_all"), F.lit(None).cast("long").alias("best_all"))
    keep_id = F.when(F.col("s").isNull(), F.col("best_here")).otherwise(F.col("best_all"))
    return grouped.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("n_all", "n_here").cast("long").alias("group_size"),
        ((F.col("rank_here") == 1) & F.col("doc_id").eqNullSafe(keep_id)).alias("kept"),
        "text_sha256",
        *(["row"] if carry else []),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.table(spark, sf_dir, "documents"), keep="largest")


QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLE_SQL = {
    "op4_exact_dedup": """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
}
