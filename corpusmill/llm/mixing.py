"""Mixing sources to target weights by hash-threshold histograms.

Each source gets a share of a token budget by its weight, capped at
``max_repeats`` times its size, the excess reshared by weight until no source
is above its cap. A source takes every document ``floor(target / size)`` times
and the rest of its target by a hash threshold: documents whose hash lies
under it are taken once more. The threshold comes from nested histograms:
tokens by source and the leading 12 bits of the hash, then only the bucket
that holds the budget by the next 12 bits, then that bucket's single hashes.
Nothing is sorted but histograms of fixed size, and the documents are filtered
where they lie.

Defined results: null text has size 0; null source is a source of its own,
ordered last; a source of size 0 has target 0; an empty table gives an empty
result; rows repeated with one identifier share a hash and are taken alike;
null identifiers hash as the empty string; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranges import with_row_number
from . import common

#: Bits of the hash, and of one histogram level.
HASH_BITS, LEVEL_BITS = 60, 12
#: Sources up to which the threshold table (under 100 bytes a row) is broadcast, and ranked in one task.
BROADCAST_SOURCES = 50_000


def n_words(text: Column) -> Column:
    """Runs of non-white-space, counted without an array: a run starts after a space or at the start."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def unit_hash(ident: Column) -> Column:
    """60 bits of md5 of the identifier as text."""
    digest = F.md5(F.coalesce(ident.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, n: int, weights: tuple[float, ...], budget: float, max_repeats: float) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one small row for each of ``n`` sources; cut.

    The level ``lam`` solves sum(min(cap, lam * weight)) = budget: it starts at
    an even share of all weights, and what the sources above their caps leave
    is reshared among the others until none is above. Each step is one
    aggregate over the sources, and only its sums come to the driver.
    """
    if n <= BROADCAST_SOURCES:
        ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    else:
        ranked = with_row_number(sizes.where("source is not null"), [("source", False)], "rank")
        ranked = ranked.unionByName(sizes.where("source is null").withColumn("rank", F.lit(n).cast("long")))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = common.cut(ranked.select("source", "source_size", w.alias("w"), (F.col("source_size") * F.lit(float(max_repeats))).alias("cap")))
    whole = ranked.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    goal = float(budget) * float(whole["size"] or 0)
    lam = goal / whole.w if whole.w else 0.0
    while True:
        above = F.col("cap") <= F.lit(lam) * F.col("w")
        r = ranked.agg(F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)).alias("full"), F.coalesce(F.sum(F.when(~above, F.col("w"))), F.lit(0.0)).alias("open")).first()
        more = (goal - r.full) / r.open if r.open else float("inf")
        if more <= lam or r.open == 0:
            break
        lam = more
    target = F.when(above, F.col("cap")).otherwise(F.lit(lam) * F.col("w"))
    return ranked.select("source", "source_size", target.alias("target"))


def thresholds(light: DataFrame, weights: tuple[float, ...], budget: float, max_repeats: float) -> tuple[DataFrame, int]:
    """``(source, source_size, target, repeats, threshold)`` and how many sources there are.

    ``light`` has (source, size, u) and should be cut: it is read once a level.
    """
    sizes = common.cut(light.groupBy("source").agg(F.sum("size").alias("source_size")))
    n_sources = sizes.count()
    targets = source_targets(sizes, n_sources, weights, budget, max_repeats)
    q = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = targets.select("source", "source_size", "target", q.alias("repeats")).withColumn("rest", F.col("target") - F.col("repeats") * F.col("source_size"))

    # open(source, prefix, base): the one bucket of each source that holds the rest of its budget
    opened = goal.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("base"))
    for level in (1, 2):
        shift = HASH_BITS - LEVEL_BITS * level
        o = common.small_or_not(opened.select(F.col("source").alias("s"), "rest", "prefix", "base"), n_sources, BROADCAST_SOURCES)
        inside = light.join(o, light.source.eqNullSafe(o.s) & (F.shiftright(light.u, shift + LEVEL_BITS) == o.prefix) & (o.rest > 0))
        hist = inside.groupBy("source", "rest", "base", F.shiftright("u", shift).alias("b")).agg(F.sum("size").alias("tokens"))
        run = Window.partitionBy("source").orderBy("b")
        cum = hist.withColumn("after", F.col("base") + F.sum("tokens").over(run)).withColumn("before", F.col("after") - F.col("tokens"))
        opened = common.cut(cum.where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("after"))).select("source", "rest", F.col("b").alias("prefix"), F.col("before").alias("base")))
    o = common.small_or_not(opened.select(F.col("source").alias("s"), "rest", "prefix", "base"), n_sources, BROADCAST_SOURCES)
    inside = light.join(o, light.source.eqNullSafe(o.s) & (F.shiftright(light.u, shift) == o.prefix))
    single = inside.groupBy("source", "rest", "base", "prefix", "u").agg(F.sum("size").alias("tokens"))
    run = Window.partitionBy("source").orderBy("u")
    cum = single.withColumn("after", F.col("base") + F.sum("tokens").over(run)).withColumn("before", F.col("after") - F.col("tokens"))
    # a hash is taken if that brings the source nearer to its target
    nearer = F.when(F.col("before") + F.col("after") < 2 * F.col("rest"), F.col("u"))
    least = F.shiftleft(F.col("prefix"), shift) - 1
    last = cum.groupBy("source").agg(F.coalesce(F.max(nearer), F.min(least)).alias("thr")).select(F.col("source").alias("s"), "thr")
    out = goal.join(common.small_or_not(last, n_sources, BROADCAST_SOURCES), goal.source.eqNullSafe(last.s), "left")
    # a source with no bucket above (rest 0) takes none beyond its repeats
    return common.cut(out.select("source", "source_size", "target", "repeats", F.coalesce("thr", F.lit(-1)).alias("threshold"))), n_sources


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    budget: float = 1.5,
    max_repeats: float = 2,
    carry: bool = False,
) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken (and ``row``), one row per input row.

    ``budget`` is a multiple of all sizes; ``copies`` says how often the whole
    document enters the mix.
    """
    light = df.select(df[source_col].cast("string").alias("source"), n_words(df[text_col]).alias("size"), unit_hash(df[id_col]).alias("u"), df[id_col].alias("doc_id"))
    light = common.cut(light)
    plan, n_sources = thresholds(light.select("source", "size", "u"), weights, budget, max_repeats)
    plan = common.small_or_not(plan.withColumnRenamed("source", "s"), n_sources, BROADCAST_SOURCES)
    rows = light
    if carry:
        rows = df.select(df[source_col].cast("string").alias("source"), n_words(df[text_col]).alias("size"), unit_hash(df[id_col]).alias("u"), df[id_col].alias("doc_id"), F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"))
    copies = F.col("repeats") + (F.col("u") <= F.col("threshold")).cast("long")
    return rows.join(plan, rows.source.eqNullSafe(plan.s), "left").select(
        "doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(["row"] if carry else [])
    )


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op6_source_mixing": op6_source_mixing}
ORACLE_SQL = {
    "op6_source_mixing": r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w,
         CAST(source_size AS DOUBLE) * 2 AS cap
  FROM s
), l AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam
  FROM r
), t AS (
  SELECT source, source_size,
         least(cap, w * (SELECT min_by(lam, cap / w) FROM l WHERE lam <= cap / w)) AS target
  FROM l
), g AS (
  SELECT source, source_size, target,
         CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS repeats
  FROM t
), h AS (
  SELECT source, u, sum(size) AS tokens, sum(sum(size)) OVER (PARTITION BY source ORDER BY u) AS after FROM d GROUP BY source, u
), k AS (
  SELECT h.source, h.u, CAST(after + after - tokens < 2 * (target - repeats * source_size) AS BIGINT) AS once_more
  FROM h JOIN g ON h.source IS NOT DISTINCT FROM g.source
)
SELECT d.doc_id, d.size, g.source_size, g.target,
       d.size * (g.repeats + k.once_more) AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
JOIN k ON k.source IS NOT DISTINCT FROM d.source AND k.u = d.u
"""
}
