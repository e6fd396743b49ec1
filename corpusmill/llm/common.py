"""Pieces that several training-data operators share.

Everything here is declarative except :func:`splitters`, which brings a
bounded sample of sort keys to the driver, as any range partitioner does.
"""

from __future__ import annotations

import gc
import json
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import ready_for_python  # noqa: F401
from ..sources.folders import delete, written  # noqa: F401

#: Keys that a range split samples for each of its buckets, and buckets for each partition: several
#: small buckets fill a partition more evenly than one.
SAMPLES_PER_BUCKET, BUCKETS_PER_PARTITION = 16, 4
#: Bytes of text that a partition of a content sort holds.
PART_BYTES = 256 << 20
#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Cuts between two releases of what they no longer need.
CUTS = 6
_cuts = count()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut: reads survive lost executors."""
    out = written(df)
    if next(_cuts) % CUTS == CUTS - 1:
        release(df.sparkSession)
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffles and checkpoints that nothing refers to any more.

    So disk is bounded by a few steps, and so is the driver's memory, which holds plans and broadcasts as long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def hashed_under(hashed: Column, share: float) -> Column:
    """Whether a 64-bit hash is among the least so share of all: the same rows in reruns, fine enough for any size of input."""
    return F.pmod(hashed, F.lit(1 << 60)) < F.lit(min(1 << 60, max(1, round(share * (1 << 60)))))


def least_hashes(rows: DataFrame, by: str, ident: Column, counts: dict, each: int) -> DataFrame:
    """About three times the ``each`` rows of each value of ``by`` with the least hashes of ``ident``.

    ``counts`` has the rows of each value. The threshold is applied where the
    rows lie, so what is shuffled to rank them is bounded at any size of input.
    """
    unit = F.pmod(F.xxhash64(ident), F.lit(1 << 52)).cast("double") / float(1 << 52)
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(by) == F.lit(value), F.lit(min(1.0, 3.0 * each / max(1, n)))).otherwise(share)
    return rows.where(unit < share).withColumn("_unit", unit)


def parts_for(spark: SparkSession, n_bytes: int) -> int:
    """Partitions for so many bytes: those that the session asks for, more where they would be too large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-n_bytes // PART_BYTES))


def deal(df: DataFrame, bucket: str, parts: int) -> DataFrame:
    """``df`` with each bucket whole in one partition."""
    return df.repartition(parts, bucket)


def splitters(keys: DataFrame, n_rows: int, n: int, salt: Column) -> list[tuple]:
    """At most ``n - 1`` sampled splitters of the rows of ``keys``, ascending.

    ``salt`` is a 64-bit hash of what identifies a row: the sample is the rows
    whose hash falls under a threshold, so a rerun takes the same rows. About
    ``SAMPLES_PER_BUCKET * n`` keys reach the driver at any size of input.
    """
    if n_rows <= 0 or n <= 1:
        return []
    share = min(1.0, SAMPLES_PER_BUCKET * n / n_rows)
    if share < 1.0:
        keys = keys.where(hashed_under(salt, share))
    rows = sorted(tuple(r) for r in keys.collect())
    picks = [rows[len(rows) * i // n] for i in range(1, n)] if rows else []
    return sorted(set(picks))


def bucket_of(bounds: list[tuple], columns: list[Column], types: list[str]) -> Column:
    """Number of splitters not above the row's key: a binary search in one literal array.

    The expression has the same size for any number of splitters.
    """
    if not bounds:
        return F.lit(0)
    names = [f"c{i}" for i in range(len(types))]
    rows = json.dumps([dict(zip(names, b)) for b in bounds])
    table = F.from_json(F.lit(rows), "array<struct<" + ",".join(f"{n}:{t}" for n, t in zip(names, types)) + ">>")
    key = F.struct(*[c.cast(t).alias(n) for c, t, n in zip(columns, types, names)])

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        above = F.when(key >= F.get(table, mid), F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))
        return F.when(s["lo"] < s["hi"], above).otherwise(s)

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    return F.aggregate(steps, start, halve, lambda s: s["lo"])


def small_or_not(df: DataFrame, rows: int, most: int) -> DataFrame:
    """A broadcast hint only for a relation whose counted rows are within ``most``."""
    return F.broadcast(df) if rows <= most else df


#: A key with more than this share of the rows, and so many at least, is hot.
HOT_SHARE, LEAST_HOT = 1 / 2000, 200


def join_hot(rows: DataFrame, values: DataFrame, key: str, n_col: str, value_col: str, keep_all: bool = False) -> DataFrame:
    """``rows`` with ``value_col`` of ``values``, which has one row for each ``key`` and how many rows have it.

    Rows of hot keys meet a broadcast, of 1 / ``HOT_SHARE`` rows at most
    whatever the input; the others an equi-join in which no key is large.
    ``keep_all``: rows without a value keep a null; they too must not share a key
    too often, as all keys without a value are dealt alike.
    """
    many = max(LEAST_HOT, HOT_SHARE * rows.count())
    hot = F.broadcast(values.where(F.col(n_col) > many).select(F.col(key).alias("_hot"), F.col(value_col).alias("_value")))
    marked = rows.join(hot, F.col(key) == F.col("_hot"), "left")
    done = marked.where(F.col("_hot").isNotNull()).select(*rows.columns, F.col("_value").alias(value_col))
    rest = marked.where(F.col("_hot").isNull()).select(*rows.columns)
    cold = values.where(F.col(n_col) <= many).select(key, value_col)
    return done.unionAll(rest.join(cold, key, "left" if keep_all else "inner").select(*rows.columns, value_col))


def unsigned_hex(value: Column, digits: int = 16) -> Column:
    return F.lower(F.lpad(F.hex(value), digits, "0"))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for all nodes of ``edges(a, b)``; root is the least node reachable.

    Alternating large-star and small-star rounds: each is one aggregation and
    one equi-join, its result is cut to the shared folder, and no component or
    link comes to the driver. A round in which no link changes ends it.
    """
    spark = edges.sparkSession

    def star(links: DataFrame, large: bool, n_links: int, degree: int) -> DataFrame:
        if large:
            both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"), "n")
        # small plans and no broadcasts unless there is a hub: each build would hold driver memory
        many = max(LEAST_HOT, HOT_SHARE * n_links)
        if degree <= many:
            joined = both.join(least.hint("merge"), both.a == least.u)
        else:
            # the hub of a large component holds most links: hubs, 2 / HOT_SHARE at most, are broadcast
            least = cut(least)
            hot = F.broadcast(least.where(F.col("n") > many).select("u", "m"))
            rest = least.where(F.col("n") <= many).select("u", "m").hint("merge")
            joined = both.join(hot, both.a == hot.u).unionAll(both.join(hot, both.a == hot.u, "left_anti").join(rest, F.col("a") == F.col("u")))
        if large:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return cut(out.where(F.col("a") != F.col("b")).distinct())

    def mark(links: DataFrame) -> tuple:
        """(how many links, a hash of all, the most that one node has)."""
        ends = F.array(F.struct(F.col("a").alias("node"), F.xxhash64("a", "b").alias("x")), F.struct(F.col("b").alias("node"), F.lit(0).cast("long").alias("x")))
        by = links.select(F.inline(ends)).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("x").alias("x"))
        return tuple(by.agg(F.coalesce(F.sum("n"), F.lit(0)), F.bit_xor("x"), F.max("n")).first())

    links = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(links)
    if seen[0] == 0:
        return spark.createDataFrame([], T.StructType([T.StructField("node", edges.schema["a"].dataType), T.StructField("root", edges.schema["a"].dataType)]))
    for _ in range(rounds):
        links = star(links, True, seen[0], seen[2])
        links = star(links, False, seen[0], seen[2])
        now = mark(links)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
