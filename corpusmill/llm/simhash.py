"""SimHash near-dedup by deletion-variant signatures.

A 64-bit SimHash is cut into two segments of 32 bits. Of two fingerprints
that differ in at most two bits, one segment differs in at most one bit, so
both hold the same variant of it with one bit deleted. All 64 one-wildcard
variants of each distinct fingerprint are indexed, equal variants joined and
the pairs verified by their Hamming distance.

Copies never multiply: only distinct fingerprints are indexed, whatever the
number of their documents. A variant shared by more than ``BUCKET`` distinct
fingerprints is not joined with itself, and one that many share, as a sample of
fingerprints shows, isn't even gathered. Their fingerprints go by an exact way of
bounded groups instead: each is put to the 65 points of its radius-one ball,
and those that meet in a point are linked to the least of them. Two
fingerprints differ in at most two bits exactly if their balls meet, and no
more than 65 can meet in a point.

Links become classes by alternating star rounds; see
:func:`corpusmill.llm.common.connected_components`.

Defined results: null and empty texts, and texts without words, have
fingerprint zero and are linked like any other; fewer words than a shingle
make one shingle of all words; repeated shingles count as often as they
occur; repeated rows come back once each; a null identifier never is the
least unless a class has no other; empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Distinct fingerprints up to which a variant's pairs are compared directly.
BUCKET = 12
#: Fingerprints sampled to find variants that many share; of them, so many make one hot.
SAMPLED, SHARED = 2_000, 8
#: Shingles whose bits are counted at once.
BLOCK = 8_160


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How often each bit is set in rows of unsigned longs (n, words): (64 * words) counts.

    Runs of 255 rows are added up in single bytes.
    """
    counts = np.zeros(64 * hashes.shape[1], np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = np.ascontiguousarray(hashes[i : i + BLOCK], "<u8")
        bits = np.unpackbits(part.view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduceat(bits, np.arange(0, len(part), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return counts


def simhash(text: str | None, width: int = 3) -> int:
    """Signed 64-bit SimHash of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        digest = xxhash.xxh64_intdigest
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        first = [0, *ends[:-width].tolist()]
        hashes = [digest(joined[a:b], 42) for a, b in zip(first, (ends[width - 1 :] - 1).tolist())]
    counts = bit_sums(np.array(hashes, np.uint64).reshape(-1, 1))
    over = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(over.view("<i8")[0])


def fingerprint_udf(width: int):
    @F.pandas_udf("long")
    def fingerprint(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([simhash(t, width) for t in texts], dtype="int64")

    return fingerprint


def fingerprint_links(distinct: DataFrame, max_distance: int = 2) -> DataFrame:
    """``(a, b)`` links between distinct fingerprints ``fp`` that join all within ``max_distance`` bits.

    Classes of the links are the classes of all close pairs; of a crowded
    variant, pairs may be linked through a common neighbour instead.
    """
    if max_distance not in (1, 2):
        raise ValueError("two segments and radius-one balls serve distances 1 and 2")
    # variant number v in 0..63: segment v / 32, bit v % 32 deleted (here: cleared)
    seg = F.when(F.col("v") < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    bit = F.expr("shiftleft(1L, cast(v % 32 as int))")
    variant = F.shiftleft(F.col("v").cast("long"), 32).bitwiseOR(seg.bitwiseAND(F.bitwise_not(bit)))

    def variants(prints: DataFrame) -> DataFrame:
        return prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v")).select("fp", variant.alias("k"))

    some = distinct.where(common.hashed_under(F.xxhash64("fp"), SAMPLED / max(1, distinct.count())))
    # 64 * SAMPLED / SHARED keys at most
    hot = common.cut(variants(some).groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SHARED).select("k"))
    index = variants(distinct)
    met = index.join(F.broadcast(hot), "k", "left_anti").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k"))).where(F.col("n") > 1)
    met = common.cut(met)
    few = met.where(F.col("n") <= BUCKET).select("k", "fp")
    x, y = few.select("k", F.col("fp").alias("a")), few.select("k", F.col("fp").alias("b"))
    pairs = x.join(y, "k").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)).select("a", "b")

    crowded = met.where(F.col("n") > BUCKET).select("fp").unionAll(index.join(F.broadcast(hot), "k", "left_semi").select("fp")).distinct()
    if max_distance == 1:
        # whole-fingerprint deletions: at most two meet in one
        point = F.explode(F.expr("transform(sequence(0, 63), j -> struct(j as j, fp & ~shiftleft(1L, j) as c))")).alias("point")
        place = ["point.j", "point.c"]
    else:
        point = F.explode(F.expr("transform(sequence(0, 64), j -> struct(if(j = 64, fp, fp ^ shiftleft(1L, j)) as c))")).alias("point")
        place = ["point.c"]
    balls = crowded.select("fp", point).select("fp", *place)
    names = [c for c in balls.columns if c != "fp"]
    least = F.min("fp").over(Window.partitionBy(*names))
    stars = balls.select(least.alias("a"), F.col("fp").alias("b")).where(F.col("a") != F.col("b"))
    return pairs.unionAll(stars).distinct()


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_distance: int = 2) -> DataFrame:
    """doc_id, fp (signed long), component_id: one row per input row."""
    common.ready_for_python(df.sparkSession)
    prints = common.cut(df.select(df[id_col].alias("doc_id"), fingerprint_udf(width)(df[text_col].cast("string")).alias("fp")))
    reps = common.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    roots = common.connected_components(fingerprint_links(reps.select("fp"), max_distance))
    named = common.cut(reps.join(roots, reps.fp == roots.node, "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root")))
    least = common.cut(named.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("members")))
    classes = common.join_hot(named.select("fp", "n", "root"), least, "root", "members", "component_id")
    classes = common.cut(classes.select("fp", "n", "component_id"))
    return common.join_hot(prints, classes, "fp", "n", "component_id")



def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", common.unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash_near_dedup": op9_simhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
