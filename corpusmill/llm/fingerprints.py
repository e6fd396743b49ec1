"""I-Match document fingerprints over randomised lexicons [DataFrame functions only].

Terms are runs of letters and digits, lower-cased. The lexicon is the band of
terms whose share of the documents lies between ``low`` and ``high``, counted
over all documents; the idf is -log of that share. A document's distinct
lexicon terms, sorted, are hashed once whole and once for each of several
randomised lexicon subsets, of four densities, so that long and short texts
both have subsets in which an edit goes unseen.

The lexicon holds at most (mean distinct terms of a document) / ``low`` terms
at any size of the corpus, since the document counts of its terms sum to no
more than all (document, term) pairs. That bound makes it safe to send as a
literal set of 64-bit term hashes, and no (document, term) pair is shuffled:
only the term counts are, pre-aggregated by task.

Likeness of two fingerprints: the share of subsets with equal hashes among
those in which either document has a term; 1 for equal fingerprints.

Defined results: null is the empty text; a text without lexicon terms is
fingerprinted by all of its terms, one without terms by its characters;
rows repeated with one identifier order by text; null identifiers order last;
the only row of a table is its own next one; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: The band of document shares.
LOW, HIGH = 0.002, 0.1
#: (bits, subsets): a subset keeps a term whose hash has one given value in that many bits.
SPARSE = ((4, 8), (6, 8), (8, 8))
#: Classic randomised lexicons: each leaves out a quarter of the terms.
DENSE = 4


def term_hashes(text: Column) -> Column:
    """64-bit hashes of the sorted distinct terms."""
    terms = F.array_sort(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")))
    return F.transform(F.filter(terms, lambda t: t != ""), lambda t: F.xxhash64(t))


def lexicon(df: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> list[int]:
    """Hashes of the terms within the band, ascending."""
    n = df.select(F.count(F.lit(1))).first()[0]
    terms = df.select(F.explode(term_hashes(F.coalesce(df[text_col].cast("string"), F.lit("")))).alias("h"))
    counts = terms.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    return sorted(r.h for r in counts.where((F.col("df") >= low * n) & (F.col("df") <= high * n)).select("h").collect())


def with_signatures(df: DataFrame, text: str, out: str, terms: list[int]) -> DataFrame:
    """``df`` with the array column ``out``; ``text`` names a non-null string column."""
    members = ",".join(f"{h}L" for h in terms if h != -(2**63))
    every = df.withColumn("_all", term_hashes(F.col(text)))
    kept = F.expr(f"filter(_all, h -> h IN ({members}))") if members else F.expr("filter(_all, h -> false)")
    every = every.withColumn("_band", kept)
    # never empty: without lexicon terms all terms, without terms the characters
    every = every.withColumn("_kept", F.when(F.size("_band") > 0, F.col("_band")).when(F.size("_all") > 0, F.col("_all")).otherwise(F.array(F.xxhash64(F.col(text)))))
    low32 = F.lit(0xFFFFFFFF)

    def digest(hashes: Column) -> Column:
        return F.when(F.size(hashes) > 0, F.xxhash64(hashes).bitwiseAND(low32)).otherwise(F.lit(0).cast("long"))

    parts = [digest(F.col("_kept"))]
    parts += [digest(F.expr(f"filter(_kept, h -> (shiftright(h, {2 * i}) & 3) <> 0)")) for i in range(DENSE)]
    at = 2 * DENSE
    for bits, n in SPARSE:
        every = every.withColumn(f"_s{bits}", F.expr(f"filter(_kept, h -> (shiftright(h, {at}) & {2**bits - 1}) < {n})"))
        parts += [digest(F.expr(f"filter(_s{bits}, h -> (shiftright(h, {at}) & {2**bits - 1}) = {i})")) for i in range(n)]
        at += bits
    return every.withColumn(out, F.array(*parts)).drop("_all", "_band", "_kept", *[f"_s{b}" for b, _ in SPARSE])


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda s: F.lower(F.lpad(F.hex(s), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal subsets among those that either document reaches; 1 for equal fingerprints."""
    pairs = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), F.lit(None).cast("int")).otherwise((x == y).cast("int")))
    met = F.filter(pairs, lambda p: p.isNotNull())
    return F.when(a == b, F.lit(1.0)).otherwise(F.size(F.filter(met, lambda p: p == 1)) / F.size(met))


def with_next(df: DataFrame, columns: list[str], buckets: int | None = None) -> DataFrame:
    """``df`` (doc_id, t, ...) with ``next_<c>`` of the row after it by (doc_id, t); the first row follows the last.

    Sampled splitters cut the identifiers into ranges. The first rows of each
    range are dealt to the range before it as well, marked, so every window is
    one range and no row waits for another range.
    """
    spark = df.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(2**63 - 1).cast("long"))
    rows, first, size = df.select(F.count(F.lit(1)), F.min(key), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    parts = common.parts_for(spark, size)
    n = buckets or common.BUCKETS_PER_PARTITION * parts
    bounds = common.splitters(df.select(key.alias("k")), rows, n, F.xxhash64("doc_id"))
    starts = [first, *[b[0] for b in bounds if first is not None and b[0] > first]]
    bounds = [(s,) for s in starts[1:]]
    bucket = common.bucket_of(bounds, [key], ["bigint"])
    last = len(bounds)
    before = F.when(bucket == 0, F.lit(last)).otherwise(bucket - 1)
    own = F.struct(bucket.alias("bucket"), F.lit(False).alias("extra"))
    also = F.struct(before.cast("int").alias("bucket"), F.lit(True).alias("extra"))
    dealt = df.select("*", F.explode(F.when(key.isin([s for s in starts if s is not None]), F.array(own, also)).otherwise(F.array(own))).alias("to"))
    dealt = common.deal(dealt.select(*df.columns, "to.bucket", "to.extra"), "bucket", parts)
    order = Window.partitionBy("bucket").orderBy("extra", F.col("doc_id").asc_nulls_last(), "t")
    return dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where(~F.col("extra")).drop("bucket", "extra")


def op1_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    terms = lexicon(docs, "t")
    rows = with_next(with_signatures(docs, "t", "sig", terms), ["t", "sig"])
    half = F.floor(F.length("t") / 2).cast("int")
    rows = rows.select("doc_id", "t", "sig", "next_sig", F.length("t").cast("long").alias("n_chars"), F.concat(F.expr("left(t, length(t) - cast(floor(length(t) / 2) as int))"), F.substring(F.col("next_t"), F.lit(1), half)).alias("edited"))
    rows = with_signatures(rows.drop("t"), "edited", "edited_sig", terms)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("sig")).alias("fingerprint"),
        as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )


QUERIES = {"op1_imatch_fingerprints": op1_imatch_fingerprints}
ORACLE_SQL: dict[str, str] = {}
