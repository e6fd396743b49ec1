"""A training-data pipeline over ``documents``: each stage applies one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again before the next stage. All but the last return the
columns of ``docs``; the last returns one row per document of the mix with its
token count and digests, a document taken twice giving two rows.

Defined results: empty input gives empty output of the same columns; nulls,
ties and repeated rows are as the operators define them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bpe, common, exact_dedup, mixing, quality, simhash_similar
from corpusmill.sources.folders import shared_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject (score of at least ``quality.THRESHOLD``)."""
    field = quality.fitted_on(spark, docs, sf_dir)
    score = common.free_name(docs, "score")
    return quality.score(docs, field, out=score).where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest identifier."""
    return exact_dedup.exact_dedup(docs, keep="largest", carry=True).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, one row: the one with the smallest identifier, any of these if it is repeated.

    Near copies share five-word shingles to a similarity of 0.8 or more.
    """
    # the row's own number tells rows of one identifier apart; a null identifier is the largest
    row = common.free_name(docs, "row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    found = simhash_similar.near_dedup_similar(numbered.select(key.alias("key"), "text"), id_col="key", width=5, similarity=0.8)
    gone = found.where(F.col("doc_id.row") != F.col("component_id.row")).select(F.col("doc_id.row").alias(row))
    return numbered.join(gone, row, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    taken = mixing.mix(docs, carry=True).where(F.col("copies") > 0)
    return taken.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes of each row."""
    return bpe.digests(bpe.encode_documents(docs.select("doc_id", "text"), *bpe.public_files()))


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: The classifier is learnt and the encoding is a fold over merges: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; what a stage has read is deleted then."""
    where = shared_folder(spark, "corpus-pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{i}")
        docs = spark.read.parquet(f"{where}/{i}")
        if i:
            common.delete(spark, f"{where}/{i - 1}")
    return docs
