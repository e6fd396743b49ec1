"""Token counts by an exact length histogram.

Each document's encoded length is counted once; documents of one length are
aggregated (pre-aggregated in each task, so only lengths are shuffled); and
suffix sums over the histogram answer totals, quantiles and truncated totals
for every context limit. The sums run in two levels, within blocks of lengths
and over the blocks, so no task holds the histogram.

The library counts; texts with a run of ``LONG_RUN`` white-space characters,
on which its pattern engine runs out of stack, are counted by the fold of
:class:`corpusmill.llm.bpe.Codec`, which gives the same ids.

Defined results: null and empty texts have length 0; an empty table has an
empty histogram; repeated rows count as often as they occur; identifiers and
other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .bpe import codec, load_ranks

#: Lengths of one block of the two-level sums.
BLOCK = 256
#: White space that the library's engine takes at once; its stack holds some ten times as much.
LONG_RUN = 50_000
_LONG_RUN = re.compile(r"\s{%d}" % LONG_RUN)


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def length_of(text: str | None, path: str, pattern: str) -> int:
    if not text:
        return 0
    if len(text) >= LONG_RUN and _LONG_RUN.search(text):
        return codec(path, pattern).encode(text).count(",") + 1
    return len(_encoding(path, pattern).encode_ordinary(text))


def encoded_length(text: Column, path: str, pattern: str) -> Column:
    """Number of ids of each whole text under a rank file."""

    @F.pandas_udf("long")
    def length(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([length_of(t, path, pattern) for t in texts], dtype="int64")

    return length(text)


def histogram(df: DataFrame, length: Column) -> DataFrame:
    """``(n_tokens, documents)``, one row per length that occurs."""
    return df.select(length.alias("n_tokens")).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("documents"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Answers for each length L taken as a context limit.

    documents, tokens: of exactly L; documents_longer, tokens_longer: of more
    than L; share_within: documents of at most L among all, the quantile that
    L is; truncated_total: tokens if every document is cut at L.
    """
    rows = common.cut(hist.select("n_tokens", "documents", (F.col("n_tokens") * F.col("documents")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("block")))
    blocks = rows.groupBy("block").agg(F.sum("documents").alias("d"), F.sum("tokens").alias("t"))
    beyond = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select(
        F.col("block").alias("b"),
        F.coalesce(F.sum("d").over(beyond), F.lit(0)).alias("d_beyond"),
        F.coalesce(F.sum("t").over(beyond), F.lit(0)).alias("t_beyond"),
        F.sum("d").over(every).alias("d_all"),
        F.sum("t").over(every).alias("t_all"),
    )
    longer = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(blocks, rows.block == blocks.b)
    d = F.coalesce(F.sum("documents").over(longer), F.lit(0)) + F.col("d_beyond")
    t = F.coalesce(F.sum("tokens").over(longer), F.lit(0)) + F.col("t_beyond")
    return out.select("n_tokens", "documents", "tokens", d.alias("documents_longer"), t.alias("tokens_longer"), "d_all", "t_all").select(
        "n_tokens",
        "documents",
        "tokens",
        "documents_longer",
        "tokens_longer",
        ((F.col("d_all") - F.col("documents_longer")) / F.col("d_all")).alias("share_within"),
        (F.col("t_all") - F.col("tokens_longer") + F.col("n_tokens") * F.col("documents_longer")).alias("truncated_total"),
    )


def at_limits(answers: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, documents_longer, truncated_total) for any limits, also between lengths."""
    spark = answers.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    # the greatest length not above the limit, else what all documents give
    whole = answers.select(F.sum("documents").alias("d_all"), F.sum("tokens").alias("t_all"))
    below = answers.select("n_tokens", "documents_longer", "tokens_longer")
    # each length is dealt to the limits it lies under by a literal list, one row for each asked limit
    under = F.filter(F.array(*[F.lit(int(x)).cast("long") for x in limits]), lambda x: x >= F.col("n_tokens"))
    found = below.select("*", F.explode(F.array_distinct(under)).alias("context_limit")).groupBy("context_limit").agg(F.max_by(F.struct("documents_longer", "tokens_longer"), "n_tokens").alias("s"))
    d_all, t_all = whole.first() or (0, 0)
    d_all, t_all = d_all or 0, t_all or 0
    d, t = F.coalesce(F.col("s.documents_longer"), F.lit(d_all)), F.coalesce(F.col("s.tokens_longer"), F.lit(t_all))
    return asked.join(found, "context_limit", "left").select("context_limit", d.alias("documents_longer"), (F.lit(t_all) - t + F.col("context_limit") * d).alias("truncated_total"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    common.ready_for_python(spark)
    docs = common.table(spark, sf_dir, "documents").select("text")
    length = encoded_length(F.col("text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return suffix_sums(histogram(docs, length))


QUERIES = {"op7_token_counts": op7_token_counts}
ORACLE_SQL: dict[str, str] = {}
