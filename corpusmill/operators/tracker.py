"""Reconciliation of an external tracker with the corpus.

``tracker(word, global_no, done, count, first_ref, surah)`` is an edited copy
of the ledger. All checks run, each as a relation; none stops the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import reference, strip
from ..plans import fixed_tables as T
from .gate import GateFailed, sequence_gaps


def vocabulary(counts: DataFrame) -> DataFrame:
    """``(vocab_word, vocab_count)`` from token counts."""
    return counts.groupBy(F.col("token").alias("vocab_word")).agg(F.sum("n").alias("vocab_count"))


def extra_words(tracker: DataFrame, vocab: DataFrame) -> DataFrame:
    return tracker.select("word").distinct().join(vocab, F.col("word") == F.col("vocab_word"), "left_anti")


def missing_words(tracker: DataFrame, vocab: DataFrame) -> DataFrame:
    return vocab.select("vocab_word").join(tracker, F.col("word") == F.col("vocab_word"), "left_anti").select(F.col("vocab_word").alias("word"))


def mismatches(tracker: DataFrame, vocab: DataFrame) -> DataFrame:
    """Tracker rows whose count is not the corpus's; a word the corpus lacks mismatches."""
    rows = tracker.select("word", "global_no", "count").join(vocab, F.col("word") == F.col("vocab_word"), "left")
    return rows.where(~F.col("count").eqNullSafe(F.col("vocab_count"))).select("word", "global_no", "count", "vocab_count")


def bad_references(tracker: DataFrame, units: DataFrame) -> DataFrame:
    known = units.select(reference(F.col("group_no"), F.col("unit_no")).alias("ref")).distinct()
    return tracker.select("word", "global_no", "first_ref").join(known, F.col("first_ref") == F.col("ref"), "left_anti")


def done_value(done: Column) -> Column:
    return F.lower(strip(F.coalesce(done.cast("string"), F.lit(""))))


def bad_done(tracker: DataFrame) -> DataFrame:
    value = done_value(F.col("done"))
    return tracker.select(value.alias("value")).distinct().where(~F.col("value").isin(*T.DONE_ALLOWED))


def duplicates(tracker: DataFrame) -> DataFrame:
    return tracker.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def progress(tracker: DataFrame) -> DataFrame:
    """done, pending, percent (not rounded; null without rows)."""
    yes = done_value(F.col("done")).isin(*T.DONE_YES)
    total = tracker.agg(F.count_if(yes).alias("done"), F.count(F.lit(1)).alias("n"))
    return total.select("done", (F.col("n") - F.col("done")).alias("pending"), F.when(F.col("n") > 0, 100 * F.col("done") / F.col("n")).alias("percent"))


def next_pending(tracker: DataFrame, n: int = 3) -> DataFrame:
    pending = tracker.where(~done_value(F.col("done")).isin(*T.DONE_YES))
    return pending.orderBy("global_no", "word").limit(n).select("global_no", "word", "first_ref", "surah")


def checks(tracker: DataFrame, units: DataFrame, vocab: DataFrame, n_rows: int, n_tokens: int) -> DataFrame:
    """``(check_no, label, ok, observed)``: the nine checks.

    One pass over the tracker, one full join with the vocabulary for the four
    checks that compare the two, one join with the references.
    """
    value = done_value(F.col("done"))
    own = tracker.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("global_no").alias("lo"),
        F.max("global_no").alias("hi"),
        F.count_distinct("global_no").alias("numbers"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("total"),
        F.count_distinct(F.when(~value.isin(*T.DONE_ALLOWED), value)).alias("illegal"),
    )
    both = tracker.select("word", "count", F.lit(1).alias("here")).join(vocab, F.col("word") == F.col("vocab_word"), "full_outer")
    here, there = F.col("here").isNotNull(), F.col("vocab_word").isNotNull()
    met = both.agg(
        F.count_distinct(F.when(here, F.col("word"))).alias("words"),
        F.count_distinct(F.when(here & ~there, F.col("word"))).alias("extra"),
        F.count_if(there & ~here).alias("missing"),
        F.count_if(here & ~F.col("count").eqNullSafe(F.col("vocab_count"))).alias("unlike"),
    )
    refs = bad_references(tracker, units).agg(F.count(F.lit(1)).alias("refs"))
    one = own.withColumn("k", F.lit(1))
    for part in (met, refs):
        one = one.join(F.broadcast(part.withColumn("k", F.lit(1))), "k")
    n = F.col("n")
    rows = [
        ("1", "number of rows", n, n == n_rows),
        ("2", "no word twice", n - F.col("words"), n == F.col("words")),
        ("3", "numbers 1..N", F.col("numbers"), (n == 0) | ((F.col("lo") == 1) & (F.col("hi") == n) & (F.col("numbers") == n))),
        ("4", "every word is in the corpus", F.col("extra"), F.col("extra") == 0),
        ("5", "every word of the corpus is there", F.col("missing"), F.col("missing") == 0),
        ("6", "sum of counts", F.col("total"), F.col("total") == n_tokens),
        ("6b", "counts word by word", F.col("unlike"), F.col("unlike") == 0),
        ("7", "references exist", F.col("refs"), F.col("refs") == 0),
        ("8", "done values are legal", F.col("illegal"), F.col("illegal") == 0),
    ]
    return one.select(F.inline(F.array(*[F.struct(F.lit(no).alias("check_no"), F.lit(label).alias("label"), ok.alias("ok"), seen.cast("bigint").alias("observed")) for no, label, seen, ok in rows])))


def samples(tracker: DataFrame, vocab: DataFrame, n: int = 3) -> dict[str, list[str]]:
    """By check: the first extra and missing words, and mismatches with both counts, in order."""
    unlike = mismatches(tracker, vocab).orderBy("global_no", "word").limit(n).collect()
    return {
        "4": [r.word for r in extra_words(tracker, vocab).orderBy("word").limit(n).collect()],
        "5": [r.word for r in missing_words(tracker, vocab).orderBy("word").limit(n).collect()],
        "6b": [f"{r.word} {r['count']} != {r.vocab_count}" for r in unlike],
    }


def verify(tracker: DataFrame, units: DataFrame, vocab: DataFrame, n_rows: int, n_tokens: int) -> list[str]:
    """Labels of all checks in order; raises ``GateFailed`` naming those that failed, with samples."""
    rows = sorted(checks(tracker, units, vocab, n_rows, n_tokens).collect(), key=lambda r: r.check_no)
    bad = [r for r in rows if not r.ok]
    if bad:
        shown = samples(tracker, vocab) if any(r.check_no in ("4", "5", "6b") for r in bad) else {}
        raise GateFailed([f"{r.check_no} {r.label}: {r.observed}" + (f" ({'; '.join(shown[r.check_no])})" if shown.get(r.check_no) else "") for r in bad])
    return [r.label for r in rows]


__all__ = ["bad_done", "bad_references", "checks", "done_value", "duplicates", "extra_words", "mismatches", "missing_words", "next_pending", "progress", "samples", "sequence_gaps", "verify", "vocabulary"]
