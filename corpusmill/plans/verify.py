"""Verification of an edited tracker file against the exported corpus."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import frequency, tracker
from ..sources import csvs
from . import fixed_tables as T
from .book import LEDGER_COLUMNS

CORPUS_SCHEMA = "surah_number bigint, surah_name string, ayah_number bigint, ayah_text_raw string"
#: Ledger column -> tracker column; ``surah`` is the group's name.
TRACKER = {"word": "word", "global_no": "global_no", "done": "done", "count": "count", "first_ref": "first_ref", "group_name": "surah"}


def read_tracker(spark: SparkSession, path: str):
    """The columns of the checks, whatever others the file has and in whatever order."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    numbers = ("global_no", "count")
    return raw.select(*[F.col(f"`{LEDGER_COLUMNS[c]}`").try_cast("bigint" if c in numbers else "string").alias(n) for c, n in TRACKER.items()])


def run(spark: SparkSession, corpus_csv: str, tracker_csv: str, n_rows: int = T.LEDGER_ROWS, n_tokens: int = T.LEDGER_TOKENS) -> tuple[bool, list[str]]:
    """(all checks passed, lines of a report with every check, the progress and the next pending words)."""
    units = csvs.read_csv(spark, corpus_csv, CORPUS_SCHEMA).select(F.col("surah_number").alias("group_no"), F.col("surah_name").alias("group_name"), F.col("ayah_number").alias("unit_no"), F.col("ayah_text_raw").alias("text"))
    rows = read_tracker(spark, tracker_csv).cache()
    vocab = tracker.vocabulary(frequency.token_counts(units)).cache()
    found = tracker.checks(rows, units, vocab, n_rows, n_tokens).orderBy("check_no").collect()
    lines = [f"[{'ok' if r.ok else 'no'}] {r.check_no} {r.label}" + ("" if r.ok else f": {r.observed:,}") for r in found]
    if not found[2].ok:
        lines.append("gaps: " + ", ".join(str(r.gap) for r in tracker.sequence_gaps(rows, "global_no").collect()))
    state = tracker.progress(rows).first()
    lines.append(f"done {state.done:,}, pending {state.pending:,}" + (f", {state.percent:.2f}%" if state.percent is not None else ""))
    lines += [f"next: #{r.global_no} {r.word} ({r.first_ref} - {r.surah})" for r in tracker.next_pending(rows).collect()]
    rows.unpersist()
    vocab.unpersist()
    return all(r.ok for r in found), lines
