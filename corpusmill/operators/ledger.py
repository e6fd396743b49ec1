"""First-occurrence ledger of words.

A word enters at its first occurrence in corpus order (group, unit, position),
which the token counts carry, so texts are not read again. Both global numbers,
first-seen order and frequency rank, come from sorted ranges rather than a
one-task sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import ready_for_python
from ..functions.ranges import with_row_number
from ..sources.folders import delete, stored, written
from .frequency import HELD, OUT_ROWS, PLACE_BITS, packed, place_reference, starts, tallies, token_counts

SHOWN_REFS = 12
JOINT, MORE = " · ", " … (+"


def first_seen(counts: DataFrame) -> DataFrame:
    """``(word, count, distinct_groups, group_no, at)``: group and place there of each word's first occurrence."""
    # one row a (token, group), so no two are first in the same group
    return counts.groupBy(F.col("token").alias("word")).agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("distinct_groups"), F.min("group_no").alias("group_no"), F.min_by("at", "group_no").alias("at")
    )


def numbered(counts: DataFrame) -> DataFrame:
    """The first occurrences with ``rank`` and ``global_no``, written."""
    spark = counts.sparkSession
    paths = []

    def keep(df: DataFrame) -> DataFrame:
        kept, path = stored(df, "ledger-step")
        paths.append(path)
        return kept

    words = keep(first_seen(counts))
    ranked = with_row_number(words, [("count", True), ("word", False)], "rank", keep=keep)
    rows = with_row_number(ranked, [("group_no", False), ("at", False)], "global_no")
    for path in paths:
        delete(spark, path)
    return rows


#: Groups that are few enough to be broadcast.
FEW_GROUPS = 100_000


def in_groups(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Numbered rows as the ledger shows them, but for references."""
    names = units.select("group_no", "group_name").distinct()
    # global numbers run through the groups in order, so a group's own number needs its first one, not a window over the group
    groups = written(rows.groupBy("group_no").agg((F.min("global_no") - 1).alias("before"), F.count(F.lit(1)).alias("group_total")).join(names, "group_no"))
    # the first groups hold most words: dealt by group they would be few tasks
    groups = F.broadcast(groups) if groups.count() <= FEW_GROUPS else groups
    rows = rows.join(groups, "group_no").withColumn("no_in_group", F.col("global_no") - F.col("before"))
    first = F.shiftleft("group_no", 32) + F.shiftright("at", PLACE_BITS)
    return rows.select("word", "group_no", "group_name", "no_in_group", "group_total", "global_no", F.lit("No").alias("done"), "count", place_reference(first).alias("first_ref"), "distinct_groups", "rank")


def referred(batches: Iterator[pa.RecordBatch], shown: int) -> Iterator[pa.RecordBatch]:
    """Of each token of the texts ``(ord, text)`` of a task: its count and the places of its first occurrences, one for each."""
    for tally in tallies(batches, HELD):
        code, n, place, _ = tally.rows()
        order = np.lexsort((place, code))
        code, n, place = code[order], n[order], place[order]
        first = starts(code)
        run = np.cumsum(n) - n
        before = run - np.repeat(run[first], np.diff(np.r_[first, len(n)]))
        taken = np.clip(shown - before, 0, n)
        ends = np.cumsum(np.add.reduceat(taken, first))
        heads = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(np.repeat(place, taken)))
        arrays = [tally.words(), pa.array(np.add.reduceat(n, first)), heads]
        yield from pa.Table.from_arrays(arrays, ["word", "n", "head"]).to_batches(max_chunksize=OUT_ROWS)


def all_references(units: DataFrame, shown: int = SHOWN_REFS) -> DataFrame:
    """``(word, refs)``: the first references of each word, one for each occurrence, and how many more.

    A task hands on ``shown`` places of a word at most each time that its
    tally is full, so a word of any frequency brings few.
    """
    ready_for_python(units.sparkSession)
    texts = units.select(packed(F.col("group_no"), F.col("unit_no")).alias("ord"), "text")
    rows = texts.mapInArrow(lambda batches: referred(batches, shown), "word string, n bigint, head array<bigint>").repartition("word")
    words = rows.groupBy("word").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("head"))), 1, shown).alias("head"))
    text = F.array_join(F.transform("head", place_reference), JOINT)
    more = F.when(F.col("n") > shown, F.concat(text, F.lit(MORE), (F.col("n") - shown).cast("string"), F.lit(")"))).otherwise(text)
    return words.select("word", more.alias("refs"))


def ledger(units: DataFrame, counts: DataFrame, with_refs: bool = False) -> DataFrame:
    """word, group_no, group_name, no_in_group, group_total, global_no, done, count, first_ref, distinct_groups, rank (, refs)."""
    rows = in_groups(numbered(counts), units)
    return rows.join(all_references(units), "word") if with_refs else rows


def new_words(units: DataFrame) -> DataFrame:
    """group_no, group_name, new_words, cumulative, share: one row a group, also for those without new words."""
    found = first_seen(token_counts(units, by_word=True)).groupBy("group_no").agg(F.count(F.lit(1)).alias("n"))
    groups = units.select("group_no", "group_name").distinct().join(found, "group_no", "left").select("group_no", "group_name", F.coalesce("n", F.lit(0)).alias("new_words"))
    run, whole = Window.orderBy("group_no"), Window.partitionBy()
    groups = groups.withColumn("cumulative", F.sum("new_words").over(run)).withColumn("total", F.sum("new_words").over(whole))
    return groups.select("group_no", "group_name", "new_words", "cumulative", (100 * F.col("cumulative") / F.col("total")).alias("percent"))

