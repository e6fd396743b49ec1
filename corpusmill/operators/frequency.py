"""Token frequencies and what is read off them.

``token_counts`` tokenises every text once, in Arrow batches, and aggregates at
the grain (token, group): Python splits and counts a text's tokens several times
as fast as expressions explode them, and only what a task has gathered goes on.
All forms start from it: a form is applied to the distinct (token,
group) pairs, not to every occurrence, within an explode, below which the
optimizer moves no filter on it; then one exchange by word serves both
aggregates, by (word, group) and by word. The first occurrence is carried as
one BIGINT (group * 2^32 + unit), so that every aggregate stays a hash
aggregate and a frequent token costs no more than a rare one.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import ready_for_python, strings
from ..functions.forms import FORMS
from ..functions.rounding import half_even
from ..functions.shipping import ship
from ..functions.text import reference
from .form_lengths import lengths_by_table, tables

#: Units of one group; a first occurrence is group * UNITS + unit.
UNITS = 1 << 32
TAIL = 100


#: Tokens, each counted once a text, that a task gathers before it hands their sums on, and rows handed on at once.
HELD, OUT_ROWS = 2_000_000, 50_000
#: Places within a text; a token's place in its group is unit * PLACES + place.
PLACE_BITS = 31


def packed(group: Column, unit: Column) -> Column:
    """(group, unit) as one number; null for groups or units out of range."""
    fits = (group >= 0) & (group < (1 << 31)) & (unit >= 0) & (unit < UNITS)
    return F.when(fits, group.cast("bigint") * F.lit(UNITS) + unit.cast("bigint"))


def place(group: Column, unit: Column) -> Column:
    """(group, unit) packed; fails for groups or units out of range."""
    return F.coalesce(packed(group, unit), F.raise_error(F.lit("group or unit number out of range")).cast("bigint"))


def in_range(place: int | None) -> int:
    if place is None:
        raise ValueError("group or unit number out of range")
    return place


def place_reference(ord_: Column) -> Column:
    return reference(F.shiftright(ord_, 32), ord_.bitwiseAND(F.lit(UNITS - 1)))


class Tally:
    """Tokens of texts: a row for each token of a text, its number by first appearance instead of the token."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.codes, self.ns, self.places, self.sizes = array("q"), array("q"), array("q"), array("q")

    def add(self, place: int | None, text: str | None) -> None:
        # in order of first occurrence
        found = Counter(text.split()) if text else None
        if found:
            ids = self.ids
            self.codes.extend([ids.setdefault(w, len(ids)) for w in found])
            self.ns.extend(found.values())
            self.places.append(in_range(place))
            self.sizes.append(len(found))

    def __len__(self) -> int:
        return len(self.codes)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number, count, place of the text, and place in it (among its different tokens) of each row."""
        code, n, first, size = (np.frombuffer(x, np.int64) for x in (self.codes, self.ns, self.places, self.sizes))
        return code, n, np.repeat(first, size), np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)

    def words(self) -> pa.Array:
        return pa.array(self.ids.keys(), pa.string())


def starts(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])


def tallies(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[Tally]:
    """Tallies of the texts ``(ord, text)`` of a task, cut where one holds so many rows."""
    tally = Tally()
    for batch in batches:
        for place, text in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
            tally.add(place, text)
        if len(tally) >= held:
            yield tally
            tally = Tally()
    if len(tally):
        yield tally


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and first places of tokens by group, of the texts ``(ord, text)`` of a task."""
    for tally in tallies(batches, HELD):
        code, n, place, inside = tally.rows()
        key = code << 31 | place >> 32
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = starts(key)
        at = np.minimum.reduceat((((place & (UNITS - 1)) << PLACE_BITS) + inside)[order], first)
        key, n = key[first], np.add.reduceat(n[order], first)
        arrays = [tally.words().take(pa.array(key >> 31)), pa.array(key & ((1 << 31) - 1)), pa.array(n), pa.array(at)]
        yield from pa.Table.from_arrays(arrays, ["token", "group_no", "n", "at"]).to_batches(max_chunksize=OUT_ROWS)


def token_counts(units: DataFrame, by_word: bool = False) -> DataFrame:
    """``(token, group_no, n, first, at)`` over all units; ``at`` orders first occurrences within a group by unit and place in its text.

    ``by_word`` deals the rows by token alone, so that an aggregate by token
    needs no other exchange.
    """
    ready_for_python(units.sparkSession)
    kind = units.schema["group_no"].dataType
    rows = units.select(packed(F.col("group_no"), F.col("unit_no")).alias("ord"), "text").mapInArrow(gathered, "token string, group_no bigint, n bigint, at bigint")
    rows = rows.repartition("token") if by_word else rows
    counts = rows.groupBy("token", "group_no").agg(F.sum("n").alias("n"), F.min("at").alias("at"))
    first = F.shiftleft("group_no", 32) + F.shiftright("at", PLACE_BITS)
    return counts.select("token", F.col("group_no").cast(kind).alias("group_no"), "n", first.alias("first"), "at")


def in_form(counts: DataFrame, form: str) -> DataFrame:
    """``(word, group_no, n, first)``; tokens that the form empties are gone."""
    if form == "raw":
        return counts.withColumnRenamed("token", "word")
    word = F.explode(F.filter(F.array(FORMS[form](F.col("token"))), lambda w: w != ""))
    rows = counts.select(word.alias("word"), "group_no", "n", "first").repartition("word")
    return rows.groupBy("word", "group_no").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def word_table(counts: DataFrame, form: str) -> DataFrame:
    """word, count, first_occurrence, number_of_distinct_surahs, character_length."""
    words = in_form(counts, form).groupBy("word").agg(F.sum("n").alias("count"), F.min("first").alias("first"), F.count(F.lit(1)).alias("number_of_distinct_surahs"))
    return words.select("word", "count", place_reference(F.col("first")).alias("first_occurrence"), "number_of_distinct_surahs", F.length("word").cast("bigint").alias("character_length"))


def hapax(words: DataFrame) -> DataFrame:
    return words.where(F.col("count") == 1)


def top(words: DataFrame, n: int) -> DataFrame:
    return words.orderBy(F.desc("count"), "word").limit(n)


def by_length(words: DataFrame, n: int, longest: bool) -> DataFrame:
    """The n longest or shortest words; ties by (count desc, word)."""
    length = F.col("character_length")
    return words.orderBy(length.desc() if longest else length.asc(), F.desc("count"), "word").limit(n)


def histogram(words: DataFrame) -> DataFrame:
    """occurrences 1 to 99 and 100+, distinct_word_types, tokens_accounted; empty rows are kept."""
    seen = words.groupBy(F.least("count", F.lit(TAIL)).alias("k")).agg(F.count(F.lit(1)).alias("types"), F.sum("count").alias("accounted"))
    spine = words.sparkSession.range(1, TAIL + 1).withColumnRenamed("id", "slot")
    label = F.when(F.col("slot") == TAIL, f"{TAIL}+").otherwise(F.col("slot").cast("string"))
    return spine.join(seen, spine.slot == seen.k, "left").select(
        "slot", label.alias("occurrences"), F.coalesce("types", F.lit(0)).alias("distinct_word_types"), F.coalesce("accounted", F.lit(0)).alias("tokens_accounted")
    )


def histogram_rollup(words: DataFrame) -> DataFrame:
    """The histogram as the report shows it: 1 to 10, 11-99 and 100+, with shares of types and tokens."""
    rows = histogram(words)
    band = F.when(F.col("slot") <= 10, F.col("occurrences")).when(F.col("slot") < TAIL, "11-99").otherwise(F.col("occurrences"))
    banded = rows.groupBy(band.alias("band")).agg(F.sum("distinct_word_types").alias("distinct_word_types"), F.sum("tokens_accounted").alias("tokens_accounted"))
    whole = words.agg(F.count(F.lit(1)).alias("all_types"), F.sum("count").alias("all_tokens"))
    both = banded.withColumn("one", F.lit(1)).join(F.broadcast(whole.withColumn("one", F.lit(1))), "one")
    return both.select("band", "distinct_word_types", "tokens_accounted", (F.col("distinct_word_types") / F.col("all_types")).alias("type_share"), (F.col("tokens_accounted") / F.col("all_tokens")).alias("token_share"))


def in_all_forms(counts: DataFrame) -> DataFrame:
    """``(form, word, group_no, n)`` for every form, from one pass over the counts."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("form"), form(F.col("token")).alias("word")) for name, form in FORMS.items()])).alias("f")
    rows = counts.select(each, "group_no", "n").select("f.form", "f.word", "group_no", "n").where("word <> ''").repartition("form", "word")
    return rows.groupBy("form", "word", "group_no").agg(F.sum("n").alias("n"))


def form_totals(counts: DataFrame) -> DataFrame:
    """form, tokens, types, hapax, type_token_ratio (not rounded)."""
    words = in_all_forms(counts).groupBy("form", "word").agg(F.sum("n").alias("n"))
    return words.groupBy("form").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types"), F.count_if(F.col("n") == 1).alias("hapax")).withColumn("type_token_ratio", F.col("types") / F.col("tokens"))


def form_effect(units: DataFrame) -> DataFrame:
    """form, chars of all texts joined by newlines, chars_removed_vs_raw, identical_to_raw."""
    # joining and then stripping and collapsing differs from doing so text by text only for blank texts
    ready_for_python(units.sparkSession)
    known = tables(units.sparkSession, FORMS)
    parts = [lengths_by_table(units, known)] if known else []
    others = {name: form for name, form in FORMS.items() if name not in {t.form for t in known}}
    if others:
        # each form is stated once and read twice above the explode
        each = F.array(*[F.struct(F.lit(name).alias("form"), form(F.col("text")).alias("shown")) for name, form in others.items()])
        length = lambda c: F.length(c).cast("bigint")
        rows = units.select("text", F.inline(each))
        parts.append(rows.select("form", length("shown").alias("shown"), length("text").alias("raw"), F.lit(1).cast("bigint").alias("n"), (F.col("shown") == F.col("text")).alias("same")))
    rows = reduce(DataFrame.unionAll, parts)
    total = rows.groupBy("form").agg(F.sum("shown").alias("chars"), F.sum("raw").alias("raw"), F.sum("n").alias("n"), F.bool_and("same").alias("identical_to_raw"))
    return total.select("form", (F.col("chars") + F.col("n") - 1).alias("chars"), (F.col("raw") - F.col("chars")).alias("chars_removed_vs_raw"), "identical_to_raw")


def group_statistics(units: DataFrame, counts: DataFrame) -> DataFrame:
    """One row a group: unit count, then words, unique and density for each form."""
    per = in_all_forms(counts).groupBy("form", "group_no").agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("unique"))
    wide = per.groupBy("group_no").agg(*[F.max(F.when(F.col("form") == f, F.col(c))).alias(f"{c}_{f}") for f in FORMS for c in ("words", "unique")])
    groups = units.groupBy("group_no", "group_name").agg(F.count(F.lit(1)).alias("ayah_count"))
    joined = groups.join(wide, "group_no", "left")
    columns = [F.col("group_no").cast("bigint").alias("surah_number"), F.col("group_name").alias("surah_name"), "ayah_count"]
    for f in FORMS:
        words, unique = F.coalesce(f"words_{f}", F.lit(0)), F.coalesce(f"unique_{f}", F.lit(0))
        columns += [words.alias(f"words_{f}"), unique.alias(f"unique_{f}"), F.when(words > 0, unique / words).otherwise(0.0).alias(f"density_{f}")]
    return joined.select(*columns)


def rounded_densities(statistics: DataFrame, places: int = 6) -> DataFrame:
    """The statistics with their densities as an export shows them."""
    ship(statistics.sparkSession)
    return statistics.withColumns({f"density_{f}": half_even(F.col(f"density_{f}"), places) for f in FORMS})


def top_groups(statistics: DataFrame, n: int = 5) -> DataFrame:
    kept = statistics.select("surah_number", "surah_name", "ayah_count", "words_normalized", "unique_normalized", "density_normalized")
    return kept.orderBy(F.desc("words_normalized"), "surah_number").limit(n)
