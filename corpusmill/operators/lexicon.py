"""Gate-then-lexicon flags, opening letters and the four word-count definitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.batches import bare, leading_bare, ready_for_python, strings, token_number
from ..functions.forms import no_tashkeel
from ..functions.text import reference, tokens
from ..plans import fixed_tables as T

Gate = tuple[tuple[str, str, str, str, str], ...]
Lexicon = tuple[tuple[str, str, str], ...]


def lexicon_table(spark: SparkSession, entries: Lexicon = T.JOINED_FORMS) -> DataFrame:
    return spark.createDataFrame(list(entries), "skeleton string, rule string, decomposition string")


def gate_table(spark: SparkSession, entries: Gate = T.SURFACE_GATE) -> DataFrame:
    return spark.createDataFrame(list(entries), "skeleton string, surface string, rule string, decomposition string, note string")


T_FOUND = StructType([StructField("pos", IntegerType()), StructField("token_raw", StringType()), StructField("token_no_tashkeel", StringType())])


def with_skeletons(batches: Iterator[pa.RecordBatch], wanted: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """Group, name, unit, place, token and skeleton of each token whose skeleton is wanted, in units whose tokens all have one."""
    for batch in batches:
        units, places, raws, bares = [], [], [], []
        for unit, text in enumerate(strings(batch.column(3))):
            if not text:
                continue
            raw, skeletons = text.split(), bare(text).split()
            if len(raw) != len(skeletons):
                continue
            hits = [i for i, s in enumerate(skeletons) if s in wanted]
            units += [unit] * len(hits)
            places += hits
            raws += [raw[i] for i in hits]
            bares += [skeletons[i] for i in hits]
        kept = [batch.column(i).take(pa.array(units, pa.int64())) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(places, pa.int32()), pa.array(raws, pa.string()), pa.array(bares, pa.string())], [*batch.schema.names[:3], *T_FOUND.names])


def flag_tokens(units: DataFrame, lexicon: DataFrame, gate: DataFrame) -> DataFrame:
    """One row for each token whose skeleton is in the gate or the lexicon.

    ``rejected``: the gate knows the skeleton but not in this surface. A unit
    with a token that loses all its characters is left out whole. Lexicon and
    gate are small fixed tables, so both joins are broadcasts.
    """
    ready_for_python(units.sparkSession)
    wanted = frozenset(r.skeleton for r in lexicon.select("skeleton").unionAll(gate.select("skeleton")).collect())
    units = units.select("group_no", "group_name", "unit_no", "text")
    found = T_FOUND.fields
    schema = StructType([*units.schema.fields[:3], *found])
    rows = units.mapInArrow(lambda batches: with_skeletons(batches, wanted), schema)
    gated = F.broadcast(gate.select(F.col("skeleton").alias("gk"), F.col("surface").alias("gs"), F.col("rule").alias("g_rule"), F.col("decomposition").alias("g_dec"), F.col("note").alias("g_note")))
    keys = F.broadcast(gate.select(F.col("skeleton").alias("gate_key")).distinct())
    known = F.broadcast(lexicon.select(F.col("skeleton").alias("lk"), F.col("rule").alias("l_rule"), F.col("decomposition").alias("l_dec")))
    rows = rows.join(keys, rows.token_no_tashkeel == keys.gate_key, "left")
    rows = rows.join(gated, (rows.token_no_tashkeel == gated.gk) & (rows.token_raw == gated.gs), "left")
    rows = rows.join(known, rows.token_no_tashkeel == known.lk, "left")
    in_gate = F.col("gate_key").isNotNull()
    rows = rows.where(in_gate | F.col("lk").isNotNull())
    return rows.select(
        "group_no", "group_name", "unit_no", "pos", "token_raw", "token_no_tashkeel",
        (in_gate & F.col("gk").isNull()).alias("rejected"),
        F.when(in_gate, F.col("g_rule")).otherwise(F.col("l_rule")).alias("rule"),
        F.when(in_gate, F.col("g_dec")).otherwise(F.col("l_dec")).alias("suggested_decomposition"),
        F.when(in_gate, F.col("g_note")).otherwise(F.lit("")).alias("ambiguity_note"),
    )


def extra_parts(decomposition: F.Column) -> F.Column:
    return (F.size(F.split(decomposition, r"\+")) - 1).cast("bigint")


def fused_review(flags: DataFrame) -> DataFrame:
    """The 11 columns of a review row, for every flag that isn't rejected, and its ``pos``."""
    return flags.where("not rejected").select(
        F.col("group_no").alias("surah_number"), F.col("group_name").alias("surah_name"), F.col("unit_no").alias("ayah_number"),
        reference(F.col("group_no"), F.col("unit_no")).alias("reference"), "token_raw", "token_no_tashkeel", "rule", "suggested_decomposition",
        extra_parts(F.col("suggested_decomposition")).alias("implied_extra_tokens_if_split"), "ambiguity_note", F.lit(T.NO_ACTION).alias("action_taken"),
        F.col("pos").cast("bigint").alias("pos"),
    )


def gate_rejected(flags: DataFrame) -> DataFrame:
    """token_no_tashkeel, count, the first place of each skeleton (orders ties)."""
    first = F.col("group_no").cast("bigint") * F.lit(1 << 32) + F.col("unit_no")
    return flags.where("rejected").groupBy("token_no_tashkeel").agg(F.count(F.lit(1)).alias("count"), F.min(first).alias("first_ord"))


def opening_letters(units: DataFrame, letters: DataFrame, strict: bool = False, small: bool = True) -> DataFrame:
    """surah, ayah, letters, status, tokens_spanned, surface for ``letters(surah, ayah, letters)``.

    The leading tokens of the skeleton are put together until they equal the
    letters. Tokens that run out before that count as spanned, as in the
    standing definition; ``strict`` calls them not matched. ``small`` says that
    ``letters`` is a fixed table that may be broadcast.
    """
    ready_for_python(units.sparkSession)
    hint = F.broadcast if small else (lambda df: df)
    wanted = hint(letters)
    # last one wins where a unit number repeats: read the larger text, so reruns agree
    known = units.join(hint(letters.select(F.col("surah").alias("s"), F.col("ayah").alias("a")).distinct()), (F.col("group_no") == F.col("s")) & (F.col("unit_no") == F.col("a")), "left_semi")
    known = known.groupBy("group_no", "unit_no").agg(F.max("text").alias("text"))
    rows = wanted.join(known, (F.col("surah") == F.col("group_no")) & (F.col("ayah") == F.col("unit_no")), "left")
    # each token has a character at least, so no more of them than letters, and one, are walked; three are shown
    most = F.greatest(F.length("letters") + 1, F.lit(3))
    rows = rows.select("surah", "ayah", "letters", F.col("text").isNull().alias("absent"), leading_bare(F.col("text"), most).alias("t"))

    def step(s: F.Column, t: F.Column) -> F.Column:
        acc = F.concat(s["acc"], t)
        state = F.when(acc == F.col("letters"), 1).when(F.length(acc) > F.length("letters"), 2).otherwise(0)
        return F.when(s["state"] > 0, s).otherwise(F.struct(acc.alias("acc"), (s["n"] + 1).alias("n"), state.alias("state")))

    start = F.struct(F.lit("").alias("acc"), F.lit(0).alias("n"), F.lit(0).alias("state"))
    walked = F.aggregate("t", start, step)
    rows = rows.withColumn("w", walked)
    open_end = F.lit(strict) & (F.col("w.state") == 0)
    spanned = F.when(F.col("absent"), F.lit(None)).when((F.col("w.state") == 2) | open_end, -1).otherwise(F.col("w.n"))
    status = F.when(F.col("absent"), "AYAH NOT FOUND").when(F.col("spanned") == 1, "already a single token").when(F.col("spanned") > 1, F.concat(F.lit("written as "), F.col("spanned").cast("string"), F.lit(" separate tokens"))).otherwise("NOT MATCHED at ayah start")
    rows = rows.withColumn("spanned", spanned.cast("bigint"))
    surface = F.when(F.col("absent"), "").otherwise(F.array_join(F.slice("t", 1, 3), " "))
    return rows.select(F.col("surah").cast("bigint").alias("surah"), F.col("ayah").cast("bigint").alias("ayah"), "letters", status.alias("status"), F.col("spanned").alias("tokens_spanned"), surface.alias("surface"))


def definitions(units: DataFrame, structural: DataFrame, openings: DataFrame, flags: DataFrame) -> DataFrame:
    """``(definition, component, value)``: the totals A to D and what they are made of."""
    n_tokens = F.sum(token_number(F.col("text")))
    verse = units.agg(F.coalesce(n_tokens, F.lit(0)).alias("verse"))
    formula = structural.agg(
        F.coalesce(F.sum(F.when(F.col("basmalah_present"), F.size(tokens(F.col("basmalah_text_raw"))))), F.lit(0)).alias("formula"),
        F.count_if("basmalah_present").alias("formulas"),
        F.coalesce(F.sum(F.size(tokens(F.col("header_raw")))), F.lit(0)).alias("header"),
        F.count(F.lit(1)).alias("headers"),
    )
    merged = openings.agg(F.coalesce(F.sum(F.when(F.col("tokens_spanned") > 1, F.col("tokens_spanned") - 1)), F.lit(0)).alias("merged"), F.count(F.lit(1)).alias("examined"))
    flagged = flags.agg(
        F.count_if(~F.col("rejected")).alias("flagged"),
        F.count_distinct(F.when(~F.col("rejected"), F.col("token_no_tashkeel"))).alias("types"),
        F.count_if("rejected").alias("suppressed"),
        F.coalesce(F.sum(F.when(~F.col("rejected"), extra_parts(F.col("suggested_decomposition")))), F.lit(0)).alias("extra"),
    )
    # one row each: four relations of a single row, joined on a constant
    one = verse.withColumn("k", F.lit(1))
    for part in (formula, merged, flagged):
        one = one.join(F.broadcast(part.withColumn("k", F.lit(1))), "k")
    cells = [
        ("A", "total", "verse + formula"), ("A", "ayah_tokens", "verse"), ("A", "standalone_basmalah_tokens", "formula"), ("A", "standalone_basmalah_count", "formulas"),
        ("B", "total", "verse"), ("C", "total", "verse - merged"), ("C", "tokens_removed_by_muqattaat_merge", "merged"), ("C", "muqattaat_occurrences_examined", "examined"),
        ("D", "total", "verse"), ("D", "fused_occurrences_flagged", "flagged"), ("D", "distinct_fused_types", "types"), ("D", "homographs_suppressed_by_vocalization_gate", "suppressed"),
        ("D", "hypothetical_total_if_all_split", "verse + extra"), ("D", "hypothetical_extra_tokens", "extra"),
        ("context", "surah_header_tokens_excluded", "header"), ("context", "surah_header_lines", "headers"),
    ]
    stacked = F.explode(F.array(*[F.struct(F.lit(d).alias("definition"), F.lit(c).alias("component"), F.expr(e).cast("bigint").alias("value")) for d, c, e in cells]))
    return one.select(stacked.alias("x")).select("x.*")


def review_rows(fused: DataFrame, trailing: DataFrame, census: DataFrame, key: str) -> DataFrame:
    """Rows of the three producers, numbered in their order: joined forms, inferred ends, absent formulas."""
    columns = ["producer", "reference", "rule", "token_raw", "token_no_tashkeel", "suggested_decomposition", "action_taken"]
    first = fused.withColumn("producer", F.lit(1)).select(*columns)
    second = trailing.select(
        F.lit(2).alias("producer"), reference(F.col(key), F.col("inferred_ayah_number")).alias("reference"), "rule", F.col("text_raw").alias("token_raw"),
        no_tashkeel(F.col("text_raw")).alias("token_no_tashkeel"), F.lit(T.TRAILING_DECOMPOSITION).alias("suggested_decomposition"),
        F.lit(T.TRAILING_ACTION).alias("action_taken"),
    )
    third = census.where("anomalous").select(
        F.lit(3).alias("producer"), F.concat(F.col(key).cast("string"), F.lit(":0")).alias("reference"), F.lit(T.ABSENT_RULE).alias("rule"), F.lit("").alias("token_raw"),
        F.lit("").alias("token_no_tashkeel"), F.lit("n/a").alias("suggested_decomposition"), F.lit(T.ABSENT_ACTION).alias("action_taken"),
    )
    return first.unionAll(second).unionAll(third)


def review_table(fused: DataFrame, trailing: DataFrame, census: DataFrame, elements: DataFrame) -> DataFrame:
    """The review export: 11 columns, producers in their order, corpus order within each."""
    names = elements.select(F.col("group_no").alias("g"), F.col("name").alias("surah_name"))
    end = trailing.join(names, F.col("group_no") == F.col("g")).select(
        F.col("group_no").alias("surah_number"), "surah_name", F.col("inferred_ayah_number").alias("ayah_number"), reference(F.col("group_no"), F.col("inferred_ayah_number")).alias("reference"),
        F.col("text_raw").alias("token_raw"), no_tashkeel(F.col("text_raw")).alias("token_no_tashkeel"), "rule", F.lit(T.TRAILING_DECOMPOSITION).alias("suggested_decomposition"),
        F.lit(0).cast("bigint").alias("implied_extra_tokens_if_split"), F.lit(T.TRAILING_NOTE).alias("ambiguity_note"),
        F.lit(T.TRAILING_ACTION).alias("action_taken"), F.lit(0).cast("bigint").alias("pos"),
    )
    absent = census.where("anomalous").join(names, F.col("group_no") == F.col("g")).select(
        F.col("group_no").alias("surah_number"), "surah_name", F.lit(0).cast("bigint").alias("ayah_number"), F.concat(F.col("group_no").cast("string"), F.lit(":0")).alias("reference"),
        F.lit("").alias("token_raw"), F.lit("").alias("token_no_tashkeel"), F.lit(T.ABSENT_RULE).alias("rule"), F.lit("n/a").alias("suggested_decomposition"),
        F.lit(0).cast("bigint").alias("implied_extra_tokens_if_split"), F.lit(T.ABSENT_NOTE).alias("ambiguity_note"),
        F.lit(T.ABSENT_ACTION).alias("action_taken"), F.lit(0).cast("bigint").alias("pos"),
    )
    rows = fused.withColumn("o", F.lit(1)).unionByName(end.withColumn("o", F.lit(2))).unionByName(absent.withColumn("o", F.lit(3)))
    return rows.orderBy("o", "surah_number", "ayah_number", "pos").drop("o", "pos")
