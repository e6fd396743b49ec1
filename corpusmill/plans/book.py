"""A whole run over one book: extract, structure, gate, analyse, export.

The gate is enforced before anything is written. The driver only writes what
is small by nature (tables of one book); see :mod:`corpusmill.sources.csvs`
for the writers that scale.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.forms import FORMS
from ..operators import frequency, gate, inventory, ledger, lexicon, structure
from ..sources import csvs, docx
from . import fixed_tables as T
from .report import Relations, render

#: Column names of the exported ledger, in order.
LEDGER_COLUMNS = {
    "word": "الكلمة", "group_no": "رقم السورة", "group_name": "السورة", "no_in_group": "رقم في السورة", "group_total": "إجمالي كلمات السورة", "global_no": "الرقم",
    "done": "خلص", "count": "عدد التكرار", "first_ref": "أول موضع", "refs": "كل المواضع", "distinct_groups": "عدد السور", "rank": "ترتيب التكرار",
}
#: Column names of the table of new words.
NEW_WORD_COLUMNS = {"group_name": "السورة", "new_words": "كلمات جديدة", "group_no": "رقم السورة", "cumulative": "تراكمي", "percent": "% مكتمل"}


@dataclass
class Config:
    """What a run expects of its book; the defaults are the standing tables."""

    source: str
    target: str
    expected: tuple[int, ...] = T.EXPECTED_UNITS
    spots: tuple[tuple[int, int, str], ...] = ((1, 7, "group 1"), (2, 286, "group 2"), (114, 6, "group 114"))
    letters: tuple[tuple[int, int, str], ...] = T.OPENING_LETTERS
    joined: tuple[tuple[str, str, str], ...] = T.JOINED_FORMS
    surfaces: tuple[tuple[str, str, str, str, str], ...] = T.SURFACE_GATE
    without_formula: tuple[int, ...] = T.WITHOUT_FORMULA + T.FORMULA_IS_UNIT
    title: str = "Word frequency report"
    log: list[str] = field(default_factory=list)

    def say(self, line: str) -> None:
        print(line)
        self.log.append(line)


class Unclassified(Exception):
    """Lines before the first header, shown by their first characters."""


def structured(spark: SparkSession, config: Config) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(units, structural elements, trailing audit, all text lines); stops at unclassified lines."""
    lines = structure.paragraphs_to_lines(docx.read_docx(spark, config.source)).cache()
    found = structure.classify(lines).cache()
    stray = structure.unclassified(found)
    shown = stray.orderBy("doc", "line_no").limit(gate.NAMED).collect()
    if shown:
        more = stray.count() - len(shown)
        raise Unclassified("\n".join([f"{r.line_no}: {r.shown}" for r in shown] + ([f"and {more} more"] if more else [])))
    for r in structure.suffixed_headers(found).orderBy("doc", "line_no").toLocalIterator():
        config.say(f"title suffix cut from the header of line {r.line_no}: {r.line}")
    blocks = structure.blocks(found).cache()
    expected = spark.createDataFrame([(i + 1, n) for i, n in enumerate(config.expected)], "block_no bigint, n_expected bigint")
    segments = structure.segment(blocks.select("block_no", "name", "body"), ["block_no", "name"]).cache()
    units = segments.select(F.col("block_no").alias("group_no"), F.col("name").alias("group_name"), "unit_no", "text")
    trailing = structure.trailing_audit(segments.drop("name"), expected, ["block_no"]).withColumnRenamed("block_no", "group_no")
    elements = structure.structural(blocks).withColumnRenamed("block_no", "group_no")
    return units, elements, trailing, lines


def run(spark: SparkSession, config: Config) -> list[str]:
    """Writes all exports into ``config.target``; returns their names. Raises before writing if the gate fails."""
    units, elements, trailing, lines = structured(spark, config)
    n_groups = len(config.expected)
    expected = spark.createDataFrame([(i + 1, n) for i, n in enumerate(config.expected)], "group_no bigint, n_expected bigint")
    gate.enforce(gate.failures(units, expected, n_groups, sum(config.expected), config.spots))
    config.say(f"gate passed: {n_groups} groups, {sum(config.expected)} units")

    out = Path(config.target)
    out.mkdir(parents=True, exist_ok=True)
    names: list[str] = []

    def export(df: DataFrame, name: str) -> None:
        n = csvs.export(df, str(out / name))
        names.append(name)
        config.say(f"{name}: {n} rows")

    corpus = units.select(F.col("group_no").alias("surah_number"), F.col("group_name").alias("surah_name"), F.col("unit_no").alias("ayah_number"), F.col("text").alias("ayah_text_raw"))
    export(corpus.orderBy("surah_number", "ayah_number"), "quran_corpus.csv")
    shown = elements.select(F.col("group_no").alias("surah_number"), F.col("name").alias("surah_name"), "header_raw", "basmalah_present", "basmalah_text_raw")
    export(shown.orderBy("surah_number"), "structural_elements.csv")

    # all lines of the document are counted, joined by newlines
    text = lines.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    points = inventory.codepoint_inventory(text).cache()
    export(points.orderBy("decimal"), "codepoint_inventory.csv")

    counts = frequency.token_counts(units).cache()
    letters = spark.createDataFrame(list(config.letters), "surah bigint, ayah bigint, letters string")
    openings = lexicon.opening_letters(units, letters).cache()
    flags = lexicon.flag_tokens(units, lexicon.lexicon_table(spark, config.joined), lexicon.gate_table(spark, config.surfaces)).cache()
    groups = spark.range(1, n_groups + 1).withColumnRenamed("id", "group_no")
    census = structure.formula_census(elements, "group_no", groups, config.without_formula)
    defined = lexicon.definitions(units, elements, openings, flags)
    export(openings.orderBy("surah", "ayah"), "muqattaat_analysis.csv")
    export(lexicon.review_table(lexicon.fused_review(flags), trailing, census, elements), "review_needed.csv")

    for f in FORMS:
        words = frequency.word_table(counts, f).orderBy(F.desc("count"), "word").cache()
        export(words, f"word_frequency_{f}.csv")
        export(words.where(F.col("count") == 1), f"hapax_{f}.csv")
        export(frequency.top(words, 200), f"top200_{f}.csv")
        hist = frequency.histogram(words).orderBy("slot").drop("slot")
        export(hist, f"frequency_distribution_{f}.csv")
        if f == "normalized":
            export(hist, "frequency_distribution.csv")
        words.unpersist()
    export(frequency.rounded_densities(frequency.group_statistics(units, counts)).orderBy("surah_number"), "per_surah_statistics.csv")

    full = ledger.ledger(units, counts, with_refs=True).cache()
    check_ledger(full, counts)
    named = full.select(*[F.col(c).alias(n) for c, n in LEDGER_COLUMNS.items()])
    export(named.orderBy(LEDGER_COLUMNS["global_no"]), "quran_words_by_surah.csv")
    kept = [n for c, n in LEDGER_COLUMNS.items() if c != "group_total"]
    folder = out / "surah_files"
    files = csvs.export_group_files(named, str(folder), LEDGER_COLUMNS["group_no"], LEDGER_COLUMNS["group_name"], LEDGER_COLUMNS["no_in_group"], kept)
    check_split(spark, str(folder), files, full)
    csvs.zip_folder(str(folder), str(out / "surah_files.zip"))
    for line in csvs.export_summary(full, ["group_no", "group_name"], csvs.file_sizes(spark, str(folder))):
        config.say(line)
    config.say(f"surah_files.zip: {(out / 'surah_files.zip').stat().st_size:,} bytes")
    names += ["surah_files", "surah_files.zip"]
    fresh = ledger.new_words(units).orderBy("group_no").toPandas()
    fresh["percent"] = [round(x, 1) for x in fresh["percent"]]
    export(spark.createDataFrame(fresh[list(NEW_WORD_COLUMNS)].rename(columns=NEW_WORD_COLUMNS)), "new_words_per_surah.csv")

    made = Relations(config.title, units, elements, counts, defined, points, lexicon.gate_rejected(flags), trailing, census)
    (out / "summary_report.md").write_text(render(made), encoding="utf-8")
    (out / "run_log.txt").write_text("\n".join(config.log), encoding="utf-8")
    names += ["summary_report.md", "run_log.txt"]
    for df in (lines, points, counts, openings, flags, full):
        df.unpersist()
    return names


def check_ledger(full: DataFrame, counts: DataFrame) -> None:
    """Before it is written: no word twice, numbers 1..N overall and within each group, counts that add up to all tokens."""
    one = full.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("word").alias("d"), F.count_distinct("global_no").alias("g"), F.min("global_no").alias("lo"), F.max("global_no").alias("hi"), F.sum("count").alias("s")).first()
    total = counts.agg(F.sum("n").alias("n")).first().n
    uneven = full.groupBy("group_no").agg(F.count(F.lit(1)).alias("n"), F.min("no_in_group").alias("lo"), F.max("no_in_group").alias("hi"), F.count_distinct("no_in_group").alias("d"))
    bad = [w for w, ok in (("repeated words", one.d == one.n), ("numbers", one.n == 0 or (one.lo, one.hi, one.g) == (1, one.n, one.n)), ("sum of counts", one.s == total)) if not ok]
    bad += [f"numbers of group {r.group_no}" for r in uneven.where("lo <> 1 or hi <> n or d <> n").orderBy("group_no").limit(100).collect()]
    if bad:
        raise gate.GateFailed([f"ledger: {x}" for x in bad])


def check_split(spark: SparkSession, folder: str, files: list[str], full: DataFrame) -> None:
    """The written files read again hold the whole ledger: rows, no word twice, numbers 1..N, sum of counts."""
    word, no, count = LEDGER_COLUMNS["word"], LEDGER_COLUMNS["global_no"], LEDGER_COLUMNS["count"]
    kinds = {"word": "string", "group_name": "string", "done": "string", "first_ref": "string", "refs": "string"}
    schema = ", ".join(f"`{n}` {kinds.get(c, 'bigint')}" for c, n in LEDGER_COLUMNS.items() if c != "group_total")
    back = csvs.read_csv(spark, folder, schema).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(word).alias("d"), F.min(no).alias("lo"), F.max(no).alias("hi"), F.sum(count).alias("s")).first()
    want = full.agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("s"), F.count_distinct("group_no").alias("g")).first()
    bad = [w for w, ok in (("rows", back.n == want.n), ("repeated words", back.d == back.n), ("numbers", (back.lo, back.hi) == (1, back.n)), ("sum of counts", back.s == want.s), ("files", len(files) == want.g)) if not ok]
    if bad:
        raise gate.GateFailed([f"written files: {x}" for x in bad])
