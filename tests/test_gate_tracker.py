import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import frequency, gate, ledger, tracker

UNITS = "group_no long, group_name string, unit_no long, text string"
GOOD = [(1, "أ", 1, "ا ب"), (1, "أ", 2, "ب ج ج"), (2, "ب", 1, "ا")]


def found(spark, rows, expected=((1, 2), (2, 1)), groups=2, units=3, spots=()):
    df = spark.createDataFrame(rows, UNITS)
    exp = spark.createDataFrame(list(expected), "group_no long, n_expected long")
    return gate.failures(df, exp, groups, units, spots)


def checks_of(df):
    return sorted({r.check for r in df.collect()})


def test_gate_passes(spark):
    gate.enforce(found(spark, GOOD, spots=((1, 2, "one"),)))


@pytest.mark.parametrize(
    "rows, want",
    [
        (GOOD[:2], ["group count", "group units", "unit count"]),
        ([*GOOD, (2, "ب", 3, "د")], ["group units", "last units", "unit count", "unit sequence"]),
        ([GOOD[0], (1, "أ", 1, "ج"), GOOD[2]], ["unit sequence"]),
        ([GOOD[0], (1, "أ", 2, "x"), GOOD[2]], ["markup leak", "markup units"]),
        ([GOOD[0], (1, "أ", 2, "٣"), GOOD[2]], ["markup leak", "markup units"]),
        ([GOOD[0], (1, "أ", 2, ""), GOOD[2]], ["empty units"]),
        ([], ["group count", "group units", "unit count"]),
    ],
)
def test_gate_names_every_violation(spark, rows, want):
    df = found(spark, rows)
    assert checks_of(df) == want
    with pytest.raises(gate.GateFailed) as e:
        gate.enforce(df)
    assert len(e.value.failures) == df.count()


def test_spot_check_and_context(spark):
    rows = found(spark, [(1, "أ", i, f"ن{i}") for i in (1, 2, 3, 4, 5)], ((1, 4),), 1, 5, ((1, 4, "one"),)).collect()
    assert [r.key for r in rows if r.check == "spot check"] == ["one"]
    assert len([r for r in rows if r.check == "last units"]) == 3


def test_order_and_gaps(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 3, 1), (1, 2, 2), (2, 1, 0)], "group_no long, unit_no long, at long")
    assert [r.group_no for r in gate.ordered_sequence_violations(df, "at").collect()] == [1]
    numbers = spark.createDataFrame([(1,), (2,), (7,), (9,)], "n long")
    assert [r.gap for r in gate.sequence_gaps(numbers, "n").collect()] == [3, 4]


def parts(spark):
    units = spark.createDataFrame(GOOD, UNITS)
    counts = frequency.token_counts(units)
    book = ledger.ledger(units, counts, with_refs=True)
    return units, tracker.vocabulary(counts), book


def test_ledger(spark):
    _, _, book = parts(spark)
    rows = book.orderBy("global_no").collect()
    assert [(r.word, r.global_no, r.no_in_group, r.group_total, r["count"], r.first_ref, r.distinct_groups, r["rank"], r.refs, r.done) for r in rows] == [
        ("ا", 1, 1, 3, 2, "1:1", 2, 1, "1:1 · 2:1", "No"),
        ("ب", 2, 2, 3, 2, "1:1", 1, 2, "1:1 · 1:2", "No"),
        ("ج", 3, 3, 3, 2, "1:2", 1, 3, "1:2 · 1:2", "No"),
    ]


def test_long_reference_lists_and_new_words(spark):
    units = spark.createDataFrame([(1, "a", i, "x x") for i in range(1, 9)] + [(2, "b", 1, "x"), (3, "c", 1, "y")], UNITS)
    refs = {r.word: r.refs for r in ledger.all_references(units).collect()}
    assert refs["x"] == " · ".join(f"1:{i // 2 + 1}" for i in range(12)) + " … (+5)"
    rows = ledger.new_words(units).orderBy("group_no").collect()
    assert [(r.new_words, r.cumulative, r.percent) for r in rows] == [(1, 1, 50.0), (0, 1, 50.0), (1, 2, 100.0)]


def test_tracker_checks(spark):
    units, vocab, book = parts(spark)
    rows = [("ا", 1, "نعم", 2, "1:1", "أ"), ("ب", 2, " YES ", 2, "1:1", "أ"), ("ج", 3, None, 2, "1:2", "أ")]
    schema = "word string, global_no long, done string, count long, first_ref string, surah string"
    good = spark.createDataFrame(rows, schema)
    assert len(tracker.verify(good, units, vocab, 3, 6)) == 9
    assert tuple(tracker.progress(good).first())[:2] == (2, 1)
    assert [r.word for r in tracker.next_pending(good).collect()] == ["ج"]
    faulty = spark.createDataFrame([rows[0], rows[0], ("ب", 9, "later", 5, "9:9", "أ"), ("د", 4, "", 1, "1:1", "أ")], schema)
    bad = {r.check_no: (r.ok, r.observed) for r in tracker.checks(faulty, units, vocab, 3, 6).collect()}
    assert bad == {"1": (False, 4), "2": (False, 1), "3": (False, 3), "4": (False, 1), "5": (False, 1), "6": (False, 10), "6b": (False, 2), "7": (False, 1), "8": (False, 1)}
    with pytest.raises(gate.GateFailed) as e:
        tracker.verify(faulty, units, vocab, 3, 6)
    assert len(e.value.failures) == 9
    assert [x.split(": ")[1] for x in e.value.failures if x[:2] in ("4 ", "5 ", "6b")] == ["1 (د)", "1 (ج)", "2 (د 1 != None; ب 5 != 2)"]
    empty = spark.createDataFrame([], schema)
    assert tuple(tracker.progress(empty).first()) == (0, 0, None)


def test_gate_reports_more_violations_than_it_names(spark):
    n = gate.NAMED + 5
    many = spark.range(n).selectExpr("'unit' AS check", "CAST(id AS string) AS key", "'x' AS detail")
    with pytest.raises(gate.GateFailed) as failed:
        gate.enforce(many)
    *named, last = failed.value.failures
    assert len(named) == gate.NAMED and last.startswith(f"{n} violations in all, written to ")
    assert spark.read.parquet(last.split(" written to ")[1]).distinct().count() == n


def test_ledger_reads_no_text_again(spark):
    """First places come with the counts; the units give only the groups' names."""
    units = spark.createDataFrame(GOOD, UNITS)
    counts = frequency.token_counts(units, by_word=True).localCheckpoint()
    unread = units.withColumn("text", F.raise_error(F.lit("a text was read")).cast("string"))
    rows = ledger.ledger(unread, counts).orderBy("global_no").collect()
    assert [(r.word, r.global_no, r.rank, r.first_ref) for r in rows] == [("ا", 1, 1, "1:1"), ("ب", 2, 2, "1:1"), ("ج", 3, 3, "1:2")]


@pytest.mark.parametrize("held", [1, 7, 10**6])
def test_gathered_counts_and_places(held, monkeypatch):
    """Sums of what a task hands on, however often it does, with repeated units, blank texts and bytes that are no UTF-8."""
    monkeypatch.setattr(frequency, "HELD", held)
    texts = [(2, 5, b"b a  a\xc2\xa0c"), (2, 4, b"a b"), (1, 9, b""), (1, 9, None), (1, 9, b" \x1c "), (2, 4, b"c"), (0, (1 << 32) - 1, b"a \xff")]
    batches = [pa.RecordBatch.from_arrays([pa.array([(g << 32) | u]), pa.array([t]).cast(pa.binary()).view(pa.string())], ["ord", "text"]) for g, u, t in texts]
    got = {}
    for batch in frequency.gathered(iter(batches)):
        for r in batch.to_pylist():
            n, at = got.get((r["token"], r["group_no"]), (0, r["at"]))
            got[r["token"], r["group_no"]] = (n + r["n"], min(at, r["at"]))
    at = lambda unit, place: (unit << 31) + place
    assert got == {("b", 2): (2, at(4, 1)), ("a", 2): (3, at(4, 0)), ("c", 2): (2, at(4, 0)), ("a", 0): (1, at((1 << 32) - 1, 0)), ("�", 0): (1, at((1 << 32) - 1, 1))}
    with pytest.raises(ValueError):
        list(frequency.gathered(iter([pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array(["a"])], ["ord", "text"])])))


@pytest.mark.parametrize("held", [1, 10**6])
def test_references_of_a_task(held, monkeypatch):
    """First places of each word in order, however often a task hands them on."""
    monkeypatch.setattr(ledger, "HELD", held)
    texts = [(7, "x y x"), (3, "x " * 5), (9, None), (4, " "), (1, "y")]
    batches = [pa.RecordBatch.from_arrays([pa.array([o]), pa.array([t], pa.string())], ["ord", "text"]) for o, t in texts]
    got = {}
    for batch in ledger.referred(iter(batches), 3):
        for r in batch.to_pylist():
            n, head = got.get(r["word"], (0, []))
            got[r["word"]] = (n + r["n"], sorted(head + r["head"])[:3])
    assert got == {"x": (7, [3, 3, 3]), "y": (2, [1, 7])}
