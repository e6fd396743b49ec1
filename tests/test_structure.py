import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import inventory, structure
from corpusmill.plans import fixed_tables as T


def lines(spark, values, doc="d"):
    return spark.createDataFrame([(doc, i, v) for i, v in enumerate(values)], "doc string, line_no long, line string")


def test_classification_and_blocks(spark):
    found = structure.classify(
        lines(
            spark,
            [
                "سُورَةُ الأولى القرآن الكريم :",
                "  ",
                "بِسْمِ أ",
                "بِسْمِ ب",
                "first line (1)",
                "بسم 3",
                "سورة " + "x" * 60,
                "second",
                "سورة الثانية",
                "سورة 2 with digit",
            ],
        )
    ).cache()
    kinds = [r.kind for r in found.orderBy("line_no").collect()]
    assert kinds == ["header", "blank", "formula", "formula", "body", "body", "body", "body", "header", "body"]
    one, two = structure.blocks(found).orderBy("block_no").collect()
    assert one.formula == "بِسْمِ ب" and two.formula is None
    assert one.body == "first line (1) بسم 3 سورة " + "x" * 60 + " second"
    # the word's length is cut from the header as it stands, marks and all
    assert two.name == "الثانية" and one.name == "رَةُ الأولى"[0:0] + "سُورَةُ الأولى"[len(T.HEADER_WORD) :].strip()
    rows = structure.structural(structure.blocks(found)).orderBy("block_no").collect()
    assert [(r.basmalah_present, r.basmalah_text_raw) for r in rows] == [(True, "بِسْمِ ب"), (False, "")]


def test_lines_before_a_header(spark):
    found = structure.unclassified(structure.classify(lines(spark, ["x" * 100, "سورة أ"])))
    assert [(r.line_no, len(r.shown)) for r in found.collect()] == [(0, 80)]


def test_breaks_make_lines(spark):
    got = structure.paragraphs_to_lines(lines(spark, ["a\nb", "c"])).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in got] == [(0, "a"), (1, "b"), (2, "c")]


@pytest.mark.parametrize(
    "body, want",
    [
        ("a (1) b (2)", [(1, "a", False), (2, "b", False)]),
        ("a (1) b", [(1, "a", False), (2, "b", True)]),
        ("just text", [(1, "just text", True)]),
        ("a (1) b (5) c", [(1, "a", False), (5, "b", False), (6, "c", True)]),
        ("a (١) b (٢)", [(1, "a", False), (2, "b", False)]),
        ("(1)(2) x", [(1, "", False), (2, "", False), (3, "x", True)]),
        ("", []),
    ],
)
def test_markers(spark, body, want):
    df = spark.createDataFrame([(1, body)], "g int, body string")
    rows = structure.segment(df, ["g"]).orderBy("seq").collect()
    assert [(r.unit_no, r.text, r.inferred) for r in rows] == want


def test_many_markers_take_linear_time(spark):
    n = 100_000
    df = spark.range(1).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w ("), i.cast("string"), F.lit(")"))), " ").alias("body"))
    start = time.time()
    one = structure.segment(df, ["id"]).agg(F.count("*").alias("n"), F.sum("unit_no").alias("s"), F.count_if("inferred").alias("i")).first()
    assert tuple(one) == (n, n * (n + 1) // 2, 0) and time.time() - start < 30


def test_suffixed_headers(spark):
    found = structure.classify(lines(spark, ["سورة أ القرآن الكريم :", "x (1)", "سورة ب"]))
    assert [r.line_no for r in structure.suffixed_headers(found).collect()] == [0]


def test_trailing_audit_and_census(spark):
    df = spark.createDataFrame([(1, "a (1) b"), (2, "c (1)"), (3, "d")], "g int, body string")
    expected = spark.createDataFrame([(1, 2), (2, 1), (3, 9)], "g int, n_expected long")
    rows = structure.trailing_audit(structure.segment(df, ["g"]), expected, ["g"]).orderBy("g").collect()
    assert [(r.g, r.inferred_ayah_number, r.boundary_matches, r.rule) for r in rows] == [(1, 2, True, T.TRAILING_RULE), (3, 1, False, T.TRAILING_RULE)]
    elements = spark.createDataFrame([(1, True), (2, False)], "g long, basmalah_present boolean")
    groups = spark.range(1, 10).withColumnRenamed("id", "g")
    got = {r.g: r.anomalous for r in structure.formula_census(elements, "g", groups, (1, 9)).collect()}
    assert got == {g: g != 9 for g in range(2, 10)}
    assert F is not None


def test_code_points_are_counted_in_batches():
    texts = [b"a\xf0\x9f\x98\x80a", None, b"", b"\n\xff"]
    batches = [pa.RecordBatch.from_arrays([pa.array([t], pa.binary()).view(pa.string())], ["text"]) for t in texts]
    (found,) = inventory.counted(iter(batches))
    assert {r["c"]: r["n"] for r in found.to_pylist()} == {"a": 2, "\U0001f600": 1, "\n": 1, "�": 1}
    assert sum(b.num_rows for b in inventory.counted(iter([]))) == 0
