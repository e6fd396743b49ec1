import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import forms, ranges, text
from corpusmill.operators import frequency
from corpusmill.functions.rounding import half_even
from corpusmill.functions.shipping import ship
from corpusmill.functions.text import leading_tokens


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_tokens_and_strip_as_python(spark):
    spaces = [chr(c) for c in range(1, 0x3001) if chr(c).isspace()]
    values = ["", " a  b ", "a", *[f"{s}a{s}b{s}{s}" for s in spaces], "a​b", "᠎x"]
    assert column(spark, values, text.tokens) == [v.split() for v in values]
    assert column(spark, values, text.strip) == [v.strip() for v in values]
    assert column(spark, [None], text.tokens) == [[]]


def test_digits(spark):
    values = ["²", "①", "٣", "a", "Ⅷ", "½", "x9", "𝟗"]
    assert column(spark, values, text.has_digit) == [any(c.isdigit() for c in v) for v in values]
    assert column(spark, ["١٢", "۱۲", "१२", "12", "x"], text.to_int) == [12, 12, 12, 12, None]


def test_forms(spark):
    sample = ["قُرْآن", "عَلَى", "رَحْمَةٌ", "مُؤْمِن", "شَيْئًا", "إِلَّا", "ـا‌ب﻿­‪", "ٱلرَّحْمَٰنِ ۖ", "ۖ", "a  b"]
    want = {
        "raw": sample,
        "no_marks": ["قُرْآن", "عَلَى", "رَحْمَةٌ", "مُؤْمِن", "شَيْئًا", "إِلَّا", "ـا‌ب﻿­‪", "ٱلرَّحْمَٰنِ ", "", "a  b"],
        "no_tashkeel": ["قرآن", "على", "رحمة", "مؤمن", "شيئا", "إلا", "ـا‌ب﻿­‪", "ٱلرحمن ", "", "a  b"],
        "normalized": ["قران", "علي", "رحمه", "مومن", "شييا", "الا", "اب", "الرحمن", "", "a b"],
    }
    for name, form in forms.FORMS.items():
        assert column(spark, sample, form) == want[name], name


def test_forms_act_token_by_token(spark):
    alphabet = st.text(alphabet="ab  \nًَّٰۖۥأإآىةؤئـ‌  ", max_size=12)

    @settings(max_examples=15, deadline=None)
    @given(st.lists(alphabet, min_size=1, max_size=30))
    def check(values):
        for form in forms.FORMS.values():
            whole = column(spark, values, lambda x: text.tokens(form(x)))
            each = column(spark, values, lambda x: F.filter(F.transform(text.tokens(x), form), lambda t: t != ""))
            assert whole == each

    check()


def test_register_form(spark):
    forms.register_form("upper", F.upper)
    try:
        assert column(spark, ["aB"], forms.FORMS["upper"]) == ["AB"]
    finally:
        del forms.FORMS["upper"]


def test_row_numbers_over_ranges(spark):
    from corpusmill.functions.ranges import with_row_number

    rows = [((i * 7919) % 503 % 20, f"w{(i * 31) % 997:04d}{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "n long, w string")
    got = {(r.n, r.w): r.k for r in with_row_number(df, [("n", True), ("w", False)], "k", buckets=7).collect()}
    want = {r: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))}
    assert got == want
    assert with_row_number(df.limit(0), [("n", True), ("w", False)], "k").count() == 0


def test_half_even_on_the_binary_value(spark):
    values = [0.0000005, 0.0000015, 0.1234565, 0.1234575, 2 / 3, 1 / 7, 0.0, 1.0, None, 0.5, 1.5, -2.5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    ship(spark)
    for places in (0, 6):
        got = {r.i: r.x for r in df.select("i", half_even(F.col("v"), places).alias("x")).collect()}
        assert [got[i] for i in range(len(values))] == [None if v is None else round(v, places) for v in values]


def test_leading_tokens(spark):
    rows = [("  a b\tc d ", 2), ("a", 5), ("", 3), (None, 2), ("\u00a0x y", 1), ("a b", 2)]
    df = spark.createDataFrame(rows, "t string, n int")
    got = [r.x for r in df.select(leading_tokens(F.col("t"), F.col("n")).alias("x")).collect()]
    assert got == [(t or "").split()[:n] for t, n in rows]


def test_numbers_over_many_ranges(spark):
    df = spark.range(5000).selectExpr("id * 7919 % 5003 AS a", "concat('k\"', id % 10) AS s", "id")
    rows = ranges.with_row_number(df, [("a", True), ("s", False)], "no", buckets=700).collect()
    order = sorted(rows, key=lambda r: (-r.a, r.s))
    assert [r.no for r in order] == list(range(1, 5001))
    with pytest.raises(ValueError):
        ranges.with_row_number(df, [("s", True)], "no")
    assert ranges.with_row_number(df.limit(0), [("a", False)], "no").count() == 0


def test_form_effect_equals_forms_of_whole_texts(spark):
    """From tables of characters where they say what the form does, and from the texts where they don't."""
    texts = ["ab  \tc", " a", "b‌ ‌ c", "‌", "  ", "", "aًb ۖ d", None, "\U0001f600ـx", "a b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "unit_no long, text string")
    forms.register_form("upper", F.upper)
    forms.register_form("ends", lambda t: F.concat(t, F.lit("!")))
    try:
        for rows in (df, df.where("unit_no = 9"), df.where("text is null")):
            got = {r.form: tuple(r)[1:] for r in frequency.form_effect(rows).collect()}
            for name, form in forms.FORMS.items():
                pairs = [(r.shown, r.text) for r in rows.select("text", form(F.col("text")).alias("shown")).collect()]
                known = [(s, t) for s, t in pairs if t is not None]
                chars = sum(len(s) for s, _ in known) + len(pairs) - 1 if known else None
                removed = sum(len(t) - len(s) for s, t in known) if known else None
                assert got[name] == (chars, removed, all(s == t for s, t in known) if known else None), name
        assert frequency.form_effect(df.limit(0)).count() == 0
    finally:
        del forms.FORMS["upper"], forms.FORMS["ends"]
