import pyarrow as pa

from corpusmill.functions import batches
from corpusmill.functions import charclass as C
from corpusmill.operators import lexicon, structure
from corpusmill.plans import fixed_tables as T

UNITS = "group_no long, group_name string, unit_no long, text string"


def test_gate_shadows_lexicon(spark):
    units = spark.createDataFrame(
        [
            (1, "a", 1, "لِمَ لَمْ مِمَّا هَذَا"),
            (1, "a", 2, "مَالِ مَالٌ إِلَّا إِلًّا"),
            (1, "a", 3, "لِمَ ۖ"),  # a mark alone: the whole unit is skipped
            (2, "b", 1, "لِئَلَّا أَلَا أَلَّا"),
        ],
        UNITS,
    )
    lex = lexicon.lexicon_table(spark, T.JOINED_FORMS + (("لم", "NEVER", "a + b"),))
    flags = lexicon.flag_tokens(units, lex, lexicon.gate_table(spark)).cache()
    rows = lexicon.fused_review(flags).orderBy("surah_number", "ayah_number", "pos").collect()
    assert [(r.reference, r.rule, r.implied_extra_tokens_if_split) for r in rows] == [
        ("1:1", "FUSED_LI_MA", 1), ("1:1", "FUSED_MIN_MA", 1), ("1:1", "FUSED_HA_DEM", 1), ("1:2", "FUSED_MA_LI", 1), ("1:2", "FUSED_IN_LA", 1),
        ("2:1", "FUSED_LI_AN_LA", 2), ("2:1", "PARTICLE_A_LA", 1), ("2:1", "FUSED_AN_LA", 1),
    ]
    assert rows[6].ambiguity_note.startswith("CONTESTED") and rows[0].action_taken == T.NO_ACTION
    assert {r.token_no_tashkeel: r["count"] for r in lexicon.gate_rejected(flags).collect()} == {"لم": 1, "مال": 1, "إلا": 1}


def test_opening_letters(spark):
    units = spark.createDataFrame(
        [(1, "a", 1, "الم ذلك"), (2, "b", 1, "ا لم ذ ك"), (3, "c", 1, "المص"), (4, "d", 1, "ا ل"), (5, "e", 1, ""), (6, "f", 1, "حم"), (6, "f", 2, "ع س ق ب")],
        UNITS,
    )
    wanted = [(1, 1, "الم"), (2, 1, "الم"), (3, 1, "الم"), (4, 1, "الم"), (5, 1, "الم"), (6, 1, "حم"), (6, 2, "عسق"), (7, 1, "ن")]
    letters = spark.createDataFrame(wanted, "surah long, ayah long, letters string")
    rows = lexicon.opening_letters(units, letters).orderBy("surah", "ayah").collect()
    assert [(r.status, r.tokens_spanned, r.surface) for r in rows] == [
        ("already a single token", 1, "الم ذلك"),
        ("written as 2 separate tokens", 2, "ا لم ذ"),
        ("NOT MATCHED at ayah start", -1, "المص"),
        ("written as 2 separate tokens", 2, "ا ل"),  # tokens run out: kept as the standing definition has it
        ("NOT MATCHED at ayah start", 0, ""),
        ("already a single token", 1, "حم"),
        ("written as 3 separate tokens", 3, "ع س ق"),
        ("AYAH NOT FOUND", None, ""),
    ]
    strict = lexicon.opening_letters(units, letters, strict=True).orderBy("surah", "ayah").collect()
    assert strict[3].status == "NOT MATCHED at ayah start"


def test_definitions(spark):
    units = spark.createDataFrame([(1, "a", 1, "ا لم ذلك"), (1, "a", 2, "لِمَ لَمْ")], UNITS)
    elements = spark.createDataFrame([("سورة أ", True, "بسم الله"), ("سورة ب", False, "")], "header_raw string, basmalah_present boolean, basmalah_text_raw string")
    letters = spark.createDataFrame([(1, 1, "الم")], "surah long, ayah long, letters string")
    flags = lexicon.flag_tokens(units, lexicon.lexicon_table(spark), lexicon.gate_table(spark))
    rows = lexicon.definitions(units, elements, lexicon.opening_letters(units, letters), flags).collect()
    cells = {(r.definition, r.component): r.value for r in rows}
    assert [cells[d, "total"] for d in "ABCD"] == [7, 5, 4, 5]
    assert cells["D", "homographs_suppressed_by_vocalization_gate"] == 2 and cells["D", "hypothetical_total_if_all_split"] == 6
    assert cells["context", "surah_header_tokens_excluded"] == 4


def test_skeletons_and_leading_tokens_in_batches():
    """Places of wanted skeletons in units whose tokens all keep a character; leading tokens without reading on."""
    texts = ["aًb c a", "c ً c", None, "", " c\x1cx c"]
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, pa.array(["g"] * len(texts)), ids, pa.array(texts)], ["group_no", "group_name", "unit_no", "text"])
    (found,) = lexicon.with_skeletons(iter([batch]), frozenset(["ab", "c"]))
    got = [(r["unit_no"], r["pos"], r["token_raw"], r["token_no_tashkeel"]) for r in found.to_pylist()]
    assert got == [(0, 0, "aًb", "ab"), (0, 1, "c", "c"), (4, 0, "c", "c"), (4, 2, "c", "c")]
    for text in ("ً aٰ ۖ b  c\td ", "a", " ً ", "", None):
        for most in (0, 1, 2, 3, 9):
            assert batches.leading_bare_tokens(text, most) == batches.bare(text or "").split()[:most]


def test_lines_of_any_length_are_classified(spark):
    """What is no header or formula by its length isn't searched; white space of every kind is cut from the ends."""
    head, formula = T.HEADER_WORD, T.FORMULA_WORD
    texts = [f" {head} a\x1c", f"{formula} b　", head + "x" * 80, formula + " " + "y" * 50, "  ", f"{head} 1", f"{head} ً" + "z" * 40]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc long, line_no long, line string")
    rows = structure.classify(lines).orderBy("line_no").collect()
    assert [(r.line, r.kind, r.block_no) for r in rows] == [(t.strip(), k, b) for t, k, b in zip(texts, ["header", "formula", "body", "body", "blank", "body", "header"], [1, 1, 1, 1, 1, 1, 2])]
    long = structure.classify(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "btrim" in long or "trim(" in long
    assert f"^[{C.SPACE}]+|" not in long
