import os
import zipfile

import pytest

from corpusmill.operators.gate import GateFailed
from corpusmill.plans import book, verify
from corpusmill.sources import csvs, docx

LINES = [
    "سورة الأولى القرآن الكريم :", "", "ا ب (1) ب لِمَ (2)",
    "سورة الثانية", "بِسْمِ الله", "الم (1) ذلك\tهذا (2) ج", "",
    "سورة الثالثة", "ن (1)",
]


def config(tmp_path, lines=LINES, expected=(2, 3, 1)):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in/book.docx").write_bytes(docx.document(lines))
    return book.Config(str(tmp_path / "in"), str(tmp_path / "out"), expected=expected, spots=((1, 2, "one"),), letters=((2, 1, "الم"), (3, 9, "ن")), without_formula=(1,))


def test_whole_run(spark, tmp_path, capsys):
    names = book.run(spark, config(tmp_path))
    out = tmp_path / "out"
    assert all((out / n).exists() for n in names)
    corpus = (out / "quran_corpus.csv").read_bytes()
    assert corpus.startswith(b"\xef\xbb\xbf") and b"\r" not in corpus
    assert corpus.decode("utf-8-sig").splitlines()[1:] == ["1,الأولى,1,ا ب", "1,الأولى,2,ب لِمَ", "2,الثانية,1,الم", "2,الثانية,2,ذلك\tهذا", "2,الثانية,3,ج", "3,الثالثة,1,ن"]
    review = (out / "review_needed.csv").read_text("utf-8-sig")
    assert "FUSED_LI_MA" in review and "TRAILING_REMAINDER_AS_FINAL_AYAH" in review and "BASMALAH_ABSENT_FROM_SOURCE" in review
    assert (out / "muqattaat_analysis.csv").read_text("utf-8-sig").splitlines()[1:] == ["2,1,الم,already a single token,1,الم", "3,9,ن,AYAH NOT FOUND,,"]
    elements = (out / "structural_elements.csv").read_text("utf-8-sig").splitlines()
    assert elements[1] == "1,الأولى,سورة الأولى القرآن الكريم :,False," and elements[2].endswith("True,بِسْمِ الله")
    assert sorted(os.listdir(out / "surah_files")) == ["001 - الأولى.csv", "002 - الثانية.csv", "003 - الثالثة.csv"]
    assert len(zipfile.ZipFile(out / "surah_files.zip").namelist()) == 3
    assert (out / "new_words_per_surah.csv").read_text("utf-8-sig").splitlines()[1] == "الأولى,3,1,3,37.5"
    report = (out / "summary_report.md").read_text("utf-8")
    assert all(f"## {i}. " in report for i in range(1, 8)) and "| **A** | 11 |" in report
    ok, lines = verify.run(spark, str(out / "quran_corpus.csv"), str(out / "quran_words_by_surah.csv"), 8, 9)
    assert ok and "done 0, pending 8, 0.00%" in lines and sum(x.startswith("next") for x in lines) == 3
    ok, lines = verify.run(spark, str(out / "quran_corpus.csv"), str(out / "surah_files/001 - الأولى.csv"), 8, 9)
    assert not ok and [x[:6] for x in lines[:9]] == ["[no] 1", "[ok] 2", "[ok] 3", "[ok] 4", "[no] 5", "[no] 6", "[ok] 6", "[ok] 7", "[ok] 8"]
    hist = (out / "frequency_distribution.csv").read_text("utf-8-sig").splitlines()
    assert hist[1] == "1,7,7" and hist[-1] == "100+,0,0" and len(hist) == 101
    capsys.readouterr()


def test_gate_stops_before_any_write(spark, tmp_path):
    with pytest.raises(GateFailed):
        book.run(spark, config(tmp_path, expected=(2, 2, 1)))
    assert not (tmp_path / "out").exists()


def test_stray_lines_stop(spark, tmp_path):
    with pytest.raises(book.Unclassified):
        book.run(spark, config(tmp_path, lines=["stray", *LINES]))


def test_office_source(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx.document(["x\ty", "", "l1\nl2"]))
    spark.dataSource.register(docx.DocxDataSource)
    for df in (spark.read.format("docx_paragraphs").load(str(tmp_path)), docx.read_docx(spark, str(tmp_path))):
        assert [r.line for r in df.orderBy("line_no").collect()] == ["x\ty", "", "l1\nl2"]


@pytest.mark.parametrize("tag", docx.REFUSED)
def test_office_guards(tag):
    import io

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{docx.W[1:-1]}"><w:p><w:r><w:{tag}/></w:r><w:r><w:t/></w:r></w:p></w:document>')
    with pytest.raises(ValueError, match=f"1 w:{tag}"):
        docx.paragraphs(data.getvalue())


def test_csv_with_and_without_mark(spark, tmp_path):
    rows = [(1, 'a "q", b', True), (2, None, False)]
    df = spark.createDataFrame(rows, "n long, t string, b boolean")
    csvs.export_csv(df.orderBy("n"), str(tmp_path / "x.csv"))
    assert (tmp_path / "x.csv").read_text("utf-8-sig") == 'n,t,b\n1,"a ""q"", b",True\n2,,False\n'
    assert [tuple(r) for r in csvs.read_csv(spark, str(tmp_path / "x.csv"), "n long, t string, b boolean").collect()] == rows
    csvs.write_csv(df, str(tmp_path / "folder"))
    assert csvs.read_csv(spark, str(tmp_path / "folder"), "n long, t string, b boolean").count() == 2
    assert csvs.preview(df.orderBy("n"), 1, "n > 1") == [(2, None, False)]


def test_stream_of_units(spark, tmp_path):
    from corpusmill import streaming

    spark.createDataFrame([(1, "a", 1, "x y x"), (1, "a", 2, "y")], streaming.UNIT_SCHEMA).write.parquet(str(tmp_path / "u"))
    q = streaming.start(streaming.running_counts(streaming.read_units(spark, str(tmp_path / "u"))), "running", str(tmp_path / "c"))
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("running").collect())) == [("x", 2, "1:1"), ("y", 2, "1:1")]


def test_ledger_gate(spark):
    good = [("a", 1, 1, 1, 2), ("b", 1, 2, 2, 1), ("c", 2, 3, 1, 1)]
    schema = "word string, group_no long, global_no long, no_in_group long, count long"
    counts = spark.createDataFrame([(4,)], "n long")
    book.check_ledger(spark.createDataFrame(good, schema), counts)
    for bad in ([*good[:2], ("b", 2, 3, 1, 1)], [*good[:2], ("c", 2, 4, 1, 1)], [*good[:2], ("c", 2, 3, 2, 1)], [*good[:2], ("c", 2, 3, 1, 9)]):
        with pytest.raises(GateFailed):
            book.check_ledger(spark.createDataFrame(bad, schema), counts)


def test_group_files_are_checked_as_they_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "b", 1), (2, "b", 3), (3, "c", 1)], "g long, name string, no long")
    with pytest.raises(GateFailed) as e:
        csvs.export_group_files(rows, str(tmp_path / "files"), "g", "name", "no", ["no"])
    assert e.value.failures == ["002 - b.csv: its numbers are not 1 to 2"]
    assert sorted(os.listdir(tmp_path / "files")) == ["001 - a.csv", "002 - b.csv"]


def test_sizes_and_summary(spark, tmp_path):
    rows = spark.createDataFrame([(g, f"n{g}", i) for g in range(1, 14) for i in range(1, g + 1)], "g long, name string, no long")
    csvs.export_group_files(rows, str(tmp_path / "files"), "g", "name", "no", ["no"])
    sizes = csvs.file_sizes(spark, str(tmp_path / "files"))
    want = {p.name: p.stat().st_size for p in (tmp_path / "files").iterdir()}
    assert {r.name: r.bytes for r in sizes.collect()} == want
    lines = csvs.export_summary(rows, ["g", "name"], sizes)
    assert lines[:4] == ["files: 13", "rows: 91", f"bytes: {sum(want.values()):,}", f"largest file: {max(want.values()):,} bytes"]
    assert lines[4] == "1  n1  1" and lines[-1] == "13  n13  13" and len(lines) == 4 + 6 + 5


def test_a_hot_group_is_dealt_to_files(spark, tmp_path):
    rows = spark.range(4000).selectExpr("if(id < 3900, 'hot', 'cold') AS g", "id AS no")
    csvs.write_partitioned(rows, str(tmp_path / "out"), "g", "no", file_rows=500)
    assert len([p for p in os.listdir(tmp_path / "out/g=hot") if p.endswith(".csv")]) > 1
    back = csvs.read_csv(spark, str(tmp_path / "out"), "no long, g string")
    assert sorted(map(tuple, back.select("g", "no").collect())) == sorted(map(tuple, rows.collect()))


def test_large_tables_go_to_a_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(csvs, "DRIVER_ROWS", 3)
    assert csvs.export(spark.range(3).toDF("n"), str(tmp_path / "small.csv")) == 3 and (tmp_path / "small.csv").is_file()
    assert csvs.export(spark.range(9).toDF("n"), str(tmp_path / "large.csv")) == 9 and (tmp_path / "large.csv").is_dir()
