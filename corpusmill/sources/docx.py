"""Paragraphs of ``.docx`` files: a Python data source and a reader of one file's bytes.

One row a paragraph: doc (path), line_no, line. Runs are flattened in order:
text as it is, tab as a tab, a break as a line end. A file with deleted text,
symbol characters or field instructions is refused, since their text would be
lost. Each file is one partition, so a folder of files is read in parallel.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.shipping import ship

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
REFUSED = ("delText", "sym", "instrText")
SCHEMA = "doc string, line_no bigint, line string"


def paragraphs(data: bytes) -> list[str]:
    """All paragraphs of a file's bytes, in document order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    found = {k: sum(1 for _ in root.iter(W + k)) for k in REFUSED}
    if any(found.values()):
        raise ValueError("refused: " + ", ".join(f"{n} w:{k}" for k, n in found.items() if n))
    text = {W + "tab": "\t", W + "br": "\n"}
    return ["".join((x.text or "") if x.tag == W + "t" else text.get(x.tag, "") for x in p.iter()) for p in root.iter(W + "p")]


class DocxReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        p = Path(self.path)
        files = sorted(map(str, p.glob("*.docx"))) if p.is_dir() else [str(p)]
        return [InputPartition(f) for f in files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for i, line in enumerate(paragraphs(Path(partition.value).read_bytes())):
            yield partition.value, i, line


class DocxDataSource(DataSource):
    """``spark.read.format("docx_paragraphs").load(path)`` for paths that every worker can open."""

    @classmethod
    def name(cls) -> str:
        return "docx_paragraphs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DocxReader:
        return DocxReader(self.options["path"])


def document(lines: list[str]) -> bytes:
    """A minimal file whose paragraphs are ``lines``; tabs and line ends become runs of their own."""

    def run(text: str) -> str:
        for mark, tag in (("\t", "tab"), ("\n", "br")):
            if text == mark:
                return f"<w:{tag}/>"
        return f'<w:t xml:space="preserve">{escape(text)}</w:t>'

    body = "".join("<w:p><w:r>" + "".join(run(x) for x in re.split("([\t\n])", line) if x) + "</w:r></w:p>" for line in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def write_docx(lines: DataFrame, path: str) -> None:
    """``lines(doc, line_no, line)`` as one file's bytes for each doc, kept in Parquet as (doc, content).

    A document is one row by nature; its lines are put in order before Python sees them.
    """

    @F.pandas_udf("binary")
    def packed(rows: pd.Series) -> pd.Series:
        return pd.Series([document(list(x)) for x in rows], dtype=object)

    ship(lines.sparkSession)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    lines.groupBy("doc").agg(ordered.alias("lines")).select("doc", packed("lines").alias("content")).write.mode("overwrite").parquet(path)


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of what :func:`write_docx` wrote."""
    return _unpacked(spark.read.parquet(path).select("doc", "content"))


def _unpacked(files: DataFrame) -> DataFrame:
    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, data in zip(batch["doc"], batch["content"]):
                lines = paragraphs(bytes(data))
                yield pd.DataFrame({"doc": doc, "line_no": range(len(lines)), "line": lines})

    ship(files.sparkSession)
    return files.mapInPandas(unpack, SCHEMA)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """The same rows for any store that Spark reads: files come through ``binaryFile``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    return _unpacked(files.select(F.col("path").alias("doc"), "content"))
