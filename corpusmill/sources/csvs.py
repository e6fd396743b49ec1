"""CSV sources and sinks.

Spark reads UTF-8 with or without a byte-order mark. For exchange with
spreadsheets the small exports are written by the driver, row by row, with the
mark, LF line ends and ``True``/``False``; data that is not known to be small
goes through Spark's writer.
"""

from __future__ import annotations

import csv
import shutil
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gate import GateFailed


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header, quoting and line ends within quotes as other tools write them."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def _cell(value: object) -> object:
    return "" if value is None else value


def export_csv(df: DataFrame, path: str) -> int:
    """One file with a byte-order mark, rows in the order of ``df``; returns the number of rows."""
    n = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow([_cell(x) for x in row])
            n += 1
    return n


#: Rows of a table that the driver writes itself.
DRIVER_ROWS = 2_000_000


def export(df: DataFrame, path: str) -> int:
    """One file as :func:`export_csv` writes it, or, for tables of more rows than a driver should pass on, a folder; returns the rows."""
    n = df.count()
    if n <= DRIVER_ROWS:
        return export_csv(df, path)
    write_csv(df, path)
    return n


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files by Spark's writer."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


#: Rows of one file of a group.
FILE_ROWS = 1_000_000


def write_partitioned(df: DataFrame, path: str, group_col: str, order_col: str, file_rows: int = FILE_ROWS) -> None:
    """A folder for each group, rows sorted, the whole target replaced.

    A group is dealt to as many files as its rows ask for, so one that holds most rows is no single task.
    """
    sizes = df.groupBy(F.col(group_col).alias("_group")).agg(F.ceil(F.count(F.lit(1)) / F.lit(file_rows)).alias("_files"))
    dealt = df.join(sizes, F.col(group_col).eqNullSafe(F.col("_group")))
    dealt = dealt.repartition(F.col(group_col), F.pmod(F.xxhash64(order_col), F.col("_files"))).drop("_group", "_files").sortWithinPartitions(group_col, order_col)
    dealt.write.mode("overwrite").partitionBy(group_col).option("maxRecordsPerFile", file_rows).option("header", True).option("escape", '"').csv(path)


def export_group_files(df: DataFrame, folder: str, group_col: str, name_col: str, order_col: str, columns: list[str]) -> list[str]:
    """One file ``NNN - name.csv`` for each group, the folder emptied first; returns the names.

    Raises ``GateFailed`` as soon as a file is written whose numbers in ``order_col`` are not 1..N.
    """
    shutil.rmtree(folder, ignore_errors=True)
    Path(folder).mkdir(parents=True)
    names, current, handle, out, numbers = [], None, None, None, []

    def close() -> None:
        if handle:
            handle.close()
            if numbers != list(range(1, len(numbers) + 1)):
                raise GateFailed([f"{names[-1]}: its numbers are not 1 to {len(numbers)}"])
            numbers.clear()

    try:
        for row in df.orderBy(group_col, order_col).toLocalIterator():
            if row[group_col] != current:
                close()
                current = row[group_col]
                safe = str(row[name_col]).replace("/", "_")
                names.append(f"{current:03d} - {safe}.csv")
                handle = open(Path(folder) / names[-1], "w", encoding="utf-8-sig", newline="")
                out = csv.writer(handle, lineterminator="\n")
                out.writerow(columns)
            out.writerow([_cell(row[c]) for c in columns])
            numbers.append(row[order_col])
        close()
    finally:
        if handle:
            handle.close()
    return names


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``(name, bytes)`` of the files of a folder; no content is read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))


def export_summary(df: DataFrame, group_cols: list[str], sizes: DataFrame, head: int = 6, tail: int = 5) -> list[str]:
    """What a console shows after an export: files, their largest and all their bytes, rows, the first and last groups."""
    files = sizes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("bytes"), F.lit(0)).alias("largest"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("all")).first()
    groups = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("rows"))
    first = groups.orderBy(*group_cols).limit(head).collect()
    last = groups.orderBy(*[F.desc(c) for c in group_cols]).limit(tail).collect()[::-1]
    shown = first + [r for r in last if r not in first]
    total = groups.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first().n
    lines = [f"files: {files.n:,}", f"rows: {total:,}", f"bytes: {files['all']:,}", f"largest file: {files.largest:,} bytes"]
    return lines + ["  ".join(map(str, r)) for r in shown]


def zip_folder(folder: str, target: str) -> int:
    """All files of a folder, deflated, by name; returns how many."""
    files = sorted(p for p in Path(folder).iterdir() if p.is_file())
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in files:
            z.write(p, p.name)
    return len(files)


def preview(df: DataFrame, n: int = 6, where: str | None = None) -> list[tuple]:
    """The first rows, optionally filtered, as a console summary shows them."""
    return [tuple(r) for r in (df.where(where) if where else df).limit(n).collect()]
