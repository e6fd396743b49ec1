"""What forms do to whole texts, from tables of what they do to single characters.

A form acts character by character and may, as rule N5 does, collapse white
space and cut it from the ends. So its table over all code points, which Spark
makes once from the form itself, says how long the form of any text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import charclass as C
from ..functions.batches import CODEPOINTS, codepoints, strings
from ..functions.forms import Form

#: Characters that are looked at at once.
CHARS = 1 << 20
PROBE = " \ta  \tb  c\n"
SCHEMA = "form string, shown bigint, raw bigint, n bigint, same boolean"


class Table(NamedTuple):
    """Code points that a form changes and the lengths it gives them; whether it collapses white space."""

    form: str
    changed: list[int]
    lengths: list[int]
    collapses: bool


def tables(spark: SparkSession, forms: dict[str, Form]) -> list[Table]:
    """Of those forms that do to :data:`PROBE` what such a table says; others are left out."""
    if not forms:
        return []
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    every = spark.range(CODEPOINTS).where("id < 55296 or id > 57343").select("id", char.alias("c"))
    each = F.inline(F.array(*[F.struct(F.lit(name).alias("form"), form(F.col("c")).alias("shown")) for name, form in forms.items()]))
    rows = every.select("id", "c", each).where("shown <> c").select("form", "id", "shown").toPandas()
    probe = spark.createDataFrame([(PROBE,)], "c string").select(*[form(F.col("c")).alias(name) for name, form in forms.items()]).first()
    made = []
    for name in forms:
        mine = rows[rows["form"] == name]
        shown = dict(zip(mine["id"].tolist(), mine["shown"].tolist()))
        one = [shown.get(ord(c), c) for c in PROBE]
        collapsed = " ".join(w for w in "".join(c if c in C.SPACES else x for c, x in zip(PROBE, one)).split())
        if probe[name] in ("".join(one), collapsed):
            made.append(Table(name, list(shown), [len(x) for x in shown.values()], probe[name] != "".join(one)))
    return made


def measured(batches: Iterator[pa.RecordBatch], forms: list[Table]) -> Iterator[pa.RecordBatch]:
    """Of a task's texts and each form: characters shown and there, texts, whether all are the same."""
    lengths, changes = [], []
    for form in forms:
        length, change = np.ones(CODEPOINTS, np.int32), np.zeros(CODEPOINTS, np.bool_)
        length[form.changed], change[form.changed] = form.lengths, True
        lengths.append(length)
        changes.append(change)
    space = np.zeros(CODEPOINTS, np.bool_)
    space[[ord(c) for c in C.SPACES]] = True
    shown, same = [0] * len(forms), [True] * len(forms)
    raw = n = known = 0

    def take(texts: list[str]) -> None:
        nonlocal raw
        points = codepoints("".join(texts))
        raw += len(points)
        blank = space[points]
        unit = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
        for i, form in enumerate(forms):
            length, change = lengths[i][points], changes[i][points]
            if not form.collapses:
                shown[i] += int(length.sum())
                same[i] = same[i] and not change.any()
                continue
            # words are what is left between white space, in each text
            left = blank | (length > 0)
            gap, of = blank[left], unit[left]
            begins = ~gap
            begins[1:] &= gap[:-1] | (of[1:] != of[:-1])
            word = of[begins]
            gaps = len(word) - int(np.count_nonzero(np.r_[True, word[1:] != word[:-1]][: len(word)]))
            shown[i] += int(length[~blank].sum()) + gaps
            same[i] = same[i] and not change[~blank].any() and bool((points[blank] == 32).all()) and int(blank.sum()) == gaps

    for batch in batches:
        texts, size = [], 0
        for text in strings(batch.column(0)):
            n += 1
            if text is None:
                continue
            known += 1
            texts.append(text)
            size += len(text)
            if size >= CHARS:
                take(texts)
                texts, size = [], 0
        if texts:
            take(texts)
    if n:
        some = [x if known else None for x in shown]
        columns = [[f.form for f in forms], some, [raw if known else None] * len(forms), [n] * len(forms), [x if known else None for x in same]]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["form", "shown", "raw", "n", "same"])


def lengths_by_table(units: DataFrame, forms: list[Table]) -> DataFrame:
    """:data:`SCHEMA`: a row for each task and form."""
    return units.select("text").mapInArrow(lambda batches: measured(batches, forms), SCHEMA)
