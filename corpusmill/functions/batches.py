"""Text as it comes to Python in Arrow batches.

White-space tokens are what ``str.split`` returns: its 29 characters are the
class that the column functions split by.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import charclass as C
from .shipping import ship

#: Rows, and bytes, of an Arrow batch at most.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
CODEPOINTS = 0x110000


def ready_for_python(spark: SparkSession) -> None:
    """Before Python runs: the code goes to the workers, and Arrow batches are bounded in rows and bytes.

    Texts may be long, and workers have bounded memory. Spark reads the settings
    when a plan runs, after it is declared, so they stay with the session;
    smaller ones of its own are kept.
    """
    ship(spark)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        own = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(name).lower())
        if not own or int(own[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[own[2]] > most:
            spark.conf.set(name, str(most))


def strings(column: pa.Array) -> list[str | None]:
    """The values; bytes that are no UTF-8 are replaced, as the JVM does."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def marked(body: str) -> np.ndarray:
    """For every code point, whether a class body of :mod:`charclass` (ranges and single code points) has it."""
    table = np.zeros(CODEPOINTS, np.bool_)
    for first, last in re.findall(r"\\x\{([0-9A-F]+)\}(?:-\\x\{([0-9A-F]+)\})?", body):
        table[int(first, 16) : int(last or first, 16) + 1] = True
    return table


@cache
def bare_table() -> np.ndarray:
    return ~marked(C.ANNOTATION + C.VOWELS)


def bare(text: str) -> str:
    """The form ``no_tashkeel`` of one text."""
    if text.isascii():
        return text
    points = codepoints(text)
    return points[bare_table()[points]].tobytes().decode("utf-32-le")


def leading_bare_tokens(text: str | None, most: int) -> list[str]:
    """The first ``most`` tokens of the form ``no_tashkeel``; what follows them is not looked at."""
    found: list[str] = []
    rest = text or ""
    while len(found) < most and rest:
        ahead = most - len(found)
        parts = rest.split(None, ahead)
        rest = parts.pop() if len(parts) > ahead else ""
        found += [x for x in map(bare, parts) if x]
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def leading_bare(text: pd.Series, most: pd.Series) -> pd.Series:
    """:func:`leading_bare_tokens` as a column."""
    return pd.Series([leading_bare_tokens(t, int(n)) for t, n in zip(text, most)])


@F.pandas_udf(T.LongType())
def token_number(text: pd.Series) -> pd.Series:
    """How many white-space tokens each text has; none for null."""
    return pd.Series([len(t.split()) if t else 0 for t in text], dtype="int64")
