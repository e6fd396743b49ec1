"""Rounding to a number of places, half to even on the exact binary value of a double."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column, places: int) -> Column:
    """Null stays null. Spark's own functions round the shortest decimal that reads as the double, so ties differ."""

    @F.pandas_udf("double")
    def rounded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in parts:
            yield pd.Series([None if x is None or x != x else round(float(x), places) for x in values], dtype="float64")

    return rounded(value)
