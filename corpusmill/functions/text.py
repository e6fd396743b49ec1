"""Strings and tokens: built-in expressions only, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import charclass as C


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind; only the ends are looked at."""
    return F.btrim(text, F.lit(C.SPACES))


def collapse(text: Column) -> Column:
    """White-space runs to one space (rule N5)."""
    return F.regexp_replace(text, f"[{C.SPACE}]+", " ")


def tokens(text: Column) -> Column:
    """White-space tokens; none for null and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{C.SPACE}]+"), lambda x: x != "")


def leading_tokens(text: Column, most: Column) -> Column:
    """The first ``most`` tokens; what follows them is not cut."""
    begun = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{C.SPACE}]+", "")
    return F.slice(F.filter(F.split(begun, f"[{C.SPACE}]+", (most + 1).cast("int")), lambda x: x != ""), F.lit(1), most.cast("int"))


def has_digit(text: Column) -> Column:
    return text.rlike(f"[{C.DIGIT}]")


def to_int(text: Column) -> Column:
    """A run of decimal digits as BIGINT, in Latin, Arabic-Indic or Devanagari digits; else null."""
    return F.translate(text, C.DIGITS_FROM, C.DIGITS_TO).try_cast("bigint")


def reference(group: Column, unit: Column) -> Column:
    return F.concat_ws(":", group.cast("string"), unit.cast("string"))


def codepoint(char: Column) -> Column:
    return F.ascii(char).cast("bigint")


def codepoint_label(cp: Column) -> Column:
    return F.concat(F.lit("U+"), F.lpad(F.hex(cp), F.greatest(F.lit(4), F.length(F.hex(cp))), F.lit("0")))


def display(char: Column, cp: Column) -> Column:
    """How a character shows in the inventory."""
    unseen = (cp < 0x20) | cp.between(0x200B, 0x200F) | cp.isin(0xFEFF, 0xA0, 0xAD)
    return F.when(cp == 10, "\\n").when(cp == 9, "\\t").when(cp == 32, "(space)").when(unseen, "(invisible)").otherwise(char)
