"""Parallel text forms, each a pure function of the raw text.

A form maps a string column to a string column with built-in expressions. The
four standing forms delete characters and map letters one by one and never
make white space, so a form of a text's tokens is the tokens of its form but
for tokens that vanish; :mod:`corpusmill.operators.frequency` relies on it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import charclass as C
from .text import collapse, strip

Form = Callable[[Column], Column]


def raw(text: Column) -> Column:
    return text


def no_marks(text: Column) -> Column:
    return F.regexp_replace(text, f"[{C.ANNOTATION}]", "")


def no_tashkeel(text: Column) -> Column:
    return F.regexp_replace(text, f"[{C.ANNOTATION}{C.VOWELS}]", "")


def normalized(text: Column) -> Column:
    bare = F.regexp_replace(text, f"[{C.ANNOTATION}{C.VOWELS}{C.ELONGATION}{C.ZERO_WIDTH}]", "")
    return strip(collapse(F.translate(bare, C.LETTERS_FROM, C.LETTERS_TO)))


FORMS: dict[str, Form] = {"raw": raw, "no_marks": no_marks, "no_tashkeel": no_tashkeel, "normalized": normalized}


def register_form(name: str, form: Form) -> None:
    """Adds a form for all operators that go over ``FORMS``; it must act character by character."""
    if name in FORMS:
        raise ValueError(f"there is a form {name}")
    FORMS[name] = form
