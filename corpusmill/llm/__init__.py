"""Training-data operators: queries and SQL of the ten operators and the pipeline."""

from __future__ import annotations

from importlib import import_module

#: Modules in the order of the operators 1 to 10.
MODULES = ("fingerprints", "language_id", "bpe", "exact_dedup", "html_text", "mixing", "token_counts", "url_filter", "simhash", "quality")


def queries() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= import_module(f"{__name__}.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= import_module(f"{__name__}.{name}").ORACLE_SQL
    return out
