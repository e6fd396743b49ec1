"""Markdown report over the metrics of a run.

Everything the report shows is computed by the operators; the driver receives
aggregates and top lists of fixed size and renders them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.forms import FORMS
from ..operators import frequency, inventory
from . import fixed_tables as T


@dataclass
class Relations:
    """What a run has made, before it is rendered."""

    title: str
    units: DataFrame
    structural: DataFrame
    counts: DataFrame
    definitions: DataFrame
    codepoints: DataFrame
    rejected: DataFrame
    trailing: DataFrame
    census: DataFrame


def table(head: list[str], rows: list[list[object]], right: set[int] | None = None) -> list[str]:
    marks = ["---:" if i in (right or set()) else "---" for i in range(len(head))]
    return ["| " + " | ".join(head) + " |", "|" + "|".join(marks) + "|", *["| " + " | ".join(map(str, r)) + " |" for r in rows], ""]


def _shown(n: int) -> str:
    return f"{n:,}"


def corpus_section(r: Relations) -> list[str]:
    one = r.units.agg(F.count_distinct("group_no").alias("groups"), F.count(F.lit(1)).alias("units")).first()
    formulas = r.structural.where("basmalah_present").count()
    return ["## 1. Corpus", "", *table(["Metric", "Value"], [["Groups", _shown(one.groups)], ["Units", _shown(one.units)], ["Standalone opening formulas", _shown(formulas)]], {1})]


def orthography_section(r: Relations) -> list[str]:
    seen = inventory.watched(r.codepoints, T.WATCHED_CODEPOINTS).collect()
    effect = {x.form: x for x in frequency.form_effect(r.units).collect()}
    rows = [[f"`{f}`", _shown(effect[f].chars), _shown(effect[f].chars_removed_vs_raw), "no-op" if effect[f].identical_to_raw and f != "raw" else ""] for f in FORMS if f in effect]
    return [
        "## 2. Orthography and code points", "",
        *table(["Watched code point", "Name", "Occurrences"], [[x.codepoint, unicodedata.name(chr(int(x.codepoint[2:], 16)), inventory.UNNAMED), _shown(x["count"])] for x in seen], {2}),
        *table(["Form", "Characters", "Removed vs raw", "Note"], rows, {1, 2}),
    ]


def definitions_section(r: Relations) -> list[str]:
    cells = {(x.definition, x.component): x.value for x in r.definitions.collect()}
    totals = [[f"**{d}**", _shown(cells[d, "total"])] for d in "ABCD"]
    parts = [[d, f"`{c}`", _shown(v)] for (d, c), v in cells.items() if c != "total"]
    held = [[f"`{x.token_no_tashkeel}`", _shown(x["count"])] for x in r.rejected.orderBy(F.desc("count"), "first_ord").collect()]
    deltas = [
        ["A - B: standalone opening formulas", _shown(cells["A", "total"] - cells["B", "total"])],
        ["B - C: opening letters merged", _shown(cells["B", "total"] - cells["C", "total"])],
        ["joined forms, if they were split (not applied)", "+" + _shown(cells["D", "hypothetical_extra_tokens"])],
    ]
    return [
        "## 3. Word counts under four definitions", "", *table(["Definition", "Words"], totals, {1}), *table(["Definition", "Component", "Value"], parts, {2}),
        "### Homographs that the surface gate held back", "", *table(["Skeleton", "Occurrences"], held, {1}),
        "## 4. Where the totals differ", "", *table(["Source of variation", "Tokens"], deltas, {1}),
    ]


def frequency_section(r: Relations) -> list[str]:
    totals = {x.form: x for x in frequency.form_totals(r.counts).collect()}
    rows = [[f"`{f}`", _shown(t.tokens), _shown(t.types), _shown(t.hapax), f"{t.type_token_ratio:.5f}"] for f in FORMS if (t := totals.get(f))]
    words = {f: frequency.word_table(r.counts, f) for f in ("normalized", "raw")}
    best = [[i + 1, x.word, _shown(x["count"]), x.first_occurrence, x.number_of_distinct_surahs] for i, x in enumerate(frequency.top(words["normalized"], 20).collect())]
    rollup = {x.band: x for x in frequency.histogram_rollup(words["normalized"]).collect()}
    bands = [[f"{b}×", _shown(rollup[b].distinct_word_types), _shown(rollup[b].tokens_accounted), f"{100 * rollup[b].type_share:.1f}", f"{100 * rollup[b].token_share:.1f}"] for b in [*map(str, range(1, 11)), "11-99", "100+"]]
    out = ["## 5. Frequency", "", *table(["Form", "Tokens", "Types", "Hapax", "Type/token"], rows, {1, 2, 3, 4})]
    out += ["### Top 20, form `normalized`", "", *table(["#", "Word", "Count", "First", "Groups"], best, {0, 2, 4})]
    out += ["### Distribution", "", *table(["Occurrences", "Types", "Tokens", "% of types", "% of tokens"], bands, {1, 2, 3, 4})]
    for f, longest in (("normalized", True), ("normalized", False), ("raw", True), ("raw", False)):
        found = [[x.word, x.character_length, x["count"], x.first_occurrence] for x in frequency.by_length(words[f], 10, longest).collect()]
        out += [f"### {'Longest' if longest else 'Shortest'} words, form `{f}`", "", *table(["Word", "Chars", "Count", "First"], found, {1, 2})]
    groups = frequency.top_groups(frequency.group_statistics(r.units, r.counts)).collect()
    rows = [[x.surah_number, x.surah_name, x.ayah_count, _shown(x.words_normalized), _shown(x.unique_normalized), f"{x.density_normalized:.4f}"] for x in groups]
    return [*out, "### Largest groups", "", *table(["#", "Group", "Units", "Words", "Unique", "Density"], rows, {0, 2, 3, 4, 5})]


def caveats_section(r: Relations) -> list[str]:
    found = [f"- Unit {x.inferred_ayah_number} of group {x.group_no}: its closing marker is missing; boundary as expected: {'yes' if x.boundary_matches else 'no'}." for x in r.trailing.orderBy("group_no", "inferred_ayah_number").toLocalIterator()]
    found += [f"- Group {x.group_no}: its opening formula is absent from the source and was not reconstructed." for x in r.census.where("anomalous").orderBy("group_no").toLocalIterator()]
    conventions = [
        "- The letter map of `normalized` is a convention: it merges types and changes no token total.",
        "- Header lines and markers are no tokens; tokens are white-space runs and nothing is stemmed or split.",
    ]
    return ["## 6. Conventions and anomalies of the source", "", *conventions, *found, ""]


def verified_section(r: Relations) -> list[str]:
    lines = [
        "- Verified: the gate passed (groups, units, counts, sequences, no markup, no empty units); no deleted text, symbols or field codes in the source.",
        "- Assumed: the table of expected counts, inferred boundaries, the list of joined forms and the letter map.",
    ]
    return ["## 7. Verified and assumed", "", *lines, ""]


SECTIONS: tuple[Callable[[Relations], list[str]], ...] = (corpus_section, orthography_section, definitions_section, frequency_section, caveats_section, verified_section)


def render(r: Relations) -> str:
    lines = [f"# {r.title}", "", "Each figure follows from a named rule; where definitions compete, all are given.", ""]
    for section in SECTIONS:
        lines += section(r)
    return "\n".join(lines)
