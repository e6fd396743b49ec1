"""HTML extraction by layout-aware rendering.

A tokenizer reads tags with their attributes, text, comments and raw-text
elements; a tree builder supplies implied end tags (paragraphs, list items,
table parts, options) and drops end tags that nothing opened; visibility rules
prune head matter, scripts, styles, templates, hidden elements and comments.
The renderer emits all visible text in document order, that of form fields,
formulas and drawings too: blocks on lines of their own, an empty line around
paragraphs and headings, list items with their bullets or numbers, indented by
depth, ``pre`` as it is, and table rows with their cells padded so that the
cells of a column begin at one place, spans over columns and rows included.

Pages are rendered one by one within Arrow batches, without a shuffle. Neither
the parser nor the renderer recurses, and the parser knows where each name was
last opened, so deep and broken pages cost time in proportion.

Defined results: null is the empty page and gives the empty text; unclosed
tags, comments and attributes end with the page; unknown entities stay as
they are; elements nest to any depth; spans are read as the HTML standard
reads them (1 to 1000 columns, 65534 rows); rows repeated are rendered alike;
other columns pass through, and one named like the result is replaced.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
#: Raw elements whose entities are read.
ESCAPED = frozenset("textarea title".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes audio video canvas datalist title desc metadata defs annotation annotation-xml rp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section select summary table ul".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl figure".split())
#: Elements whose line ends and spaces are kept.
AS_IT_IS = frozenset("pre listing xmp plaintext textarea".split())
#: Types of input fields of which the value is not shown as text.
NO_VALUE = frozenset("hidden checkbox radio password file image range color".split())
#: Elements whose start ends an open paragraph.
ENDS_P = BLOCK - {"option", "optgroup", "legend", "body", "html", "frameset", "select"}
#: start tag: (what it ends, where the search for it stops)
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
_SCOPE = frozenset("table td th caption button template html".split())
#: What ends within a cell only what the cell holds, and the end tags that are not held back by it.
_CELL, _PASSES_CELL = frozenset("td th table".split()), frozenset("table tr tbody thead tfoot body html".split())
_HEAD_ONLY = frozenset("title meta link base style script noscript template head".split())
_OPEN = re.compile(r"<(?:(!--)|([!?]|/(?![a-zA-Z]))|(/?)([a-zA-Z][^\s/>]*))")
#: One attribute, or the end of the tag. A quote within an unquoted value is part of it.
_ATTRIBUTE = re.compile(r"[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"'][^\s>]*)?))?)")
_NO_COMMENT, _COMMENT_END = re.compile(r"-?>"), re.compile(r"--!?>")
_HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")
_NUMBER = re.compile(r"[ \t\n\r\f]*([+-]?[0-9]+)")


class Node:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children = name, attributes, []

    def hidden(self) -> bool:
        a = self.attributes
        return self.name in UNSEEN or bool(a) and ("hidden" in a or bool(_HIDDEN_STYLE.search(a.get("style", "")))) or self.name == "dialog" and "open" not in a

    def number(self, attribute: str, least: int, most: int, default: int) -> int:
        """An attribute's number as the HTML standard reads it, brought within bounds."""
        m = _NUMBER.match(self.attributes.get(attribute, ""))
        if not m:
            return default
        digits = m[1].lstrip("+-").lstrip("0")[:12] or "0"
        return min(most, max(least, -int(digits) if m[1][0] == "-" else int(digits)))


class Tree:
    """The open elements, and where each name was opened."""

    def __init__(self) -> None:
        self.root = Node("", {})
        self.stack = [self.root]
        self.at: dict[str, list[int]] = defaultdict(list)

    def last(self, names: set[str] | frozenset[str]) -> int:
        """Place of the innermost open element of these names; 0 if there is none."""
        return max((self.at[x][-1] for x in names if self.at.get(x)), default=0)

    def push(self, node: Node) -> None:
        self.at[node.name].append(len(self.stack))
        self.stack.append(node)

    def cut(self, i: int) -> None:
        """Ends the i-th open element and all within it."""
        while len(self.stack) > i:
            self.at[self.stack.pop().name].pop()

    def close(self, names: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        """Ends all elements of ``names`` that lie further in than the innermost of ``stop``."""
        barrier = self.last(stop)
        while (i := self.last(names)) > barrier:
            self.cut(i)

    def text(self, value: str) -> None:
        if value:
            if self.stack[-1].name == "head" and not value.isspace():
                self.cut(len(self.stack) - 1)
            self.stack[-1].children.append(html.unescape(value) if "&" in value else value)

    def end(self, name: str) -> None:
        if name == "br":
            self.stack[-1].children.append(Node("br", {}))
        elif name == "p" and not self.at.get("p"):
            self.stack[-1].children.append(Node("p", {}))
        elif (i := self.last({name})) and (name in _PASSES_CELL or i >= self.last(_CELL)):
            self.cut(i)

    def start(self, node: Node) -> None:
        """Puts the element where it belongs; whether it stays open is the tokenizer's."""
        name = node.name
        if self.stack[-1].name == "head" and name not in _HEAD_ONLY:
            self.cut(len(self.stack) - 1)
        if name in ENDS_P:
            self.close({"p"}, _SCOPE)
        if name in IMPLIED:
            self.close(*IMPLIED[name])
        if not (name in ("html", "body") and self.at.get(name)):
            self.stack[-1].children.append(node)
            if name not in VOID and name not in RAW:
                self.push(node)


def read_tag(page: str, at: int) -> tuple[dict[str, str], int]:
    """(attributes, where the tag ends) from the end of a tag's name on."""
    out: dict[str, str] = {}
    while m := _ATTRIBUTE.match(page, at):
        at = m.end()
        if m[1]:
            return out, at
        value = m[3] or m[4] or m[5] or ""
        out.setdefault(m[2].lower(), html.unescape(value) if "&" in value else value)
    return out, len(page)


def parse(page: str) -> Node:
    """Tree of ``Node`` and str; the root is a nameless node."""
    tree = Tree()
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            tree.text(page[at:])
            break
        m = _OPEN.match(page, lt)
        if not m:  # a lone "<" is text
            tree.text(page[at : lt + 1])
            at = lt + 1
            continue
        tree.text(page[at:lt])
        at = m.end()
        comment, other, slash, name = m.groups()
        if comment:
            end = _NO_COMMENT.match(page, at) or _COMMENT_END.search(page, at)
            at = end.end() if end else n
        elif other:
            end = page.find(">", at)
            at = n if end < 0 else end + 1
        elif slash:
            _, at = read_tag(page, at)
            tree.end(name.lower())
        else:
            node = Node(name.lower(), {})
            node.attributes, at = read_tag(page, at)
            tree.start(node)
            if node.name in RAW:
                end = None if node.name == "plaintext" else re.compile(rf"</{re.escape(node.name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                held = page[at : end.start() if end else n]
                node.children.append(html.unescape(held) if node.name in ESCAPED else held)
                at = end.end() if end else n
    return tree.root


class Page:
    """Lines under construction: ``gap`` is how many line ends must precede the next text."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.parts: list[str] = []
        self.spaced, self.gap, self.indent, self.lead = False, 0, "", ""

    def text(self, value: str) -> None:
        value = _SPACES.sub(" ", value)
        if not self.parts or self.spaced:
            value = value.removeprefix(" ")
        if value:
            self.parts.append(value)
            self.spaced = value.endswith(" ")

    def end(self, gap: int = 1) -> None:
        """Ends the line; ``gap`` 2 leaves an empty line before the next one."""
        line = "".join(self.parts).rstrip(" ")
        if line:
            self.put(line)
        self.parts, self.spaced = [], False
        self.gap = max(self.gap, gap)

    def line_break(self) -> None:
        """Ends the line, or leaves it empty."""
        if self.parts:
            self.end()
        else:
            self.gap += 1

    def put(self, line: str) -> None:
        if self.out:
            self.out.extend([""] * (self.gap - 1))
        self.gap = 1
        lead, self.lead = self.lead, ""
        self.out.append(((lead or self.indent) + line).rstrip(" "))


#: A step of the renderer: it yields the steps to be taken before it goes on.
Step = Iterator["Step"]


def render(page: str | None) -> str:
    """All visible text of a page."""
    to = Page()
    steps = [_children(parse(page or ""), to, 0)]
    while steps:
        inner = next(steps[-1], None)
        if inner is None:
            steps.pop()
        else:
            steps.append(inner)
    to.end()
    return "\n".join(to.out)


def _children(node: Node, to: Page, depth: int) -> Step:
    for child in node.children:
        if isinstance(child, str):
            to.text(child)
        elif not child.hidden():
            yield _element(child, to, depth)


def _element(node: Node, to: Page, depth: int) -> Step:
    name = node.name
    if name == "br":
        to.line_break()
    elif name == "hr":
        to.end(2)
    elif name == "img":
        to.text(node.attributes.get("alt", ""))
    elif name == "input":
        kind = node.attributes.get("type", "").lower()
        to.text(node.attributes.get("alt" if kind == "image" else "value", "") if kind == "image" or kind not in NO_VALUE else "")
    elif name in AS_IT_IS:
        gap = 1 if name == "textarea" else 2
        to.end(gap)
        lines = _plain(node).split("\n")
        lines = lines[1:] if not lines[0] else lines
        for line in lines[:-1] if lines and not lines[-1] else lines:
            to.put(line)
        to.end(gap)
    elif name == "table":
        to.end(2)
        yield _table(node, to, depth)
        to.end(2)
    else:
        gap = 2 if name in SPACED and not (name in ("ul", "ol") and depth) else 1
        if name in BLOCK:
            to.end(gap)
        if name in ("ul", "ol", "menu", "dir"):
            yield _list(node, to, depth)
        elif name == "dd":
            kept, to.indent = to.indent, to.indent + "  "
            yield _children(node, to, depth)
            to.end()
            to.indent = kept
        else:
            yield _children(node, to, depth)
        if name in BLOCK:
            to.end(gap)


def _list(node: Node, to: Page, depth: int) -> Step:
    number = node.number("start", -(10**9), 10**9, 1)
    for child in node.children:
        if isinstance(child, str):
            to.text(child)
        elif child.hidden():
            continue
        elif child.name == "li":
            to.end()
            number = child.number("value", -(10**9), 10**9, number)
            mark = f"{number}. " if node.name == "ol" else "- "
            number += 1
            kept = to.indent
            to.lead, to.indent = kept + mark, kept + " " * len(mark)
            yield _children(child, to, depth + 1)
            to.end()
            to.lead, to.indent = "", kept
        else:
            yield _element(child, to, depth)
    to.end()


def _plain(node: Node) -> str:
    out, steps = [], [iter(node.children)]
    while steps:
        child = next(steps[-1], None)
        if child is None:
            steps.pop()
        elif isinstance(child, str):
            out.append(child)
        elif child.name == "br":
            out.append("\n")
        elif not child.hidden():
            steps.append(iter(child.children))
    return "".join(out)


class Grid:
    """Cells of a table: rows of (column, lines)."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, list[str]]]] = []
        self.free = 0
        #: (first column, column after the last, row after the last) of cells from the rows above, by column.
        self.above: list[tuple[int, int, int]] = []
        self.next_above: list[tuple[int, int, int]] = []
        self.seen = 0

    def row(self) -> None:
        self.rows.append([])
        self.free = self.seen = 0
        here = len(self.rows) - 1
        if self.next_above:
            merged: list[tuple[int, int, int]] = []
            for a in sorted(x for x in self.above + self.next_above if x[2] > here):
                if merged and merged[-1][1:] == (a[0], a[2]):
                    a = (merged.pop()[0], a[1], a[2])
                merged.append(a)
            self.above, self.next_above = merged, []

    def cell(self, lines: list[str], columns: int, rows: int) -> None:
        if not self.rows:
            self.row()
        here = len(self.rows) - 1
        while self.seen < len(self.above) and self.above[self.seen][0] <= self.free:
            _, end, until = self.above[self.seen]
            self.free = max(self.free, end) if until > here else self.free
            self.seen += 1
        self.rows[-1].append((self.free, lines))
        if rows > 1:
            self.next_above.append((self.free, self.free + columns, here + rows))
        self.free += columns

    def lines(self) -> Iterator[str]:
        """The rows as text: the cells of a column begin at one place."""
        apart: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for row in self.rows:
            for (a, held), (b, _) in zip(row, row[1:]):
                apart[b].append((a, 2 + max(map(len, held))))
        begins, least = {}, 0
        for column in sorted({c for row in self.rows for c, _ in row}):
            least = begins[column] = max([least, *(begins[a] + width for a, width in apart[column])])
        for row in self.rows:
            for k in range(max((len(held) for _, held in row), default=0)):
                line, length = [], 0
                for column, held in row:
                    if k < len(held):
                        line.append(" " * (begins[column] - length) + held[k])
                        length = begins[column] + len(held[k])
                yield "".join(line).rstrip(" ")


def _table(node: Node, to: Page, depth: int) -> Step:
    grid = Grid()

    def walk(x: Node) -> Step:
        for c in x.children:
            if isinstance(c, str):
                if not c.isspace():
                    to.text(c)
            elif c.hidden():
                continue
            elif c.name == "caption":
                to.end()
                yield _children(c, to, depth)
                to.end()
            elif c.name in ("tbody", "thead", "tfoot", "colgroup"):
                yield walk(c)
            elif c.name == "tr":
                grid.row()
                yield walk(c)
            elif c.name in ("td", "th"):
                inner = Page()
                yield _children(c, inner, 0)
                inner.end()
                # 0 rows: to the last
                rows = c.number("rowspan", 0, 65534, 1) or 65534
                grid.cell([x for x in inner.out if x] or [""], c.number("colspan", 1, 1000, 1), rows)
            elif c.name != "col":
                yield _element(c, to, depth)

    yield walk(node)
    to.end()
    for line in grid.lines():
        if line:
            to.put(line)


def extract(df: DataFrame, html_col: str = "html", out: str = "rendered") -> DataFrame:
    """``df`` with the string column ``out``."""

    common.ready_for_python(df.sparkSession)

    @F.pandas_udf("string")
    def rendered(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in parts:
            yield pd.Series([render(x) for x in pages], dtype=object)

    return df.withColumn(out, rendered(df[html_col].cast("string")))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(common.table(spark, sf_dir, "pages").select("page_id", "html"))
    lines = F.split("rendered", "\n")
    return found.select(
        "page_id",
        F.col("rendered").alias("text"),
        F.length("rendered").cast("long").alias("n_chars"),
        F.when(F.col("rendered") == "", 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
    )


QUERIES = {"op5_html_extraction": op5_html_extraction}
ORACLE_SQL: dict[str, str] = {}
