"""Document quality from a linear-chain conditional random field over lines.

Every non-blank line of a document is a node with two states, bad and good.
Its features are statistics of the line (symbols, capitals, digits, repeated
words, word and line lengths, ...), cut into bins, together with the bins of
the line before and the line after it; a 2x2 transition weight ties the chain.
Only documents are labelled: at first each line carries its document's label,
then, in ``ROUNDS`` rounds of expectation and maximisation, the labels of lines
are hidden, the document's label is evidence of the odds ``EVIDENCE`` for each,
and weights and transitions are fitted to the expected labels. The document's quality is the mean of the forward-backward marginals for good,
weighted by line length, on the log-odds scale calibrated on the training
documents (a, b) so that it reads as a probability.

The field is fitted on the driver from a bounded sample of rows: labelled
documents with the least hashes of their identifiers, half of each label, at
most ``MAX_TRAIN`` documents and ``MAX_CHARS`` characters in all; documents of
more than ``MAX_LINES`` lines aren't taken. Their whole texts are read. Scoring
reads every whole text; lines are counted batch by batch with vectorised byte
classes and all chains of a batch advance together. No shuffle.

Defined results: null, empty and blank texts have no line and get the
calibrated prior of such texts (that of no evidence); with no labelled rows
every score is 0.5; rows repeated with one identifier score alike; label rows
repeated for one document count once by their least label; labels other than
0 and 1 are ignored; other columns pass through, and one named like the result
is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAX_TRAIN, MAX_CHARS, MAX_LINES = 1600, 48_000_000, 2_000
#: Rounds in which line labels are hidden, and what a document's label says of each of its lines.
ROUNDS, EVIDENCE = 2, 9.0
THRESHOLD = 0.3
#: Upper bounds of the bins of each line statistic; the bins are one-hot features.
BINS = {
    "symbols": (0.001, 0.02, 0.06, 0.12, 0.2, 0.3),
    "marks": (0.01, 0.03, 0.06, 0.12, 0.2),
    "capitals": (0.001, 0.03, 0.08, 0.2, 0.5, 0.8),
    "digits": (0.001, 0.03, 0.1, 0.3),
    "repeats": (0.001, 0.1, 0.25, 0.4, 0.6, 0.8, 0.9),
    "echoes": (0.001, 0.05, 0.2, 0.5, 0.8),
    "pipes": (0.001, 0.02, 0.05, 0.1),
    "word": (2.5, 3.5, 4.5, 5.5, 6.5, 8.0, 12.0),
    "chars": (6, 15, 40, 100, 200, 400, 1000),
    "same": (0.001, 0.1, 0.3, 0.6, 0.9),
}
WIDTH = sum(len(b) + 1 for b in BINS.values())
_OFFSETS = np.cumsum([0, *[len(b) + 1 for b in BINS.values()]])[:-1]
#: Byte classes: 0 other, 1 small letter or byte over 127, 2 capital, 3 digit, 4 white space, 5 mark, 6 symbol, 7 pipe.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 6
_CLASS[ord("|")] = 7
#: Characters of one pass over a batch.
BATCH_BYTES = 4 << 20


def lines_of(text: str | None) -> list[bytes]:
    return [x for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n") if x and not x.isspace()]


def line_bins(lines: list[bytes], firsts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (lines x statistics) and line lengths; ``firsts``: where a document begins."""
    n = len(lines)
    lengths = np.fromiter(map(len, lines), np.int64, n)
    # capitals beyond ASCII (C3 80-9E and the like) count as letters only
    classes = _CLASS[np.frombuffer(b"".join(lines), np.uint8)]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    count = [np.add.reduceat((classes == k).astype(np.int32), starts) for k in range(8)]
    words = [x.split() for x in lines]
    n_words = np.fromiter(map(len, words), np.int64, n)
    distinct = np.fromiter((len(set(w)) for w in words), np.int64, n)
    echoes = np.fromiter((sum(map(eq, w, islice(w, 1, None))) for w in words), np.int64, n)
    letters = np.maximum(1, count[1] + count[2])
    solid = np.maximum(1, lengths - count[4])
    seen: dict[bytes, int] = {}
    same = np.zeros(n, np.int64)
    begins = set(firsts)
    for i, x in enumerate(lines):
        if i in begins:
            seen = {}
        same[i] = x in seen
        seen[x] = 1
    stats = {
        "symbols": count[6] / solid,
        "marks": count[5] / solid,
        "capitals": count[2] / letters,
        "digits": count[3] / solid,
        "repeats": 1 - distinct / np.maximum(1, n_words),
        "echoes": echoes / np.maximum(1, n_words),
        "pipes": count[7] / solid,
        "word": solid / np.maximum(1, n_words),
        "chars": lengths,
        "same": same,
    }
    cells = [np.searchsorted(np.array(BINS[k]), v, side="right") + o for (k, v), o in zip(stats.items(), _OFFSETS)]
    return np.stack(cells, 1), lengths


class Field:
    """Weights of the chain: ``w`` (before, own, after x cells) for good against bad, ``t`` 2x2, ``ends`` 2x2."""

    def __init__(self) -> None:
        self.w = np.zeros((3, WIDTH))
        self.bias = 0.0
        self.t = np.zeros((2, 2))
        self.a, self.b, self.empty = 1.0, 0.0, 0.5
        self.fitted = False

    def potentials(self, cells: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log-odds of good for each line by its own and its neighbours' features."""
        own = self.w[1][cells].sum(1) + self.bias
        before, after = np.zeros(len(cells)), np.zeros(len(cells))
        before[1:] = self.w[0][cells[:-1]].sum(1)
        after[:-1] = self.w[2][cells[1:]].sum(1)
        before[begin] = 0
        after[end] = 0
        return own + before + after

    def marginals(self, odds: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and the 2x2 pair marginals summed over all chains.

        All chains of a batch step together, longest first, in the ratio form
        of the two-state forward and backward recursions.
        """
        order = np.argsort(-sizes, kind="stable")
        first, length = begin[order], sizes[order]
        alive = np.searchsorted(-length, -np.arange(length[0]) - 1, side="right")  # chains longer than t
        t00, t01, t10, t11 = np.exp(self.t).ravel()
        e = np.exp(np.clip(odds, -30, 30))
        f = np.empty(len(odds))  # forward P(good) : P(bad) as a share
        x = e[first] / (1 + e[first])
        f[first] = x
        for t in range(1, length[0]):
            k = alive[t]
            at = first[:k] + t
            p = x[:k]
            good, bad = (p * t11 + (1 - p) * t01) * e[at], p * t10 + (1 - p) * t00
            x = good / (good + bad)
            f[at] = x
        g = np.full(len(odds), 0.5)  # backward message, as a share
        pairs = np.zeros((2, 2))
        for t in range(length[0] - 2, -1, -1):
            k = alive[t + 1]
            at = first[:k] + t
            nxt = at + 1
            q1, q0 = g[nxt] * e[nxt], 1 - g[nxt]
            p = f[at]
            joint = np.stack([(1 - p) * t00 * q0, (1 - p) * t01 * q1, p * t10 * q0, p * t11 * q1])
            pairs += (joint / joint.sum(0)).sum(1).reshape(2, 2)
            good, bad = t11 * q1 + t10 * q0, t01 * q1 + t00 * q0
            g[at] = good / (good + bad)
        m = f * g
        return m / (m + (1 - f) * (1 - g)), pairs

    def document_means(self, texts: list[str | None]) -> np.ndarray:
        """Length-weighted mean marginal of each text; nan without lines."""
        docs = [lines_of(t) for t in texts]
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        out = np.full(len(docs), np.nan)
        has = np.nonzero(sizes)[0]
        if not len(has):
            return out
        sizes = sizes[has]
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        lines = [x for d in docs for x in d]
        cells, lengths = line_bins(lines, begin.tolist())
        p, _ = self.marginals(self.potentials(cells, begin, begin + sizes - 1), begin, sizes)
        out[has] = np.add.reduceat(p * lengths, begin) / np.add.reduceat(lengths, begin)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.fitted:
            return np.full(len(texts), 0.5)
        mean = self.document_means(texts)
        odds = self.a * _logit(np.nan_to_num(mean, nan=0.5)) + self.b
        return np.where(np.isnan(mean), self.empty, 1 / (1 + np.exp(-odds)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 0.002, 0.998)
    return np.log(p / (1 - p))


def train(texts: list[str], labels: np.ndarray, steps: int = 120, l2: float = 2e-3, rate: float = 0.5) -> Field:
    """Maximum conditional likelihood by Adagrad, then rounds with hidden line labels."""
    field = Field()
    kept = [(lines_of(t), y) for t, y in zip(texts, labels)]
    kept = [(d, y) for d, y in kept if d]
    if not kept or len({y for _, y in kept}) < 2:
        return field
    sizes = np.array([len(d) for d, _ in kept])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    end = begin + sizes - 1
    y_doc = np.array([y for _, y in kept], float)
    y = np.repeat(y_doc, sizes)
    cells, _ = line_bins([x for d, _ in kept for x in d], begin.tolist())
    n = len(y)
    inside = np.ones(n, bool)
    inside[begin] = False
    followed = np.ones(n, bool)
    followed[end] = False

    def climb(target: np.ndarray, target_pairs: np.ndarray, steps: int) -> None:
        grads = [np.zeros((3, WIDTH)) + 1e-6, 1e-6, np.zeros((2, 2)) + 1e-6]
        for _ in range(steps):
            p, pairs = field.marginals(field.potentials(cells, begin, end), begin, sizes)
            d = (target - p) / n
            gw = np.stack(
                [
                    sum(np.bincount(cells[:-1][inside[1:], k], d[1:][inside[1:]], WIDTH) for k in range(cells.shape[1])),
                    sum(np.bincount(cells[:, k], d, WIDTH) for k in range(cells.shape[1])),
                    sum(np.bincount(cells[1:][followed[:-1], k], d[:-1][followed[:-1]], WIDTH) for k in range(cells.shape[1])),
                ]
            ) - l2 * field.w
            gt = (target_pairs - pairs) / n - l2 * field.t
            gb = d.sum()
            grads[0] += gw**2
            grads[1] += gb**2
            grads[2] += gt**2
            field.w += rate * gw / np.sqrt(grads[0])
            field.bias += rate * gb / np.sqrt(grads[1])
            field.t += rate * gt / np.sqrt(grads[2])

    # at first the observed pairs: labels do not change within a document
    climb(y, np.diag([((sizes - 1) * (y_doc == k)).sum() for k in (0, 1)]).astype(float), steps)
    shift = math.log(EVIDENCE) * (2 * y - 1)
    for _ in range(ROUNDS):
        climb(*field.marginals(field.potentials(cells, begin, end) + shift, begin, sizes), steps // 3)
    field.fitted = True
    # calibration: one logistic line from the mean marginal to the label
    mean = field.document_means(texts)
    ok = ~np.isnan(mean)
    x, target = _logit(mean[ok]), np.asarray(labels, float)[ok]
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-4)
        g = np.array([((target - p) * x).mean() - 1e-3 * a, (target - p).mean() - 1e-3 * b])
        h = np.array([[(w * x * x).mean() + 1e-3, (w * x).mean()], [(w * x).mean(), w.mean() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = max(0.05, a + step[0]), b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    field.a, field.b = float(a), float(b)
    field.empty = float(1 / (1 + np.exp(-b)))
    return field


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> Field:
    """Fit on at most ``max_train`` of the labelled documents, half of each label where there are as many."""
    label = labels[label_col].cast("int")
    known = labels.select(labels[id_col].alias("i"), label.alias("y")).where("i is not null and y in (0, 1)").groupBy("i").agg(F.min("y").alias("y"))
    known = common.cut(known)
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    known = common.cut(common.least_hashes(known, "y", F.col("i"), counts, max_train // 2))
    # about 3 * max_train identifiers, so a broadcast of bounded size
    rows = docs.select(docs[id_col].alias("doc"), docs[text_col].cast("string").alias("t")).join(F.broadcast(known), F.col("doc") == F.col("i"))
    rows = rows.where(F.regexp_count("t", F.lit("\n")) < MAX_LINES).groupBy("doc", "y", "_unit").agg(F.max("t").alias("t"))
    order = Window.partitionBy("y").orderBy("_unit", "doc")
    taken = rows.withColumn("r", F.row_number().over(order)).withColumn("chars", F.sum(F.length("t")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = taken.where((F.col("r") <= max_train // 2) & (F.col("chars") <= MAX_CHARS // 2)).select("doc", "y", "t").collect()
    found.sort(key=lambda r: r.doc)
    return train([r.t for r in found], np.array([r.y for r in found], int))


def score(df: DataFrame, field: Field, text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` with a double column ``out``: P(label 1) of each whole text."""

    common.ready_for_python(df.sparkSession)

    @F.pandas_udf("double")
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out, batch, held = [], [], 0
            for t in texts:
                batch.append(t)
                held += len(t or "")
                if held >= BATCH_BYTES:
                    out.append(field.score(batch))
                    batch, held = [], 0
            if batch:
                out.append(field.score(batch))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return df.withColumn(out, judged(df[text_col].cast("string")))


def held_out(ident: F.Column) -> F.Column:
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fitted_on(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Field:
    """The field learnt from the labels of the rows that are not held out."""
    labels = common.table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return fit(docs.where(~held_out(F.col("doc_id"))), labels)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), fitted_on(spark, docs, sf_dir))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
