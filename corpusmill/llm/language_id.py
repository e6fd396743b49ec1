"""Hierarchical language identification: family first, then linear SVMs within it.

A text is lower-cased, all ASCII but letters becomes spaces, and the counts of
its byte 1- to 4-grams, hashed into ``DIM`` cells, are brought to unit length
after a square root. One-versus-rest linear support vector machines choose
the language family. Within a family of two or more languages, one-versus-one
machines separate each pair, and the language with most pairwise wins (ties:
larger summed margin) is predicted.

The machines are fitted on the driver from a bounded sample: at most
``max_train`` labelled documents over all languages, or ``LEAST_EACH`` of each
language if these are more, those with the least hashes of their identifiers,
so reruns and larger corpora behave alike and every language is learnt. Their
features (8 KB each), not their texts, come to the driver. Prediction reads
every whole text once, Arrow batch by Arrow batch, without a shuffle.

Defined results: ``und`` with score 0 for null, empty and letterless texts;
``und`` for all if nothing is labelled, and the one label with score 1 if only
one is; rows repeated with one identifier are predicted alike; other columns
pass through, and one named like the result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

DIM = 2048
MAX_TRAIN, LEAST_EACH = 2400, 8
#: Length of the gradient at which a machine is fitted; the objective is strongly convex, so it is within its square of the least.
LEAST_GRADIENT = 1e-3
#: Families by language code; a code not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "no", "nb", "nn", "da", "is"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt"),
    "indo-aryan": ("hi", "ur", "bn", "pa", "gu", "mr", "ne"),
}
_FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_TABLE = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes whose n-grams are counted at once.
BLOCK = 1 << 20


def has_letter(text: str) -> bool:
    found = _LETTER.search(text)
    return bool(found) and (found[0].isalpha() or any(map(str.isalpha, text)))


def features(text: str) -> np.ndarray:
    """Unit vector of ``DIM`` float32 from the whole text."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_TABLE) + b" ", np.uint8)
    counts = np.zeros(DIM, np.int64)
    for at in range(0, len(data), BLOCK):
        x = data[at : at + BLOCK + 3].astype(np.uint32)
        code = x.copy()
        counts += np.bincount((code[:BLOCK] * np.uint32(2654435761)) >> np.uint32(21), minlength=DIM)
        for n in range(2, 5):
            if len(code) < 2:
                break
            code = (code[:-1] << np.uint32(8)) ^ x[n - 1 :] if n < 4 else (code[:-1] * np.uint32(16777619)) ^ x[n - 1 :]
            counts += np.bincount((code[:BLOCK] * np.uint32(2654435761)) >> np.uint32(21), minlength=DIM)
    # the cell of a lone space says how many words there are, which is of no use
    counts[(32 * 2654435761 & 0xFFFFFFFF) >> 21] = 0
    root = np.sqrt(counts.astype(np.float32))
    return root / max(float(np.linalg.norm(root)), 1e-9)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 8.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by accelerated gradient steps until the gradient is nought; y is +-1, classes weigh alike."""
    n = len(y)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    xb = np.hstack([x, np.ones((n, 1), np.float32)])
    w = np.zeros(xb.shape[1], np.float32)
    v, t = w.copy(), 1.0
    rate = 1.0 / (1.0 / c + 4.0)
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (xb @ v))
        grad = v / c - 2 * (xb.T @ (weight * y * slack))
        if np.linalg.norm(grad) < LEAST_GRADIENT:
            w = v
            break
        new = v - rate * grad
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w[:-1], float(w[-1])


class Model:
    """Family machines and, by family, pair machines; plain arrays, so it travels in a closure."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        family = {lang: _FAMILY_OF.get(lang, f"only {lang}") for lang in self.langs}
        self.families = sorted(set(family.values()))
        self.members = [[i for i, lang in enumerate(self.langs) if family[lang] == f] for f in self.families]
        y = np.array([self.langs.index(lang) for lang in langs])
        fam = np.array([self.families.index(family[lang]) for lang in langs])
        rows, bias, self.pairs = [], [], []
        for f in range(len(self.families) if len(self.families) > 1 else 0):
            w, b = linear_svm(x, np.where(fam == f, 1, -1).astype(np.float32))
            rows.append(w)
            bias.append(b)
        for inside in self.members:
            for a, b2 in combinations(inside, 2):
                pick = (y == a) | (y == b2)
                w, b = linear_svm(x[pick], np.where(y[pick] == a, 1, -1).astype(np.float32))
                self.pairs.append((a, b2))
                rows.append(w)
                bias.append(b)
        self.w = np.array(rows, np.float32).reshape(len(rows), DIM)
        self.b = np.array(bias, np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not has_letter(text) or not self.langs:
            return "und", 0.0
        margins = (self.w @ features(text) + self.b).tolist() if len(self.b) else []
        n = len(self.families) if len(self.families) > 1 else 0
        best = int(np.argmax(margins[:n])) if n else 0
        score = 1.0
        if n:
            others = max(m for i, m in enumerate(margins[:n]) if i != best)
            score = _squash(margins[best] - others)
        inside = self.members[best]
        wins, total = dict.fromkeys(inside, 0), dict.fromkeys(inside, 0.0)
        for (a, b), m in zip(self.pairs, margins[n:]):
            if a in wins:
                wins[a if m >= 0 else b] += 1
                total[a] += m
                total[b] -= m
        lang = max(inside, key=lambda i: (wins[i], total[i], -i))
        rivals = [abs(m) for (a, b), m in zip(self.pairs, margins[n:]) if lang in (a, b)]
        return self.langs[lang], min([score, *[_squash(2 * m) for m in rivals]])


def _squash(margin: float) -> float:
    return float(1 / (1 + np.exp(-2 * margin)))


def feature_udf() -> Column:
    @F.pandas_udf("binary")
    def vector(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([features(t).tobytes() for t in texts])

    return vector


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN) -> Model:
    """Fit on about ``max_train`` rows of ``labelled``, as many of each language where there are as many."""
    rows = labelled.select(labelled[id_col].cast("string").alias("i"), labelled[text_col].cast("string").alias("t"), labelled[lang_col].cast("string").alias("lang")).where("t is not null and lang is not null")
    common.ready_for_python(labelled.sparkSession)
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = max(LEAST_EACH, max_train // max(1, len(counts)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_unit", "i", "t"))
    picked = common.least_hashes(rows, "lang", F.col("i"), counts, each).withColumn("r", rank).where(F.col("r") <= each)
    found = picked.select("lang", "r", feature_udf()("t").alias("x")).collect() if counts else []
    found.sort(key=lambda r: (r.lang, r.r))
    x = np.array([np.frombuffer(r.x, np.float32) for r in found], np.float32).reshape(len(found), DIM)
    return Model(x, [r.lang for r in found])


def predict(df: DataFrame, model: Model, text_col: str = "text", out: str = "prediction") -> DataFrame:
    """``df`` with a struct column ``out`` (lang_pred, score)."""

    common.ready_for_python(df.sparkSession)

    @F.pandas_udf("struct<lang_pred string, score double>")
    def label(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    return df.withColumn(out, label(df[text_col].cast("string")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    model = fit(docs.where(~held_out))
    found = predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "prediction.lang_pred", "prediction.score")


QUERIES = {"op2_language_id": op2_language_id}
ORACLE_SQL: dict[str, str] = {}
