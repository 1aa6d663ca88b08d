"""Toxicity scores by FTRL-proximal logistic regression over hashed word
n-grams and skip-grams.

Null and empty texts get the score of the intercept alone.  Repeated rows get
equal scores; without training rows every score is 0.5.  Extra columns pass
through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

TOKEN = re.compile(r"[^\W_]+")


def features(text: str | None, bits: int) -> np.ndarray:
    """Distinct hashed unigrams, bigrams and one-word skip-grams; slot 0 is
    the intercept."""
    w = TOKEN.findall((text or "").lower())
    grams = {*w, *map(" ".join, zip(w, w[1:])), *map(" _ ".join, zip(w, w[2:]))}
    top = (1 << bits) - 1
    return np.array([0, *sorted({1 + xxhash.xxh64_intdigest(g) % top for g in grams})], dtype=np.int64)


def fit(rows: Iterator[tuple[str, int]], bits: int = 20, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0,
        l2: float = 0.1, epochs: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with per-coordinate rates (McMahan et al., 2013).
    Returns the indexes and values of the non-zero weights."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    data = [(features(t, bits), y) for t, y in rows]

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(z[i]) <= l1, 0.0, w)

    for _ in range(epochs):
        for i, y in data:
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    w = weights(np.arange(1 << bits))
    at = np.flatnonzero(w)
    return at, w[at]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
          max_rows: int = 6000, max_chars: int = 64 << 20, bits: int = 20, **settings):
    """Weights fitted on a bounded sample of the labelled rows: the
    ``max_rows`` with the least hash of id, in that order, up to ``max_chars``
    characters in all.  The sample is the only data on the driver."""
    y = labels.where(F.col(label).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label).alias("__y")).distinct()
    pick = y.orderBy(F.xxhash64("__id"), "__id", "__y").limit(max_rows)
    rows = (docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"))
            .join(pick, F.col("__doc") == F.col("__id"))
            .select("__id", "__text", "__y").orderBy(F.xxhash64("__id"), "__id", "__text").toLocalIterator())
    taken, used = [], 0
    for r in islice(rows, max_rows):
        used += len(r["__text"] or "")
        if used > max_chars:
            break
        taken.append((r["__text"], int(r["__y"])))
    return fit(iter(taken), bits, **settings)


def score(docs: DataFrame, weights, text_col: str = "text", bits: int = 20, out: str = "score") -> DataFrame:
    """``docs`` plus the probability of label 1 for each whole text.  The
    broadcast weights are sparse and bounded by 2 ** ``bits``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = np.zeros(1 << bits)
        w[shared.value[0]] = shared.value[1]
        for texts in batches:
            m = np.array([w[features(t, bits)].sum() for t in texts], dtype=float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(m, -30, 30))))

    return docs.withColumn(out, udf(F.col(text_col)))
