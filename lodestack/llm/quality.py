"""Quality by hashed word n-gram logistic regression, fitted with follow-the-regularised-leader updates.

Tokens are words and runs of punctuation. Each gives its hashed unigram and bigram, and the same for its form (letter
case and character class of its first three characters; pairs of forms also tell whether a word repeats), so that
unseen words still say something. A text is scored
as a sparse dot product of n-gram shares with the weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, texts_of
from .labelled import SAMPLE, sample

TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+")
BITS = 18
FORM = bytes(ord("A") if 65 <= c < 91 else ord("a") if 97 <= c < 123 or c >= 128 else ord("9") if 48 <= c < 58 else c for c in range(256))


def _mixed(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return (a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, values) of a whole text: each n-gram kind's shares sum to 1. The empty text has none."""
    tokens = TOKEN.findall(text.encode())
    if not tokens:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    n = len(tokens)
    form = np.fromiter((zlib.crc32(t[:3].translate(FORM)) for t in tokens), dtype=np.uint64, count=n)
    word = np.fromiter(map(zlib.crc32, map(bytes.lower, tokens)), dtype=np.uint64, count=n)
    none = np.zeros(1, dtype=np.uint64)
    kinds = [_mixed(word, none, 1), _mixed(word[:-1], word[1:], 2), _mixed(form, none, 3), _mixed(form[:-1], form[1:], 4) ^ (word[:-1] == word[1:]).astype(np.uint64)]
    index = np.concatenate(kinds).astype(np.int64)
    value = np.concatenate([np.full(len(k), 1 / max(1, len(k))) for k in kinds])
    return index, value


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        index, value = features(text)
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[index] @ value, -30, 30))))


def fit(texts: list[str], y: np.ndarray, epochs: int = 6, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.0005, l2: float = 0.0005, seed: int = 11) -> Model:
    """FTRL-proximal, one example at a time; the bias is an n-gram that every text has."""
    size = (1 << BITS) + 1
    z, g2 = np.zeros(size), np.zeros(size)
    rows = []
    for t in texts:
        index, value = features(t)
        unique, inverse = np.unique(index, return_inverse=True)
        rows.append((np.append(unique, size - 1), np.append(np.bincount(inverse, weights=value, minlength=len(unique)) if len(unique) else np.zeros(0), 1.0)))

    def weights(i: np.ndarray | slice) -> np.ndarray:
        w = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(g2[i])) / alpha + l2)
        return np.where(np.abs(z[i]) <= l1, 0.0, w)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i, v = rows[k]
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ v, -30, 30)))
            g = (p - y[k]) * v
            z[i] += g - (np.sqrt(g2[i] + g * g) - np.sqrt(g2[i])) / alpha * w
            g2[i] += g * g
    w = weights(slice(None))
    return Model(w[:-1].copy(), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    """Fit on a bounded sample of labels.quality, never on rows with crc32(doc_id as text) mod 3 = 1."""
    rows = sample(docs, labels, "quality", 3, 1, limit)
    return fit([r[1] for r in rows], np.array([r[3] for r in rows], dtype=np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; null text is scored as the empty text, which has the bias alone.

    Whole texts of any length; repeated rows and null ids give rows as they come. Other columns are not read, whatever
    their names; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = pa.array([sent.value.score(t) for t in texts_of(batch)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), value], names=["doc_id", "score"])

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, score double")
