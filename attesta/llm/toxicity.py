"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are a text's words, pairs of neighbours, pairs with one word skipped,
and the stems of words (their first ``STEMS`` letters), so that inflected forms
that the labelled rows lack are known by the forms they have.

The model is fitted in one task on a bounded, documented sample of labelled
rows (``TRAIN_ROWS``, those with the smallest hashes of their ids); its weights
are sparse (L1) and at most ``2**BITS``, a few hundred kB in practice, and go
to the scoring tasks as a broadcast variable. Scoring is one pass over the
whole texts without a shuffle.

Defined results: a null or empty text has no features and the score of the
bias; several label rows of a document count as their maximum, and of several
rows with one doc_id the one with the least hash of its text is learnt from;
label rows without a document or with a null label are ignored; with no
labelled row, or one class only, the bias alone is fitted; a score of exactly
0.5 is predicted 1; rows that repeat are scored each; further columns of the
inputs are not looked at; very long texts are scored whole, and only their
distinct features (at most ``2**BITS``) reach the fit; an empty table gives no
rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attesta.llm.common import bound_batches

#: log2 of the number of hashed features; labelled rows that the model is fitted on, at most; passes over them.
BITS, TRAIN_ROWS, EPOCHS = 20, 16_000, 6
#: FTRL-proximal: learning rate, its smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 20.0, 1.0
#: Lengths of the stems that are features beside whole words.
STEMS = (4, 5, 6, 7)
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Distinct hashed features: words and their stems, pairs of neighbours, and pairs with one word skipped."""
    from xxhash import xxh64_intdigest

    words = _WORD.findall((text or "").lower())
    known: dict[str, int] = {}
    for w in words:
        if w not in known:
            known[w] = xxh64_intdigest(w)
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    stems = {(k, w[:k]) for w in known for k in STEMS if len(w) > k}
    parts = [np.unique(h), np.fromiter((xxh64_intdigest(w, k) for k, w in stems), np.uint64, len(stems))]
    with np.errstate(over="ignore"):
        if len(h) > 1:
            parts.append((h[:-1] * _MIX) ^ (h[1:] + np.uint64(1)))
        if len(h) > 2:
            parts.append((h[:-2] * _MIX) ^ (h[2:] * np.uint64(3) + np.uint64(2)))
        mixed = np.concatenate(parts) * _MIX
    return np.unique((mixed >> np.uint64(64 - bits)).astype(np.int64))


class Ftrl:
    """Per-coordinate FTRL-proximal with an unpenalised bias."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.bias_z = self.bias_n = 0.0
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def _w(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    @property
    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha)

    def learn(self, at: np.ndarray, label: int) -> None:
        """One example: its features' places and its label."""
        z, n = self.z[at], self.n[at]
        w = self._w(z, n)
        g = sigmoid(float(w.sum()) + self.bias) - label
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at], self.n[at] = z + g - sigma * w, n + g * g
        step = ((self.bias_n + g * g) ** 0.5 - self.bias_n**0.5) / self.alpha
        self.bias_z, self.bias_n = self.bias_z + g - step * self.bias, self.bias_n + g * g

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of the weights that aren't zero."""
        w = self._w(self.z, self.n)
        at = np.flatnonzero(w)
        return at.astype(np.int32), w[at]


def sigmoid(x: float) -> float:
    """Logistic function without overflow."""
    return float(1 / (1 + np.exp(-x))) if x >= 0 else float(np.exp(x) / (1 + np.exp(x)))


def held_out(id_col: str = "doc_id"):
    """Rows of the evaluation fold: crc32 of the id as text leaves no remainder by five."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, label_col: str, rows: int = TRAIN_ROWS, epochs: int = EPOCHS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights ``(places, values, bias)`` from the labelled rows outside the evaluation fold."""
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label_col).alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x, bits).astype(np.int32).tobytes() for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], ["doc_id", "y", "th", "at"])

    found = texts.select("doc_id", F.col("y").cast("int").alias("y"), F.xxhash64("text").alias("th"), "text").mapInArrow(extract, "doc_id long, y int, th long, at binary")
    once = found.groupBy("doc_id").agg(F.min(F.struct("th", "y", "at")).alias("x")).select("doc_id", "x.y", "x.at")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples: list[tuple[int, int, np.ndarray]] = []
        for batch in batches:
            ids, ys, xs = (c.to_pylist() for c in batch.columns)
            examples += [(i, y, np.frombuffer(x, np.int32)) for i, y, x in zip(ids, ys, xs, strict=True)]
        examples.sort(key=lambda e: e[0] * 0x9E3779B97F4A7C15 & ((1 << 64) - 1))
        model = Ftrl(bits)
        for _ in range(epochs):
            for _, y, at in examples:
                model.learn(at, y)
        at, w = model.weights()
        yield pa.RecordBatch.from_pydict({"at": [at.tobytes()], "w": [w.tobytes()], "bias": [model.bias]}, schema=pa.schema([("at", pa.binary()), ("w", pa.binary()), ("bias", pa.float64())]))

    row = once.repartition(1).mapInArrow(train, "at binary, w binary, bias double").first()
    if row is None:
        return np.zeros(0, np.int32), np.zeros(0), 0.0
    return np.frombuffer(row["at"], np.int32), np.frombuffer(row["w"], np.float64), row["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS) -> DataFrame:
    """``(doc_id, score)`` of every row over its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = shared.value
        dense = np.zeros(1 << bits)
        dense[at] = w
        for batch in batches:
            scores = [sigmoid(float(dense[features(x, bits)].sum()) + bias) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, **fit_options: int) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every document."""
    bound_batches(docs.sparkSession)
    scored = score(docs, fit(docs, labels, "toxic", **fit_options))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
