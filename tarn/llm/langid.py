"""Operator 5, language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader and elastic-net penalties, then calibrated by a temperature. Document
frequencies come from all rows that may be learned from; weights from a bounded sample of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, slices, trim_memory
from .sampling import bounded_sample, held_out

BITS = 14  # of a hashed feature
ROWS = 4000  # of a batch that are worked on at once
_K = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def ngrams(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The text's hashed 1-, 2- and 3-grams of lower-cased characters, and their counts."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(U64) + U64(1)
    one = c * _K[0]
    two = one[:-1] * _K[1] + one[1:]
    three = two[:-1] * _K[2] + one[2:]
    at = [((h ^ h >> U64(31)) * _K[1] >> U64(64 - bits)).astype(np.int32) for h in (one, two, three)]
    n = np.bincount(np.concatenate(at), minlength=1 << bits)
    found = np.flatnonzero(n)
    return found, n[found]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # by feature and language
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, n = ngrams(text)
        x = (1 + np.log(n)) * self.idf[at]
        return at, x / max(np.sqrt(x @ x), 1e-12)

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        z = self.logits(*self.vector(text)) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], features: int, classes: int, epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by FTRL-proximal steps on the multinomial log loss; l1 and l2 are the elastic net."""
    z, n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))

    def weights(z, n):
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)

    order = np.random.default_rng(1)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, features), np.append(x, 1.0)
            w = weights(z[at], n[at])
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    w = weights(z, n)
    return w[:-1], w[-1]


def fit(docs: DataFrame, per_language: int = 800, most_rows: int = 4000) -> Model:
    """docs: rows (doc_id, text, lang) that may be learned from. per_language, most_rows: the sample's bounds; languages aren't bounded
    but by most_rows."""
    docs = docs.where("text is not null and lang is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(1 << BITS, np.int64)
        for b in slices(batches, ROWS):
            for t in b.column("text"):
                df[ngrams(t.as_py())[0]] += 1
                n += 1
        if n:
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], n))], ["feature", "df"])

    got = docs.select("text").mapInArrow(frequencies, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect()
    df = np.zeros((1 << BITS) + 1)
    for r in got:
        df[r.feature] = r.df  # the last is the number of texts
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    sample = bounded_sample(docs.select("doc_id", "text", "lang"), "lang", per_language, most_rows)
    languages = sorted({r.lang for r in sample})
    model = Model(languages, idf, np.zeros((1 << BITS, len(languages))), np.zeros(len(languages)))
    if not languages:
        return model
    rows = [(*model.vector(r.text), languages.index(r.lang)) for r in sample]
    kept, check = [r for i, r in enumerate(rows) if i % 5], rows[::5]
    model.weights, model.bias = ftrl(kept or rows, 1 << BITS, len(languages))
    z = np.array([model.logits(at, x) for at, x, _ in check])
    y = np.array([k for *_, k in check])

    def loss(t: float) -> float:
        s = z / t
        top = s.max(1)
        return float((top + np.log(np.exp(s - top[:, None]).sum(1)) - s[np.arange(len(y)), y]).mean())

    model.temperature = min(np.geomspace(0.05, 5, 60), key=loss)
    return model


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter, and all if nothing could be learned: und, 0. Other columns aren't read."""
    known = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights for each language of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for b in slices(batches, ROWS):
            found = [m.predict(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
        trim_memory()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out())
    return plain.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op5(docs: DataFrame) -> DataFrame:
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return detect(docs, fit(plain.where(~held_out() & F.col("doc_id").isNotNull())))
