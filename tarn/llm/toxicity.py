"""Operator 7, toxicity: a convolutional text classifier trained in numpy.

A word's vector is the sum of the vectors of its 64-bit hash and of its beginnings' hashes; only hashes that several
texts of the sample have are trained, others are zero. Filters of several widths run over a text's word vectors, each is max-pooled over the whole text, and a logistic layer scores
the pooled values. Thresholds are calibrated by language, which is predicted from the same words; a score is stretched so
that its language's threshold is at 0.7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, trim_memory
from .decontam import words_of
from .sampling import bounded_sample, held_out

WIDTHS, FILTERS, SIZE = (1, 2, 3), 8, 8
STARTS = (4, 5)  # bytes of a word's beginnings
CACHE = 150_000  # words that a worker remembers
ROWS = 4000  # of a batch that are worked on at once
CUT = 0.7
DECAY = 1e-4


def _hashes(word: bytes) -> list[int]:
    return [xxhash.xxh3_64_intdigest(word), *[xxhash.xxh3_64_intdigest(word[:n], n) if len(word) > n else 0 for n in STARTS]]


class Classifier:
    def __init__(self, seed: int = 5):
        self.rows: dict[int, int] = {}
        rng = np.random.default_rng(seed)
        self.rng = rng
        self.vectors = np.zeros((1, SIZE), np.float32)
        self.filters = [rng.normal(0, 0.5, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.level = np.float32(-1.0)
        self.scale, self.shift = 1.0, 0.0
        self.languages: list[str] = []
        self.words_by_language = np.zeros((1, 0), np.float32)
        self.cuts: np.ndarray = np.zeros(0)
        self.forget()
        self.trained = False

    def parts(self, word: bytes) -> tuple[int, ...]:
        """Rows of the word's known hashes; 0 for unknown ones."""
        get, size = self.rows.get, len(word)
        known = [get(xxhash.xxh3_64_intdigest(word), 0)]
        for n in STARTS:
            start = word[:n] if size > n else b""
            row = self.starts.get(start)
            if row is None:
                row = self.starts[start] = get(xxhash.xxh3_64_intdigest(start, n), 0) if start else 0
            known.append(row)
        return tuple(known)

    def ids(self, text: str | None) -> np.ndarray:
        """Slots of the text's words, for scoring; 0 for unknown ones and past the end, so that every filter fits."""
        words = words_of(text)
        try:
            return np.fromiter((*map(self.cache.__getitem__, words), 0, 0, 0), np.int32, len(words) + 3)
        except KeyError:
            pass
        cache, mixed = self.cache, self.mixed
        for w in words:
            if w not in cache:
                rows = self.parts(w)
                slot = mixed.get(rows)
                if slot is None:  # words with the same known hashes share a slot
                    slot = mixed[rows] = len(mixed)
                    if slot == len(self.slots):
                        self.slots = np.concatenate([self.slots, np.zeros_like(self.slots)])
                        self.slot_words = np.concatenate([self.slot_words, np.zeros_like(self.slot_words)])
                    self.slots[slot] = self.vectors[list(rows)].sum(0)
                    self.slot_words[slot] = self.words_by_language[rows[0]]
                cache[w] = slot
        return np.fromiter((*map(cache.__getitem__, words), 0, 0, 0), np.int32, len(words) + 3)

    def forget(self) -> None:
        """Empties the cache of words seen while scoring."""
        self.cache: dict[bytes, int] = {}
        self.starts: dict[bytes, int] = {}
        self.mixed: dict[tuple[int, ...], int] = {(0,) * (1 + len(STARTS)): 0}
        self.slots = np.zeros((1024, SIZE), np.float32)
        self.slot_words = np.zeros((1024, self.words_by_language.shape[1]), np.float32)

    def maps(self, x: np.ndarray) -> np.ndarray:
        """What the filters give at every position of joined texts, each followed by three zero rows."""
        out = []
        for w, f in zip(WIDTHS, self.filters):
            y = x @ f[0]
            for i in range(1, w):
                y[:-i] += x[i:] @ f[i]
            out.append(y)
        return np.concatenate(out, 1)

    def logits(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the logit, and the number of its predicted language."""
        flat = np.concatenate(texts)
        at = np.cumsum([0, *map(len, texts[:-1])])
        pooled = np.maximum.reduceat(self.maps(self.slots[flat]), at, axis=0)
        z = np.maximum(pooled + self.bias, 0) @ self.out + self.level
        if not self.languages:
            return z, np.zeros(len(texts), np.int64)
        return z, np.add.reduceat(self.slot_words[flat], at, axis=0).argmax(1)

    def fit(self, texts: list[str | None], toxic: np.ndarray, languages: list[str | None], steps: int = 800, least: int = 3, rate: float = 0.05) -> None:
        known: dict[int, int] = {}
        for t in texts:
            for h in {h for w in set(words_of(t)) for h in _hashes(w)}:
                known[h] = known.get(h, 0) + 1
        known.pop(0, None)
        self.rows = {h: i + 1 for i, h in enumerate(sorted(h for h, n in known.items() if n >= least))}
        del known
        self.vectors = self.rng.normal(0, 0.05, (len(self.rows) + 1, SIZE)).astype(np.float32)
        self.vectors[0] = 0
        self.forget()
        parts = {w: self.parts(w) for t in texts for w in set(words_of(t))}
        ids = [np.array([*map(parts.__getitem__, words_of(t)), *[(0,) * (1 + len(STARTS))] * 3], np.int32) for t in texts]
        del parts
        self.forget()
        self._languages(ids, languages)
        check = np.arange(len(ids)) % 5 == 0
        learn = np.flatnonzero(~check)
        if not len(learn) or toxic[learn].min() == toxic[learn].max():
            return
        weight = np.where(toxic == 1, (toxic == 0).sum() / max(1, (toxic == 1).sum()), 1.0) ** 0.5
        params = [self.bias, self.out, *self.filters]
        squares = [np.full_like(p, 1e-6) for p in params]
        v_squares = np.full_like(self.vectors, 1e-6)
        level_square = 1e-6
        per_epoch = max(1, len(learn) // 24)
        for _ in range(-(-steps // per_epoch)):
            for some in np.array_split(self.rng.permutation(learn), per_epoch):
                own = [ids[i] for i in some]
                flat = np.concatenate(own)
                at = np.cumsum([0, *map(len, own)])
                x = self.vectors[flat].sum(1)
                maps = self.maps(x)
                top = np.stack([maps[i:j].argmax(0) + i for i, j in zip(at, at[1:])])
                pooled = maps[top, np.arange(maps.shape[1])] + self.bias
                act = np.maximum(pooled, 0)
                p = 1 / (1 + np.exp(-(act @ self.out + self.level)))
                d = ((p - toxic[some]) * weight[some] / len(some)).astype(np.float32)
                d_act = d[:, None] * self.out * (pooled > 0)
                grads = [d_act.sum(0), act.T @ d]
                d_x = np.zeros_like(x)
                for k, (w, f) in enumerate(zip(WIDTHS, self.filters)):
                    g, pos = d_act[:, k * FILTERS : (k + 1) * FILTERS], top[:, k * FILTERS : (k + 1) * FILTERS]
                    d_f = np.zeros_like(f)
                    for i in range(w):
                        here = np.minimum(pos + i, len(x) - 1)
                        d_f[i] = np.einsum("bf,bfs->sf", g, x[here])
                        np.add.at(d_x, here.ravel(), (g[:, :, None] * f[i].T[None]).reshape(-1, SIZE))
                    grads.append(d_f)
                for q, g, s in zip(params, grads, squares):
                    s += g * g
                    q -= rate * g / np.sqrt(s)
                level_square += float(d.sum()) ** 2
                self.level = np.float32(self.level - rate * d.sum() / level_square**0.5)
                moved = np.flatnonzero(d_x.any(1))
                rows, back = np.unique(flat[moved], return_inverse=True)
                g = np.zeros((len(rows), SIZE), np.float32)
                np.add.at(g, back.reshape(len(moved), -1), d_x[moved][:, None])
                g += DECAY * self.vectors[rows]
                v_squares[rows] += g * g
                self.vectors[rows] -= rate * g / np.sqrt(v_squares[rows])
                self.vectors[0] = 0
        self.trained = True
        self.forget()
        self._calibrate([self.ids(texts[i]) for i in np.flatnonzero(check)], toxic[check])
        self.forget()

    def _languages(self, ids: list[np.ndarray], languages: list[str | None]) -> None:
        self.languages = sorted({x for x in languages if x is not None})
        n = np.ones((len(self.vectors), len(self.languages)), np.float32)
        for own, x in zip(ids, languages):
            if x is not None:
                np.add.at(n[:, self.languages.index(x)], own[:, 0], 1)
        n[0] = 1
        self.words_by_language = np.log(n / n.sum(0)) if self.languages else n
        self.words_by_language[0] = 0

    def _calibrate(self, ids: list[np.ndarray], toxic: np.ndarray) -> None:
        """A logistic scale and, where a language has enough checked texts, its own threshold; else that of all."""
        z, lang = self.logits(ids)
        for _ in range(200):
            p = 1 / (1 + np.exp(-(self.scale * z + self.shift)))
            self.scale -= 0.5 * float(((p - toxic) * z).mean()) / max(1.0, float((z * z).mean()))
            self.shift -= 0.5 * float((p - toxic).mean())
        self.scale = max(self.scale, 0.05)
        p = 1 / (1 + np.exp(-(self.scale * z + self.shift)))

        def cut(own: np.ndarray, fallback: float) -> float:
            if toxic[own].sum() < 20:
                return fallback
            order = np.argsort(-p[own])
            t, s = toxic[own][order], p[own][order]
            good = np.cumsum(t)
            f1 = 2 * good / (np.arange(1, len(t) + 1) + t.sum())
            k = int(f1.argmax())
            low = s[k + 1] if k + 1 < len(s) else 0.0
            return float(np.clip((s[k] + low) / 2, 0.05, 0.95))

        whole = cut(np.ones(len(p), bool), 0.5)
        self.cuts = np.array([cut(lang == k, whole) for k in range(max(1, len(self.languages)))])

    def scores(self, texts: list[str | None], most_words: int = 60_000) -> list[float]:
        out: list[float] = []
        if not self.trained:
            return [0.0] * len(texts)
        held, n = [], 0
        for i, t in enumerate(texts):
            own = self.ids(t)
            held.append(own)
            n += len(own)
            if n > most_words or i == len(texts) - 1:
                z, lang = self.logits(held)
                p = 1 / (1 + np.exp(-(self.scale * z.astype(np.float64) + self.shift)))
                c = self.cuts[lang]
                out += np.where(p < c, CUT * p / c, CUT + (1 - CUT) * (p - c) / (1 - c)).tolist()
                held, n = [], 0
                if len(self.cache) > CACHE:
                    self.forget()
        return out


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 3000, most_rows: int = 6000) -> Classifier:
    """docs (doc_id, text, lang), labels (doc_id, toxic). Learns from about per_label ids of either label and at most
    most_rows together, of those that aren't held out, and at most twice as many rows, where ids repeat. Repeated labels of an id: the larger one holds."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~held_out())
    sample = bounded_sample(own.withColumn("text", F.lit("")), "toxic", per_label, most_rows)
    model = Classifier()
    if not sample:
        return model
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(r.doc_id, r.toxic) for r in sample], "doc_id long, toxic int"))  # at most most_rows
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = plain.join(wanted, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * most_rows).collect()
    texts, toxic, languages = [r.text for r in rows], np.array([r.toxic for r in rows], np.float64), [r.lang for r in rows]
    del rows, sample
    if texts:
        model.fit(texts, toxic, languages)
    del texts
    trim_memory()  # of the driver
    return model


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score, predicted (1 where score >= 0.7).

    Null, empty and wordless texts get the score of no known word. If nothing could be learned, all scores are 0. Other columns aren't
    read; rows are independent."""
    known = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for b in slices(batches, ROWS):
            s = m.scores([t.as_py() for t in b.column("text")])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array([int(x >= CUT) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])
        m.forget()
        trim_memory()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out())
    return plain.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Classifier) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns; nothing is shuffled."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for b in slices(batches, ROWS):
            yield b.filter(pa.array([x < CUT for x in m.scores([t.as_py() for t in b.column("text")])], pa.bool_()))
        m.forget()
        trim_memory()

    return docs.mapInArrow(run, docs.schema)


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
