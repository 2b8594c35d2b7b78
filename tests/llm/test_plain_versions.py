"""Operators that SQL can't express against versions written with plain loops."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import langid, toxicity
from tarn.llm.binout import materialise, read_slots
from tarn.llm.decontam import words_of
from tarn.llm.tokens import vocabulary_path

M = 2**64 - 1


def mix(x, seed):
    x = (x + ((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & M)) & M
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def slot(ordinal, size, key):
    """A Feistel network over the least even number of bits that holds size, walked until it is within size."""
    half = 1
    while 1 << (2 * half) < size:
        half += 1
    low, x = (1 << half) - 1, ordinal
    while True:
        left, right = x >> half, x & low
        for r in range(4):
            left, right = right, left ^ ((mix(right, key * 31 + r) >> 17) & low)
        x = left << half | right
        if x < size:
            return x


@pytest.mark.parametrize("stride,shard,parts", [(16, 7, 3), (64, 1000, 1), (5, 2, 4)])
def test_token_shards(spark, tmp_path, stride, shard, parts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path())
    rows = [(i, "some words %d é漢 " % i * (i % 9)) for i in range(60)] + [(70, None), (71, ""), (None, "no id here"), (3, "three words again"), (3, "three words again"), (72, "long " * 900)]
    src, place = str(tmp_path / "in"), f"file://{tmp_path}/out"
    spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).write.parquet(src)
    docs = spark.read.parquet(src)
    index = materialise(docs, place, stride=stride, shard=shard, key=99, stable=True).collect()
    streams = {}
    for part, doc, text in docs.select(F.spark_partition_id(), "doc_id", "text").collect():
        streams.setdefault(part, []).append((doc, [*sp.encode(text or ""), 2]))
    sequences, pieces = [], []
    for part in sorted(streams):
        at, first = 0, len(sequences)
        for doc, ids in streams[part]:
            for i, token in enumerate(ids):
                if at % stride == 0:
                    sequences.append([])
                if i == 0 or at % stride == 0:
                    pieces.append([doc, len(sequences) - 1, at % stride, 0])
                sequences[-1].append(token)
                pieces[-1][3] += 1
                at += 1
        if len(sequences) > first:
            sequences[-1] += [0] * (stride - len(sequences[-1]))
    n = len(sequences)
    slots = [slot(i, n, 99) for i in range(n)]
    want = [None] * n
    for s, seq in zip(slots, sequences):
        want[s] = seq
    assert read_slots(place, 0, n, stride, shard).tolist() == want
    got = sorted((str(r.doc_id), r.slot, r["at"], r.n_tokens, r.shard) for r in index)
    assert got == sorted((str(d), slots[s], at, k, slots[s] // shard) for d, s, at, k in pieces)


def test_ngrams_and_their_weights():
    text, bits = "Aéb ab", 10
    k = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]
    want = Counter()
    chars = [ord(c) + 1 for c in text.lower()]
    for i in range(len(chars)):
        one = lambda j: chars[j] * k[0] & M
        hashes = [one(i)]
        if i + 1 < len(chars):
            two = (one(i) * k[1] + one(i + 1)) & M
            hashes.append(two)
            if i + 2 < len(chars):
                hashes.append((two * k[2] + one(i + 2)) & M)
        for h in hashes:
            want[((h ^ h >> 31) * k[1] & M) >> (64 - bits)] += 1
    at, n = langid.ngrams(text, bits)
    assert dict(zip(at.tolist(), n.tolist())) == want
    idf = np.linspace(1, 2, 1 << langid.BITS)
    model = langid.Model(["x"], idf, np.zeros((1 << langid.BITS, 1)), np.zeros(1))
    at, x = model.vector(text)
    plain = {int(a): (1 + math.log(c)) * idf[a] for a, c in zip(*langid.ngrams(text))}
    length = math.sqrt(sum(v * v for v in plain.values()))
    assert {int(a): pytest.approx(v) for a, v in zip(at, x)} == {a: v / length for a, v in plain.items()}


def test_ftrl_steps():
    rng = np.random.default_rng(4)
    features, classes, alpha, beta, l1, l2 = 6, 3, 0.7, 1.3, 0.02, 0.05
    rows = [(np.sort(rng.choice(features, 3, replace=False)), rng.random(3), int(rng.integers(classes))) for _ in range(40)]
    z = {(f, c): 0.0 for f in range(features + 1) for c in range(classes)}
    n = dict(z)

    def weight(f, c):
        if abs(z[f, c]) <= l1:
            return 0.0
        return -(z[f, c] - math.copysign(l1, z[f, c])) / ((beta + math.sqrt(n[f, c])) / alpha + l2)

    order = np.random.default_rng(1)
    for _ in range(2):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            values = [*zip(at.tolist(), x.tolist()), (features, 1.0)]
            w = {(f, c): weight(f, c) for f, _ in values for c in range(classes)}
            scores = [sum(v * w[f, c] for f, v in values) for c in range(classes)]
            e = [math.exp(s - max(scores)) for s in scores]
            for f, v in values:
                for c in range(classes):
                    g = v * (e[c] / sum(e) - (c == y))
                    z[f, c] += g - (math.sqrt(n[f, c] + g * g) - math.sqrt(n[f, c])) / alpha * w[f, c]
                    n[f, c] += g * g
    w, b = langid.ftrl(rows, features, classes, 2, alpha, beta, l1, l2)
    assert w == pytest.approx(np.array([[weight(f, c) for c in range(classes)] for f in range(features)])) and b == pytest.approx(np.array([weight(features, c) for c in range(classes)]))


TEXTS = ["good plain words here", "zorg bad zorg words", "one", "", None, "plain zorg blefo", "words and more words here", "blefo bad thing"] * 6


def fitted():
    model = toxicity.Classifier()
    model.fit(TEXTS, np.array([1.0 if t and ("zorg" in t or "blefo" in t) else 0.0 for t in TEXTS]), ["x"] * len(TEXTS), steps=40)
    return model


def test_filters_and_pooling():
    model = fitted()
    for text in ["good zorg here", "one", "", "unknown words only", "plain words plain zorg blefo bad thing here"]:
        vectors = [model.vectors[list(model.parts(w))].sum(0).tolist() for w in words_of(text)] + [[0.0] * toxicity.SIZE] * 3
        z = float(model.level)
        for k, (width, f) in enumerate(zip(toxicity.WIDTHS, model.filters)):
            for j in range(toxicity.FILTERS):
                best = -math.inf
                for at in range(len(vectors)):
                    best = max(best, sum(vectors[at + i][s] * float(f[i, s, j]) for i in range(width) if at + i < len(vectors) for s in range(toxicity.SIZE)))
                unit = k * toxicity.FILTERS + j
                z += max(best + float(model.bias[unit]), 0.0) * float(model.out[unit])
        assert float(model.logits([model.ids(text)])[0][0]) == pytest.approx(z, abs=1e-4)
        p = 1 / (1 + math.exp(-(model.scale * z + model.shift)))
        c = float(model.cuts[0])
        assert model.scores([text])[0] == pytest.approx(0.7 * p / c if p < c else 0.7 + 0.3 * (p - c) / (1 - c), abs=1e-4)


def test_training_is_the_same_each_time():
    a, b = fitted(), fitted()
    assert a.scores(TEXTS) == b.scores(TEXTS) and a.trained
