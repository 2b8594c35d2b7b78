import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tarn.llm import langid, toxicity
from tarn.llm.sampling import bounded_sample, held_out

S = "doc_id long, text string, lang string, score string, held_out int"
SYLLABLES = {"xx": ["ka", "ru", "to", "mi"], "yy": ["sch", "ung", "ver", "ein"]}


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(["xx", "yy"])
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zorg", "blefo", "quax"]))
        rows.append((i, " ".join(words), lang, "x", 1))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_and_sample(spark):
    rows, _ = corpus(300)
    df = spark.createDataFrame(rows + [(None, "a", "xx", "x", 1)], S)
    for r in df.select("doc_id", held_out().alias("h")).collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    got = bounded_sample(df.where("doc_id is not null").select("doc_id", "text", "lang"), "lang", 20, 30)
    assert 10 <= len(got) <= 30 and got == bounded_sample(df.where("doc_id is not null").repartition(3).select("doc_id", "text", "lang"), "lang", 20, 30)
    assert bounded_sample(df.limit(0), "lang", 20, 30) == []


def test_language(spark):
    rows, _ = corpus()
    odd = [(9000, None, "xx", "x", 1), (9001, "", "yy", "x", 1), (9002, "12 ?!", None, "x", 1), (None, "ka ru to", "xx", "x", 1), (9003, "ka ru mi " * 20000, None, "x", 1), rows[3]]
    df = spark.createDataFrame(rows + odd, S).repartition(3)
    got = langid.op5(df).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {r[0]: r[2] for r in rows}
    test = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in test]) > 0.97
    by = {r.doc_id: r for r in got}
    assert all((by[d].lang_pred, by[d].score) == ("und", 0.0) for d in (9000, 9001, 9002))
    assert by[None].lang_pred == by[9003].lang_pred == "xx" and all(0 <= r.score <= 1 for r in got)
    assert langid.op5(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.op5(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_ftrl_drops_useless_weights():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(300):
        y = int(rng.integers(2))
        rows.append((np.array([y, 2 + int(rng.integers(8))]), np.array([1.0, 1.0]), y))
    w, _ = langid.ftrl(rows, 10, 2, l1=2.0)
    assert np.abs(w[:2]).max() > 1 and (w[2:] == 0).mean() > 0.5


def test_toxicity(spark):
    rows, labels = corpus(500, 2)
    odd = [(9000, None, "xx", "x", 1), (9001, "", "yy", "x", 1), (None, "zorg quax blefo", "xx", "x", 1), (9003, "ka ru mi " * 20000 + "zorg quax blefo", None, "x", 1), rows[3]]
    df = spark.createDataFrame(rows + odd, S).repartition(3)
    lab = spark.createDataFrame(labels + [(None, 1), (9001, None), labels[3]], "doc_id long, toxic int")
    got = toxicity.op7(df, lab).collect()
    assert len(got) == len(rows) + len(odd)
    truth = dict(labels)
    test = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in test]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[None].predicted == by[9003].predicted == 1 and by[9000].predicted == by[9001].predicted == 0
    model = toxicity.fit(df, lab)
    kept = toxicity.accepted(df, model)
    assert kept.columns == df.columns and kept.count() == toxicity.score(df, model).where("predicted = 0").count()
    assert toxicity.op7(df.limit(0), lab).count() == 0
    assert {r.score for r in toxicity.op7(df, lab.limit(0)).collect()} == {0.0}


def test_texts_without_letters_have_no_language():
    from tarn.llm.langid import Model

    m = Model(["xx", "yy"], np.ones(1 << 14), np.zeros((1 << 14, 2)), np.zeros(2))
    for text in ("½ ² Ⅷ", "12 _ -- ①", "", None, " \n", "١٢٣"):
        assert m.predict(text) == ("und", 0.0)
    assert m.predict("½ a")[0] == "xx" and m.predict("漢")[0] == "xx"


def test_a_sample_of_many_groups_and_long_texts(spark):
    rows = [(i, f"text {i}", f"g{i % 1500}") for i in range(4500)] + [(9000, "x" * 50_000, "g1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = bounded_sample(df, "lang", 2, 10_000, most_bytes=10_000)
    assert len({r.lang for r in got}) > 1200 and all(len(r.text) < 10_000 for r in got)
    assert len(bounded_sample(df, "lang", 2, 100)) == 100
    assert bounded_sample(df.withColumn("lang", F.lit(None).cast("string")), "lang", 2, 100) == []
