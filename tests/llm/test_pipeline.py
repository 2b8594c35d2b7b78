import re

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F

from tarn.llm import decontam, ngram_join, toxicity
from tarn.llm.mixing import mix

DIR = "/root/testdata/sf0.001"


def test_stages_do_what_their_operators_say(spark, tmp_path, monkeypatch):
    model = toxicity.fit(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet"))
    monkeypatch.setattr(toxicity, "fit", lambda *_: model)  # training isn't the same to the last bit each time
    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumn("size", F.lit("extra"))
    columns, at, seen = docs.columns, None, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = str(tmp_path / name)
        stage(spark, before, DIR).write.parquet(out)
        docs = spark.read.parquet(out)
        seen[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    before, after = seen["toxicity"]
    scores = toxicity.score(before, model)
    assert ids(after) == ids(scores.where("predicted = 0"))
    before, after = seen["near_duplicates"]
    assert ids(after) == ids(ngram_join.ngram_components(before, 5, 80).where("doc_id = component_id"))
    before, after = seen["decontamination"]
    assert ids(after) == ids(decontam.find_items(before, spark.read.parquet(f"{DIR}/benchmark.parquet")).where("not contaminated"))
    before, after = seen["mixing"]
    want = {r.doc_id: r.copies for r in mix(before).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == want
    before, after = seen["token_shards"]
    assert after.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, DIR).count() == after.count() and at is None


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def plain_near_duplicates(rows):
    """Ids of the rows that stay: of documents linked by sets of five-word shingles the smallest id."""
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(r.text))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {d: low if x == high else x for d, x in label.items()}
    return sorted(d for d, x in label.items() if d == x)


def plain_clean(rows, items):
    """Ids of the rows of whose words less than a twentieth lies in windows of 13 words of items."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = set()
    for item in items:
        w = words(item.text)
        windows |= {tuple(w[i : i + 13]) for i in range(len(w) - 12)} if len(w) >= 13 else {tuple(w)} - {()}
    kept = []
    for r in rows:
        w, hit = words(r.text), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        if not (hit and 20 * len(hit) >= len(w)):
            kept.append(r.doc_id)
    return sorted(kept)


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = docs.collect()
    got = corpus_pipeline.drop_near_duplicates(spark, docs, DIR)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == plain_near_duplicates(rows)
    items = spark.read.parquet(f"{DIR}/benchmark.parquet").collect()
    kept = corpus_pipeline.drop_contaminated(spark, docs, DIR)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == plain_clean(rows, items)


def test_a_stage_drops_what_the_ones_before_had_written(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(50)
    corpus_pipeline.mix_sources(spark, docs, DIR).write.parquet(str(tmp_path / "a"))
    mine = list(corpus_pipeline._SCRATCH)
    assert mine
    again = spark.read.parquet(str(tmp_path / "a"))
    corpus_pipeline.mix_sources(spark, again, DIR).write.parquet(str(tmp_path / "b"))
    gone = [p for p in mine if p not in corpus_pipeline._SCRATCH]
    fs = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p))
    assert gone == mine and not any(map(fs, gone)) and any(map(fs, corpus_pipeline._SCRATCH))


def test_stages_take_batches_of_bounded_rows(spark):
    docs, setting = spark.range(9000).repartition(1), corpus_pipeline.BATCH
    stage = corpus_pipeline.staged(lambda s, d, _: d.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long"))
    before = spark.conf.get(setting)
    try:
        assert max(r.n for r in stage(spark, docs, "").collect()) == corpus_pipeline.ROWS
        spark.conf.set(setting, "100")  # a smaller one stays
        assert max(r.n for r in stage(spark, docs, "").collect()) == 100
    finally:
        spark.conf.set(setting, before)
