"""Hand-worked cases, edge rules and round trips."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from tarn.functions import nested, text
from tarn.operators import compaction, drift, sampling, scoring, stats
from tarn.sources import readers, writers
from tarn.streaming import log


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()])
    return df.select(col.alias("x")).first().x


def test_text(spark):
    c = F.col("t")
    assert one(spark, text.normal_space(c), t=" a \t\n b\x1cc ") == "a b c"
    assert one(spark, text.fold_key(c), t=" Straße  X") == "strasse x"
    assert [one(spark, text.clean(c), t=v) for v in (None, False, 0, " a ")] == ["", "", "", "a"]
    assert [one(spark, text.sentence_count(c), t=v) for v in ("", "A b. C!  D? e", "no end")] == [1, 4, 1]
    assert one(spark, text.jaccard(F.col("a"), F.col("b")), a=["deep", "neural", "net"], b=["neural", "net"]) == pytest.approx(2 / 3)
    assert one(spark, text.typed_entity(c), t="a:b:C") == ("a:b", "C") and one(spark, text.typed_entity(c), t="ab") == ("ab", None)
    assert one(spark, text.grounded(c, F.lit("xy z")), t="") is False and one(spark, text.grounded(c, F.lit("Xy  Z")), t="y z") is True
    assert one(spark, text.leading_id(c), t="123.txt") == "123" and one(spark, text.leading_id(c), t="x1") is None
    assert one(spark, text.split_of_path(c), t="/a/Train/x.json") == "train"
    assert [(s.start_char, s.end_char) for s in one(spark, text.offsets(c), t=["ab", "c", "def"])] == [(0, 2), (3, 4), (5, 8)]
    assert [one(spark, text.span_text(c, F.lit(i), F.lit(j)), t=["a", "b", "c"]) for i, j in ((1, 2), (0, 0), (2, 3), (2, 1), (-1, 0))] == ["b c", "a", None, None, None]
    assert one(spark, text.padded(F.lit("s"), c, F.lit(7)), t=["aa", "b"]) == "s\naa\nb\naa"
    assert one(spark, text.seed32(F.lit("a"), F.lit("b"))) == one(spark, text.seed32(F.lit("a|b")))


@pytest.mark.parametrize("raw, want", [
    ('{"a":1}', {"a": 1}), ("```json\n{\"a\": 1}\n```", {"a": 1}), ('Sure: {"a":1} done', {"a": 1}), ('{bad} then {"b":2}', {"b": 2}), ('{"a":1,"a":2}', {"a": 2}), ("[1]", None), ("", None), (None, None), ("{", None),
])
def test_first_object(raw, want):
    got = nested.first_object(raw)
    assert (json.loads(got) if got else None) == want


def test_validation(spark):
    rows = ['{"entities":[{"text":"a","type":"T"}],"relations":[]}', '{"entities":[{"text":1,"type":"T"}],"relations":[]}', '{"entities":[],"relations":[],"x":1}', '{"entities":[],"relations":[{"head":"a","type":"t","tail":"b"}]}', "[]", None]
    df = spark.createDataFrame([(r,) for r in rows], "p string").select(nested.validation("p").alias("v")).select("v.*")
    assert [(r.json_valid, r.exact_keys, r.entities_valid, r.relations_valid, r.schema_valid) for r in df.collect()] == [
        (True, True, True, True, True), (True, True, False, True, False), (True, False, True, True, False), (True, True, True, True, True), (False, False, False, False, False), (False, False, False, False, False),
    ]


def test_arrays(spark):
    assert one(spark, nested.dedupe_caseless(F.col("a")), a=["b", "A", "a", "B"]) == ["A", "b"]
    assert one(spark, nested.labels_from_lines(F.col("a")), a="1\n x\n 2 \n-3\n4.5\n12345678901") == [1, 2, -3, 12345678901]
    assert one(spark, nested.binary_labels(F.col("a")), a="1 0 10 1.0 0") == [1, 0, 0]
    assert one(spark, nested.positive_runs(F.col("a")), a=[0, 1, 1, 2, 2, 0, 1]) == 2


def test_islands_and_samples(spark):
    df = spark.createDataFrame([("d", i, v) for i, v in enumerate([0, 1, 1, 2, 2, 0, 1])], "k string, i int, v int")
    runs = sampling.islands(df, ["k"], ["i"], "v").where("v > 0").orderBy("first").collect()
    assert [(r.v, r["first"], r["last"]) for r in runs] == [(1, 1, 2), (2, 3, 4), (1, 6, 6)]
    pts = spark.createDataFrame([(1, 5), (2, 4), (2, 6), (3, 6)], "x int, y int")
    assert sorted(map(tuple, sampling.pareto(pts, "x", "y").collect())) == [(1, 5), (2, 6)]
    with pytest.raises(ValueError):
        sampling.quartile_sample(df, ["k"], ["v"], "i", 6)


def test_scoring(spark):
    items = lambda s: spark.createDataFrame([("k", x) for x in s] + [("z", "q")] * (s == "abc"), "k string, x string")
    got = {r.k: r for r in scoring.multiset_f1(items("aab"), items("abc"), ["k"], "x").collect()}
    assert (got["k"].tp, got["k"].precision, got["k"].recall) == (2, pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert (got["z"].precision, got["z"].recall, got["z"].f1) == (0.0, 0.0, 0.0)
    c = spark.createDataFrame([([(0.9, 0, 1), (0.9, 1, 1), (0.5, 0, 0)],)], "c array<struct<score: double, p: int, g: int>>")
    assert c.select(scoring.greedy_matches(F.col("c"))).first()[0] == 2


def test_stats(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 10)], "v double")
    s = df.agg(*stats.summary("v")).first()
    assert s.p95 == pytest.approx(9.1) and s.n == 4
    assert df.limit(1).agg(*stats.summary("v")).first().std == 0.0 and df.limit(0).agg(*stats.summary("v")).first().std is None
    mc = spark.createDataFrame([(19, 1), (0, 0)], "b long, c long").select(stats.mcnemar("b", "c").alias("p")).collect()
    assert [r.p for r in mc] == [pytest.approx(4.00543212890625e-05), 1.0]
    h = stats.holm(spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "i int, p double"), "p").orderBy("i").collect()
    assert [r.p_holm for r in h] == [pytest.approx(0.03), pytest.approx(0.06), pytest.approx(0.06), None] and h[3].significant is None
    pairs = spark.createDataFrame([("a", 0.0, float(i)) for i in range(1, 7)] + [("b", 1.0, 1.0)], "k string, l double, r double")
    w = {r.k: r for r in stats.wilcoxon(pairs, ["k"], "l", "r").collect()}
    assert (w["a"].w, w["a"].p, w["a"].sign_effect, w["b"].p) == (0.0, pytest.approx(2 / 64), 1.0, 1.0)


def test_drift(spark):
    v = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, [-2.0, 0.0]), ("b", 0, [0.0, 3.0])], "k string, i int, embedding array<float>")
    c = {r.k: r.centroid for r in drift.centroids(v, ["k"]).collect()}
    assert c == {"a": None, "b": [0.0, 1.0]}
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), (None, [1.0]), (None, None)], "l array<double>, r array<double>")
    assert [r[0] for r in rows.select(drift.drift(F.col("l"), F.col("r"))).collect()] == [1.0, 2.0, 1.0, 0.0]


def test_latest_keeps_schema(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z"), ("", 4, "w")], "id string, seq int, v string")
    got = compaction.latest(df, "id", ["seq"])
    assert got.columns == df.columns and list(map(tuple, got.collect())) == [("a", 2, "y")]


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "é", "train"), ("b", 'q"\n', "dev")], "id string, v string, split string")
    assert writers.jsonl(df, f"{tmp_path}/j") == 2
    assert sorted(map(tuple, readers.strict_jsonl(spark, f"{tmp_path}/j", df.schema).collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "torn.jsonl").write_text('{"id": "a"}\n{"id": "b"\n')
    assert readers.tolerant_jsonl(spark, f"{tmp_path}/torn.jsonl", df.select("id").schema).count() == 1
    assert readers.tolerant_jsonl(spark, f"{tmp_path}/none*.jsonl", df.schema).count() == 0
    with pytest.raises(Exception, match="torn.jsonl:2: not a JSON object"):
        readers.strict_jsonl(spark, f"{tmp_path}/torn.jsonl", df.select("id").schema).collect()
    for name, body, want in (("w.json", '{"data": [{"a": 1}, {"a": 2}]}', 2), ("a.json", '[{"a": 1}]', 1), ("l.json", '{"a": 1}\n\nbad\n{"a": 2}\n', 3)):
        (tmp_path / name).write_text(body)
        got = readers.json_records(spark, str(tmp_path / name)).collect()
        assert len(got) == want and sum(r.error is not None for r in got) == (name == "l.json")
    writers.csv(df, f"{tmp_path}/c", ["split", "v"])
    assert sorted(map(tuple, readers.csv_strings(spark, f"{tmp_path}/c").collect())) == [("dev", 'q"\n'), ("train", "é")]
    (tmp_path / "tok").mkdir()
    (tmp_path / "tok" / "1.tokens").write_text("a\n\nb\n\n\n")
    assert readers.token_files(spark, f"{tmp_path}/tok").first().tokens == ["a", "", "b"]
    assert readers.best_directory(spark, str(tmp_path), "*.tokens").first().files == 1
    assert writers.merged_summary({"a": [1], "b": 1}, {"a": [2, 1], "b": 2}, ["a"]) == {"a": [1, 2], "b": 2} and writers.merged_summary(None, {"x": 1}) == {"x": 1}


def test_streamed_log_and_batches(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "id string, v int")
    df.write.json(src)
    for _ in range(2):  # a restart adds nothing
        log.append_once(log.follow(spark, src, df.schema), "id", out, ck).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b"]
    seen = []
    log.monitor(log.follow(spark, src, df.schema), lambda b, i: seen.append(b.count()), f"{ck}2", once=True).awaitTermination()
    assert seen == [3]
    assert log.batches_of([10, 20, 30], 10, 2, 60) == [0, 0, 1]
    assert log.batches_of([100], 10, 2, 60) == [0]


def test_bootstrap_draws_as_often_as_the_reference(spark):
    x = [1.0, 2.0, 4.0, 8.0, 16.0]

    def points(draws):
        at = lambda i, j: int(hashlib.md5(f"k|{i}|{j}".encode()).hexdigest()[:8], 16) % len(x)
        means = sorted(sum(x[at(i, j)] for j in range(len(x))) / len(x) for i in range(draws))
        cut = lambda q: means[math.floor(q)] + (means[math.ceil(q)] - means[math.floor(q)]) * (q - math.floor(q))
        return [cut(0.025 * (draws - 1)), cut(0.975 * (draws - 1))]

    rows = spark.createDataFrame([("k", v) for v in x], "k string, x double")
    got = stats.bootstrap_mean(rows, ["k"], "x").first()
    assert [got.ci_low, got.ci_high] == pytest.approx(points(2000)) and points(2000) != pytest.approx(points(200))


def test_micro_batches_of_many_parts_are_those_of_the_whole_list(spark):
    rows = [(i * 7919 % 3001 - 50, i * i % 90 if i % 3 else 40, 5 if i % 4 else 9) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, prompt_tokens int, max_new_tokens int").repartition(5)
    lost = spark.createDataFrame([(9000 + i, None, 5) for i in range(9)], df.schema)
    got = sorted((r.batch, r.id) for r in log.micro_batches(df.union(lost), 4, 300, chunk=64).collect() if r.prompt_tokens is None)
    assert [i for _, i in got] == list(range(9000, 9009)) and got[-1][0] - got[0][0] in (2, 3)
    for most, budget in ((8, 300), (7, 10**6), (1000, 400), (3, 10)):
        got = log.micro_batches(df, most, budget, chunk=64).collect()
        assert len({(r.max_new_tokens, r.part) for r in got}) > 20
        for new in (5, 9):
            whole = sorted((size, i) for i, size, limit in rows if limit == new)
            want = dict(zip((i for _, i in whole), log.batches_of([size for size, _ in whole], new, most, budget)))
            assert {r.id: r.batch for r in got if r.max_new_tokens == new} == want
