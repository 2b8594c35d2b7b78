import pytest
from pyspark.sql import functions as F

from tarn.llm.mixing import mix, repeated, water_fill

S = "doc_id long, text string, source string, size string, bucket int"


def filled(sizes, weights=(5, 2, 1), share=1.5, epochs=2.0):
    """Clamp and deal again until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        t = {s: left * w[s] / sum(w[r] for r in rest) for s in rest}
        over = [s for s in rest if t[s] >= epochs * sizes[s]]
        if not over:
            return capped | t
        capped |= {s: epochs * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100, None: 100}, {"a": 1, "b": 1000, "c": 5, "d": 0}, {"z": 7}, {"a": 10, "b": 9000, "c": 10, "d": 10, "é": 4, "Z": 2}])
def test_water_fill(spark, sizes):
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in water_fill(df).collect()}
    assert got == pytest.approx(filled(sizes))


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (1 + i * i % 37)), "s%d" % (i % 5) if i % 5 else None) for i in range(900)]
    rows += [(None, "a b", "s1"), (5, None, "s1"), (6, "", None), (1, rows[1][1], rows[1][2]), (7000, "w " * 60000, "s2")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], S).repartition(6)
    got = mix(df).collect()
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mix(df.repartition(3)).collect()))
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert all(0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
        assert own[0].source_size == sum(r.size for r in own)
    out = repeated(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)


def test_fraction_that_ends_with_a_bucket(spark):
    """Rate 1.5 of equal documents: half of the words, a whole number of documents, are the fraction."""
    df = spark.createDataFrame([(i, "w " * 10, "s", "x", 1) for i in range(200)], S)
    got = mix(df).collect()
    assert got[0].target == 3000 and sum(r.taken for r in got) == 3000


def test_empty_table(spark):
    df = spark.createDataFrame([], S)
    assert mix(df).count() == 0 and repeated(df).count() == 0
    one = spark.createDataFrame([(1, None, None, "x", 1)], S)
    assert [(r.target, r.taken) for r in mix(one).collect()] == [(0.0, 0)]


def test_no_python_in_plan(spark):
    df = spark.createDataFrame([(1, "a b", "s", "x", 1)], S)
    plan = mix(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert F is not None
