"""Ranks, percentiles and bootstraps whose groups aren't gathered."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarn.operators import ranks, sampling, stats


def rows(n=4000):
    r = np.random.default_rng(3)
    k = np.where(np.arange(n) % 3 > 0, "hot", np.char.add("k", (np.arange(n) % 40).astype(str))).astype(object)
    k[::97] = None
    return pd.DataFrame({"k": k, "v": np.round(r.normal(size=n) * 50), "c": r.integers(1, 5, n), "id": np.arange(n)})


@pytest.mark.parametrize("n_ranges", [1, 2, 40, 500])
def test_sums_before_a_row(spark, n_ranges):
    d = rows()
    got = ranks.before(spark.createDataFrame(d), ["k"], ["v", "id"], {"s": "c", "r": "1L"}, {"total": "s"}, ranges=n_ranges).toPandas().set_index("id").sort_index()
    d = d.sort_values(["v", "id"])
    by = d.groupby("k", dropna=False)["c"]
    assert (got["s"] == (by.cumsum() - d["c"]).sort_index()).all()
    assert (got["r"] == by.cumcount().sort_index()).all() and (got["total"] == by.transform("sum").sort_index()).all()


def test_one_key_over_many_ranges(spark):
    d = spark.range(20_000).select(F.lit(1).alias("k"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("v"))
    got = ranks.before(d, ["k"], ["v"], {"r": "1L"}, ranges=64)
    assert got.agg(F.countDistinct("r"), F.min("r"), F.max("r"), F.corr("v", "r")).first()[:3] == (20_000, 0, 19_999)
    bounds = ranks._bounds(d, ["k", "v"], 64, 20_000).first().bounds
    assert 50 <= len(bounds) < 70 and bounds == sorted(bounds)


def test_no_rows_and_no_keys(spark):
    d = spark.createDataFrame([], "k string, v int")
    assert ranks.before(d, ["k"], ["v"], {"r": "1L"}, ranges=8).count() == 0
    some = spark.createDataFrame([(x,) for x in (3, 1, None, 2)], "v int")
    assert [tuple(r) for r in ranks.before(some, [], ["v"], {"r": "1L"}, {"n": "r"}, ranges=3).orderBy("r").collect()] == [(None, 0, 4), (1, 1, 4), (2, 2, 4), (3, 3, 4)]


@pytest.fixture
def ranged(monkeypatch):
    """Everything goes by several ranges, however small it is."""
    monkeypatch.setattr(ranks, "ONE_RANGE", 0)
    monkeypatch.setattr(stats, "ONE_RANGE", 0)
    monkeypatch.setattr(ranks, "ROWS_A_RANGE", 50)


def test_the_four_users_by_ranges_give_the_same(spark, ranged, monkeypatch):
    d = spark.createDataFrame(rows(1500))

    def results():
        pairs = d.select("k", F.col("c").cast("double").alias("l"), (F.col("v") / 7 + F.col("c")).alias("r"))
        return [
            stats.average_ranks(d, ["k"], "v").collect(), stats.wilcoxon(pairs, ["k"], "l", "r").collect(), stats.spearman(d, ["k"], "v", "c").collect(),
            sampling.length_buckets(d.select("k", "v", "id"), "v", ["k"], "id").collect(), sampling.quartile_sample(d.select("k", "v", "id"), ["k"], ["v"], "id", 8).collect(),
        ]

    plain = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    by_ranges = [sorted(map(plain, r), key=str) for r in results()]
    monkeypatch.setattr(ranks, "ONE_RANGE", 1 << 40)
    assert by_ranges == [sorted(map(plain, r), key=str) for r in results()]


def test_percentiles_in_two_passes(spark, ranged):
    d = rows(9000)
    d.loc[::50, "v"] = np.nan
    df = spark.createDataFrame(d).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    qs = [0.0, 0.025, 0.5, 0.9, 0.95, 1.0]
    want = {None if isinstance(k, float) else k: [x.quantile(q) for q in qs] for k, x in d.groupby("k", dropna=False)["v"]}
    got = stats.exact_percentiles(df, ["k"], "v", qs, large=100, accuracy=50)
    assert {r.k: pytest.approx(r.percentiles, abs=1e-9) for r in got.collect()} == want
    one = stats.exact_percentiles(df, [], "v", qs, large=100, accuracy=20).first()
    assert list(one.percentiles) == pytest.approx([d["v"].quantile(q) for q in qs], abs=1e-9)
    none = stats.exact_percentiles(df.where("v is null").withColumn("v", F.lit(None).cast("double")), ["k"], "v", qs, large=1)
    assert all(r.percentiles is None for r in none.collect())


def test_a_bracket_that_misses_is_widened(spark, ranged, monkeypatch):
    d = spark.createDataFrame(rows(2000))
    real, calls = stats._selected, []

    def missing(*a):
        calls.append(1)
        out = real(*a)
        return out.withColumn("_x", F.when(F.col("k") != "hot", F.col("_x"))) if len(calls) == 1 else out

    monkeypatch.setattr(stats, "_selected", missing)
    got = {r.k: r.percentiles for r in stats.exact_percentiles(d, ["k"], "v", [0.5], large=10).collect()}
    assert len(calls) == 2 and got["hot"] == [rows(2000).query("k == 'hot'")["v"].median()]


def test_summaries_of_large_groups(spark, ranged, monkeypatch):
    d = spark.createDataFrame(rows(3000))
    want = {r.k: r for r in d.groupBy("k").agg(*stats.summary("v"), F.max("c").alias("c")).collect()}
    monkeypatch.setattr(stats, "LARGE", 100)
    got = {r.k: r for r in stats.summarised(d, ["k"], "v", more=[F.max("c").alias("c")]).collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert [r[c] for c in r.__fields__] == pytest.approx([want[k][c] for c in r.__fields__])


def test_bootstrap_of_a_large_group_by_counts(spark):
    r = np.random.default_rng(1)
    x = r.exponential(size=50_000)
    d = spark.createDataFrame(pd.DataFrame({"k": ["big"] * 50_000 + ["small"] * 5, "x": [*x, 1, 2, 3, 4, 5]}))
    got = {r.k: r for r in stats.bootstrap_mean(d, ["k"], "x", 500, counted=30_000).collect()}
    se = x.std() / 50_000**0.5
    assert got["big"].n == 50_000 and got["big"]["mean"] == pytest.approx(x.mean())
    assert got["big"].ci_low == pytest.approx(x.mean() - 1.96 * se, abs=0.4 * se) and got["big"].ci_high == pytest.approx(x.mean() + 1.96 * se, abs=0.4 * se)
    again = {r.k: r for r in stats.bootstrap_mean(d.repartition(7), ["k"], "x", 500, counted=30_000).collect()}
    assert again["big"].ci_low == pytest.approx(got["big"].ci_low, abs=1e-9) and again["small"] == got["small"]
    alone = stats.bootstrap_mean(d.where("k = 'small'"), ["k"], "x", 500).first()
    assert alone.ci_low == got["small"].ci_low  # draws of small groups don't depend on the others
    joined = stats.bootstrap_mean(d, ["k"], "x", 500, most=2, counted=30_000)
    assert {r.k: pytest.approx(r.ci_low) for r in joined.collect()} == {k: v.ci_low for k, v in got.items()}


def test_bootstrap_of_200000_values_and_more_takes_the_same_draws(spark):
    n, draws, prime = 210_000, 12, stats.PRIME
    x = np.floor(np.random.default_rng(2).random(n) * 3000)
    d = spark.createDataFrame(pd.DataFrame({"k": "k", "x": x})).repartition(5)
    got = stats.bootstrap_mean(d, ["k"], "x", draws).first()
    fifth = lambda a: (a * a % prime) * (a * a % prime) % prime * a % prime
    seed, j = int(hashlib.sha256(b"k").hexdigest()[:8], 16), np.arange(n)
    place = lambda i: fifth((fifth((seed + i * 1000003 + j * 7919 + 12345) % prime) + i * 31 + j * 17 + 1) % prime) % n
    means = [np.sort(x)[place(i)].mean() for i in range(draws)]
    assert [got.ci_low, got.ci_high] == pytest.approx(np.quantile(means, [0.025, 0.975]).tolist(), rel=1e-12)
    for m in (1, 2, 5, 16_384, 16_385, 40_000):  # a tile of several iterations, of one, and several of one iteration
        j, v, n = np.arange(m), np.sort(x[:m]), m
        assert stats._means(v, seed, 3, 20) == pytest.approx([v[place(i)].mean() for i in range(3, 20)], rel=1e-12)


def test_exact_mcnemar(spark):
    from fractions import Fraction
    from math import comb

    pairs = [(0, 0), (2, 8), (8, 2), (0, 1), (1, 5), (0, 30), (5, 5), (250, 260), (500, 500), (490, 511), (3000, 3100), (0, 2000)]
    got = spark.createDataFrame(pairs, "b int, c int").select("b", "c", stats.mcnemar("b", "c").alias("p")).collect()
    for b, c, p in got:
        n, k = b + c, min(b, c)
        want = float(min(1, Fraction(2 * sum(comb(n, i) for i in range(k + 1)), 2**n)))
        assert p == want if n <= 30 else p == pytest.approx(want, rel=1e-9)
