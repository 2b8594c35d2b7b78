"""Order statistics, bootstrap, paired tests, multiplicity and rank correlation."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.text import seed32
from .compaction import settled, small
from .ranks import ONE_RANGE, at_most, before


QUANTILES = (0.5, 0.9, 0.95)


def _moments(value: str) -> list[tuple[str, Column]]:
    std = F.when(F.count(value) > 0, F.coalesce(F.stddev_samp(value), F.lit(0.0)))
    return [("n", F.count(value)), ("mean", F.avg(value)), ("std", std), ("max", F.max(value))]


def summary(value: str, prefix: str = "") -> list[Column]:
    """n, mean, median, sample deviation (0 for one row), p90, p95 and maximum; nulls don't count, nothing gives nulls. For groups whose distinct
    values fit into a task, as one buffer; else summarised."""
    q = F.percentile(value, F.lit(list(QUANTILES)))
    m = dict(_moments(value))
    cols = [("n", m["n"]), ("mean", m["mean"]), ("median", q[0]), ("std", m["std"]), ("p90", q[1]), ("p95", q[2]), ("max", m["max"])]
    return [c.alias(prefix + n) for n, c in cols]


ACCURACY = 10_000  # of the sketch that brackets a percentile
LARGE = 200_000  # values of a group from which on its percentiles are selected in two passes


def _selected(rows: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], groups: DataFrame) -> DataFrame:
    """(keys, _q, _x) by percentile: the exact one, null where the bracket misses it. groups: keys, _n, and _lo and _hi, the brackets by percentile."""
    on = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys], F.lit(True))
    met = rows.select(*keys, F.col(value).cast("double").alias("_v")).alias("l").join(small(groups).alias("g"), on).select("l.*", "_n", "_lo", "_hi")
    each = F.transform(F.sequence(F.lit(0), F.lit(len(qs) - 1)), lambda i: F.struct(i.alias("_q"), (F.col("_v") < F.get("_lo", i)).alias("_below"), F.col("_v").between(F.get("_lo", i), F.get("_hi", i)).alias("_in")))
    hits = met.select(*keys, "_n", "_v", F.explode(F.filter(each, lambda x: x["_below"] | x["_in"])).alias("h")).select(*keys, "_n", "h._q", F.when(F.col("h._in"), F.col("_v")).alias("_v"))
    counts = settled(hits.groupBy(*keys, "_n", "_q", "_v").agg(F.count("*").alias("_c")))  # what lies below is one row, null, the first in order
    by = [*keys, "_n", "_q"]
    placed = before(counts, by, ["_v"], {"_b": "_c"})
    fraction = F.element_at(F.lit(list(qs)), F.col("_q") + 1)
    place = (F.col("_n") - 1) * fraction
    at = lambda r: F.max(F.when((F.col("_b") <= r) & (r < F.col("_b") + F.col("_c")), F.col("_v")))
    both = placed.withColumn("_p", place).groupBy(*by).agg(at(F.floor("_p")).alias("_low"), at(F.ceil("_p")).alias("_high"), F.max("_p").alias("_p"))
    x = F.when(F.floor("_p") == F.ceil("_p"), F.col("_low")).otherwise((F.ceil("_p") - F.col("_p")) * F.col("_low") + (F.col("_p") - F.floor("_p")) * F.col("_high"))
    return both.select(*keys, "_q", x.alias("_x"))


def exact_percentiles(rows: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float] = QUANTILES, large: int = LARGE, accuracy: int = ACCURACY) -> DataFrame:
    """(keys, percentiles): the exact percentiles of each group's values other than null, interpolated between neighbours as percentile() does; a group
    without values has null.

    No buffer grows with a group: of groups of more than `large` values, a quantile sketch of fixed size brackets each percentile, then values below the
    bracket are counted and only those within it, some 4 / accuracy of all, are counted by value and ranked by ranges (ranks.before).
    Smaller groups are one aggregate. NaN is the largest value."""
    plain = lambda r: r.groupBy(*keys).agg(F.percentile(F.col(value).cast("double"), F.lit(list(qs))).alias("percentiles"))
    if at_most(rows, ONE_RANGE) and large >= LARGE:
        return plain(rows)
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > large)
    big = settled(counted)
    if big.isEmpty():
        return plain(rows)
    on = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys], F.lit(True))
    own = rows.alias("l").join(small(big).alias("g"), on, "left_semi").where(F.col(value).isNotNull())
    rest = rows.alias("l").join(small(big).alias("g"), on, "left_anti")
    margin = 2 / accuracy
    ends = [max(0.0, q - margin) for q in qs] + [min(1.0, q + margin) for q in qs]
    low = lambda c: F.array(*[F.lit(float("-inf")) if q <= margin else F.get(c, i) for i, q in enumerate(qs)])
    high = lambda c: F.array(*[F.lit(float("nan")) if q >= 1 - margin else F.get(c, i + len(qs)) for i, q in enumerate(qs)])
    sketch = own.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx(F.col(value).cast("double"), ends, accuracy).alias("_e"))
    groups = settled(sketch.select(*keys, "_n", low(F.col("_e")).alias("_lo"), high(F.col("_e")).alias("_hi")))
    found = settled(_selected(own, keys, value, qs, groups))
    missed = found.where("_x is null").select(*keys).distinct()
    if not missed.isEmpty():  # a sketch that erred by more than it may: all of the group's values are the bracket
        all_ = lambda x: F.array(*[F.lit(float(x))] * len(qs))
        wide = groups.alias("l").join(missed.alias("g"), on, "left_semi").withColumns({"_lo": all_("-inf"), "_hi": all_("nan")})
        found = found.alias("l").join(missed.alias("g"), on, "left_anti").unionByName(_selected(own, keys, value, qs, wide))
    lists = found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_q", "_x"))), lambda s: s["_x"]).alias("percentiles"))
    return plain(rest).unionByName(lists) if keys else lists


def summarised(rows: DataFrame, keys: Sequence[str], value: str, prefix: str = "", more: Sequence[Column] = ()) -> DataFrame:
    """summary by keys, for groups of any size, with further aggregates."""
    names = [prefix + n for n in ("n", "mean", "median", "std", "p90", "p95", "max")]
    if at_most(rows, ONE_RANGE):
        return rows.groupBy(*keys).agg(*summary(value, prefix), *more)
    some = rows.groupBy(*keys).agg(*[c.alias(prefix + n) for n, c in _moments(value)], *more)
    q = exact_percentiles(rows, keys, value).select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.get("percentiles", i).alias(prefix + n) for i, n in enumerate(("median", "p90", "p95"))])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.lit(True))
    rest = [c for c in some.columns if c not in names and c not in keys]
    return some.join(q, on, "left").select(*keys, *names, *rest)


PRIME = 2147483647  # of the draws' arithmetic, which fits into a long and is the same in every engine


def draw(seed: Column, i: Column, j: Column, n: Column) -> Column:
    """The place, of n, that draw j of iteration i takes. Two rounds of x ** 5 modulo a prime, a permutation, scramble (seed, i, j)."""

    def fifth(x: Column) -> Column:
        two = x * x % PRIME
        return two * two % PRIME * x % PRIME

    x = fifth((seed + i * 1000003 + j * 7919 + 12345) % PRIME)
    return fifth((x + i * 31 + j * 17 + 1) % PRIME) % n


TILE = 16_384  # draws that are made at once, so that they stay in the processor's cache
DRAWS = 50_000_000  # of a row of iterations, at least
PART_BYTES = 16 << 20  # of packed values that a task is dealt, about


def _means(values: np.ndarray, seed: int, first: int, last: int) -> np.ndarray:
    """The means of iterations first to last over ascending values: what draw does, a tile of places at once. Remainders of the prime, 2 ** 31 - 1, are
    folds of the bits above the 31st, so that there is no division; bounds are given as multiples of the prime."""
    n, p, shift = len(values), np.uint64(PRIME), np.uint64(31)
    sums = np.zeros(last - first)
    width = min(n, TILE)
    deep = max(1, min(last - first, TILE // width))
    held = [np.empty((deep, width), np.uint64) for _ in range(3)]

    def fold(x, t):
        np.right_shift(x, shift, out=t)
        np.bitwise_and(x, p, out=x)
        np.add(x, t, out=x)

    def least(x, t):  # of 0 to 2: below 1, as what is below 0 wraps round
        np.subtract(x, p, out=t)
        np.minimum(x, t, out=x)

    def fifth(x, y, t):  # of below 1: y is x ** 5, at most 3
        np.multiply(x, x, out=y)
        fold(y, t)
        least(y, t)
        np.multiply(y, y, out=y)
        fold(y, t)
        np.multiply(y, x, out=y)
        fold(y, t)

    for low in range(0, n, width):
        j = np.arange(low, min(n, low + width), dtype=np.uint64)
        once, twice = j * np.uint64(7919) % p, (j * np.uint64(17) + np.uint64(1)) % p
        for at in range(first, last, deep):
            i = np.arange(at, min(at + deep, last), dtype=np.int64)[:, None]
            x, y, t = (h[: len(i), : len(j)] for h in held)
            np.add(once, ((seed + i * 1000003 + 12345) % PRIME).astype(np.uint64), out=x)
            least(x, t)
            fifth(x, y, t)
            np.add(y, twice, out=x)
            np.add(x, (i * 31 % PRIME).astype(np.uint64), out=x)
            fold(x, t)
            least(x, t)
            fifth(x, y, t)
            fold(y, t)
            least(y, t)
            np.floor_divide(y, np.uint64(n), out=t)
            np.multiply(t, np.uint64(n), out=t)
            np.subtract(y, t, out=y)
            sums[at - first : at - first + len(i)] += values[y.view(np.int64)].sum(axis=1)
    return sums / n


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_id, x, c), sorted by _id and x: of each _id one row, with its values and how often each occurs as bytes. An _id's values are held, not more."""
    held, at = [], None

    def row():
        x, c = (np.concatenate(v) for v in zip(*held))
        once = bool((c == 1).all())
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([x.tobytes()], pa.binary()), pa.array([b"" if once else c.tobytes()], pa.binary())], ["_id", "v", "c"])

    for b in batches:
        ids, x, c = (np.array(b.column(k)) for k in ("_id", "x", "c"))
        edges = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]])) if len(ids) else []
        for i, j in zip(edges[:-1], edges[1:]):
            if held and ids[i] != at:
                yield row()
                held = []
            at = int(ids[i])
            held.append((x[i:j].astype(float), c[i:j].astype(np.int64)))
    if held:
        yield row()


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, m): the means of the iterations _first to _last of packed values."""
    for b in batches:
        for k in range(b.num_rows):
            at, v, c, seed, first, last = (b.column(x)[k].as_py() for x in ("_id", "v", "c", "seed", "_first", "_last"))
            values = np.frombuffer(v, float)
            m = _means(np.repeat(values, np.frombuffer(c, np.int64)) if c else values, seed, first, last)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), at), pa.int64()), pa.array(m, pa.float64())], ["_id", "m"])


RANGES = 1024  # of ranks, by which the draws of a large group are counted


@F.pandas_udf(ArrayType(DoubleType()))
def _drawn_by_counts(sizes: pd.Series, means: pd.Series, variances: pd.Series, seed: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
    """The means of iterations first to last. Each splits the n draws by binomials down the ranges; the sum of a range's draws has the range's
    mean and variance, and sums over that many draws are normal."""

    def one(sizes, means, variances, seed, first, last):
        sizes, means, variances = (np.asarray(x, float) for x in (sizes, means, variances))
        n = int(sizes.sum())
        out = []
        for i in range(first, last):
            rng = np.random.default_rng([int(seed), i])
            k = rng.multinomial(n, sizes / n)
            out.append(float((k @ means + np.sqrt(k @ variances) * rng.standard_normal()) / n))
        return out

    return pd.Series([one(*x) for x in zip(sizes, means, variances, seed, first, last)])


def bootstrap_mean(values: DataFrame, keys: Sequence[str], value: str, draws: int = 2000, most: int = 20_000, counted: int = 1_000_000) -> DataFrame:
    """n, mean, ci_low and ci_high by keys, the same in every run. The reference draws 2000 samples for scores, the default, and 5000 for
    dropout and drift.

    A key with at most `most` or `counted` values: draw j of iteration i takes the row at place draw(seed of the keys, i, j) of the values in order, as
    every engine does it. Values are counted by size, sorted by Spark and packed into one row a key (8 bytes for each unlike value, 16 if some repeat),
    which is dealt out with so many iterations at a time that all cores have some. A larger key's values are never gathered but ranked by ranges
    (ranks.before): they become RANGES counts, means and variances, and an iteration draws how often each range is met, so that it costs the number of
    ranges, not of values."""
    ok = values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, value)
    seed = seed32(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]) if keys else F.lit(1).cast("long")
    found = ok.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    size = settled(found.select(*keys, "n", "mean", F.monotonically_increasing_id().alias("_id"), seed.alias("seed")))
    most = max(most, counted)
    few = F.col("n") <= most
    largest, least, total = size.agg(F.max("n"), F.min("n"), F.sum(F.when(few, F.col("n").cast("double")))).first()
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))
    if not largest:
        return size.select(*keys, "n", "mean").withColumns({"ci_low": F.lit(None).cast("double"), "ci_high": F.lit(None).cast("double")})
    named = lambda cond: ok.alias("v").join(small(size.where(cond)).alias("s"), same("v", "s")).groupBy("s._id", F.col(f"v.{value}").cast("double").alias("x")).agg(F.count("*").alias("c"))
    deal, parts = values.sparkSession.sparkContext.defaultParallelism, []
    if least <= most:
        work = max(DRAWS, total * draws / (4 * deal))
        step = F.least(F.lit(draws), F.greatest(F.lit(1), F.ceil(F.lit(work) / F.col("n")))).cast("int")
        lists = settled(named(few).repartition("_id").sortWithinPartitions("_id", "x").mapInArrow(_packed, "_id long, v binary, c binary"))
        dealt = size.where(few).select("_id", "seed", "n", step.alias("_step")).withColumn("_first", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.col("_step"))))
        rows = dealt.join(lists, "_id").select("_id", "v", "c", "seed", "_first", F.least(F.col("_first") + F.col("_step"), F.lit(draws)).alias("_last"))
        sizes = lists.select("_id", (F.length("v") + F.length("c")).alias("_bytes")).join(dealt.groupBy("_id").agg(F.count("*").alias("_rows")), "_id")
        size_of = sizes.agg(F.sum(F.col("_bytes").cast("double") * F.col("_rows"))).first()[0]
        parts.append(rows.repartition(int(max(4 * deal, size_of // PART_BYTES + 1))).mapInArrow(_drawn, "_id long, m double"))
    if largest > most:
        ranked = before(settled(named(~few)), ["_id"], ["x"], {"b": "c"}, {"n": "b"})
        # a value that occurs often spans ranges; it goes to the one in which it begins, which only makes that one larger
        ranges = ranked.withColumn("r", F.expr(f"b * {RANGES} div n")).groupBy("_id", "r").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("x")).alias("s"), F.sum(F.col("c") * F.col("x") * F.col("x")).alias("ss"))
        mean = F.col("s") / F.col("c")
        variance = F.greatest(F.lit(0.0), F.col("ss") / F.col("c") - mean * mean)
        lists = ranges.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("r", "c", mean.alias("m"), variance.alias("v")))).alias("l")).join(size.select("_id", "seed"), "_id")
        by = lambda f: F.transform("l", lambda s: s[f].cast("double"))
        chunks = lists.withColumn("_first", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(50)))).repartition(deal, "_id", "_first")
        means = _drawn_by_counts(by("c"), by("m"), by("v"), "seed", F.col("_first"), F.least(F.col("_first") + 50, F.lit(draws)))
        parts.append(chunks.select("_id", F.explode(means).alias("m")))
    ends = F.percentile("m", F.lit([0.025, 0.975]))
    ci = reduce(lambda a, b: a.unionByName(b), parts).groupBy("_id").agg(ends[0].alias("ci_low"), ends[1].alias("ci_high"))
    return size.join(ci, "_id").select(*keys, "n", "mean", "ci_low", "ci_high")


def holm(rows: DataFrame, p: str, family: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """p_holm and significant: step-down adjusted within a family; null p stay null."""
    ok = F.col(p).isNotNull() & ~F.isnan(p)
    by = Window.partitionBy(*family, ok).orderBy(p, *order)
    m = F.count("*").over(Window.partitionBy(*family, ok))
    raw = F.least(F.col(p) * (m - F.row_number().over(by) + 1), F.lit(1.0))
    stepped = rows.withColumn("_raw", raw).withColumn("p_holm", F.when(ok, F.max("_raw").over(by.rowsBetween(Window.unboundedPreceding, 0))))
    return stepped.drop("_raw").withColumn("significant", F.when(ok, (F.col("p_holm") < 0.05).cast("int")))


def significant(tests: DataFrame, at: str = "p_holm", level: float = 0.05) -> DataFrame:
    """The tests whose adjusted p is below the level; one without a p isn't."""
    return tests.where(F.col(at).isNotNull() & ~F.isnan(at) & (F.col(at) < level))


EXACT_PAIRS = 1000  # up to so many discordant pairs all binomials fit into a double


def _ln_factorial(n: Column) -> Column:
    """By Stirling's series, for large n."""
    x = n.cast("double")
    return (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)


def mcnemar(b: str, c: str) -> Column:
    """Exact two-sided p of the discordant counts; 1 where there are none.

    The binomials of the lower tail, each from the one before: whole numbers, so that the sum is exact as long as it is below 2 ** 53. Beyond
    EXACT_PAIRS the tail goes down from its largest term, of which some 6 * sqrt(n) count."""
    n, k = (F.col(b) + F.col(c)).cast("long"), F.least(F.col(b), F.col(c)).cast("long")
    few = n <= EXACT_PAIRS
    one = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def added(acc: Column, factor: Column) -> Column:
        term = acc["t"] * factor
        return F.struct(term.alias("t"), (acc["s"] + term).alias("s"))

    def up(acc: Column, i: Column) -> Column:
        term = acc["t"] * (n - i) / (i + 1)
        return F.struct(term.alias("t"), (acc["s"] + term).alias("s"))

    steps = lambda last: F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<long>"))
    small = F.aggregate(steps(F.when(few, k - 1).otherwise(-1)), one, up, lambda x: x["s"]) * F.pow(F.lit(2.0), -n.cast("double"))
    reach = F.least(k - 1, (6 * F.sqrt(n.cast("double")) + 50).cast("long"))
    ratios = F.aggregate(steps(F.when(few, F.lit(-1).cast("long")).otherwise(reach)), one, lambda acc, j: added(acc, (k - j).cast("double") / (n - k + j + 1).cast("double")), lambda x: x["s"])
    top = F.exp(_ln_factorial(n) - F.when(k > 0, _ln_factorial(F.greatest(k, F.lit(1)))).otherwise(0.0) - _ln_factorial(n - k) - n.cast("double") * math.log(2))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.when(few, small).otherwise(top * ratios)))


def average_ranks(rows: DataFrame, keys: Sequence[str], value: str, weight: str | None = None, name: str = "rank") -> DataFrame:
    """(keys, value, name): the average rank of each value that occurs, from grouped counts, or sums of weight; a key is ranked by ranges."""
    counts = settled(rows.groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias("_c")))
    placed = before(counts, keys, [value], {"_b": "_c"})
    return placed.select(*keys, value, (F.col("_b") + (F.col("_c") + 1) / 2).alias(name))


@F.pandas_udf(DoubleType())
def wilcoxon_p(w: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
    """Two-sided p of the signed-rank statistic: exact for up to 50 differences without ties, else tie-corrected normal."""

    def one(w, n, ties):
        if n == 0:
            return 1.0
        n = int(n)
        if n <= 50 and ties == 0:
            counts = [1] + [0] * (n * (n + 1) // 2)
            for r in range(1, n + 1):
                for s in range(len(counts) - 1, r - 1, -1):
                    counts[s] += counts[s - r]
            return min(1.0, 2 * sum(counts[: int(w) + 1]) / 2**n)
        var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
        return math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(var) / math.sqrt(2)) if var > 0 else 1.0

    return pd.Series([one(*x) for x in zip(w, n, ties)])


def wilcoxon(pairs: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """By keys, over right - left: pairs, mean_delta, n (differences other than 0), w, p, sign_effect and rank_biserial. Ranks come from how often
    each size of difference occurs, and a key's differences are ranked by ranges."""
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    d = pairs.where(good(left) & good(right)).withColumn("d", (F.col(right) - F.col(left)).cast("double")).withColumn("a", F.abs("d"))
    counts = settled(d.groupBy(*keys, "a").agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("pos"), F.count_if(F.col("d") < 0).alias("neg")))
    other = F.col("a") > 0
    placed = before(counts, keys, ["a"], {"b": F.when(other, F.col("c")).otherwise(0)})
    ranked = placed.withColumn("r", F.col("b") + (F.col("c") + 1) / 2)
    total = lambda c: F.coalesce(F.sum(F.when(other, c)), F.lit(0))
    c = F.col("c").cast("double")
    full = ranked.groupBy(*keys).agg(F.sum("c").alias("pairs"), total(F.col("c")).alias("n"), total(F.col("pos") * F.col("r")).alias("up"), total(F.col("neg") * F.col("r")).alias("down"), total(F.col("pos")).alias("pos"), total(F.col("neg")).alias("neg"), total(c * c * c - c).alias("ties"), (F.sum(F.col("a") * (F.col("pos") - F.col("neg"))) / F.sum("c")).alias("mean_delta"))
    w = F.least("up", "down")
    return full.select(*keys, "pairs", "mean_delta", "n", w.alias("w"), wilcoxon_p(w, F.col("n"), F.col("ties")).alias("p"), ((F.col("pos") - F.col("neg")) / F.greatest(F.col("n"), F.lit(1))).alias("sign_effect"), F.coalesce((F.col("up") - F.col("down")) / F.nullif(F.col("up") + F.col("down"), F.lit(0.0)), F.lit(0.0)).alias("rank_biserial"))


def _finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


@F.pandas_udf(DoubleType())
def correlation_p(rho: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a rank correlation by Student's t with n - 2 degrees of freedom."""

    def beta(a: float, b: float, x: float) -> float:
        """The regularised incomplete beta function, by its continued fraction."""
        if x in (0.0, 1.0):
            return x
        if x > (a + 1) / (a + b + 2):
            return 1 - beta(b, a, 1 - x)
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
        c, d, h, tiny = 1.0, 1 - (a + b) * x / (a + 1), 0.0, 1e-300
        d = 1 / (d or tiny)
        h = d
        for m in range(1, 500):
            for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + t * d) or tiny)
                c = (1 + t / c) or tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return front * h

    def one(r, n):
        if r != r or n < 3:
            return None
        return 0.0 if abs(r) >= 1 else beta((n - 2) / 2, 0.5, 1 - r * r)

    return pd.Series([one(*x) for x in zip(rho, n)], dtype="float64")


def spearman(rows: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 4) -> DataFrame:
    """Rank correlation by keys, n, rho and p; null where a side has fewer than two values. Pairs with a null, NaN or infinite side don't
    count; groups of fewer than `least` pairs go."""
    ok = settled(rows.where(_finite(x) & _finite(y)).groupBy(*keys, x, y).agg(F.count("*").alias("_w")))
    on = lambda v: reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, v]])
    first = ok.alias("l").join(average_ranks(ok, keys, x, "_w", "_rx").alias("r"), on(x)).select("l.*", "_rx")
    both = first.alias("l").join(average_ranks(ok, keys, y, "_w", "_ry").alias("r"), on(y)).select("l.*", "_ry")
    n, sx, sy = F.sum("_w").cast("double"), F.sum(F.col("_w") * F.col("_rx")), F.sum(F.col("_w") * F.col("_ry"))
    sxy = F.sum(F.col("_w") * F.col("_rx") * F.col("_ry"))
    sxx, syy = F.sum(F.col("_w") * F.col("_rx") * F.col("_rx")), F.sum(F.col("_w") * F.col("_ry") * F.col("_ry"))
    spread = F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))
    two = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    rho = F.when(two, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (n * sxy - sx * sy) / spread)))
    out = both.groupBy(*keys).agg(F.sum("_w").alias("n"), rho.alias("rho")).where(F.col("n") >= least)
    return out.withColumn("p", F.when(F.col("rho").isNotNull(), correlation_p("rho", "n")))


def correlations(rows: DataFrame, x: str, targets: Sequence[str], groupings: Sequence[Sequence[str]]) -> DataFrame:
    """Rank correlations of x with each target under each grouping, with p adjusted within (grouping, target): columns grouping, all the
    grouping keys, null where not grouped by, target, n, rho, p, p_holm, significant (0 where there is no p)."""
    names = [*dict.fromkeys(k for g in groupings for k in g)]
    long = rows.select(*names, F.col(x).cast("double").alias("x"), F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y")) for t in targets])).alias("t")).select(*names, "x", "t.*")
    parts = []
    for g in groupings:
        own = spearman(long, [*g, "target"], "x", "y")
        parts.append(own.select(F.lit("+".join(g) or "all").alias("grouping"), *[F.col(k) if k in g else F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in names], "target", "n", "rho", "p"))
    return holm(reduce(lambda a, b: a.unionByName(b), parts), "p", ["grouping", "target"], names).withColumn("significant", F.coalesce("significant", F.lit(0)))


def by_level(rows: DataFrame, keys: Sequence[str], level: str, pairs: Sequence[tuple[str, str]], metrics: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """(keys, left_level, right_level, metric, left, right): the value of each metric at both levels of each pair of a row's key; equal
    keys are rows to pair. Of several rows of a key and level the last one by order counts, without an order the largest value.
    One grouped pivot for all levels and metrics, no self-join."""
    levels = [*dict.fromkeys(x for p in pairs for x in p)]
    at = lambda m, v: F.when(F.col(level) == v, F.col(m).cast("double"))
    one = (lambda m, v: F.max_by(F.col(m).cast("double"), F.when(F.col(level) == v, F.struct(*order)))) if order else (lambda m, v: F.max(at(m, v)))
    wide = rows.where(F.col(level).isin(*levels)).groupBy(*keys).agg(*[one(m, v).alias(f"{m}__{v}") for m in metrics for v in levels])
    each = F.array(*[F.struct(F.lit(a).alias("left_level"), F.lit(b).alias("right_level"), F.lit(m).alias("metric"), F.col(f"{m}__{a}").alias("left"), F.col(f"{m}__{b}").alias("right")) for a, b in pairs for m in metrics])
    return wide.select(*keys, F.explode(each).alias("t")).select(*keys, "t.*").where("left is not null and right is not null")


def paired_continuous(rows: DataFrame, groups: Sequence[str], unit: Sequence[str], level: str, pairs: Sequence[tuple[str, str]], metrics: Sequence[str]) -> DataFrame:
    """A signed-rank test for each group, pair of levels and metric, over units; p adjusted as one family."""
    by = [*groups, "left_level", "right_level", "metric"]
    return holm(wilcoxon(by_level(rows, [*groups, *unit], level, pairs, metrics), by, "left", "right"), "p", order=by)


def paired_binary(rows: DataFrame, groups: Sequence[str], unit: Sequence[str], level: str, pairs: Sequence[tuple[str, str]], metrics: Sequence[str]) -> DataFrame:
    """Exact McNemar tests of 0/1 metrics, with pairs, b (1 to 0), c (0 to 1), and p adjusted as one family."""
    by = [*groups, "left_level", "right_level", "metric"]
    t = by_level(rows, [*groups, *unit], level, pairs, metrics).groupBy(*by).agg(F.count("*").alias("pairs"), F.count_if((F.col("left") == 1) & (F.col("right") == 0)).alias("b"), F.count_if((F.col("left") == 0) & (F.col("right") == 1)).alias("c"))
    return holm(t.withColumn("p", mcnemar("b", "c")), "p", order=by)


def summaries(rows: DataFrame, groupings: Sequence[Sequence[str]], metrics: Sequence[str], draws: int = 2000) -> DataFrame:
    """By each grouping, pooled rows: documents and of every metric n, mean, median, std, p90, p95, max, ci_low, ci_high; in long form, with
    null keys where not grouped by. Nulls don't count. rows is made once for all groupings."""
    names = [*dict.fromkeys(k for g in groupings for k in g)]
    long = settled(rows.select(*names, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("t")).select(*names, "t.*"))
    parts = []
    for g in groupings:
        by = [*g, "metric"]
        some = summarised(long, by, "value", more=[F.count("*").alias("documents")])
        ci = bootstrap_mean(long, by, "value", draws).select(*[F.col(k).alias(f"c_{k}") for k in by], "ci_low", "ci_high")
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"c_{k}")) for k in by])
        met = some.join(ci, on, "left").drop(*[f"c_{k}" for k in by])
        parts.append(met.select(F.lit("+".join(g) or "all").alias("grouping"), *[F.col(k) if k in g else F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in names], *[c for c in met.columns if c not in names]))
    return reduce(lambda a, b: a.unionByName(b), parts)
