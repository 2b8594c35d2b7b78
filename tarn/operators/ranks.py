"""Running sums and ranks in which a key of any size is shared out: ranges of (key, order), their sums, sums before each range, local windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

ROWS_A_RANGE = 500_000
ONE_RANGE = 32 << 20  # bytes, by estimate, below which rows aren't counted
MOST_RANGES = 2048  # the bounds are a literal of the plan
SAMPLED = 24  # rows for each bound


def at_most(rows: DataFrame, size: int) -> bool:
    """Whether the plan's own estimate, made without a job, is below so many bytes."""
    try:
        return int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString()) <= size
    except Exception:  # no JVM at hand: a count decides
        return False


def _bounds(rows: DataFrame, by: Sequence[str], ranges: int, total: int) -> DataFrame:
    """One row, bounds: at most ranges - 1 places between ranges of about as many rows. By a hash of what is ordered, so that it is the same
    in every run; some SAMPLED * ranges rows come to the driver, four times as many at most, once, so that all who read it see the same."""
    every = max(1, total // (ranges * SAMPLED))
    some = rows.select(*by).where(F.pmod(F.xxhash64(*by), F.lit(every)) == 0).distinct().limit(4 * ranges * SAMPLED).sort(*by)
    found = some.collect()
    step = max(1, len(found) // ranges)
    return rows.sparkSession.createDataFrame([(found[step::step],)], StructType([StructField("bounds", ArrayType(some.schema, False), False)]))


def _range_of(place: Column, bounds: Column, ranges: int) -> Column:
    """How many bounds are at most place: a binary search, some log2(ranges) comparisons a row."""
    steps = F.sequence(F.lit(1), F.lit(max(1, ranges.bit_length() + 2)))
    start = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        right = F.get(bounds, mid) <= place
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~right, mid).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(steps, start, halve, lambda s: s["lo"])


def ranged(rows: DataFrame, by: Sequence[str], ranges: int, total: int, name: str = "_range") -> DataFrame:
    """rows, of which there are `total`, with the number of the range that they are in: at most `ranges`, and MOST_RANGES, in order of the columns by, of
    about the same size. Rows that are equal in these are in one range."""
    ranges = max(1, min(MOST_RANGES, ranges))
    if ranges == 1:
        return rows.withColumn(name, F.lit(0))
    bounds = _bounds(rows, by, ranges, total)
    return rows.join(F.broadcast(bounds)).withColumn(name, _range_of(F.struct(*by), F.col("bounds"), ranges)).drop("bounds")


def before(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, str | Column], totals: Mapping[str, str] | None = None, ranges: int | None = None, rows_a_range: int | None = None) -> DataFrame:
    """rows with a column for each of sums: the sum, over the rows of the same keys that stand before by order (nulls first), of its
    expression; 0 for the first. totals: names of further columns, and the one of sums whose total over the keys' rows they hold.

    Rows that are equal in keys and order are one after the other in no stated order. Null keys are a key. A key isn't sorted as a whole:
    (keys, order) is cut into ranges of about equal size, each range is summed for itself, and a range gets the sums of the same key's
    ranges before it; of these at most one a range isn't 0. So a task gets the rows of one range, whatever the keys are, unless rows are equal in
    all of keys and order. ranges: how many; else by the number of rows, about rows_a_range (ROWS_A_RANGE) in each. rows is read some times over."""
    totals = totals or {}
    sums = {n: F.expr(e) if isinstance(e, str) else e for n, e in sums.items()}
    if ranges is None and rows_a_range is None and at_most(rows, ONE_RANGE):
        ranges = 1
    if ranges is None:
        total = rows.count()
        ranges = min(MOST_RANGES, -(-total // (rows_a_range or ROWS_A_RANGE)))
    else:
        total = rows.count() if ranges > 1 else 0
    if ranges <= 1:
        own = Window.partitionBy(*keys)
        w = own.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        out = rows.withColumns({n: F.coalesce(F.sum(e).over(w), F.lit(0)) for n, e in sums.items()})
        return out.withColumns({n: F.coalesce(F.sum(sums[s]).over(own), F.lit(0)) for n, s in totals.items()}) if totals else out
    by = [*dict.fromkeys([*keys, *order])]
    laid = ranged(rows, by, ranges, total)
    each = laid.groupBy("_range", *keys).agg(*[F.sum(e).alias(f"_s_{n}") for n, e in sums.items()])
    own = Window.partitionBy(*keys)
    w = own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    based = each.select("_range", *keys, F.count("*").over(own).alias("_ranges"), *[F.coalesce(F.sum(f"_s_{n}").over(w), F.lit(0)).alias(f"_b_{n}") for n in sums], *[F.sum(f"_s_{s}").over(own).alias(f"_t_{n}") for n, s in totals.items()])
    # a key within one range needs nothing from elsewhere; of the others, a range holds two at most, its first and its last
    far = based.where("_ranges > 1").drop("_ranges")
    local = Window.partitionBy("_range", *keys)
    lw = local.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = laid.withColumns({f"_l_{n}": F.coalesce(F.sum(e).over(lw), F.lit(0)) for n, e in sums.items()} | {f"_lt_{n}": F.sum(sums[s]).over(local) for n, s in totals.items()})
    on = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"f.{k}")) for k in ["_range", *keys]])
    met = here.alias("l").join(F.broadcast(far).alias("f"), on, "left")
    kept = [F.col(f"l.{c}").alias(c) for c in rows.columns]
    return met.select(
        *kept,
        *[(F.col(f"_l_{n}") + F.coalesce(F.col(f"_b_{n}"), F.lit(0))).alias(n) for n in sums],
        *[F.coalesce(F.col(f"_t_{n}"), F.col(f"_lt_{n}"), F.lit(0)).alias(n) for n in totals],
    )
