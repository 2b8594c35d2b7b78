"""Deterministic samples, buckets, frontiers and top rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .compaction import settled
from .ranks import before
from .stats import exact_percentiles


def placed(rows: DataFrame, keys: Sequence[str], order: str, tie: Sequence[str], cut: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """rows with cut(rank, n): rank, from 1, by (order, tie) within keys, n the size of the key's group; cut is monotone in rank.

    Not one sort of a key's rows: how often each order value occurs tells the ranks it spans, and where cut is the same at both ends, it is
    known. Only the rows of the few values within which cut changes are ranked."""
    counts = settled(rows.groupBy(*keys, order).agg(F.count("*").alias("_c")))
    spans = before(counts, keys, [order], {"_b": "_c"}, {"_n": "_b"})
    spans = spans.withColumn("_lo", cut(F.col("_b") + 1, F.col("_n"))).withColumn("_hi", cut(F.col("_b") + F.col("_c"), F.col("_n")))
    on = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, order]])
    met = rows.alias("l").join(spans.alias("r"), on).select("l.*", "_b", "_n", "_lo", "_hi")
    sure = met.where(F.col("_lo").eqNullSafe(F.col("_hi"))).withColumn(name, F.col("_lo"))
    ranked = before(met.where(~F.col("_lo").eqNullSafe(F.col("_hi"))), [*keys, order], tie, {"_r": "1L"})
    close = ranked.withColumn(name, cut(F.col("_b") + F.col("_r") + 1, F.col("_n"))).drop("_r")
    return sure.unionByName(close).drop("_b", "_n", "_lo", "_hi")


def quartile_sample(rows: DataFrame, keys: Sequence[str], order: Sequence[str], digest: str, total: int) -> DataFrame:
    """total / 4 rows of the smallest digest from each quarter of the order; quarters end at half-even rounded bounds."""
    if total % 4:
        raise ValueError("the total has to be a multiple of 4")
    stratum = lambda r, n: F.when(r <= F.bround(n / 4), 0).when(r <= F.bround(n / 2), 1).when(r <= F.bround(n * 3 / 4), 2).otherwise(3)
    q = placed(rows, keys, order[0], [*order[1:], digest], stratum, "stratum")
    best = F.row_number().over(Window.partitionBy(*keys, "stratum").orderBy(digest))  # a limit by group, taken before the shuffle too
    return q.withColumn("_b", best).where(F.col("_b") <= total // 4).drop("_b")


def length_buckets(rows: DataFrame, size: str, keys: Sequence[str], tie: str, name: str = "bucket") -> DataFrame:
    """short, medium or long by thirds of rank / n."""
    third = lambda r, n: F.when(r / n <= 1 / 3, "short").when(r / n <= 2 / 3, "medium").otherwise("long")
    return placed(rows, keys, size, [tie], third, name)


def pareto(rows: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, x, y) of the frontier: the points that no point with a smaller or equal x and an at least as large y stands before. Rows that share a point
    give it once; a join with rows on it finds them."""
    best = rows.groupBy(*keys, x).agg(F.max(y).alias(y))  # one row for each x, however many rows there are
    top = F.max(y).over(Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, -1))
    return best.withColumn("_top", top).where(F.col("_top").isNull() | (F.col(y) > F.col("_top"))).drop("_top")


def demos(rows: DataFrame, size: str, digest: str, pool: int = 100, count: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """Of the pool shortest rows, by keys, the count with the smallest digests."""
    if not keys:
        return rows.orderBy(size, digest).limit(pool).orderBy(digest).limit(count)
    first = lambda r, order, n: r.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n).drop("_k")
    return first(first(rows, [size, digest], pool), [digest], count)


def binned_median(rows: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """Medians of x and y in bins of equal frequency; equal edges fall together, bins are closed to the right. Nothing where there are
    fewer rows than bins or fewer than three different x; rows without a finite x and y don't count."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    rows = rows.where(finite(x) & finite(y))
    seen = rows.groupBy(x).agg(F.count("*").alias("c")).agg(F.sum("c").alias("n"), F.count("*").alias("d"))
    rows = rows.join(F.broadcast(seen)).where((F.col("n") >= bins) & (F.col("d") >= 3)).drop("n", "d")
    edges = exact_percentiles(rows, [], x, [i / bins for i in range(bins + 1)]).select(F.array_distinct("percentiles").alias("edges"))
    dealt = rows.join(F.broadcast(edges)).withColumn("bin", F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e < F.col(x))))).drop("edges")
    middle = lambda c, name: exact_percentiles(dealt, ["bin"], c, [0.5]).select("bin", F.get("percentiles", 0).alias(f"{name}_median"))
    return dealt.groupBy("bin").agg(F.count("*").alias("n")).join(middle(x, "x"), "bin").join(middle(y, "y"), "bin")


def islands(rows: DataFrame, keys: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """Maximal runs of equal labels: label, first and last place, length."""
    w = Window.partitionBy(*keys).orderBy(*order)
    r = rows.withColumn("place", F.row_number().over(w) - 1).withColumn("_new", (~F.col(label).eqNullSafe(F.lag(label).over(w)) | (F.col("place") == 0)).cast("int"))
    r = r.withColumn("run", F.sum("_new").over(w))
    return r.groupBy(*keys, "run", label).agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("length"))


def spans(rows: DataFrame, keys: Sequence[str], labels: str, tokens: str, kind: Column) -> DataFrame:
    """Of rows with an array of labels and one of tokens: keys, id, type, start_token, end_token, start_char, end_char, text of each maximal run
    of equal labels other than 0, in order. Rows stay where they are."""
    at = lambda i: F.coalesce(F.get(F.col(labels), i).cast("int"), F.lit(0))
    places = F.filter(F.sequence(F.lit(0), F.size(labels) - 1), lambda i: (i >= 0) & (i < F.size(labels)) & (at(i) != 0))
    first, last = F.filter(places, lambda i: at(i) != at(i - 1)), F.filter(places, lambda i: at(i) != at(i + 1))
    runs = rows.withColumn("_off", text.offsets(F.col(tokens))).withColumn("_type", kind).withColumn("_runs", F.zip_with(first, last, lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    fits = F.filter("_runs", lambda r: r["b"] < F.size(tokens))
    each = runs.select(*keys, "_off", tokens, "_type", F.posexplode(fits))
    return each.select(*keys, F.format_string("E%04d", F.col("pos") + 1).alias("id"), F.col("_type").alias("type"), F.col("col.a").alias("start_token"), F.col("col.b").alias("end_token"), F.get("_off", F.col("col.a"))["start_char"].alias("start_char"), F.get("_off", F.col("col.b"))["end_char"].alias("end_char"), text.span_text(F.col(tokens), F.col("col.a"), F.col("col.b")).alias("text"))
