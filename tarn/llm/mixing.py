"""Operator 1, mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions.

DataFrame operations only. The heavy table is read once, for sizes; then only (id, source, size) moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, null_text, written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(column: Column) -> Column:
    return F.regexp_count(F.coalesce(column, F.lit("")), F.lit(WORD)).cast("long")


def water_fill(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """sizes (source, source_size) with a target each. One row per source; the table is as small as the list of sources.

    Sources by code point, null last, take the weights in turn. share * sum of sizes is dealt by weight; no target
    exceeds epochs * its size; what lies above is dealt again by weight until none is above. In closed form: with the
    sources by cap / weight, a source is capped while its cap is below the level at which the rest would stand.
    A source of size 0 has target 0.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_ratio = Window.orderBy("ratio", "place")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("place", F.row_number().over(order)).withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(epochs))).withColumn("ratio", F.col("cap") / F.col("weight"))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (total - before) / rest).withColumn("capped", F.col("ratio") <= F.col("level"))
    level = F.min_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), F.col("ratio"))).over(Window.partitionBy())
    return s.withColumn("final", level).select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def _placed(sized: DataFrame, seed: int, buckets: int) -> DataFrame:
    """Rows with the seeded order u and its bucket; it depends on (id, size) alone."""
    u = F.xxhash64(F.lit(seed), F.col("id"), F.col("size"))
    return sized.withColumn("u", u).withColumn("bucket", F.pmod(F.shiftrightunsigned("u", 20), F.lit(buckets)).cast("int"))


def _plan(sized: DataFrame, **fill) -> DataFrame:
    """Of placed rows, by source: s, source_size, target, whole (repetitions), and edge, start, extra_words of the bucket in which the
    fraction ends. As small as the list of sources."""
    per_bucket = written(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    fills = water_fill(per_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), **fill)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    fills = fills.withColumn("whole", F.floor(rate).cast("long")).withColumn("extra_words", (rate - F.floor(rate)) * F.col("source_size"))
    fills = written(fills, "targets")
    run = Window.partitionBy("source").orderBy("bucket")
    b = join_small(per_bucket.alias("b"), fills.select(F.col("source").alias("s"), "extra_words"), F.expr("source <=> s")).drop("s")
    b = b.withColumn("end", F.sum("words").over(run)).withColumn("start", F.col("end") - F.col("words"))
    edge = b.where("start < extra_words and extra_words <= end").select(F.col("source").alias("s"), F.col("bucket").alias("edge"), "start", "extra_words")
    edge = edge.groupBy("s").agg(F.min_by(F.struct("edge", "start", "extra_words"), "edge").alias("e"))
    met = join_small(fills.drop("extra_words"), edge, F.expr("source <=> s"), "left")
    return written(met.select(F.col("source").alias("s"), "source_size", "target", "whole", F.col("e.edge").alias("edge"), F.col("e.start").alias("start"), F.col("e.extra_words").alias("extra_words")), "info")


def _whole_and_extra(rows: DataFrame) -> DataFrame:
    """copies of rows outside their source's edge bucket."""
    extra = F.when(F.col("edge").isNull(), F.lit(0)).otherwise((F.col("bucket") < F.col("edge")).cast("int"))
    return rows.where("edge is null or bucket <> edge").withColumn("copies", (F.col("whole") + extra).cast("long"))


def _at_the_edge(rows: DataFrame) -> DataFrame:
    """copies of the edge buckets' rows: the part of a document that lies below the mark decides, by half."""
    rank = Window.partitionBy("source").orderBy("u", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    close = rows.where("bucket = edge").withColumn("till", F.sum("size").over(rank))
    extra = (F.col("start") + F.col("till") - F.col("size") / 2 <= F.col("extra_words")).cast("int")
    return close.withColumn("copies", (F.col("whole") + extra).cast("long")).drop("till")


def mix_sizes(sized: DataFrame, seed: int = 17, buckets: int = 4096, **fill) -> DataFrame:
    """sized (id, source, size) with source_size, target, copies and taken = copies * size.

    A source's rate is target / size: every document is repeated floor(rate) times, and the documents that a seeded
    order puts within the fractional part of the source's words are repeated once more. So a source's words miss its
    target by at most about one document, and reruns agree. The order is cut into hash buckets: their sums find the
    bucket in which the fraction ends, and only that bucket's rows, one in `buckets` of a source, are ranked.
    Rows equal in id share an order place; empty texts have size 0 and follow the order as the others do.
    """
    sized = written(_placed(sized.select("id", "source", "size"), seed, buckets), "sizes")
    rows = join_small(sized, _plan(sized, **fill), F.expr("source <=> s")).drop("s")
    both = _whole_and_extra(rows).unionByName(_at_the_edge(rows))
    return both.select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text, source) with doc_id, source, size, source_size, target, copies, taken.

    size: words of the text, null 0. Null sources are a source of their own. An empty table gives no rows. Extra
    columns aren't read.
    """
    sized = docs.select(F.col("doc_id").alias("id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    return mix_sizes(sized, **options).withColumnRenamed("id", "doc_id")


def repeated(docs: DataFrame, seed: int = 17, buckets: int = 4096, **fill) -> DataFrame:
    """The rows of docs as often as the mix takes them, with the columns of docs. Rows equal in doc_id, source and size are taken
    alike. Only the rows of the edge buckets meet their copies in a join; the others' follow from their source's line of the plan."""
    key = {"id": F.col("doc_id"), "source": F.col("source").cast("string"), "size": word_count(F.col("text").cast("string"))}
    sized = written(_placed(docs.select(*[c.alias(n) for n, c in key.items()]), seed, buckets), "sizes")
    plan = _plan(sized, **fill)
    tagged = docs.select(F.struct(*docs.columns).alias("row"), *[c.alias(n) for n, c in key.items()])
    rows = join_small(_placed(tagged, seed, buckets), plan, F.expr("source <=> s")).drop("s")
    edge = _at_the_edge(join_small(sized, plan, F.expr("source <=> s")).drop("s"))
    edge = edge.groupBy("id", "source", "size").agg(F.max("copies").alias("copies")).select(*[F.col(c).alias(f"e_{c}") for c in ("id", "source", "size")], "copies")
    close = rows.where("bucket = edge").join(edge, F.expr("id <=> e_id and source <=> e_source and size <=> e_size")).select("row", "copies")
    both = _whole_and_extra(rows).select("row", "copies").unionByName(close).where("copies > 0")
    return both.select("row", F.explode(F.expr("sequence(1, cast(copies as int))")).alias("_copy")).select("row.*")


def op1(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


