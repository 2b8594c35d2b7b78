"""Vector centroids and the drift between them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import bootstrap_mean


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def unit(v: Column) -> Column:
    """The vector at length 1; null for a zero vector."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x / n))


def centroids(rows: DataFrame, keys: Sequence[str], vector: str = "embedding", dims: int | None = None) -> DataFrame:
    """The unit mean of unit vectors by keys; null where it has no direction. A mean for each of dims dimensions (else as many as the longest
    vector has), summed before the shuffle, so that what is shuffled is a row of sums for each key and task."""
    dims = dims or rows.agg(F.max(F.size(vector))).first()[0] or 1
    units = rows.select(*keys, unit(F.col(vector)).alias("_u"))
    means = units.groupBy(*keys).agg(*[F.avg(F.get("_u", i)).alias(f"_m{i}") for i in range(dims)])
    return means.select(*keys, F.filter(F.array(*[f"_m{i}" for i in range(dims)]), lambda x: x.isNotNull()).alias("_m")).select(*keys, unit(F.col("_m")).alias("centroid"))


_ENCODERS: dict[str, Callable] = {}  # of this worker


def embedded(texts: DataFrame, load: Callable[[], Callable[[list[str]], Sequence]], column: str = "text", batch: int = 512) -> DataFrame:
    """(text, embedding): a unit vector for each distinct text other than null, null for a vector without direction. load gives the encoder, a function of a
    list of texts to as many vectors, and is called once in a worker. The encoder sees at most `batch` texts at once, in order of their
    length, so that texts of like length go together. Join the result back by text."""
    name = uuid.uuid4().hex

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if name not in _ENCODERS:
            _ENCODERS[name] = load()
        for part in parts:
            out = []
            for at in range(0, len(part), batch):
                v = np.asarray(_ENCODERS[name](part.iloc[at : at + batch].tolist()), float)
                n = np.sqrt((v * v).sum(axis=1))
                out += [x / d if d > 0 else None for x, d in zip(v, n)]
            yield pd.Series(out, dtype=object)

    distinct = texts.where(F.col(column).isNotNull()).select(F.col(column).alias("text")).distinct()
    return distinct.sortWithinPartitions(F.length("text"), "text").select("text", run("text").alias("embedding"))


def drift(left: Column, right: Column) -> Column:
    """1 - cosine in 0 to 2; nothing to nothing is 0, nothing to something 1."""
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(left, right)))
    return F.when(left.isNull() & right.isNull(), 0.0).when(left.isNull() | right.isNull(), 1.0).otherwise(1 - cos)


def adjacent(rows: DataFrame, keys: Sequence[str], level: str, value: str) -> DataFrame:
    """Pairs of a level and the next one, where both exist: an equi-join, so no group meets in one task."""
    right = rows.select(*keys, (F.col(level) - 1).alias(level), F.col(value).alias("right"))
    return rows.select(*keys, level, F.col(value).alias("left")).join(right, [*keys, level])


def text_centroids(fields: DataFrame, vectors: DataFrame, keys: Sequence[str], dims: int | None = None) -> DataFrame:
    """fields (keys, field, texts) with the unit mean of their texts' vectors (text, embedding), and n; no texts, or none with a
    vector, give a null centroid. Texts meet their vectors in an equi-join; repeated texts of a row count as often as they occur."""
    dims = dims or vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    each = fields.select(*keys, "field", F.size("texts").alias("n"), F.explode_outer("texts").alias("text"))
    met = each.join(vectors.select("text", unit(F.col("embedding")).alias("_u")), "text", "left")
    means = met.groupBy(*keys, "field").agg(F.max("n").alias("n"), *[F.avg(F.get("_u", i)).alias(f"_m{i}") for i in range(dims)])
    listed = means.select(*keys, "field", "n", F.filter(F.array(*[f"_m{i}" for i in range(dims)]), lambda x: x.isNotNull()).alias("_m"))
    return listed.select(*keys, "field", "n", unit(F.col("_m")).alias("centroid"))


def field_drift(left_n: Column, right_n: Column, left: Column, right: Column) -> Column:
    """Nothing to nothing is 0, nothing to something 1 and back; else the drift of the centroids, 1 where one has no direction."""
    return F.when((left_n == 0) & (right_n == 0), 0.0).when((left_n == 0) | (right_n == 0), 1.0).when(left.isNull() | right.isNull(), 1.0).otherwise(drift(left, right))


def level_pairs(rows: DataFrame, keys: Sequence[str], level: str, pairs: Sequence[tuple[str, str]], values: Sequence[str]) -> DataFrame:
    """(keys, transition, left_*, right_*) of rows whose levels are a pair, both present: an equi-join on keys and transition."""
    def side(at: int, name: str) -> DataFrame:
        known = F.create_map(*[F.lit(x) for p in pairs for x in (p[at], f"{p[0]}->{p[1]}")])
        named = rows.withColumn("transition", F.try_element_at(known, F.col(level))).where("transition is not null")
        return named.select(*keys, "transition", *[F.col(v).alias(f"{name}_{v}") for v in values])

    return side(0, "left").join(side(1, "right"), [*keys, "transition"])


def instability(drifts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """psi: the plain mean of the fields' drifts by (keys, transition), and how many fields."""
    return drifts.groupBy(*keys, "transition").agg(F.avg("drift").alias("psi"), F.count("*").alias("fields"))


def deltas(pairs: DataFrame, metrics: Sequence[str], valid: str = "schema_valid") -> DataFrame:
    """level_pairs with delta_* and abs_delta_* of metrics, null where a side is, and schema_break: valid before and not after."""
    made = {}
    for m in metrics:
        d = F.col(f"right_{m}") - F.col(f"left_{m}")
        made |= {f"delta_{m}": d, f"abs_delta_{m}": F.abs(d)}
    return pairs.withColumns(made).withColumn("schema_break", ((F.col(f"left_{valid}") == 1) & (F.col(f"right_{valid}") == 0)).cast("int"))


def dropout(rows: DataFrame, keys: Sequence[str], unit: Sequence[str], level: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """How often a field that was there is gone a level on, by (keys, transition, field, variant). rows: keys, unit, level, presence (a map of
    field to 0 or 1), schema_valid. Of a pair of levels every field counts, and __ANY_FIELD__ if any is gone; the variant
    valid_only takes pairs whose sides are both valid. paired, events and the values' key columns are kept for resampling."""
    met = level_pairs(rows, [*keys, *unit], level, pairs, ["presence", "schema_valid"])
    gone = F.transform(F.map_keys("left_presence"), lambda f: F.struct(f.alias("field"), ((F.col("left_presence")[f] == 1) & (F.coalesce(F.try_element_at("right_presence", f), F.lit(0)) == 0)).cast("int").alias("gone")))
    whole = F.struct(F.lit("__ANY_FIELD__").alias("field"), F.coalesce(F.array_max(F.transform("gone", lambda g: g["gone"])), F.lit(0)).alias("gone"))
    both = (F.col("left_schema_valid") == 1) & (F.col("right_schema_valid") == 1)
    variants = F.when(both, F.array(F.lit("inclusive"), F.lit("valid_only"))).otherwise(F.array(F.lit("inclusive")))
    each = met.withColumn("gone", gone).select(*keys, *unit, "transition", F.explode(F.array_append("gone", whole)).alias("g"), variants.alias("variants"))
    return each.select(*keys, *unit, "transition", "g.field", "g.gone", F.explode("variants").alias("variant"))


def dropout_rates(rows: DataFrame, keys: Sequence[str], unit: Sequence[str], level: str, pairs: Sequence[tuple[str, str]], draws: int = 5000) -> DataFrame:
    """(keys, transition, field, variant) with paired, events, idr, idr_ci_low and idr_ci_high."""
    by = [*keys, "transition", "field", "variant"]
    events = dropout(rows, keys, unit, level, pairs)
    counts = events.groupBy(*by).agg(F.count("*").alias("paired"), F.sum("gone").alias("events"))
    ci = bootstrap_mean(events.withColumn("gone", F.col("gone").cast("double")), by, "gone", draws)
    return counts.join(ci.select(*by, F.col("mean").alias("idr"), F.col("ci_low").alias("idr_ci_low"), F.col("ci_high").alias("idr_ci_high")), by)


def coverage(pairs: DataFrame, fields: DataFrame, expected_pairs: int, expected_fields: int) -> DataFrame:
    """One row: how many pairs and field pairs there are and should be, and whether that is all."""
    n = pairs.agg(F.count("*").alias("pairs")).join(fields.agg(F.count("*").alias("field_pairs")))
    return n.withColumns({"expected_pairs": F.lit(expected_pairs).cast("long"), "expected_field_pairs": F.lit(expected_fields).cast("long")}).withColumn("complete", F.expr("pairs = expected_pairs and field_pairs = expected_field_pairs"))


def column_of(df: DataFrame, names: Sequence[str]) -> str | None:
    """The first of several names of a column that a table has."""
    return next((n for n in names if n in df.columns), None)
