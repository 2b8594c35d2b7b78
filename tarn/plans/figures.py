"""The tables behind the experiment's figures; drawing them is out of scope."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import compaction, sampling, stats
from .catalog import query
from .experiment import _DRIFTS, _HOLM, _TEST, _W, ABLATION, BASE, CONTINUOUS, STEPS, _paired_rows, _paired_sql, drifts, with_aliases
from .oracles import exact_p_sql

_COLUMNS = [right for _, right in ABLATION]


@query(BASE + _paired_sql(CONTINUOUS) + _W + exact_p_sql("tests") + f""", {_HOLM}, s AS (SELECT *, max(raw) OVER (ORDER BY p, {_TEST} ROWS UNBOUNDED PRECEDING) AS p_holm FROM h),
de AS (SELECT {_TEST}, avg(r - l) AS delta FROM paired GROUP BY ALL), cells AS (SELECT * FROM s JOIN de USING ({_TEST}) WHERE family = 'ablation_vs_A0' AND metric = 'entity_partial_f1')
SELECT dataset, model_id, {", ".join(f"round(max(delta) FILTER (right_level = '{c}'), 6) AS {c}_delta, max((p_holm < 0.05)::int) FILTER (right_level = '{c}') AS {c}_star" for c in _COLUMNS)} FROM cells GROUP BY 1, 2""")
def ablation_heat_map(spark, d):
    """What each condition of the ablation changes in partial F1 against A0: a row of the matrix for each dataset and model, with a star where the whole family of tests leaves it significant."""
    tests = stats.paired_continuous(_paired_rows(spark, d, CONTINUOUS), ["model_id", "dataset"], ["record_id"], "condition", [*STEPS, *ABLATION], CONTINUOUS)
    own = tests.where("left_level = 'A0' and metric = 'entity_partial_f1'").withColumn("star", F.coalesce((F.col("p_holm") < 0.05).cast("int"), F.lit(0)))
    wide = own.groupBy("dataset", "model_id").pivot("right_level", _COLUMNS).agg(F.max(F.round("mean_delta", 6)).alias("delta"), F.max("star").alias("star"))
    return wide.select("dataset", "model_id", *[f"{c}_{x}" for c in _COLUMNS for x in ("delta", "star")])


@query(BASE + """, a AS (SELECT model_id, condition, count(*) AS documents, avg(seconds) AS seconds, avg(schema_valid) AS valid, avg(entity_partial_f1) AS f1 FROM metrics WHERE phase = 'main' GROUP BY 1, 2),
f AS (SELECT x.model_id, x.condition FROM a x WHERE NOT EXISTS (SELECT 1 FROM a y WHERE y.seconds <= x.seconds AND y.valid >= x.valid AND (y.seconds < x.seconds OR y.valid > x.valid)))
SELECT model_id, condition, documents, round(seconds, 6) AS seconds, round(valid, 6) AS schema_valid, round(f1, 6) AS partial_f1, round(170 + 450 * greatest(0, least(1, valid)), 4) AS marker, (f.model_id IS NOT NULL)::int AS on_frontier FROM a LEFT JOIN f USING (model_id, condition)""")
def speed_against_validity(spark, d):
    """Mean seconds and share of valid answers of each model and main condition, the size of its marker, and whether it lies on the frontier. For that means
    are made once, as sums in another order end in other bits, and taken to nine digits, so that equal ones are equal."""
    rows = with_aliases(spark, d).where("phase = 'main'").groupBy("model_id", "condition").agg(F.count("*").alias("documents"), F.avg("seconds").alias("seconds"), F.avg("schema_valid").alias("schema_valid"), F.avg("entity_partial_f1").alias("partial_f1"))
    rows = compaction.settled(rows).withColumn("s9", F.round("seconds", 9))
    frontier = sampling.pareto(rows, "s9", "schema_valid").select(F.col("s9").alias("fs"), F.col("schema_valid").alias("fv"))
    met = rows.join(F.broadcast(frontier), (F.col("s9") == F.col("fs")) & (F.col("schema_valid") == F.col("fv")), "left")
    marker = F.round(170 + 450 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("schema_valid"))), 4)
    return met.select("model_id", "condition", "documents", *[F.round(c, 6).alias(c) for c in ("seconds", "schema_valid", "partial_f1")], marker.alias("marker"), F.col("fs").isNotNull().cast("int").alias("on_frontier"))


@query(BASE + _DRIFTS + """, f AS (SELECT dataset, field, transition, avg(drift) AS mean FROM dr GROUP BY 1, 2, 3), o AS (SELECT dataset, field, avg(mean) AS overall FROM f GROUP BY 1, 2)
SELECT f.dataset, f.field, transition, round(mean, 6) AS mean, round(overall, 6) AS overall, place FROM f JOIN (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY round(overall, 9) DESC, field)::int AS place FROM o) USING (dataset, field)""")
def volatility_order(spark, d):
    """The mean drift of each dataset's fields by transition, with the fields' places from the most to the least volatile."""
    means = drifts(spark, d).groupBy("dataset", "field", "transition").agg(F.avg("drift").alias("mean"))
    overall = means.groupBy("dataset", "field").agg(F.avg("mean").alias("overall"))
    placed = overall.withColumn("place", F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc(F.round("overall", 9)), "field")))
    return means.join(placed, ["dataset", "field"]).select("dataset", "field", "transition", F.round("mean", 6).alias("mean"), F.round("overall", 6).alias("overall"), "place")
