"""The evaluation tables of an extraction experiment: scoring, aggregates, paired tests, dropout, drift and its correlations.

The driver's tables stand in for the experiment's files: events are an append-only log of predictions (the last one of a job counts) of
users' records under conditions P1 to P6; what was predicted and what is right comes from names of parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nested
from ..operators import compaction, drift, scoring, stats
from .catalog import query, r6, t
from .oracles import bootstrap_sql, exact_p_sql

MAIN = [f"P{i}" for i in range(1, 7)]
NEW = [f"A{i}" for i in range(2, 7)]  # conditions of the ablation that aren't another's alias
SLOTS = [*MAIN, *NEW, "X"]  # an event is a prediction under one of these; X is no known job
STEPS = list(zip(MAIN, MAIN[1:]))
ALIASES = {"P3": "A0", "P4": "A1"}
ABLATION = [("A0", f"A{i}") for i in range(1, 7)]
FIELDS = ["Adj", "Noun"]
CONTINUOUS = ["entity_exact_f1", "entity_partial_f1", "relation_exact_f1", "hallucinated_entity_rate", "prompt_tokens", "output_tokens", "seconds"]
BINARY = ["json_valid", "schema_valid", "truncated_at_limit"]

_SLOT = f"user_id || '-' || {SLOTS}[1 + event_id // 5 % 12]"
#: jobs, the latest predictions of known jobs, gold records, and the scores, as SQL.
BASE = f"""WITH RECURSIVE users AS (SELECT DISTINCT user_id AS record_id FROM events), np AS (SELECT count(*) AS np FROM part),
jobs AS (SELECT record_id || '-' || c AS job_id, 'm' || (record_id % 3) AS model_id, 'd' || (record_id // 3 % 3) AS dataset, record_id, CASE WHEN c LIKE 'P%' THEN 'main' ELSE 'ablation' END AS phase, c AS condition
 FROM users, (SELECT unnest({[*MAIN, *NEW]}) AS c) WHERE c LIKE 'P%' OR record_id % 4 = 0),
latest AS (SELECT *, {_SLOT} AS job_id FROM events QUALIFY row_number() OVER (PARTITION BY {_SLOT} ORDER BY ts DESC, event_id DESC) = 1),
words AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, p_name FROM part),
preds AS (SELECT job_id, model_id, dataset, record_id, phase, condition, event_type <> 'error' AS json_valid, event_type <> 'error' AND event_id % 5 <> 0 AS schema_valid, event_id % 1000 AS prompt_tokens,
 event_id % 300 AS output_tokens, event_id % 300 >= 250 AS truncated, value AS seconds, event_id, w1, w2, p_name, event_type <> 'error' AND event_id % 4 <> 0 AS has_noun, event_type IN ('click', 'view') AS has_rel
 FROM latest JOIN jobs USING (job_id) JOIN words ON p_partkey = event_id % (SELECT np FROM np)),
gold AS (SELECT record_id, w1 AS g1, w2 AS g2, p_name AS g3 FROM users JOIN words ON p_partkey = record_id % (SELECT np FROM np)),
pe AS (SELECT job_id, unnest([{{'i': 0, 'x': w1, 't': 'adj'}}] || CASE WHEN has_noun THEN [{{'i': 1, 'x': w2, 't': 'noun'}}, {{'i': 2, 'x': p_name, 't': 'noun'}}] ELSE [] END) AS e FROM preds WHERE json_valid),
ge AS (SELECT job_id, unnest([{{'i': 0, 'x': g1, 't': 'adj'}}, {{'i': 1, 'x': g2, 't': 'noun'}}, {{'i': 2, 'x': g3, 't': 'noun'}}]) AS e FROM preds JOIN gold USING (record_id)),
ec AS (SELECT job_id, e.x, e.t, count(*) FILTER (s = 'p') AS p, count(*) FILTER (s = 'g') AS g FROM (SELECT job_id, e, 'p' AS s FROM pe UNION ALL SELECT job_id, e, 'g' FROM ge) GROUP BY 1, 2, 3),
ex AS (SELECT job_id, sum(least(p, g)) AS tp, sum(p) AS p, sum(g) AS g FROM ec GROUP BY 1),
cand AS (SELECT pe.job_id, pe.e.i AS pi, ge.e.i AS gi, len(list_intersect(string_split(pe.e.x, ' '), string_split(ge.e.x, ' '))) / len(list_distinct(string_split(pe.e.x, ' ') || string_split(ge.e.x, ' '))) AS score
 FROM pe JOIN ge ON pe.job_id = ge.job_id AND pe.e.t = ge.e.t),
ordered AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, pi DESC, gi DESC) AS k FROM cand WHERE score >= 0.5),
walk AS (SELECT job_id, 0::bigint AS k, []::int[] AS up, []::int[] AS ug, 0 AS tp FROM (SELECT DISTINCT job_id FROM ordered) UNION ALL
 SELECT o.job_id, o.k, CASE WHEN list_contains(up, pi) OR list_contains(ug, gi) THEN up ELSE list_append(up, pi) END, CASE WHEN list_contains(up, pi) OR list_contains(ug, gi) THEN ug ELSE list_append(ug, gi) END,
 tp + CASE WHEN list_contains(up, pi) OR list_contains(ug, gi) THEN 0 ELSE 1 END FROM walk w JOIN ordered o ON o.job_id = w.job_id AND o.k = w.k + 1),
pm AS (SELECT job_id, max(tp) AS ptp FROM walk GROUP BY 1),
m AS (SELECT p.job_id, model_id, dataset, record_id, phase, condition, json_valid::int AS json_valid, schema_valid::int AS schema_valid, truncated::int AS truncated_at_limit, prompt_tokens, output_tokens, seconds,
 CASE WHEN NOT json_valid THEN 0 WHEN has_noun THEN 3 ELSE 1 END AS n_pred, 2 * tp / (p + g) AS entity_exact_f1, 2 * coalesce(ptp, 0) / (p + g) AS entity_partial_f1,
 CASE WHEN json_valid AND has_rel THEN (w1 = g1 AND w2 = g2)::int::double ELSE 0.0 END AS relation_exact_f1,
 CASE WHEN json_valid THEN (NOT contains(g3, w1))::int + CASE WHEN has_noun THEN (NOT contains(g3, w2))::int + (NOT contains(g3, p_name))::int ELSE 0 END ELSE 0 END AS unsupported
 FROM preds p JOIN gold USING (record_id) JOIN ex USING (job_id) LEFT JOIN pm USING (job_id)),
metrics AS (SELECT *, coalesce(unsupported / nullif(n_pred, 0), 0) AS hallucinated_entity_rate FROM m),
aliased AS (SELECT * FROM metrics UNION ALL SELECT metrics.* REPLACE ('alias::' || job_id || '::' || a AS job_id, 'ablation_alias' AS phase, a AS condition)
 FROM metrics JOIN (VALUES ('P3', 'A0'), ('P4', 'A1')) v(c, a) ON c = condition WHERE record_id % 4 = 0)"""


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """Every user's record under the main conditions, and a quarter of them under those of the ablation."""
    u = t(spark, d, "events").select(F.col("user_id").alias("record_id")).distinct()
    each = u.select("record_id", F.explode(F.array(*map(F.lit, [*MAIN, *NEW]))).alias("condition")).where("condition like 'P%' or record_id % 4 = 0")
    phase = F.when(F.col("condition").startswith("P"), "main").otherwise("ablation")
    return each.select(F.concat_ws("-", "record_id", "condition").alias("job_id"), F.concat(F.lit("m"), F.col("record_id") % 3).alias("model_id"), F.concat(F.lit("d"), F.expr("record_id div 3 % 3")).alias("dataset"), "record_id", phase.alias("phase"), "condition")


def _words(spark, d):
    w = F.split("p_name", " ")
    return t(spark, d, "part").select("p_partkey", w[0].alias("w1"), w[1].alias("w2"), "p_name")


def _part(spark, d, key: str) -> F.Column:
    """A part for each key, of all parts."""
    return F.col(key) % t(spark, d, "part").count()


def _prediction_rows(spark, d) -> DataFrame:
    slot = F.element_at(F.array(*map(F.lit, SLOTS)), (F.expr("event_id div 5 % 12") + 1).cast("int"))
    log = t(spark, d, "events").withColumn("job_id", F.concat_ws("-", "user_id", slot))
    last = compaction.latest(log, "job_id", ["ts", "event_id"])
    return last.withColumn("p_partkey", _part(spark, d, "event_id")).join(_words(spark, d), "p_partkey")


_VALID = "event_type <> 'error'"
_NOUN = f"{_VALID} AND event_id % 4 <> 0"


def _entity(text: str, kind: str):
    return F.struct(F.col(text).alias("text"), F.lit(kind).alias("type"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """The log's last prediction of each job, with its output as JSON text."""
    both = F.when(F.expr(_NOUN), F.array(_entity("w1", "Adj"), _entity("w2", "Noun"), _entity("p_name", "noun"))).otherwise(F.array(_entity("w1", "Adj")))
    rel = F.array(F.struct(F.col("w1").alias("head"), F.lit("Of").alias("type"), F.col("w2").alias("tail")))
    out = F.to_json(F.struct(both.alias("entities"), F.when(F.expr("event_type in ('click', 'view')"), rel).otherwise(F.filter(rel, lambda _: F.lit(False))).alias("relations")))
    valid = F.expr(_VALID)
    measured = [(F.col("event_id") % 1000).alias("prompt_tokens"), (F.col("event_id") % 300).alias("output_tokens"), F.expr("event_id % 300 >= 250").cast("int").alias("truncated_at_limit"), F.col("value").alias("seconds")]
    return _prediction_rows(spark, d).select("job_id", F.when(valid, out).alias("parsed_output"), valid.cast("int").alias("json_valid"), F.expr(f"{_VALID} AND event_id % 5 <> 0").cast("int").alias("schema_valid"), *measured)


def gold(spark: SparkSession, d: str) -> DataFrame:
    u = t(spark, d, "events").select(F.col("user_id").alias("record_id")).distinct().withColumn("p_partkey", _part(spark, d, "record_id")).join(_words(spark, d), "p_partkey")
    out = F.struct(F.array(_entity("w1", "adj"), _entity("w2", "NOUN"), _entity("p_name", "Noun")).alias("entities"), F.array(F.struct(F.struct(F.col("w1").alias("text")).alias("head"), F.lit("of").alias("type"), F.struct(F.col("w2").alias("text")).alias("tail"))).alias("relations"))
    return u.select("record_id", F.col("p_name").alias("input_text"), F.to_json(out).alias("gold_output"))


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return scoring.job_metrics(predictions(spark, d), jobs(spark, d), gold(spark, d), ["record_id"])


def with_aliases(spark: SparkSession, d: str) -> DataFrame:
    dim = spark.createDataFrame(list(ALIASES.items()), "condition string, alias string")
    sample = t(spark, d, "events").where("user_id % 4 = 0").select(F.col("user_id").alias("record_id")).distinct()
    out = compaction.with_aliases(metrics(spark, d), dim, sample, ["record_id"])
    return out.withColumn("phase", F.when(F.col("is_alias"), "ablation_alias").otherwise(F.col("phase")))


@query(BASE + """ SELECT job_id, model_id, dataset, phase, condition, json_valid, schema_valid, n_pred::bigint AS predicted, unsupported::bigint AS unsupported, round(hallucinated_entity_rate, 6) AS hallucinated,
round(entity_exact_f1, 6) AS entity_exact_f1, round(entity_partial_f1, 6) AS entity_partial_f1, round(relation_exact_f1, 6) AS relation_exact_f1 FROM aliased""")
def scoring_table(spark, d):
    q = with_aliases(spark, d)
    names = {"predicted_entities": "predicted", "unsupported_entities": "unsupported", "hallucinated_entity_rate": "hallucinated"}
    return q.withColumnsRenamed(names).select("job_id", "model_id", "dataset", "phase", "condition", "json_valid", "schema_valid", "predicted", "unsupported", *[r6(F.col(c)).alias(c) for c in ("hallucinated", "entity_exact_f1", "entity_partial_f1", "relation_exact_f1")])


def _metric_structs(names, side: str = "") -> str:
    return ", ".join(f"{{'metric': '{c}', 'value': {side}{c}::double}}" for c in names)


_GROUPINGS = [["model_id", "dataset", "phase", "condition"], ["model_id", "phase", "condition"]]
_LONG = f""", tall AS (SELECT model_id, dataset, phase, condition, unnest([{_metric_structs([*CONTINUOUS, *BINARY])}], recursive := true) FROM aliased),
grouped AS (SELECT 'model_id+dataset+phase+condition' AS grouping, * FROM tall UNION ALL SELECT 'model_id+phase+condition', tall.* REPLACE (NULL AS dataset) FROM tall)"""
_BY = ["grouping", "model_id", "dataset", "phase", "condition", "metric"]


@query(BASE + _LONG + bootstrap_sql(_BY, "grouped", "value", 2000, "model_id || '|' || coalesce(dataset || '|', '') || phase || '|' || condition || '|' || metric") + """ SELECT s.grouping, s.model_id, s.dataset, s.phase, s.condition, s.metric, s.n, round(s.mean, 9) AS mean, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high
FROM s JOIN ci ON s.grouping = ci.grouping AND s.model_id = ci.model_id AND s.dataset IS NOT DISTINCT FROM ci.dataset AND s.phase = ci.phase AND s.condition = ci.condition AND s.metric = ci.metric""")
def global_metrics_with_intervals(spark, d):
    """All ten metrics, with the dataset and without. Nine digits: interpolated means of few integers end in a five at the seventh."""
    q = stats.summaries(with_aliases(spark, d), _GROUPINGS, [*CONTINUOUS, *BINARY])
    return q.select(*_BY, "n", *[F.round(c, 9).alias(c) for c in ("mean", "ci_low", "ci_high")])


@query(BASE + """ SELECT model_id, dataset, phase, condition, count(*) AS documents, round(avg(entity_exact_f1), 6) AS f1_mean, round(median(entity_exact_f1), 6) AS f1_median, round(coalesce(stddev_samp(entity_exact_f1), 0), 6) AS f1_std,
round(quantile_cont(prompt_tokens::double, 0.95), 6) AS prompt_p95, round(avg(seconds), 6) AS seconds_mean FROM aliased GROUP BY GROUPING SETS ((model_id, dataset, phase, condition), (model_id, phase, condition))""")
def condition_summary(spark, d):
    q = with_aliases(spark, d).groupingSets(_GROUPINGS, *_GROUPINGS[0])
    f = "entity_exact_f1"
    return q.agg(F.count("*").alias("documents"), r6(F.avg(f)).alias("f1_mean"), r6(F.median(f)).alias("f1_median"), r6(F.coalesce(F.stddev_samp(f), F.lit(0.0))).alias("f1_std"), r6(F.percentile("prompt_tokens", F.lit(0.95))).alias("prompt_p95"), r6(F.avg("seconds")).alias("seconds_mean"))


def _sql_pairs(pairs) -> str:
    return "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in pairs) + ") pairs(left_level, right_level)"


def _paired_sql(names) -> str:
    sides = ", ".join(f"{{'metric': '{c}', 'l': round(a.{c}::double, 9), 'r': round(b.{c}::double, 9)}}" for c in names)
    return f""", paired AS (SELECT * FROM (SELECT CASE WHEN left_level = 'A0' THEN 'ablation_vs_A0' ELSE 'main_adjacent' END AS family, a.model_id, a.dataset, left_level, right_level, unnest([{sides}], recursive := true)
 FROM {_sql_pairs([*STEPS, *ABLATION])} JOIN aliased a ON a.condition = left_level JOIN aliased b ON b.condition = right_level AND b.record_id = a.record_id) WHERE l IS NOT NULL AND r IS NOT NULL)"""


_TEST = "family, model_id, dataset, left_level, right_level, metric"
_W = f""", diff AS (SELECT *, r - l AS d FROM paired), ranked AS (SELECT *, CASE WHEN d <> 0 THEN rank() OVER (PARTITION BY {_TEST}, d <> 0 ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {_TEST}, abs(d)) - 1) / 2 END AS rk,
 count(*) OVER (PARTITION BY {_TEST}, abs(d)) AS c FROM diff),
sums AS (SELECT {_TEST}, count(*) AS pairs, count(*) FILTER (d <> 0) AS n, coalesce(sum(rk) FILTER (d > 0), 0) AS up, coalesce(sum(rk) FILTER (d < 0), 0) AS down, coalesce(sum(c * c - 1) FILTER (d <> 0), 0) AS ties FROM ranked GROUP BY ALL),
tests AS (SELECT *, least(up, down) AS w, abs(least(up, down) - n * (n + 1) / 4) / sqrt(nullif(n * (n + 1) * (2 * n + 1) / 24 - ties / 48, 0)) AS z FROM sums)"""
_HOLM = f"""h AS (SELECT *, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, {_TEST}) + 1)) AS raw FROM p)"""


def _paired_rows(spark, d, names) -> DataFrame:
    """Scores to nine digits, so that equal differences are equal in every engine."""
    return compaction.settled(with_aliases(spark, d).select("model_id", "dataset", "record_id", "condition", *[F.round(F.col(c).cast("double"), 9).alias(c) for c in names]))


def _family(q: DataFrame) -> F.Column:
    return F.when(F.col("left_level") == "A0", "ablation_vs_A0").otherwise("main_adjacent").alias("family")


@query(BASE + _paired_sql(CONTINUOUS) + _W + exact_p_sql("tests") + f""", {_HOLM}
SELECT {_TEST}, pairs, n, round(w, 4)::double AS w, round(p, 5)::double AS p, round(max(raw) OVER (ORDER BY p, {_TEST} ROWS UNBOUNDED PRECEDING), 5)::double AS p_holm FROM h""")
def paired_wilcoxon_tests(spark, d):
    """The steps of the main conditions and the ablation's conditions against A0: eleven pairs, seven metrics, by model and dataset, as one family."""
    q = stats.paired_continuous(_paired_rows(spark, d, CONTINUOUS), ["model_id", "dataset"], ["record_id"], "condition", [*STEPS, *ABLATION], CONTINUOUS)
    return q.select(_family(q), "model_id", "dataset", "left_level", "right_level", "metric", "pairs", "n", F.round("w", 4).alias("w"), F.round("p", 5).alias("p"), F.round("p_holm", 5).alias("p_holm"))


@query(BASE + _paired_sql(BINARY) + f""", binom(n, i, c) AS (SELECT 0::bigint, 0::bigint, 1::double UNION ALL SELECT n, i, sum(c) FROM (SELECT n + 1 AS n, unnest([i, i + 1]) AS i, c FROM binom WHERE n < 200) GROUP BY 1, 2),
c AS (SELECT {_TEST}, count(*) AS pairs, count(*) FILTER (l = 1 AND r = 0) AS b, count(*) FILTER (l = 0 AND r = 1) AS c FROM paired GROUP BY ALL),
p AS (SELECT *, CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(binom.c) FROM binom WHERE binom.n = t.b + t.c AND i <= least(t.b, t.c)) * pow(2, -(b + c))) END AS p FROM c t), {_HOLM}
SELECT {_TEST}, pairs, b, c, round(p, 5)::double AS p, round(max(raw) OVER (ORDER BY p, {_TEST} ROWS UNBOUNDED PRECEDING), 5)::double AS p_holm FROM h""")
def paired_mcnemar_tests(spark, d):
    q = stats.paired_binary(_paired_rows(spark, d, BINARY), ["model_id", "dataset"], ["record_id"], "condition", [*STEPS, *ABLATION], BINARY)
    return q.select(_family(q), "model_id", "dataset", "left_level", "right_level", "metric", "pairs", "b", "c", F.round("p", 5).alias("p"), F.round("p_holm", 5).alias("p_holm"))


_EVENTS = f""", pr AS (SELECT record_id, model_id, dataset, condition, schema_valid, json_valid::int AS adj, (json_valid AND has_noun)::int AS noun FROM preds),
 ev AS (SELECT a.model_id, a.dataset, left_level || '->' || right_level AS transition, x.field, x.gone, unnest(CASE WHEN a.schema_valid AND b.schema_valid THEN ['inclusive', 'valid_only'] ELSE ['inclusive'] END) AS variant
 FROM {_sql_pairs(STEPS)} JOIN pr a ON a.condition = left_level JOIN pr b ON b.condition = right_level AND b.record_id = a.record_id,
 LATERAL (SELECT unnest([{{'field': 'Adj', 'gone': (a.adj = 1 AND b.adj = 0)::int}}, {{'field': 'Noun', 'gone': (a.noun = 1 AND b.noun = 0)::int}}, {{'field': '__ANY_FIELD__', 'gone': (a.adj = 1 AND b.adj = 0 OR a.noun = 1 AND b.noun = 0)::int}}]) AS x))"""


@query(BASE + _EVENTS + bootstrap_sql(["model_id", "dataset", "transition", "field", "variant"], "ev", "gone", 5000) + """, n AS (SELECT model_id, dataset, transition, field, variant, count(*) AS paired, sum(gone)::bigint AS events FROM ev GROUP BY ALL)
SELECT model_id, dataset, transition, field, variant, paired, events, round(mean, 6) AS idr, round(ci_low, 6) AS idr_ci_low, round(ci_high, 6) AS idr_ci_high FROM n JOIN s USING (model_id, dataset, transition, field, variant) JOIN ci USING (model_id, dataset, transition, field, variant)""")
def instruction_dropout(spark, d):
    p = predictions(spark, d).join(jobs(spark, d), "job_id")
    ents = F.from_json("parsed_output", "entities array<struct<text: string, type: string>>")["entities"]
    seen = F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.coalesce(nested.present(F.col("ents"), F.lit(f)), F.lit(0)))])
    rows = p.withColumn("ents", ents).withColumn("presence", seen)
    q = drift.dropout_rates(rows, ["model_id", "dataset"], ["record_id"], "condition", STEPS)
    return q.select("model_id", "dataset", "transition", "field", "variant", "paired", "events", *[r6(F.col(c)).alias(c) for c in ("idr", "idr_ci_low", "idr_ci_high")])


@query(BASE + """, j AS (SELECT model_id, job_id FROM jobs), ok AS (SELECT job_id, json_valid, schema_valid, seconds FROM preds WHERE json_valid), bad AS (SELECT job_id FROM preds WHERE NOT json_valid OR NOT schema_valid)
SELECT model_id, count(*) AS expected, count(ok.job_id) AS done, count(CASE WHEN ok.job_id IS NULL THEN bad.job_id END) AS unresolved, count(*) - count(ok.job_id) AS remaining, round_even(100.0 * count(ok.job_id) / count(*), 3)::double AS percent,
round(avg(schema_valid::int), 6) AS schema_valid_rate, round(avg(seconds) FILTER (seconds > 0), 6) AS mean_seconds_per_item, round((count(*) - count(ok.job_id)) * avg(seconds) FILTER (seconds > 0) / 3600, 6) AS projected_hours
FROM j LEFT JOIN ok USING (job_id) LEFT JOIN bad ON bad.job_id = j.job_id GROUP BY 1""")
def progress_by_model(spark, d):
    p = predictions(spark, d)
    q = compaction.progress_report(jobs(spark, d), p.where("json_valid = 1"), p.where("schema_valid = 0"), "model_id", "job_id")
    return q.select("model_id", "expected", "done", "unresolved", "remaining", "percent", *[r6(F.col(c)).alias(c) for c in ("schema_valid_rate", "mean_seconds_per_item", "projected_hours")])


def fields(spark: SparkSession, d: str) -> DataFrame:
    """(job columns, field, texts) of predictions in three shapes: lists by type, entities with types, entities as an object of lists."""
    nouns = F.when(F.expr(_NOUN), F.array("w2", "p_name")).otherwise(F.filter(F.array("w2"), lambda _: F.lit(False)))
    adj = F.array("w1")
    typed = F.concat(F.transform(adj, lambda x: F.struct(F.lit("adj").alias("label"), x.alias("span"))), F.transform(nouns, lambda x: F.struct(F.lit("NOUN").alias("label"), x.alias("span"))))
    shapes = [F.to_json(F.struct(adj.alias("Adj"), nouns.alias("noun"))), F.to_json(F.struct(typed.alias("entities"))), F.to_json(F.struct(F.struct(adj.alias("Adj"), nouns.alias("Noun")).alias("entities")))]
    rows = _prediction_rows(spark, d).withColumn("raw", F.when(F.expr(_VALID), F.element_at(F.array(*shapes), (F.col("event_id") % 3 + 1).cast("int"))))
    each = rows.select("job_id", (F.col("event_id") % 1000).alias("prompt_tokens"), "value", F.expr(f"{_VALID} AND event_id % 5 <> 0").cast("int").alias("schema_valid"), F.explode(nested.extract_fields(F.col("raw"), FIELDS)).alias("f"))
    return compaction.settled(each).join(jobs(spark, d), "job_id").select("job_id", "model_id", "dataset", "record_id", "condition", "prompt_tokens", "value", "schema_valid", "f.*")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(text, embedding): each name and word with the vector of a hash of it."""
    w = _words(spark, d).select(F.explode(F.array("w1", "w2", "p_name")).alias("text")).distinct()
    known = t(spark, d, "embeddings").select("vec_id", "embedding")
    at = F.conv(F.substring(F.md5("text"), 1, 6), 16, 10).cast("long") % known.count()
    return w.withColumn("vec_id", at).join(known, "vec_id").select("text", "embedding")


def drifts(spark: SparkSession, d: str) -> DataFrame:
    dims = t(spark, d, "embeddings").select(F.size("embedding")).first()[0]
    c = compaction.settled(drift.text_centroids(fields(spark, d), vectors(spark, d), ["model_id", "dataset", "record_id", "condition"], dims))
    p = drift.level_pairs(c, ["model_id", "dataset", "record_id", "field"], "condition", STEPS, ["n", "centroid"])
    return p.withColumn("drift", drift.field_drift(F.col("left_n"), F.col("right_n"), F.col("left_centroid"), F.col("right_centroid")))


_DRIFTS = f""", vt AS (SELECT DISTINCT unnest([w1, w2, p_name]) AS text FROM words), vv AS (SELECT text, generate_subscripts(embedding, 1) AS i, unnest(embedding)::double AS x FROM vt JOIN embeddings ON vec_id = ('0x' || substr(md5(text), 1, 6))::bigint % (SELECT count(*) FROM embeddings)),
 vu AS (SELECT text, i, x / sqrt(sum(x * x) OVER (PARTITION BY text)) AS x FROM vv),
 ft AS (SELECT job_id, model_id, dataset, record_id, condition, unnest([{{'field': 'Adj', 'texts': CASE WHEN json_valid THEN [w1] ELSE [] END}}, {{'field': 'Noun', 'texts': CASE WHEN has_noun THEN [w2, p_name] ELSE [] END}}], recursive := true) FROM preds),
 fe AS (SELECT record_id, condition, field, unnest(texts) AS text FROM ft), fm AS (SELECT record_id, condition, field, i, avg(x) AS x FROM fe JOIN vu USING (text) GROUP BY ALL),
 fc AS (SELECT record_id, condition, field, i, x / sqrt(sum(x * x) OVER (PARTITION BY record_id, condition, field)) AS x FROM fm),
 cs AS (SELECT left_level, right_level, a.record_id, a.field, sum(a.x * b.x) AS cos FROM {_sql_pairs(STEPS)} JOIN fc a ON a.condition = left_level JOIN fc b ON b.condition = right_level AND b.record_id = a.record_id AND b.field = a.field AND b.i = a.i GROUP BY ALL),
 dr AS (SELECT a.model_id, a.dataset, a.record_id, pairs.left_level || '->' || pairs.right_level AS transition, a.field, CASE WHEN len(a.texts) = 0 AND len(b.texts) = 0 THEN 0.0 WHEN len(a.texts) = 0 OR len(b.texts) = 0 THEN 1.0 ELSE 1 - greatest(-1, least(1, cos)) END AS drift
 FROM {_sql_pairs(STEPS)} JOIN ft a ON a.condition = pairs.left_level JOIN ft b ON b.condition = pairs.right_level AND b.record_id = a.record_id AND b.field = a.field
 LEFT JOIN cs ON cs.left_level = pairs.left_level AND cs.right_level = pairs.right_level AND cs.record_id = a.record_id AND cs.field = a.field)"""


@query(BASE + _DRIFTS + """ SELECT model_id, dataset, record_id, transition, round(avg(drift), 6) AS psi, count(*) AS fields FROM dr GROUP BY ALL""")
def psi_pairwise(spark, d):
    q = drift.instability(drifts(spark, d), ["model_id", "dataset", "record_id"])
    return q.select("model_id", "dataset", "record_id", "transition", r6(F.col("psi")).alias("psi"), "fields")


def _volatility_sql(source: str, value: str, keys: list[str]) -> str:
    """Summaries with 5000-draw intervals, with the transition and without."""
    names = ["model_id", "dataset", "transition", *keys]
    both = f""", vo AS (SELECT '{"+".join(names)}' AS grouping, {", ".join(names)}, {value} AS value FROM {source} UNION ALL SELECT '{"+".join(n for n in names if n != "transition")}', {", ".join("NULL" if n == "transition" else n for n in names)}, {value} FROM {source})"""
    seed = " || '|' || ".join("coalesce(transition || '|', '')" if n == "transition" else n for n in names).replace("coalesce(transition || '|', '') || '|' || ", "coalesce(transition || '|', '') || ")
    if not keys:
        seed = "model_id || '|' || dataset || coalesce('|' || transition, '')"
    by = ["grouping", *names]
    on = " AND ".join(f"a.{k} IS NOT DISTINCT FROM ci.{k}" for k in by)
    return both + bootstrap_sql(by, "vo", "value", 5000, f"{seed} || '|{value}'") + f""", a AS (SELECT {", ".join(by)}, count(*) AS n, round(avg(value), 9) AS mean, round(median(value), 9) AS median, round(coalesce(stddev_samp(value), 0), 9) AS std, round(quantile_cont(value, 0.9), 9) AS p90,
 round(quantile_cont(value, 0.95), 9) AS p95, round(max(value), 9) AS max FROM vo GROUP BY {", ".join(by)}) SELECT a.*, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high FROM a JOIN ci ON {on}"""


def _volatility(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    groupings = [["model_id", "dataset", "transition", *keys], ["model_id", "dataset", *keys]]
    q = stats.summaries(rows, groupings, [value], draws=5000)
    return q.select("grouping", *groupings[0], "n", *[F.round(c, 9).alias(c) for c in ("mean", "median", "std", "p90", "p95", "max", "ci_low", "ci_high")])


@query(BASE + _DRIFTS + _volatility_sql("dr", "drift", ["field"]))
def field_volatility(spark, d):
    return _volatility(drifts(spark, d), "drift", ["field"])


@query(BASE + _DRIFTS + """, ps AS (SELECT model_id, dataset, record_id, transition, avg(drift) AS psi FROM dr GROUP BY ALL)""" + _volatility_sql("ps", "psi", []))
def psi_volatility(spark, d):
    return _volatility(drift.instability(drifts(spark, d), ["model_id", "dataset", "record_id"]), "psi", [])


_SCORES = ["entity_exact_f1", "entity_partial_f1", "relation_exact_f1"]
_TARGETS = [f"{sign}delta_{m}" for m in _SCORES for sign in ("", "abs_")]


def pairwise(spark: SparkSession, d: str) -> DataFrame:
    """psi of pairs with the changes of their measurements."""
    m = metrics(spark, d).select("model_id", "dataset", "record_id", "condition", *_SCORES, "prompt_tokens", "schema_valid")
    values = [*_SCORES, "prompt_tokens"]
    deltas = drift.deltas(drift.level_pairs(m, ["model_id", "dataset", "record_id"], "condition", STEPS, [*values, "schema_valid"]), values)
    psi = drift.instability(drifts(spark, d), ["model_id", "dataset", "record_id"])
    return compaction.settled(psi.join(deltas, ["model_id", "dataset", "record_id", "transition"]))


_PAIRWISE = _DRIFTS + f""", ps AS (SELECT model_id, dataset, record_id, transition, avg(drift) AS psi FROM dr GROUP BY ALL),
 de AS (SELECT a.record_id, left_level || '->' || right_level AS transition, {", ".join(f"b.{c} - a.{c} AS delta_{c}, abs(b.{c} - a.{c}) AS abs_delta_{c}" for c in _SCORES)}, (a.schema_valid = 1 AND b.schema_valid = 0)::int AS schema_break
 FROM {_sql_pairs(STEPS)} JOIN metrics a ON a.condition = left_level JOIN metrics b ON b.condition = right_level AND b.record_id = a.record_id), pw AS (SELECT * FROM ps JOIN de USING (record_id, transition))"""


@query(BASE + _PAIRWISE + """ SELECT model_id, dataset, record_id, count(*) AS n, round(avg(psi), 6) AS mean, round(median(psi), 6) AS median, round(quantile_cont(psi, 0.95), 6) AS p95, round(max(psi), 6) AS max, sum(schema_break)::bigint AS schema_breaks FROM pw GROUP BY ALL""")
def document_instability(spark, d):
    q = pairwise(spark, d).groupBy("model_id", "dataset", "record_id").agg(*stats.summary("psi"), F.sum("schema_break").alias("schema_breaks"))
    return q.select("model_id", "dataset", "record_id", "n", *[r6(F.col(c)).alias(c) for c in ("mean", "median", "p95", "max")], "schema_breaks")


_T = "list_sum(list_transform(range(4001), lambda q: CASE WHEN q IN (0, 4000) THEN 1 WHEN q % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(q * tt / 4000, 2) / (n - 2), -(n - 1) / 2))) * tt / 12000 * exp(lgamma((n - 1) / 2) - lgamma((n - 2) / 2)) / sqrt((n - 2) * pi())"


_G = "grouping, model_id, dataset, transition, target"


@query(BASE + _PAIRWISE + f""", tg AS (SELECT model_id, dataset, transition, psi AS x, unnest([{", ".join(f"{{'target': '{c}', 'y': {c}}}" for c in _TARGETS)}], recursive := true) FROM pw),
 g AS (SELECT 'model_id+dataset+transition' AS grouping, model_id, dataset, transition, target, round(x, 9) AS x, round(y, 9) AS y FROM tg UNION ALL SELECT 'model_id+dataset', model_id, dataset, NULL, target, round(x, 9), round(y, 9) FROM tg UNION ALL SELECT 'model_id', model_id, NULL, NULL, target, round(x, 9), round(y, 9) FROM tg),
 rk AS (SELECT *, rank() OVER (PARTITION BY {_G} ORDER BY x) + (count(*) OVER (PARTITION BY {_G}, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY {_G} ORDER BY y) + (count(*) OVER (PARTITION BY {_G}, y) - 1) / 2 AS ry FROM g),
 co AS (SELECT {_G}, count(*) AS n, CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(rx, ry) END AS rho FROM rk GROUP BY ALL HAVING count(*) >= 4),
 tt AS (SELECT *, CASE WHEN abs(rho) < 0.999999999 THEN abs(rho) * sqrt((n - 2) / (1 - rho * rho)) END AS tt FROM co),
 pv AS (SELECT *, CASE WHEN abs(rho) >= 0.999999999 THEN 0.0 ELSE 1 - 2 * {_T} END AS p FROM tt),
 hh AS (SELECT *, least(1.0, p * (count(p) OVER (PARTITION BY grouping, target) - row_number() OVER (PARTITION BY grouping, target, p IS NULL ORDER BY p, model_id, dataset, transition) + 1)) AS raw FROM pv)
SELECT {_G}, n, round(rho, 5) AS rho, round(p, 5) AS p, CASE WHEN p IS NOT NULL THEN round(max(raw) OVER (PARTITION BY grouping, target, p IS NULL ORDER BY p, model_id, dataset, transition ROWS UNBOUNDED PRECEDING), 5) END AS p_holm FROM hh""")
def psi_correlations(spark, d):
    """All six targets, by the reference's three groupings."""
    rows = pairwise(spark, d).withColumns({c: F.round(c, 9) for c in ("psi", *_TARGETS)})
    q = stats.correlations(rows, "psi", _TARGETS, [["model_id", "dataset", "transition"], ["model_id", "dataset"], ["model_id"]])
    return q.select("grouping", "model_id", "dataset", "transition", "target", "n", *[F.round(c, 5).alias(c) for c in ("rho", "p", "p_holm")])


_HASHED = 8


def hash_encoder():
    """A fixed encoder: words go by their digests to one of eight dimensions and a sign."""
    import hashlib

    import numpy as np

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), _HASHED))
        for row, words in zip(out, texts):
            for w in words.split(" "):
                h = hashlib.md5(w.encode()).hexdigest()
                row[int(h[:2], 16) % _HASHED] += 1 if int(h[2], 16) < 8 else -1
        return out

    return encode


@query(f"""WITH w AS (SELECT text, unnest(string_split(text, ' ')) AS x FROM (SELECT DISTINCT p_name AS text FROM part)), v AS (SELECT text, ('0x' || substr(md5(x), 1, 2))::int % {_HASHED} AS i, sum(CASE WHEN ('0x' || substr(md5(x), 3, 1))::int < 8 THEN 1 ELSE -1 END) AS s FROM w GROUP BY ALL),
n AS (SELECT *, sqrt(sum(s * s) OVER (PARTITION BY text)) AS n FROM v)
SELECT p.p_partkey, {", ".join(f"round(CASE WHEN max(n) > 0 THEN coalesce(sum(s) FILTER (i = {i}), 0) / max(n) END, 6) AS e{i}" for i in range(_HASHED))} FROM part p JOIN n ON n.text = p.p_name GROUP BY 1""")
def text_embeddings(spark, d):
    """Each part's name with its vector: distinct names are encoded, and joined back."""
    parts = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("text"))
    q = parts.join(drift.embedded(parts, hash_encoder), "text")
    return q.select("p_partkey", *[F.round(F.get("embedding", i), 6).alias(f"e{i}") for i in range(_HASHED)])
