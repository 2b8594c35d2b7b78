"""All named queries over the driver's tables with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import nested, text
from ..operators import compaction, corpus, drift, sampling, scoring, stats
from ..streaming import log
from .oracles import bootstrap_sql, exact_p_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


SPACED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(rf"""SELECT doc_id, {SPACED} AS clean, sha256(text) AS raw_hash, sha256({SPACED}) AS clean_hash, length(text) AS chars,
len(list_filter(string_split({SPACED}, ' '), lambda x: x <> '')) AS words FROM documents""")
def text_normalised(spark, d):
    c = text.normal_space(F.col("text"))
    return t(spark, d, "documents").select("doc_id", c.alias("clean"), text.sha256(F.col("text")).alias("raw_hash"), text.sha256(c).alias("clean_hash"), F.length("text").alias("chars"), text.word_count(F.col("text")).alias("words"))


@query(rf"""SELECT doc_id, greatest(1, 1 + len(regexp_extract_all({SPACED}, '[.!?] .', 0))) AS sentences FROM documents""")
def text_sentences(spark, d):
    return t(spark, d, "documents").select("doc_id", text.sentence_count(F.col("text")).alias("sentences"))


@query(r"""SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+'))) AS n_tokens FROM documents""")
def text_token_sets(spark, d):
    return t(spark, d, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).alias("n_tokens"))


@query("""SELECT doc_id, substr(sha256(concat_ws('|', lang, source, doc_id::varchar)), 1, 24) AS short_id,
('0x' || substr(sha256(concat_ws('|', lang, doc_id::varchar)), 1, 8))::bigint AS seed FROM documents""")
def text_ids_and_seeds(spark, d):
    i = F.col("doc_id").cast("string")
    return t(spark, d, "documents").select("doc_id", text.short_id(F.col("lang"), F.col("source"), i).alias("short_id"), text.seed32(F.col("lang"), i).alias("seed"))


@query("""SELECT page_id, nullif(regexp_extract(url, '(\\d{2,})', 1), '') AS long_id, CASE WHEN contains(url, ':') THEN regexp_extract(url, '^(.*):([^:]*)$', 1) ELSE url END AS head,
CASE WHEN contains(url, ':') THEN regexp_extract(url, '^(.*):([^:]*)$', 2) END AS tail FROM pages""".replace("\\\\", "\\"))
def text_url_parts(spark, d):
    e = text.typed_entity(F.col("url"))
    return t(spark, d, "pages").select("page_id", text.leading_id(F.col("url"), 2, anywhere=True).alias("long_id"), e["text"].alias("head"), e["type"].alias("tail"))


@query("""SELECT doc_id, round_even(n_chars / 7.0, 0) AS even FROM documents""")
def text_half_even(spark, d):
    return t(spark, d, "documents").select("doc_id", F.bround((F.col("n_chars") / 7.0).cast("decimal(20,6)"), 0).cast("double").alias("even"))


@query(rf"""WITH w AS (SELECT conv_id, turn, string_split({SPACED}, ' ') AS w FROM conversations),
e AS (SELECT conv_id, turn, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM w),
o AS (SELECT conv_id, turn, i, length(x) AS n, coalesce(sum(length(x) + 1) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM e)
SELECT conv_id, turn, count(*) AS tokens, max(s + n)::bigint AS end_char, sum(s)::bigint AS sum_starts FROM o GROUP BY 1, 2""")
def text_token_offsets(spark, d):
    w = F.split(text.normal_space(F.col("text")), " ")
    o = t(spark, d, "conversations").select("conv_id", "turn", F.posexplode(w))
    before = F.coalesce(F.sum(F.length("col") + 1).over(Window.partitionBy("conv_id", "turn").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return o.withColumn("s", before).groupBy("conv_id", "turn").agg(F.count("*").alias("tokens"), F.max(F.col("s") + F.length("col")).alias("end_char"), F.sum("s").alias("sum_starts"))


@query("""SELECT event_id, json_extract_string(props, '$.k')::int AS k, len(json_keys(props)) AS n_keys, json_keys(props)[1] AS first_key FROM events""")
def json_props(spark, d):
    k = F.expr("try_variant_get(try_parse_json(props), '$.k', 'int')")
    return t(spark, d, "events").select("event_id", k.alias("k"), F.expr("size(json_object_keys(props))").alias("n_keys"), F.expr("json_object_keys(props)[0]").alias("first_key"))


@query("""SELECT conv_id, turn, text AS entity, role AS kind, '{' AS opens, true AS json_valid, true AS exact_keys, true AS entities_valid, true AS relations_valid, true AS schema_valid FROM conversations""")
def json_extraction_and_validation(spark, d):
    made = t(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("Answer {not json}:\n```json\n"), F.to_json(F.struct(F.array(F.struct("text", F.col("role").alias("type"))).alias("entities"), F.expr("cast(array() as array<string>)").alias("relations"))), F.lit("\n``` done")).alias("raw"))
    parsed = made.withColumn("found", nested.extract_object_and_text("raw")).select("conv_id", "turn", "found.object", "found.source")
    first = F.from_json("object", "entities array<struct<text: string, type: string>>")["entities"][0]
    return parsed.select("conv_id", "turn", first["text"].alias("entity"), first["type"].alias("kind"), F.substring("source", 1, 1).alias("opens"), nested.validation("object").alias("v")).select("conv_id", "turn", "entity", "kind", "opens", "v.*")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id, event_id, event_type, round(value, 6) AS value FROM e WHERE rn = 1""")
def latest_event_per_user(spark, d):
    return compaction.latest(t(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", r6(F.col("value")).alias("value"))


def _orders_by_priority(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return o.where("o_orderpriority = '1-URGENT'"), o.where("o_orderpriority = '2-HIGH'")


@query("""SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def pending_customers(spark, d):
    return compaction.pending(t(spark, d, "customer").select("c_custkey"), *_orders_by_priority(spark, d), "c_custkey")


@query("""SELECT o_custkey AS c_custkey FROM orders WHERE o_orderpriority = '2-HIGH' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'""")
def unresolved_customers(spark, d):
    return compaction.unresolved(t(spark, d, "customer").select("c_custkey"), *_orders_by_priority(spark, d), "c_custkey")


@query("""WITH j AS (SELECT c_mktsegment AS segment, c_custkey AS k FROM customer), o AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'),
f AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
SELECT segment, count(*) AS expected, count(o.k) AS done, count(CASE WHEN o.k IS NULL THEN f.k END) AS unresolved, count(*) - count(o.k) AS remaining,
round_even(100.0 * count(o.k) / count(*), 3)::double AS percent FROM j LEFT JOIN o USING (k) LEFT JOIN f ON f.k = j.k GROUP BY 1""")
def progress_by_segment(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    j = t(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("k"))
    return compaction.progress(j, o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "segment", "k")


@query("""SELECT doc_id, sha256(text) AS digest, count(*) OVER (PARTITION BY sha256(text)) AS group_size FROM documents QUALIFY group_size > 1""")
def duplicate_documents(spark, d):
    return compaction.duplicates(t(spark, d, "documents").select("doc_id", "text"), text.sha256(F.col("text"))).select("doc_id", "digest", "group_size")


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS ordinal FROM conversations""")
def ordinals(spark, d):
    return compaction.latest_ordinal(t(spark, d, "conversations"), "conv_id", ["turn", "role"]).select("conv_id", "turn", "ordinal")


@query("""WITH s AS (SELECT l_returnflag AS condition, l_orderkey || '-' || l_linenumber AS job_id, l_orderkey FROM lineitem), k AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'),
u AS (SELECT job_id, condition, false AS is_alias, l_orderkey FROM s UNION ALL
SELECT 'alias::' || job_id || '::' || a, a, true, l_orderkey FROM s JOIN (VALUES ('A', 'A0'), ('N', 'A1')) v(c, a) ON c = condition WHERE l_orderkey IN (SELECT o_orderkey FROM k))
SELECT condition, is_alias, count(*) AS n, count(DISTINCT job_id) AS jobs, min(job_id) AS least FROM u GROUP BY 1, 2""")
def alias_rows(spark, d):
    rows = t(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("job_id"), F.col("l_returnflag").alias("condition"), "l_orderkey")
    sample = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    dim = spark.createDataFrame([("A", "A0"), ("N", "A1")], "condition string, alias string")
    return compaction.with_aliases(rows, dim, sample, ["l_orderkey"]).groupBy("condition", "is_alias").agg(F.count("*").alias("n"), F.count_distinct("job_id").alias("jobs"), F.min("job_id").alias("least"))


@query("""WITH p AS (SELECT user_id, event_type FROM events) SELECT user_id FROM p WHERE event_type = 'click' INTERSECT SELECT user_id FROM p WHERE event_type = 'view'""")
def users_in_both(spark, d):
    e = t(spark, d, "events").select("user_id", "event_type")
    return e.where("event_type = 'click'").select("user_id").intersect(e.where("event_type = 'view'").select("user_id"))


_GS = """round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(coalesce(stddev_samp(l_quantity), 0), 4) AS std,
round(quantile_cont(l_quantity, 0.95), 4) AS p95"""


@query(f"""SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, {_GS} FROM lineitem
GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, l_linenumber), (l_returnflag, l_linenumber))""")
def grouped_summaries(spark, d):
    q = t(spark, d, "lineitem").groupingSets([["l_returnflag", "l_linestatus", "l_linenumber"], ["l_returnflag", "l_linenumber"]], "l_returnflag", "l_linestatus", "l_linenumber")
    return q.agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.round(F.percentile("l_extendedprice", F.lit(0.5)), 4).alias("median"), F.round(F.coalesce(F.stddev_samp("l_quantity"), F.lit(0.0)), 4).alias("std"), F.round(F.percentile("l_quantity", F.lit(0.95)), 4).alias("p95"))


@query("""SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(coalesce(stddev_samp(value), 0), 6) AS std,
round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS max FROM events GROUP BY 1""")
def value_summary(spark, d):
    q = t(spark, d, "events").groupBy("event_type").agg(*stats.summary("value"))
    return q.select("event_type", "n", *[r6(F.col(c)).alias(c) for c in ("mean", "median", "std", "p90", "p95", "max")])


@query("WITH src AS (SELECT p_brand, p_retailprice AS value FROM part)" + bootstrap_sql(["p_brand"], "src", "value", 2000) + """ SELECT p_brand, n, round(mean, 6) AS mean, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM s JOIN ci USING (p_brand)""")
def bootstrap_by_brand(spark, d):
    q = stats.bootstrap_mean(t(spark, d, "part").select("p_brand", F.col("p_retailprice").alias("x")), ["p_brand"], "x")
    return q.select("p_brand", "n", *[r6(F.col(c)).alias(c) for c in ("mean", "ci_low", "ci_high")])


@query("""WITH w AS (SELECT conv_id, role, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+')) AS x FROM conversations WHERE role IN ('user', 'assistant')),
c AS (SELECT conv_id, x, count(*) FILTER (role = 'user') AS p, count(*) FILTER (role = 'assistant') AS g FROM w GROUP BY 1, 2),
s AS (SELECT conv_id, sum(least(p, g))::bigint AS tp, sum(p)::bigint AS predicted, sum(g)::bigint AS gold FROM c GROUP BY 1),
q AS (SELECT *, CASE WHEN predicted = 0 THEN CASE WHEN gold = 0 THEN 1.0 ELSE 0.0 END ELSE tp / predicted END AS pr, CASE WHEN gold = 0 THEN CASE WHEN predicted = 0 THEN 1.0 ELSE 0.0 END ELSE tp / gold END AS re FROM s)
SELECT conv_id, tp, predicted, gold, round(pr, 6)::double AS precision, round(re, 6)::double AS recall, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 6)::double AS f1 FROM q""".replace("\\\\", "\\"))
def multiset_f1_by_conversation(spark, d):
    w = t(spark, d, "conversations").select("conv_id", "role", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w+)"), 1)).alias("x"))
    q = scoring.multiset_f1(w.where("role = 'user'"), w.where("role = 'assistant'"), ["conv_id"], "x")
    return q.select("conv_id", "tp", "predicted", "gold", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query("""WITH RECURSIVE s AS (SELECT p_partkey % 200 AS k, p_partkey // 200 AS pos, p_type AS type, p_name AS text FROM part),
p AS (SELECT k, pos AS p, type, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+')) AS w FROM s WHERE pos % 2 = 0),
g AS (SELECT k, pos AS g, type, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+')) AS w FROM s WHERE pos % 2 = 1),
c AS (SELECT k, len(list_intersect(p.w, g.w)) / len(list_distinct(list_concat(p.w, g.w))) AS score, p, g FROM p JOIN g USING (k, type)),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, p DESC, g DESC) AS i FROM c WHERE score >= 0.5),
f AS (SELECT k, 0::bigint AS i, []::bigint[] AS up, []::bigint[] AS ug, 0 AS tp FROM (SELECT DISTINCT k FROM o) UNION ALL
 SELECT o.k, o.i, CASE WHEN list_contains(up, p) OR list_contains(ug, g) THEN up ELSE list_append(up, p) END, CASE WHEN list_contains(up, p) OR list_contains(ug, g) THEN ug ELSE list_append(ug, g) END,
 tp + CASE WHEN list_contains(up, p) OR list_contains(ug, g) THEN 0 ELSE 1 END FROM f JOIN o ON o.k = f.k AND o.i = f.i + 1),
n AS (SELECT k, max(tp)::int AS tp FROM f GROUP BY 1), z AS (SELECT k, count(*) FILTER (pos % 2 = 0) AS predicted, count(*) FILTER (pos % 2 = 1) AS gold FROM s GROUP BY 1)
SELECT k, coalesce(tp, 0) AS tp, predicted, gold FROM z LEFT JOIN n USING (k)""".replace("\\\\", "\\"))
def greedy_partial_match(spark, d):
    s = t(spark, d, "part").select((F.col("p_partkey") % 200).alias("k"), F.floor(F.col("p_partkey") / 200).cast("int").alias("pos"), F.col("p_type").alias("type"), F.col("p_name").alias("text"))
    return scoring.partial_f1(s.where("pos % 2 = 0"), s.where("pos % 2 = 1"), "k").select("k", "tp", "predicted", "gold")


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place FROM events),
c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR place = 0 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY place)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY place) AS run FROM c)
SELECT user_id, run::bigint AS run, event_type, min(place) AS first, max(place) AS last, count(*) AS length FROM r GROUP BY 1, 2, 3""")
def event_islands(spark, d):
    e = t(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return sampling.islands(e, ["user_id"], ["ts", "event_id"], "event_type").withColumn("first", F.col("first").cast("long")).withColumn("last", F.col("last").cast("long"))


@query("""WITH d AS (SELECT doc_id, lang, n_chars, sha256(text || doc_id) AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars, h) AS r, count(*) OVER (PARTITION BY lang) AS n FROM d),
s AS (SELECT *, CASE WHEN r <= round_even(n / 4, 0) THEN 0 WHEN r <= round_even(n / 2, 0) THEN 1 WHEN r <= round_even(n * 3 / 4, 0) THEN 2 ELSE 3 END AS stratum FROM r)
SELECT doc_id, lang, stratum FROM (SELECT *, row_number() OVER (PARTITION BY lang, stratum ORDER BY h) AS b FROM s) WHERE b <= 10""")
def quartile_sample(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "lang", "n_chars", F.sha2(F.concat("text", F.col("doc_id").cast("string")), 256).alias("h"))
    return sampling.quartile_sample(rows, ["lang"], ["n_chars"], "h", 40).select("doc_id", "lang", "stratum")


@query("""WITH r AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) / count(*) OVER (PARTITION BY lang) AS q FROM documents)
SELECT doc_id, lang, CASE WHEN q <= 1 / 3 THEN 'short' WHEN q <= 2 / 3 THEN 'medium' ELSE 'long' END AS bucket FROM r""")
def length_buckets(spark, d):
    return sampling.length_buckets(t(spark, d, "documents").select("doc_id", "lang", "n_chars"), "n_chars", ["lang"], "doc_id").drop("n_chars")


@query("""WITH b AS (SELECT p_type, p_size, max(p_retailprice) AS y FROM part GROUP BY 1, 2), w AS (SELECT *, max(y) OVER (PARTITION BY p_type ORDER BY p_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM b)
SELECT p_type, p_size, y AS p_retailprice FROM w WHERE m IS NULL OR y > m""")
def pareto_frontier(spark, d):
    return sampling.pareto(t(spark, d, "part"), "p_size", "p_retailprice", ["p_type"])


@query("""SELECT doc_id, h FROM (SELECT doc_id, sha256(text || doc_id) AS h FROM documents ORDER BY n_chars, h LIMIT 100) ORDER BY h LIMIT 3""")
def demo_pick(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "n_chars", F.sha2(F.concat("text", F.col("doc_id").cast("string")), 256).alias("h"))
    return sampling.demos(rows, "n_chars", "h").select("doc_id", "h")


@query("""WITH e AS (SELECT list_sort(list_distinct(quantile_cont(l_quantity, [0,.1,.2,.3,.4,.5,.6,.7,.8,.9,1.0]))) AS e FROM lineitem),
b AS (SELECT greatest(1, len(list_filter(e, lambda x: x < l_quantity))) AS bin, l_quantity AS x, l_extendedprice AS y FROM lineitem, e)
SELECT bin, count(*) AS n, median(x) AS x_median, round(median(y), 4) AS y_median FROM b GROUP BY 1""")
def binned_medians(spark, d):
    q = sampling.binned_median(t(spark, d, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice")
    return q.withColumn("y_median", F.round("y_median", 4))


@query("""SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 30""")
def top_parts(spark, d):
    return t(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(30)


@query("""WITH n AS (SELECT c.conv_id, c.turn, length(c.text) AS l, length(x.text) AS r FROM conversations c JOIN conversations x ON x.conv_id = c.conv_id AND x.turn = c.turn + 1)
SELECT conv_id, turn, l AS "left", r AS "right", r - l AS delta FROM n""")
def adjacent_turns(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return drift.adjacent(c, ["conv_id"], "turn", "n").withColumn("delta", F.col("right") - F.col("left"))


_PAIRS = """WITH v AS (SELECT user_id, date_trunc('day', ts) AS day, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b, max((event_type = 'purchase')::int) AS c, max((event_type = 'error')::int) AS e FROM events GROUP BY 1, 2)"""


def _pairs(spark, d):
    on = lambda kind: F.col("event_type") == kind
    e = t(spark, d, "events").groupBy("user_id", F.date_trunc("day", F.col("ts")).alias("day"))
    return e.agg(F.avg(F.when(on("click"), F.col("value"))).alias("a"), F.avg(F.when(on("view"), F.col("value"))).alias("b"), F.max(on("purchase").cast("int")).alias("c"), F.max(on("error").cast("int")).alias("e"))


@query(_PAIRS + """, d AS (SELECT user_id % 5 AS k, b - a AS d FROM v WHERE a IS NOT NULL AND b IS NOT NULL), n AS (SELECT k, count(*) AS pairs FROM d GROUP BY 1),
r AS (SELECT k, d, rank() OVER (PARTITION BY k ORDER BY abs(d)) + (count(*) OVER (PARTITION BY k, abs(d)) - 1) / 2 AS r FROM d WHERE d <> 0),
s AS (SELECT k, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS up, coalesce(sum(r) FILTER (d < 0), 0) AS down, count(*) FILTER (d > 0) AS pos, count(*) FILTER (d < 0) AS neg FROM r GROUP BY 1)
SELECT k, pairs, coalesce(n, 0) AS n, round(coalesce(least(up, down), 0), 4)::double AS w, round(coalesce((pos - neg) / greatest(n, 1), 0), 6) AS sign_effect, round(coalesce((up - down) / nullif(up + down, 0), 0), 6) AS rank_biserial FROM n LEFT JOIN s USING (k)""")
def wilcoxon_statistic(spark, d):
    q = stats.wilcoxon(_pairs(spark, d).withColumn("k", F.col("user_id") % 5), ["k"], "a", "b")
    return q.select("k", "pairs", "n", F.round("w", 4).alias("w"), r6(F.col("sign_effect")).alias("sign_effect"), r6(F.col("rank_biserial")).alias("rank_biserial"))


_W = """, d AS (SELECT user_id % 5 AS k, b - a AS d FROM v WHERE a IS NOT NULL AND b IS NOT NULL), r AS (SELECT k, d, rank() OVER (PARTITION BY k ORDER BY abs(d)) + (count(*) OVER (PARTITION BY k, abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY k, abs(d)) AS c FROM d WHERE d <> 0),
s AS (SELECT k, count(*) AS n, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w, sum(c * c - 1) AS ties FROM r GROUP BY 1), tests AS (SELECT *, abs(w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s)"""


@query(_PAIRS.replace("WITH", "WITH RECURSIVE") + _W + exact_p_sql("tests") + """, h AS (SELECT *, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, k) + 1)) AS raw FROM p)
SELECT k, n, round(w, 4)::double AS w, round(p, 6)::double AS p, round(max(raw) OVER (ORDER BY p, k ROWS UNBOUNDED PRECEDING), 6)::double AS p_holm, (max(raw) OVER (ORDER BY p, k ROWS UNBOUNDED PRECEDING) < 0.05)::int AS significant FROM h""")
def wilcoxon_p_values(spark, d):
    q = stats.wilcoxon(_pairs(spark, d).withColumn("k", F.col("user_id") % 5), ["k"], "a", "b")
    return stats.holm(q, "p", order=["k"]).select("k", "n", F.round("w", 4).alias("w"), r6(F.col("p")).alias("p"), r6(F.col("p_holm")).alias("p_holm"), "significant")


@query(_PAIRS + """, c AS (SELECT user_id % 20 AS k, count(*) FILTER (c = 1 AND e = 0) AS b, count(*) FILTER (c = 0 AND e = 1) AS c FROM v GROUP BY 1),
p AS (SELECT *, CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END AS p FROM c),
h AS (SELECT *, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, k) + 1)) AS raw FROM p)
SELECT k, b, c, round(p, 6)::double AS p, round(max(raw) OVER (ORDER BY p, k ROWS UNBOUNDED PRECEDING), 6)::double AS p_holm, (max(raw) OVER (ORDER BY p, k ROWS UNBOUNDED PRECEDING) < 0.05)::int AS significant FROM h""")
def mcnemar_with_holm(spark, d):
    k = _pairs(spark, d).groupBy((F.col("user_id") % 20).alias("k")).agg(F.count_if((F.col("c") == 1) & (F.col("e") == 0)).alias("b"), F.count_if((F.col("c") == 0) & (F.col("e") == 1)).alias("c"))
    q = stats.holm(k.withColumn("p", stats.mcnemar("b", "c")), "p", order=["k"])
    return q.select("k", "b", "c", r6(F.col("p")).alias("p"), r6(F.col("p_holm")).alias("p_holm"), "significant")


@query("""WITH s AS (SELECT p_type, p_retailprice AS x, p_size AS y FROM part), r AS (SELECT p_type, rank() OVER (PARTITION BY p_type ORDER BY x) + (count(*) OVER (PARTITION BY p_type, x) - 1) / 2 AS rx,
rank() OVER (PARTITION BY p_type ORDER BY y) + (count(*) OVER (PARTITION BY p_type, y) - 1) / 2 AS ry FROM s) SELECT p_type, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1 HAVING count(*) >= 4""")
def rank_correlation(spark, d):
    return stats.spearman(t(spark, d, "part"), ["p_type"], "p_retailprice", "p_size").select("p_type", "n", r6(F.col("rho")).alias("rho"))


_CENTROIDS = """WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::double AS x FROM embeddings), u AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM e),
m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY 1, 2), c AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM m)"""


@query(_CENTROIDS + " SELECT label, round(sum(x), 6) AS total, round(sum(x * x), 6) AS norm, round(max(x), 6) AS largest FROM c GROUP BY 1")
def label_centroids(spark, d):
    q = drift.centroids(t(spark, d, "embeddings"), ["label"])
    s = F.aggregate("centroid", F.lit(0.0), lambda acc, x: acc + x)
    return q.select("label", r6(s).alias("total"), r6(drift.dot(F.col("centroid"), F.col("centroid"))).alias("norm"), r6(F.array_max("centroid")).alias("largest"))


@query(_CENTROIDS + """ SELECT a.label, round(1 - greatest(-1, least(1, sum(a.x * b.x))), 6)::double AS drift FROM c a JOIN c b ON b.label = a.label + 1 AND b.i = a.i GROUP BY 1""")
def label_drift(spark, d):
    q = drift.adjacent(drift.centroids(t(spark, d, "embeddings"), ["label"]), [], "label", "centroid")
    return q.select("label", r6(drift.drift(F.col("left"), F.col("right"))).alias("drift"))


@query("""SELECT lang, source, count(*) AS documents, count(*) FILTER (length(trim(text)) > 0) AS eligible, sum(n_chars)::bigint AS chars, round_even(coalesce(avg(n_chars) FILTER (length(trim(text)) > 0), 0), 2) AS mean_chars,
coalesce(median(n_chars) FILTER (length(trim(text)) > 0), 0) AS median_chars, coalesce(min(n_chars) FILTER (length(trim(text)) > 0), 0) AS min_chars,
coalesce(max(n_chars) FILTER (length(trim(text)) > 0), 0) AS max_chars FROM documents GROUP BY 1, 2""")
def split_summary(spark, d):
    ok = F.length(F.trim("text")) > 0
    q = t(spark, d, "documents").groupBy("lang", "source")
    n = F.when(ok, F.col("n_chars"))
    return q.agg(F.count("*").alias("documents"), F.count_if(ok).alias("eligible"), F.sum("n_chars").alias("chars"), F.bround(F.coalesce(F.avg(n), F.lit(0.0)), 2).alias("mean_chars"), F.coalesce(F.median(n), F.lit(0.0)).alias("median_chars"), F.coalesce(F.min(n), F.lit(0)).alias("min_chars"), F.coalesce(F.max(n), F.lit(0)).alias("max_chars"))


@query("""SELECT lang, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY 1""")
def label_inventory(spark, d):
    return t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query("""WITH a AS (SELECT lang, unnest([{'check': 'documents', 'value': count(*)}, {'check': 'labelled', 'value': count(quality)}, {'check': 'chars', 'value': sum(n_chars)::bigint}], recursive := true) FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang),
e AS (SELECT lang, "check", CASE "check" WHEN 'documents' THEN value WHEN 'labelled' THEN value + 1 ELSE value * 3 END AS expected FROM a UNION ALL SELECT 'none', 'documents', 3)
SELECT e.lang, e."check", expected, coalesce(value, 0) AS actual, CASE WHEN coalesce(value, 0) = expected THEN 'PASS' WHEN coalesce(value, 0) < expected * 0.5 THEN 'FAIL' ELSE 'WARN' END AS status FROM e LEFT JOIN a ON a.lang IS NOT DISTINCT FROM e.lang AND a."check" = e."check\"""".replace('check\\"', 'check"'))
def validation_report(spark, d):
    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    actual = corpus.counted_checks(rows, ["lang"], {"documents": F.count("*"), "labelled": F.count("quality"), "chars": F.sum("n_chars")})
    want = F.when(F.col("check") == "documents", F.col("value")).when(F.col("check") == "labelled", F.col("value") + 1).otherwise(F.col("value") * 3)
    expected = actual.select("lang", "check", want.alias("value")).unionByName(spark.createDataFrame([("none", "documents", 3)], "lang string, check string, value long"))
    return corpus.audited(actual, expected, ["lang"])


@query("""WITH l AS (SELECT conv_id, turn, role, contains(lower(text), 'the') AS p FROM conversations), n AS (SELECT a.conv_id, a.p AS before, b.p AS after FROM l a JOIN l b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)
SELECT v AS variant, count(*) AS n, round(avg(CASE WHEN after THEN 0.0 ELSE 1.0 END), 6)::double AS dropout FROM n, (VALUES ('inclusive'), ('valid_only')) x(v) WHERE before AND (v = 'inclusive' OR conv_id % 2 = 0) GROUP BY 1""")
def dropout_rate(spark, d):
    l = t(spark, d, "conversations").select("conv_id", "turn", F.contains(F.lower("text"), F.lit("the")).alias("p"))
    n = drift.adjacent(l, ["conv_id"], "turn", "p").where("left").withColumn("variant", F.explode(F.array(F.lit("inclusive"), F.lit("valid_only"))))
    return n.where("variant = 'inclusive' or conv_id % 2 = 0").groupBy("variant").agg(F.count("*").alias("n"), r6(F.avg((~F.col("right")).cast("double"))).alias("dropout"))


@query("""WITH f AS (SELECT l_orderkey AS k, l_linenumber AS level, max(l_discount) AS x FROM lineitem GROUP BY 1, 2), p AS (SELECT a.k, a.level, abs(b.x - a.x) AS drift FROM f a JOIN f b ON b.k = a.k AND b.level = a.level + 1)
SELECT k, count(*) AS n, round(avg(drift), 6) AS mean, round(median(drift), 6) AS median, round(quantile_cont(drift, 0.95), 6) AS p95, round(max(drift), 6) AS max FROM p GROUP BY 1""")
def document_volatility(spark, d):
    f = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("level")).agg(F.max("l_discount").alias("x"))
    p = drift.adjacent(f, ["k"], "level", "x").select("k", F.abs(F.col("right") - F.col("left")).alias("drift"))
    return p.groupBy("k").agg(*stats.summary("drift")).select("k", "n", *[r6(F.col(c)).alias(c) for c in ("mean", "median", "p95", "max")])


@query("""SELECT p_type, round(avg(p_retailprice) FILTER (p_size <= 10), 4) AS small, round(avg(p_retailprice) FILTER (p_size > 10 AND p_size <= 30), 4) AS middle, round(avg(p_retailprice) FILTER (p_size > 30), 4) AS large FROM part GROUP BY 1""")
def statistic_matrix(spark, d):
    size = F.when(F.col("p_size") <= 10, "small").when(F.col("p_size") <= 30, "middle").otherwise("large")
    return t(spark, d, "part").withColumn("b", size).groupBy("p_type").pivot("b", ["small", "middle", "large"]).agg(F.round(F.avg("p_retailprice"), 4))


@query(rf"""WITH RECURSIVE i AS (SELECT doc_id AS id, len(list_filter(string_split({SPACED}, ' '), lambda x: x <> '')) AS size, CASE WHEN lang = 'en' THEN 900 ELSE 1200 END AS new FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY new ORDER BY size, id) AS k FROM i), b AS (SELECT id, size, new, k, 0 AS batch, 1 AS n FROM o WHERE k = 1 UNION ALL
 SELECT o.id, o.size, o.new, o.k, CASE WHEN n + 1 > 8 OR (o.size + o.new) * (n + 1) > 7000 THEN batch + 1 ELSE batch END, CASE WHEN n + 1 > 8 OR (o.size + o.new) * (n + 1) > 7000 THEN 1 ELSE n + 1 END FROM b JOIN o ON o.new = b.new AND o.k = b.k + 1)
SELECT id, size::int AS prompt_tokens, new AS max_new_tokens, batch FROM b""")
def micro_batches(spark, d):
    items = t(spark, d, "documents").select(F.col("doc_id").alias("id"), text.word_count(F.col("text")).alias("prompt_tokens"), F.when(F.col("lang") == "en", 900).otherwise(1200).alias("max_new_tokens"))
    return log.micro_batches(items, 8, 7000).drop("part")


@query("""WITH d AS (SELECT doc_id, lang, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+')) AS w FROM documents), b AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'))) AS x FROM benchmark),
n AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1), e AS (SELECT doc_id, unnest(w) AS x FROM d), s AS (SELECT doc_id, item_id, count(*) AS common FROM e JOIN b USING (x) GROUP BY 1, 2),
j AS (SELECT doc_id, max(common / (len(w) + n - common)) AS best FROM s JOIN n USING (item_id) JOIN d USING (doc_id) GROUP BY 1)
SELECT lang, quality, count(*) AS n, round(avg(coalesce(best, 0)), 6) AS mean, round(median(coalesce(best, 0)), 6) AS median, round(quantile_cont(coalesce(best, 0), 0.95), 6) AS p95
FROM d JOIN labels USING (doc_id) LEFT JOIN j USING (doc_id) GROUP BY 1, 2""".replace("\\\\", "\\"))
def flagship_overlap_summary(spark, d):
    """Best token overlap of each labelled document with a benchmark item, summarised by language and quality."""
    docs = t(spark, d, "documents").select("doc_id", "lang", text.tokens(F.col("text")).alias("w")).withColumn("size", F.size("w"))
    docs = docs.join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    items = t(spark, d, "benchmark").select("item_id", text.tokens(F.col("text")).alias("w")).select("item_id", F.size("w").alias("n"), F.explode("w").alias("x"))
    items = compaction.small(items)
    hits = docs.select("doc_id", "size", F.explode("w").alias("x")).join(items, "x").groupBy("doc_id", "item_id").agg(F.count("*").alias("both"), F.first("size").alias("size"), F.first("n").alias("n"))
    best = hits.groupBy("doc_id").agg(F.max(F.col("both") / (F.col("size") + F.col("n") - F.col("both"))).alias("best"))
    q = docs.select("doc_id", "lang", "quality").join(best, "doc_id", "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    return q.groupBy("lang", "quality").agg(*stats.summary("best")).select("lang", "quality", "n", *[r6(F.col(c)).alias(c) for c in ("mean", "median", "p95")])
