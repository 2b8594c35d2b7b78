"""Queries of single functions over well-formed, malformed and empty values, and manifests of corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nested, text
from ..operators import compaction, corpus, stats
from ..sources import readers, writers
from .catalog import query, t
from .corpora import workspace

_FLAT = """CASE event_id % 7 WHEN 0 THEN '{"a": [1], "b": []}' WHEN 1 THEN '{"a": [1]}' WHEN 2 THEN '{"b": [], "a": [], "c": 1}' WHEN 3 THEN '{"a": 1, "b": []}' WHEN 4 THEN '[1]' WHEN 5 THEN 'torn {' END"""


@query("""SELECT event_id, event_id % 7 < 4 AS json_valid, event_id % 7 IN (0, 3) AS exact_keys, event_id % 7 IN (0, 2) AS all_values_lists,
CASE WHEN event_id % 7 IN (0, 2, 3) THEN '' WHEN event_id % 7 = 1 THEN 'b' ELSE 'a,b' END AS missing_keys, CASE WHEN event_id % 7 = 2 THEN 'c' ELSE '' END AS extra_keys FROM events""")
def flat_answers(spark, d):
    """Answers that should be an object of two lists: with the keys, without one, with one too many, with no list, and no object at all."""
    e = t(spark, d, "events").select("event_id", F.expr(_FLAT).alias("answer"))
    v = e.select("event_id", nested.flat_validation("answer", ["a", "b"]).alias("v")).select("event_id", "v.*")
    return v.withColumns({c: F.array_join(c, ",") for c in ("missing_keys", "extra_keys")})


@query("""SELECT conv_id, turn, conv_id % 5 < 4 AS json_valid, conv_id % 5 IN (0, 1) AS exact_keys, conv_id % 5 IN (0, 2) AS entities_valid, conv_id % 5 IN (0, 1) AS relations_valid, conv_id % 5 = 0 AS schema_valid FROM conversations""")
def answers_of_five_kinds(spark, d):
    """Valid; an entity whose text is a number; no relations; a list, in which an object of other keys is found; and no JSON."""
    good = F.struct(F.array(F.struct("text", F.col("role").alias("type"))).alias("entities"), F.expr("cast(array() as array<string>)").alias("relations"))
    number = F.struct(F.array(F.struct(F.col("turn").alias("text"), F.col("role").alias("type"))).alias("entities"), F.expr("cast(array() as array<string>)").alias("relations"))
    kinds = F.array(F.to_json(good), F.to_json(number), F.to_json(F.struct(F.array(F.struct("text", F.col("role").alias("type"))).alias("entities"))), F.to_json(F.array(F.struct("text"))), F.concat(F.lit("no { JSON: "), "text"))
    rows = t(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("```json\n"), F.get(kinds, (F.col("conv_id") % 5).cast("int")), F.lit("\n```")).alias("raw"))
    found = rows.select("conv_id", "turn", nested.extract_object("raw").alias("object"))
    return found.select("conv_id", "turn", nested.validation("object").alias("v")).select("conv_id", "turn", "v.*")


_LINES = """list_transform(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: CASE length(x) % 5 WHEN 0 THEN '' WHEN 1 THEN ' 1 ' WHEN 2 THEN '0' WHEN 3 THEN 'B' ELSE '2.5' END)"""


@query(rf"""WITH l AS (SELECT conv_id, turn, {_LINES} AS l FROM conversations), n AS (SELECT conv_id, turn, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM l),
k AS (SELECT *, lag(x) OVER (PARTITION BY conv_id, turn ORDER BY i) AS p FROM (SELECT * FROM n WHERE trim(x) IN ('0', '1')))
SELECT n.conv_id, n.turn, count(*) FILTER (trim(x) IN ('0', '1'))::int AS labels, coalesce(sum(CASE WHEN trim(x) = '1' THEN 1 END), 0)::bigint AS total, count(*) FILTER (trim(x) IN ('0', '1'))::int AS binary_labels,
count(*) FILTER (trim(x) IN ('1', 'B'))::int AS positive_lines, (SELECT count(*) FROM k WHERE k.conv_id = n.conv_id AND k.turn = n.turn AND trim(k.x) = '1' AND coalesce(trim(p), '0') <> '1')::int AS runs FROM n GROUP BY 1, 2""")
def labels_of_lines(spark, d):
    """Label files of a line for each word: integers, tags, numbers that aren't whole, and empty lines."""
    words = F.split(text.normal_space(F.col("text")), " ")
    line = lambda x: F.when(F.length(x) % 5 == 0, "").when(F.length(x) % 5 == 1, " 1 ").when(F.length(x) % 5 == 2, "0").when(F.length(x) % 5 == 3, "B").otherwise("2.5")
    rows = t(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.transform(words, line), "\n").alias("lines"))
    whole = nested.labels_from_lines(F.col("lines"))
    rows = rows.withColumn("whole", whole)
    total = F.aggregate("whole", F.lit(0).cast("long"), lambda acc, x: acc + x)
    return rows.select("conv_id", "turn", F.size("whole").alias("labels"), total.alias("total"), F.size(nested.binary_labels(F.regexp_replace("lines", r"2\.5", "x"))).alias("binary_labels"), nested.positive_lines(F.col("lines")).alias("positive_lines"), nested.positive_runs(F.col("whole")).alias("runs"))


@query("""WITH w AS (SELECT p_partkey, unnest([upper(split_part(p_name, ' ', 1)), split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), upper(split_part(p_name, ' ', 2)), split_part(p_name, ' ', 1)]) AS x, unnest(range(5)) AS i FROM part),
f AS (SELECT p_partkey, lower(x) AS k, arg_min(x, i) AS x FROM w GROUP BY 1, 2) SELECT p_partkey, string_agg(x, '|' ORDER BY k) AS kept FROM f GROUP BY 1""")
def caseless_names(spark, d):
    w = F.split("p_name", " ")
    p = t(spark, d, "part").select("p_partkey", F.array(F.upper(w[0]), w[0], w[1], F.upper(w[1]), w[0]).alias("x"))
    return p.select("p_partkey", F.array_join(nested.dedupe_caseless(F.col("x")), "|").alias("kept"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 'Clicked' ELSE upper(substr(event_type, 1, 1)) || substr(event_type, 2) || ' Rate' END || ' · ' || user_id AS label FROM events""")
def labels_for_reading(spark, d):
    raw = F.concat(F.lit("__"), "event_type", F.lit("_rate__"))
    pretty = text.pretty_label(raw, {"__click_rate__": "Clicked"})
    return t(spark, d, "events").select("event_id", text.joined_label(pretty, F.col("user_id").cast("string")).alias("label"))


@query("""SELECT event_type, n FROM (SELECT event_type, count(*) AS n, CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 4 END AS k FROM events GROUP BY 1) ORDER BY k, event_type LIMIT 4""")
def levels_in_their_order(spark, d):
    """The first four kinds of events in an order that is given; kinds that it lacks come last."""
    counts = t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return compaction.by_position(counts, "event_type", ["purchase", "view", "click"]).limit(4)


@query("""WITH p AS (SELECT user_id % 50 AS k, count(*) FILTER (event_type = 'click') AS b, count(*) FILTER (event_type = 'view' AND event_id % 3 = 0) AS c FROM events GROUP BY 1),
binom AS (SELECT k, b, c, CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END AS p FROM p),
h AS (SELECT *, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, k) + 1)) AS raw FROM binom), a AS (SELECT *, max(raw) OVER (ORDER BY p, k ROWS UNBOUNDED PRECEDING) AS p_holm FROM h)
SELECT k, b, c, round(p, 9) AS p, round(p_holm, 9) AS p_holm FROM a WHERE p_holm < 0.05""")
def significant_tests(spark, d):
    """The McNemar tests of users' groups that stay significant after Holm's adjustment."""
    e = t(spark, d, "events").groupBy((F.col("user_id") % 50).alias("k")).agg(F.count_if(F.col("event_type") == "click").alias("b"), F.count_if((F.col("event_type") == "view") & (F.col("event_id") % 3 == 0)).alias("c"))
    q = stats.significant(stats.holm(e.withColumn("p", stats.mcnemar("b", "c")), "p", order=["k"]))
    return q.select("k", "b", "c", F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"))


@query("""SELECT least AS least, CASE WHEN least <= (SELECT count(DISTINCT doc_id) FROM labels) THEN 'first' WHEN least <= (SELECT count(*) FROM documents) THEN 'second' ELSE 'union' END AS chosen,
CASE WHEN least <= (SELECT count(DISTINCT doc_id) FROM labels) THEN (SELECT count(*) FROM labels) ELSE (SELECT count(*) FROM documents) END AS n FROM (SELECT unnest([1, (SELECT count(DISTINCT doc_id) + 1 FROM labels), (SELECT count(*) + 1 FROM documents)]) AS least)""")
def sources_by_cardinality(spark, d):
    """The first source that has enough keys, else the second, else both: each of the three."""
    first = t(spark, d, "labels").select("doc_id", F.lit("label").alias("kind"))
    second = t(spark, d, "documents").select("doc_id", F.lit("document").alias("kind"))
    out = None
    for least in (1, first.select("doc_id").distinct().count() + 1, second.count() + 1):
        name, rows = compaction.by_cardinality(first, second, ["doc_id"], least)
        one = rows.agg(F.count("*").alias("n")).select(F.lit(least).cast("long").alias("least"), F.lit(name).alias("chosen"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT source, count(*) AS docs, 1::bigint AS files, '.txt' AS extension FROM documents WHERE source IS NOT NULL GROUP BY 1""")
def discovered_files(spark, d):
    """A file for each source, found again by its extension below a folder that holds others too."""
    at = workspace(spark)
    docs = t(spark, d, "documents").where("source is not null")
    docs.select("source", F.regexp_replace("text", r"\s+", " ").alias("value")).repartition("source").write.partitionBy("source").text(f"{at}/corpus")
    docs.limit(1).select("doc_id").write.json(f"{at}/other")
    found = readers.discovered(spark, at, [".txt"], ["corpus"]).select("extension", F.regexp_extract("path", "source=([^/]*)/", 1).alias("source"))
    files = found.groupBy("source", "extension").agg(F.count("*").alias("files"))
    sizes = spark.read.text(f"{at}/corpus").groupBy("source").agg(F.count("*").alias("docs"))
    return sizes.join(files, "source").select("source", "docs", "files", "extension")


@query("""SELECT count(*) AS documents, count(DISTINCT lang) AS langs, string_agg(DISTINCT lang, '|' ORDER BY lang) AS names FROM documents""")
def merged_summaries(spark, d):
    """A summary that is written, read again and merged: later numbers win, lists are joined without repeats, and a broken file counts as none."""
    at = workspace(spark)
    docs = t(spark, d, "documents")
    n = docs.agg(F.count("*").alias("documents"), F.count_distinct("lang").alias("langs"), F.array_sort(F.collect_set("lang")).alias("names")).first()
    path = f"{at}/summary.json"
    writers.update_summary(spark, path, {"documents": -1, "names": n.names[:2]}, ["names"])
    writers.update_summary(spark, path, {"documents": n.documents, "names": n.names}, ["names"])
    merged = writers.update_summary(spark, path, {"langs": n.langs}, ["names"])
    return spark.createDataFrame([(merged["documents"], merged["langs"], "|".join(merged["names"]))], "documents long, langs long, names string")


_CLEAN = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
_MANIFEST = rf"""WITH c AS (SELECT coalesce(source, '') AS dataset, coalesce(lang, '') AS split, doc_id, {_CLEAN} AS text, len(string_split({_CLEAN}, ' ')) AS words FROM documents),
m AS (SELECT dataset, split, doc_id, length(text) AS char_count, CASE WHEN text = '' THEN 0 ELSE words END AS word_count, (text <> '')::int AS eligible, CASE WHEN text <> '' THEN sha256(text) END AS text_sha256, (doc_id % 5)::int AS sentence_count, (doc_id % 7)::int AS entity_count,
 (doc_id % 3)::int AS relation_count, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN split ELSE concat_ws('|', list_sort([split, 'x'])[1], list_sort([split, 'x'])[2]) END AS label_types FROM c)"""


def _manifest(spark, d):
    labels = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit(""), F.lit(None))).when(F.col("doc_id") % 4 == 1, F.array("split", "split")).otherwise(F.array(F.lit("x"), "split", F.lit("")))
    docs = t(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("dataset"), F.coalesce("lang", F.lit("")).alias("split"), "doc_id", "text")
    counts = {f"{c}_count": (F.col("doc_id") % n).cast("int") for c, n in (("sentence", 5), ("entity", 7), ("relation", 3))}
    return corpus.manifest(docs.withColumns({**counts, "labels": labels}))


@query(_MANIFEST + """, b AS (SELECT dataset, doc_id, row_number() OVER (PARTITION BY dataset ORDER BY char_count, doc_id) / count(*) OVER (PARTITION BY dataset) AS q FROM m WHERE eligible = 1)
SELECT m.*, CASE WHEN q <= 1 / 3 THEN 'short' WHEN q <= 2 / 3 THEN 'medium' WHEN q IS NOT NULL THEN 'long' END AS length_bucket FROM m LEFT JOIN b USING (dataset, doc_id)""")
def corpus_manifest(spark, d):
    return _manifest(spark, d)


@query(_MANIFEST + """ SELECT dataset, split, count(*) AS documents, sum(eligible)::bigint AS eligible, sum(sentence_count)::bigint AS sentences, sum(entity_count)::bigint AS entities, sum(relation_count)::bigint AS relations,
coalesce(round_even(avg(char_count) FILTER (eligible = 1), 2), 0) AS mean_chars, coalesce(round_even(median(char_count) FILTER (eligible = 1), 2), 0) AS median_chars, coalesce(min(char_count) FILTER (eligible = 1), 0)::int AS min_chars, coalesce(max(char_count) FILTER (eligible = 1), 0)::int AS max_chars FROM m GROUP BY 1, 2""")
def corpus_manifest_summary(spark, d):
    return corpus.manifest_summary(_manifest(spark, d))


@query(_MANIFEST + """ SELECT dataset, label, count(*) AS documents_with_label FROM (SELECT dataset, unnest(string_split(label_types, '|')) AS label FROM m) WHERE label <> '' GROUP BY 1, 2""")
def corpus_label_inventory(spark, d):
    return corpus.label_inventory(_manifest(spark, d))
