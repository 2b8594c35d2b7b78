"""Queries over corpora and files: sources and sinks by round trips, normalisation, free-form JSON, job tables, audits."""

from __future__ import annotations

import atexit
import uuid
from functools import reduce

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import nested, prompts, text
from ..operators import compaction, corpus, normalise, sampling
from ..operators.drift import unit
from ..sources import readers, writers
from .catalog import query, r6, t


_WRITTEN: list[tuple[SparkSession, str]] = []


def workspace(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or the warehouse where that is unset. Removed when the driver ends."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    at = f"{place.rstrip('/')}/tarn-files-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, at))
    return at


def _remove_written() -> None:
    for spark, at in _WRITTEN:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended before
            return


atexit.register(_remove_written)


@query("""SELECT conv_id, turn, role, text, (SELECT count(*) FROM conversations) AS written FROM conversations""")
def jsonl_round_trip(spark, d):
    rows, at = t(spark, d, "conversations"), workspace(spark)
    n = writers.jsonl(rows, at)
    return readers.strict_jsonl(spark, at, rows.schema).withColumn("written", F.lit(n))


@query("""SELECT user_id, event_id, event_type FROM events WHERE event_id % 7 <> 3 AND event_id % 7 <> 5 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def appended_log_with_torn_lines(spark, d):
    rows, at = t(spark, d, "events").select("user_id", "event_id", "event_type"), workspace(spark)
    good = "event_id % 7 <> 3 AND event_id % 7 <> 5"
    writers.jsonl(rows.where(f"event_id % 2 = 0 AND {good}"), at)
    writers.jsonl(rows.where(f"event_id % 2 = 1 AND {good}"), at, mode="append")
    text_ = F.to_json(F.struct(*rows.columns))
    bad = F.when(F.col("event_id") % 7 == 3, F.concat(text_, F.lit(" trailing"))).otherwise(F.concat(F.lit("["), text_, F.lit("]")))
    rows.where(f"NOT ({good})").select(bad).write.mode("append").text(at)
    rows.select(F.concat(F.lit('{"user_id": 1, "event_id": 9'), "event_id")).write.mode("append").text(at)  # torn
    return compaction.latest(readers.tolerant_jsonl(spark, at, rows.schema), "user_id", ["event_id"])


@query("""SELECT CASE event_id % 6 WHEN 0 THEN 'array' WHEN 1 THEN 'trailing' WHEN 2 THEN 'torn' WHEN 3 THEN 'scalar' WHEN 4 THEN 'blank' ELSE 'object' END AS kind, CASE WHEN event_id % 6 = 4 THEN 0 ELSE count(*) END AS lines, CASE WHEN event_id % 6 >= 4 THEN 0 ELSE count(*) END AS errors FROM events GROUP BY event_id % 6""")
def marked_lines(spark, d):
    """What each kind of line comes as; blank lines don't come."""
    at, e = workspace(spark), F.col("event_id")
    text_ = F.to_json(F.struct("event_id", "event_type"))
    kinds = ["array", "trailing", "torn", "scalar", "blank", "object"]
    line = F.element_at(F.array(F.concat(F.lit("["), text_, F.lit("]")), F.concat(text_, F.lit(" {}")), F.substring(text_, 1, 12), e.cast("string"), F.lit("  "), text_), (e % 6 + 1).cast("int"))
    t(spark, d, "events").withColumn("kind", F.element_at(F.array(*map(F.lit, kinds)), (e % 6 + 1).cast("int"))).select("kind", line.alias("value")).repartition(4, "kind").write.partitionBy("kind").text(at)
    parts = []
    for k in kinds:
        found = readers.json_lines(spark, f"{at}/kind={k}", "marked", part_bytes=1 << 16)
        parts.append(found.agg(F.count("*").alias("lines"), F.count("error").alias("errors")).select(F.lit(k).alias("kind"), "lines", "errors"))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("""SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 DESC, event_id) = 1""")
def latest_of_partitioned_logs(spark, d):
    """The last record of each user over three logs, by file and place; each log has its records from the last to the first."""
    rows, at = t(spark, d, "events").select("user_id", "event_id", "event_type"), workspace(spark)
    for k in range(3):
        rows.where(F.col("event_id") % 3 == k).coalesce(1).sortWithinPartitions(F.desc("event_id")).write.json(f"{at}/log-{k}")
    logs = readers.partitioned_log(spark, f"{at}/log-*", rows.schema)
    return compaction.latest(logs, "user_id", ["file_path", "offset"]).select(*rows.columns)


@query("""SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part""")
def csv_round_trip(spark, d):
    rows, at = t(spark, d, "part"), workspace(spark)
    fields = ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"]
    writers.csv(rows, at, fields)
    typed = readers.csv(spark, at, rows.select(*fields).schema)
    plain = readers.csv_strings(spark, at, fields)
    return typed.join(plain.select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("p_name").alias("again")), "p_partkey").where("again = p_name").drop("again")


@query("""SELECT p_partkey::varchar AS p_partkey, p_name, NULL::varchar AS s_suppkey FROM part UNION ALL SELECT NULL, NULL, s_suppkey::varchar FROM supplier""")
def csv_of_unlike_tables(spark, d):
    at = workspace(spark)
    names = writers.csv_union([t(spark, d, "part").select("p_partkey", "p_name"), t(spark, d, "supplier").select("s_suppkey")], at)
    return readers.csv_strings(spark, at, names)


@query("""SELECT 'corpus' AS dataset, role AS split, count(*) AS n, count(*) AS all_n FROM conversations GROUP BY ALL""")
def files_by_split(spark, d):
    rows, at = t(spark, d, "conversations").withColumn("split", F.col("role")), workspace(spark)
    writers.by_split(rows, at)
    schema = rows.drop("split").schema
    found = readers.split_sources(spark, {("corpus", s): f"{at}/split/split={s}" for s in ("user", "assistant", "system", "missing")}, schema)
    whole = readers.strict_jsonl(spark, f"{at}/all", rows.schema).groupBy("split").agg(F.count("*").alias("all_n"))
    return found.groupBy("dataset", "split").agg(F.count("*").alias("n")).join(whole, "split").select("dataset", "split", "n", "all_n")


@query("""SELECT item_id, text, NULL::varchar AS error FROM benchmark UNION ALL SELECT NULL, NULL, 'not JSON ' || item_id FROM benchmark WHERE item_id % 4 = 3""")
def wrapped_json_records(spark, d):
    """Files of three shapes, an object that wraps its records, an array, and lines, of which some are no JSON."""
    rows, at = t(spark, d, "benchmark"), workspace(spark)
    one = F.to_json(F.struct("item_id", "text"))
    shape = lambda g: rows.where(F.col("item_id") % 3 == g)
    shape(0).agg(F.to_json(F.struct(F.lit("x").alias("name"), F.collect_list(F.struct("item_id", "text")).alias("records")))).write.text(f"{at}/wrapped")
    shape(1).agg(F.to_json(F.collect_list(F.struct("item_id", "text")))).write.text(f"{at}/array")
    shape(2).select(one).write.text(f"{at}/lines")
    rows.where("item_id % 4 = 3").select(F.concat(F.lit("not JSON "), "item_id").alias("value")).write.mode("append").text(f"{at}/lines")
    found = readers.json_records(spark, f"{at}/*/*.txt")
    read = found.select(F.from_json("record", rows.schema).alias("r"), "error").select("r.item_id", "r.text", "error")
    # the message names the line; which it is depends on how the rows were dealt to files
    broken = read.where("error is not null").agg(F.count("*").alias("n")).join(rows.where("item_id % 4 = 3").select(F.concat(F.lit("not JSON "), "item_id").alias("error")))
    return read.where("error is null").unionByName(broken.where(F.col("n") == rows.where("item_id % 4 = 3").count()).select(F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("string").alias("text"), "error"))


@query(r"""SELECT conv_id // 16 AS file, trim(regexp_replace(string_agg(text, ' ' ORDER BY conv_id, turn), '\s+', ' ', 'g')) AS text, length(trim(regexp_replace(string_agg(text, ' ' ORDER BY conv_id, turn), '\s+', ' ', 'g'))) AS chars FROM conversations GROUP BY 1""")
def whole_text_files(spark, d):
    rows, at = t(spark, d, "conversations").withColumn("file", F.expr("conv_id div 16")), workspace(spark)
    lines = F.array_sort(F.collect_list(F.struct("conv_id", "turn", "text")))
    rows.groupBy("file").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("value")).write.partitionBy("file").text(at)
    found = readers.text_files(spark, f"{at}/*/*.txt")
    return found.select(F.regexp_extract("path", r"file=(\d+)/", 1).cast("long").alias("file"), "text", F.length("text").alias("chars"))


_PATHS = """paths AS (SELECT '/corpus/' || CASE doc_id % 3 WHEN 0 THEN 'documents/' WHEN 1 THEN 'annotations/aggregated/participants/' ELSE 'annotations/individual/outcomes/' END
|| CASE doc_id % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'test' WHEN 2 THEN 'valid' ELSE 'other' END || '/' || (doc_id % 50) || CASE WHEN doc_id % 2 = 0 THEN '.text' ELSE '.tokens' END AS path, doc_id FROM documents)"""


def _paths(spark, d):
    i = F.col("doc_id")
    kind = F.when(i % 3 == 0, "documents/").when(i % 3 == 1, "annotations/aggregated/participants/").otherwise("annotations/individual/outcomes/")
    split = F.when(i % 4 == 0, "train").when(i % 4 == 1, "test").when(i % 4 == 2, "valid").otherwise("other")
    return t(spark, d, "documents").select(F.concat(F.lit("/corpus/"), kind, split, F.lit("/"), (i % 50).cast("string"), F.when(i % 2 == 0, ".text").otherwise(".tokens")).alias("path"), "doc_id")


@query(f"""WITH {_PATHS} SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'test' WHEN 2 THEN 'dev' ELSE 'unspecified' END AS split, CASE doc_id % 3 WHEN 1 THEN 'PIO:Participant' WHEN 2 THEN 'PIO:Outcome' END AS element,
doc_id % 3 <> 0 AS annotation, doc_id % 3 = 1 AS aggregated, (doc_id % 50)::varchar AS id FROM paths""")
def path_rules(spark, d):
    p = F.col("path")
    return _paths(spark, d).select("doc_id", text.split_of_path(p, "unspecified").alias("split"), text.element_of_path(p, "PIO:").alias("element"), text.is_annotation_path(p).alias("annotation"), text.has_all_parts(p, ["annotations", "aggregated"]).alias("aggregated"), text.leading_id(F.regexp_extract(p, "([^/]*)$", 1)).alias("id"))


@query(f"""WITH {_PATHS}, own AS (SELECT *, (doc_id % 50)::varchar AS id FROM paths), docs AS (SELECT id, path FROM own WHERE doc_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY (CASE WHEN path LIKE '%.text' THEN 20 ELSE 10 END) DESC, path DESC) = 1),
ann AS (SELECT id, count(*) AS annotations, list_sort(list_distinct(list(CASE doc_id % 3 WHEN 1 THEN 'Participant' ELSE 'Outcome' END))) AS labels FROM own WHERE doc_id % 3 <> 0 GROUP BY 1),
best AS (SELECT id, path AS annotation FROM own WHERE doc_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY contains(path, 'aggregated') DESC, doc_id DESC) = 1)
SELECT docs.id, docs.path, coalesce(annotations, 0) AS annotations, array_to_string(labels, '|') AS labels, annotation FROM docs LEFT JOIN ann USING (id) LEFT JOIN best USING (id)""")
def documents_with_annotations(spark, d):
    files = _paths(spark, d)
    id_ = text.leading_id(F.regexp_extract("path", "([^/]*)$", 1))
    ann = corpus.annotation_index(files, id_, text.element_of_path(F.col("path")))
    best = corpus.preferred_annotations(files, id_, "doc_id").select("id", F.col("path").alias("annotation"))
    docs = corpus.unique_documents(files, id_)
    return docs.join(ann, "id", "left").join(best, "id", "left").select("id", "path", F.coalesce("annotations", F.lit(0)).alias("annotations"), nested.joined_set(F.col("labels")).alias("labels"), "annotation")


_SENTENCES = r"""sent AS (SELECT conv_id, turn, text, role, regexp_extract(text, '^(\S+)', 1) AS w FROM conversations),
e AS (SELECT conv_id, turn, role, w FROM sent WHERE w <> '')"""


def _sentences(spark, d):
    w = F.regexp_extract("text", r"^(\S+)", 1)
    none = lambda a: F.filter(a, lambda _: F.lit(False))
    ents = F.array(F.struct(w.alias("text"), F.col("role").alias("type")))
    rels = F.array(F.struct(w.alias("head"), F.concat(F.lit("says-"), "role").alias("type")))
    c = t(spark, d, "conversations")
    return c.select("conv_id", "turn", "text", F.when(w != "", ents).otherwise(none(ents)).alias("entities"), F.when((w != "") & (F.col("role") != "system"), rels).otherwise(none(rels)).alias("relations"))


@query(f"""WITH {_SENTENCES}, x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM sent)
SELECT conv_id, count(*) AS sentences, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) FILTER (w <> '') AS entities, array_to_string(list(i ORDER BY turn) FILTER (w <> ''), ',') AS entity_sentences,
coalesce(array_to_string(list_sort(list_distinct(list('says-' || role) FILTER (w <> '' AND role <> 'system'))), '|'), '') AS relation_types FROM x GROUP BY 1""")
def documents_of_sentences(spark, d):
    q = corpus.documents_of_sentences(_sentences(spark, d), "conv_id", "turn")
    at = F.array_join(F.transform("entities", lambda e: e["sentence_index"].cast("string")), ",")
    return q.select("conv_id", "sentences", "text", F.size("entities").cast("long").alias("entities"), at.alias("entity_sentences"), F.array_join("relation_types", "|").alias("relation_types"))


@query(f"""WITH {_SENTENCES}, l AS (SELECT conv_id % 4 AS part, 'entity:' || role AS label FROM e UNION ALL SELECT conv_id % 4, 'relation:says-' || role FROM e WHERE role <> 'system') SELECT part, label, count(*) AS n FROM l GROUP BY ALL""")
def annotation_label_counts(spark, d):
    return corpus.label_counts(_sentences(spark, d).withColumn("part", F.col("conv_id") % 4), ["part"])


@query(f"""WITH {_SENTENCES} SELECT conv_id % 4 AS part, count(*) AS records, sum(length(text))::bigint AS characters, count(*) FILTER (w <> '') AS entities, count(*) FILTER (w <> '' AND role <> 'system') AS relations FROM sent GROUP BY 1""")
def record_summary(spark, d):
    return corpus.record_summary(_sentences(spark, d).withColumn("part", F.col("conv_id") % 4), ["part"])


@query(r"""WITH w AS (SELECT conv_id, turn, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM conversations), e AS (SELECT conv_id, turn, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS x FROM w),
o AS (SELECT *, length(x) % 3 AS v, coalesce(sum(length(x) + 1) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM e),
c AS (SELECT *, CASE WHEN v IS DISTINCT FROM lag(v) OVER (PARTITION BY conv_id, turn ORDER BY i) THEN 1 ELSE 0 END AS new FROM o), r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run FROM c)
SELECT conv_id, turn, 'E' || lpad((row_number() OVER (PARTITION BY conv_id, turn ORDER BY min(i)))::varchar, 4, '0') AS id, min(i)::int AS start_token, max(i)::int AS end_token, min(s)::int AS start_char, max(s + length(x))::int AS end_char, string_agg(x, ' ' ORDER BY i) AS text FROM r WHERE v <> 0 GROUP BY conv_id, turn, run""")
def label_spans(spark, d):
    w = F.split(text.normal_space(F.col("text")), " ")
    rows = t(spark, d, "conversations").select("conv_id", "turn", w.alias("tokens")).withColumn("labels", F.transform("tokens", lambda x: F.length(x) % 3))
    return sampling.spans(rows, ["conv_id", "turn"], "labels", "tokens", F.lit("X")).drop("type")


@query(r"""WITH w AS (SELECT conv_id, turn, role, text, len(string_split(text, ' ')) AS n FROM conversations)
SELECT conv_id, turn, (n + 2)::bigint AS entities, 'L' || role || '|' || role AS labels, trim(regexp_replace(text, '\s+', ' ', 'g')) AS body, 'c' || conv_id AS id FROM w""")
def free_form_json(spark, d):
    c = t(spark, d, "conversations")
    words = F.split("text", " ")
    inner = F.to_json(F.struct(F.transform(words, lambda x: F.struct(x.alias("text"))).alias("entities")))  # JSON within JSON
    lists = F.array(F.array(F.lit("0"), F.lit("1"), F.concat(F.lit("L"), "role")), F.array(F.lit("x")))
    raw = F.to_json(F.struct(F.struct(F.concat(F.lit("c"), "conv_id").alias("id"), F.col("text").alias("abstract")).alias("data"), inner.alias("output"), F.array(F.struct(lists.alias("entities"))).alias("spans"), F.struct(lists.alias("ner"), F.col("role").alias("type")).alias("gold")))
    rows = c.select("conv_id", "turn", raw.alias("raw"))
    n = nested.count_named(F.col("raw"), ["entities"]) - 2  # 3 + 1 items of the lists
    labels = F.array_join(F.array_sort(nested.collect_labels(F.col("raw"), ["gold"])), "|")
    return rows.select("conv_id", "turn", n.alias("entities"), labels.alias("labels"), nested.record_text(F.col("raw")).alias("body"), nested.record_id(F.get_json_object("raw", "$.data")).alias("id"))


_TYPES, _RELS = ["Task", "Method"], ["Used-for"]
_MAIN, _ABLATION = ["P1", "P2", "P3", "P4", "P5", "P6"], ["A2", "A3", "A4", "A5", "A6"]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# the conditions are written out here, not taken from the table that the query reads
_JOBS = f"""WITH rec AS (SELECT 'd' || conv_id % 2 AS dataset, conv_id || '-' || turn AS record_id, text, sha256(conv_id || '-' || turn) AS h FROM conversations),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY length(text), h) AS r, count(*) OVER (PARTITION BY dataset) AS n FROM rec),
strata AS (SELECT *, CASE WHEN r <= round_even(n / 4, 0) THEN 0 WHEN r <= round_even(n / 2, 0) THEN 1 WHEN r <= round_even(n * 3 / 4, 0) THEN 2 ELSE 3 END AS s FROM ranked),
sample AS (SELECT dataset, record_id FROM strata QUALIFY row_number() OVER (PARTITION BY dataset, s ORDER BY h) <= 2),
pool AS (SELECT 'd' || item_id % 2 AS dataset, text, sha256(item_id::varchar) AS h FROM benchmark QUALIFY row_number() OVER (PARTITION BY 'd' || item_id % 2 ORDER BY length(text), sha256(item_id::varchar)) <= 10),
chosen AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY h) AS k FROM pool QUALIFY k <= 3),
shown AS (SELECT dataset, k, 'Example ' || k || chr(10) || 'Text: ' || text || chr(10) || 'Answer: {{"entities":[{{"text":"' || regexp_extract(text, '^\\S+') || '","type":"Task"}}],"relations":[]}}' AS demo FROM chosen),
demos AS (SELECT dataset, string_agg(demo, chr(10) || chr(10) ORDER BY k) AS demos, any_value(demo) FILTER (k = 1) AS demo FROM shown GROUP BY 1),
b AS (SELECT 'Find the entities that the text below states. Types: Task, Method. Relations: Used-for.' AS task, {_quoted(prompts.BLOCKS["format"])} AS form, {_quoted(prompts.BLOCKS["grounding"])} AS ground,
 {_quoted(prompts.BLOCKS["negative"])} AS neg, {_quoted(prompts.BLOCKS["reminders"])} AS again,
 'Schema: {{"entities":[{{"text":"a span of the text","type":"Task | Method"}}],"relations":[{{"head":"an entity''s text","type":"Used-for","tail":"an entity''s text"}}]}}' AS shape,
 'Types:' || chr(10) || '- Task: what is to be done' || chr(10) || '- Method: how it is done' || chr(10) || 'Relations: Used-for' AS defs,
 'Answer with JSON only: spans copied from the text, nothing guessed. Types: Task, Method. Relations: Used-for. Check spans, types, ends of relations and the JSON.' AS brief),
long AS (SELECT rec.*, b.*, d.demo, d.demos, 'Text: ' || text AS inp, concat_ws(chr(10), task, form, ground, defs, neg, again, demos, shape, 'Text: ' || text) AS p6 FROM rec JOIN demos d USING (dataset), b),
main AS (SELECT dataset, record_id, text, 'main' AS phase, unnest([{{'c': 'P1', 'p': concat_ws(chr(10), task, shape, inp)}}, {{'c': 'P2', 'p': concat_ws(chr(10), task, form, shape, inp)}},
 {{'c': 'P3', 'p': concat_ws(chr(10), task, form, ground, shape, inp)}}, {{'c': 'P4', 'p': concat_ws(chr(10), task, form, ground, demo, shape, inp)}},
 {{'c': 'P5', 'p': concat_ws(chr(10), task, form, ground, defs, demos, shape, inp)}}, {{'c': 'P6', 'p': p6}}]) AS x FROM long),
more AS (SELECT dataset, record_id, text, 'ablation' AS phase, unnest([{{'c': 'A2', 'p': concat_ws(chr(10), task, form, ground, demos, shape, inp)}}, {{'c': 'A3', 'p': concat_ws(chr(10), task, form, ground, defs, shape, inp)}},
 {{'c': 'A4', 'p': concat_ws(chr(10), task, form, ground, neg, shape, inp)}},
 {{'c': 'A5', 'p': concat_ws(chr(10), list_reduce(list_prepend(concat_ws(chr(10), task, form, ground), flatten(list_transform(range(400), lambda i: [{", ".join(map(_quoted, prompts.RULES))}]))),
   lambda acc, x: CASE WHEN length(acc) >= greatest(length(p6) - length(text), 1) THEN acc ELSE acc || chr(10) || x END), shape, inp)}},
 {{'c': 'A6', 'p': concat_ws(chr(10), brief, defs, neg, demos, shape, inp)}}]) AS x FROM long SEMI JOIN sample USING (dataset, record_id)),
j AS (SELECT 'm' || m AS model_id, dataset, record_id, phase, x.c AS condition, CASE dataset WHEN 'd0' THEN 768 ELSE 2048 END::int AS max_new_tokens, x.p AS prompt, text FROM (SELECT * FROM main UNION ALL SELECT * FROM more), range(3) r(m))"""


def job_records(spark, d):
    return t(spark, d, "conversations").select(F.concat(F.lit("d"), F.col("conv_id") % 2).alias("dataset"), F.lit("all").alias("split"), F.concat_ws("-", "conv_id", "turn").alias("record_id"), F.col("text").alias("input_text"))


def experiment(spark, d):
    """The job table over all eleven conditions, written with its checks."""
    records = job_records(spark, d)
    sized = records.select("dataset", "split", "record_id", F.length("input_text").alias("size"), F.sha2("record_id", 256).alias("h"))
    sample = sampling.quartile_sample(sized, ["dataset"], ["size"], "h", 8)
    train = t(spark, d, "benchmark").select(F.concat(F.lit("d"), F.col("item_id") % 2).alias("dataset"), F.col("text").alias("input_text"), F.length("text").alias("size"), F.sha2(F.col("item_id").cast("string"), 256).alias("h"))
    output = F.to_json(F.struct(F.array(F.struct(F.regexp_extract("input_text", r"^\S+", 0).alias("text"), F.lit("Task").alias("type"))).alias("entities"), F.expr("cast(array() as array<string>)").alias("relations")))
    chosen = sampling.demos(train, "size", "h", 10, 3, ["dataset"]).withColumn("output", output)
    shown = chosen.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("h", "input_text", "output"))).alias("demos"))
    phases = spark.createDataFrame([*[(c, "main") for c in _MAIN], *[(c, "ablation") for c in _ABLATION]], "condition string, phase string")
    conditions = phases.join(prompts.condition_table(spark), "condition")
    models = spark.createDataFrame([(f"m{i}",) for i in range(3)], "model_id string")
    caps = spark.createDataFrame([("d0", 768), ("d1", 2048)], "dataset string, max_new_tokens int")
    types, rels = (F.array(*map(F.lit, x)) for x in (_TYPES, _RELS))
    defs = F.array(*[F.struct(F.lit(a).alias("type"), F.lit(b).alias("meaning")) for a, b in (("Task", "what is to be done"), ("Method", "how it is done"))])
    values = {"task": prompts.task_text(types, rels), "compressed": prompts.compressed_text(types, rels), "schema": prompts.schema_text(types, rels), "definitions": prompts.definitions_text(defs, rels)}
    return corpus.experiment_jobs(records, sample, shown, conditions, models, caps, workspace(spark), values)


@query(_JOBS + """ SELECT substr(sha256(concat_ws('|', model_id, dataset, 'all', record_id, phase, condition)), 1, 24) AS job_id, dataset, record_id, model_id, phase, condition, max_new_tokens,
sha256(prompt) AS prompt_sha256, length(prompt) AS prompt_characters, length(text) AS input_characters FROM j""")
def job_table(spark, d):
    return experiment(spark, d).drop("split")


@query("""WITH j AS (SELECT doc_id, sha256(text) AS h, n_chars FROM documents), q AS (SELECT j.*, CASE WHEN l.doc_id IS NULL THEN 'MissingRecord' WHEN doc_id % 7 = 0 THEN 'PromptHashMismatch' WHEN n_chars + 900 > 4000 THEN 'ContextOverflow' END AS error_type FROM j LEFT JOIN labels l USING (doc_id))
SELECT coalesce(error_type, 'ok') AS outcome, count(*) AS n FROM q GROUP BY 1""")
def admitted_jobs(spark, d):
    jobs = t(spark, d, "documents").select(F.col("doc_id").alias("job_id"), "doc_id", "n_chars", "text", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("noted"), F.lit(900).alias("new"))
    found, missing = compaction.with_records(jobs, t(spark, d, "labels"), ["doc_id"])
    ok, bad = compaction.admitted(found, "text", "noted", "n_chars", "new", 4000)
    errors = missing.unionByName(bad).groupBy(F.col("error_type").alias("outcome")).agg(F.count("*").alias("n"))
    return errors.unionByName(ok.agg(F.count("*").alias("n")).select(F.lit("ok").alias("outcome"), "n"))


@query("""SELECT user_id || CASE WHEN k > 1 THEN '__' || k ELSE '' END AS id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)""")
def suffixed_ids(spark, d):
    q = compaction.suffixed_ids(t(spark, d, "events").select(F.col("user_id").alias("id"), "event_id"), "id", ["event_id"])
    return q.select("id", "event_id")


@query("""WITH a AS (SELECT doc_id, 'first' AS origin FROM documents WHERE doc_id % 3 = 0), b AS (SELECT doc_id, 'second' AS origin FROM documents WHERE doc_id % 2 = 0)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)""")
def preferred_union(spark, d):
    docs = t(spark, d, "documents").select("doc_id")
    a, b = docs.where("doc_id % 3 = 0").withColumn("origin", F.lit("first")), docs.where("doc_id % 2 = 0").withColumn("origin", F.lit("second"))
    mode, out = compaction.by_cardinality(a, b, ["doc_id"], 1 << 40)
    return out


@query("""SELECT doc_id FROM documents WHERE lang = 'en' UNION SELECT doc_id FROM labels WHERE toxic = 1""")
def distinct_union(spark, d):
    return t(spark, d, "documents").where("lang = 'en'").select("doc_id").union(t(spark, d, "labels").where("toxic = 1").select("doc_id")).distinct()


@query("""WITH a AS (SELECT p_partkey, p_brand FROM part), k AS (SELECT l_partkey, l_suppkey, l_linenumber FROM lineitem)
SELECT l_linenumber, count(*) AS n, count(coalesce(x.p_brand, y.p_brand)) AS found, min(coalesce(x.p_brand, y.p_brand)) AS least FROM k LEFT JOIN a x ON x.p_partkey = l_partkey * 2 LEFT JOIN a y ON x.p_partkey IS NULL AND y.p_partkey = l_suppkey GROUP BY 1""")
def joined_by_either_key(spark, d):
    k = t(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber")
    q = compaction.joined_by_either(k, t(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") * 2, F.col("l_suppkey"), "p_partkey")
    return q.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count("p_brand").alias("found"), F.min("p_brand").alias("least"))


@query("""WITH b AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, round(avg(q), 6) AS mean_of_means, round(max(q), 6) AS most, round(median(q), 6) AS middle FROM b GROUP BY 1""")
def mean_of_means(spark, d):
    b = t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_quantity").alias("q"))
    return b.groupBy("l_returnflag").agg(r6(F.avg("q")).alias("mean_of_means"), r6(F.max("q")).alias("most"), r6(F.median("q")).alias("middle"))


@query("""WITH e AS (SELECT e.label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::double AS x, vec_id FROM embeddings e), u AS (SELECT label, vec_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM e), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY 1, 2)
SELECT label, 'L' || label || ' · ' || 'label' AS caption, count(*) AS dims, round(sqrt(sum(x * x)), 6) AS length FROM m GROUP BY 1""")
def captioned_mean_lengths(spark, d):
    e = t(spark, d, "embeddings").select("label", F.posexplode(unit(F.col("embedding"))))
    m = e.groupBy("label", "pos").agg(F.avg("col").alias("x")).groupBy("label").agg(F.count("*").alias("dims"), r6(F.sqrt(F.sum(F.col("x") * F.col("x")))).alias("length"))
    return m.select("label", text.joined_label(F.concat(F.lit("L"), F.col("label").cast("string")), F.lit("label")).alias("caption"), "dims", "length")


@query("""SELECT doc_id, CASE lower(source) WHEN 'src0' THEN 'Zero' WHEN 'src1' THEN 'One' END AS canonical, lower(trim(regexp_replace(lang, '\\s+', ' ', 'g'))) AS folded FROM documents""".replace("\\\\", "\\"))
def canonical_labels(spark, d):
    return t(spark, d, "documents").select("doc_id", text.canonical(F.concat(F.substring("source", 1, 3), F.lit("_ "), F.substring("source", 4, 9)), {"src0": "Zero", "src1": "One"}).alias("canonical"), text.strict_fold_key(F.col("lang")).alias("folded"))


@query("""WITH g AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) SELECT lang, count(*) AS sources, min(n) AS least, max(n) AS most, max(n) > 1 AS repeated FROM g GROUP BY 1""")
def repeated_keys(spark, d):
    docs = t(spark, d, "documents")
    g = docs.groupBy("lang", "source").agg(F.count("*").alias("n"))
    twice = compaction.repeated_keys(docs, ["lang", "source"]).groupBy("lang").agg(F.count("*").alias("k"))
    q = g.groupBy("lang").agg(F.count("*").alias("sources"), F.min("n").alias("least"), F.max("n").alias("most")).alias("a").join(twice.alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang")), "left")
    return q.select("a.lang", "sources", "least", "most", F.col("k").isNotNull().alias("repeated"))


# Raw documents of the three shapes, from conversations: sentences of seven words, spans at their beginnings, some of which don't fit.
_WORDS_OF = r"list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '')"
_TOKENS = rf"""c AS (SELECT conv_id || '-' || turn AS record_id, {_WORDS_OF} AS w FROM conversations), u AS (SELECT *, len(w) AS n FROM c),
tok AS (SELECT record_id, n, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS x FROM u), o AS (SELECT *, coalesce(sum(length(x) + 1) OVER (PARTITION BY record_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::int AS s FROM tok),
sent AS (SELECT record_id, w, n, k FROM u, LATERAL (SELECT unnest(range((n + 6) // 7)) AS k)),
ent AS (SELECT record_id, w, n, k, 7 * k AS a, 7 * k + k % 3 AS b, 'T' || k % 2 AS type FROM sent),
fit AS (SELECT e.*, p.s AS start_char, q.s + length(q.x) AS end_char, array_to_string(w[a + 1 : b + 1], ' ') AS text FROM ent e JOIN o p ON p.record_id = e.record_id AND p.i = a JOIN o q ON q.record_id = e.record_id AND q.i = b)"""


def _token_sources(spark, d):
    words = F.filter(F.split(text.normal_space(F.col("text")), " "), lambda x: x != "")
    rows = t(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("record_id"), words.alias("w"))
    k = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 7).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    item = lambda i: F.concat(F.lit("["), (7 * i).cast("string"), F.lit(","), (7 * i + i % 3).cast("string"), F.lit(',"T'), (i % 2).cast("string"), F.lit('"]'))
    link = lambda i: F.concat(F.lit("["), (7 * i).cast("string"), F.lit(","), (7 * i + i % 3).cast("string"), F.lit(","), (7 * i + 7).cast("string"), F.lit(","), (7 * i + 7).cast("string"), F.lit(',"R"]'))
    listed = lambda f: F.concat(F.lit("["), F.array_join(F.transform(k, lambda i: F.concat(F.lit("["), f(i), F.lit("]"))), ","), F.lit("]"))
    sentences = F.to_json(F.transform(k, lambda i: F.slice("w", 7 * i + 1, 7)))
    raw = F.concat(F.lit('{"doc_key":"'), "record_id", F.lit('","sentences":'), F.when(F.size("w") > 0, sentences).otherwise(F.lit("[]")), F.lit(',"ner":'), listed(item), F.lit(',"relations":'), listed(link), F.lit(',"clusters":[[[0,0],[7,7]],[[-1,0]],3]}'))
    return rows.select("record_id", raw.alias("raw"))


@query(f"""WITH {_TOKENS},
e AS (SELECT record_id, string_agg(concat_ws(':', 'E' || lpad(k::varchar, 4, '0'), type, a, b, start_char, end_char, text), '|' ORDER BY k) AS entities, count(*) AS n FROM fit GROUP BY 1),
r AS (SELECT h.record_id, string_agg(concat_ws(':', 'R' || lpad(h.k::varchar, 4, '0'), 'E' || lpad(h.k::varchar, 4, '0'), CASE WHEN (h.k + 1) % 3 = 0 THEN 'E' || lpad((h.k + 1)::varchar, 4, '0') ELSE '-' END, h.text, p.x), '|' ORDER BY h.k) AS relations, count(*) AS n
 FROM fit h JOIN o p ON p.record_id = h.record_id AND p.i = 7 * h.k + 7 GROUP BY 1),
bad AS (SELECT record_id, count(*) FILTER (b >= n) + count(*) FILTER (b >= n OR 7 * k + 7 >= n) AS errors FROM ent GROUP BY 1)
SELECT u.record_id, u.n::int AS tokens, ((u.n + 6) // 7)::int AS sentences, sha256(array_to_string(w, ' ')) AS text_sha256, coalesce(e.entities, '') AS entities, coalesce(r.relations, '') AS relations, coalesce(e.n, 0)::int AS n_entities, coalesce(r.n, 0)::int AS n_relations,
CASE WHEN u.n = 0 THEN '' WHEN u.n <= 7 THEN w[1] ELSE w[1] || ',' || w[8] END AS clusters, coalesce(bad.errors, 0)::int AS errors
FROM u LEFT JOIN e USING (record_id) LEFT JOIN r USING (record_id) LEFT JOIN bad USING (record_id)""")
def normalised_documents_of_tokens(spark, d):
    r = normalise.token_documents(_token_sources(spark, d))
    shown = lambda e: F.concat_ws(":", e["id"], e["type"], *[e[c].cast("string") for c in ("start_token", "end_token", "start_char", "end_char")], e["text"])
    linked = lambda x: F.concat_ws(":", x["id"], F.coalesce(x["head_entity_id"], F.lit("-")), F.coalesce(x["tail_entity_id"], F.lit("-")), x["head"]["text"], x["tail"]["text"])
    return r.select("record_id", F.col("statistics.tokens").alias("tokens"), F.col("statistics.sentences").alias("sentences"), "text_sha256", F.array_join(F.transform("entities", shown), "|").alias("entities"), F.array_join(F.transform("relations", linked), "|").alias("relations"),
        F.col("statistics.entities").alias("n_entities"), F.col("statistics.relations").alias("n_relations"), F.array_join(F.transform(F.flatten("coreference_clusters"), lambda s: s["text"]), ",").alias("clusters"), F.size("errors").alias("errors"))


@query(f"""WITH {_TOKENS}, p AS (SELECT record_id, n, i, x, s, CASE WHEN n % 5 = 0 THEN 'bad' ELSE 'ok' END AS kind, length(x) % 3 AS v FROM o),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY record_id, v ORDER BY i) AS g FROM p WHERE kind = 'ok'), sp AS (SELECT record_id, min(i) AS a, max(i) AS b, min(s) AS start_char, max(s + length(x)) AS end_char, string_agg(x, ' ' ORDER BY i) AS text FROM runs WHERE v > 0 GROUP BY record_id, v, g),
el AS (SELECT record_id, 'Participant' AS type, a, b, start_char, end_char, text FROM sp UNION ALL SELECT record_id, 'Outcome', i, i, s, s + length(x), x FROM o WHERE i = 0),
e AS (SELECT record_id, string_agg(concat_ws(':', 'E' || lpad((k - 1)::varchar, 4, '0'), type, a, b, start_char, end_char, text), '|' ORDER BY k) AS entities, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY type DESC, a) AS k FROM el) GROUP BY 1)
SELECT record_id, CASE WHEN u.n = 0 THEN 'unspecified' WHEN u.n % 2 = 0 THEN 'test' ELSE 'train' END AS split, coalesce(e.entities, '') AS entities, coalesce(e.n, 0)::int AS n_entities, CASE WHEN u.n = 0 THEN '' WHEN u.n % 5 = 0 THEN 'Outcome' ELSE 'Participant|Outcome' END AS valid,
CASE WHEN u.n = 0 THEN 'empty token file' WHEN u.n % 5 = 0 THEN 'Participant label/token mismatch: labels=' || (u.n + 1) || ', tokens=' || u.n ELSE '' END AS errors FROM u LEFT JOIN e USING (record_id)""")
def normalised_documents_of_labels(spark, d):
    words = F.filter(F.split(text.normal_space(F.col("text")), " "), lambda x: x != "")
    docs = t(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("record_id"), words.alias("tokens"))
    marked = docs.where(F.size("tokens") > 0).withColumns({"split": F.when(F.size("tokens") % 2 == 0, "test").otherwise("train"), "n": F.size("tokens")})
    participants = F.transform("tokens", lambda x: F.length(x) % 3)
    one = marked.select("record_id", "split", F.lit("Participant").alias("element"), F.when(F.col("n") % 5 == 0, F.array_append(participants, F.lit(1))).otherwise(participants).alias("labels"))
    two = marked.select("record_id", "split", F.lit("Outcome").alias("element"), F.transform("tokens", lambda x, i: (i == 0).cast("int")).alias("labels"))
    other = marked.where("n % 2 = 0").select("record_id", F.lit("train").alias("split"), F.lit("Outcome").alias("element"), F.transform("tokens", lambda x: F.lit(1)).alias("labels"))  # test is preferred
    r = normalise.labelled_documents(docs, one.unionByName(two).unionByName(other), ["Participant", "Intervention", "Outcome"])
    shown = lambda e: F.concat_ws(":", e["id"], e["type"], *[e[c].cast("string") for c in ("start_token", "end_token", "start_char", "end_char")], e["text"])
    return r.select("record_id", "split", F.array_join(F.transform("entities", shown), "|").alias("entities"), F.size("entities").alias("n_entities"), F.array_join("annotation_status.valid_elements", "|").alias("valid"), F.array_join("errors", "|").alias("errors"))


@query(r"""WITH s AS (SELECT 'c' || conv_id AS doc, turn, role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
f AS (SELECT *, split_part(text, ' ', 1) AS w FROM s)
SELECT doc AS record_id, count(*)::int AS sentences, sha256(string_agg(text, chr(10) ORDER BY turn)) AS text_sha256, string_agg(concat_ws(':', 'E0000', 'Task', w, i, doc || '::sent_' || lpad(turn::varchar, 6, '0')), '|' ORDER BY turn) AS entities,
coalesce(string_agg(concat_ws(':', 'R0001', CASE WHEN turn % 2 = 0 THEN 'Used-for' ELSE 'Part-of' END, w, 'Task', w || ':x', 'Method', i), '|' ORDER BY turn) FILTER (role <> 'system'), '') AS relations,
array_to_string(list_sort(list_distinct(list(CASE WHEN turn % 2 = 0 THEN 'Used-for' ELSE 'Part-of' END) FILTER (role <> 'system'))), '|') AS relation_types FROM f GROUP BY doc""")
def normalised_documents_of_sentences(spark, d):
    c = t(spark, d, "conversations")
    w = F.split_part(text.normal_space(F.col("text")), F.lit(" "), F.lit(1))
    kind = F.when(F.col("turn") % 2 == 0, "Used-for").otherwise("Part-of")
    rel = F.array(F.array(F.lit("short"), F.lit("x")), F.array(F.concat(w, F.lit(":Task")), kind, F.concat(w, F.lit(":x:Method"))))
    shared = [F.concat(F.lit("c"), "conv_id").alias("doc_id"), F.col("text").alias("sentence"), F.array(F.array(w, F.lit("Task")), F.array(F.lit("alone"))).alias("ner")]
    raw = F.when(F.col("role") == "system", F.to_json(F.struct(*shared))).when(F.col("role") == "user", F.to_json(F.struct(*shared, rel.alias("rel_plus")))).otherwise(F.to_json(F.struct(*shared, rel.alias("rel"))))
    rows = c.select(F.lit("train").alias("split"), F.col("turn").cast("int").alias("row_index"), raw.alias("raw"))
    r = normalise.document_records(normalise.sentence_records(rows))
    entity = lambda e: F.concat_ws(":", e["id"], e["type"], e["text"], e["sentence_index"].cast("string"), e["source_record_id"])
    relation = lambda x: F.concat_ws(":", x["id"], x["type"], x["head"]["text"], x["head"]["type"], x["tail"]["text"], x["tail"]["type"], x["sentence_index"].cast("string"))
    return r.select("record_id", F.col("statistics.sentences").alias("sentences"), "text_sha256", F.array_join(F.transform("entities", entity), "|").alias("entities"), F.array_join(F.transform("relations", relation), "|").alias("relations"), F.array_join("relation_types", "|").alias("relation_types"))
