"""Annotated corpora: roll-ups of sentences, label counts, audits, job tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions.nested import joined_set, split_set
from ..functions.text import is_annotation_path, normal_space, short_id, word_count
from ..sources.writers import checked
from .sampling import length_buckets
from .compaction import best_by, settled, small


def entity_ids(entities: DataFrame, keys: Sequence[str], relations: DataFrame, side: str) -> DataFrame:
    """relations (keys, side_start, side_end) with side_entity_id: the id of the first entity, by pos, that has the span, or null."""
    first = entities.groupBy(*keys, "start", "end").agg(F.min_by("id", "pos").alias(f"{side}_entity_id"))
    on = [F.col(f"r.{k}") == F.col(f"e.{k}") for k in keys] + [F.col(f"r.{side}_start") == F.col("e.start"), F.col(f"r.{side}_end") == F.col("e.end")]
    return relations.alias("r").join(first.alias("e"), on, "left").select("r.*", f"{side}_entity_id")


def label_counts(records: DataFrame, keys: Sequence[str], entities: str = "entities", relations: str = "relations") -> DataFrame:
    """(keys, label, n): occurrences of entity:type and relation:type in arrays of structs."""
    named = lambda c, kind: F.transform(c, lambda x: F.concat(F.lit(f"{kind}:"), x["type"]))
    return records.select(*keys, F.explode(F.concat(named(entities, "entity"), named(relations, "relation"))).alias("label")).groupBy(*keys, "label").agg(F.count("*").alias("n"))


def record_summary(records: DataFrame, keys: Sequence[str], text: str = "text", entities: str = "entities", relations: str = "relations") -> DataFrame:
    """records, characters, entities and relations by keys."""
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return records.groupBy(*keys).agg(F.count("*").alias("records"), total(F.length(text)).alias("characters"), total(F.greatest(F.size(entities), F.lit(0))).alias("entities"), total(F.greatest(F.size(relations), F.lit(0))).alias("relations"))


def documents_of_sentences(rows: DataFrame, key: str, order: str, text: str = "text", entities: str = "entities", relations: str = "relations", joint: str = "\n", drop_blank: bool = False) -> DataFrame:
    """Sentences (key, order, text, arrays of entity and relation structs with a type) as documents: sentences, text, entities and relations with
    their sentence_index, and the sorted distinct relation_types. A document's sentences meet in one row of it."""
    if drop_blank:
        rows = rows.where(F.trim(text) != "")
    doc = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"), F.col(entities).alias("e"), F.col(relations).alias("r")))).alias("s"))
    tagged = lambda part: F.flatten(F.transform("s", lambda s, i: F.transform(s[part], lambda x: x.withField("sentence_index", i))))
    out = doc.select(key, F.size("s").cast("long").alias("sentences"), F.array_join(F.transform("s", lambda s: s["t"]), joint).alias(text), tagged("e").alias(entities), tagged("r").alias(relations))
    return out.withColumn("relation_types", F.array_sort(F.array_distinct(F.transform(relations, lambda r: r["type"]))))


def annotation_index(files: DataFrame, id_: Column, label: Column) -> DataFrame:
    """(id, annotations, labels) of annotation files (path): how many, and their sorted labels."""
    own = files.where(is_annotation_path(F.col("path"))).select(id_.alias("id"), label.alias("label")).where("id is not null")
    return own.groupBy("id").agg(F.count("*").alias("annotations"), F.array_sort(F.collect_set("label")).alias("labels"))


def unique_documents(files: DataFrame, id_: Column) -> DataFrame:
    """(id, path): of document files the best one by id: below a documents folder, plain text before tokens, then few parts, then the last name."""
    path = F.lower("path")
    score = F.when(F.contains(path, F.lit("/documents/")), 100).otherwise(0) + F.when(path.endswith(".text"), 20).when(path.endswith(".tokens"), 10).otherwise(0)
    own = files.where(~is_annotation_path(F.col("path"))).select(id_.alias("id"), "path").where("id is not null")
    return best_by(own, ["id"], [score.alias("s"), (-F.size(F.split("path", "/"))).alias("d"), F.col("path").alias("p")])


def preferred_annotations(files: DataFrame, id_: Column, ordinal: str) -> DataFrame:
    """(id, path): of annotation files the one below an aggregated folder, then the last one."""
    own = files.where(is_annotation_path(F.col("path"))).select(id_.alias("id"), "path", ordinal).where("id is not null")
    return best_by(own, ["id"], [F.contains(F.lower("path"), F.lit("aggregated")).alias("a"), F.col(ordinal).alias("o")])


def audited(actual: DataFrame, expected: DataFrame, keys: Sequence[str], fail_below: float = 0.5) -> DataFrame:
    """(keys, check, expected, actual, status) of counts in long form (keys, check, value): PASS where they agree, FAIL where less than a share
    of what is expected is there, else WARN. Checks that nothing is expected of aren't listed."""
    met = expected.alias("e").join(actual.alias("a"), [F.col(f"e.{k}").eqNullSafe(F.col(f"a.{k}")) for k in (*keys, "check")], "left")
    n = F.coalesce("a.value", F.lit(0))
    status = F.when(n == F.col("e.value"), "PASS").when(n < F.col("e.value") * fail_below, "FAIL").otherwise("WARN")
    return met.select(*[F.col(f"e.{k}").alias(k) for k in keys], F.col("e.check").alias("check"), F.col("e.value").alias("expected"), n.alias("actual"), status.alias("status"))


def counted_checks(rows: DataFrame, keys: Sequence[str], checks: dict[str, Column]) -> DataFrame:
    """(keys, check, value): several aggregates in long form."""
    each = rows.groupBy(*keys).agg(*[c.cast("long").alias(n) for n, c in checks.items()])
    return each.unpivot([F.col(k) for k in keys], [F.col(n) for n in checks], "check", "value")


def manifest(records: DataFrame, keys: Sequence[str] = ("dataset", "split", "doc_id"), within: Sequence[str] = ("dataset",)) -> DataFrame:
    """records (keys, text, sentence_count, entity_count, relation_count, labels: an array) with char_count, word_count, text_sha256 (null where there is no text), eligible (1
    where there is text), label_types (sorted, joined by |) and length_bucket: short, medium or long by thirds of the eligible records' char_count, within a
    dataset; null for the others. Text is collapsed first; it isn't kept."""
    clean = normal_space(F.coalesce(F.col("text"), F.lit("")))
    rows = records.withColumn("text", clean).withColumns({
        "char_count": F.length("text"), "word_count": word_count(F.col("text")), "eligible": (F.col("text") != "").cast("int"), "text_sha256": F.when(F.col("text") != "", F.sha2("text", 256)),
        "label_types": joined_set(F.filter(F.coalesce("labels", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")),
    }).drop("text", "labels")
    rows = settled(rows)
    last = [c for c in keys if c not in within]
    kept = length_buckets(rows.where("eligible = 1"), "char_count", within, last[-1], "length_bucket")
    return kept.unionByName(rows.where("eligible = 0").withColumn("length_bucket", F.lit(None).cast("string")))


def manifest_summary(rows: DataFrame, keys: Sequence[str] = ("dataset", "split")) -> DataFrame:
    """Of a manifest by keys: documents, eligible, sentences, entities, relations over all; mean_chars (two digits), median_chars, min_chars and max_chars over the
    eligible ones, 0 where there is none."""
    n = F.when(F.col("eligible") == 1, F.col("char_count"))
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    sizes = {"mean_chars": F.bround(F.avg(n), 2), "median_chars": F.bround(F.median(n), 2), "min_chars": F.min(n), "max_chars": F.max(n)}
    return rows.groupBy(*keys).agg(F.count("*").alias("documents"), total("eligible").alias("eligible"), total("sentence_count").alias("sentences"), total("entity_count").alias("entities"), total("relation_count").alias("relations"), *[F.coalesce(c, F.lit(0)).alias(name) for name, c in sizes.items()])


def label_inventory(rows: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """(keys, label, documents_with_label) of a manifest."""
    return rows.select(*keys, F.explode(split_set(F.col("label_types"))).alias("label")).groupBy(*keys, "label").agg(F.count("*").alias("documents_with_label"))


def job_table(records: DataFrame, conditions: DataFrame, models: DataFrame, prompt: Column, keys: Sequence[str] = ("dataset", "split", "record_id")) -> DataFrame:
    """Every record under every condition (condition, phase, ...) and model (model_id, ...), with job_id, prompt_sha256 and the
    lengths. The two dimensions are small tables; their product with the records is the job table itself."""
    product = records.join(small(conditions.join(small(models))))
    made = product.withColumn("prompt", prompt)
    identity = [F.col("model_id"), *[F.col(k).cast("string") for k in keys], F.col("phase"), F.col("condition")]
    return made.withColumns({"job_id": short_id(*identity), "prompt_sha256": F.sha2("prompt", 256), "prompt_characters": F.length("prompt"), "input_characters": F.length("input_text")})


def experiment_jobs(records: DataFrame, sample: DataFrame, demos: DataFrame, conditions: DataFrame, models: DataFrame, caps: DataFrame, path: str, values: Mapping[str, Column], keys: Sequence[str] = ("dataset", "split", "record_id")) -> DataFrame:
    """The job table of an experiment, written to path: all records under the conditions of phase main and those of sample (keys) under
    the ones of phase ablation, for each model. conditions: prompts.condition_table with phase; demos: (dataset, demos), with demos an array of structs
    (input_text, output); caps: (dataset, max_new_tokens); values: what prompts are filled with, but for demo, demos and input.

    The numbers of records, of sampled ones and of jobs are checked while the table is written, and that no job_id repeats: else nothing is written."""
    conditions, demos, sample = settled(conditions), settled(demos), settled(sample.select(*keys).distinct())  # small, and read more than once
    of = {r.phase: r["count"] for r in conditions.groupBy("phase").count().collect()}
    m, main, some = models.count(), records.count(), records.join(small(sample), list(keys), "left_semi").count()
    with_dims = records.join(small(demos), "dataset", "left").join(small(caps), "dataset", "left")
    each = prompts.build_prompt(dict(values) | {"demo": prompts.demo_texts(F.col("demos"), 1), "demos": prompts.demo_texts(F.col("demos")), "input": F.concat(F.lit("Text: "), "input_text")}, F.col("input_text"))
    phase = lambda rows, name: job_table(rows, conditions.where(F.col("phase") == name), models, each, keys)
    both = phase(with_dims, "main").unionByName(phase(with_dims.join(small(sample), list(keys), "left_semi"), "ablation"))
    out = both.select("job_id", "model_id", *keys, "phase", "condition", "max_new_tokens", "prompt_sha256", "prompt_characters", "input_characters")
    count = lambda name: F.count_if(F.col("phase") == name)
    wanted = {"main": (count("main"), m * main * of.get("main", 0)), "ablation": (count("ablation"), m * some * of.get("ablation", 0)), "without_cap": (F.count_if(F.col("max_new_tokens").isNull()), 0)}
    return checked(out, path, wanted, ["job_id"])
