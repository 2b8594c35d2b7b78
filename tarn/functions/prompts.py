"""Prompts from a table of blocks: a condition is rows (condition, seq, block), composed once to a template and filled in each record's row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import padded

#: Wording of our own. A block that isn't here depends on the record.
BLOCKS: dict[str, str] = {
    "format": "Answer with one JSON object and nothing else.\nIt has the keys of the schema, with empty lists where there is nothing.",
    "grounding": "Copy every span letter by letter from the text.\nLeave out what the text does not say.",
    "negative": "Wrong: spans that are not in the text; types of your own; remarks before or after the object.\nBefore you answer, see that each span occurs in the text and that the object parses.",
    "reminders": "Once more: each rule counts.\nCheck spans, types, relations and the JSON again.",
}
RULES = ["Do not guess.", "Do not explain.", "Do not change the spelling.", "Do not repeat an entity.", "Do not leave the schema."]

#: What each condition puts together, in order. demo is the first demonstration, demos are up to three of them, compressed states the
#: task and its rules at once, padded is PADDED with rules repeated until it has the length that LONGEST has without the input.
CONDITIONS: dict[str, list[str]] = {
    "P1": ["task", "schema", "input"],
    "P2": ["task", "format", "schema", "input"],
    "P3": ["task", "format", "grounding", "schema", "input"],
    "P4": ["task", "format", "grounding", "demo", "schema", "input"],
    "P5": ["task", "format", "grounding", "definitions", "demos", "schema", "input"],
    "P6": ["task", "format", "grounding", "definitions", "negative", "reminders", "demos", "schema", "input"],
    "A2": ["task", "format", "grounding", "demos", "schema", "input"],
    "A3": ["task", "format", "grounding", "definitions", "schema", "input"],
    "A4": ["task", "format", "grounding", "negative", "schema", "input"],
    "A5": ["padded", "schema", "input"],
    "A6": ["compressed", "definitions", "negative", "demos", "schema", "input"],
}
PADDED = ["task", "format", "grounding"]
LONGEST = "P6"


def block_rows(spark: SparkSession, conditions: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(condition, seq, block, template): template is null for what depends on the record."""
    rows = [(c, i, b, BLOCKS.get(b)) for c, blocks in (conditions or CONDITIONS).items() for i, b in enumerate(blocks)]
    return spark.createDataFrame(rows, "condition string, seq int, block string, template string")


def templates(blocks: DataFrame) -> DataFrame:
    """(condition, parts): parts are structs (block, text), in order; blocks of fixed text that stand together are one, of which block is null."""
    fixed = F.col("template").isNotNull()
    before = "sum(cast(template is null as int)) over (partition by condition order by seq)"
    runs = blocks.withColumn("run", F.expr(before)).groupBy("condition", "run", fixed.alias("fixed")).agg(
        F.min("seq").alias("seq"), F.expr("listagg(template, '\\n') within group (order by seq)").alias("text"), F.min(F.when(~fixed, F.col("block"))).alias("block")
    )
    return runs.groupBy("condition").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "block", "text"))), lambda p: F.struct(p["block"].alias("block"), p["text"].alias("text"))).alias("parts"))


def condition_table(spark: SparkSession, conditions: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(condition, parts, padded_parts, longest_parts): a row for each condition, the same last two in each."""
    known = dict(conditions or CONDITIONS)
    made = templates(block_rows(spark, known | {"_padded": PADDED, "_longest": known.get(LONGEST, CONDITIONS[LONGEST])}))
    only = lambda name, as_: made.where(F.col("condition") == name).select(F.col("parts").alias(as_))
    return made.where(F.col("condition").isin(*known)).join(F.broadcast(only("_padded", "padded_parts"))).join(F.broadcast(only("_longest", "longest_parts")))


def filled(parts: Column, values: Mapping[str, Column]) -> Column:
    """A template with the values of its blocks, line by line; a missing value is an empty line, an unknown block fails."""

    def text(p: Column) -> Column:
        value = F.raise_error(F.concat(F.lit("unknown block: "), p["block"])).cast("string")
        for name, c in values.items():
            value = F.when(p["block"] == name, F.coalesce(c, F.lit(""))).otherwise(value)
        return F.when(p["block"].isNull(), p["text"]).otherwise(value)

    return F.array_join(F.transform(parts, text), "\n")


def build_prompt(values: Mapping[str, Column], text: Column, parts: str = "parts") -> Column:
    """The prompt of a row with the columns of condition_table: its template with values (task, schema, definitions, demo, demos, compressed,
    input); text is the record's own, which padding doesn't count. Only what a template has is made. An unknown condition, without
    parts, fails."""
    target = F.greatest(F.length(filled(F.col("longest_parts"), values)) - F.length(text), F.lit(1))
    pad = padded(filled(F.col("padded_parts"), values), F.array(*map(F.lit, RULES)), target)
    missing = F.raise_error(F.concat(F.lit("unknown condition: "), F.coalesce(F.col("condition"), F.lit("null")))).cast("string")
    return F.when(F.col(parts).isNull(), missing).otherwise(filled(F.col(parts), dict(values) | {"padded": pad}))


def task_text(types: Column, relations: Column) -> Column:
    """What is asked for, by its types."""
    more = F.when(F.size(relations) > 0, F.concat(F.lit(" Relations: "), F.array_join(relations, ", "), F.lit("."))).otherwise(F.lit(" No relations."))
    return F.concat(F.lit("Find the entities that the text below states. Types: "), F.array_join(types, ", "), F.lit("."), more)


def compressed_text(types: Column, relations: Column) -> Column:
    """The task and all its rules in a paragraph."""
    none = F.when(F.size(relations) > 0, F.array_join(relations, ", ")).otherwise(F.lit("none"))
    return F.concat(F.lit("Answer with JSON only: spans copied from the text, nothing guessed. Types: "), F.array_join(types, ", "), F.lit(". Relations: "), none, F.lit(". Check spans, types, ends of relations and the JSON."))


def schema_text(types: Column, relations: Column) -> Column:
    """The shape of the answer, by its types; no relation types, no relations."""
    entity = F.struct(F.lit("a span of the text").alias("text"), F.array_join(types, " | ").alias("type"))
    relation = F.struct(F.lit("an entity's text").alias("head"), F.array_join(relations, " | ").alias("type"), F.lit("an entity's text").alias("tail"))
    none = F.filter(F.array(relation), lambda _: F.lit(False))
    return F.concat(F.lit("Schema: "), F.to_json(F.struct(F.array(entity).alias("entities"), F.when(F.size(relations) > 0, F.array(relation)).otherwise(none).alias("relations"))))


def definitions_text(definitions: Column, relations: Column) -> Column:
    """A line for each (type, meaning), and the relation types if there are any."""
    lines = F.transform(definitions, lambda d: F.concat(F.lit("- "), d["type"], F.lit(": "), d["meaning"]))
    allowed = F.when(F.size(relations) > 0, F.concat(F.lit("Relations: "), F.array_join(relations, ", ")))
    return F.concat_ws("\n", F.lit("Types:"), F.array_join(lines, "\n"), allowed)


def demo_text(demo: Column, number: Column) -> Column:
    """A demonstration with its output, JSON text or a struct, as compact JSON."""
    return F.concat(F.lit("Example "), number.cast("string"), F.lit("\nText: "), demo["input_text"], F.lit("\nAnswer: "), demo["output"])


def demo_texts(demos: Column, most: int = 3) -> Column:
    """Up to three demonstrations, numbered, with an empty line between them."""
    return F.array_join(F.transform(F.slice(demos, 1, most), lambda d, i: demo_text(d, i + 1)), "\n\n")
