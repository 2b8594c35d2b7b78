"""Annotated corpora of three shapes as one kind of record, each put together within its row.

A record has record_id, input_text, entities and relations as arrays of structs, statistics, text_sha256, and errors: what of its annotations didn't fit,
a side table by `errors_of`. Entities are numbered E0000 on and relations R0000 on by their place in the source, whether or not those before fit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

SPAN = "struct<start_token: int, end_token: int, start_char: int, end_char: int, text: string>"


def _items(value: Column, path: str = "$") -> Column:
    """An array of a variant's items; empty for what is no list."""
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.expr("cast(array() as array<variant>)"))


def _is_list(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))


def _whole(item: Column, i: int) -> Column:
    return F.try_variant_get(item, f"$[{i}]", "int")


def _text(item: Column, i: int) -> Column:
    return F.coalesce(F.try_variant_get(item, f"$[{i}]", "string"), F.lit("None"))


def _numbered(letter: str, i: Column) -> Column:
    return F.format_string(f"{letter}%04d", i)


def span(tokens: Column, offsets: Column, first: Column, last: Column) -> Column:
    """The struct SPAN of tokens first to last, both included; null where they don't fit."""
    made = F.struct(first.cast("int").alias("start_token"), last.cast("int").alias("end_token"), F.get(offsets, first)["start_char"].alias("start_char"), F.get(offsets, last)["end_char"].alias("end_char"), text.span_text(tokens, first, last).alias("text"))
    return F.when((first >= 0) & (last >= first) & (last < F.size(tokens)), made)


def _statistics(**counts: Column) -> Column:
    return F.struct(*[c.cast("int").alias(n) for n, c in counts.items()])


def token_documents(rows: DataFrame, raw: str = "raw", fallback: str = "record_id") -> DataFrame:
    """rows (raw: JSON text) with a record for each object with doc_key, sentences (lists of tokens), ner (by sentence, lists of [first, last, type] over the
    whole document's tokens), relations (by sentence, [first, last, first, last, type]) and clusters (lists of [first, last]).

    Adds record_id (doc_key, else what the column fallback holds), tokens, token_offsets, sentence_ranges, input_text (tokens by single spaces), entities, relations, with the
    ids of the first entities of their very spans, coreference_clusters, statistics, text_sha256 and errors. Members of other shapes are skipped; spans
    that don't fit are errors, in clusters they are left out, and so is a cluster without any."""
    v = F.try_parse_json(F.col(raw))
    first = rows.select("*", v.alias("_v")).withColumn("record_id", F.coalesce(F.try_variant_get("_v", "$.doc_key", "string"), F.col(fallback)))
    sentences = F.transform(_items(F.col("_v"), "$.sentences"), lambda s, i: F.struct(i.alias("i"), _is_list(s).alias("ok"), F.transform(_items(s), lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("None"))).alias("t")))
    r = first.withColumn("_s", F.filter(sentences, lambda s: s["ok"]))
    r = r.withColumn("tokens", F.flatten(F.transform("_s", lambda s: s["t"])))
    r = r.withColumns({"token_offsets": text.offsets(F.col("tokens")), "_b": text.sums_before(F.transform("_s", lambda s: F.size(s["t"]))), "input_text": F.array_join("tokens", " ")})
    r = r.withColumn("sentence_ranges", F.zip_with("_s", "_b", lambda s, b: F.struct(s["i"].alias("sentence_index"), b.alias("start_token"), (b + F.size(s["t"]) - 1).alias("end_token"))))
    of = lambda a, b: span(F.col("tokens"), F.col("token_offsets"), a, b)
    grouped = lambda path: F.flatten(F.transform(F.filter(_items(F.col("_v"), path), _is_list), lambda x: _items(x)))
    long_enough = lambda path, n: F.filter(F.transform(grouped(path), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: _is_list(p["x"]) & (F.size(_items(p["x"])) >= n))
    r = r.withColumn("_e", F.transform(long_enough("$.ner", 3), lambda p: F.struct(_numbered("E", p["i"]).alias("id"), _text(p["x"], 2).alias("type"), _whole(p["x"], 0).alias("a"), _whole(p["x"], 1).alias("b"), of(_whole(p["x"], 0), _whole(p["x"], 1)).alias("span"))))
    r = r.withColumn("_r", F.transform(long_enough("$.relations", 5), lambda p: F.struct(
        _numbered("R", p["i"]).alias("id"), _text(p["x"], 4).alias("type"), F.to_json(p["x"]).alias("raw"), of(_whole(p["x"], 0), _whole(p["x"], 1)).alias("head"), of(_whole(p["x"], 2), _whole(p["x"], 3)).alias("tail"))))
    same = lambda s: F.get(F.filter("entities", lambda e: (e["start_token"] == s["start_token"]) & (e["end_token"] == s["end_token"])), F.lit(0))["id"]
    fields = lambda s: [s[c].alias(c) for c in ("start_token", "end_token", "start_char", "end_char", "text")]
    r = r.withColumn("entities", F.transform(F.filter("_e", lambda e: e["span"].isNotNull()), lambda e: F.struct(e["id"].alias("id"), e["type"].alias("type"), *fields(e["span"]))))
    fit = lambda x: x["head"].isNotNull() & x["tail"].isNotNull()
    r = r.withColumn("relations", F.transform(F.filter("_r", fit), lambda x: F.struct(x["id"].alias("id"), x["type"].alias("type"), same(x["head"]).alias("head_entity_id"), same(x["tail"]).alias("tail_entity_id"), x["head"].alias("head"), x["tail"].alias("tail"))))
    mentions = lambda c: F.filter(F.transform(F.filter(_items(c), lambda m: _is_list(m) & (F.size(_items(m)) >= 2)), lambda m: of(_whole(m, 0), _whole(m, 1))), lambda s: s.isNotNull())
    r = r.withColumn("coreference_clusters", F.filter(F.transform(F.filter(_items(F.col("_v"), "$.clusters"), _is_list), mentions), lambda c: F.size(c) > 0))
    wrong_e = F.transform(F.filter("_e", lambda e: e["span"].isNull()), lambda e: F.concat(F.lit("invalid entity token span: "), F.coalesce(e["a"].cast("string"), F.lit("?")), F.lit("-"), F.coalesce(e["b"].cast("string"), F.lit("?"))))
    wrong_r = F.transform(F.filter("_r", lambda x: ~fit(x)), lambda x: F.concat(F.lit("invalid relation token span: "), x["raw"]))
    unread = F.when(F.coalesce(~F.schema_of_variant("_v").startswith("OBJECT"), F.lit(True)), F.array(F.lit("not an object"))).otherwise(F.array().cast("array<string>"))
    r = r.withColumns({
        "statistics": _statistics(characters=F.length("input_text"), tokens=F.size("tokens"), sentences=F.size("sentence_ranges"), entities=F.size("entities"), relations=F.size("relations")),
        "text_sha256": F.sha2("input_text", 256), "errors": F.concat(unread, wrong_e, wrong_r),
    })
    return r.drop("_v", "_s", "_b", "_e", "_r")


def _runs(labels: Column) -> Column:
    """Structs (a, b) of the first and last places of maximal runs of an equal label other than 0."""
    at = lambda i: F.coalesce(F.get(labels, i), F.lit(0))
    places = F.filter(F.transform(labels, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())
    first, last = F.filter(places, lambda i: at(i) != F.when(i > 0, at(i - 1)).otherwise(0)), F.filter(places, lambda i: at(i) != at(i + 1))
    return F.zip_with(first, last, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def labelled_documents(docs: DataFrame, annotations: DataFrame, elements: Sequence[str]) -> DataFrame:
    """A record for each of docs (record_id, tokens), from annotations (record_id, split, element, labels: an array with a label for each token): runs of an equal label
    other than 0 are entities of the element's type, numbered through the elements in their order.

    Adds split, input_text, token_offsets, entities, statistics, annotation_status (valid_elements, missing_or_invalid_elements, complete), text_sha256 and errors. The split is the only one that a document
    is annotated in, else test, else train, else unspecified. Labels that aren't as many as the tokens are an error and their element is invalid; an empty token at the end may be
    too many. A document without tokens isn't a record but an error, with null text."""
    by = annotations.groupBy("record_id", "split").agg(F.map_from_entries(F.collect_list(F.struct("element", "labels"))).alias("labels"))
    splits = by.groupBy("record_id").agg(F.collect_list(F.struct("split", "labels")).alias("s"))
    named = lambda n: F.get(F.filter("s", lambda x: x["split"] == n), F.lit(0))
    chosen = F.when(F.size("s") == 1, F.get("s", 0)).otherwise(F.coalesce(named("test"), named("train")))
    r = docs.join(splits, "record_id", "left").withColumn("_c", chosen).withColumns({"split": F.coalesce(F.col("_c.split"), F.lit("unspecified")), "_l": F.col("_c.labels")})
    short = F.exists(F.array(*[F.size(F.col("_l")[e]) for e in elements]), lambda n: n == F.size("tokens") - 1) & (F.get("tokens", F.size("tokens") - 1) == "")
    r = r.withColumn("tokens", F.when(F.coalesce(short, F.lit(False)), F.slice("tokens", 1, F.size("tokens") - 1)).otherwise(F.col("tokens")))
    r = r.withColumns({"token_offsets": text.offsets(F.col("tokens")), "input_text": F.when(F.size("tokens") > 0, F.array_join("tokens", " "))})
    fits = lambda e: F.coalesce(F.size(F.col("_l")[e]) == F.size("tokens"), F.lit(False)) & (F.size("tokens") > 0)
    found = lambda e: F.transform(_runs(F.col("_l")[e]), lambda x: F.struct(F.lit(e).alias("type"), span(F.col("tokens"), F.col("token_offsets"), x["a"], x["b"]).alias("s")))
    each = [F.when(fits(e), found(e)).otherwise(F.expr(f"cast(array() as array<struct<type: string, s: {SPAN}>>)")) for e in elements]
    fields = ("start_token", "end_token", "start_char", "end_char", "text")
    r = r.withColumn("entities", F.transform(F.concat(*each), lambda x, i: F.struct(_numbered("E", i).alias("id"), x["type"].alias("type"), *[x["s"][c].alias(c) for c in fields])))
    some = lambda cond: F.filter(F.array(*[F.when(cond(e), F.lit(e)) for e in elements]), lambda x: x.isNotNull())
    valid = some(fits)
    wrong = [F.when(F.col("_l")[e].isNotNull() & ~fits(e) & (F.size("tokens") > 0), F.concat(F.lit(f"{e} label/token mismatch: labels="), F.size(F.col("_l")[e]), F.lit(", tokens="), F.size("tokens"))) for e in elements]
    r = r.withColumns({
        "statistics": _statistics(characters=F.length("input_text"), tokens=F.size("tokens"), entities=F.size("entities")),
        "annotation_status": F.struct(valid.alias("valid_elements"), some(lambda e: ~fits(e)).alias("missing_or_invalid_elements"), (F.size(valid) == len(elements)).alias("complete")),
        "text_sha256": F.sha2("input_text", 256),
        "errors": F.filter(F.array(F.when(F.size("tokens") == 0, F.lit("empty token file")), *wrong), lambda x: x.isNotNull()),
    })
    return r.drop("s", "_c", "_l")


def _typed(c: Column) -> Column:
    """text:type as a struct of both, the type behind the last colon; without one no type."""
    cut = F.regexp_extract(c, r"(?s)^(.*):([^:]*)$", 1), F.regexp_extract(c, r"(?s)^(.*):([^:]*)$", 2)
    has = F.contains(c, F.lit(":"))
    return F.struct(F.when(has, cut[0]).otherwise(c).alias("text"), F.when(has, cut[1]).alias("type"))


def sentence_records(rows: DataFrame, raw: str = "raw", prefix: str = "document") -> DataFrame:
    """A record for each of rows (split, row_index, raw: JSON text) with doc_id, sentence, ner (lists of [text, type]) and rel_plus, or else rel (lists
    of ["text:type", relation, "text:type"]): record_id, document_id, input_text, entities, relations, statistics, text_sha256. Without a doc_id it is prefix_split_number."""
    r = rows.withColumn("_v", F.try_parse_json(F.col(raw)))
    r = r.withColumn("document_id", F.coalesce(F.try_variant_get("_v", "$.doc_id", "string"), F.format_string(f"{prefix}_%s_%06d", "split", "row_index")))
    r = r.withColumns({"record_id": F.format_string("%s::sent_%06d", "document_id", "row_index"), "input_text": text.normal_space(F.coalesce(F.try_variant_get("_v", "$.sentence", "string"), F.lit("")))})
    numbered = lambda items, n: F.filter(F.transform(items, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: _is_list(p["x"]) & (F.size(_items(p["x"])) >= n))
    entities = F.transform(numbered(_items(F.col("_v"), "$.ner"), 2), lambda p: F.struct(_numbered("E", p["i"]).alias("id"), _text(p["x"], 1).alias("type"), _text(p["x"], 0).alias("text")))
    rel = F.coalesce(F.try_variant_get("_v", "$.rel_plus", "array<variant>"), _items(F.col("_v"), "$.rel"))
    relations = F.transform(numbered(rel, 3), lambda p: F.struct(_numbered("R", p["i"]).alias("id"), _text(p["x"], 1).alias("type"), _typed(_text(p["x"], 0)).alias("head"), _typed(_text(p["x"], 2)).alias("tail")))
    r = r.withColumns({"entities": entities, "relations": relations})
    return r.withColumns({"statistics": _statistics(characters=F.length("input_text"), entities=F.size("entities"), relations=F.size("relations")), "text_sha256": F.sha2("input_text", 256)}).drop("_v")


def document_records(sentences: DataFrame) -> DataFrame:
    """Of sentence_records a record for each (split, document_id): sentences in order of row_index, input_text (one a line), entities and relations with sentence_index and
    source_record_id, the sorted distinct relation_types, statistics, text_sha256. A document's sentences meet in its row."""
    doc = sentences.groupBy("split", "document_id").agg(F.array_sort(F.collect_list(F.struct("row_index", "input_text", "record_id", "entities", "relations"))).alias("s"))
    tagged = lambda part: F.flatten(F.transform("s", lambda s, i: F.transform(s[part], lambda x: x.withField("sentence_index", i).withField("source_record_id", s["record_id"]))))
    r = doc.select("split", F.col("document_id").alias("record_id"), F.transform("s", lambda s: s["input_text"]).alias("sentences"), tagged("entities").alias("entities"), tagged("relations").alias("relations"))
    r = r.withColumns({"input_text": F.array_join("sentences", "\n"), "relation_types": F.array_sort(F.array_distinct(F.transform("relations", lambda x: x["type"])))})
    return r.withColumns({"statistics": _statistics(characters=F.length("input_text"), sentences=F.size("sentences"), entities=F.size("entities"), relations=F.size("relations")), "text_sha256": F.sha2("input_text", 256)})


def errors_of(records: DataFrame, *keys: str) -> DataFrame:
    """(keys, error): the side table of what didn't fit."""
    return records.select(*keys, F.explode("errors").alias("error"))
