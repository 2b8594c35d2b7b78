"""Scalars over JSON text and arrays."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_FENCE = re.compile(r"^```(?:json)?\s*|\s*```$", re.I)


def found_object(text: str | None) -> tuple[dict | None, str | None]:
    """The first JSON object of a model's answer and its text: the whole answer without its code fence, else from the first brace on that
    opens one. Text that is nested too deep for the decoder holds none."""
    if not text or not text.strip():
        return None, None
    s = _FENCE.sub("", text.strip())
    decoder, at, whole = json.JSONDecoder(), -1, True
    while whole or at >= 0:
        try:
            value, end = (json.loads(s), len(s)) if whole else decoder.raw_decode(s, at)
            if isinstance(value, dict):
                return value, s[max(at, 0) : end]
        except (ValueError, RecursionError):
            pass
        whole, at = False, s.find("{", at + 1)
    return None, None


def _dumped(value) -> str | None:
    """JSON that parsers without NaN and infinity read: these become strings."""
    if value is None:
        return None
    try:
        return json.dumps(value, ensure_ascii=False, allow_nan=False)
    except ValueError:
        plain = lambda v: {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else [plain(x) for x in v] if isinstance(v, list) else repr(v) if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))) else v
        return json.dumps(plain(value), ensure_ascii=False)


def first_object(text: str | None) -> str | None:
    return _dumped(found_object(text)[0])


@F.pandas_udf(StringType())
def extract_object(texts: pd.Series) -> pd.Series:
    """first_object, strict as Python's decoder is: built-in parsers accept trailing text and refuse repeated keys."""
    return texts.map(first_object)


@F.pandas_udf(StructType([StructField("object", StringType()), StructField("source", StringType())]))
def extract_object_and_text(texts: pd.Series) -> pd.DataFrame:
    """As extract_object, with the part of the answer that the object was read from."""
    found = [found_object(t) for t in texts]
    return pd.DataFrame({"object": [_dumped(v) for v, _ in found], "source": [t for _, t in found]})


def _strings(v: str, array: str, field: str) -> str:
    return f"forall(try_cast(try_variant_get({v}, '$.{array}') as array<variant>), x -> coalesce(schema_of_variant(try_variant_get(x, '$.{field}')) = 'STRING', false))"


def validation(parsed: str) -> Column:
    """Flags of a parsed prediction, given by column name as JSON text: valid JSON object, the exact keys, and well-typed parts."""
    v = f"try_parse_json({parsed})"
    ok = f"coalesce(schema_of_variant({v}) like 'OBJECT%', false)"
    ent = f"coalesce({_strings(v, 'entities', 'text')} and {_strings(v, 'entities', 'type')}, false)"
    rel = f"coalesce({_strings(v, 'relations', 'head')} and {_strings(v, 'relations', 'type')} and {_strings(v, 'relations', 'tail')}, false)"
    keys = f"coalesce(array_sort(json_object_keys({parsed})) = array('entities', 'relations'), false)"
    return F.expr(f"named_struct('json_valid', {ok}, 'exact_keys', {keys}, 'entities_valid', {ent}, 'relations_valid', {rel}, 'schema_valid', {ok} and {keys} and {ent} and {rel})")


def flat_validation(parsed: str, keys: Sequence[str]) -> Column:
    """Flags of a flat object of lists, given by column name as JSON text: its exact keys, all of them lists, and the keys missing and too many."""
    found = F.coalesce(F.json_object_keys(F.col(parsed)), F.array().cast("array<string>"))
    want = F.array(*map(F.lit, keys))
    is_list = lambda k: F.coalesce(F.expr(f"schema_of_variant(try_variant_get(try_parse_json({parsed}), '$.{k}')) like 'ARRAY%'"), F.lit(False))
    lists = F.forall(F.array(*map(is_list, keys)), lambda x: x)
    valid = F.json_object_keys(F.col(parsed)).isNotNull()
    return F.struct(valid.alias("json_valid"), (valid & (F.size(F.array_except(want, found)) == 0) & (F.size(F.array_except(found, want)) == 0)).alias("exact_keys"), (valid & lists).alias("all_values_lists"), F.array_sort(F.array_except(want, found)).alias("missing_keys"), F.array_sort(F.array_except(found, want)).alias("extra_keys"))


def _folded(x: Column, field: str) -> Column:
    """A member's text as a caseless key; an absent one is empty, a null one reads none."""
    from .text import fold_key

    v = F.try_variant_get(x, f"$.{field}", "string")
    null = F.schema_of_variant(F.try_variant_get(x, f"$.{field}", "variant")) == "VOID"
    return fold_key(F.when(null, F.lit("none")).otherwise(F.coalesce(v, F.lit(""))))


def tuples(parsed: Column, array: str, fields: Sequence[str], inner: Sequence[str] = ()) -> Column:
    """Of JSON text, an array's objects as structs of caseless texts, in order and with repeats; what isn't an object or has a blank member
    goes. Members named in `inner` may be objects, whose text counts."""
    items = F.coalesce(F.try_variant_get(F.try_parse_json(parsed), f"$.{array}", "array<variant>"), F.array().cast("array<variant>"))
    objects = F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT"))

    def member(x, f):
        if f not in inner:
            return _folded(x, f)
        v = F.try_variant_get(x, f"$.{f}", "variant")
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), _folded(v, "text")).otherwise(_folded(x, f))

    made = F.transform(objects, lambda x: F.struct(*[member(x, f).alias(f) for f in fields]))
    return F.filter(made, lambda s: reduce(lambda a, f: a & (s[f] != ""), fields, F.lit(True)))


def entity_tuples(parsed: Column) -> Column:
    return tuples(parsed, "entities", ("text", "type"))


def relation_tuples(parsed: Column, gold: bool = False) -> Column:
    return tuples(parsed, "relations", ("head", "type", "tail"), ("head", "tail") if gold else ())


def relation_types(relations: str) -> Column:
    """An aggregate: the sorted distinct types of arrays of relations."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform(F.col(relations), lambda r: r["type"])))))


# Free-form objects whose keys the model chose: no schema to project, so plain functions over decoded JSON, by Arrow batches.

# The names under which parts of a relation or an entity are found, in order of preference.
RELATION_TYPE = ("type", "relation_type", "label", "predicate", "relation")
RELATION_HEAD = ("head", "source", "subject", "from", "arg1", "entity1", "head_text", "source_text")
RELATION_TAIL = ("tail", "target", "object", "to", "arg2", "entity2", "tail_text", "target_text")
RELATION_IGNORED = ("id", "relation_id", "confidence", "probability", "score")
ENTITY_TYPE = ("type", "entity_type", "label", "category")
ENTITY_TEXT = ("text", "span", "name", "value", "mention", "surface")
LABELS = ("type", "label", "relation", "relation_type", "entity_type", "category")
# Where a free-form record has its text, its id, its annotations and a record within it; texts and ids in order of preference.
TEXT_KEYS = ("text", "abstract", "content", "document", "article", "input", "sentences", "tokens", "paragraphs", "sections")
ID_KEYS = ("doc_id", "document_id", "paper_id", "pmid", "id", "doc_key", "filename")
ENTITY_KEYS = ("entities", "entity", "ner", "mentions", "spans")
RELATION_KEYS = ("relations", "relation", "rels")
OUTPUT_KEYS = ("output", "gold", "target", "answer", "annotations")
RECORD_KEYS = ("source", "example", "instance", "data", "payload")


def plain_text(value) -> str:
    """White space collapsed; what counts as nothing is empty."""
    return " ".join(str(value or "").split())


def first_value(row: dict, names: Sequence[str]) -> str:
    """The first of the named members that isn't empty."""
    return next((t for n in names if (t := plain_text(row.get(n)))), "")


def values_of(value) -> list[str]:
    """The texts of a scalar, an object or a list of either."""
    texts = (first_value(x, ENTITY_TEXT[:5]) if isinstance(x, dict) else plain_text(x) for x in (value if isinstance(value, list) else [value]))
    return [t for t in texts if t]


def relation_text(relation) -> str:
    """head --[type]--> tail; of a relation without these, its scalar members by name."""
    if not isinstance(relation, dict):
        return plain_text(relation)
    kind, head, tail = (first_value(relation, n) for n in (RELATION_TYPE, RELATION_HEAD, RELATION_TAIL))
    if kind or head or tail:
        return plain_text(f"{head} --[{kind or 'related_to'}]--> {tail}")
    scalars = {k: plain_text(v) for k, v in relation.items() if k not in RELATION_IGNORED and isinstance(v, str | int | float)}
    return " | ".join(f"{k}={scalars[k]}" for k in sorted(scalars) if scalars[k])


def canonical_name(value, aliases: dict[str, str]) -> str | None:
    key = plain_text(value).casefold()
    return aliases.get(key) or aliases.get(re.sub("[^a-z0-9]+", "", key))


def fields_of(parsed, names: Sequence[str], aliases: dict[str, str]) -> dict[str, list[str]]:
    """The texts of each field of a prediction, whichever of three shapes it has: a list by type, entities with their types, or
    entities as an object of lists; and relations, where `names` has __RELATIONS__. Caseless repeats go, the first form stays."""
    out: dict[str, list[str]] = {n: [] for n in names}
    if isinstance(parsed, dict):
        for key, value in parsed.items():
            name = canonical_name(key, aliases)
            if name in out:
                out[name] += values_of(value)
        entities = parsed.get("entities", [])
        if isinstance(entities, dict):
            entities = [{"type": k, "text": x} for k, v in entities.items() for x in (v if isinstance(v, list) else [v])]
        for e in entities if isinstance(entities, list) else []:
            if isinstance(e, dict) and (name := canonical_name(first_value(e, ENTITY_TYPE), aliases)) in out:
                out[name].append(first_value(e, ENTITY_TEXT))
        relations = parsed.get("relations", [])
        relations = list(relations.values()) if isinstance(relations, dict) else relations
        if "__RELATIONS__" in out and isinstance(relations, list):
            out["__RELATIONS__"] += map(relation_text, relations)
    for name, texts in out.items():
        kept: dict[str, str] = {}
        for t in texts:
            if t:
                kept.setdefault(t.casefold(), t)
        out[name] = [kept[k] for k in sorted(kept)]
    return out


def extract_fields(parsed: Column, names: Sequence[str], aliases: dict[str, str] | None = None) -> Column:
    """An array of (field, texts), one for each name, of predictions as JSON text. Without aliases a name stands for itself, caseless."""
    known = dict(aliases) if aliases else {n.casefold(): n for n in names if not n.startswith("__")}

    @F.pandas_udf("array<struct<field: string, texts: array<string>>>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                value = json.loads(t) if t else None
            except (ValueError, RecursionError):
                value = None
            return [{"field": k, "texts": v} for k, v in fields_of(value, names, known).items()]

        return texts.map(one)

    return run(parsed)


def _opened(value):
    """JSON that stands as a string within JSON."""
    if isinstance(value, str) and value.strip()[:1] in ("[", "{"):
        try:
            return json.loads(value)
        except (ValueError, RecursionError):
            return value
    return value


def _count(value) -> int:
    value = _opened(value)
    if isinstance(value, list):
        return sum(map(len, value)) if value and all(isinstance(x, list) for x in value) else len(value)
    return len(value) if isinstance(value, dict) else 0


def named_count(value, names: frozenset[str]) -> int:
    """How many items the members of the given names hold, at any depth; what lies within these isn't looked into."""
    total, open_ = 0, [value]
    while open_:
        value = _opened(open_.pop())
        if isinstance(value, dict):
            for k, v in value.items():
                if k.lower() in names:
                    total += _count(v)
                else:
                    open_.append(v)
        elif isinstance(value, list):
            open_ += value
    return total


def labels_within(value) -> set[str]:
    """Labels at any depth: members named as labels are, and the last string of lists of three or more."""
    found, open_ = set(), [value]
    while open_:
        value = _opened(open_.pop())
        if isinstance(value, dict):
            found |= {v.strip() for k in LABELS if isinstance(v := value.get(k), str)}
            open_ += value.values()
        elif isinstance(value, list):
            if len(value) >= 3 and isinstance(value[-1], str):
                found.add(value[-1].strip())
            open_ += value
    return found - {""}


def text_within(value, keys: Sequence[str], wrappers: Sequence[str]) -> str:
    """The text of a record: of its first text member by order of keys, else of a wrapper's."""

    def text(v) -> str:
        if isinstance(v, str):
            return v
        if isinstance(v, dict):
            return record(v)
        if isinstance(v, list):
            return " ".join(v) if all(isinstance(x, str) for x in v) else "\n".join(t for x in v if (t := text(x)))
        return ""

    def record(v) -> str:
        if not isinstance(v, dict):
            return " ".join(text(v).split())
        direct = next((t for k in keys if k in v and (t := text(v[k]))), "")
        return " ".join(direct.split()) or next((t for k in wrappers if k in v and (t := record(v[k]))), "")

    return record(value)


def id_within(value, keys: Sequence[str]) -> str | None:
    """The first scalar member by order of keys that isn't blank."""
    scalars = (value.get(k) for k in keys) if isinstance(value, dict) else ()
    return next((t for v in scalars if isinstance(v, str | int | float) and (t := str(v).strip())), None)


def over_json(function: Callable, kind: str) -> Callable[[Column], Column]:
    """A function of decoded JSON as one of JSON text, by Arrow batches; null where the text doesn't parse or is nested too deep."""

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return function(json.loads(t)) if t is not None else None
            except (ValueError, RecursionError):
                return None

        return texts.map(one)

    return run


def count_named(text: Column, names: Sequence[str]) -> Column:
    wanted = frozenset(names)
    return over_json(lambda v: named_count(v, wanted), "long")(text)


def collect_labels(text: Column, keys: Sequence[str] = (*ENTITY_KEYS, *RELATION_KEYS, *OUTPUT_KEYS)) -> Column:
    """Sorted labels below the given members of a record."""
    wanted = frozenset(keys)
    return over_json(lambda v: sorted(set().union(*[labels_within(x) for k, x in v.items() if k.lower() in wanted])) if isinstance(v := _opened(v), dict) else [], "array<string>")(text)


def record_text(text: Column, keys: Sequence[str] = TEXT_KEYS, wrappers: Sequence[str] = RECORD_KEYS) -> Column:
    """The text of a free-form record, white space collapsed: of its first member by order of keys that has one, else of a record within it."""
    return over_json(lambda v: text_within(v, keys, wrappers), "string")(text)


def record_id(text: Column, keys: Sequence[str] = ID_KEYS) -> Column:
    """Its first member by order of keys that is a scalar and not blank."""
    return over_json(lambda v: id_within(v, keys), "string")(text)


def flatten_once(nested: Column) -> Column:
    """The items of an array of variants' lists; what isn't a list goes."""
    return F.flatten(F.filter(F.transform(nested, lambda x: F.try_variant_get(x, "$", "array<variant>")), lambda x: x.isNotNull()))


def dedupe_caseless(items: Column) -> Column:
    """Items without later ones of the same caseless key, in the order of the keys: sorted by key and place, then one pass."""
    from .text import fold_key

    keyed = F.array_sort(F.transform(items, lambda x, i: F.struct(fold_key(x).alias("k"), i.alias("i"), x.alias("x"))))
    zero = F.struct(F.lit(None).cast("string").alias("k"), F.filter(items, lambda x: F.lit(False)).alias("kept"))
    step = lambda acc, s: F.struct(s["k"].alias("k"), F.when(acc["k"].eqNullSafe(s["k"]), acc["kept"]).otherwise(F.array_append(acc["kept"], s["x"])).alias("kept"))
    return F.aggregate(keyed, zero, step, lambda acc: acc["kept"])


def positive_lines(c: Column, tags: Sequence[str] = ("1", "B", "I", "B-P", "I-P", "B-I", "I-I", "B-O", "I-O")) -> Column:
    """How many lines have one of the tags among their parts."""
    marked = F.filter(F.split(c, r"\r?\n"), lambda line: F.arrays_overlap(F.split(F.trim(line), r"[\s,;]+"), F.array(*map(F.lit, tags))))
    return F.size(marked).cast("int")


def joined_set(c: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(c)), "|")


def split_set(c: Column) -> Column:
    return F.filter(F.split(c, r"\|"), lambda x: x != "")


def overridden(base: Column, **fields: Column) -> Column:
    """A struct with some of its fields replaced or added."""
    for name, value in fields.items():
        base = base.withField(name, value)
    return base


def labels_from_lines(c: Column) -> Column:
    """Integers of a text, one a line, as long; other lines are dropped."""
    whole = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: F.rlike(x, F.lit(r"^[+-]?\d+$")))
    return F.transform(whole, lambda x: x.cast("decimal(38,0)").cast("long"))


def binary_labels(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?<![\d.])([01])(?![\d.])"), 1), lambda x: x.cast("int"))


def positive_runs(labels: Column) -> Column:
    """How many runs of labels above 0 an array has."""
    return F.size(F.filter(F.transform(labels, lambda x, i: (x > 0) & ((i == 0) | (F.try_element_at(labels, i) <= 0))), lambda x: x))


def present(entities: Column, kind: Column) -> Column:
    """Whether an entity of that very type has a text that isn't blank."""
    return F.exists(entities, lambda e: (e["type"] == kind) & (F.trim(e["text"]) != "")).cast("int")
