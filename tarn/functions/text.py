"""Text scalars, Column to Column. All stay within built-in expressions, but for strict case folding."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Unicode has it, with the separators \x1c-\x1f.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def normal_space(c: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def clean(c: Column) -> Column:
    """normal_space, null-safe. Values that count as nothing, false and the number 0, are empty; the strings "0" and "false" aren't."""
    number = F.rlike(F.typeof(c), F.lit("^(boolean|tinyint|smallint|int|bigint|float|double|decimal.*)$"))
    nothing = number & c.cast("string").isin("false", "0", "0.0", "-0.0")
    return F.when(nothing, F.lit("")).otherwise(normal_space(F.coalesce(c.cast("string"), F.lit(""))))


def fold_key(c: Column) -> Column:
    """A caseless key: lower case, with sharp s spelled out. Enough for most text, and in the JVM; strict_fold_key knows all of Unicode."""
    return F.replace(F.replace(F.lower(normal_space(c)), F.lit("ß"), F.lit("ss")), F.lit("ẞ"), F.lit("ss"))


@F.pandas_udf(StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.str.casefold()


def strict_fold_key(c: Column) -> Column:
    """A caseless key by Unicode's full case folding, which no built-in function has."""
    return _casefold(normal_space(c))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def short_id(*parts: Column, length: int = 24) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def seed32(*parts: Column) -> Column:
    """A 32-bit number that depends on the parts alone."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8), 16, 10).cast("long")


def words(c: Column) -> Column:
    return F.filter(F.split(normal_space(c), " "), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def sentence_count(c: Column, floor: int = 1) -> Column:
    """Parts after . ! ? and white space; blank ones don't count."""
    parts = F.filter(F.split(normal_space(c), r"(?<=[.!?])\s+"), lambda x: x != "")
    return F.greatest(F.lit(floor), F.size(parts))


def tokens(c: Column) -> Column:
    """The set of lower-cased Unicode word tokens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)"), 1))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def grounded(entity: Column, text: Column) -> Column:
    """Whether the folded text contains the folded entity; an empty entity is in nothing."""
    e = fold_key(entity)
    return (e != "") & F.contains(fold_key(text), e)


def typed_entity(c: Column) -> Column:
    """text:Type cut at the last colon; no colon, no type."""
    at = F.length(c) - F.locate(":", F.reverse(c)) + 1
    has = F.contains(c, F.lit(":"))
    return F.struct(F.when(has, c.substr(F.lit(1), at - 1)).otherwise(c).alias("text"), F.when(has, c.substr(at + 1, F.length(c))).alias("type"))


def leading_id(c: Column, digits: int = 1, anywhere: bool = False) -> Column:
    found = F.regexp_extract(c, rf"{'' if anywhere else '^'}(\d{{{digits},}})", 1)
    return F.nullif(found, F.lit(""))


def path_parts(path: Column, separators: str = "/") -> Column:
    """Lower-cased parts of a path."""
    return F.filter(F.split(F.lower(path), f"[{separators}]"), lambda x: x != "")


def _any_of(parts: Column, names: Sequence[str]) -> Column:
    return F.arrays_overlap(parts, F.array(*map(F.lit, names)))


def by_part(path: Column, rules: Sequence[tuple[Sequence[str], str]], other: str | None = None, separators: str = "/") -> Column:
    """The value of the first rule (names, value) of which the path has a part; else `other`."""
    parts = path_parts(path, separators)
    out = F.lit(other).cast("string")
    for names, value in reversed(rules):
        out = F.when(_any_of(parts, names), F.lit(value)).otherwise(out)
    return out


# Words of paths and what they stand for.
SPLITS = [(("test_ood",), "test_ood"), (("train", "training"), "train"), (("dev", "valid", "validation"), "dev"), (("test", "testing"), "test")]
ELEMENTS = [(("participants", "participant"), "Participant"), (("interventions", "intervention"), "Intervention"), (("outcomes", "outcome"), "Outcome")]
ANNOTATION_PARTS = ("annotations", "annotation", "aggregated", "individual", "starting_spans", "hierarchical_labels", "participants", "interventions", "outcomes")


def split_of_path(path: Column, other: str | None = None) -> Column:
    """train, dev, test or test_ood by a whole part of the path."""
    found = F.coalesce(by_part(path, SPLITS, None, r"/.\-"), by_part(path, SPLITS[1:], None, r"/_.\-"))
    return F.coalesce(found, F.lit(other)) if other else found


def element_of_path(path: Column, prefix: str = "") -> Column:
    """What a path's annotations are about, or null."""
    return by_part(path, [(names, prefix + value) for names, value in ELEMENTS])


def is_annotation_path(path: Column) -> Column:
    return _any_of(path_parts(path), ANNOTATION_PARTS)


def has_all_parts(path: Column, names: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, names)), path_parts(path))) == 0


def sums_before(sizes: Column, block: int = 64) -> Column:
    """Of an array of integers the sums of those before each. Arrays grow only within blocks, so that a long array isn't copied for each element."""

    def running(xs: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(xs, zero, lambda acc, x: F.struct((acc["at"] + x).cast("int").alias("at"), F.array_append(acc["all"], acc["at"]).alias("all")), lambda acc: acc["all"])

    total = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: (acc + x).cast("int"))
    starts = F.when(F.size(sizes) > 0, F.sequence(F.lit(1), F.size(sizes), F.lit(block))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda i: F.slice(sizes, i, block))
    return F.flatten(F.zip_with(F.transform(blocks, running), running(F.transform(blocks, total)), lambda xs, at: F.transform(xs, lambda x: x + at)))


def offsets(words_: Column) -> Column:
    """Character spans of tokens joined by single spaces."""
    sizes = F.transform(words_, lambda w: F.length(w) + 1)
    return F.zip_with(sums_before(sizes), words_, lambda at, w: F.struct(at.alias("start_char"), (at + F.length(w)).alias("end_char")))


def span_text(words_: Column, first: Column, last: Column) -> Column:
    """Tokens first to last, both included, or null where the span doesn't fit."""
    fits = (first >= 0) & (last >= first) & (last < F.size(words_))
    return F.when(fits, F.array_join(F.slice(words_, first + 1, F.greatest(last - first + 1, F.lit(0))), " "))


def padded(seed: Column, rules: Column, target: Column) -> Column:
    """seed with rules in turn appended, line by line, until it has the target length. Whole rounds come from their length, and only the
    rules of the last round are tried one by one."""
    n = F.size(rules)
    round_ = F.concat(F.lit("\n"), F.array_join(rules, "\n"))
    lacking = target - F.length(seed)
    whole = F.greatest(F.floor((lacking - 1) / F.greatest(F.length(round_), F.lit(1))), F.lit(0)).cast("int")
    start = F.concat(seed, F.repeat(round_, whole))
    step = lambda acc, x: F.when(F.length(acc) >= target, acc).otherwise(F.concat(acc, F.lit("\n"), x))
    return F.when(n > 0, F.aggregate(rules, start, step)).otherwise(seed)


def pretty_label(c: Column, names: dict[str, str] | None = None) -> Column:
    """A label for reading: given names, else underscores around it go and words get capitals."""
    known = F.create_map(*[F.lit(x) for kv in (names or {"": ""}).items() for x in kv])
    return F.coalesce(F.try_element_at(known, c), F.initcap(F.replace(F.regexp_replace(c, "^_+|_+$", ""), F.lit("_"), F.lit(" "))))


def joined_label(*parts: Column) -> Column:
    return F.concat_ws(" · ", *parts)


def canonical(value: Column, aliases: dict[str, str]) -> Column:
    """The name that a label's caseless key has in a list of aliases, or its key without all but letters and digits; else null."""
    known = F.create_map(*[F.lit(x) for kv in (aliases or {"\0": ""}).items() for x in kv])
    key = fold_key(F.coalesce(value, F.lit("")))
    return F.coalesce(F.try_element_at(known, key), F.try_element_at(known, F.regexp_replace(key, "[^a-z0-9]+", "")))


def utc_now() -> Column:
    """The query's time in UTC, ISO 8601."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
