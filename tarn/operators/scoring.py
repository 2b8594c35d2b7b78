"""Predictions against references: multiset and greedy partial matches."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import nested
from ..functions.text import fold_key, jaccard, tokens


def prf(tp: str, pred: str, gold: str) -> list[Column]:
    """precision, recall, f1; both sides empty are perfect, one empty side is 0."""
    p = F.when(F.col(pred) == 0, F.when(F.col(gold) == 0, 1.0).otherwise(0.0)).otherwise(F.col(tp) / F.col(pred))
    r = F.when(F.col(gold) == 0, F.when(F.col(pred) == 0, 1.0).otherwise(0.0)).otherwise(F.col(tp) / F.col(gold))
    f = F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return [p.alias("precision"), r.alias("recall"), f.alias("f1")]


def multiset_f1(pred: DataFrame, gold: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """By keys: tp = sum of the smaller count of each item, with precision, recall and f1. One tagged union, two grouped sums."""
    both = pred.select(*keys, item, F.lit(1).alias("p"), F.lit(0).alias("g")).unionByName(gold.select(*keys, item, F.lit(0).alias("p"), F.lit(1).alias("g")))
    counts = both.groupBy(*keys, item).agg(F.sum("p").alias("p"), F.sum("g").alias("g"))
    total = counts.groupBy(*keys).agg(F.sum(F.least("p", "g")).alias("tp"), F.sum("p").alias("predicted"), F.sum("g").alias("gold"))
    return total.select(*keys, "tp", "predicted", "gold", *prf("tp", "predicted", "gold"))


def greedy_matches(candidates: Column) -> Column:
    """How many one-to-one matches a greedy pass makes over structs (score, p, g), from the largest down."""
    zero = F.struct(F.array().cast("array<int>").alias("p"), F.array().cast("array<int>").alias("g"), F.lit(0).alias("n"))

    def step(acc, c):
        free = ~F.array_contains(acc["p"], c["p"]) & ~F.array_contains(acc["g"], c["g"])
        return F.when(free, F.struct(F.array_append(acc["p"], c["p"]).alias("p"), F.array_append(acc["g"], c["g"]).alias("g"), (acc["n"] + 1).alias("n"))).otherwise(acc)

    return F.aggregate(F.sort_array(candidates, asc=False), zero, step, lambda acc: acc["n"])


def _walked(name: str, threshold: float):
    """Of the rows (side, pos, type, words) of one key the greedy matches, as a row (key, tp). Rows of equal type and words are one class, so that classes
    are compared and not rows; from the largest score down, each prediction, by its place from the last, takes the last reference left of the classes that score so."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        places: tuple[dict, dict] = {}, {}
        for side, kind, words, pos in zip(rows["side"], rows["type"], rows["words"], rows["pos"]):
            places[side].setdefault((kind, words), []).append(pos)
        left, right = ({c: sorted(p) for c, p in side.items()} for side in places)
        holders: dict = {}  # of a word, or of none, the classes of references
        for c in right:
            for w in set(c[1].split(" ")):
                holders.setdefault((c[0], w), []).append(c)
        levels: dict[float, dict] = {}
        for c in left:
            own = set(c[1].split(" "))
            near = dict.fromkeys(x for w in own for x in holders.get((c[0], w), ())) if threshold > 0 else [x for x in right if x[0] == c[0]]
            for x in near:
                other = set(x[1].split(" "))
                both, none = own & other - {""}, not c[1] and not x[1]
                score = 1.0 if none else len(both) / len((own | other) - {""})
                if score >= threshold:
                    levels.setdefault(score, {}).setdefault(c, []).append(x)
        taken: tuple[set, set] = set(), set()
        for score in sorted(levels, reverse=True):
            stacks = {x: right[x].copy() for xs in levels[score].values() for x in xs}
            at: dict = {}
            for c in levels[score]:
                for p in left[c]:
                    if p not in taken[0]:
                        at.setdefault(p, []).append(c)
            for p in sorted(at, reverse=True):
                best = None
                for x in dict.fromkeys(x for c in at[p] for x in levels[score][c]):
                    while stacks[x] and stacks[x][-1] in taken[1]:
                        stacks[x].pop()
                    if stacks[x] and (best is None or stacks[x][-1] > best):
                        best = stacks[x][-1]
                if best is not None:
                    taken[0].add(p)
                    taken[1].add(best)
        return pd.DataFrame({name: [key[0]], "tp": [len(taken[0])]})

    return run


def partial_f1(pred: DataFrame, gold: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """pred and gold (key, pos, type, text) by key: greedy one-to-one matches of equal type and similar tokens. A task holds a key's rows, not their pairs."""
    words = F.array_join(F.sort_array(tokens(F.col("text"))), " ")
    rows = lambda d, side: d.select(key, F.lit(side).alias("side"), "pos", "type", words.alias("words"))
    both = rows(pred, 0).unionByName(rows(gold, 1)).where(F.col(key).isNotNull() & F.col("type").isNotNull() & F.col("words").isNotNull())
    matched = both.groupBy(key).applyInPandas(_walked(key, threshold), StructType([pred.schema[key], StructField("tp", IntegerType())]))
    sizes = pred.groupBy(key).agg(F.count("*").alias("predicted")).join(gold.groupBy(key).agg(F.count("*").alias("gold")), key, "full")
    full = sizes.join(matched, key, "left").na.fill(0, ["predicted", "gold", "tp"])
    return full.select(key, "tp", "predicted", "gold", *prf("tp", "predicted", "gold"))


def with_gold(predictions: DataFrame, gold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner join with the gold records, whose keys have to be unique and to cover every prediction; else the query fails, naming a key."""
    named = F.concat_ws("|", *[F.col(f"p.{k}").cast("string") for k in keys])
    once = gold.groupBy(*keys).agg(F.count("*").alias("_times"), F.first(F.struct(*[c for c in gold.columns if c not in keys])).alias("_gold"))
    on = [F.col(f"p.{k}") == F.col(f"g.{k}") for k in keys]
    met = predictions.alias("p").join(once.alias("g"), on, "left")
    wrong = F.when(F.col("_times").isNull(), F.raise_error(F.concat(F.lit("no gold record for "), named))).when(F.col("_times") > 1, F.raise_error(F.concat(F.lit("several gold records for "), named)))
    return met.withColumn("_times", F.coalesce(wrong.cast("long"), F.col("_times"))).where("_times = 1").select("p.*", "_gold.*")


def _prf(tp: Column, pred: Column, gold: Column) -> Column:
    """A struct of precision, recall and f1 of counts; both sides empty are perfect, one empty side is 0."""
    p = F.when(pred == 0, F.when(gold == 0, 1.0).otherwise(0.0)).otherwise(tp / pred)
    r = F.when(gold == 0, F.when(pred == 0, 1.0).otherwise(0.0)).otherwise(tp / gold)
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f1"))


def tuple_score(pred: Column, gold: Column) -> Column:
    """multiset_f1 of two arrays in their row."""
    times = lambda items, x: F.size(F.filter(items, lambda y: y == x))
    tp = F.aggregate(F.array_distinct(pred), F.lit(0), lambda acc, x: acc + F.least(times(pred, x), times(gold, x)))
    return _prf(tp, F.size(pred), F.size(gold))


def partial_score(pred: Column, gold: Column, threshold: float = 0.5) -> Column:
    """partial_f1 of two arrays of structs (text, type) in their row."""
    with_tokens = lambda items: F.transform(items, lambda e, i: F.struct(i.alias("i"), e["type"].alias("type"), tokens(e["text"]).alias("t")))
    g = with_tokens(gold)
    pairs = F.flatten(F.transform(with_tokens(pred), lambda p: F.transform(F.filter(g, lambda x: x["type"] == p["type"]), lambda x: F.struct(jaccard(p["t"], x["t"]).alias("score"), p["i"].alias("p"), x["i"].alias("g")))))
    return _prf(greedy_matches(F.filter(pairs, lambda c: c["score"] >= threshold)), F.size(pred), F.size(gold))


def job_metrics(predictions: DataFrame, jobs: DataFrame, gold: DataFrame, keys: Sequence[str] = ("dataset", "split", "record_id")) -> DataFrame:
    """The scoring table: the latest predictions (job_id, parsed_output as JSON text, and measurements) of known jobs against gold records
    (keys, input_text, gold_output as JSON text).

    Entities and relations are compared as caseless tuples with their number, entities also one to one with similar tokens;
    an entity is unsupported if the input doesn't contain it; both sides empty are perfect. Rows of the result have the jobs' and predictions'
    columns without the JSON. A row holds both its sides, so that nothing but the two joins is shuffled."""
    met = with_gold(predictions.join(jobs, "job_id"), gold, keys)
    rows = met.withColumns({
        "_pe": nested.entity_tuples(F.col("parsed_output")), "_ge": nested.entity_tuples(F.col("gold_output")),
        "_pr": nested.relation_tuples(F.col("parsed_output")), "_gr": nested.relation_tuples(F.col("gold_output"), gold=True),
        "_in": fold_key(F.col("input_text")),
    })
    unsupported = F.size(F.filter("_pe", lambda e: ~F.contains(F.col("_in"), e["text"])))
    n = lambda c: F.size(c).cast("long")
    scored = rows.withColumns({"entity_exact": tuple_score(F.col("_pe"), F.col("_ge")), "entity_partial": partial_score(F.col("_pe"), F.col("_ge")), "relation_exact": tuple_score(F.col("_pr"), F.col("_gr"))})
    return scored.select(
        *[c for c in met.columns if c not in ("parsed_output", "gold_output", "input_text")],
        n("_pe").alias("predicted_entities"), n("_ge").alias("gold_entities"), n("_pr").alias("predicted_relations"), n("_gr").alias("gold_relations"),
        unsupported.cast("long").alias("unsupported_entities"), F.coalesce(unsupported / F.nullif(F.size("_pe"), F.lit(0)), F.lit(0.0)).alias("hallucinated_entity_rate"),
        *[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in ("entity_exact", "entity_partial", "relation_exact") for c in ("precision", "recall", "f1")],
        ((F.size("_pr") > 0) | (F.size("_gr") > 0)).alias("relation_f1_applicable"),
    )
