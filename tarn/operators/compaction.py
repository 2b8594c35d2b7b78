"""Result logs: the latest record of each key, what is still to do, and set operations on keys."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last record of each key by the order columns; records with a null or empty key don't count.

    A grouped maximum, combined before the shuffle, so that a key with a third of the log doesn't meet in one task."""
    rest = [c for c in log.columns if c != key]
    kept = log.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    best = kept.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in log.columns])


def latest_ordinal(log: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Every record with its number within its key, from the first on."""
    return log.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def pending(jobs: DataFrame, done: DataFrame, failed: DataFrame, key: str, retry: bool = False) -> DataFrame:
    """Jobs neither done nor, unless they are retried, failed."""
    left = jobs.join(done.select(key).distinct(), key, "left_anti")
    return left if retry else left.join(failed.select(key).distinct(), key, "left_anti")


def unresolved(jobs: DataFrame, done: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Failed jobs among the expected ones without a success."""
    return failed.select(key).distinct().join(jobs, key, "left_semi").join(done.select(key).distinct(), key, "left_anti")


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df, marked for broadcasting if it has at most so many rows; counted up to there."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def settled(df: DataFrame) -> DataFrame:
    """df with its lineage cut, for what is read several times: a checkpoint in the folder that spark.checkpoint.dir names. Where that is unset, in
    one of the warehouse, and only in local mode one of the machine's own."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place:
            here = (spark.sparkContext.master or "").startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
            place = "file://" + tempfile.mkdtemp(prefix="tarn-") if here else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tarn-scratch"
        spark.sparkContext.setCheckpointDir(place)
    return df.checkpoint()


def with_aliases(rows: DataFrame, aliases: DataFrame, sample: DataFrame, keys: Sequence[str], condition: str = "condition") -> DataFrame:
    """rows and, of those in sample, copies under their condition's aliases (condition, alias). Each row is made once and exploded."""
    named = aliases.groupBy(condition).agg(F.collect_list("alias").alias("_aliases"))
    marks = sample.select(*keys).distinct().withColumn("_sampled", F.lit(True))
    met = rows.join(small(named), condition, "left").join(small(marks), list(keys), "left")
    own = F.array(F.lit(None).cast("string"))
    each = met.withColumn("_alias", F.explode(F.when(F.col("_sampled") & F.col("_aliases").isNotNull(), F.concat(own, "_aliases")).otherwise(own)))
    is_alias = F.col("_alias").isNotNull()
    changed = {"job_id": F.when(is_alias, F.concat_ws("::", F.lit("alias"), "job_id", "_alias")).otherwise(F.col("job_id")), condition: F.coalesce("_alias", condition)}
    return each.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in rows.columns], is_alias.alias("is_alias"))


def duplicates(rows: DataFrame, digest: Column) -> DataFrame:
    """Rows whose digest another row shares, with the size of their group."""
    tagged = rows.withColumn("digest", digest)
    sizes = tagged.groupBy("digest").agg(F.count("*").alias("group_size")).where("group_size > 1")
    return tagged.join(sizes, "digest")


def progress(jobs: DataFrame, done: DataFrame, failed: DataFrame, by: str, key: str) -> DataFrame:
    """Expected, done, unresolved and remaining jobs by group; only expected jobs count."""
    ok = done.select(key).distinct().withColumn("ok", F.lit(1))
    bad = failed.select(key).distinct().withColumn("bad", F.lit(1))
    j = jobs.select(by, key).distinct().join(ok, key, "left").join(bad, key, "left")
    n = F.count("*").alias("expected")
    d = F.count("ok")
    return j.groupBy(by).agg(n, d.alias("done"), F.count(F.when(F.col("ok").isNull(), F.col("bad"))).alias("unresolved")).withColumn("remaining", F.col("expected") - F.col("done")).withColumn("percent", F.bround(100.0 * F.col("done") / F.col("expected"), 3))


def progress_report(jobs: DataFrame, predictions: DataFrame, failed: DataFrame, by: str, key: str) -> DataFrame:
    """progress with rates over the jobs done: json_valid_rate, schema_valid_rate, mean_seconds_per_item (of those above 0), and the hours that
    the remaining ones will take. predictions: one row a key with json_valid, schema_valid and seconds."""
    counts = progress(jobs, predictions, failed, by, key)
    done = jobs.select(by, key).distinct().join(predictions.select(key, "json_valid", "schema_valid", "seconds"), key)
    rates = done.groupBy(by).agg(F.avg(F.col("json_valid").cast("double")).alias("json_valid_rate"), F.avg(F.col("schema_valid").cast("double")).alias("schema_valid_rate"), F.avg(F.when(F.col("seconds") > 0, F.col("seconds"))).alias("mean_seconds_per_item"))
    out = counts.alias("c").join(rates.alias("r"), F.col(f"c.{by}").eqNullSafe(F.col(f"r.{by}")), "left").select("c.*", "json_valid_rate", "schema_valid_rate", "mean_seconds_per_item")
    return out.withColumn("projected_hours", F.col("remaining") * F.col("mean_seconds_per_item") / 3600)


def suffixed_ids(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Later rows of a key get its number behind it: id, id__2, id__3."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn(key, F.when(n == 1, F.col(key).cast("string")).otherwise(F.concat(F.col(key).cast("string"), F.lit("__"), n.cast("string"))))


def best_by(rows: DataFrame, keys: Sequence[str], score: Sequence[Column]) -> DataFrame:
    """Of each key the row of the greatest score; a grouped maximum."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*score)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def preferring(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """first, and the rows of second whose keys it hasn't."""
    return first.unionByName(second.join(first.select(*keys).distinct(), list(keys), "left_anti"))


def by_cardinality(first: DataFrame, second: DataFrame, keys: Sequence[str], least: int) -> tuple[str, DataFrame]:
    """first if it has at least so many keys, else second if it has, else both, first preferred; and which it was."""
    for name, df in (("first", first), ("second", second)):
        if df.select(*keys).distinct().limit(min(least, 2**31 - 1)).count() >= least:
            return name, df
    return "union", preferring(first, second, keys)


def repeated_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1")


def expect(rows: DataFrame, keys: Sequence[str] = (), total: int | None = None) -> DataFrame:
    """rows, once it is known that no key repeats and that there are `total` rows; else ValueError."""
    if keys and (bad := repeated_keys(rows, keys).limit(5).collect()):
        raise ValueError(f"repeated keys: {[tuple(r)[:-1] for r in bad]}")
    if total is not None and (n := rows.count()) != total:
        raise ValueError(f"expected {total} rows, found {n}")
    return rows


def with_records(jobs: DataFrame, records: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Jobs joined with their records, and error rows (job_id, error_type) of those without one."""
    mark = records.withColumn("_found", F.lit(True))
    met = jobs.join(mark, list(keys), "left")
    return met.where("_found").drop("_found"), met.where("_found is null").select("job_id", F.lit("MissingRecord").alias("error_type"))


def admitted(jobs: DataFrame, prompt: str, digest: str, prompt_tokens: str, new_tokens: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """Jobs whose prompt has the digest that was noted and fits into the limit with what is to be generated, and error rows of the others. A job
    without a prompt or digest is a mismatch, one without a size an overflow."""
    same = F.coalesce(F.sha2(prompt, 256) == F.col(digest), F.lit(False))
    fits = F.coalesce(F.col(prompt_tokens) + F.col(new_tokens) <= limit, F.lit(False))
    kind = F.when(~same, "PromptHashMismatch").when(~fits, "ContextOverflow")
    judged = jobs.withColumn("error_type", kind)
    return judged.where("error_type is null").drop("error_type"), judged.where("error_type is not null").select("job_id", "error_type")


def joined_by_either(rows: DataFrame, other: DataFrame, key: Column, fallback: Column, by: str) -> DataFrame:
    """rows left-joined with other (by, ...) on a key, and where that finds nothing on a second one."""
    rest = [c for c in other.columns if c != by]
    a = other.select(F.col(by).alias("_a"), F.struct(*rest).alias("_x"))
    b = other.select(F.col(by).alias("_b"), F.struct(*rest).alias("_y"))
    met = rows.withColumns({"_k": key, "_f": fallback}).join(a, F.col("_k") == F.col("_a"), "left").join(b, F.col("_a").isNull() & (F.col("_f") == F.col("_b")), "left")
    return met.withColumn("_z", F.coalesce("_x", "_y")).select(*rows.columns, *[F.col(f"_z.{c}").alias(c) for c in rest])


def by_position(rows: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """rows in the order in which levels are given, other values last."""
    at = F.array_position(F.array(*map(F.lit, levels)), F.col(column))
    return rows.orderBy(F.when(at > 0, at).otherwise(F.lit(len(levels) + 1)), column)
