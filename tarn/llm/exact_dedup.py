"""Operator 10, exact dedup by skew-safe combining: local, then salted digest groups, then the salts' winners.

Texts are equal when identical after the deletion of ASCII white space. Groups are keyed by digest *and* content at
every stage, so a digest collision can't merge different texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small, null_text, written

WHITE = "[\\x20\\x09-\\x0D]"


def sha256(column: Column) -> Column:
    return F.unhex(F.sha2(column, 256))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = 16, broadcast_limit: int = 1_000_000, large: int = 10_000) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, digest.

    The row with the most code points in its original text stays, then the smallest doc_id. Null text counts as empty,
    so all empty, blank and null texts are one group. A null doc_id sorts last and stays only where no other row has as
    many code points. Rows that repeat one doc_id with one text: the first by length stays once, all of them are
    marked kept. Other columns aren't read. An empty table gives no rows.

    digests: each map task combines its own rows by digest (Spark's partial aggregate), salted partial counts are
    merged, then the salts' sums. Only texts whose digest occurs twice have their content compared: again local
    combining, salted groups of (digest, content), then the salts' winners. A group of copies of any size so reaches a
    task as at most one row per map task and salt. At last the rows meet the winners: of groups of more than `large` rows, of which
    there is at most one in `large` rows, the winners are broadcast if they are few, so that such a group stays where it is.
    """
    norm = F.regexp_replace(null_text(), WHITE, "")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(null_text()).cast("long").alias("chars"), norm.alias("norm")).withColumn("digest", digest(F.col("norm")))
    keys = written(base.select("doc_id", "chars", "digest"), "digests")
    salt = F.pmod(F.xxhash64("doc_id", "chars"), F.lit(salts)).alias("salt")
    counts = keys.groupBy("digest", salt).agg(F.count("*").alias("n")).groupBy("digest").agg(F.sum("n").alias("n"))
    multi = written(counts.where("n > 1").select(F.col("digest")), "multi")
    n_multi = multi.limit(broadcast_limit + 1).count()
    again = base.join(F.broadcast(multi) if n_multi <= broadcast_limit else multi, "digest", "left_semi")
    # rank is the order of staying: more code points, then the smaller doc_id, null last
    rank = F.struct((-F.col("chars")).alias("r"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"))
    local = again.groupBy("digest", "norm", salt).agg(F.min(rank).alias("best"), F.count("*").alias("n"))
    winners = written(local.groupBy("digest", "norm").agg(F.min("best").alias("best"), F.sum("n").alias("n")).select("digest", "norm", F.col("best.d").alias("keep_id"), (-F.col("best.r")).alias("best_chars"), F.col("n").alias("group_size"), F.lit(1).alias("one")), "winners")
    collided = written(winners.groupBy("digest").agg(F.count("*").alias("c")).where("c > 1").select("digest"), "collided")
    out = ["doc_id", "keep_id", "best_chars", "group_size", "chars", "digest"]
    plain = keys
    if not collided.isEmpty():  # one digest, several contents: these rows are matched by content
        plain = keys.join(collided, "digest", "left_anti")
        by_content = base.join(collided, "digest", "left_semi").join(winners, ["digest", "norm"]).select(*out)
        winners = winners.join(collided, "digest", "left_anti")
    winners = winners.drop("norm")
    big = winners.where(F.col("group_size") > large)
    if big.isEmpty():
        met = plain.join(winners, "digest", "left")
    else:
        met = join_small(plain, big, "digest").unionByName(join_small(plain, big.select("digest"), "digest", "left_anti").join(winners.where(F.col("group_size") <= large), "digest", "left"))
    joined = met.select(
        "doc_id",
        F.when(F.col("one").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("best_chars", "chars").alias("best_chars"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        "chars", "digest",
    )
    if plain is not keys:
        joined = joined.unionByName(by_content)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("best_chars"))
    return joined.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), "digest")


def op10(docs: DataFrame) -> DataFrame:
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d
      WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
