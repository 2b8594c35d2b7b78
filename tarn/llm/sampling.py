"""The split and the bounded samples that classifiers learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small


def held_out(column: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bounded_sample(rows: DataFrame, group: str, per_group: int, most_rows: int, seed: int = 11, most_bytes: int = 1 << 20) -> list:
    """At most most_rows rows (doc_id, text, ...), about per_group of each value of group, in an order of their own; of texts of at most
    most_bytes, so that what comes to the driver is bounded. There may be any number of groups: where they have more than most_rows together, each row that the
    rates let through has the same chance. Rows without a group don't count.

    A row's hash decides; the groups' counts, which stay on the executors, give the rates. Only the sample comes to the driver."""
    short = rows.where(F.col(group).isNotNull() & (F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes))
    counts = short.groupBy(group).agg(F.count("*").alias("_n"))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / float(1 << 53)
    dealt = join_small(short, counts, group).where(u < F.least(F.lit(1.0), per_group / F.col("_n"))).select(*rows.columns)
    return dealt.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "text").limit(most_rows).collect()
