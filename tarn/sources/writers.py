"""Sinks."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Writes one object a line and returns how many, counted while writing."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path)
    return seen.get["n"]


def checked(df: DataFrame, path: str, wanted: Mapping[str, tuple[Column, object]], keys: Sequence[str] = ()) -> DataFrame:
    """Writes df as Parquet and reads it again, if it is as expected: wanted gives by name an aggregate, taken while df is written, and the value it
    must have; keys may not repeat, for which only they are read again. Until all is known, the rows stand beside path; otherwise
    they are dropped, path is as it was, and ValueError tells what was found."""
    spark, beside = df.sparkSession, f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    seen = Observation()
    (df.observe(seen, *[a.alias(n) for n, (a, _) in wanted.items()]) if wanted else df).write.parquet(beside)
    found = seen.get if wanted else {}
    wrong = [f"{n}: expected {v}, found {found[n]}" for n, (_, v) in wanted.items() if found[n] != v]
    if keys and not wrong:
        again = spark.read.parquet(beside).groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1").limit(5).collect()
        wrong = [f"repeated {', '.join(keys)}: {[tuple(r)[:-1] for r in again]}"] if again else []
    jvm = spark.sparkContext._jvm
    p, b = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, beside))
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if wrong:
        fs.delete(b, True)
        raise ValueError("; ".join(wrong))
    fs.delete(p, True)
    fs.rename(b, p)
    return spark.read.schema(df.schema).parquet(path)


def csv(df: DataFrame, path: str, fields: Sequence[str] | None = None) -> None:
    """A header and the fields in their order; other columns are left out."""
    (df.select(*fields) if fields else df).write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def csv_union(tables: Sequence[DataFrame], path: str) -> list[str]:
    """Tables of unlike columns as one CSV with all columns, in the order in which they first occur; what a table lacks is empty."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    csv(whole, path)
    return whole.columns


def by_split(df: DataFrame, path: str) -> None:
    """A folder for each split below path/split, and the whole table in path/all."""
    df.write.mode("overwrite").partitionBy("split").json(f"{path}/split")
    df.write.mode("overwrite").json(f"{path}/all")


def summary(df: DataFrame, path: str) -> None:
    """A summary of one row as one JSON file."""
    df.limit(1).coalesce(1).write.mode("overwrite").json(path)


def merged_summary(old: dict | None, new: dict, lists: Sequence[str] = ()) -> dict:
    """new over old; the named lists are joined without repeats; a broken old summary counts as none."""
    out = dict(old) if isinstance(old, dict) else {}
    for k, v in new.items():
        out[k] = [*dict.fromkeys([*(out.get(k) or []), *v])] if k in lists else v
    return out


def update_summary(spark: SparkSession, path: str, new: dict, lists: Sequence[str] = ()) -> dict:
    """Reads the summary file at path, if it is there and sound, merges, and writes it again; a driver's job, by Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = None
    if fs.exists(p):
        try:
            old = json.loads("\n".join(r.value for r in spark.read.text(path).collect()))
        except ValueError:
            pass
    merged = merged_summary(old, new, lists)
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps(merged, ensure_ascii=False, indent=2).encode()))
    finally:
        out.close()
    return merged
