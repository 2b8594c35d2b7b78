"""Readers. Schemas are given, never inferred from a model's output."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import normal_space, path_parts
from . import jsonlines

#: Keys under which a file's records are found.
WRAPPERS = ("documents", "data", "records", "examples", "instances")


_WHERE = "_metadata.file_path"


def json_lines(spark: SparkSession, path: str, mode: str, part_bytes: int = jsonlines.PART, head: int = 0) -> DataFrame:
    """(value, path, offset, line, error) of the lines of JSON that path, which may be a glob, means; see jsonlines. Strict lines fail the job that
    reads them, by path:line."""
    jsonlines.register(spark)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    if not found:
        raise FileNotFoundError(path)
    return spark.read.format("tarn_jsonl").option("path", json.dumps([x.getPath().toString() for x in found])).option("mode", mode).option("part_bytes", part_bytes).option("head", head).load()


def strict_jsonl(spark: SparkSession, path: str, schema: StructType | str, part_bytes: int = jsonlines.PART) -> DataFrame:
    """One object a line; blank lines are skipped. A line that isn't an object by itself, with nothing behind it, fails the job that reads it and is
    named by path:line, in the one pass over the file. Of a repeated key the last value counts."""
    return json_lines(spark, path, "strict", part_bytes).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def tolerant_jsonl(spark: SparkSession, path: str, schema: StructType, part_bytes: int = jsonlines.PART) -> DataFrame:
    """Lines that aren't objects, torn ones and such with something behind the object too, are dropped; an object whose member has another type
    stays, with null there. A missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return json_lines(spark, path, "tolerant", part_bytes).select(F.from_json("value", schema).alias("r")).select("r.*")


def first_record(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The first object of JSON lines, by path and place, at most one row; a first line that isn't an object fails. Of each part but one line is read."""
    first = json_lines(spark, path, "strict", head=1).orderBy("path", "offset").limit(1)
    return first.select(F.from_json("value", schema).alias("r")).select("r.*")


def json_object(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object a file, over any number of lines."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def _records(text: str, by_line: bool, wrappers: Sequence[str]) -> list[tuple[str | None, str | None]]:
    """(record, error) of a file's text: the text as one value if it is one, else each line."""
    if not by_line:
        try:
            whole = json.loads(text)
            if isinstance(whole, dict):
                whole = next((whole[w] for w in wrappers if isinstance(whole.get(w), list)), [whole])
            values = [(v, None) for v in (whole if isinstance(whole, list) else [whole])]
        except (ValueError, RecursionError):
            by_line = True
    if by_line:
        values = []
        for number, line in enumerate(text.split("\n"), 1):
            if line.strip():
                try:
                    values.append((json.loads(line), None))
                except (ValueError, RecursionError) as e:
                    values.append((line, f"line {number}: {e}"))
    as_text = lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    return [(as_text(v), None) if e is None and isinstance(v, dict) else (None, e or f"expected an object, found {as_text(v)[:200]}") for v, e in values]


def json_records(spark: SparkSession, path: str, wrappers: Sequence[str] = WRAPPERS) -> DataFrame:
    """(record, error, path): each record of a file as JSON text, whether the file is an array, an object, an object that wraps an array, or
    lines, as files named .jsonl always are. The whole text is decoded strictly; where it isn't one value, each line is. Lines that don't parse come as errors with
    their number, and so do records that aren't objects; nothing is lost. Of a repeated key the last value counts. Without wrappers an object is a record."""

    def run(batches):
        for b in batches:
            for text, where in zip(b.column("value"), b.column("path")):
                text = text.as_py().strip()
                found = _records(text, where.as_py().lower().endswith(".jsonl"), wrappers) if text else []
                for at in range(0, len(found), 10_000):
                    records, errors = zip(*found[at : at + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(records, pa.string()), pa.array(errors, pa.string()), pa.array([where.as_py()] * len(records))], ["record", "error", "path"])

    return spark.read.text(path, wholetext=True).select("value", F.col(_WHERE).alias("path")).mapInArrow(run, "record string, error string, path string")


def csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def csv_strings(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """All columns as strings; a missing file is an empty table of the given columns."""
    if not exists(spark, path):
        return spark.createDataFrame([], StructType([StructField(c, StringType()) for c in columns]))
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files with their white space collapsed."""
    return spark.read.text(path, wholetext=True).select(F.col(_WHERE).alias("path"), normal_space(F.col("value")).alias("text"))


def split_sources(spark: SparkSession, files: Mapping[tuple[str, str], str], schema: StructType) -> DataFrame:
    """Files of JSON lines by (dataset, split), as one table with these two columns."""
    parts = [tolerant_jsonl(spark, path, schema).withColumns({"dataset": F.lit(d), "split": F.lit(s)}) for (d, s), path in files.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def listed(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, dir, name) of the files below root, listed without their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")
    return files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"))


def scored_directory(spark: SparkSession, root: str, stems: Sequence[str] = ("train", "dev", "test"), pattern: str = "*.json*", favoured: Sequence[str] = ()) -> DataFrame:
    """(dir, score): the directory that holds a file of every stem; more of the favoured path parts are better, then the last name."""
    files = listed(spark, root, pattern).withColumn("stem", F.regexp_extract(F.lower("name"), r"^([^.]*)", 1))
    dirs = files.groupBy("dir").agg(F.collect_set("stem").alias("stems"))
    score = F.size(F.array_intersect(path_parts(F.col("dir")), F.array(*map(F.lit, favoured)).cast("array<string>")))
    return dirs.where(F.size(F.array_except(F.array(*map(F.lit, stems)), "stems")) == 0).select("dir", score.alias("score")).orderBy(F.desc("score"), F.desc("dir")).limit(1)


def discovered(spark: SparkSession, root: str, extensions: Sequence[str], parts: Sequence[str] = ()) -> DataFrame:
    """(path, extension): the files with one of the extensions, and with one of the path parts where any are given."""
    files = listed(spark, root).withColumn("extension", F.regexp_extract(F.lower("name"), r"(\.[^.]*)$", 1)).where(F.col("extension").isin(*extensions))
    return (files.where(F.arrays_overlap(path_parts(F.col("path")), F.array(*map(F.lit, parts)))) if parts else files).select("path", "extension")


def token_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, tokens): one token a line, empty lines at the end dropped."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"(\r?\n)+$", "").alias("value"))
    return text.select("path", F.when(F.col("value") == "", F.array().cast("array<string>")).otherwise(F.split("value", r"\r?\n")).alias("tokens"))


def best_directory(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """The directory below root with the most files of a pattern; of equals the last by name."""
    return listed(spark, root, pattern).groupBy("dir").agg(F.count("*").alias("files")).orderBy(F.desc("files"), F.desc("dir")).limit(1)


def partitioned_log(spark: SparkSession, glob: str, schema: StructType) -> DataFrame:
    """A log of several files, of objects only, with file_path and offset, in whose order its records are: the order keys of latest()."""
    if not exists(spark, glob):
        return spark.createDataFrame([], schema).withColumns({"file_path": F.lit("").cast("string"), "offset": F.lit(0).cast("long")})
    lines = json_lines(spark, glob, "tolerant").withColumnRenamed("offset", "_offset")
    return lines.select(F.from_json("value", schema).alias("r"), "path", "_offset").select("r.*", F.col("path").alias("file_path"), F.col("_offset").alias("offset"))
