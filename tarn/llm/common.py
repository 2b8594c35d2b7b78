"""What several operators share: written tables, a fixed-size Bloom prefilter, connected components, hashing."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one in the warehouse, and only in local mode
    one of the machine's own."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if (spark.sparkContext.master or "").startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            place = "file://" + tempfile.mkdtemp(prefix="tarn-")
        else:
            place = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tarn-scratch"
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever it is; none is no error."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_written() -> None:
    for spark, path in _WRITTEN:
        try:
            remove(spark, path)
        except Exception:  # the session may have ended before
            return


atexit.register(_remove_written)


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The scratch paths that are made within, known when it ends: for who knows when the results that read them are written."""
    at, paths = len(_WRITTEN), []
    yield paths
    paths += [p for _, p in _WRITTEN[at:]]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tarn-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def lasting(spark: SparkSession, name: str) -> str:
    """A new path for what the driver's end must not remove: below the setting tarn.output.dir, or the shared folder where it is unset."""
    return f"{(spark.conf.get('tarn.output.dir', None) or shared_dir(spark)).rstrip('/')}/tarn-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it again."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(docs: DataFrame) -> int:
    """Of the column text, in UTF-8; a count by the executors, for the number of partitions."""
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    with np.errstate(over="ignore"):
        x = x.astype(U64) + U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class BloomFilter:
    """A bit set of fixed size, for dropping most of the rows that a following exact join would drop. It never drops
    a row that the join keeps; its size doesn't grow with the data, only its rate of false hits does."""

    def __init__(self, bits: np.ndarray, log2_bits: int):
        self.bits, self.log2_bits = bits, log2_bits

    @classmethod
    def of(cls, keys: DataFrame, column: str, log2_bits: int = 24) -> BloomFilter:
        """Of a column of 64-bit hashes. Built by the executors: at most 2**log2_bits / 63 words come to the driver."""
        low = (1 << log2_bits) - 1
        at = F.explode(F.array(F.col(column).bitwiseAND(F.lit(low).cast("long")), F.shiftrightunsigned(column, 32).bitwiseAND(F.lit(low).cast("long")))).alias("at")
        words = keys.select(at).groupBy(F.expr("at div 63").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 63 as int)))").alias("b"))
        got = words.toArrow()  # two words each, where rows of Python take some 200 bytes
        bits = np.zeros(low // 63 + 1, np.int64)
        bits[np.array(got["w"])] = np.array(got["b"])
        return cls(bits, log2_bits)

    @staticmethod
    def hits(bits: np.ndarray, keys: np.ndarray, log2_bits: int) -> np.ndarray:
        u, low = keys.view(U64), U64((1 << log2_bits) - 1)
        found = np.ones(len(u), bool)
        for at in (u & low, (u >> U64(32)) & low):
            at = at.astype(np.int64)
            found &= (bits[at // 63] >> (at % 63) & 1).astype(bool)
        return found


def stable_min_label(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, label) of every node of edges (a, b) but the smallest of each connected component, which is the label.

    Large-star and small-star steps in turn, each a grouped minimum and a join, written out every round. Nothing but a
    count and a checksum of the edges comes to the driver. Self loops and repeated edges are harmless; null ends go.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()

    was = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        now = written(small, "edges")
        is_ = state(now)
        if is_ == was:
            break
        was = is_
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))


def join_small(df: DataFrame, small: DataFrame, on: Column | str | list[str], how: str = "inner", limit: int = 200_000) -> DataFrame:
    """Joins with a table that is broadcast only if it has at most limit rows; else Spark shuffles and splits skew."""
    n = small.limit(limit + 1).count()
    return df.join(F.broadcast(small) if n <= limit else small, on, how)


def trim_memory() -> None:
    """Gives freed memory of this worker back to the system, Arrow's and, where it can, the C library's; workers are used again."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def slices(batches, rows: int, column: str = "text", size: int = 8 << 20):
    """Arrow batches cut into slices of at most `rows` rows and, but for single long values, about `size` bytes of a column."""
    import pyarrow.compute as pc

    for whole in batches:
        if not whole.num_rows:
            continue
        ends = np.cumsum(np.array(pc.fill_null(pc.binary_length(whole.column(column)), 0), np.int64))
        at = 0
        while at < whole.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, "right"))))
            yield whole.slice(at, to - at)
            at = to


def null_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
