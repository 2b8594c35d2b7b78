"""Keyed state kept by the stream: the latest record of each key, and appends that happen once, without reading the sink again.

Both run on transformWithState, for which the session's state store has to be RocksDB (state_store sets it). State is a record, or a mark, for each key; with a time to live
it is dropped when that long has passed since it was last written.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


def _rank(row: tuple, places: Sequence[int]) -> tuple:
    """Null comes first in an order."""
    return tuple((row[i] is not None, row[i]) if row[i] is not None else (False, 0) for i in places)


def _plain(value):
    """Pandas' numbers and missing values as Python's."""
    if value is None or value is pd.NaT or isinstance(value, float) and value != value:
        return None
    return value.item() if hasattr(value, "item") else value.to_pydatetime() if isinstance(value, pd.Timestamp) else value


class Latest(StatefulProcessor):
    """Holds a key's last record by order and gives it out whenever a batch changes it."""

    def __init__(self, schema: StructType, order: Sequence[str], ttl_ms: int | None):
        self.schema, self.ttl_ms = schema, ttl_ms
        self.places = [schema.fieldNames().index(c) for c in order]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", self.schema, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(map(_plain, self.state.get())) if self.state.exists() else None
        best = held
        for pdf in rows:
            for row in pdf.itertuples(index=False, name=None):
                row = tuple(map(_plain, row))
                if best is None or _rank(row, self.places) > _rank(best, self.places):
                    best = row
        if best is not held:
            self.state.update(best)
            yield pd.DataFrame([best], columns=self.schema.fieldNames()).astype(object)

    def close(self) -> None:
        pass


class Once(StatefulProcessor):
    """Gives out a key's first record, by order within the batch in which it comes, and no other."""

    def __init__(self, schema: StructType, order: Sequence[str], ttl_ms: int | None):
        self.schema, self.ttl_ms = schema, ttl_ms
        self.places = [schema.fieldNames().index(c) for c in order]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("seen", "seen boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, first = self.state.exists(), None
        for pdf in rows:
            for row in () if seen else pdf.itertuples(index=False, name=None):
                row = tuple(map(_plain, row))
                if first is None or _rank(row, self.places) < _rank(first, self.places):
                    first = row
        if first is not None:
            self.state.update((True,))
            yield pd.DataFrame([first], columns=self.schema.fieldNames()).astype(object)

    def close(self) -> None:
        pass


def _kept(stream: DataFrame, key: str, processor: StatefulProcessor, mode: str) -> DataFrame:
    known = stream.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return known.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=stream.schema, outputMode=mode, timeMode="None" if processor.ttl_ms is None else "ProcessingTime")


def latest(stream: DataFrame, key: str, order: Sequence[str], ttl_ms: int | None = None) -> DataFrame:
    """The stream of each key's last record by order, anew whenever a later one comes; in update mode. Records with a null or empty key don't count, one that
    is as late as the one held changes nothing. What came last by key of all that is given out is compaction.latest of all that came in."""
    return _kept(stream, key, Latest(stream.schema, order, ttl_ms), "Update")


def once(stream: DataFrame, key: str, order: Sequence[str], ttl_ms: int | None = None) -> DataFrame:
    """The stream of each key's first record, in append mode: a key that has come before is dropped by its state, whatever the sink holds."""
    return _kept(stream, key, Once(stream.schema, order, ttl_ms), "Append")


def append_first(stream: DataFrame, key: str, order: Sequence[str], path: str, checkpoint: str, ttl_ms: int | None = None) -> StreamingQuery:
    """Appends each key's first record to a Parquet folder, once, over restarts too. Runs what is available. The sink is never read."""
    return once(stream, key, order, ttl_ms).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
