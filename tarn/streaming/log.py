"""Append-only logs as streams, and budgeted micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import compaction, ranks
from ..sources.readers import exists


def follow(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """New lines of a folder of JSON lines; torn lines come as nulls and are dropped by their missing key."""
    return spark.readStream.schema(schema).option("mode", "PERMISSIVE").json(path)


def append_once(stream: DataFrame, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Appends records whose key isn't there yet; the checkpoint makes a restart go on where it was. Runs what is available. What is there
    is asked of the sink, by an anti-join for each batch, so no key is held in state; of a batch's repeats one record stays."""

    def write(batch: DataFrame, _: int) -> None:
        spark, new = batch.sparkSession, batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        if exists(spark, path):
            new = new.join(spark.read.schema(batch.schema).parquet(path).select(key), key, "left_anti")
        new.select(*batch.columns).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def monitor(stream: DataFrame, report: Callable[[DataFrame, int], None], checkpoint: str, every: str = "15 seconds", once: bool = False) -> StreamingQuery:
    """Calls report with each new batch of a log."""
    w = stream.writeStream.foreachBatch(report).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def monitor_progress(stream: DataFrame, jobs: DataFrame, failed: DataFrame, by: str, key: str, log: str, report: Callable[[DataFrame], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends the stream's records to the log and reports the progress of all jobs after each batch."""

    def step(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").parquet(log)
        report(compaction.progress(jobs, batch.sparkSession.read.schema(batch.schema).parquet(log), failed, by, key))

    return monitor(stream, step, checkpoint, once=once)


def retries(failures: DataFrame, key: str, most: int = 8, wait: float = 60.0) -> DataFrame:
    """Of a log of failures (key, ts): attempts, when to try again, and whether the key has failed for good."""
    return failures.groupBy(key).agg(F.count("*").alias("attempts"), (F.max("ts") + F.make_dt_interval(secs=F.lit(wait))).alias("retry_at")).withColumn("terminal", F.col("attempts") > most)


def split_on_failure(items: Sequence, run: Callable[[Sequence], Sequence], failed: Callable[[object, Exception], object]) -> list:
    """The results of run over items; where it raises, of each half by itself, down to single items, which `failed` answers for."""
    out, open_ = [], [list(items)]
    while open_:
        part = open_.pop()
        if not part:
            continue
        try:
            out += run(part)
        except Exception as e:
            if len(part) == 1:
                out.append(failed(part[0], e))
            else:
                half = len(part) // 2
                open_ += [part[half:], part[:half]]
    return out


def inferred(batched: DataFrame, infer: Callable[[list[str]], list[str]], columns: Sequence[str] = ("max_new_tokens", "batch")) -> DataFrame:
    """(id, output, error) of items (id, prompt, and the columns of their batch): infer is called with a batch's prompts, and with halves
    of it where it fails. A batch is bounded by its number and budget."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = list(zip(pdf["id"], pdf["prompt"]))
        got = split_on_failure(pairs, lambda part: [(i, o, None) for (i, _), o in zip(part, infer([p for _, p in part]), strict=True)], lambda x, e: (x[0], None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(got, columns=["id", "output", "error"])

    return batched.select("id", "prompt", *columns).groupBy(*columns).applyInPandas(run, "id long, output string, error string")


def batches_of(sizes: list[int], new: int, most: int, budget: int, batch: int = 0, n: int = 0) -> list[int]:
    """The batch number of each prompt of an ascending list: a batch ends where one more prompt would exceed the number or the budget.
    batch, n: the open batch and how many prompts it has, where the list goes on from another."""
    out = []
    for s in sizes:
        if n and (n + 1 > most or (s + new) * (n + 1) > budget):
            batch, n = batch + 1, 0
        out.append(batch)
        n += 1
    return out


def batches_after(size: float, count: int, new: int, most: int, budget: int, batch: int = 0, n: int = 0) -> tuple[int, int]:
    """The open batch and its number of prompts after `count` more prompts of one size, as batches_of would leave them;
    a size that is not a number is bound by `most` alone."""
    cap = max(1, min(most, budget // (size + new)) if size + new > 0 else most)
    left = count - max(cap - n, 0)
    if left <= 0:
        return batch, n + count
    opened = -(-left // cap)
    return batch + opened, left - (opened - 1) * cap


def micro_batches(items: DataFrame, most: int, budget: int, chunk: int = 4096) -> DataFrame:
    """items (id, prompt_tokens, max_new_tokens) with part and batch. The list of each output limit, by (prompt_tokens, id), is batched
    as one; batch counts through it. So that it doesn't meet in one task, it is cut into parts, ranges of about `chunk` items, more
    where that would be over ranks.MOST_RANGES. An open batch goes on into the next part: it depends on how many prompts of which size come
    before, so one task an output limit follows the counts by part and size, and hands each part the batch that it starts with.
    Null sizes and ids come last. Rows without an output limit have null part and batch."""
    columns = ["id", "prompt_tokens", "max_new_tokens"]
    unbounded = items.select(*columns).where("max_new_tokens is null").withColumns({"part": F.lit(None).cast("int"), "batch": F.lit(None).cast("int")})
    items = items.select(*columns).where("max_new_tokens is not null")
    order = {"_limit": F.col("max_new_tokens"), "_size": F.coalesce("prompt_tokens", F.lit(2**31 - 1)), "_id": F.coalesce("id", F.lit(2**63 - 1))}
    n = items.count()
    dealt = ranks.ranged(items.withColumns(order), [*order], -(-n // chunk), n, "part").drop(*order)

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        new, batch, n, out = int(pdf["max_new_tokens"].iloc[0]), 0, 0, {}
        for part, size, count in pdf.sort_values(["part", "prompt_tokens"])[["part", "prompt_tokens", "count"]].itertuples(index=False):
            out.setdefault(part, (new, part, batch, n))
            batch, n = batches_after(size, int(count), new, most, budget, batch, n)
        return pd.DataFrame(out.values(), columns=["max_new_tokens", "part", "_batch", "_n"])

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["prompt_tokens", "id"])
        new, batch, n = (int(pdf[c].iloc[0]) for c in ("max_new_tokens", "_batch", "_n"))
        pdf["batch"] = batches_of(pdf["prompt_tokens"].tolist(), new, most, budget, batch, n)
        return pdf[["id", "prompt_tokens", "max_new_tokens", "part", "batch"]]

    begin = dealt.groupBy("max_new_tokens", "part", "prompt_tokens").count().groupBy("max_new_tokens").applyInPandas(starts, "max_new_tokens int, part int, _batch int, _n int")
    cut_ = dealt.join(begin, ["max_new_tokens", "part"]).groupBy("max_new_tokens", "part").applyInPandas(cut, "id long, prompt_tokens int, max_new_tokens int, part int, batch int")
    return cut_.unionByName(unbounded)
