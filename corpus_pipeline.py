"""A corpus from raw documents to shuffled token shards: each stage calls one operator of tarn.llm on all that the stage before kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import binout, decontam, mixing, ngram_join, toxicity
from tarn.llm.common import lasting, recorded, remove, scratch, trim_memory

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_SCRATCH: list[str] = []  # of the stages before
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS = 4000  # of a batch: an executor's tasks hold their batches of whole texts twice, in the JVM and in Python


def staged(stage: Stage) -> Stage:
    """The stage, which first drops what the stages before had written for themselves: their results are written by then, as a stage's docs
    are the written result of the one before. What docs itself reads stays. Arrow batches of more than ROWS rows are made smaller, from then on in the session."""

    @functools.wraps(stage)
    def run_(spark: SparkSession, docs: DataFrame, sf_dir: str, *more) -> DataFrame:
        read = docs.inputFiles() if _SCRATCH else []
        for path in [p for p in _SCRATCH if not any(p.rpartition("/")[2] in f for f in read)]:
            remove(spark, path)
            _SCRATCH.remove(path)
        if not 0 < int(spark.conf.get(BATCH)) <= ROWS:
            spark.conf.set(BATCH, ROWS)
        with recorded() as paths:
            out = stage(spark, docs, sf_dir, *more)
        _SCRATCH.extend(paths)
        trim_memory()  # of the driver, which goes on
        return out

    return run_


@staged
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of documents not held out, predicts to be toxic go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted(docs, model)


@staged
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at a similarity of 0.8 or more, the one with the smallest doc_id stays."""
    return ngram_join.representatives(docs, k=5, percent=80)


@staged
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of whose words at least a twentieth lies in 13-word windows of benchmark items."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@staged
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: weights 5, 2, 1 by source, 150% of all words, at most 2 epochs."""
    return mixing.repeated(docs)


@staged
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, place: str | None = None) -> DataFrame:
    """Token shards in training order; the index of documents' parts in sequences is returned."""
    return binout.materialise(docs, place, stable=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_shards", write_tokens),
]

#: A trained classifier and hashing of whole texts; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, place: str | None = None) -> DataFrame:
    """All stages in turn, each written to the shared folder, read again by the next one and then dropped. The shards and their index stay, in the folders
    shards and index of place, a URI; without one, of a new folder below tarn.output.dir, or else the shared folder."""
    at, place = f"{sf_dir}/documents.parquet", place or lasting(spark, "corpus")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        out = scratch(spark, name)
        stage(spark, spark.read.parquet(at), sf_dir).write.parquet(out)
        if k:
            remove(spark, at)
        at = out
    write_tokens(spark, spark.read.parquet(at), sf_dir, f"{place}/shards").write.parquet(f"{place}/index")
    remove(spark, at)
    return spark.read.parquet(f"{place}/index")
