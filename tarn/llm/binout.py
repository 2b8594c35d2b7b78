"""Operator 9, token-ID / binary output: training-order materialisation by a keyed Feistel permutation.

Documents' tokens, each document closed by an end token, form a stream per input partition, cut into sequences of a
fixed stride (a partition's last one is padded). A first pass counts each partition's sequences, so every sequence
has an ordinal; the permutation (cycle-walking keeps it within the number of sequences) gives its global slot. Slots
fall into shards by range; each shard is one file of fixed-stride records, so slot s is at byte (s mod shard) *
stride * 2 of file s // shard, and a reader resumes at any slot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, lasting, mix, trim_memory, written
from .tokens import counter, slices, vocabulary_path

END, PAD = 2, 0  # </s>, <unk>
SLICE = 3 << 20  # bytes of text that are encoded at once


def permute(x: np.ndarray, size: int, key: int, rounds: int = 4) -> np.ndarray:
    """A keyed bijection of range(size)."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    low = U64((1 << half) - 1)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> U64(half), v & low
        for r in range(rounds):
            left, right = right, left ^ mix(right, key * 31 + r) >> U64(17) & low
        return left << U64(half) | right

    out = once(x.astype(U64))
    while (outside := np.flatnonzero(out >= U64(size))).size:  # walk the cycle until it is back within the range
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def _streams(batches, model: str):
    """Per slice of an input batch: doc ids, the documents' tokens end to end, each with its end token, and how many each has."""
    c = counter(model)
    for b in batches:
        at = 0
        for texts in slices(b.column("text"), SLICE):
            body, n = c.encode_column(texts)
            ends = np.cumsum(n + 1)
            flat = np.full(len(body) + len(n), END, np.uint16)
            inner = np.ones(len(flat), bool)
            inner[ends - 1] = False
            flat[inner] = body
            del body, inner
            yield b.column("doc_id").slice(at, len(texts)), flat, n + 1
            at += len(texts)
            del flat
            trim_memory()
    c.forget_ids()


_BLOCK = "shard int, slots binary, data binary, docs binary"
_INDEX = "doc_id long, slot long, at int, n_tokens int, shard int, sha256 string"


def materialise(docs: DataFrame, place: str | None = None, stride: int = 2048, shard: int = 1024, key: int = 20240607, model_file: str | None = None, stable: bool = False) -> DataFrame:
    """Writes the shards below place and returns the index: a row for each document's part in a sequence, with doc_id,
    slot, at (the first token's place in the sequence), n_tokens (with the end token), shard, and sha256 of the sequence.
    place is a URI. Without one, the shards go to a new folder below tarn.output.dir, or else the shared folder, and stay
    there when the driver ends. shards_of tells the place from the index, also when that was written as Parquet and read again.

    Null and empty texts have an end token only. Rows that repeat are written as often. A null doc_id is null in
    the index. An empty table gives no rows and no shards. Other columns aren't read. Token ids are 16-bit words.

    stable: docs is read from files as they stand, so that both passes see the same partitions; else it is written out first.
    A pass that finds other tokens in a partition than the first one fails. Tasks may be repeated: a shard's file is written under another name and moved.
    """
    import zstandard

    spark, model = docs.sparkSession, model_file or vocabulary_path()
    place = place or lasting(spark, "shards")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not stable:
        plain = written(plain, "stream")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, check = 0, 0
        c = counter(model)
        for b in batches:
            at = 0
            for texts in slices(b.column("text"), SLICE):
                n += int((c.encode_column(texts, sizes_only=True)[1] + 1).sum())
                check = (check * 1_000_003 + sum(b.column("doc_id").slice(at, len(texts)).drop_null().to_pylist()) + n) % (1 << 61)
                at += len(texts)
                trim_memory()
        c.forget_ids()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64()), pa.array([check], pa.int64())], ["part", "n", "check"])

    parts = sorted(map(tuple, plain.mapInArrow(count, "part int, n long, check long").collect()))  # a row for each partition
    base, total = {}, 0
    for part, n, check in parts:
        base[part] = (total, n, check)
        total += -(-n // stride)
    known = spark.sparkContext.broadcast(base)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ordinal, n_part, check = known.value.get(part, (0, 0, 0))
        rest, rest_docs, seen, sum_ = np.empty(0, np.uint16), [], 0, 0
        press = zstandard.ZstdCompressor(level=3)

        def blocks(flat: np.ndarray, spans: list, ordinal: int):
            """flat: whole sequences; spans: (doc_id, valid, first, last + 1) in flat."""
            n = len(flat) // stride
            slots = permute(np.arange(ordinal, ordinal + n), total, key)
            d = np.array(spans, np.int64).reshape(-1, 4)
            first, last = d[:, 2] // stride, (d[:, 3] - 1) // stride
            times = last - first + 1
            row = np.repeat(np.arange(len(d)), times)
            seq = first[row] + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            start = np.maximum(d[row, 2], seq * stride)
            pieces = np.stack([d[row, 0], d[row, 1], seq, start - seq * stride, np.minimum(d[row, 3], (seq + 1) * stride) - start], 1)
            shards = slots // shard
            order = np.argsort(slots)
            rank = np.empty(n, np.int64)
            table = flat.reshape(n, stride)
            out = []
            by_seq = np.searchsorted(pieces[:, 2], np.arange(n + 1))  # pieces are in the order of sequences
            cut = np.flatnonzero(np.concatenate([[True], np.diff(shards[order]) > 0, [True]]))
            for i, j in zip(cut[:-1], cut[1:]):
                own = order[i:j]
                rank[own] = np.arange(len(own))
                mine = np.concatenate([pieces[by_seq[k] : by_seq[k + 1]] for k in own])
                mine[:, 2] = slots[mine[:, 2]]
                out.append((int(shards[own[0]]), slots[own].tobytes(), press.compress(table[own].tobytes()), press.compress(mine.tobytes())))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["shard", "slots", "data", "docs"])

        for ids, flat, sizes in _streams(batches, model):
            seen += len(flat)
            sum_ = (sum_ * 1_000_003 + sum(ids.drop_null().to_pylist()) + seen) % (1 << 61)
            flat = np.concatenate([rest, flat])
            ends = len(rest) + np.cumsum(sizes)
            valid = np.array(ids.is_valid()).astype(np.int64)
            spans = rest_docs + [x for x in zip(ids.fill_null(0).to_pylist(), valid.tolist(), (ends - sizes).tolist(), ends.tolist())]
            whole = len(flat) // stride * stride
            if whole:
                yield blocks(flat[:whole], [(d, v, i, min(j, whole)) for d, v, i, j in spans if i < whole], ordinal)
                ordinal += whole // stride
            rest, rest_docs = flat[whole:].copy(), [(d, v, max(i - whole, 0), j - whole) for d, v, i, j in spans if j > whole]
        if seen and (seen, sum_) != (n_part, check):
            raise RuntimeError(f"partition {part} has other rows than when its sequences were counted")
        if len(rest):
            yield blocks(np.concatenate([rest, np.full(stride - len(rest), PAD, np.uint16)]), rest_docs, ordinal)

    def write(key, table):
        return _write_shard(int(key[0].as_py()), table, place, stride, shard, total)

    return plain.mapInArrow(deal, _BLOCK).groupBy("shard").applyInArrow(write, _INDEX).withMetadata("shard", {"place": place})


def shards_of(index: DataFrame) -> str:
    """The folder of an index's shards."""
    return index.schema["shard"].metadata["place"]


def file_system(place: str):
    """A place's file system and its path there. Names that only Hadoop knows a store by are given the ones that Arrow knows."""
    from pyarrow import fs

    for theirs, ours in (("s3a://", "s3://"), ("s3n://", "s3://"), ("wasbs://", "abfss://"), ("dbfs:/", "file:///dbfs/")):
        if place.startswith(theirs):
            place = ours + place[len(theirs) :].lstrip("/")
    return fs.FileSystem.from_uri(place)


def _write_shard(number: int, table: pa.Table, place: str, stride: int, shard: int, total: int) -> pa.Table:
    import uuid

    import zstandard

    press = zstandard.ZstdDecompressor()
    n = min(shard, total - number * shard)
    out, filled, docs = np.zeros((n, stride), np.uint16), 0, []
    for slots, data, own in zip(*[table.column(c).to_pylist() for c in ("slots", "data", "docs")]):
        at = np.frombuffer(slots, np.int64) - number * shard
        out[at] = np.frombuffer(press.decompress(data), np.uint16).reshape(-1, stride)
        filled += len(at)
        docs.append(np.frombuffer(press.decompress(own), np.int64).reshape(-1, 5))
    if filled != n:
        raise RuntimeError(f"shard {number} has {filled} of {n} sequences")
    files, root = file_system(place)
    files.create_dir(root, recursive=True)
    name = f"{root}/shard-{number:08d}.bin"
    with files.open_output_stream(temporary := f"{name}.{uuid.uuid4().hex}") as f:
        f.write(out)
    try:
        files.move(temporary, name)
    except OSError:  # a file system that moves onto no file: an earlier run of this task has written the same one
        if files.get_file_info(name).size != out.nbytes:
            raise
        files.delete_file(temporary)
    sha = np.array([hashlib.sha256(x.tobytes()).hexdigest() for x in out])
    d = np.concatenate(docs)
    return pa.table({
        "doc_id": pa.array(d[:, 0], pa.int64(), mask=d[:, 1] == 0), "slot": pa.array(d[:, 2]), "at": pa.array(d[:, 3].astype(np.int32)),
        "n_tokens": pa.array(d[:, 4].astype(np.int32)), "shard": pa.array(np.full(len(d), number, np.int32)), "sha256": pa.array(sha[d[:, 2] - number * shard]),
    })


def read_slots(place: str, first: int, n: int, stride: int = 2048, shard: int = 1024) -> np.ndarray:
    """Sequences first to first + n - 1, read where they stand."""
    files, root = file_system(place)
    out = []
    while n > 0:
        number, at = divmod(first, shard)
        take = min(n, shard - at)
        with files.open_input_file(f"{root}/shard-{number:08d}.bin") as f:
            f.seek(at * stride * 2)
            raw = f.read(take * stride * 2)
        out.append(np.frombuffer(raw, np.uint16).reshape(-1, stride))
        if len(out[-1]) < take:
            break
        first, n = first + take, n - take
    return np.concatenate(out) if out else np.empty((0, stride), np.uint16)


def op9(docs: DataFrame) -> DataFrame:
    return materialise(docs, stable=True)
