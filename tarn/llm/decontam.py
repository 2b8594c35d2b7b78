"""Operator 6, benchmark decontamination: one Aho-Corasick automaton over the items' windows of normalised words.

The automaton's symbols are words: a document becomes a sequence of word numbers (0 for words of no item) that is
scanned once. Normalising keeps byte offsets, so hits map back to the original text.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import null_text, slices, trim_memory, written

#: Bytes of a UTF-8 text: A-Z lower-cased, ASCII other than letters and digits to space.
TABLE = bytes(ord(chr(b).lower()) if chr(b).isalpha() and b < 128 else b if b > 127 or chr(b).isdigit() else 32 for b in range(256))
MOST_BYTES = 64 << 20
ROWS = 4000  # of a batch that are worked on at once


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TABLE).split()


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


class Scanner:
    """Finds every occurrence of every window of `size` consecutive words of an item; shorter items are one window."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int = 13):
        import ahocorasick

        self.vocabulary, windows = _Vocabulary(), {}
        for name, text in items:
            w = tuple([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words_of(text)])
            for i in range(max(1, len(w) - size + 1) if w else 0):
                windows.setdefault(w[i : i + size], set()).add(name)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, names in windows.items():
            self.automaton.add_word(window, (len(window), frozenset(names - {None})))
        self.empty = not windows
        if windows:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """The number of words, the runs of hit words as (first, last + 1), and the items."""
        words = words_of(text)
        runs: list[tuple[int, int]] = []
        items: set[str] = set()
        if self.empty or not words:
            return len(words), runs, items
        for end, (size, names) in self.automaton.iter(tuple(map(self.vocabulary.__getitem__, words))):
            start, end = end - size + 1, end + 1
            items |= names
            while runs and runs[-1][1] >= start:
                start = min(start, runs.pop()[0])
            runs.append((start, end))
        return len(words), runs, items

    @staticmethod
    def spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Runs of words as character offsets (first, last + 1) of the original text."""
        raw = text.encode("utf-8", "replace")
        at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(TABLE))]
        edges = [x for i, j in sorted(runs) for x in (at[i][0], at[j - 1][1])]  # ascending, as runs don't overlap
        chars, done, found = 0, 0, []
        for e in edges:
            chars += len(raw[done:e].decode("utf-8", "replace"))
            done = e
            found.append(chars)
        return list(zip(found[::2], found[1::2]))


_BUILT: dict[str, Scanner] = {}


def _scanner(name: str, items: list[tuple[str | None, str | None]], size: int) -> Scanner:
    """A worker keeps the last scanner, if it is small, for its next tasks."""
    if name in _BUILT:
        return _BUILT[name]
    _BUILT.clear()
    scanner = Scanner(items, size)
    if sum(len(t or "") for _, t in items) <= 4 << 20:
        _BUILT[name] = scanner
    return scanner


def load_items(items: DataFrame, part: int = 0, parts: int = 1) -> list[tuple[str | None, str | None]]:
    """One of the parts of the benchmark that a hash of the items makes, for broadcasting."""
    plain = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    own = plain if parts == 1 else plain.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
    return [tuple(r) for r in own.collect()]


def joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs in any order as the fewest that cover the same words, as scan gives them."""
    out: list[tuple[int, int]] = []
    for i, j in sorted(runs):
        if out and out[-1][1] >= i:
            out[-1] = (out[-1][0], max(out[-1][1], j))
        else:
            out.append((i, j))
    return out


def _scanned(docs: DataFrame, items: DataFrame, size: int, most_bytes: int | None) -> tuple[DataFrame, object]:
    """docs, and what gives (number of words, runs, items) of each row of one of its batches. Of a benchmark of more than most_bytes,
    all parts but the last, of about so many bytes each, are scanned before, one by one; docs is written with their hits each time."""
    spark, most = docs.sparkSession, most_bytes or MOST_BYTES
    total = items.agg(F.sum(F.octet_length(null_text()))).first()[0] or 0
    parts = max(1, -(-total // most))

    def scans(part: int):
        known = spark.sparkContext.broadcast(load_items(items, part, parts))
        before, name = part > 0, uuid.uuid4().hex

        def of(batches):
            scanner = _scanner(name, known.value, size)
            for b in slices(batches, ROWS):
                found = [scanner.scan(t.as_py()) for t in b.column("text")]
                if before:
                    old = zip(b.column("__hit_runs").to_pylist(), b.column("__hit_items").to_pylist())
                    found = [(n, joined([*runs, *zip(r[::2], r[1::2])]), names | set(i)) for (n, runs, names), (r, i) in zip(found, old)]
                yield b, found
                del found
                trim_memory()

        return of

    for part in range(parts - 1):
        own, columns = scans(part), [c for c in docs.columns if c not in ("__hit_runs", "__hit_items")]

        def run(batches: Iterator[pa.RecordBatch], own=own, columns=columns) -> Iterator[pa.RecordBatch]:
            for b, found in own(batches):
                hits = [pa.array([[x for r in runs for x in r] for _, runs, _ in found], pa.list_(pa.int32())), pa.array([sorted(x) for _, _, x in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], *hits], [*columns, "__hit_runs", "__hit_items"])

        schema = StructType([*[docs.schema[c] for c in columns], StructField("__hit_runs", ArrayType(IntegerType())), StructField("__hit_items", ArrayType(StringType()))])
        docs = written(docs.mapInArrow(run, schema), "hits")
    return docs, scans(parts - 1)


def contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def find_items(docs: DataFrame, items: DataFrame, size: int = 13, most_bytes: int | None = None, spans: bool = True) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_hit, items (sorted as strings), spans (of characters,
    in the original text; null where spans aren't asked for), contaminated.

    A word is hit if it lies in any occurrence of a window of an item. Null, empty and wordless texts have no words and
    aren't contaminated; an item without words has no window, and an empty benchmark hits nothing. Items without an
    id hit but aren't listed; an id is listed once. Rows are independent; other columns aren't read.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plain, scans = _scanned(plain, items, size, most_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in scans(batches):
            hit = [sum(j - i for i, j in runs) for _, runs, _ in found]
            at = [[{"start": i, "end": j} for i, j in Scanner.spans(t.as_py(), runs)] if runs else [] for t, (_, runs, _) in zip(b.column("text"), found)] if spans else [None] * len(found)
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array([n for n, _, _ in found], pa.int64()), pa.array(hit, pa.int64()),
                pa.array([sorted(x) for _, _, x in found], pa.list_(pa.string())),
                pa.array(at, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                pa.array([contaminated(n, h) for (n, _, _), h in zip(found, hit)], pa.bool_()),
            ], ["doc_id", "n_words", "n_hit", "items", "spans", "contaminated"])

    return plain.mapInArrow(run, "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start: int, end: int>>, contaminated boolean")


def decontaminated(docs: DataFrame, items: DataFrame, size: int = 13, most_bytes: int | None = None) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns; nothing is shuffled."""
    columns, schema = docs.columns, docs.schema
    docs, scans = _scanned(docs, items, size, most_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in scans(batches):
            yield b.select(columns).filter(pa.array([not contaminated(n, sum(j - i for i, j in runs)) for n, runs, _ in found], pa.bool_()))

    return docs.mapInArrow(run, schema)


def op6(docs: DataFrame, items: DataFrame) -> DataFrame:
    joined = F.array_join("items", ",")
    return find_items(docs, items, spans=False).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), "contaminated")


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
