"""Operator 13, ranked lexical search over a tiered index: postings of high impact first, and a bound for what each term has left.

The index has a row for each block of documents, with the postings of each of three tiers in columns of its own, so that a search of the first
tiers doesn't read the others. A term's postings go to tiers by their impact: the FIRST highest to the first tier, the next up to SECOND to the second
tier, all others to the last one; the largest impact that a tier and those before it lack is the term's residual. An item is searched
in the first tier. Where the residuals of its terms, summed, stay below the 20th best sum that was found, no document outside can enter, and
documents whose sum with the residuals of the terms not seen in them could still enter are looked up in all tiers, which gives exact scores. Items
for which this doesn't prove the result go on to the second tier, and at last to all tiers, where residuals are nil.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_small, null_text, scratch, slices, trim_memory, written

FIRST, SECOND = 2048, 65536  # postings of a term in the first tier, and in the first two, at most
TIERS = 3
WIDTH = 1024  # of a bucket of impacts, by which the tiers are cut
DOCS, POSTINGS = 8192, 2_000_000  # of a block, at most, but for a single document
CANDIDATES = 4096  # documents that are looked up for an item; an item with more goes on to the next tier
MOST_BYTES = 16 << 20  # of the text of items searched at once
_PIECE = 8 << 20
#: Digits, letters and all that isn't ASCII stay, capitals become small, the rest is blank.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of some megabytes."""
    text, at = text.translate(_TABLE), 0
    while at < len(text):
        end = at + _PIECE
        if end < len(text):
            cut = text.rfind(b" ", at, end)
            end = cut if cut >= 0 else text.find(b" ", end)
            end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end + 1


class Items(NamedTuple):
    """Items (id, [(term, times)]), and the terms' numbers from 1 on."""

    items: list[tuple[object, list[tuple[int, int]]]]
    terms: dict[bytes, int]


def load_items(items: DataFrame, part: int = 0, parts: int = 1) -> Items:
    rows = items.select("item_id", null_text().alias("text"))
    if parts > 1:
        rows = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
    terms: dict[bytes, int] = {}
    found = []
    for name, text in rows.collect():
        counts = Counter(w for ws in words(text.encode()) for w in ws)
        if counts:
            found.append((name, [(terms.setdefault(w, len(terms) + 1), n) for w, n in sorted(counts.items())]))
    return Items(found, terms)


def forward(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, times) of each document with a term: n counts all its terms, repeats too; the arrays hold those asked for."""
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for b in slices(batches, 2048):
            ids, sizes, ends, found, times = [], [], [0], [], []
            for doc, text in zip(b.column("doc_id"), b.column("text").cast(pa.binary())):
                n, own = 0, []
                for ws in words(text.as_py() or b""):
                    n += len(ws)
                    own.append(np.array([*filter(None, map(get, ws))], np.int32))
                if n:
                    t, c = np.unique(np.concatenate(own), return_counts=True)
                    ids.append(doc.as_py())
                    sizes.append(n)
                    found.append(t)
                    times.append(c)
                    ends.append(ends[-1] + len(t))
            flat = [np.concatenate(x) if x else np.empty(0, int) for x in (found, times)]
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(flat[0].astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(flat[1].astype(np.int64)))], ["doc_id", "n", "terms", "times"])
        trim_memory()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n long, terms array<int>, times array<long>")


def impacts(sizes: Iterable[int], per_doc: np.ndarray, times: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a posting counts before its term's weight, by the sizes of the documents and how many postings each has."""
    m = np.array([75 + (25 * n * n_docs) // n_terms for n in sizes], np.int64)
    return (1_000_000_000 * times) // (1000 * times + 12 * np.repeat(m, per_doc))


def _lists(b: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """A column of arrays as (number by row, all elements)."""
    c = b.column(column)
    return np.diff(c.offsets.to_numpy()), c.flatten().to_numpy(zero_copy_only=False)


class Tiers(NamedTuple):
    """By number of a term: its weight, the least impact of the first and of the second tier, and what is left after each of them."""

    weight: np.ndarray
    cuts: np.ndarray
    residual: np.ndarray


def tiers(rows: DataFrame, n_docs: int, n_terms: int, most: int, first: int, second: int) -> Tiers:
    """From the counts of each term's impacts by bucket; only a row for each of the `most` terms comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            per_doc, terms = _lists(b, "terms")
            imps = impacts(b.column("n").to_pylist(), per_doc, _lists(b, "times")[1], n_docs, n_terms)
            order = np.lexsort((imps, terms))
            terms, imps = terms[order].astype(np.int64), imps[order]
            key = terms * (1 << 20) + imps // WIDTH
            last = np.flatnonzero(np.append(key[1:] != key[:-1], True)) if len(key) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(terms[last].astype(np.int32)), pa.array(imps[last] // WIDTH), pa.array(np.diff(last, prepend=-1)), pa.array(imps[last])], ["term", "bucket", "c", "top"])

    counts = rows.mapInArrow(run, "term int, bucket long, c long, top long").groupBy("term", "bucket").agg(F.sum("c").alias("c"), F.max("top").alias("top"))
    down = counts.withColumn("seen", F.sum("c").over(Window.partitionBy("term").orderBy(F.desc("bucket"))))
    cut = lambda size: F.min(F.when(F.col("seen") <= size, F.col("bucket") * WIDTH))
    left = lambda size: F.max(F.when(F.col("seen") > size, F.col("top")))
    t = Tiers(np.zeros(most + 1, np.int64), np.full((2, most + 1), 1 << 60, np.int64), np.zeros((TIERS, most + 1), np.int64))
    for r in down.groupBy("term").agg(F.sum("c").alias("df"), cut(first).alias("c1"), cut(second).alias("c2"), left(first).alias("r1"), left(second).alias("r2")).collect():
        t.weight[r.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
        for k, (c, x) in enumerate(((r.c1, r.r1), (r.c2, r.r2))):
            t.cuts[k, r.term] = t.cuts[k, r.term] if c is None else c
            t.residual[k, r.term] = x or 0
    return t


_COLUMNS = ("terms", "ends", "docs", "impacts")


def _index(rows: DataFrame, known, n_docs: int, n_terms: int) -> DataFrame:
    """A row for each block: block (its number), doc_ids, and by tier the terms, where the postings of each end, their documents (places in
    doc_ids) and impacts."""
    schema = "doc_ids array<long>, " + ", ".join(f"terms{k} array<int>, ends{k} array<int>, docs{k} array<smallint>, impacts{k} array<int>" for k in range(TIERS))
    kinds = (np.int32, np.int32, np.int16, np.int32)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, at = np.cumsum(_lists(b, "terms")[0]), 0
            while at < b.num_rows:
                to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + POSTINGS, "right"))
                to = max(at + 1, min(at + DOCS, to))
                yield b.slice(at, to - at)
                at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = known.value
        for b in cut(batches):
            per_doc, terms = _lists(b, "terms")
            imps = impacts(b.column("n").to_pylist(), per_doc, _lists(b, "times")[1], n_docs, n_terms)
            docs = np.repeat(np.arange(b.num_rows), per_doc)
            order = np.argsort(terms, kind="stable")
            terms, docs, imps = terms[order], docs[order], imps[order]
            tier = (imps < t.cuts[0][terms]).astype(np.int8) + (imps < t.cuts[1][terms])
            out = {"doc_ids": pa.array([b.column("doc_id").to_pylist()], pa.list_(pa.int64()))}
            for k in range(TIERS):
                own = tier == k
                mine = terms[own]
                last = np.flatnonzero(np.append(mine[1:] != mine[:-1], True)) if len(mine) else np.empty(0, np.int64)
                for name, values, kind in zip(_COLUMNS, (mine[last], last + 1, docs[own], imps[own]), kinds):
                    out[f"{name}{k}"] = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values.astype(kind)))
            yield pa.RecordBatch.from_arrays([*out.values()], [*out])

    return rows.mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id())


class Block:
    """One row of the index, as far as some tiers."""

    def __init__(self, b: pa.RecordBatch, row: int, upto: int, most: int):
        get = lambda c: b.column(c)[row].values
        self.ids, self.tiers = get("doc_ids"), []
        for k in range(upto + 1):
            terms, ends, docs, imps = (get(f"{c}{k}").to_numpy(zero_copy_only=False) for c in _COLUMNS)
            spans = np.zeros((2, most + 1), np.int64)
            spans[1][terms] = ends
            spans[0][terms] = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            self.tiers.append((spans, docs, imps))

    def sums(self, terms: np.ndarray, factor: np.ndarray, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each document the sum over the terms' postings here, and that sum less the residuals of the terms found."""
        low, open_ = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), np.int64)
        for spans, docs, imps in self.tiers:
            for i in np.flatnonzero(spans[1][terms] > spans[0][terms]):
                a, e = spans[:, terms[i]]
                d, x = docs[a:e], factor[i] * imps[a:e].astype(np.int64)
                low[d] += x
                open_[d] += x - residual[i]
        return low, open_


class Weighed(NamedTuple):
    """An item: its terms, weight by times of each, the residuals with that factor, and the sum of these."""

    terms: np.ndarray
    factor: np.ndarray
    residual: np.ndarray
    unseen: int


def _weighed(items: Items, t: Tiers, tier: int) -> list[Weighed]:
    out = []
    for _, own in items.items:
        terms, times = np.array([x for x, _ in own], np.int64), np.array([n for _, n in own], np.int64)
        factor = t.weight[terms] * times
        rest = factor * t.residual[tier][terms]
        out.append(Weighed(terms, factor, rest, int(rest.sum())))
    return out


def _best(scores: np.ndarray, ids: list, k: int) -> list[tuple[int, object]]:
    """The k highest scores above 0 with their ids, equal ones by id, null last."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    return sorted(((int(scores[i]), ids[i].as_py()) for i in at), key=_order)[:k]


def _order(x: tuple[int, object]) -> tuple:
    return -x[0], x[1] is None, x[1] or 0


_HIT = "item int, doc_id long, score long"


def _hits(rows: list[tuple[int, object, int]]) -> pa.RecordBatch:
    i, d, s = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(d, pa.int64()), pa.array(s, pa.int64())], ["item", "doc_id", "score"])


def _tops(index: DataFrame, asked, upto: int, most: int, k: int) -> DataFrame:
    """(item, doc_id, score): of each task the k highest sums of each item asked for, as far as the tier."""
    columns = ["doc_ids", *[f"{c}{i}" for i in range(upto + 1) for c in _COLUMNS]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        for b in batches:
            for row in range(b.num_rows):
                block = Block(b, row, upto, most)
                for i, w in asked.value.items():
                    low, _ = block.sums(w.terms, w.factor, w.residual)
                    best[i] = sorted([*best.get(i, ()), *_best(low, block.ids, k)], key=_order)[:k]
        if rows := [(i, d, s) for i, got in best.items() for s, d in got]:
            yield _hits(rows)

    return index.select(*columns).mapInArrow(run, _HIT)


def _first(rows: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _candidates(index: DataFrame, asked, upto: int, most: int) -> DataFrame:
    """(block, item, docs): the places of documents that could reach the item's least score."""
    columns = ["block", "doc_ids", *[f"{c}{i}" for i in range(upto + 1) for c in _COLUMNS]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row in range(b.num_rows):
                block = Block(b, row, upto, most)
                for i, (w, least) in asked.value.items():
                    low, open_ = block.sums(w.terms, w.factor, w.residual)
                    at = np.flatnonzero((low > 0) & (open_ + w.unseen >= least))
                    if len(at):
                        rows.append((b.column("block")[row].as_py(), i, at.tolist()))
            if rows:
                n, i, at = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(i, pa.int32()), pa.array(at, pa.list_(pa.int16()))], ["block", "item", "docs"])

    return index.select(*columns).mapInArrow(run, "block long, item int, docs array<smallint>")


def _looked_up(index: DataFrame, places: DataFrame, asked, most: int, k: int) -> DataFrame:
    """(item, doc_id, score): the exact scores of documents at these places, from all tiers, the k best of a block and item."""
    by_block = places.groupBy("block").agg(F.collect_list(F.struct("item", "docs")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row in range(b.num_rows):
                block = Block(b, row, TIERS - 1, most)
                for x in b.column("places")[row].as_py():
                    w, _ = asked.value[x["item"]]
                    score = block.sums(w.terms, w.factor, w.residual)[0]
                    mask = np.zeros(len(score), np.int64)
                    mask[x["docs"]] = score[x["docs"]]
                    rows += [(x["item"], d, s) for s, d in _best(mask, block.ids, k)]
            if rows:
                yield _hits(rows)

    return join_small(index, by_block, "block", limit=5_000).mapInArrow(run, _HIT)


class Index(NamedTuple):
    """Of documents, for some terms: rows, and what is known of the terms."""

    rows: DataFrame
    tiers: Tiers


def build(docs: DataFrame, terms: dict[bytes, int], first: int = FIRST, second: int = SECOND) -> Index | None:
    """The index of all rows of docs (doc_id, text) for the terms asked for; None where no document has a term."""
    spark = docs.sparkSession
    rows = written(forward(docs, terms), "forward")
    n_docs, n_terms = rows.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    t = tiers(rows, n_docs, n_terms, len(terms), first, second)
    return Index(written(_index(rows, spark.sparkContext.broadcast(t), n_docs, n_terms), "index"), t)


def ask(index: Index, items: Items, k: int = 20, candidates: int = CANDIDATES) -> tuple[list[DataFrame], list[int]]:
    """Parts of the result (item, its place in items, doc_id, score, rank), and of how many items each tier gave the result."""
    spark = index.rows.sparkSession
    most, cast = len(items.terms), spark.sparkContext.broadcast
    left, done, proven = range(len(items.items)), [], []
    for tier in range(TIERS):
        weighed, before = _weighed(items, index.tiers, tier), len(left)
        closed = cast({i: weighed[i] for i in left if not weighed[i].unseen})
        if closed.value:
            done.append(_first(_tops(index.rows, closed, tier, most, k), k))
        left = [i for i in left if weighed[i].unseen]
        if left:
            sums = _first(_tops(index.rows, cast({i: weighed[i] for i in left}), tier, most, k), k)
            least = {r[0]: r[1] for r in sums.where(F.col("rank") == k).select("item", "score").collect()}
            sure = cast({i: (weighed[i], least[i]) for i in left if weighed[i].unseen < least.get(i, 0)})
            if sure.value:
                places = written(_candidates(index.rows, sure, tier, most), "candidates")
                few = [r[0] for r in places.groupBy("item").agg(F.sum(F.size("docs")).alias("c")).where(F.col("c") <= candidates).select("item").collect()]
                done.append(_first(_looked_up(index.rows, places.where(F.col("item").isin(few)), sure, most, k), k))
                left = sorted({*left} - {*few})
        proven.append(before - len(left))
    return done, proven


def search(docs: DataFrame, items: DataFrame, k: int = 20, most_bytes: int = MOST_BYTES, first: int = FIRST, second: int = SECOND, candidates: int = CANDIDATES) -> DataFrame:
    """(item_id, rank, doc_id, score): of each row of items (item_id, text) the k highest-scoring rows of docs (doc_id, text) with a score above
    0, all where there are fewer; equal scores by doc_id, null last.

    Null and empty texts have no terms: such documents don't count, such items have no result. Rows that repeat are documents, and
    items, as often. The index is of all documents, for the terms of the items; of items of more than most_bytes in all, it is built
    and asked for parts of about that size. Other columns aren't read. Empty tables give no rows."""
    spark: SparkSession = docs.sparkSession
    parts = max(1, -(-(items.agg(F.sum(F.octet_length(null_text()))).first()[0] or 0) // most_bytes))
    out = scratch(spark, "found")
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long"
    spark.createDataFrame([], schema).write.parquet(out)
    for part in range(parts):
        asked = load_items(items, part, parts)
        index = build(docs, asked.terms, first, second) if asked.items else None
        if index is None:
            continue
        names = F.broadcast(spark.createDataFrame([(i, name) for i, (name, _) in enumerate(asked.items)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}"))
        for rows in ask(index, asked, k, candidates)[0]:
            rows.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score").write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


def op13(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)


SQL = rf"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all({{lower}}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::bigint AS n FROM tf GROUP BY doc_id),
g AS (SELECT count(*) AS docs, sum(n)::bigint AS terms FROM n),
m AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM n, g),
df AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint AS weight FROM tf, g GROUP BY term),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({{lower}}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint AS score
      FROM q JOIN df USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 20
""".replace("{lower}", f"translate(text, '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')")
