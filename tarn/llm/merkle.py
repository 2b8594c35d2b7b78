"""Operator 12, a Merkle manifest of a dataset: a tree of 16 children for each source, one over the sources, and a proof for every row.

Rows get their place within their source by sums over ranges (operators.ranks), so that no source is sorted by one task. Aligned blocks of
16 ** 3 leaves are climbed one by one; block roots are the leaves of the next round, until each source has one node, and those are the leaves of
the tree over all sources. On the way down a block is walked leaf by leaf: stacks of treehash build the next run of each level while the present
one is in use, so that the authentication path moves on with 16 nodes and a stack for each level; what lies above the block is the same for all
its leaves and is appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import before
from .common import join_small, written

FAN = 16
LEVELS = 3  # of a block
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
Path = list[tuple[str, str]]  # level by level, the siblings to the left and to the right, joined


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(n: int) -> int:
    """How often n nodes are combined until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


class Treehash:
    """Takes leaves one after the other and combines full runs at once: holds fewer than FAN nodes of each level below its own."""

    def __init__(self, level: int):
        self.stack: list[list[str]] = [[] for _ in range(level + 1)]

    def push(self, leaf: str) -> None:
        level, node = 0, leaf
        while True:
            self.stack[level].append(node)
            if level == len(self.stack) - 1 or len(self.stack[level]) < FAN:
                return
            node, self.stack[level], level = digest("".join(self.stack[level])), [], level + 1

    def take(self) -> list[str]:
        """The nodes of its own level; what is left below, at the end of the leaves, is combined as it is."""
        for level, nodes in enumerate(self.stack[:-1]):
            if nodes:
                self.stack[level + 1].append(digest("".join(nodes)))
                self.stack[level] = []
        nodes, self.stack[-1] = self.stack[-1], []
        return nodes


def top(leaves: Sequence[str], levels: int) -> str:
    """The node so many levels above all the leaves."""
    t = Treehash(levels)
    for x in leaves:
        t.push(x)
    return t.take()[0]


def paths(leaves: Sequence[str], levels: int) -> Iterator[Path]:
    """The path of each leaf in turn, as far as so many levels up, from stacks that are one run ahead."""
    spans = [FAN ** (h + 1) for h in range(levels)]
    ahead = [Treehash(h) for h in range(levels)]
    runs = []
    for span, t in zip(spans, ahead):
        for x in leaves[:span]:
            t.push(x)
        runs.append(t.take())
    for i in range(len(leaves)):
        path = []
        for h, run in enumerate(runs):
            at = i // FAN**h % FAN
            path.append(("".join(run[:at]), "".join(run[at + 1 :])))
        yield path
        for h, (span, t) in enumerate(zip(spans, ahead)):
            if i + span < len(leaves):
                t.push(leaves[i + span])
            if (i + 1) % span == 0:
                runs[h] = t.take()


def fold(leaf: str, path: Path) -> str:
    """The root that a leaf and the siblings on its path give."""
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


def field(c: Column) -> Column:
    """- for null, else the byte count of the value, a colon and the value."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(**other: Column) -> Column:
    return F.sha2(F.concat(*[field(other.get(c, F.col(c))) for c in FIELDS]).cast("binary"), 256)


_PATH = "array<struct<left: string, right: string>>"


def _blocks(nodes: DataFrame, tree: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A row for each block of nodes (tree, order, node): tree, block, levels that it is climbed, rest (nodes of the tree in the next round), and
    members, an array of (at, node and all other columns), in order; at most BLOCK of them."""
    ranked = before(nodes, tree, [*order, "node"], {"_at": "1L"}, {"_n": "_at"}, rows_a_range=2 * BLOCK)
    own = [c for c in nodes.columns if c not in tree]
    placed = ranked.withColumn("block", F.expr(f"_at div {BLOCK}"))
    grouped = placed.groupBy(*tree, "block").agg(F.array_sort(F.collect_list(F.struct(F.col("_at").alias("at"), *own))).alias("members"), F.max("_n").alias("n"))
    levels = F.lit(0)
    for h in range(LEVELS):
        levels = levels + (F.col("n") > FAN**h).cast("int")
    return grouped.select(*tree, "block", levels.alias("levels"), F.ceil(F.col("n") / BLOCK).cast("long").alias("rest"), "members")


def _tops(blocks: DataFrame, tree: Sequence[str]) -> DataFrame:
    """(tree, at, rest, node) of the node on top of each block."""
    kept = [*tree, "block", "rest"]
    schema = ", ".join([*[f"`{c}` {blocks.schema[c].dataType.simpleString()}" for c in kept], "node string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = [top([m["node"] for m in ms.as_py()], levels.as_py()) for ms, levels in zip(b.column("members"), b.column("levels"))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(nodes, pa.string())], [*kept, "node"])

    slim = blocks.select(*kept, "levels", F.transform("members", lambda m: F.struct(m["node"].alias("node"))).alias("members"))
    return slim.mapInArrow(run, schema)


def _walked(blocks: DataFrame, above: DataFrame, tree: Sequence[str], own: Sequence[str], proofs: str | None = None) -> DataFrame:
    """Of every member of blocks its columns `own`, node and path, the whole one: its block's and what lies above it, of above (tree, at, up).
    proofs: a column of members, and what is given instead of path are folded_root, what this leaf, or else the node, and the path give, and proof_sha256."""
    same = " AND ".join(["l.block = r.at", *[f"l.`{c}` <=> r.`{c}`" for c in tree]])
    met = join_small(blocks.alias("l"), above.alias("r"), F.expr(same), limit=20_000).select(*[f"l.{c}" for c in [*tree, "levels", "members"]], "r.up")
    types = {f.name: f.dataType.simpleString() for f in blocks.schema["members"].dataType.elementType.fields}
    last = f"path {_PATH}" if proofs is None else "folded_root string, proof_sha256 string"
    schema = ", ".join([*[f"`{c}` {blocks.schema[c].dataType.simpleString()}" for c in tree], *[f"`{c}` {types[c]}" for c in own], "node string", last])
    names, path_type = [*own, "node"], pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i in ((b, i) for b in batches for i in range(b.num_rows)):
            ms, levels = b.column("members")[i].values, b.column("levels")[i].as_py()
            up = [(x["left"], x["right"]) for x in b.column("up")[i].as_py()]
            leaves, shared = ms.field("node").to_pylist(), "".join(x + y for x, y in up)
            walk = paths(leaves, levels)
            step = max(1, 4_000_000 // (levels * FAN * 64 + len(shared) + 64)) if proofs is None else BLOCK
            for at in range(0, len(leaves), step):
                part = ms.slice(at, step)
                trees = [pa.array([b.column(c)[i].as_py()] * len(part), b.schema.field(c).type) for c in tree]
                if proofs is None:
                    got = [[{"left": x, "right": y} for x, y in next(walk) + up] for _ in range(len(part))]
                    ends = {"path": pa.array(got, path_type)}
                else:
                    roots, digests = [], []
                    for leaf, own_leaf in zip(part.field("node").to_pylist(), part.field(proofs).to_pylist()):
                        path = next(walk)
                        roots.append(fold(own_leaf or leaf, path + up))
                        digests.append(digest("".join(x + y for x, y in path) + shared))
                    ends = {"folded_root": pa.array(roots, pa.string()), "proof_sha256": pa.array(digests, pa.string())}
                yield pa.RecordBatch.from_arrays([*trees, *[part.field(c) for c in names], *ends.values()], [*tree, *names, *ends])

    return met.mapInArrow(run, schema)


def _climbed(nodes: DataFrame, tree: Sequence[str], order: Sequence[str], name: str) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of blocks from the leaves up, and a row (tree, node) for each tree's last node."""
    rounds = []
    while True:
        blocks = written(_blocks(nodes, tree, order), f"{name}-blocks")
        rounds.append(blocks)
        tops = written(_tops(blocks, tree), f"{name}-tops")
        if tops.where("rest > 1").isEmpty():
            return rounds, tops.select(*tree, "node")
        nodes, order = tops.select(*tree, F.col("block").alias("place"), "node"), ["place"]


def _down(rounds: list[DataFrame], above: DataFrame, tree: Sequence[str], name: str, own: Sequence[str], proofs: str | None = None) -> DataFrame:
    """Of the first round's members what _walked gives with whole paths. above: (tree, up) of each tree's last node."""
    up = above.withColumn("at", F.lit(0).cast("long"))
    for blocks in reversed(rounds[1:]):
        up = written(_walked(blocks, up, tree, ["place"]).select(*tree, F.col("place").alias("at"), F.col("path").alias("up")), f"{name}-up")
    return _walked(rounds[0], up, tree, own, proofs)


def manifest(docs: DataFrame, claimed: Column | None = None, whole_paths: bool = True) -> DataFrame:
    """One row per row of docs (doc_id, source, lang, n_chars, text): doc_id, source, leaf, subroot, root, and path (the siblings, an array of left
    and right, level by level up to the root), with which fold checks a row. Or, without whole_paths, proof_sha256 of the siblings
    and folded_root, the root that the leaf `claimed` gives with the path, or, where that is null, the row's own leaf.

    Leaves are sha256 of the five fields, a null one as -, in order of doc_id within their source, a null doc_id first and rows that share
    an id by their leaf; a null source is a source, the first. Rows that repeat are leaves as often. Of a source with one row the leaf is the
    subroot, and of one source the subroot is the root; else a run of one node is combined too. Other columns aren't read. An empty table
    gives no rows. Values of other types are taken as their strings, but doc_id in its own order."""
    base = docs.select("doc_id", "source", leaf_of().alias("node"), (F.lit(None) if claimed is None else claimed).cast("string").alias("claimed"))
    rounds, subroots = _climbed(written(base, "leaves"), ["source"], ["doc_id"], "source")
    whole, roots = _climbed(subroots, [], ["source"], "all")
    none = roots.select(F.expr(f"cast(array() as {_PATH})").alias("up"))
    sources = written(_down(whole, none, [], "all", ["source"]).select("source", F.col("node").alias("subroot"), F.col("path").alias("up")), "sources")
    below = _down(rounds, sources.select("source", "up"), ["source"], "source", ["doc_id"], None if whole_paths else "claimed")
    met = join_small(below.alias("l"), sources.select("source", "subroot").alias("r"), F.expr("l.source <=> r.source")).select("l.*", "r.subroot")
    last = ["path"] if whole_paths else ["folded_root", "proof_sha256"]
    return met.join(F.broadcast(roots.select(F.col("node").alias("root")))).select("doc_id", "source", F.col("node").alias("leaf"), "subroot", "root", *last)


def op12(docs: DataFrame) -> DataFrame:
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    proofs = manifest(docs, F.when(tampered, leaf_of(text=F.translate(F.col("text").cast("string"), upper, lower))), whole_paths=False)
    return proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _level_sql(nodes: str, tree: str, up: int) -> str:
    """Nodes (tree, pos, h, n, node) so many levels up: n the tree's nodes there; a tree with one node stays."""
    return f"""{nodes}{up + 1} AS (SELECT {tree}, pos // 16 AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h,
 (any_value(n) + 15) // 16 AS n, any_value(n) > 1 AS moved FROM {nodes}{up} GROUP BY {tree}, pos // 16)"""


def _sql(levels: int = 5, over: int = 3) -> str:
    """SQL for trees of up to 16 ** levels leaves by source and 16 ** over sources. A level's siblings come by joins with the row's place at that level."""
    enc = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    leaf = lambda text: f"sha256({' || '.join(enc(c) if c != 'text' else enc(text) for c in FIELDS)})"
    crc = "list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda ch: list_concat([ascii(ch)::bigint], [-1::bigint, -1, -1, -1, -1, -1, -1, -1])))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    lowered = f"translate(text, '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')"
    ctes = [
        f"d AS (SELECT doc_id, source, {leaf('text')} AS h, CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {leaf(lowered)} ELSE {leaf('text')} END AS claimed FROM documents)",
        "a0 AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, h, count(*) OVER (PARTITION BY source) AS n, doc_id, claimed FROM d)",
        *[_level_sql("a", "source", k) for k in range(levels)],
        f"b0 AS (SELECT 0 AS t, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, h, count(*) OVER () AS n, source FROM a{levels})",
        *[_level_sql("b", "t", k) for k in range(over)],
        "p0 AS (SELECT doc_id, source, pos, h AS leaf, claimed AS f, '' AS proof FROM a0)",
    ]

    def side(nodes: str, k: int, before_: bool) -> str:
        return f"coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos {'<' if before_ else '>'} r.pos), '')"

    def step(name: str, prior: str, nodes: str, tree: str, k: int, kept: str) -> str:
        left, right = side(nodes, k, True), side(nodes, k, False)
        return f"""{name} AS (SELECT {kept}, r.pos // 16 AS pos, CASE WHEN any_value(s.n) > 1 THEN sha256({left} || any_value(r.f) || {right}) ELSE any_value(r.f) END AS f,
 CASE WHEN any_value(s.n) > 1 THEN any_value(r.proof) || {left} || {right} ELSE any_value(r.proof) END AS proof
 FROM {prior} r JOIN {nodes}{k} s ON {tree} AND s.pos // 16 = r.pos // 16 GROUP BY {kept}, r.pos)"""

    for k in range(levels):
        ctes.append(step(f"p{k + 1}", f"p{k}", "a", "s.source IS NOT DISTINCT FROM r.source", k, "r.doc_id, r.source, r.leaf"))
    ctes.append(f"q0 AS (SELECT p.doc_id, p.source, p.leaf, b.h AS subroot, b.pos, p.f, p.proof FROM p{levels} p JOIN b0 b ON b.source IS NOT DISTINCT FROM p.source)")
    for k in range(over):
        ctes.append(step(f"q{k + 1}", f"q{k}", "b", "true", k, "r.doc_id, r.source, r.leaf, r.subroot"))
    return f"WITH {', '.join(ctes)} SELECT q.doc_id, q.leaf, q.subroot, b.h AS root, sha256(q.proof) AS proof_sha256, q.f AS folded_root, q.f = b.h AS verified FROM q{over} q, b{over} b"


SQL = _sql()
