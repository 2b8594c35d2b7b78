"""Operator 3, n-gram Jaccard join by universe partition and pigeonhole.

Two sets that link differ in at most H elements. The universe of hashed shingles is cut into segments by a hash, as
many for each band of set sizes as the band's H asks; a set's subset in each segment is indexed. An equal subset is worth one
of the H + 1 differences that the pigeonhole needs, one that differs by at most one element (one side's subset or one of its
one-deletion neighbours equals the other's) is worth two.

Allocation by cost: for each band, equal subsets or one-deletion neighbourhoods, and how many segments more than needed
(the slack), whichever has the least rows of the index plus HARD for each set that the slack doesn't serve. Slack pays for what isn't
joined: empty subsets, which very many sets share. A set with more empty subsets than slack also indexes one-deletion
neighbourhoods of larger segments. Signatures of more than `dear` sets are joined only among the sets for which they, with the
empty ones, use up more than the slack: a pair found by no other signature has two such sets.

Rows of the index don't travel one by one: a map task sends, for each reduce partition, one block of signatures, and
sets that it has sent before aren't sent again. The sets of a signature meet, in blocks, with their sketches (a
bit for each of 1024 hash classes: whether the set has an odd number of elements there). Sketches that differ in more bits than linked
sets may in elements rule a link out, as each differing element changes one bit. A block gives each set's nearest set only, so
rows grow with the members and not with their pairs; these are compared in full, and joined into components. Then each set's nearest
set of another component, until at last what still lies apart and close is compared in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, BloomFilter, join_small, mix, null_text, partitions, stable_min_label, text_bytes, trim_memory, written

RATIO = 1.35  # of a band's largest to its smallest size
HARD = 1000  # index rows that a set is taken to cost which the slack doesn't serve
SKETCH = 16  # 64-bit words of a set's sketch
WIDE = 64  # and of the one for sets that are looked at again
BAND_BITS = 6  # a signature's low bits
BANDS = 8  # in which a set looks for partners, at most
ROWS = 4000  # of a batch that are worked on at once
BLOCK = 2048  # sets of a signature that meet in one group
SENT = 200_000  # sets that a map task remembers to have sent
PART_BYTES = 24 << 20  # of text for each reduce partition of the index


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, k: int, words: dict) -> np.ndarray:
    """The distinct 64-bit hashes of a text's k-word shingles, sorted; of fewer words, one for the whole sequence."""
    found = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: lower-cases A-Z, splits at ASCII space
    if not found:
        return np.empty(0, U64)
    w = np.fromiter(map(words.__getitem__, found), U64, len(found))
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, U64)
    for i in range(n):
        h = mix(h ^ w[i : len(w) - n + 1 + i])
    return np.unique(h)


def set_id(h: np.ndarray, seed: int = 0) -> int:
    """A set's 64-bit name, signed as Spark's long is. Equal sets share it; that others don't is checked by a second name."""
    return int(np.array(xxhash.xxh3_64_intdigest(h.tobytes(), seed), U64).view(np.int64))


def sketch(h: np.ndarray) -> np.ndarray:
    odd = np.bincount((mix(h, 77) >> U64(54)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def wide_sketch(h: np.ndarray) -> np.ndarray:
    """The same of WIDE words, for the sets that are looked at again: fewer unlike elements share a bit."""
    odd = np.bincount((mix(h, 78) >> U64(52)).astype(np.int64), minlength=64 * WIDE) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _more_than(slack: int, mean: float) -> float:
    """The chance that a Poisson variable is above slack; by the normal distribution where that is large."""
    if mean <= 0 or slack > mean + 12 * math.sqrt(mean) + 30:
        return 0.0
    if slack > 300:
        return math.erfc((slack + 0.5 - mean) / math.sqrt(2 * mean)) / 2
    return max(0.0, 1.0 - sum(math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(slack + 1)))


class Scheme:
    """How a band's sets are cut: m segments, of which the first `two` take one-deletion neighbourhoods, and slack."""

    def __init__(self, n: int, need: int, slack: int, deletions: bool):
        worth = need + (2 if deletions else 1) * slack
        self.slack = slack
        self.two = worth // 2 if deletions else 0
        self.m = self.two + worth % 2 if deletions else worth
        size = n / self.m
        empty = math.exp(-size) * (1 + size if deletions else 1)  # of one element, a neighbour is empty
        self.cost = self.m + n * self.two / self.m + HARD * _more_than(slack, self.m * empty)

    def signatures(self, h: np.ndarray, band: int, empties: bool = True) -> tuple[np.ndarray, int]:
        """Signatures, and how much slack is left; -1 where the empty subsets are more, and indexed too if empties is set."""
        salt = band + 1 + (64 if self.two else 0)
        x = mix(h, salt)
        seg = ((x >> U64(32)) * U64(self.m) >> U64(32)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        seg, x = seg[order], mix(x[order], 99)
        edge = np.searchsorted(seg, np.arange(self.m + 1))
        total = np.concatenate([np.zeros(1, U64), np.cumsum(x, dtype=U64)])
        sums, size = total[edge[1:]] - total[edge[:-1]], np.diff(edge)
        tag = mix((np.arange(self.m, dtype=U64) << U64(8)) + U64(salt), 7)
        small = size < np.where(np.arange(self.m) < self.two, 2, 1)
        left = max(-1, self.slack - int(np.count_nonzero(small)))
        skip = left >= 0 or not empties
        out = [(sums ^ tag)[size > 0] if skip else sums ^ tag]
        if self.two:
            near = (seg < self.two) & ((size[seg] > 1) | (not skip))
            out.append((sums[seg[near]] - x[near]) ^ tag[seg[near]])
        return mix(np.concatenate(out)) << U64(BAND_BITS) | U64(band), left


class Bands:
    """Bands of sizes with their schemes, for links at percent * union <= 100 * intersection."""

    def __init__(self, percent: int):
        self.percent = percent
        self.low, self.high, self.scheme, self.rescue = [1], [], [], []
        while len(self.low) < 1 << BAND_BITS:
            lo = self.low[-1]
            hi = max(lo, int(lo * RATIO))
            need = self.differ(hi, hi * 100 // percent) + 1
            self.high.append(hi)
            near = min((Scheme(lo, need, s, True) for s in range(4)), key=lambda s: s.cost)
            slacks = sorted({*range(6), *(math.ceil(need * f) for f in (0.05, 0.1, 0.15, 0.2, 0.3))})
            best = min([near, *(Scheme(lo, need, s, False) for s in slacks)], key=lambda s: s.cost)
            self.scheme.append(best)
            self.rescue.append(None if best.two else near)
            self.low.append(hi + 1)
        self.low.pop()

    def differ(self, a: int, b: int) -> int:
        """The most elements in which linked sets of these sizes differ."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def of(self, size: int) -> range:
        """The bands in which a set looks for partners of its size or smaller; the last is its own."""
        if size > self.high[-1]:
            raise ValueError(f"a set of {size} shingles is beyond the last band")
        least = -(-size * self.percent // 100)
        return range(int(np.searchsorted(self.high, least)), int(np.searchsorted(self.high, size)) + 1)

    def signatures(self, h: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Signatures in all bands, and for each band what slack is left, as band * 256 + left + 1."""
        out, spare = [], []
        for band in self.of(len(h)):
            rescue = self.rescue[band]
            sig, left = self.scheme[band].signatures(h, band, rescue is None)
            out.append(sig)
            if left < 0 and rescue:  # a pair whose only shared subsets are empty meets in the larger segments
                out.append(rescue.signatures(h, band)[0])
            spare.append(band << 8 | min(left, 254) + 1)
        return np.unique(np.concatenate(out)), spare


_INDEX = "pid int, kind int, a binary, b binary, c binary"
_DOC = np.dtype([("id", np.int64), ("null", np.int8), ("node", np.int64), ("twin", np.int64), ("th", np.int64), ("n", np.int32), ("spare", np.int32, BANDS), ("sketch", np.int64, SKETCH)])
_GROUPS = "kind int, gid long, node long, size int, times int, doc_id long, n int, twin long, th long, spare array<int>, sketch array<long>"


def _map_side(k: int, bands: Bands, pids: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sent = _Words(), set()
        for b in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            docs = np.zeros(b.num_rows, _DOC)
            docs["null"] = ~np.array(b.column("doc_id").is_valid())
            docs["id"] = b.column("doc_id").fill_null(0)
            docs["th"] = b.column("th")
            sigs, owner, fresh = [], [], []
            for d, text in zip(docs, (x.as_py() for x in b.column("text"))):
                h = shingles(text, k, words)
                if not len(h):
                    continue
                d["n"], d["node"], d["twin"], d["sketch"] = len(h), set_id(h, seed), set_id(h, seed + 1), sketch(h)
                if (node := int(d["node"])) not in sent:
                    if len(sent) < SENT:  # beyond, a set may be sent again, which costs only its rows
                        sent.add(node)
                    s, spare = bands.signatures(h)
                    d["spare"][: len(spare)] = spare
                    sigs.append(s)
                    owner.append(np.full(len(s), len(fresh), np.uint32))
                    fresh.append(node)
            rows = [(int(docs["th"][0]) % pids, 1, docs.tobytes(), b"", b"")] if len(docs) else []
            if sigs:
                s, o, fresh = np.concatenate(sigs), np.concatenate(owner), np.array(fresh, np.int64)
                order = np.argsort(s, kind="stable")
                s, o = s[order], o[order]
                pid = (s >> U64(40)).astype(np.int64) * pids >> 24
                edges = np.flatnonzero(np.concatenate([[True], pid[1:] != pid[:-1], [True]]))
                wide = np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, :6])
                for i, j in zip(edges[:-1], edges[1:]):
                    used, at = np.unique(o[i:j], return_inverse=True)
                    at = at.astype(np.uint16 if len(used) < 65536 else np.uint32)
                    rows.append((int(pid[i]), 0, wide[i:j].tobytes(), at.tobytes(), fresh[used].tobytes()))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[2:]]], ["pid", "kind", "a", "b", "c"])
            del docs, sigs, owner, rows, cols
            trim_memory()

    return run


def _reduce_side(key, table):
    """Of one partition of the index: for each signature of three sets or more its sets (kind 0), pairs of sets that have one to themselves
    (kind 2, the other set as gid), and the documents as they came (kind 1).

    Signatures with the same sets are given once, with how many there are."""
    sigs, nodes, docs = [], [], []
    for kind, a, b, c in zip(*[table.column(n).to_pylist() for n in ("kind", "a", "b", "c")]):
        if kind:
            docs.append(np.frombuffer(a, _DOC))
            continue
        n = len(a) // 6
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :6] = np.frombuffer(a, np.uint8).reshape(n, 6)
        sigs.append(wide.view(U64).ravel())
        nodes.append(np.frombuffer(c, np.int64)[np.frombuffer(b, np.uint16 if len(b) == 2 * n else np.uint32)])
    out = {n: np.empty(0, np.int64) for n in ("gid", "node", "size", "times")}
    two = np.empty((0, 2), np.int64)
    if sigs:
        s, v = np.concatenate(sigs), np.concatenate(nodes)
        order = np.lexsort((v, s))
        s, v = s[order], v[order]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != s[:-1]) | (v[1:] != v[:-1])
        s, v = s[keep], v[keep]
        start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        size = np.diff(np.append(start, len(s)))
        start, size = start[size > 1], size[size > 1]
        if len(start):
            # the same members give the same sum of their names
            low = s[start] & U64((1 << BAND_BITS) - 1)
            total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(v.view(U64)), dtype=U64)])
            name = mix(total[start + size] - total[start], 3) ^ low
            _, first, times = np.unique(name, return_index=True, return_counts=True)
            start, size, low = start[first], size[first], low[first]
            alone = size == 2
            two = np.unique(np.stack([v[start[alone]], v[start[alone] + 1]], 1), axis=0)  # ascending within a signature
            start, size, low, times = start[~alone], size[~alone], low[~alone], times[~alone]
            rows = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            gid = (mix(s[start], int(key[0].as_py()) + 5) & ~U64((1 << BAND_BITS) - 1) | low).view(np.int64)
            out = {"gid": np.repeat(gid, size), "node": v[rows], "size": np.repeat(size, size), "times": np.repeat(times, size)}
    out = {"gid": np.concatenate([out["gid"], two[:, 1]]), "node": np.concatenate([out["node"], two[:, 0]]), **{c: np.concatenate([out[c], np.zeros(len(two), np.int64)]) for c in ("size", "times")}}
    g = len(out["gid"])
    kind = np.where(out["size"] == 0, 2, 0).astype(np.int32)
    d = np.concatenate(docs) if docs else np.empty(0, _DOC)
    m = len(d)
    lists = lambda name, width: pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(d[name]).ravel()))
    both = lambda x, y: pa.chunked_array([x, y])
    own = lambda name, t: pa.array(np.ascontiguousarray(d[name]), t)
    return pa.table({
        "kind": both(pa.array(kind), pa.array(np.ones(m, np.int32))),
        "gid": both(pa.array(out["gid"], pa.int64()), pa.nulls(m, pa.int64())),
        "node": both(pa.array(out["node"], pa.int64()), own("node", pa.int64())),
        "size": both(pa.array(out["size"], pa.int32()), pa.nulls(m, pa.int32())),
        "times": both(pa.array(out["times"], pa.int32()), pa.nulls(m, pa.int32())),
        "doc_id": both(pa.nulls(g, pa.int64()), pa.array(np.ascontiguousarray(d["id"]), pa.int64(), mask=d["null"] == 1)),
        "n": both(pa.nulls(g, pa.int32()), own("n", pa.int32())),
        "twin": both(pa.nulls(g, pa.int64()), own("twin", pa.int64())),
        "th": both(pa.nulls(g, pa.int64()), own("th", pa.int64())),
        "spare": both(pa.nulls(g, pa.list_(pa.int32())), lists("spare", BANDS)),
        "sketch": both(pa.nulls(g, pa.list_(pa.int64())), lists("sketch", SKETCH)),
    })


_MEMBERS = ("gid", "rb", "vb", "node", "label", "u", "n", "sketch")


WOOD = 64  # sets of a group from which on it gives a forest


def _forest(far: np.ndarray, label: np.ndarray, never: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (p, q) of pairs that join all of a group that can be joined, by Boruvka's steps: each component's nearest pair that leads out
    of it, until none does. far: how many bits differ, never where there can't be a link. Fewer pairs than there are sets, or as many."""
    comp = np.unique(label, return_inverse=True)[1].ravel()
    rows, ps, qs = np.arange(len(comp)), [], []
    while True:
        out = np.where(comp[:, None] == comp[None, :], never, far)
        q = out.argmin(1)
        d = out[rows, q]
        order = np.lexsort((rows, d, comp))
        best = order[np.flatnonzero(np.append(True, comp[order][1:] != comp[order][:-1]))]  # a row for each component
        best = best[d[best] < never]
        if not len(best):
            break
        ps.append(best)
        qs.append(q[best])
        root = list(range(int(comp.max()) + 1))
        for a, b in zip(comp[best].tolist(), comp[q[best]].tolist()):
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        for c in range(len(root)):  # a root is smaller than what it holds
            root[c] = root[root[c]]
        comp = np.array(root)[comp]
    return (np.concatenate(ps), np.concatenate(qs)) if ps else (rows[:0], rows[:0])


def _close(percent: int, every: bool, words: int = SKETCH, nearest: bool = False):
    """Over rows sorted by (gid, rb, vb): pairs (a, b) of a group's sets of different labels, one of them marked u, whose sizes and
    sketches allow a link. Of each set that is marked the nearest one, of groups of more than WOOD sets a forest that joins what can be joined, unless nearest is set; or every one.
    Rows with a gid alone name the groups that may have such pairs besides those given."""

    lines = 64 * SKETCH // words  # of a group that are held against all of it at once

    def forests(node, label, u, n, sk):
        """pairs, of large groups, one by one."""
        found, never, more = [], 1 << 14, np.zeros(len(node), bool)
        for i in range(len(node)):
            far = np.empty((node.shape[1],) * 2, np.int16)
            for r in range(0, len(far), lines):
                y = slice(r, r + lines)
                d = np.bitwise_count(sk[i, y, None] ^ sk[i, None, :]).sum(-1, dtype=np.int32)
                a, b = n[i, y, None], n[i, None, :]
                ok = (d <= (100 - percent) * (a + b) // (100 + percent)) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (u[i, y, None] | u[i, None, :])
                far[y] = np.where(ok, d, never)
            p, q = _forest(far, label[i], never)
            found.append((node[i][p], node[i][q]))
            close = np.count_nonzero((far < never) & (label[i][:, None] != label[i][None, :]))  # from both sides
            more[i] = close > 2 * len(np.unique(np.minimum(p, q) * len(far) + np.maximum(p, q)))
        return found, more

    def pairs(node, label, u, n, sk):
        """Of groups of one size, (groups, size) arrays, at once."""
        g, size = node.shape
        found, more = [], np.zeros(g, bool)
        step = max(1, (1 << 10) * lines // (size * min(size, lines)))
        for i in range(0, g, step):
            for r in range(0, size, lines):
                x, y = slice(i, i + step), slice(r, r + lines)
                far = np.bitwise_count(sk[x, y, None] ^ sk[x, None, :]).sum(-1, dtype=np.int32)
                a, b = n[x, y, None], n[x, None, :]
                ok = far <= (100 - percent) * (a + b) // (100 + percent)
                ok &= 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
                ok &= (label[x, y, None] != label[x, None, :]) & (u[x, y, None] | u[x, None, :])
                if not ok.any():
                    continue
                if every:
                    k, p, q = np.nonzero(ok)
                else:
                    q = np.where(ok, far, 1 << 30).argmin(-1)
                    more[x] |= ((np.count_nonzero(ok, -1) > 1) & u[x, y]).any(-1)
                    k, p = np.nonzero(ok.any(-1) & u[x, y])  # the others' pairs are found from this side
                    q = q[k, p]
                found.append((node[x][k, r + p], node[x][k, q]))
        return found, more

    def run(batches):
        held = None
        for b in _and_end(batches):
            t = None
            if b is not None and b.num_rows:
                t = {c: np.array(b.column(c)) for c in _MEMBERS if c != "sketch"}
                length = b.column("sketch").value_lengths().to_numpy()
                t["width"] = length.astype(np.int64)
                t["sketch"] = np.zeros((b.num_rows, words), np.int64)
                t["sketch"][np.arange(words) < length[:, None]] = np.array(b.column("sketch").flatten())
            if held is not None:
                t = held if t is None else {c: np.concatenate([held[c], t[c]]) for c in t}
            if t is None:
                continue
            new = np.ones(len(t["gid"]), bool)
            new[1:] = (t["gid"][1:] != t["gid"][:-1]) | (t["rb"][1:] != t["rb"][:-1]) | (t["vb"][1:] != t["vb"][:-1])
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(new)))
            if b is not None:  # the last group may go on
                held = {c: x[start[-1] :] for c, x in t.items()}
                start, size = start[:-1], size[:-1]
            found, left = [], []
            width = np.minimum.reduceat(t["width"], start) if len(start) else start  # a group's narrowest sketch, to which all are folded
            for s, w in np.unique(np.stack([size, width], 1)[size > 1], axis=0).tolist():
                at = start[(size == s) & (width == w)][:, None] + np.arange(s)
                sk = t["sketch"][at].view(U64)
                while sk.shape[-1] > w:
                    half = sk.shape[-1] // 2
                    sk = sk[..., :half] ^ sk[..., half:]
                given, more = (pairs if every or nearest or s <= WOOD else forests)(t["node"][at], t["label"][at], t["u"][at].astype(bool), t["n"][at].astype(np.int64), sk)
                found += given
                left.append(t["gid"][at[more, 0]])
            a, c = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
            each = np.unique(np.stack([np.minimum(a, c), np.maximum(a, c)], 1), axis=0)
            left = np.unique(np.concatenate(left)) if left else np.empty(0, np.int64)
            each = [pa.array(np.ascontiguousarray(each[:, i]), pa.int64()) for i in (0, 1)]
            columns = [pa.concat_arrays([x, pa.nulls(len(left), pa.int64())]) for x in each] + [pa.concat_arrays([pa.nulls(len(each[0]), pa.int64()), pa.array(left, pa.int64())])]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "gid"])
        trim_memory()

    return run


def _and_end(batches):
    yield from batches
    yield None


def _folded(percent: int) -> Column:
    """The sketch, folded where so few elements may differ that fewer classes tell unlike sets apart: each bit then stands for two or four
    classes, and still changes with each differing element."""
    fold = lambda n: F.array(*[reduce(lambda a, b: a.bitwiseXOR(b), [F.col(f"s{j}") for j in range(i, SKETCH, n)]) for i in range(n)])
    out = fold(SKETCH)
    for n in (SKETCH // 2, SKETCH // 4):  # half of the bits differ by chance, less five deviations
        most = 32 * n - 5 * 4 * math.isqrt(n)
        out = F.when(F.col("n") <= most * (100 + percent) // (2 * (100 - percent)), fold(n)).otherwise(out)
    return out


def _candidates(members: DataFrame, sketches: DataFrame, percent: int, every: bool = False, once: bool = False, words: int = SKETCH, nearest: bool = False, rest: bool = False) -> DataFrame:
    """(a, b) of members (gid, node, label, u, nu, nv): nu of a group's nv sets are marked u, and meet all of them. A group of more
    than BLOCK sets is dealt into blocks of the marked ones against blocks of all. once: where all are marked, such a group is instead
    dealt into blocks twice, by two hashes, so that what each dealing joins within its blocks the other joins across them; a set comes
    twice, however large its group is, and may miss the only set that it links with: _links looks for that. nearest: no forests. rest: with
    a column gid, which is null; rows with a gid alone name the groups that may have close pairs besides those given."""
    block = lambda c, n: F.pmod(F.xxhash64(F.lit(c), "node"), F.col(n))
    parts = members.withColumn("ru", F.ceil(F.col("nu") / BLOCK)).withColumn("rv", F.ceil(F.col("nv") / BLOCK))
    whole = parts.where("ru <= 1 and rv <= 1").select(*_MEMBERS[:1], F.lit(0).alias("rb"), F.lit(0).alias("vb"), "node", "label", "u")
    cut = parts.where("ru >= 1 and rv > 1")
    rows = cut.where("u").select("gid", block(0, "ru").cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), (F.col("rv") - 1).cast("int"))).alias("vb"), "node", "label", "u")
    others = cut.select("gid", F.explode(F.sequence(F.lit(0), (F.col("ru") - 1).cast("int"))).alias("rb"), block(1, "rv").cast("int").alias("vb"), "node", "label", F.lit(False).alias("u"))
    if once:
        rows = cut.withColumn("rb", F.explode(F.array(F.lit(0), F.lit(1)))).select("gid", "rb", F.pmod(F.xxhash64("rb", "gid", "node"), F.col("rv")).cast("int").alias("vb"), "node", "label", "u")
    dealt = whole.unionByName(rows) if once else whole.unionByName(rows).unionByName(others)
    dealt = dealt.join(sketches, "node").select("gid", "rb", "vb", "node", "label", "u", "n", (_folded(percent) if words == SKETCH else F.col("wide")).alias("sketch"))
    dealt = dealt.repartition("gid", "rb", "vb").sortWithinPartitions("gid", "rb", "vb")
    close = dealt.mapInArrow(_close(percent, every, words, nearest), "a long, b long, gid long")
    return (close if rest else close.where("gid is null").select("a", "b")).distinct()


def _sets(docs: DataFrame, k: int, needed: DataFrame, log2_bits: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(row, node, hashes, wide) of the needed sets (node, th); th tells the texts that have to be hashed again. They are written where they are
    made: a set may come from several tasks, and some come that aren't needed. Of each needed one the second table (row, node) names one row."""
    spark = docs.sparkSession
    blooms = [spark.sparkContext.broadcast(BloomFilter.of(needed, c, log2_bits).bits) for c in ("node", "th")]  # of fixed size

    def run(batches):
        words, sent = _Words(), set()
        for b in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            hit = np.flatnonzero(BloomFilter.hits(blooms[1].value, np.array(b.column("th")), log2_bits))
            texts = b.column("text").take(pa.array(hit))
            sets = [h for h in (shingles(x.as_py(), k, words) for x in texts) if len(h)]
            nodes = np.array([set_id(h, seed) for h in sets], np.int64)
            take = []
            for i in np.flatnonzero(BloomFilter.hits(blooms[0].value, nodes, log2_bits)):
                if (node := int(nodes[i])) not in sent:
                    take.append(i)
                    if len(sent) < SENT:
                        sent.add(node)
            flat = np.concatenate([sets[i].view(np.int64) for i in take]) if take else np.empty(0, np.int64)
            ends = np.cumsum([0, *[len(sets[i]) for i in take]]).astype(np.int32)
            wide = np.concatenate([wide_sketch(sets[i]) for i in take]) if take else np.empty(0, np.int64)
            each = pa.array(np.arange(len(take) + 1, dtype=np.int32) * WIDE)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[take] if take else [], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.ListArray.from_arrays(each, pa.array(wide))], ["node", "hashes", "wide"])
            del sets, flat
            trim_memory()

    found = docs.select("th", "text").mapInArrow(run, "node long, hashes array<long>, wide array<long>")
    sets = written(found.select(F.monotonically_increasing_id().alias("row"), "*"), "sets")
    for x in blooms:
        x.destroy()
    first = sets.groupBy("node").agg(F.min("row").alias("row"))
    return sets, written(first.join(needed.select("node"), "node", "left_semi").select("row", "node"), "rows")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of sets, those that link."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    la, lb, both = F.size("ha"), F.size("hb"), F.size(F.array_intersect("ha", "hb"))
    fits = 100 * F.least(la, lb) >= percent * F.greatest(la, lb)
    linked = F.when(fits, 100 * both >= percent * (la + lb - both)).otherwise(False)
    return written(pairs.join(left, "a").join(right, "b").where(linked).select("a", "b"), "links")


def _near(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose sizes and sketches allow a link."""
    own = lambda p: sketches.select(*[F.col(c).alias(f"{p}_{c}") for c in ("node", "n", *[f"s{i}" for i in range(SKETCH)])])
    differ = " + ".join(f"bit_count(a_s{i} ^ b_s{i})" for i in range(SKETCH))
    fits = F.expr(f"{differ} <= ({100 - percent}L * (a_n + b_n)) div {100 + percent}L and 100L * least(a_n, b_n) >= {percent}L * greatest(a_n, b_n)")
    return pairs.join(own("a"), F.col("a") == F.col("a_node")).join(own("b"), (F.col("b") == F.col("b_node")) & fits).select("a", "b")


def _near_wide(pairs: DataFrame, again: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose sizes and wide sketches (node, n, wide) allow a link: long sets differ in more bits than the narrow ones have."""
    own = lambda p: again.select(F.col("node").alias(p), F.col("n").alias(f"{p}_n"), F.col("wide").alias(f"{p}_w"))
    differ = F.aggregate(F.zip_with("a_w", "b_w", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda d, x: d + x)
    fits = differ <= F.expr(f"({100 - percent}L * (a_n + b_n)) div {100 + percent}L")
    return pairs.join(own("a"), "a").join(own("b"), "b").where(fits & F.expr(f"100L * least(a_n, b_n) >= {percent}L * greatest(a_n, b_n)")).select("a", "b")


def _once(members: DataFrame) -> DataFrame:
    """Of members (gid, node), groups of several sets, of those that hold the same sets one: near sets share very many signatures, in any partition of the index."""
    each = members.groupBy("gid").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    return members.join(each.where("n > 1").groupBy("n", "x", "y").agg(F.min("gid").alias("gid")).select("gid"), "gid", "left_semi")


def _links(docs: DataFrame, groups: DataFrame, alone: DataFrame, sketches: DataFrame, k: int, percent: int, dear: int, log2_bits: int, seed: int) -> DataFrame:
    """(node, label) of the sets that link with a smaller one: label is the smallest node of the component."""
    counted = lambda rows: rows.groupBy("gid").agg(F.count("*").alias("nv"))
    members = groups.where(F.col("size") <= dear).select("gid", "node", F.col("size").alias("nv"))
    costly = groups.where(F.col("size") > dear)
    if not costly.isEmpty():
        band = F.col("gid").bitwiseAND(F.lit((1 << BAND_BITS) - 1).cast("long")).alias("band")
        used = costly.groupBy("node", band).agg(F.sum("times").alias("times"))
        left = sketches.select("node", F.explode("spare").alias("s")).select("node", F.shiftright("s", 8).cast("long").alias("band"), ((F.col("s") % 256) - 1).alias("left"))
        over = used.join(left, ["node", "band"]).where("times > left").select("node", "band")
        among = written(costly.select("gid", "node", band).join(over, ["node", "band"], "left_semi").select("gid", "node"), "costly")
        members = members.unionByName(among.join(counted(among), "gid").select("gid", "node", F.col("nv").cast("int")))
    marked = members.select("gid", "node", F.col("node").alias("label"), F.lit(True).alias("u"), F.col("nv").alias("nu"), "nv")
    tested = written(_candidates(marked, sketches, percent, once=True).union(_near(alone.distinct(), sketches, percent)).distinct(), "pairs")
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    cut = members.where(F.col("nv") > BLOCK)
    if not cut.isEmpty():
        # of a group that was dealt into blocks, sets that met nothing close there are held against all of it
        seen = ends(tested).withColumn("met", F.lit(True))
        cut = written(cut.join(seen, "node", "left").select("gid", "node", "nv", F.col("met").isNull().alias("u")), "cut")
        alike = cut.groupBy("gid").agg(F.count_if("u").alias("nu")).where("nu > 0")
        unmet = cut.join(alike, "gid").select("gid", "node", F.col("node").alias("label"), "u", "nu", "nv")
        tested = written(tested.union(_candidates(unmet, sketches, percent, nearest=True)).distinct(), "pairs")
    needed = written(ends(tested).join(sketches.select("node", "th"), "node"), "needed")
    sets, row = _sets(docs, k, needed, log2_bits, seed)
    again = written(join_small(sets.select("row", "node", F.size("hashes").alias("n"), "wide"), row, ["row", "node"], "left_semi").select("node", "n", "wide"), "again")
    # only the sets of the pairs in question are sent
    verified = lambda pairs: _verified(pairs, join_small(sets.select("row", "node", "hashes"), ends(pairs).join(row, "node"), ["row", "node"], "left_semi"), percent)
    links = verified(written(_near_wide(tested, again, percent), "near"))
    labels = stable_min_label(links)
    # what is close to nothing stays so; the others' signatures are looked at again, across components, as long as that joins some, and
    # at last with every pair
    members = written(members.select("gid", "node").join(needed.select("node"), "node", "left_semi"), "members")
    members = written(_once(members), "members")
    every = False
    while True:
        own = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        sizes = own.groupBy("gid", "label").agg(F.count("*").alias("n")).groupBy("gid").agg(F.sum("n").alias("nv"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("top"), F.count("*").alias("parts"))
        apart = own.join(sizes.where("parts > 1"), "gid").select("gid", "node", "label", (F.col("label") != F.col("top")).alias("u"), (F.col("nv") - F.col("most")).alias("nu"), "nv")
        given = written(_candidates(apart, again, percent, every, words=WIDE, rest=True), "close")
        close = written(given.where("gid is null").select("a", "b").join(tested, ["a", "b"], "left_anti"), "pairs")
        none = close.isEmpty() or (found := verified(close)).isEmpty()
        if not none:
            tested, links = written(tested.union(close), "tested"), written(links.union(found), "links")
            labels = stable_min_label(links)
        rest = given.where("gid is not null").select("gid")
        if every or rest.isEmpty():
            return labels
        # components only grow, so a group all of whose close pairs across them were given has no others later
        members = written(join_small(members, rest, "gid", "left_semi"), "members")
        every = none


def ngram_components(docs: DataFrame, k: int = 4, percent: int = 85, dear: int = 8192, log2_bits: int = 24, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id.

    A document's set is its distinct k-word shingles (of words cut at ASCII white space, A-Z lower-cased); documents
    link when 100 * intersection >= percent * union; component_id is the smallest doc_id reachable by links. Null,
    empty and blank texts have empty sets and link with nothing: each is its own component. Fewer than k words: the
    sequence is the one shingle. Equal sets are one set from the start, so copies make no pairs. Rows that repeat a
    doc_id are judged by their own texts. A null doc_id is no component's smallest, unless all are null. An empty table gives no
    rows; other columns aren't read. Shingles are 64-bit hashes. Sets have two 64-bit names: were two sets to share only the first,
    the index would be made again with others. A set of more shingles than the last band (some 400 million) raises ValueError.

    dear: a signature of more sets than that is used only where the slack doesn't serve. part_bytes: of text, for each
    partition of the index.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), null_text().alias("text")).withColumn("th", F.xxhash64("text"))
    bands = Bands(percent)
    pids = max(partitions(spark), text_bytes(docs) // part_bytes)
    for seed in range(0, 8, 2):
        index = docs.mapInArrow(_map_side(k, bands, pids, seed), _INDEX).repartition(pids, "pid")
        both = written(index.groupBy("pid").applyInArrow(_reduce_side, _GROUPS), "index")
        words = [F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)]
        one = both.where("kind = 1 and n > 0").select("node", "n", "twin", "th", F.to_json("spare").alias("spare"), *words)
        one = one.groupBy("node").agg(F.min("twin").alias("twin"), F.max("twin").alias("other"), F.min("th").alias("th"), F.max("spare").alias("spare"), *[F.max(c).alias(c) for c in ("n", *[f"s{i}" for i in range(SKETCH)])])
        sketches = written(one.withColumn("spare", F.from_json("spare", "array<int>")), "sketches")
        if sketches.where("twin <> other").isEmpty():
            break
    else:
        raise RuntimeError("sets share names under every seed")
    groups = both.where("kind = 0").select("gid", "node", "size", "times")
    alone = both.where("kind = 2").select(F.col("node").alias("a"), F.col("gid").alias("b"))
    labels = _links(docs, groups, alone, sketches, k, percent, dear, log2_bits, seed)
    labels = labels.union(labels.select(F.col("label").alias("node"), "label").distinct())  # a component's smallest has no row of its own
    # the smallest doc_id by set, then by component; sets are joined, not documents
    rows = both.where("kind = 1").select("doc_id", F.when(F.col("n") > 0, F.col("node")).alias("node"), F.col("n").cast("long").alias("n_shingles"))
    least = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    named = written(least.join(labels, "node", "left").where("copies > 1 or label is not null").withColumn("label", F.coalesce("label", "node")), "named")
    first = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = written(join_small(named.select("node", "label"), first, "label").select("node", "component_id"), "components")
    return join_small(rows, named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Of each component the row with the smallest doc_id; null ids come last. Rows are judged and removed one by one.

    Of rows of a component that repeat its smallest doc_id, the least hash of (doc_id, text) stays; rows that repeat
    a doc_id in other components aren't touched by that. Of rows equal in doc_id and text one stays, but of those with
    a null doc_id and no words all do. A row is named by a 64-bit hash; where unlike rows share one, as a second hash tells, these rows
    are named by the second. docs may have columns of any names."""
    free = {c: next(x for i in range(len(docs.columns) + 1) if (x := f"{c}{i or ''}") not in docs.columns) for c in ("_key", "_again", "_go", "_shared")}
    key = free["_key"]
    text = F.col("text").cast("string")
    first_hash, second_hash = F.xxhash64("doc_id", text), F.xxhash64(F.lit(0x5DEECE66D), text, "doc_id")
    names = docs.select(first_hash.alias("k"), second_hash.alias("h")).groupBy("k").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    shared = written(names.where("low <> high").select(F.col("k").alias(free["_shared"])), "shared")
    keyed = docs.withColumn(key, first_hash)
    if not shared.isEmpty():
        keyed = join_small(keyed, shared, F.col(key) == F.col(free["_shared"]), "left").withColumn(key, F.when(F.col(free["_shared"]).isNotNull(), second_hash).otherwise(F.col(key))).drop(free["_shared"])
    found = ngram_components(keyed.select(F.col(key).alias("doc_id"), "text"), k, percent)
    found = found.groupBy(F.col("doc_id").alias("_key")).agg(F.count("*").alias("times"), F.max("n_shingles").alias("n"), F.min("component_id").alias("component"))
    named = keyed.groupBy(F.col(key).alias("_key")).agg(F.min(F.col("doc_id").cast("long")).alias("id"))
    named = written(found.join(named, "_key"), "rows")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "_key")
    first = named.groupBy("component").agg(F.min(order).alias("first"), F.count("*").alias("of")).where("of > 1")
    first = written(first.select(F.col("component").alias("c"), F.col("first._key").alias("stays")), "first")
    go = written(join_small(named, first, F.col("component") == F.col("c")).where("_key <> stays").select(F.col("_key").alias(free["_go"])), "go")
    kept = join_small(keyed, go, F.col(key) == F.col(free["_go"]), "left_anti")
    again = named.where("times > 1 and not (id is null and n = 0)").select(F.col("_key").alias(free["_again"]))
    again = written(join_small(again, go, F.col(free["_again"]) == F.col(free["_go"]), "left_anti"), "repeated")
    if not again.isEmpty():
        once = join_small(kept, again, F.col(key) == F.col(free["_again"]), "left_semi").dropDuplicates([key])
        kept = join_small(kept, again, F.col(key) == F.col(free["_again"]), "left_anti").unionByName(once)
    return kept.drop(key)


def op3(docs: DataFrame) -> DataFrame:
    return ngram_components(docs)
