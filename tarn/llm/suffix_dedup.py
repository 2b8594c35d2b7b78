"""Operator 4, suffix-array dedup: every byte that a 100-byte string covers which also starts earlier is removed.

A sort of all suffixes can't be exchanged within the disk limit (each byte of text starts one), so the suffixes sorted
are those at anchors: in every 100-byte string the positions whose 24-byte hash is least. Equal strings have equal
anchors, so no repeat is lost.

1. Map tasks send the anchors' hashes in blocks; hashes that occur twice give the anchors to look at.
2. With the texts, each such anchor gets its context: the suffix from it (100 bytes), then what stands before it,
   reversed (76 bytes). A map task sorts its contexts, keeps the earliest of equal ones, and sends sorted runs,
   front-coded: for each context the length of the prefix it shares with the one before, and the rest.
3. Runs are merged by a loser tree that carries common-prefix lengths, so that no known prefix is compared again.
   Equal contexts come out side by side. Contexts that only share an anchor are cut into their 100-byte strings, of
   which the earliest of each stays; strings whose hashes agree are compared byte by byte.
4. An anchor that occurs more than HOT times would have all its contexts in one task. Its strings are dealt by themselves: a map
   task keeps the earliest of each, and sends 128 bits of its digest with its place, so that the tasks that meet at a string
   send one row each.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, BloomFilter, mix, null_text, partitions, slices, text_bytes, trim_memory, written

LENGTH, GRAM = 100, 24
BEFORE = LENGTH - GRAM
CONTEXT = BEFORE + LENGTH
PIECE = 1 << 17
ROWS = 1500  # of a batch that are worked on at once
SLICE = 3000  # contexts whose strings are compared at once, or all of one anchor
HELD = 2_000_000  # hashes that are held at once, or eight for each context of one anchor
HOT = 4096  # occurrences from which an anchor's strings are dealt by themselves
TOGETHER = 20  # places whose strings are dealt together, by the 81 bytes that all of them have
HOT_BITS = 24  # of the filter of hot anchors; a false hit costs rows only
PART_BYTES = 16 << 20  # of text for each partition of anchors
NO_ID = (1 << 63) - 1  # a null doc_id sorts last
_C = [U64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def _doubled(a: np.ndarray, levels: int, seed: int = 0) -> list[np.ndarray]:
    """Hashes of 1, 2, 4, ... bytes at every position along the last axis."""
    out = [mix(a, seed)]
    for i in range(levels):
        n = out[-1].shape[-1] - (1 << i)
        left, right = out[-1][..., :n], out[-1][..., 1 << i :]
        out.append((left ^ left >> U64(29)) * _C[i] + right)
    return out


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes from every position on."""
    h = _doubled(data, 4)
    n = len(data) - GRAM + 1
    return mix(h[4][:n] * _C[5] + h[3][16 : 16 + n])


def string_hashes(rows: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the LENGTH bytes from every position on, in each row."""
    h = _doubled(rows, 6, seed)
    n = rows.shape[-1] - LENGTH + 1
    return mix((h[6][..., :n] * _C[4] + h[5][..., 64 : 64 + n]) * _C[3] + h[2][..., 96 : 96 + n], seed)


def _sliding(a: np.ndarray, width: int, least) -> np.ndarray:
    step, out = 1, a
    while step * 2 <= width:
        out = least(out[:-step], out[step:])
        step *= 2
    return least(out[: len(out) - (width - step)], out[width - step :]) if width > step else out


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a text's anchors: in every LENGTH bytes those where the GRAM hash is least."""
    width, found = BEFORE + 1, []
    for start in range(0, max(1, len(data) - LENGTH + 1), PIECE):
        piece = data[start : start + PIECE + LENGTH - 1]
        if len(piece) < LENGTH:
            continue
        h = gram_hashes(piece)
        low = _sliding(h, width, np.minimum)  # of the windows from each position on
        padded = np.concatenate([np.zeros(width - 1, U64), low, np.zeros(width - 1, U64)])
        at = np.flatnonzero(_sliding(padded, width, np.maximum) == h)
        found.append((at + start, h[at]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, U64)
    pos, h = (np.concatenate(x) for x in zip(*found))
    pos, first = np.unique(pos, return_index=True)
    return pos, h[first]


class Runs:
    """Sorted byte strings, front-coded."""

    @staticmethod
    def code(keys: np.ndarray) -> tuple[bytes, bytes]:
        """keys: sorted rows of one width. The lengths of the prefixes shared with the row before, and the rests."""
        shared = np.zeros(len(keys), np.uint8)
        if len(keys) > 1:
            differ = keys[1:] != keys[:-1]
            shared[1:] = np.where(differ.any(1), differ.argmax(1), keys.shape[1])
        return shared.tobytes(), keys[np.arange(keys.shape[1]) >= shared[:, None]].tobytes()

    @staticmethod
    def decode(shared: bytes, rest: bytes, width: int) -> Iterator[tuple[int, bytes]]:
        key, at = b"", 0
        for n in shared:
            key = key[:n] + rest[at : at + width - n]
            at += width - n
            yield n, key


def merge_runs(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """(run, shared, key) in sorted order; shared: the prefix length that the key shares with the one before it.

    A loser tree. Each head carries the length of the prefix it shares with the last winner; the longer one wins
    without a comparison, and equal ones are compared from there on only."""
    k = 1
    while k < len(runs):
        k *= 2
    runs = runs + [iter(())] * (k - len(runs))
    heads: list[bytes | None] = [None] * k
    shared = [0] * k
    tree = [0] * k  # losers; tree[0] is the winner

    def advance(i: int) -> None:
        shared[i], heads[i] = next(runs[i], (-1, None))

    def beats(i: int, j: int) -> bool:
        """Whether head i comes out before head j; the loser's shared length becomes that with the winner."""
        a, b = shared[i], shared[j]
        if a != b:
            return a > b
        x, y = heads[i], heads[j]
        if x is None:
            return i < j
        if x == y:
            shared[max(i, j)] = len(x)
            return i < j
        n = a
        step = 16
        while x[n : n + step] == y[n : n + step]:
            n += step
        while x[n] == y[n]:
            n += 1
        first = x[n] < y[n]
        shared[j if first else i] = n
        return first

    for i in range(k):
        advance(i)
    winners = list(range(k))
    level = k
    while level > 1:
        level //= 2
        new = []
        for n in range(level):
            i, j = winners[2 * n], winners[2 * n + 1]
            if not beats(i, j):
                i, j = j, i
            tree[level + n] = j
            new.append(i)
        winners = new
    tree[0] = winners[0]
    while heads[w := tree[0]] is not None:
        yield w, shared[w], heads[w]
        advance(w)
        node = (w + k) // 2
        while node:
            if not beats(w, tree[node]):
                w, tree[node] = tree[node], w
            node //= 2
        tree[0] = w


def merged_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unions of spans, by document: doc, start and end of the maximal ones."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    base = doc.astype(np.int64) << 33
    reach = np.maximum.accumulate(base + end)
    new = np.ones(len(doc), bool)
    new[1:] = base[1:] + start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], reach[last] - base[last] if len(doc) else end


_BLOCK = "pid int, kind int, docs binary, at binary, pos binary, a binary, b binary"
_FOUND = "id long, th long, data binary"


def _block(pid, kind, docs: np.ndarray, at, pos, a=b"", b=b""):
    """docs: (id, th) by number; at: numbers; only the documents that occur are sent."""
    used, at = np.unique(at, return_inverse=True)
    at = at.astype(np.uint16 if len(used) < 65536 else np.uint32)
    small = np.uint16 if not len(pos) or int(pos.max()) < 65536 else np.uint32
    return pid, kind, docs[used].tobytes(), at.tobytes(), pos.astype(small).tobytes(), a, b


def _unblock(docs: bytes, at: bytes, pos: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    table = np.frombuffer(docs, np.int64).reshape(-1, 2)
    own = table[np.frombuffer(at, np.uint16 if len(at) == 2 * n else np.uint32)]
    return own, np.frombuffer(pos, np.uint16 if len(pos) == 2 * n else np.uint32).astype(np.int64)


def _batch(rows) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 7
    types = [pa.int32()] * 2 + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["pid", "kind", "docs", "at", "pos", "a", "b"])


def _by_document(own: np.ndarray, values: np.ndarray) -> pa.Table:
    """A row for each document with its values' bytes."""
    order = np.lexsort((own[:, 1], own[:, 0])) if len(own) else np.empty(0, np.int64)
    own, values = own[order], values[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]).any(1)
    first = np.flatnonzero(new)
    values = np.ascontiguousarray(values)
    each = values.itemsize * (values.size // max(len(values), 1))
    edges = (np.append(first, len(values)) * each).astype(np.int32)
    data = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(edges), pa.py_buffer(values)])
    return pa.table({"id": pa.array(own[first, 0], pa.int64()), "th": pa.array(own[first, 1], pa.int64()), "data": data})


def _pid(h: np.ndarray, pids: int) -> np.ndarray:
    return (h >> U64(48)).astype(np.int64) * pids >> 16


def _send_anchors(pids: int):
    def run(batches):
        for b in slices(batches, ROWS):
            docs = np.stack([np.array(b.column(c), np.int64) for c in ("id", "th")], 1)
            found = []
            for i, text in enumerate(x.as_py() for x in b.column("text")):
                if len(raw := text.encode("utf-8", "replace")) >= LENGTH:
                    pos, h = anchors(np.frombuffer(raw, np.uint8))
                    found.append((np.full(len(pos), i), pos, h))
            if not found:
                continue
            at, pos, h = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(h, kind="stable")
            at, pos, h = at[order], pos[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            again = ~new
            again[:-1] |= ~new[1:]
            # what repeats here is known to repeat; of each hash one anchor asks whether it does elsewhere
            rows = [_block(int(docs[at[0], 1]) % pids, 1, docs, at[again], pos[again])] if again.any() else []
            times = np.minimum(np.diff(np.append(np.flatnonzero(new), len(h))), 65535).astype(np.uint16)
            at, pos, h = at[new], pos[new], h[new]
            pid = _pid(h, pids)
            edges = np.flatnonzero(np.concatenate([[True], pid[1:] != pid[:-1], [True]]))
            for i, j in zip(edges[:-1], edges[1:]):
                rows.append(_block(int(pid[i]), 0, docs, at[i:j], pos[i:j], h[i:j].view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), times[i:j].tobytes()))
            yield _batch(rows)
            del found, rows
            trim_memory()

    return run


def _hot_key(h: np.ndarray) -> np.ndarray:
    return mix(h & U64((1 << 48) - 1), 11).view(np.int64)


def _repeated_anchors(hot: int):
    """By document the anchors that occur twice, and, without an id, keys of those that occur more than `hot` times."""

    def run(key, table):
        trim_memory()
        own, pos, known, sig, times = [], [], [], [], []
        for kind, d, at, p, a, b in zip(*[table.column(c).to_pylist() for c in ("kind", "docs", "at", "pos", "a", "b")]):
            n = len(a) // 6 if kind == 0 else _entries(d, at)
            o, q = _unblock(d, at, p, n)
            own.append(o)
            pos.append(q)
            known.append(np.full(n, kind == 1))
            wide = np.zeros((n, 8), np.uint8)
            if kind == 0:
                wide[:, :6] = np.frombuffer(a, np.uint8).reshape(n, 6)
            sig.append(wide.view(U64).ravel())
            times.append(np.frombuffer(b, np.uint16).astype(np.int64) if kind == 0 else np.zeros(n, np.int64))
        own, pos, known, sig, times = (np.concatenate(x) for x in (own, pos, known, sig, times))
        order = np.lexsort((sig, known))
        s, k = sig[order], known[order]
        same = (s[1:] == s[:-1]) & ~k[1:] & ~k[:-1]
        twice = k.copy()
        twice[1:] |= same
        twice[:-1] |= same
        take = order[twice]
        asked = np.flatnonzero(~k)
        first = asked[np.concatenate([[True], s[asked][1:] != s[asked][:-1]])] if len(asked) else asked
        busy = s[first][np.add.reduceat(times[order][asked], np.searchsorted(asked, first)) > hot] if len(asked) else s[:0]
        out = _by_document(own[take], pos[take].astype(np.int32))
        none = pa.table({"id": pa.nulls(len(busy), pa.int64()), "th": pa.array(_hot_key(busy), pa.int64()), "data": pa.nulls(len(busy), pa.binary())})
        return pa.concat_tables([out, none]).combine_chunks()

    return run


def _entries(docs: bytes, at: bytes) -> int:
    return len(at) // (2 if len(docs) // 16 < 65536 else 4)


def _hot_strings(docs, at, pos, before, after, keys, pids: int, rows: list) -> None:
    """Of contexts of hot anchors: a row for each partition of digests with the earliest place of each string, and the spans of later ones.

    The strings at twenty places in a row have 81 bytes in common, whose hash is dealt by: a context goes to four partitions
    at most, and contexts that differ in those bytes to different ones."""
    rank = np.unique(docs, axis=0, return_inverse=True)[1].ravel().astype(np.int64)
    places = np.arange(BEFORE + 1)
    for i in range(0, len(keys), 4000):
        one, two, core, row, place = [], [], [], [], []
        for j in range(i, min(i + 4000, len(keys)), 500):
            some = slice(j, min(j + 500, len(keys), i + 4000))
            text = np.concatenate([keys[some, LENGTH:][:, ::-1], keys[some, :LENGTH]], 1)
            r, p = np.nonzero((places >= BEFORE - before[some, None]) & (places + LENGTH <= BEFORE + after[some, None]))
            one.append(string_hashes(text)[r, p])
            two.append(string_hashes(text, 5)[r, p])
            h = _doubled(text, 6)
            groups = -(-len(places) // TOGETHER)
            shared = mix(h[6][:, TOGETHER - 1 :: TOGETHER][:, :groups] * _C[1] + h[5][:, LENGTH - 32 :: TOGETHER][:, :groups])
            core.append(shared[r, p // TOGETHER])
            row.append(r + j)
            place.append(p)
        one, two, core, row, place = (np.concatenate(x) for x in (one, two, core, row, place))
        if not len(one):
            continue
        start = pos[row] - BEFORE + place
        when = rank[at[row]] << 32 | start
        order = np.lexsort((when, two, one, core))
        one, two, core, row, start, when = (x[order] for x in (one, two, core, row, start, when))
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        late = when > when[np.flatnonzero(new)[np.cumsum(new) - 1]]
        if late.any():
            d, s, e = merged_spans(at[row[late]], start[late], start[late] + LENGTH)
            rows.append(_block(int(docs[at[row[0]], 1]) % pids, 1, docs, d, s, e.astype(np.int32).tobytes()))
        one, two, core, row, start = one[new], two[new], core[new], row[new], start[new]
        pid = _pid(core, pids)
        edges = np.flatnonzero(np.concatenate([[True], pid[1:] != pid[:-1], [True]]))
        for a, b in zip(edges[:-1], edges[1:]):
            rows.append(_block(int(pid[a]), 2, docs, at[row[a:b]], start[a:b], one[a:b].tobytes(), two[a:b].tobytes()))


def _send_runs(pids: int, hot):
    """hot: a broadcast filter of the keys of hot anchors."""

    def run(batches):
        import zstandard

        press = zstandard.ZstdDecompressor()

        def deal(docs, at, pos, before, after, keys):
            rows = []
            order = np.lexsort((pos, docs[at][:, 1], docs[at][:, 0]))
            order = order[np.argsort(keys[order].view(f"V{CONTEXT}").ravel(), kind="stable")]
            at, pos, before, after, keys = at[order], pos[order], before[order], after[order], keys[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]).any(1)
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            # of equal contexts the earliest stands for all; a later one is covered as far as its context goes
            late = (docs[at] != docs[at[head]]).any(1) | (pos != pos[head])
            late &= before + after >= LENGTH
            if late.any():
                d, s, e = merged_spans(at[late], pos[late] - before[late], pos[late] + after[late])
                rows.append(_block(int(docs[at[0], 1]) % pids, 1, docs, d, s, e.astype(np.int32).tobytes()))
            at, pos, before, after, keys = at[new], pos[new], before[new], after[new], keys[new]
            h = np.concatenate([np.empty(0, U64), *[gram_hashes(keys[i : i + 4000, :GRAM].ravel())[::GRAM] for i in range(0, len(keys), 4000)]])
            busy = BloomFilter.hits(hot.value, _hot_key(h), HOT_BITS)
            if busy.any():
                _hot_strings(docs, at[busy], pos[busy], before[busy], after[busy], keys[busy], pids, rows)
                at, pos, before, after, keys, h = at[~busy], pos[~busy], before[~busy], after[~busy], keys[~busy], h[~busy]
            pid = _pid(h, pids)
            for p in np.unique(pid):
                own = np.flatnonzero(pid == p)
                shared, rest = Runs.code(keys[own])
                row = list(_block(int(p), 0, docs, at[own], pos[own], shared, rest))
                row[5] = shared + before[own].astype(np.uint8).tobytes() + after[own].astype(np.uint8).tobytes()
                rows.append(row)
            return _batch(rows)

        for b in slices(batches, ROWS, "z", 3 << 20):
            docs = np.stack([np.array(b.column(c), np.int64) for c in ("id", "th")], 1)
            parts, held = [], 0
            for i, (z, found) in enumerate(zip(b.column("z").to_pylist(), b.column("found").to_pylist())):
                data = np.frombuffer(press.decompress(z), np.uint8)
                pos = np.unique(np.concatenate([np.frombuffer(x, np.int32) for x in found])).astype(np.int64)
                wide = np.concatenate([np.full(BEFORE, 255, np.uint8), data, np.full(LENGTH, 255, np.uint8)])
                context = np.lib.stride_tricks.sliding_window_view(wide, CONTEXT)[pos]
                keys = np.concatenate([context[:, BEFORE:], context[:, :BEFORE][:, ::-1]], 1)
                parts.append((np.full(len(pos), i), pos, np.minimum(pos, BEFORE), np.minimum(len(data) - pos, LENGTH), keys))
                held += len(pos)
                if held > 25_000:
                    yield deal(docs, *(np.concatenate(x) for x in zip(*parts)))
                    parts, held = [], 0
            if parts:
                yield deal(docs, *(np.concatenate(x) for x in zip(*parts)))
            del parts
            trim_memory()

    return run


def _merge_side(key, table):
    """One partition: the spans that are covered, by document, as (start, end) pairs."""
    trim_memory()
    runs, own, pos, size, local, strings = [], [], [], [], [], []
    for kind, d, at, p, a, b in zip(*[table.column(c).to_pylist() for c in ("kind", "docs", "at", "pos", "a", "b")]):
        if kind == 2:
            o, q = _unblock(d, at, p, len(a) // 8)
            strings.append((o, q, np.frombuffer(a, U64), np.frombuffer(b, U64)))
            continue
        if kind:
            o, q = _unblock(d, at, p, len(a) // 4)
            local.append((o, q, np.frombuffer(a, np.int32).astype(np.int64)))
            continue
        n = len(a) // 3
        o, q = _unblock(d, at, p, n)
        own.append(o)
        pos.append(q)
        size.append(np.frombuffer(a[n:], np.uint8).reshape(2, n).T.astype(np.int64))
        runs.append(Runs.decode(a[:n], b, CONTEXT))
    spans = list(local)
    if strings:
        o, start, one, two = (np.concatenate(x) for x in zip(*strings))
        when = np.unique(o, axis=0, return_inverse=True)[1].ravel().astype(np.int64) << 32 | start
        order = np.lexsort((when, two, one))
        one, two, when = one[order], two[order], when[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        late = order[when > when[np.flatnonzero(new)[np.cumsum(new) - 1]]]
        spans.append((o[late], start[late], start[late] + LENGTH))
        del strings, one, two, when, order
    if runs:
        base = np.cumsum([0, *map(len, own)])
        nth, row, common = base.tolist(), array("q"), array("B")
        texts, last, kept = bytearray(), b"", True  # contexts that share their anchor with the one before or after
        for r, shared, text in merge_runs(runs):
            row.append(nth[r])
            nth[r] += 1
            common.append(shared)
            if shared < CONTEXT:
                if near := shared >= GRAM:
                    texts += text if kept else last + text
                last, kept = text, near
        row, common = np.frombuffer(row, np.int64), np.frombuffer(common, np.uint8)
        n_heads = np.count_nonzero(common < CONTEXT)
        own, pos, size = np.concatenate(own)[row], np.concatenate(pos)[row], np.concatenate(size)[row]
        group = np.cumsum(common < CONTEXT) - 1  # of equal contexts
        _, rank = np.unique(own, axis=0, return_inverse=True)
        when = rank.ravel().astype(np.int64) << 32 | pos
        first = np.full(n_heads, np.iinfo(np.int64).max)
        np.minimum.at(first, group, when)
        late = (when > first[group]) & (size.sum(1) >= LENGTH)
        spans.append((own[late], (pos - size[:, 0])[late], (pos + size[:, 1])[late]))
        # contexts that share an anchor with a different one, each by its earliest row
        order = np.lexsort((when, group))
        lead = order[np.concatenate([[True], np.diff(group[order]) > 0])]
        heads = common[np.flatnonzero(common < CONTEXT)]
        near = heads >= GRAM  # with the context before
        bundle = np.cumsum(~near)
        near[:-1] |= near[1:].copy()
        lead, bundle, keys = lead[near], bundle[near], np.frombuffer(texts, np.uint8).reshape(-1, CONTEXT)
        # some thousand contexts at a time, cut where no anchor is shared
        cut = np.flatnonzero(np.concatenate([[True], np.diff(bundle) > 0, [True]])) if len(lead) else np.zeros(1, np.int64)
        at = 0
        while at < len(cut) - 1:
            to = max(at + 1, int(np.searchsorted(cut, cut[at] + SLICE, side="right")) - 1)
            i, j = cut[at], cut[to]
            spans.append(_repeated_strings(keys[i:j], lead[i:j], own, when, size))
            at = to
    own, start, end = (np.concatenate(x) for x in zip(*spans))
    if not len(own):
        return _by_document(np.empty((0, 2), np.int64), np.empty((0, 2), np.int32))
    names, doc = np.unique(own, axis=0, return_inverse=True)
    doc, start, end = merged_spans(doc.ravel(), start, end)
    return _by_document(names[doc], np.stack([start, end], 1).astype(np.int32))


def _repeated_strings(keys: np.ndarray, lead: np.ndarray, own: np.ndarray, when: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts (rows lead of own, when, size) the strings that also start earlier: document, start, end.

    Equal strings have their anchor at the same place, so those at each place of the context are compared by themselves;
    of an anchor with very many contexts, the hashes of some places are held at once."""
    order = np.argsort(when[lead], kind="stable")
    lead, keys = lead[order], keys[order]
    n, mine, before, after = len(lead), when[lead], size[lead, 0], size[lead, 1]
    texts = np.concatenate([keys[:, LENGTH:][:, ::-1], keys[:, :LENGTH]], 1)
    again = np.zeros((n, BEFORE + 3), np.int8)  # a column before and after the places
    width = min(BEFORE + 1, max(8, HELD // max(n, 1)))
    for j in range(0, BEFORE + 1, width):
        to = min(BEFORE + 1, j + width)
        hashes = np.empty((n, to - j), U64)
        for i in range(0, n, 1000):
            hashes[i : i + 1000] = string_hashes(texts[i : i + 1000, j : to + LENGTH - 1])
        for place in range(j, to):
            at = np.flatnonzero((place >= BEFORE - before) & (place + LENGTH <= BEFORE + after))
            h = hashes[at, place - j]
            by_hash = np.argsort(h, kind="stable")
            h, at = h[by_hash], at[by_hash]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            head = np.flatnonzero(new)[np.cumsum(new) - 1]  # the earliest, as rows are in order and the sort is stable
            same = np.flatnonzero(~new)
            strings = texts[:, place : place + LENGTH]
            for i in range(0, len(same), 4000):
                some = same[i : i + 4000]
                if (strings[at[some]] != strings[at[head[some]]]).any():  # unlike strings share a hash: by their bytes
                    _, head = np.unique(np.ascontiguousarray(strings[at]).view(f"V{LENGTH}").ravel(), return_inverse=True)
                    least = np.full(len(at), np.iinfo(np.int64).max)
                    np.minimum.at(least, head.ravel(), mine[at])
                    again[at[mine[at] > least[head.ravel()]], place + 1] = 1
                    break
            else:
                again[at[same[mine[at[same]] > mine[at[head[same]]]]], place + 1] = 1
    edge = np.diff(again, axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    pos = (mine[row] & (1 << 32) - 1) - BEFORE
    return own[lead[row]], pos + start, pos + end - 1 + LENGTH


def _compressed(batches):
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    for b in slices(batches, ROWS):
        trim_memory()
        z = [press.compress(t.as_py().encode("utf-8", "replace")) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("id"), b.column("th"), pa.array(z, pa.binary())], ["doc_id", "id", "th", "z"])


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, id, th, z, spans): every row of docs with its compressed text and its spans to remove, as blocks of pairs.

    id and th (the text's hash) tell rows apart. Only texts of 100 bytes or more can have spans."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), null_text().alias("text")).withColumn("id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("th", F.xxhash64("text"))
    pids = max(6 * partitions(spark), text_bytes(plain) // PART_BYTES)  # a merge holds its partition's contexts
    dealt = (lambda df: df.repartition(pids // 6, "pid")) if pids > 6 * partitions(spark) else lambda df: df
    sent = dealt(plain.select("id", "th", "text").mapInArrow(_send_anchors(pids), _BLOCK))
    found = sent.groupBy("pid").applyInArrow(_repeated_anchors(hot), _FOUND)
    found = written(found.groupBy("id", "th").agg(F.collect_list("data").alias("found")), "anchors")
    busy = spark.sparkContext.broadcast(BloomFilter.of(found.where("id is null").select("th"), "th", HOT_BITS).bits)  # of fixed size
    found = found.where("id is not null")
    packed = plain.mapInArrow(_compressed, "doc_id long, id long, th long, z binary")
    contexts = packed.drop("doc_id").join(found, ["id", "th"]).mapInArrow(_send_runs(pids, busy), _BLOCK)
    spans = dealt(contexts).groupBy("pid").applyInArrow(_merge_side, _FOUND)
    spans = written(spans.groupBy("id", "th").agg(F.collect_list("data").alias("spans")), "spans")
    busy.destroy()
    return packed.join(spans, ["id", "th"], "left")


def _pieces(batches):
    import zstandard

    press = zstandard.ZstdDecompressor()
    for b in slices(batches, ROWS, "z", 3 << 20):
        trim_memory()
        raws, starts, ends = [], [], []
        for z, spans in zip(b.column("z").to_pylist(), b.column("spans").to_pylist()):
            raws.append(press.decompress(z))
            pairs = np.concatenate([np.frombuffer(x, np.int32).reshape(-1, 2) for x in spans or []] or [np.empty((0, 2), np.int32)]).astype(np.int64)
            _, s, e = merged_spans(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
            starts.append(s)
            ends.append(e)
        yield b, raws, starts, ends


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, starts, ends (of the removed runs, in bytes of the UTF-8 text), kept
    (the remaining bytes).

    A byte goes if a 100-byte string covers it that also starts earlier: in a document with a smaller doc_id, or earlier in
    the same one; strings overlap and never cross documents. Null text counts as empty. A null doc_id comes
    last. Rows that repeat a doc_id: with equal texts neither is earlier, with different texts the order of the texts' hashes decides. Other
    columns aren't read. An empty table gives no rows.
    """

    def run(batches):
        for b, raws, starts, ends in _pieces(batches):
            kept = [b"".join(r[i:j] for i, j in zip([0, *e], [*s, len(r)])) for r, s, e in zip(raws, starts, ends)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(map(len, raws)), pa.int64()), pa.array([x.tolist() for x in starts], pa.list_(pa.int64())), pa.array([x.tolist() for x in ends], pa.list_(pa.int64())), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "starts", "ends", "kept"])

    return repeated_spans(docs, hot).select("doc_id", "z", "spans").mapInArrow(run, "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")


def op4(docs: DataFrame, hot: int = HOT) -> DataFrame:
    out = remove_repeats(docs, hot)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def sha256_of(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()
