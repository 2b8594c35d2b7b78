"""Operator 2, token counts: a prefix table of exact counts, and token ids, of a byte-fallback piece BPE model.

Pieces hold the space mark only at their start, and no piece has both letters and other characters, or a line end; so
a text falls into chunks that no merge crosses, and counts add up over chunks. (A model for which this doesn't hold
is refused or cut less finely.) Within a chunk the count at every prefix comes from a dynamic program: the last
token of a prefix's encoding is the one token that ends there and is compatible with the last token of the prefix
before it (two tokens are compatible when their concatenation encodes as just these two). So no chunk is encoded
whole; counts by chunk and by word are kept in bounded caches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MODEL = "piece_bpe_32k.model"
CACHE = 500_000
ID_CACHE = 100_000  # words and chunks whose ids are kept
UNKNOWN = 1 << 20  # ids from here on stand for characters without a piece


def vocabulary_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Cache(dict):
    """Computes what it lacks; starts anew when full."""

    def __init__(self, compute, most: int):
        self.compute, self.most = compute, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.compute(key)
        return value


class PrefixCounter:
    """Exact token counts of every prefix of a text."""

    def __init__(self, model_file: str, cache: int = CACHE):
        import ahocorasick
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i): i for i in plain}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces) or sp.encode("a  b ", out_type=str)[-1] != MARK:
            raise ValueError("the model's pieces cross the space mark, or it strips spaces; chunks aren't independent")
        letters, others = "[^\\W\\d_]", f"[^\\w{MARK}\\n]|[\\d_]"
        mixed = re.compile(f"{letters}(?:{others})|(?:{others}){letters}|\\n.|.\\n", re.S)
        fine = not any(mixed.search(p) for p in self.pieces)
        self.split = re.compile(f"{MARK}*(?:{letters}+|(?:{others})+)|\\n|{MARK}+" if fine else f"{MARK}+[^{MARK}]*").findall
        self.marked = np.array([sp.id_to_piece(i)[:1] == MARK for i in range(sp.get_piece_size())])
        self.cache = cache
        self.counts = _Cache(lambda c: self._prefixes(c)[-1], cache)  # by chunk
        self.words = _Cache(lambda w: sum(map(self.counts.__getitem__, self.split(MARK + w))), cache)  # by word
        self.surface = {i: p for p, i in self.pieces.items()}
        self.finder = ahocorasick.Automaton()
        for piece, i in self.pieces.items():
            self.finder.add_word(piece, (i, len(piece)))
        self.finder.make_automaton()
        self.find = self.finder.iter
        self.pairs: dict[int, bool] = {}  # left id << 22 | right id
        self.whole = _Cache(lambda p: self.raw(p) == [self.pieces[p]], len(self.pieces))
        self.word_ids: dict[str, bytes] = {}  # with the mark before the word
        self.chunk_ids: dict[str, bytes] = {}  # as the chunk stands

    def forget_ids(self) -> None:
        self.word_ids.clear()
        self.chunk_ids.clear()

    def raw(self, text: str) -> list[int]:
        """Ids of a piece of text as it stands, without the mark that the model puts before a text."""
        if text in ("", MARK):  # the model makes nothing of an empty text, not even its mark
            return [self.pieces[MARK]] * len(text)
        return self.sp.encode(text[1:]) if text[0] == MARK else self.sp.encode("\n" + text)[2:]

    def text_of(self, token: int) -> str:
        """An id from UNKNOWN on stands for a character that no piece has, 0 for the start of a chunk."""
        return "" if not token else chr(token - UNKNOWN) if token >= UNKNOWN else self.surface[token]

    def fits(self, key: int) -> bool:
        """Whether the right token may follow the left one, as the model itself encodes the two."""
        left, right = key >> 22, key & (1 << 22) - 1
        both = self.text_of(left) + self.text_of(right)
        if left and both in self.pieces and self.whole[both]:  # a piece that encodes as itself is never two tokens
            ok = False
        else:
            own = [[t] if 0 < t < UNKNOWN else self.raw(self.text_of(t)) for t in (left, right)]
            ok = self.raw(both) == own[0] + own[1]
        if len(self.pairs) > self.cache:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def _prefixes(self, chunk: str) -> list[int]:
        """Token counts of every prefix of a chunk, from the empty one. One pass over all occurrences of pieces."""
        size, known, fits = len(chunk), self.pairs.get, self.fits
        counts, last, done = [0] * (size + 1), [0] * (size + 1), 0
        for end, (token, length) in self.find(chunk):
            if done < end:
                if not counts[end] or end - done > 1:
                    self._fill(chunk, counts, last, done, end)
                done = end
            end += 1
            if not counts[end]:
                start = end - length
                key = last[start] << 22 | token
                ok = known(key)
                if fits(key) if ok is None else ok:
                    counts[end], last[end] = counts[start] + 1, token
        self._fill(chunk, counts, last, done, size)
        return counts

    def _fill(self, chunk: str, counts: list[int], last: list[int], done: int, end: int) -> None:
        """Prefixes that end in a character of no piece: it is as many tokens as it has bytes."""
        for at in range(done + 1, end + 1):
            if not counts[at]:
                c = chunk[at - 1]
                if c in self.pieces:
                    raise AssertionError(f"no token ends {chunk[:at]!r}")
                counts[at], last[at] = counts[at - 1] + len(c.encode()), UNKNOWN + ord(c)

    def chunks(self, text: str) -> list[str]:
        return self.split(MARK + text.replace(" ", MARK)) if text else []

    @staticmethod
    def spaced(text: str) -> list[str] | None:
        """The words of a text with single spaces between words and no marks: each has one mark before it."""
        return None if "  " in text or text[0] == " " or text[-1] == " " or MARK in text else text.split(" ")

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        words = self.spaced(text)
        return sum(map(self.words.__getitem__, words)) if words else sum(map(self.counts.__getitem__, self.chunks(text)))

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """n[i]: tokens of the first i characters, for every i from 0 to len(text)."""
        out, base = [0], 0
        for k, chunk in enumerate(self.chunks(text or "")):
            own = self._prefixes(chunk)
            # the mark before a text stands for no character of it
            out += [base + x for x in own[2 if k == 0 else 1 :]]
            base += own[-1]
        return np.array(out, np.int64)

    def encode(self, text: str | None) -> bytes:
        """The text's token ids as little-endian 16-bit words, chunk by chunk from a bounded cache."""
        if not text:
            return b""
        if words := self.spaced(text):
            return b"".join(self._words_as(dict.fromkeys(words), words))
        chunks = self.chunks(text)
        self._learn(chunks)
        return b"".join([self.chunk_ids[c] for c in chunks])

    def _words_as(self, distinct, words: list[str]) -> list[bytes]:
        """The ids of each of the words, from a cache that starts anew when full."""
        ids = self.word_ids
        if missing := [w for w in distinct if w not in ids]:
            if len(ids) + len(missing) > ID_CACHE:
                ids.clear()
                missing = list(distinct)
            cut = [self.split(MARK + w) for w in missing]
            self._learn([c for chunks in cut for c in chunks])
            known = self.chunk_ids
            ids.update((w, b"".join([known[c] for c in chunks])) for w, chunks in zip(missing, cut))
        return [ids[w] for w in words]

    @staticmethod
    def _by_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Which texts spaced() cuts; of those, where each one's words begin, each word's number, and the numbered words."""
        plain = pc.invert(pc.match_substring_regex(texts, f"^$|^ | $|  |{MARK}"))
        cut = pc.split_pattern(texts.filter(plain), " ")
        words = cut.flatten().dictionary_encode()
        start = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64))
        return plain.to_numpy(zero_copy_only=False), np.concatenate([[0], start[:-1]]) if len(start) else start, words.indices.to_numpy(), words.dictionary

    def count_column(self, texts: pa.Array) -> np.ndarray:
        """count() of every text of a column without nulls. Each distinct word of it is looked up once."""
        plain, start, at, words = self._by_words(texts)
        n = np.empty(len(texts), np.int64)
        if len(start):
            known = np.fromiter(map(self.words.__getitem__, words.to_pylist()), np.int64, len(words))
            n[plain] = np.add.reduceat(known[at], start)
        n[~plain] = [self.count(x) for x in texts.filter(pa.array(~plain)).to_pylist()]
        return n

    def _encode_words(self, words: pa.Array, group: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words end to end, and how many each has. The model encodes groups of words as texts with
        spaces between; a word has one mark, before it, so it begins where a token begins with a mark."""
        edges = np.append(np.arange(0, len(words), group), len(words))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), words), " ")
        ids = [np.array(g, np.uint16) for g in self.sp.encode(texts.to_pylist(), num_threads=1)]
        if not np.array_equal([np.count_nonzero(self.marked[g]) for g in ids], np.diff(edges)):  # the model takes other characters for spaces
            listed = words.to_pylist()
            coded = self._words_as(listed, listed)
            return np.frombuffer(b"".join(coded), "<u2"), np.fromiter(map(len, coded), np.int32, len(coded)) // 2
        flat = np.concatenate(ids)
        first = np.flatnonzero(self.marked[flat])
        return flat, np.diff(np.append(first, len(flat))).astype(np.int32)

    def encode_column(self, texts: pa.Array, sizes_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """encode() of every text of a column without nulls, end to end, and each one's number of tokens."""
        plain, start, at, words = self._by_words(texts)
        n, flat = np.zeros(len(texts), np.int64), np.empty(0, np.uint16)
        if len(start):
            ids, size = self._encode_words(words)
            own = size[at]
            n[plain] = np.add.reduceat(own, start, dtype=np.int64)
            if not sizes_only:
                shift = (np.cumsum(size, dtype=np.int32) - size)[at] - (np.cumsum(own, dtype=np.int32) - own)
                where = np.repeat(shift, own)
                where += np.arange(len(where), dtype=np.int32)
                flat = ids[where]
        if plain.all():
            return flat, n
        other = [np.frombuffer(self.encode(x), "<u2") for x in texts.filter(pa.array(~plain)).to_pylist()]
        n[~plain] = list(map(len, other))
        if sizes_only:
            return flat, n
        out, mine = np.empty(n.sum(), np.uint16), np.repeat(plain, n)
        out[mine], out[~mine] = flat, np.concatenate(other)
        return out, n

    def _learn(self, chunks: list[str]) -> None:
        """Puts the ids of chunks into the cache, which starts anew when full."""
        known = self.chunk_ids
        missing = [c for c in dict.fromkeys(chunks) if c not in known]
        if len(known) + len(missing) > ID_CACHE:
            known.clear()
            missing = list(dict.fromkeys(chunks))
        if missing:
            marked = [c[0] == MARK for c in missing]
            got = self.sp.encode([c[1:] if m else "\n" + c for c, m in zip(missing, marked)], num_threads=1)
            for c, m, g in zip(missing, marked, got):
                known[c] = np.array([self.pieces[MARK]] if c == MARK else g if m else g[2:], "<u2").tobytes()


def budget_chars(prefix: np.ndarray, limit: int) -> int:
    """The most characters of the text that encode to at most limit tokens."""
    return int(np.flatnonzero(prefix <= limit)[-1])


def slices(texts: pa.Array, most: int = 16 << 20) -> Iterator[pa.Array]:
    """A column of texts in slices of about that many bytes or of one text, null as empty."""
    texts = pc.fill_null(texts, "")
    part = (np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) - 1) // most
    edges = np.flatnonzero(np.concatenate([[True], np.diff(part) > 0, [True]])) if len(texts) else []
    for i, j in zip(edges[:-1], edges[1:]):
        yield texts.slice(i, j - i)


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(model_file: str) -> PrefixCounter:
    if model_file not in _COUNTERS:
        _COUNTERS[model_file] = PrefixCounter(model_file)
    return _COUNTERS[model_file]


def token_counts(docs: DataFrame, limit: int = 4096, model_file: str | None = None, prefixes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; with prefixes, also limit_chars (the longest prefix within
    the limit) and prefix_tokens (the count at every prefix, delta-coded as one byte string).

    Null text counts as empty: 0 bytes, 0 tokens. Null ids pass. Rows are independent; extra columns aren't read.
    """
    path = model_file or vocabulary_path()
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean" + ", limit_chars long, prefix_tokens binary" * prefixes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            size = pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64())
            cols = {"doc_id": b.column("doc_id"), "n_bytes": size}
            if prefixes:
                tables = [c.prefix_counts(x) for x in b.column("text").to_pylist()]
                n = [int(t[-1]) for t in tables]
            else:
                n = np.concatenate([c.count_column(x) for x in slices(b.column("text"))]) if len(b) else []
            cols |= {"n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())}
            if prefixes:
                cols |= {"limit_chars": pa.array([budget_chars(t, limit) for t in tables], pa.int64()), "prefix_tokens": pa.array([np.diff(t).astype(np.int8).tobytes() for t in tables], pa.binary())}
            yield pa.RecordBatch.from_pydict(cols)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op2(docs: DataFrame) -> DataFrame:
    return token_counts(docs)
