import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.llm.tokens import PrefixCounter, budget_chars, slices, token_counts, vocabulary_path


@pytest.fixture(scope="module")
def counter():
    return PrefixCounter(vocabulary_path(), cache=5000)


WORDS = st.sampled_from([" ", "  ", "\n", "\t", "▁", "the", "ing", "ation", "Über", "ñ", "漢", "😀", "<s>", "</s>", "<0x0A>", "...", "123", "x́", " ", "ſ", "²"])
SAMPLES = ["", " ", "  a", "a ", "a\n b", "\n", "▁", "▁▁a", "é😀漢字 ", "a" * 300, "漢" * 80, "x y" * 40, "<s> </s><unk>", "1,234.50", "   "]


def check(counter, text):
    sp = counter.sp
    assert counter.count(text) == len(sp.encode(text))
    assert list(np.frombuffer(counter.encode(text), "<u2")) == sp.encode(text)
    assert counter.prefix_counts(text).tolist() == [len(sp.encode(text[:i])) for i in range(len(text) + 1)]


@pytest.mark.parametrize("text", SAMPLES)
def test_samples(counter, text):
    check(counter, text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(WORDS, st.text(max_size=6).filter(lambda s: not any("\ud800" <= c <= "\udfff" for c in s))), max_size=12))
def test_against_the_library(counter, parts):
    check(counter, "".join(parts))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(WORDS, st.sampled_from(["a b", "one two", "x"])), max_size=5).map("".join), max_size=8))
def test_columns(counter, texts):
    want = [counter.sp.encode(t) for t in texts]
    got = [(n, *counter.encode_column(s)) for s in slices(pa.array([t or None for t in texts], pa.string()), 9) for n in [counter.count_column(s)]]
    assert [x for n, _, _ in got for x in n] == [x for _, _, n in got for x in n] == list(map(len, want))
    assert [x for _, flat, _ in got for x in flat] == sum(want, [])


def test_query(spark, counter):
    rows = [(i, t) for i, t in enumerate(SAMPLES)] + [(99, None), (None, "some words"), (3, SAMPLES[3]), (100, "the word " * 30000)]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, n_tokens string, n_bytes int").repartition(3)
    got = sorted(map(tuple, token_counts(df, limit=50).collect()), key=str)
    want = [(d, len((t or "").encode()), n := len(counter.sp.encode(t or "")), n > 50) for d, t in rows]
    assert got == sorted(want, key=str)
    for r in token_counts(df, limit=50, prefixes=True).collect():
        assert np.frombuffer(r.prefix_tokens, np.int8).sum(dtype=np.int64) == r.n_tokens
    assert token_counts(df.limit(0)).count() == 0


def test_budget(counter):
    text = SAMPLES[8] * 5
    n = budget_chars(counter.prefix_counts(text), 10)
    assert len(counter.sp.encode(text[:n])) <= 10 and all(len(counter.sp.encode(text[:i])) > 10 for i in range(n + 1, len(text) + 1))
