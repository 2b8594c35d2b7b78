import math
import random
import re
from collections import Counter

import pytest

from tarn.llm import search

S = "doc_id long, text string, score int, item int, rank string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, k=20):
    tf = [(d, Counter(words(t))) for d, t in docs]
    tf = [(d, c, sum(c.values())) for d, c in tf if c]
    n_docs, n_terms = len(tf), sum(n for _, _, n in tf)
    df = Counter(w for _, c, _ in tf for w in c)
    out = []
    for name, t in items:
        scores = []
        for d, c, n in tf:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 12 * m)) for w, q in Counter(words(t)).items() if c[w])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(name, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def texts(n, seed):
    r = random.Random(seed)
    common, rare = ["the", "of", "IN", "and"], [f"w{i}" for i in range(400)] + ["É", "é", "日本語", "x9"]
    return [" ".join(r.choice(common) if r.random() < 0.5 else r.choice(rare) for _ in range(r.randint(1, 60))) for _ in range(n)]


DOCS = [*enumerate(texts(600, 1)), (5000, None), (5001, ""), (5002, "-- !!"), (5003, "the " * 3000 + "w1"), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (7, "w1 w2 w3"), *[(6000 + i, "w5 w6, the W7") for i in range(120)]]
ITEMS = [*enumerate(texts(25, 2)), (100, None), (101, "..."), (102, "the"), (103, "w1 w2 w3"), (103, "w1 w2 w3"), (104, "w5 w6 w7 w7 of the"), (None, "é"), (105, "nowhere")]


def frames(spark):
    return spark.createDataFrame([(d, t, 1, 2, "x") for d, t in DOCS], S).repartition(5), spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, doc_id int")


@pytest.mark.parametrize("first,second,candidates", [(2048, 65536, 4096), (10, 40, 4096), (1, 5, 4096), (30, 60, 10)])
def test_against_brute_force(spark, first, second, candidates):
    docs, items = frames(spark)
    got = search.search(docs, items, first=first, second=second, candidates=candidates)
    assert sorted(map(tuple, got.collect()), key=str) == brute(DOCS, ITEMS)


def test_blocks_and_parts(spark, monkeypatch):
    docs, items = frames(spark)
    got = search.search(docs, items, most_bytes=1500, first=20, second=50)
    assert sorted(map(tuple, got.collect()), key=str) == brute(DOCS, ITEMS)


def test_each_tier_proves_some(spark):
    docs, items = frames(spark)
    asked = search.load_items(items)
    index = search.build(docs, asked.terms, 30, 60)
    _, proven = search.ask(index, asked)
    assert sum(proven) == len(asked.items) and proven[0] > 0 and proven[2] > 0


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(search, "_PIECE", 10)
    for t in ("aa bb,cc  dddddddddddddddddd ee", "x" * 35, " " * 30, "", "A,b " * 20):
        assert [w.decode() for ws in search.words(t.encode()) for w in ws] == words(t)


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert search.op13(docs.limit(0), items).count() == 0
    assert search.op13(docs, items.limit(0)).count() == 0
    assert search.op13(docs.where("doc_id = 5001"), items).count() == 0


def test_sql(spark):
    import duckdb

    c = duckdb.connect()
    docs = [x for x in DOCS if x[0] is not None and x[0] != 7]
    items = [x for x in ITEMS if x[0] not in (None, 103)]
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        c.execute(f"CREATE TABLE {name} ({key} bigint, text varchar)")
        c.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    assert sorted(c.execute(search.SQL).fetchall(), key=str) == brute(docs, items)
