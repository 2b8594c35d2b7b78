import hashlib
import random
import re

from tarn.llm.decontam import Scanner, decontaminated, find_items, op6

S = "doc_id long, text string, n_words string, items int"
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, items, size=13):
    wins = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for d, t in rows:
        w = WORD.findall(lower(t))
        hit, got = set(), set()
        for win, names in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    got |= names
        got = sorted(str(x) for x in got if x is not None)
        out.append((d, len(w), len(hit), len(got), hashlib.sha256(",".join(got).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def data():
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "B", "cé", "d9", "E", "f"]) + rng.choice(["", "x", "Y"])
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 12, 13, 14, 30])))) for i in range(12)] + [(12, None), (13, "..."), (None, "null item words here"), (5, "other words of five")]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.choice([0, 5, 40, 300]))]
        if rng.random() < 0.7:
            src = (rng.choice(items)[1] or "").split()
            k = rng.randint(0, max(0, len(src) - 13))
            w[len(w) // 2 : len(w) // 2] = src[k : k + 13 + rng.randint(0, 9)]
        rows.append((i, rng.choice([" ", ", ", "-\n"]).join(w)))
    return rows + [(60, None), (61, ""), (62, "?!"), (None, items[0][1]), (0, rows[0][1]), (63, (items[4][1] + " zz ") * 800)], items


def test_against_brute_force(spark):
    rows, items = data()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], S).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, op6(docs, bench).collect()), key=str) == brute(rows, items)
    kept = decontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r[-1] for r in brute(rows, items))


def test_spans_map_to_the_text():
    s = Scanner([("q", "What IS the capital")])
    text = "«Né» --What, is\nthe CAPITAL?"
    n, runs, items = s.scan(text)
    assert items == {"q"} and [text[i:j] for i, j in s.spans(text, runs)] == ["What, is\nthe CAPITAL"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 1)], S)
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:3] for r in op6(docs, none).collect()] == [(1, 2, 0)]
    assert find_items(docs.limit(0), none).count() == 0


def test_a_benchmark_in_parts_hits_as_a_whole_one(spark, monkeypatch):
    from tarn.llm import decontam

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    both = lambda: (sorted(map(str, decontam.find_items(docs, items).collect())), sorted(map(str, decontam.decontaminated(docs, items).collect())))
    whole = both()
    total = sum(len(r.text.encode()) for r in items.collect() if r.text)
    monkeypatch.setattr(decontam, "MOST_BYTES", total // 3)
    assert both() == whole and any("start=" in x for x in whole[0])
