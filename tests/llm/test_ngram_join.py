import random

import pytest
from pyspark.sql import functions as F

from tarn.llm import ngram_join
from tarn.llm.ngram_join import Bands, ngram_components, representatives

S = "doc_id long, text string, n_shingles string, label int"


def brute(rows, k=4, percent=85):
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in w).split(" ") if x]
        n = min(k, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i), d)) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n=160):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    line = " ".join(word() for _ in range(12))
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.35 or not out:
            t = " ".join(word() for _ in range(rng.choice([1, 3, 4, 6, 12, 40, 90, 300, 900])))
        elif kind < 0.5:
            t = line + " " + " ".join(word() for _ in range(rng.randint(0, 6)))
        else:
            w = rng.choice(out)[1].split() or ["x"]
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
                w[rng.randrange(len(w))] = word()
            t = rng.choice([" ", "\n", "\t "]).join(w)
            t = t.upper() if rng.random() < 0.2 else t
        out.append((i * 7 % 1009, t))
    return out + [(5000, ""), (5001, None), (5002, "  \n"), (None, out[0][1]), (None, "lonely words of no id at all"), (5003, "é " * 3000), out[1], out[1]]


def group(seed, n=200):
    """Near copies of one text, many of them below the limit, some of them linked through others only."""
    rng = random.Random(seed)
    texts = [[f"w{i}" for i in range(150)]]
    while len(texts) < n:
        w = list(rng.choice(texts))
        for _ in range(rng.choice([1, 2, 4, 6, 7, 8, 9])):
            w[rng.randrange(len(w))] = f"v{rng.randrange(9999)}"
        texts.append(w)
    return [(9000 - i, " ".join(w)) for i, w in enumerate(texts)]


@pytest.mark.parametrize("seed, dear, block, k, percent", [(1, 8192, 1024, 4, 85), (2, 2, 1024, 4, 85), (3, 8192, 16, 5, 80), (4, 6, 8, 5, 80)])
def test_against_brute_force(spark, monkeypatch, seed, dear, block, k, percent):
    rows = corpus(seed) + group(seed)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], S).repartition(5)
    got = ngram_components(df, k, percent, dear=dear, part_bytes=50_000)
    assert got.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, k, percent)


def test_empty_table_and_representatives(spark):
    df = spark.createDataFrame([], S)
    assert ngram_components(df).count() == 0
    rows = corpus(9, 60)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], S)
    kept = representatives(df)
    assert kept.columns == df.columns
    want = {d for d, _, c in brute(rows, 5, 80) if d == c and d is not None}
    got = [r.doc_id for r in kept.where(F.col("doc_id").isNotNull()).collect()]
    assert sorted(got) == sorted(want)


def test_representatives_remove_rows_not_ids(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(1, text("a")), (2, text("a") + " more"), (2, text("b")), (3, text("b") + " more"), (4, text("c")), (4, text("d")), (4, text("d"))]
    rows += [(None, text("a") + " again"), (None, text("e")), (None, text("e")), (None, text("e") + " more"), (None, " "), (None, " "), (5, None), (5, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], S).repartition(3)
    got = [(r.doc_id, r.text) for r in representatives(df).collect()]
    alone = [r for r in got if r[0] is None and r[1].startswith("e")]
    assert len(alone) == 1
    want = [(1, text("a")), (2, text("b")), (4, text("c")), (4, text("d")), (None, " "), (None, " "), (5, None)]
    assert sorted(map(str, got)) == sorted(map(str, want + alone))


def test_linked_sets_share_a_signature():
    import numpy as np

    rng, bands = np.random.default_rng(5), Bands(85)
    for n in (1, 2, 3, 5, 8, 13, 21, 40, 75, 128, 200, 700):
        for _ in range(60):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            drop = int(rng.integers(0, n * 15 // 100 + 1))
            b = a[drop:]
            while 100 * len(b) >= 85 * (n + len(b) - (n - drop)) and rng.random() < 0.9:
                b = np.append(b, rng.integers(0, 2**63, 1, dtype=np.uint64))
            both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            if 100 * both >= 85 * either:
                assert len(np.intersect1d(bands.signatures(np.unique(a))[0], bands.signatures(np.unique(b))[0]))


def test_rows_that_share_a_hash_and_columns_of_any_name(spark, monkeypatch):
    from tarn.llm import ngram_join

    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(i, text(c), f"k{i}", f"g{i}", "s") for i, c in enumerate("abcabd")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string, _go string, _shared string")
    want = sorted((i, f"k{i}", f"g{i}") for i in (0, 1, 2, 5))
    got = lambda: sorted((r.doc_id, r._key, r._go) for r in representatives(df).collect())
    assert got() == want and representatives(df).columns == df.columns
    real = ngram_join.F.xxhash64

    def weak(*columns):  # the first hash tells only even from odd ids
        return ngram_join.F.pmod(ngram_join.F.col("doc_id"), ngram_join.F.lit(2)) if columns and isinstance(columns[0], str) and columns[0] == "doc_id" else real(*columns)

    monkeypatch.setattr(ngram_join.F, "xxhash64", weak)
    assert got() == want


def test_a_forest_joins_what_can_be_joined():
    import numpy as np

    from tarn.llm.ngram_join import _forest

    rng = np.random.default_rng(2)
    for size in (2, 3, 10, 80):
        for _ in range(20):
            far = rng.integers(0, 9, (size, size))
            far = np.where(rng.random((size, size)) < 2 / size, far, 99)
            far = np.minimum(far, far.T).astype(np.int16)
            label = rng.integers(0, size, size)

            def parts(pairs, label=label, size=size):
                to = {x: x for x in label.tolist()}
                for p, q in pairs:
                    a, b = to[label[p]], to[label[q]]
                    to = {k: min(a, b) if v in (a, b) else v for k, v in to.items()}
                return [to[x] for x in label.tolist()]

            p, q = _forest(far, label, 99)
            assert all(far[a, b] < 99 and label[a] != label[b] for a, b in zip(p, q)) and len(p) <= 2 * size
            assert parts(zip(p, q)) == parts(np.argwhere(far < 99))


def test_large_groups_in_blocks_are_whole_components(spark, monkeypatch):
    from tarn.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", 40)
    monkeypatch.setattr(ngram_join, "WOOD", 8)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):  # near copies of one text, each with a word of its own, and of another
        words = list(base) if i % 3 else [f"v{j}" for j in range(120)]
        words[rng.randrange(120)] = f"own{i}"
        rows.append((i, " ".join(words), "x", 1))
    rows += [(1000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(100)), "x", 1) for i in range(50)]
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string, other string, n int").repartition(4)).collect()
    sets = {r[0]: {tuple(r[1].split()[i : i + 4]) for i in range(len(r[1].split()) - 3)} for r in rows}
    label = {d: d for d in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {d: low if x == high else x for d, x in label.items()}
    assert {r.doc_id: r.component_id for r in got} == label


def test_links_within_large_groups_of_unlike_sets(spark, monkeypatch):
    """Pairs whose only common signature is one of a group that is dealt into blocks."""
    from pyspark.sql import functions as F

    from tarn.llm import ngram_join as nj

    monkeypatch.setattr(nj, "BLOCK", 4)
    texts = [" ".join(f"w{p}x{i}" for i in range(60)) + tail for p in range(20) for tail in ("", " end")]
    words = nj._Words()
    sets = [nj.shingles(x, 4, words) for x in texts]
    nodes = [nj.set_id(h) for h in sets]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("th", F.xxhash64("text"))
    rows = [(i, n, len(h), *nj.sketch(h).tolist()) for i, (n, h) in enumerate(zip(nodes, sets))]
    s = ", ".join(f"s{i} long" for i in range(nj.SKETCH))
    sketches = spark.createDataFrame(rows, f"doc_id long, node long, n int, {s}").join(docs.select("doc_id", "th"), "doc_id").drop("doc_id").withColumn("spare", F.array(F.lit(0)))
    groups = spark.createDataFrame([(64, n, len(nodes), 1) for n in nodes], "gid long, node long, size int, times int")
    labels = nj._links(docs, groups, spark.createDataFrame([], "a long, b long"), sketches, 4, 85, 8192, 16, 0)
    got = {(r.label, r.node) for r in labels.collect()}
    assert got == {(min(x), max(x)) for x in zip(nodes[::2], nodes[1::2])}


def test_of_groups_with_the_same_sets_one_is_looked_at_again(spark):
    from tarn.llm.ngram_join import _once

    held = {1: [5, 6], 2: [6, 5], 3: [5, 6, 7], 4: [8], 5: [7, 6, 5], 6: [5, 7]}
    rows = [(g, n) for g, nodes in held.items() for n in nodes]
    got = _once(spark.createDataFrame(rows, "gid long, node long")).collect()
    assert sorted(map(tuple, got)) == [(1, 5), (1, 6), (3, 5), (3, 6), (3, 7), (6, 5), (6, 7)]


def test_wide_sketches_keep_links_and_tell_long_sets_apart(spark):
    import numpy as np

    from tarn.llm.ngram_join import SKETCH, _near_wide, sketch, wide_sketch

    rng = np.random.default_rng(4)
    first, other = (rng.integers(0, 2**63, 4000, dtype=np.uint64) for _ in range(2))
    linked = np.concatenate([first[:3700], other[:100]])
    sets = [np.unique(x) for x in (first, linked, other)]
    differ = np.bitwise_count(sketch(sets[0]).view(np.uint64) ^ sketch(sets[2]).view(np.uint64)).sum()
    assert differ <= min(20 * 8000 // 180, 64 * SKETCH)  # the narrow ones don't
    again = spark.createDataFrame([(i, len(h), wide_sketch(h).tolist()) for i, h in enumerate(sets)], "node long, n int, wide array<long>")
    got = _near_wide(spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "a long, b long"), again, 80)
    assert [tuple(r) for r in got.collect()] == [(0, 1)]


def test_only_the_sets_of_the_pairs_in_question_are_compared(spark, monkeypatch):
    """A first pass that tests no pair of a cluster but its neighbours leaves later passes a few pairs: these bring only their own sets."""
    from tarn.llm import ngram_join as nj

    real, seen = nj._verified, []

    def verified(pairs, sets, percent):
        seen.append((sets.count(), len({x for r in pairs.collect() for x in r})))
        return real(pairs, sets, percent)

    monkeypatch.setattr(nj, "_verified", verified)
    rows = corpus(3) + group(3)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], S).repartition(5)
    assert sorted(map(tuple, ngram_components(df, 5, 80).collect()), key=str) == brute(rows, 5, 80)
    assert seen and all(sent == asked for sent, asked in seen)


def test_groups_with_close_pairs_besides_those_given_are_named(spark):
    from tarn.llm import ngram_join as nj

    def wide(*bits):
        words = [0] * nj.WIDE
        for b in bits:
            words[b // 32] |= 1 << b % 32
        return words

    # sets of 100 of which 22 may differ: 0, 1 and 2 are close to each other, 3 and 4 too, 5 is close to nothing
    sketches = spark.createDataFrame([(0, 100, wide()), (1, 100, wide(1)), (2, 100, wide(2, 3)), (3, 100, wide(*range(100, 200))), (4, 100, wide(*range(101, 200))), (5, 100, wide(*range(300, 400)))], "node long, n int, wide array<long>")

    def given(groups, every=False):
        rows = [(g, n, n, True, len(nodes), len(nodes)) for g, nodes in groups.items() for n in nodes]
        members = spark.createDataFrame(rows, "gid long, node long, label long, u boolean, nu long, nv long")
        got = nj._candidates(members, sketches, 80, every, words=nj.WIDE, rest=True).collect()
        return {(r.a, r.b) for r in got if r.gid is None}, {r.gid for r in got if r.gid is not None}

    groups = {7: [0, 1, 2, 5], 8: [3, 4, 5], 9: [0, 3, 5], 10: [0, 5]}
    assert given(groups) == ({(0, 1), (0, 2), (3, 4)}, {7})
    assert given(groups, every=True) == ({(0, 1), (0, 2), (1, 2), (3, 4)}, set())
    limit, nj.WOOD = nj.WOOD, 1
    try:
        assert given(groups)[1] == {7}  # by forests
    finally:
        nj.WOOD = limit


def test_later_looks_are_at_groups_with_more_close_pairs(spark, monkeypatch):
    """Groups whose close pairs across components were all given aren't looked at again, and without others the first look is the last."""
    from tarn.llm import ngram_join as nj

    real, looks = nj._candidates, []

    def candidates(members, sketches, percent, every=False, *more, words=nj.SKETCH, **named):
        if words == nj.WIDE:
            looks.append(members.select("gid").distinct().count())
        return real(members, sketches, percent, every, *more, words=words, **named)

    monkeypatch.setattr(nj, "_candidates", candidates)
    rows = [(2 * i + j, " ".join(f"w{i}x{k}" for k in range(80)) + " end" * j) for i in range(20) for j in range(2)]
    got = ngram_components(spark.createDataFrame([(*r, "x", 1) for r in rows], S).repartition(3), 5, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: d // 2 * 2 for d, _ in rows}
    assert len(looks) == 1
    looks.clear()
    rows = corpus(3) + group(3)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], S).repartition(5)
    assert sorted(map(tuple, ngram_components(df, 5, 80).collect()), key=str) == brute(rows, 5, 80)
    assert all(x >= y for x, y in zip(looks, looks[1:]))


def test_sets_are_written_where_they_are_made(spark, monkeypatch):
    """Copies in several tasks give a set several rows; one of them counts, and none is sent to find that out."""
    from tarn.llm import ngram_join as nj

    real, plans, seen = nj.written, {}, {}

    def written(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        out = real(df, name)
        if name in ("sets", "again", "rows"):
            seen[name] = [r.node for r in out.select("node").collect()] if name != "rows" or "node" in out.columns else []
        return out

    monkeypatch.setattr(nj, "written", written)
    texts = [" ".join(f"w{i}x{k}" for k in range(80)) + " end" * j for i in range(10) for j in range(2)]
    rows = [(100 * c + d, text, "x", 1) for c in range(6) for d, text in enumerate(texts)]
    got = ngram_components(spark.createDataFrame(rows, S).repartition(6)).collect()
    assert {r.doc_id: r.component_id for r in got} == {r[0]: r[0] % 100 // 2 * 2 for r in rows}
    assert "Exchange" not in plans["sets"].replace("Exchange RoundRobinPartitioning", "")
    assert len(seen["sets"]) > len(set(seen["sets"])) == 20 == len(seen["again"]) == len(seen["rows"])
