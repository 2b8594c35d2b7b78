import hashlib
import zlib

import pytest

from tarn.llm import merkle

S = "doc_id long, source string, lang string, n_chars int, text string, node string, at int, path int"


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(r):
    return H("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r[:5]))


def climb(nodes):
    """All levels, from the nodes to the last one."""
    out = [nodes]
    while len(out[-1]) > 1:
        now = out[-1]
        out.append([H("".join(now[i : i + 16])) for i in range(0, len(now), 16)])
    return out


def siblings(levels, at):
    """(left, right) of each level on the way of the node at this place."""
    out = []
    for nodes in levels[:-1]:
        first = at // 16 * 16
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 16])))
        at //= 16
    return out


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    top = climb([trees[s][-1][0] for s in order])
    out = []
    for i, s in enumerate(order):
        for at, (_, _, h, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            way = siblings(trees[s], at) + siblings(top, i)
            own = h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                own = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for a, b in way:
                own = H(a + own + b)
            out.append((r[0], h, trees[s][-1][0], top[-1][0], H("".join(a + b for a, b in way)), own, own == top[-1][0]))
    return sorted(out, key=str)


def rows(sizes):
    n = 0
    for s, size in sizes:
        for i in range(size):
            n += 1
            yield (n * 7 % 10007, s, [None, "en", "é"][n % 3], None if n % 5 == 0 else n, [f"Text {n}", None, "", "lower", "Ünï " * (n % 50)][n % 5], "x", 1, 2)


@pytest.mark.parametrize("sizes", [
    [("a", 1)], [("a", 16)], [("a", 17), ("b", 1)], [(None, 3), ("", 257), ("z", 4097), ("é", 2), ("\U0001f600", 1), ("￮", 1)],
    [(f"s{i}", i % 4 + 1) for i in range(300)],
])
def test_against_brute_force(spark, sizes):
    data = list(rows(sizes))
    data += [data[0], (None, sizes[0][0], None, None, None, None, None, None), (-5, sizes[0][0], "x", 0, "A" * 200_000, None, None, None)]
    got = merkle.op12(spark.createDataFrame(data, S).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == brute(data)


@pytest.mark.parametrize("n,levels", [(1, 1), (15, 1), (16, 1), (17, 2), (256, 2), (300, 3), (4095, 3), (4096, 3)])
def test_paths_move_on_leaf_by_leaf(n, levels):
    leaves = [H(str(i)) for i in range(n)]
    tree = [leaves]
    for _ in range(levels):
        tree.append([H("".join(tree[-1][i : i + 16])) for i in range(0, len(tree[-1]), 16)])
    assert merkle.top(leaves, levels) == tree[-1][0]
    assert list(merkle.paths(leaves, levels)) == [siblings(tree, i) for i in range(n)]


def test_stacks_stay_small():
    t = merkle.Treehash(3)
    for i in range(4096 * 3):
        t.push(H(str(i)))
        assert all(len(x) < 16 for x in t.stack[:-1])


def test_rounds_of_small_blocks(spark, monkeypatch):
    """Several rounds, as a source of over 16 ** 6 rows takes them; and a source whose places come from several ranges."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    data = list(rows([("a", 700), (None, 40)]))
    got = merkle.op12(spark.createDataFrame(data, S).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == brute(data)


def test_whole_paths_prove_a_row(spark):
    data = list(rows([("a", 20), ("b", 5)]))
    got = merkle.manifest(spark.createDataFrame(data, S)).collect()
    assert len(got) == 25 and all(merkle.fold(r.leaf, [tuple(x) for x in r.path]) == r.root for r in got)
    assert not any(merkle.fold(H("other"), [tuple(x) for x in r.path]) == r.root for r in got)


def test_empty_table(spark):
    got = merkle.op12(spark.createDataFrame([], S))
    assert got.count() == 0 and got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_sql(spark):
    import duckdb

    data = [r[:5] for r in rows([(None, 3), ("", 30), ("z", 300), ("é", 1)])]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id bigint, source varchar, lang varchar, n_chars int, text varchar)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", data)
    assert sorted(c.execute(merkle.SQL).fetchall(), key=str) == brute(data)
