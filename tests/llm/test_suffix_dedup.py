import hashlib
import random

import numpy as np
import pytest

from tarn.llm.suffix_dedup import CONTEXT, LENGTH, Runs, anchors, merge_runs, op4, remove_repeats

S = "doc_id long, text string, n_bytes string, id int"


def brute(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    raws = [(t or "").encode() for _, t in rows]
    first, out = {}, []
    for i in order:
        for p in range(len(raws[i]) - LENGTH + 1):
            first.setdefault(raws[i][p : p + LENGTH], (rows[i][0], p))
    for (d, _), raw in zip(rows, raws):
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - LENGTH + 1):
            if first[raw[p : p + LENGTH]] != (d, p):
                gone[p : p + LENGTH] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    text = lambda m: "".join(rng.choice("abcdeé \n") for _ in range(m))
    passages = [text(m) for m in (40, 90, 99, 100, 101, 130, 300)]
    out = []
    for i in range(n):
        t = text(rng.choice([0, 20, 99, 100, 150, 600]))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages + [x for _, x in out[-5:]])
            a = rng.randint(0, max(0, len(p) // 2))
            at = rng.randint(0, len(t))
            t = t[:at] + p[a : a + rng.choice([80, 100, 120, 900])] + t[at:]
        out.append((i * 37 % 101, t))
    out += [(200, "ab" * 400), (201, "x" * 99), (202, "x" * 100), (203, "x" * 250), (204, "ab" * 60), (205, None), (206, ""), (207, text(9000)), (208, out[3][1])]
    out += [(209, out[-2][1][10:5000] + text(300) + out[-2][1][4000:]), out[5], (None, out[7][1] + "tail")]
    return out


@pytest.mark.parametrize("seed, hot", [(1, 4096), (2, 4096), (2, 0), (3, 5)])
def test_against_brute_force(spark, seed, hot):
    rows = corpus(seed)
    shared = "".join(random.Random(9).choice("xyz") for _ in range(230))
    rows = [(d, t[:50] + shared + t[50:] if t and d is not None and d % 2 else t) for d, t in rows]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], S).repartition(5)
    assert sorted(map(tuple, op4(df, hot).collect()), key=str) == brute(rows)


def test_outputs_and_empty_table(spark):
    rows = corpus(7, 20)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], S)
    for r in remove_repeats(df).collect():
        assert len(r.kept) == r.n_bytes - sum(r.ends) + sum(r.starts)
    assert op4(df.limit(0)).count() == 0


def test_anchors_of_long_texts(monkeypatch):
    import tarn.llm.suffix_dedup as m

    raw = np.random.default_rng(1).integers(97, 101, 5000).astype(np.uint8)
    whole = set(anchors(raw)[0].tolist())
    monkeypatch.setattr(m, "PIECE", 700)
    assert whole <= set(anchors(raw)[0].tolist())


def test_merge_of_front_coded_runs():
    rng = np.random.default_rng(2)
    keys = rng.integers(97, 99, (400, 12)).astype(np.uint8)
    runs = []
    for part in np.array_split(keys, 7):
        part = part[np.lexsort(part.T[::-1])]
        runs.append(Runs.decode(*Runs.code(part), 12))
    got = list(merge_runs(runs))
    texts = [t for _, _, t in got]
    assert texts == sorted(k.tobytes() for k in keys)
    for (_, _, a), (_, n, b) in zip(got, got[1:]):
        assert a[:n] == b[:n] and (n == 12 or a[n] != b[n])
    assert CONTEXT == 176


def test_strings_of_an_anchor_by_blocks_of_places(monkeypatch):
    """However few hashes are held, the strings that occur earlier are those that a plain search finds."""
    import numpy as np

    import tarn.llm.suffix_dedup as m

    rng = np.random.default_rng(5)
    parts = [rng.integers(97, 99, m.CONTEXT, dtype=np.uint8) for _ in range(3)]
    keys = np.array([np.concatenate([parts[rng.integers(3)][: m.LENGTH], parts[rng.integers(3)][: m.BEFORE]]) for _ in range(40)])
    for row in keys:
        row[m.LENGTH + rng.integers(0, m.BEFORE) :] = rng.integers(0, 256)
    own = np.stack([np.arange(40), np.zeros(40, int)], 1)
    when, size = np.arange(40) << 32 | 200, np.full((40, 2), (m.BEFORE, m.LENGTH))
    text = [bytes(np.concatenate([k[m.LENGTH :][::-1], k[: m.LENGTH]])) for k in keys]
    want, seen = set(), set()
    for d, t in enumerate(text):
        own_strings = [(j, t[j : j + m.LENGTH]) for j in range(m.BEFORE + 1)]
        want |= {(d, 200 - m.BEFORE + j + i) for j, x in own_strings if (j, x) in seen for i in range(m.LENGTH)}
        seen |= set(own_strings)
    assert want
    for held in (1, 500, 2_000_000):
        monkeypatch.setattr(m, "HELD", held)
        o, s, e = m._repeated_strings(keys, np.arange(40), own, when, size)
        assert {(int(d), x) for (d, _), i, j in zip(o, s, e) for x in range(i, j)} == want
    monkeypatch.setattr(m, "string_hashes", lambda rows, seed=0: np.zeros((len(rows), rows.shape[1] - m.LENGTH + 1), np.uint64))
    o, s, e = m._repeated_strings(keys, np.arange(40), own, when, size)  # hashes that tell nothing: the bytes decide
    assert {(int(d), x) for (d, _), i, j in zip(o, s, e) for x in range(i, j)} == want
