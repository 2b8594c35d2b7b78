import numpy as np
import pytest

from tarn.llm import common
from tarn.llm.binout import materialise, op9, permute, read_slots, shards_of
from tarn.llm.tokens import counter, vocabulary_path

S = "doc_id long, text string, slot string, shard int"


@pytest.mark.parametrize("size", [1, 2, 3, 10, 64, 1000, 4097])
def test_permutation(size):
    x = permute(np.arange(size), size, 7)
    assert sorted(x.tolist()) == list(range(size))
    assert size < 10 or x.tolist() != list(range(size))
    assert size < 64 or x.tolist() != permute(np.arange(size), size, 8).tolist()


@pytest.mark.parametrize("stable", [True, False])
def test_round_trip(spark, tmp_path, stable):
    rows = [(i, "some words %d é漢 " % i * (i % 23)) for i in range(70)] + [(70, None), (71, ""), (None, "no id here"), (3, "three words again"), (3, "three words again"), (72, "long " * 9000)]
    src = str(tmp_path / "in")
    spark.createDataFrame([(*r, "x", 1) for r in rows], S).repartition(3).write.parquet(src)
    place = f"file://{tmp_path}/out"
    index = materialise(spark.read.parquet(src), place, stride=32, shard=50, stable=stable).collect()
    n = max(r.slot for r in index) + 1
    data = read_slots(place, 0, n, 32, 50)
    assert len(data) == n and sorted({r.slot for r in index}) == list(range(n))
    assert read_slots(place, 47, 9, 32, 50).tolist() == data[47:56].tolist()
    c = counter(vocabulary_path())
    want = sorted(tuple(np.frombuffer(c.encode(t), "<u2").tolist() + [2]) for _, t in rows)
    sizes = {}
    for r in index:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.n_tokens
    for d in (70, 71, 72):
        assert sizes[d] == len(c.encode(dict(rows)[d])) // 2 + 1
    assert sum(r.n_tokens for r in index) == sum(map(len, want))
    own = sorted((r for r in index if r.doc_id in (5, 9)), key=lambda r: r.doc_id)
    for r in own:  # a fragment's tokens lie where the index says
        text = np.frombuffer(c.encode(dict(rows)[r.doc_id]), "<u2").tolist() + [2]
        got = data[r.slot, r.at : r.at + r.n_tokens].tolist()
        assert any(text[i : i + len(got)] == got for i in range(len(text)))


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], S)
    assert materialise(df, f"file://{tmp_path}/none").count() == 0


def test_shards_outlast_the_driver(spark, tmp_path):
    src = str(tmp_path / "docs")
    spark.createDataFrame([(i, f"some words {i}") for i in range(40)], "doc_id long, text string").write.parquet(src)
    spark.conf.set("tarn.output.dir", f"file://{tmp_path}/kept")
    try:
        op9(spark.read.parquet(src)).write.parquet(f"{tmp_path}/index")
    finally:
        spark.conf.unset("tarn.output.dir")
    place = shards_of(spark.read.parquet(f"{tmp_path}/index"))
    assert place.startswith(f"file://{tmp_path}/kept/") and not any(place.startswith(path) for _, path in common._WRITTEN)
    assert len(read_slots(place, 0, 5)) > 0
