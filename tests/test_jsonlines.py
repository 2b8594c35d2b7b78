"""JSON lines: strict, tolerant and marked, in parts, over files, and as a stream; records of files of any shape; checked writes."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tarn.operators import compaction
from tarn.sources import jsonlines, readers, writers

BAD = ['{"id": "a"} trailing', "[1]", '"text"', "7", "null", '{"id": "torn', '{"id": 1,}', "{'id': 1}", "[" * 100_000]


def test_lines_of_any_part_are_read_once(tmp_path):
    f = tmp_path / "x"
    body = ["", "a", "bb", "", "ccc" * 5, "d\r", "é" * 3, "last"]
    f.write_bytes("\n".join(body).encode())
    whole = [(o, n, line.decode()) for o, n, line in jsonlines.lines(str(f), 0, None)]
    assert [x for _, _, x in whole] == body and [n for _, n, _ in whole] == list(range(1, 9))
    size = f.stat().st_size
    for part in range(1, size + 2):
        got = [(o, line.decode()) for at in range(0, size, part) for o, _, line in jsonlines.lines(str(f), at, min(at + part, size))]
        assert got == [(o, x) for o, _, x in whole], part
    assert [line for _, _, line in jsonlines.lines(str(f), 0, None, ended=True)][-1] == "é".encode() * 3


def test_small_buffers(tmp_path, monkeypatch):
    f = tmp_path / "x"
    f.write_bytes(b"ab\n" + b"c" * 50 + b"\n\nend")
    want = list(jsonlines.lines(str(f), 0, None))
    for size in (1, 2, 7):
        monkeypatch.setattr(jsonlines, "_BUFFER", size)
        assert list(jsonlines.lines(str(f), 0, None)) == want


@pytest.mark.parametrize("bad", BAD)
def test_a_line_that_is_no_object(spark, tmp_path, bad):
    (tmp_path / "a.jsonl").write_text('{"id": "ok"}\n')
    (tmp_path / "b.jsonl").write_text('{"id": "x"}\n\n' + bad + '\n{"id": "y", "id": "z"}\n')
    schema = spark.createDataFrame([], "id string").schema
    with pytest.raises(Exception, match=r"b\.jsonl:3: "):
        readers.strict_jsonl(spark, str(tmp_path / "*.jsonl"), schema, part_bytes=5).collect()
    kept = readers.tolerant_jsonl(spark, str(tmp_path), schema, part_bytes=5).collect()
    assert sorted(r.id for r in kept) == ["ok", "x", "z"]
    marked = readers.json_lines(spark, str(tmp_path), "marked").where("error is not null").collect()
    assert [(Path(r.path).name, r.line) for r in marked] == [("b.jsonl", 3)]


def test_a_log_of_several_files_has_an_order(spark, tmp_path):
    (tmp_path / "log-1.jsonl").write_text('{"id": "a", "v": 1}\n{"id": "b", "v": 1}\n{"id": "a", "v": 2}\n')
    (tmp_path / "log-2.jsonl").write_text('{"id": "b", "v": 3}\n{"id": "c", "v')
    schema = spark.createDataFrame([], "id string, v int").schema
    rows = readers.partitioned_log(spark, str(tmp_path / "log-*.jsonl"), schema)
    assert sorted((r.id, r.v) for r in compaction.latest(rows, "id", ["file_path", "offset"]).collect()) == [("a", 2), ("b", 3)]
    assert readers.partitioned_log(spark, str(tmp_path / "none-*"), schema).count() == 0
    assert readers.first_record(spark, str(tmp_path), schema).first().v == 1


def test_a_stream_of_what_was_appended(spark, tmp_path):
    src, ck, out = (tmp_path / n for n in ("src", "ck", "out"))
    src.mkdir()
    (src / "a").write_text('{"id": 1}\nbroken\n{"id": 2}')
    jsonlines.register(spark)

    def run():
        q = spark.readStream.format("tarn_jsonl").option("path", str(src)).load().writeStream.format("parquet").option("checkpointLocation", str(ck)).trigger(availableNow=True).start(str(out))
        q.awaitTermination()
        return sorted(json.loads(r.value)["id"] for r in spark.read.parquet(str(out)).collect())

    assert run() == [1]  # the second line has no end yet
    with (src / "a").open("a") as f:
        f.write('\n{"id": 3}\n')
    (src / "b").write_text('{"id": 4}\n')
    assert run() == [1, 2, 3, 4] and run() == [1, 2, 3, 4]


@pytest.mark.parametrize("name,body,records,errors", [
    ("a.json", '{"id":"a"} trailing\n{"id":"b"}\n{"id":"c"}', 2, 1), ("b.json", '{"a":1},\n{"a":2},', 0, 2), ("c.json", '[1]\n{"a":1}\n{"a":2}', 2, 1), ("d.json", '{"a":\n1}\n{"b":\n2}', 0, 4),
    ("e.json", '{"a":1}\n{"a":2}\n', 2, 0), ("f.json", '{"a": 1,\n "data": [{"b": 1}, 2, {"b": 3}]}', 2, 1), ("g.jsonl", '{"data": [{"b": 1}]}', 1, 0), ("h.json", "", 0, 0), ("i.json", "7", 0, 1), ("j.json", '{"a": 1, "a": 2}', 1, 0),
    ("k.json", "[]", 0, 0), ("l.json", '[{"a": 1}, null]', 1, 1),
])
def test_no_record_of_a_file_is_lost(spark, tmp_path, name, body, records, errors):
    (tmp_path / name).write_text(body)
    got = readers.json_records(spark, str(tmp_path / name)).collect()
    assert (sum(r.record is not None for r in got), sum(r.error is not None for r in got)) == (records, errors)
    if name == "j.json":
        assert json.loads(got[0].record) == {"a": 2}
    if name == "f.json":
        assert readers.json_records(spark, str(tmp_path / name), ()).count() == 1


def test_what_is_written_is_as_expected_or_not_there(spark, tmp_path):
    rows, at = spark.range(10).withColumn("k", F.col("id") % 3), f"file://{tmp_path}/t"
    n = {"rows": (F.count(F.lit(1)), 10)}
    assert writers.checked(rows, at, n, ["id"]).count() == 10
    with pytest.raises(ValueError, match="rows: expected 11, found 10"):
        writers.checked(rows, at, {"rows": (F.count(F.lit(1)), 11)})
    with pytest.raises(ValueError, match="repeated k"):
        writers.checked(rows, at, n, ["k"])
    assert spark.read.parquet(at).count() == 10 and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]


def test_the_last_value_by_an_order(spark):
    from tarn.operators import stats

    rows = spark.createDataFrame([("u", "A", 5.0, 1), ("u", "A", 1.0, 2), ("u", "B", None, 1), ("u", "B", 7.0, 0)], "k string, level string, m double, at int")
    assert [tuple(r) for r in stats.by_level(rows, ["k"], "level", [("A", "B")], ["m"]).collect()] == [("u", "A", "B", "m", 5.0, 7.0)]
    assert stats.by_level(rows, ["k"], "level", [("A", "B")], ["m"], ["at"]).count() == 0  # B's last value is null
    last = stats.by_level(rows.where("m is not null"), ["k"], "level", [("A", "B")], ["m"], ["at"]).first()
    assert (last.left, last.right) == (1.0, 7.0)


def test_jobs_without_a_prompt_or_size_aren_t_admitted(spark):
    sha = "(select sha2('p', 256))"
    jobs = spark.sql(f"select 1 as job_id, 'p' as p, {sha} as h, 1 as n, 1 as m union all select 2, null, {sha}, 1, 1 union all select 3, 'p', null, 1, 1 union all select 4, 'p', {sha}, null, 1")
    ok, bad = compaction.admitted(jobs, "p", "h", "n", "m", 10)
    assert [r.job_id for r in ok.collect()] == [1] and sorted(map(tuple, bad.collect())) == [(2, "PromptHashMismatch"), (3, "PromptHashMismatch"), (4, "ContextOverflow")]


def test_state_of_keys_over_batches_and_a_restart(spark, tmp_path):
    from tarn.streaming import log, state

    state.state_store(spark)
    src, out, once, ck = (str(tmp_path / n) for n in ("src", "out", "once", "ck"))
    Path(src).mkdir()
    schema = spark.createDataFrame([], "id string, at long, v string").schema
    batches = [[("a", 1, "x"), ("a", 3, "y"), ("b", 1, None)], [("a", 2, "old"), ("b", None, "less"), (None, 9, "no key"), ("", 9, "no key")], [("b", 5, "z"), ("c", 1, "w"), ("a", 3, "same")]]
    everything = []
    for i, rows in enumerate(batches):
        everything += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
        seen = []
        q = state.latest(log.follow(spark, src, schema), "id", ["at"]).writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend(map(tuple, b.collect())))
        q.option("checkpointLocation", f"{ck}1").trigger(availableNow=True).start().awaitTermination()  # a new query each time goes on where the last one was
        if seen:
            spark.createDataFrame([(i, *r) for r in seen], "batch int, id string, at long, v string").write.mode("append").parquet(out)
        state.append_first(log.follow(spark, src, schema), "id", ["at"], once, f"{ck}2").awaitTermination()
    given = spark.read.parquet(out)
    assert sorted(map(tuple, given.collect())) == [(0, "a", 3, "y"), (0, "b", 1, None), (2, "b", 5, "z"), (2, "c", 1, "w")]
    last = compaction.latest(given, "id", ["batch"]).select("id", "at", "v")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, compaction.latest(spark.createDataFrame(everything, schema).where("v is null or v <> 'same'"), "id", ["at"]).collect()))
    assert sorted((r.id, r.at) for r in spark.read.parquet(once).collect()) == [("a", 1), ("b", 1), ("c", 1)]
