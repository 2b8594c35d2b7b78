"""Published results recomputed, and rules of the evaluation tables on literal rows."""

import csv
import json
import math
import random
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tarn.functions import nested, prompts, text
from tarn.operators import compaction, corpus, drift, scoring, stats
from tarn.sources import readers, writers
from tarn.streaming import log

PUBLISHED = os.environ.get("TARN_PUBLISHED", "")  # a folder of published tables as CSV
golden = pytest.mark.skipif(not PUBLISHED, reason="no folder of published tables is named")


def published(has, lacks=()):
    """The rows of the table whose columns have all of some names and none of others."""
    for p in sorted(Path(PUBLISHED).glob("*.csv")):
        with open(p, encoding="utf-8") as f:
            rows = list(csv.DictReader(f))
        names = " ".join(rows[0]).split() if rows else []
        if all(any(c == h or c.endswith(h) for c in names) for h in has) and not any(c in lacks for c in names):
            return rows
    raise LookupError(has)


@golden
def test_published_exact_and_adjusted_p(spark):
    rows = published(["mcnemar_exact_p", "p_holm"])
    assert len(rows) == 297
    df = spark.createDataFrame([(i, int(r["left_1_right_0"]), int(r["left_0_right_1"]), float(r["mcnemar_exact_p"])) for i, r in enumerate(rows)], "i int, b long, c long, given double")
    got = {r.i: r for r in stats.holm(df.withColumn("p", stats.mcnemar("b", "c")), "given", order=["i"]).collect()}
    for i, r in enumerate(rows):
        assert got[i].p == pytest.approx(float(r["mcnemar_exact_p"]), rel=1e-9, abs=1e-15)
        assert got[i].p_holm == pytest.approx(float(r["p_holm"]), rel=1e-9, abs=1e-15)
        assert got[i].significant == int(r["significant_holm_005"])


@golden
def test_published_means_of_drift_agree():
    by = {}
    for r in published(["dataset", "transition", "mean"], ["field"]):
        n = next(float(v) for k, v in r.items() if k in ("n", "documents", "psi_n", "count") or k.endswith("_n"))
        mean = next(float(v) for k, v in r.items() if k.endswith("mean"))
        t = by.setdefault((r["model_id"], r["dataset"]), [0.0, 0.0])
        t[0] += n
        t[1] += n * mean
    for r in published(["dataset", "mean"], ["field", "transition"]):
        n, total = by[r["model_id"], r["dataset"]]
        assert total / n == pytest.approx(next(float(v) for k, v in r.items() if k.endswith("mean")), rel=1e-9)


def test_signed_rank_and_correlation_p(spark):
    pairs = spark.createDataFrame([("a", 0.0, float(x)) for x in (1, -2, 3, 4, 5, 6, 7, 8)] + [("z", 1.0, 1.0), ("n", float("nan"), 1.0)], "k string, l double, r double")
    got = {r.k: r for r in stats.wilcoxon(pairs, ["k"], "l", "r").collect()}
    assert (got["a"].w, got["a"].p, got["z"].p) == (2.0, pytest.approx(6 / 256), 1.0) and "n" not in got
    xy = spark.createDataFrame([("k", float(i), float(j)) for i, j in enumerate([1, 3, 2, 5, 4, 6])] + [("k", math.inf, 1.0), ("k", 1.0, math.nan)], "k string, x double, y double")
    r = stats.spearman(xy, ["k"], "x", "y").first()
    assert (r.n, r.rho, r.p) == (6, pytest.approx(0.8857142857), pytest.approx(0.0188454812, rel=1e-6))


def test_bootstrap_of_large_groups_takes_the_same_draws(spark):
    rows = spark.createDataFrame([("a", float(i * i % 17)) for i in range(40)] + [("b", 3.0), (None, 1.0), (None, 2.0)], "k string, x double")
    key = lambda df: sorted((str(r.k), r.n, round(r.mean, 9), round(r.ci_low, 9), round(r.ci_high, 9)) for r in df.collect())
    small, large = (key(stats.bootstrap_mean(rows, ["k"], "x", 200, most=m)) for m in (20_000, 0))
    assert small == large and ("b", 1, 3.0, 3.0, 3.0) in small
    assert stats.bootstrap_mean(rows.limit(0), ["k"], "x").count() == 0


def test_scoring_table_rules(spark):
    jobs = spark.createDataFrame([("j1", 1), ("j2", 1)], "job_id string, record_id int")
    gold = spark.createDataFrame([(1, "The Cat sat", json.dumps({"entities": [{"text": "cat", "type": "A"}, {"text": "cat", "type": "A"}], "relations": []}))], "record_id int, input_text string, gold_output string")
    out = json.dumps({"entities": [{"text": " CAT ", "type": "a"}, 3, {"text": "dog", "type": "A"}, {"text": "", "type": "A"}], "relations": []})
    preds = spark.createDataFrame([("j1", out), ("j2", None), ("unknown", out)], "job_id string, parsed_output string")
    got = {r.job_id: r for r in scoring.job_metrics(preds, jobs, gold, ["record_id"]).collect()}
    assert set(got) == {"j1", "j2"}
    a, b = got["j1"], got["j2"]
    assert (a.predicted_entities, a.unsupported_entities, a.hallucinated_entity_rate, a.entity_exact_f1, a.relation_exact_f1) == (2, 1, 0.5, 0.5, 1.0)
    assert (b.hallucinated_entity_rate, b.entity_exact_f1, b.entity_partial_f1, b.relation_f1_applicable) == (0.0, 0.0, 0.0, False)
    with pytest.raises(Exception, match="no gold record"):
        scoring.job_metrics(preds, jobs, gold.limit(0), ["record_id"]).collect()
    with pytest.raises(Exception, match="several gold records"):
        scoring.job_metrics(preds, jobs, gold.union(gold), ["record_id"]).collect()


def test_free_form_predictions():
    aliases = {"task": "Task", "otherterm": "Other"}
    fields = ["Task", "Other", "__RELATIONS__"]
    one = nested.fields_of({"Task": ["b", {"name": "A"}, "B "], "other term": 0, "relations": {"x": {"subject": "h", "object": "t"}, "y": {"id": 1, "k": 2}}}, fields, aliases)
    assert one == {"Task": ["A", "b"], "Other": [], "__RELATIONS__": ["h --[related_to]--> t", "k=2"]}
    two = nested.fields_of({"entities": [{"label": "TASK", "span": "x"}, "junk", {"type": "none", "text": "y"}]}, fields, aliases)
    assert two["Task"] == ["x"] and nested.fields_of([1], fields, aliases)["Task"] == []
    assert nested.found_object("[" * 100_000 + "{" + '"a":' * 3) == (None, None)
    assert json.loads(nested.first_object('{"a": NaN, "b": [Infinity]}')) == {"a": "nan", "b": ["inf"]}
    assert nested.named_count({"x": [{"Entities": "[[1, 2], [3]]"}], "entities": {"a": 1}}, frozenset(["entities"])) == 4
    assert nested.text_within({"data": {"sentences": ["a ", "b"]}}, ("text", "sentences"), ("data",)) == "a b"


def test_prompts_and_paths(spark):
    row = spark.range(1).select(text.padded(F.lit("s"), F.array(F.lit("aa"), F.lit("b")), F.lit(20)).alias("q")).first()
    assert row.q == "s\naa\nb\naa\nb\naa\nb\naa\nb"[: len(row.q)] and 20 <= len(row.q) <= 23
    table = prompts.condition_table(spark)
    values = {n: F.lit(f"<{n}>") for n in ("task", "schema", "definitions", "demo", "demos", "compressed")} | {"input": F.concat(F.lit("Text: "), "input")}
    rows = table.join(spark.createDataFrame([("short {input}",), ("a longer text " * 20,)], "input string")).withColumn("p", prompts.build_prompt(values, F.col("input"))).collect()
    assert {r.condition for r in rows} == set(prompts.CONDITIONS) and len(rows) == 22
    for r in rows:
        said = [prompts.BLOCKS.get(b, f"<{b}>") if b != "input" else "Text: " + r.input for b in prompts.CONDITIONS[r.condition]]
        if r.condition != "A5":
            assert r.p == "\n".join(said)
        else:
            p6 = next(x.p for x in rows if x.condition == "P6" and x.input == r.input)
            start = "\n".join(["<task>", prompts.BLOCKS["format"], prompts.BLOCKS["grounding"], prompts.RULES[0]])
            padded = r.p.removesuffix(f"\n<schema>\nText: {r.input}")
            assert r.p.startswith(start) and len(p6) - len(r.input) <= len(padded) < len(p6) - len(r.input) + 30
    empty = table.where("condition = 'P4'").withColumn("p", prompts.build_prompt(values | {"input": F.lit("i"), "demo": F.lit(None).cast("string")}, F.lit("i"))).first()
    assert empty.p == "\n".join(["<task>", prompts.BLOCKS["format"], prompts.BLOCKS["grounding"], "", "<schema>", "i"])
    with pytest.raises(Exception, match="unknown condition"):
        spark.sql("select 'X' as condition").join(table.drop("condition").limit(1)).withColumn("parts", F.when(F.col("condition") != "X", F.col("parts"))).select(prompts.build_prompt(values | {"input": F.lit("i")}, F.lit("i"))).collect()
    with pytest.raises(Exception, match="unknown block: input"):
        table.select(prompts.build_prompt({k: v for k, v in values.items() if k != "input"}, F.lit("i"))).collect()
    files = spark.createDataFrame([("/a/documents/7.tokens",), ("/a/documents/7.text",), ("/b/annotations/7.text",)], "path string")
    assert [r.path for r in corpus.unique_documents(files, F.lit("7")).collect()] == ["/a/documents/7.text"]


def test_readers_drop_and_refuse_lines(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"id": "a", "v": 1}\n[{"id": "x"}]\n{"id": "b", "v": "one"}\n\n{"id"\n')
    schema = spark.createDataFrame([], "id string, v int").schema
    got = sorted((r.id, r.v) for r in readers.tolerant_jsonl(spark, str(tmp_path / "t.jsonl"), schema).collect())
    assert got == [("a", 1), ("b", None)]
    with pytest.raises(Exception, match="t.jsonl:2"):
        readers.strict_jsonl(spark, str(tmp_path / "t.jsonl"), schema).collect()
    assert readers.first_record(spark, str(tmp_path / "t.jsonl"), schema).first().id == "a"
    assert readers.csv_strings(spark, str(tmp_path / "none.csv"), ["a"]).columns == ["a"]
    at = str(tmp_path / "summary.json")
    assert writers.update_summary(spark, at, {"a": [1], "b": 1}, ["a"]) == {"a": [1], "b": 1}
    assert writers.update_summary(spark, at, {"a": [2]}, ["a"]) == {"a": [1, 2], "b": 1} == json.loads(Path(at).read_text())
    (tmp_path / ".summary.json.crc").unlink(missing_ok=True)
    Path(at).write_text("{broken")
    assert writers.update_summary(spark, at, {"c": 1}) == {"c": 1}
    (tmp_path / "x" / "good").mkdir(parents=True)
    for n in ("train", "dev", "test"):
        (tmp_path / "x" / "good" / f"{n}.json").write_text("{}")
    assert readers.scored_directory(spark, str(tmp_path / "x"), favoured=["good"]).first().dir.endswith("/x/good")


def test_logs_and_failures(spark):
    fails = spark.sql("select 'a' as id, timestamp'2024-01-01 00:00:00' as ts union all select 'a', timestamp'2024-01-01 00:01:00'")
    r = log.retries(fails, "id", most=1).first()
    assert (r.attempts, r.terminal, str(r.retry_at)) == (2, True, "2024-01-01 00:02:00")

    def run(part):
        if 3 in part:
            raise RuntimeError("three")
        return [x * 2 for x in part]

    assert log.split_on_failure([1, 2, 3, 4], run, lambda x, e: f"{x}: {e}") == [2, 4, "3: three", 8]
    items = spark.createDataFrame([(1, "a", 5, 0), (2, "bad", 5, 0), (3, "c", 5, 1)], "id long, prompt string, max_new_tokens int, batch int")

    def infer(prompts_):
        if "bad" in prompts_:
            raise ValueError("no")
        return [p.upper() for p in prompts_]

    assert sorted(map(tuple, log.inferred(items, infer).collect())) == [(1, "A", None), (2, None, "ValueError: no"), (3, "C", None)]
    with pytest.raises(ValueError, match="repeated keys"):
        compaction.expect(items.union(items), ["id"])
    with pytest.raises(ValueError, match="expected 4"):
        compaction.expect(items, ["id"], 4)
    done = drift.coverage(items, items, 3, 4).first()
    assert (done.pairs, done.complete) == (3, False) and drift.column_of(items, ["x", "prompt"]) == "prompt"


def test_equal_means_share_the_frontier(spark, monkeypatch):
    from tarn.plans import figures

    each = [("P1", [0.1, 0.2, 0.3]), ("P2", [0.3, 0.2, 0.1]), ("P3", [0.4, 0.4])]
    assert (0.1 + 0.2) + 0.3 != (0.3 + 0.2) + 0.1
    rows = spark.createDataFrame([("main", "m", c, x, 1, 0.5) for c, v in each for x in v], "phase string, model_id string, condition string, seconds double, schema_valid int, entity_partial_f1 double").coalesce(1)
    monkeypatch.setattr(figures, "with_aliases", lambda spark, d: rows)
    assert {r.condition: r.on_frontier for r in figures.speed_against_validity(spark, "").collect()} == {"P1": 1, "P2": 1, "P3": 0}


def test_partial_matches_of_many_rows_are_those_of_the_pairs(spark):
    """As a walk over all pairs makes them; a key of 6000 alike rows on either side has 18 million."""
    from tarn.operators import scoring

    r = random.Random(4)
    texts = ["a b", "b a", "a b c", "c d", "A", "", "d", "a c", "b c d"]
    rows = [(k, i, r.choice("xy"), r.choice(texts)) for k in (1, 2, 3) for i in range(k * 14)] + [(4, 3, "x", None), (4, 2, "x", "a"), (4, 2, "y", "c d"), (4, 1, "x", "a")]
    s = "k int, pos int, type string, text string"
    sides = [[x for x in rows if x[1] % 2 == side or x[0] == 4] for side in (0, 1)]
    for threshold in (0.5, 0.3):
        want = {}
        for k in (1, 2, 3, 4):
            p, g = ([(pos, t, set(x.lower().split())) for kk, pos, t, x in side if kk == k and x is not None] for side in sides)
            score = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
            pairs = sorted(((score(a[2], b[2]), a[0], b[0]) for a in p for b in g if a[1] == b[1]), reverse=True)
            up, ug = set(), set()
            for x, a, b in pairs:
                if x >= threshold and a not in up and b not in ug:
                    up.add(a)
                    ug.add(b)
            want[k] = len(up)
        assert {x.k: x.tp for x in scoring.partial_f1(*[spark.createDataFrame(side, s) for side in sides], "k", threshold).collect()} == want
    many = spark.range(12_000).selectExpr("1 as k", "id as pos", "'x' as type", "if(id % 3 = 0, 'a b', 'b a') as text")
    got = scoring.partial_f1(many.where("pos % 2 = 0"), many.where("pos % 2 = 1"), "k").first()
    assert (got.tp, got.predicted, got.gold) == (6000, 6000, 6000)
