"""Records of the three shapes against plain versions, with members that don't fit."""

import hashlib
import json

from pyspark.sql import functions as F

from tarn.functions import text
from tarn.operators import corpus, normalise


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def spans_of(tokens):
    at, out = 0, []
    for x in tokens:
        out.append((at, at + len(x)))
        at += len(x) + 1
    return out


def span(tokens, a, b):
    if not all(isinstance(x, int) for x in (a, b)) or a < 0 or b < a or b >= len(tokens):
        return None
    o = spans_of(tokens)
    return {"start_token": a, "end_token": b, "start_char": o[a][0], "end_char": o[b][1], "text": " ".join(tokens[a : b + 1])}


def plain_document(source):
    """The record as a dictionary."""
    sentences = [(i, [str(t) for t in s]) for i, s in enumerate(source.get("sentences") or []) if isinstance(s, list)]
    tokens = [t for _, s in sentences for t in s]
    ranges, at = [], 0
    for i, s in sentences:
        ranges.append({"sentence_index": i, "start_token": at, "end_token": at + len(s) - 1})
        at += len(s)
    flat = lambda x: [y for g in x if isinstance(g, list) for y in g] if isinstance(x, list) else []
    entities, relations, errors, first = [], [], [], {}
    for i, item in enumerate(flat(source.get("ner"))):
        if isinstance(item, list) and len(item) >= 3:
            s = span(tokens, item[0], item[1])
            if s is None:
                errors.append(f"invalid entity token span: {item[0]}-{item[1]}")
            else:
                entities.append({"id": f"E{i:04d}", "type": item[2], **s})
                first.setdefault((item[0], item[1]), f"E{i:04d}")
    for i, item in enumerate(flat(source.get("relations"))):
        if isinstance(item, list) and len(item) >= 5:
            head, tail = span(tokens, *item[:2]), span(tokens, *item[2:4])
            if head is None or tail is None:
                errors.append("invalid relation token span: " + json.dumps(item, separators=(",", ":")))
            else:
                relations.append({"id": f"R{i:04d}", "type": item[4], "head_entity_id": first.get(tuple(item[:2])), "tail_entity_id": first.get(tuple(item[2:4])), "head": head, "tail": tail})
    clusters = [[s for m in c if isinstance(m, list) and len(m) >= 2 and (s := span(tokens, *m[:2]))] for c in source.get("clusters") or [] if isinstance(c, list)]
    joined = " ".join(tokens)
    return {
        "record_id": source.get("doc_key", "fallback"), "tokens": tokens, "sentence_ranges": ranges, "input_text": joined, "entities": entities, "relations": relations, "coreference_clusters": [c for c in clusters if c],
        "token_offsets": [{"start_char": a, "end_char": b} for a, b in spans_of(tokens)], "errors": errors, "text_sha256": sha(joined),
        "statistics": {"characters": len(joined), "tokens": len(tokens), "sentences": len(ranges), "entities": len(entities), "relations": len(relations)},
    }


SOURCES = [
    {"doc_key": "d1", "sentences": [["A", "bc", "def"], [], ["é", "😀", "."]], "ner": [[[0, 1, "Task"], [0, 1, "Method"]], [], [[3, 4, "Task"], [5, 9, "Task"], [1], "x", [4, 3, "T"], [-1, 0, "T"]]], "relations": [[[0, 1, 3, 4, "Used-for"], [2, 2, 0, 1, "Part-of"]], [[0, 9, 1, 1, "R"], [1, 2]]], "clusters": [[[0, 0], [3, 3]], [[9, 9]], "no", [[1], [2, 2, 7]]]},
    {"sentences": ["not a list", ["only"]], "ner": "none", "relations": None},
    {"doc_key": "d3", "sentences": [[str(i) for i in range(300)]], "ner": [[[i, i + 2, f"T{i % 3}"] for i in range(0, 298, 7)]], "clusters": []},
    {"doc_key": "empty"},
]


def test_documents_of_tokens(spark):
    rows = spark.createDataFrame([("test", "fallback", json.dumps(s)) for s in SOURCES] + [("test", "bad", "[1"), ("test", "list", "[]")], "split string, record_id string, raw string")
    got = {r.record_id: r.asDict(recursive=True) for r in normalise.token_documents(rows).collect()}
    for s in SOURCES:
        want = plain_document(s)
        mine = got[want["record_id"]]
        assert {k: mine[k] for k in want} == want
    assert got["bad"]["errors"] == ["not an object"] == got["list"]["errors"] and got["bad"]["tokens"] == []
    side = normalise.errors_of(normalise.token_documents(rows), "split", "record_id")
    assert side.where("record_id = 'd1'").count() == 4
    labels = {(r.split, r.label): r.n for r in corpus.label_counts(normalise.token_documents(rows), ["split"]).collect()}
    assert labels[("test", "entity:Task")] == 2 and labels[("test", "relation:Used-for")] == 1


def test_offsets_of_many_tokens(spark):
    tokens = [("x" * (i % 5)) for i in range(1000)]
    r = spark.createDataFrame([(tokens,), ([],), (["a"],)], "t array<string>").select(text.offsets(F.col("t")).alias("o"), "t").collect()
    assert all([(x.start_char, x.end_char) for x in row.o] == spans_of(row.t) for row in r)


def test_documents_of_labels(spark):
    docs = [("1", ["a", "bb", "c"]), ("2", ["x", "y", ""]), ("3", []), ("4", ["solo"]), ("5", ["p", "q"])]
    notes = [
        ("1", "train", "P", [1, 1, 0]), ("1", "train", "I", [0, 2, 1]), ("1", "train", "O", [0, 0, 0]), ("2", "test", "P", [0, 1]), ("2", "train", "P", [1, 1]), ("2", "test", "I", [1]),
        ("3", "test", "P", []), ("5", "train", "P", [1, 0]), ("5", "dev", "P", [0, 1]),
    ]
    frames = spark.createDataFrame(docs, "record_id string, tokens array<string>"), spark.createDataFrame(notes, "record_id string, split string, element string, labels array<int>")
    got = {r.record_id: r for r in normalise.labelled_documents(*frames, ["P", "I", "O"]).collect()}
    brief = lambda r: [(e.id, e.type, e.start_token, e.end_token, e.start_char, e.end_char, e.text) for e in r.entities]
    assert brief(got["1"]) == [("E0000", "P", 0, 1, 0, 4, "a bb"), ("E0001", "I", 1, 1, 2, 4, "bb"), ("E0002", "I", 2, 2, 5, 6, "c")]
    assert got["1"].annotation_status.complete and got["1"].split == "train" and not got["1"].errors
    assert got["2"].split == "test" and got["2"].tokens == ["x", "y"] and brief(got["2"]) == [("E0000", "P", 1, 1, 2, 3, "y")]
    assert got["2"].errors == ["I label/token mismatch: labels=1, tokens=2"] and got["2"].annotation_status.missing_or_invalid_elements == ["I", "O"]
    assert got["3"].errors == ["empty token file"] and got["3"].input_text is None
    assert got["4"].split == "unspecified" and got["4"].annotation_status.valid_elements == [] and got["5"].split == "train"
    assert got["1"].text_sha256 == sha("a bb c") and got["1"].statistics.asDict() == {"characters": 6, "tokens": 3, "entities": 3}


def test_sentences_and_their_documents(spark):
    raws = [
        {"doc_id": "D", "sentence": " first  one ", "ner": [["first", "Task"], ["x"], ["one", "Method", 3]], "rel_plus": [["first:Task", "Used-for", "a:b:Method"], ["short", "R"]]},
        {"doc_id": "D", "sentence": "second", "rel": [["plain", "Part-of", "of:Dataset"]]},
        {"sentence": "no id", "ner": "none"},
    ]
    rows = spark.createDataFrame([("train", i, json.dumps(r)) for i, r in enumerate(raws)], "split string, row_index int, raw string")
    s = normalise.sentence_records(rows)
    got = {r.row_index: r.asDict(recursive=True) for r in s.collect()}
    assert got[0]["record_id"] == "D::sent_000000" and got[0]["input_text"] == "first one"
    assert got[0]["entities"] == [{"id": "E0000", "type": "Task", "text": "first"}, {"id": "E0002", "type": "Method", "text": "one"}]
    assert got[0]["relations"] == [{"id": "R0000", "type": "Used-for", "head": {"text": "first", "type": "Task"}, "tail": {"text": "a:b", "type": "Method"}}]
    assert got[1]["relations"][0]["head"] == {"text": "plain", "type": None} and got[2]["document_id"] == "document_train_000002" and got[2]["entities"] == []
    d = {r.record_id: r for r in normalise.document_records(s).collect()}
    assert d["D"].input_text == "first one\nsecond" and d["D"].relation_types == ["Part-of", "Used-for"] and d["D"].statistics.entities == 2
    assert [(r.id, r.sentence_index, r.source_record_id) for r in d["D"].relations] == [("R0000", 0, "D::sent_000000"), ("R0000", 1, "D::sent_000001")]
