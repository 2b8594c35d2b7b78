import re

from pyspark.sql import functions as F

from tarn.llm.exact_dedup import exact_groups, op10

S = "doc_id long, text string, digest string, chars int"


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    out = []
    for d, t in rows:
        same = [(x, y or "") for x, y in rows if norm(y) == norm(t)]
        best = min(same, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        out.append((d, best[0], len(same), d == best[0] and len(t or "") == len(best[1])))
    return sorted(out, key=str)


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b\n"), (4, None), (5, ""), (6, " \t"), (7, "é "), (8, "é"), (9, "x" * 50000), (10, "x" * 50000), (11, "solo"), (None, "ab"), (None, "lost"), (12, "dup"), (12, "dup"), (13, "😀 "), (14, "😀")]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(*r, "d", 1) for r in ROWS], S).repartition(4)
    got = op10(df)
    assert sorted(map(tuple, got.drop("text_sha256").collect()), key=str) == brute(ROWS)
    assert got.where(F.col("text_sha256").rlike("^[0-9a-f]{64}$")).count() == len(ROWS)


def test_content_decides_where_digests_collide(spark):
    df = spark.createDataFrame([(*r, "d", 1) for r in ROWS], S).repartition(4)
    weak = exact_groups(df, digest=lambda c: F.substring(c, 1, 1).cast("binary"), broadcast_limit=0)
    assert sorted(map(tuple, weak.drop("digest").collect()), key=str) == brute(ROWS)


def test_large_groups_stay_where_they_are(spark):
    df = spark.createDataFrame([(*r, "d", 1) for r in ROWS], S).repartition(4)
    got = exact_groups(df, large=2)
    assert sorted(map(tuple, got.drop("digest").collect()), key=str) == brute(ROWS)


def test_empty_table(spark):
    assert op10(spark.createDataFrame([], S)).count() == 0
