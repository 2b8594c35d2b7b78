"""Every query with SQL gives DuckDB's rows."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from tarn.plans import corpora, experiment, figures, shapes  # noqa: E402, F401
from tarn.plans.catalog import ORACLE_SQL, QUERIES  # noqa: E402

DIR = "/root/testdata/sf0.01"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}")
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    names = sorted(got.columns)
    rows = [tuple(plain(r[n]) for n in names) for r in got.collect()]
    assert rows
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name])
        cols = [d[0] for d in want.description]
        assert sorted(cols) == names
        at = [cols.index(n) for n in names]
        expected = [tuple(plain(r[i]) for i in at) for r in want.fetchall()]
        # value by value, as the driver's hash has them
        assert sorted(rows, key=str) == sorted(expected, key=str)
