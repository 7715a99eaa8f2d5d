"""The driver's contract, and every query of the catalogue against DuckDB on the smallest tables."""

import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quillgrid.operators import cases, catalog  # noqa: F401  the cases add themselves to the catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 8) + 0.0)
    return str(list(v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    want = con.execute(catalog.SQL[name])
    columns = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(c) for c in columns]
    df = catalog.QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == columns
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(plain(r[k]) for k in order) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["i", "j", "v"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
