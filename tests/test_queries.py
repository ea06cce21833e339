"""Every query with SQL is held against DuckDB on the smallest tables; the rest must run."""

import math
import os

import pytest

import __spark_entry__ as entry
from corpusforge import plans

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in plans.QUERIES if n in plans.ORACLE])
def test_query_equals_sql(spark, db, name):
    df = plans.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(cols).collect()), key=repr)
    rel = db.sql(plans.ORACLE[name])
    assert sorted(rel.columns) == cols
    want = sorted((tuple(plain(v) for v in r) for r in db.sql(f"SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({plans.ORACLE[name]})").fetchall()), key=repr)
    assert got == want


def test_every_name_is_registered():
    assert set(plans.ORACLE) <= set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
