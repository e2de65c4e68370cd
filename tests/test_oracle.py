"""Every query with SQL gives the rows that DuckDB gives, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from trekspark.fixtures import TABLES
from trekspark.plans.catalog import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def _value(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    cols = sorted(df.columns)
    cur = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(_value(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(_value(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == want


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0
