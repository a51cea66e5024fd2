"""Every registered query with a SQL twin, on the smallest tables, compared value by value."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import ROOT
from tools.compare import TABLES, rows

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{ROOT}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, ROOT)
    got = [tuple(r) for r in df.collect()]
    rel = con.execute(ORACLES[name])
    cols = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, got) == rows(cols, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_twin(spark, name):
    assert QUERIES[name](spark, ROOT).count() > 0
