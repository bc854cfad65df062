"""Every query with SQL against DuckDB on the small tables, and plans without products of rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from sessiontide.plans import queries

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return con


def rows(frame):
    return sorted(map(str, frame.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, con, name, capsys):
    frame = queries.QUERIES[name](spark, SMALL)
    frame.explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got, want = frame.toPandas(), con.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    got, want = got[order], want[order]
    assert len(got) == len(want) > 0
    assert {c: got[c].dtype.kind for c in order} == {c: want[c].dtype.kind for c in order}
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
