"""Every query of the library against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from quarrymill import registry
from quarrymill.plans.bindings import BASE

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows_of(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr(tuple(plain(r[i]) for i in order)) for r in records))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    expected = duck.sql(ORACLES[name])
    assert sorted(frame.columns) == sorted(expected.columns)
    assert rows_of([tuple(r) for r in frame.collect()], frame.columns) == rows_of(expected.fetchall(), expected.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs_alike(spark, name):
    """Without SQL: a stable, filled result of the documents' rows; what it computes is held against plain Python in other tests."""
    frame = QUERIES[name](spark, DATA)
    rows = rows_of([tuple(r) for r in frame.collect()], frame.columns)
    assert rows
    again = QUERIES[name](spark, DATA)
    assert rows_of([tuple(r) for r in again.collect()], again.columns) == rows
    if "doc_id" in frame.columns:
        known = {r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}
        assert {r.doc_id for r in frame.select("doc_id").collect()} <= known
