"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as registered
from conftest import TINY
from pairloom.workload import oracle, queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)
QUERIES, ORACLES = queries.QUERIES, oracle.ORACLES


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{TINY}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    """The library's own queries; those of the training-data operators are tested beside them."""
    assert set(queries.QUERIES) == set(oracle.ORACLES)
    assert set(queries.QUERIES) <= set(registered.queries()) and set(registered.oracle_sql()) <= set(registered.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    df = QUERIES[name](spark, TINY)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    assert all(not isinstance(v, (list, dict)) for v in rows[0])
    assert not any(isinstance(v, float) and v != v for r in rows for v in r)
    if name in ORACLES:
        cursor = database.execute(ORACLES[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        at = [df.columns.index(c) for c in sorted(columns)]
        there = [columns.index(c) for c in sorted(columns)]
        ours = sorted((tuple(r[i] for i in at) for r in rows), key=repr)
        theirs = sorted((tuple(r[i] for i in there) for r in cursor.fetchall()), key=repr)
        assert ours == theirs


def test_entry(spark):
    df = registered.entry(spark)
    assert df.columns == ["org", "loc"] and df.count() >= 5
