"""Every registered query of the operators against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as registered
from conftest import TINY
from pairloom.llm.oracle import ORACLES
from pairloom.llm.queries import QUERIES

TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{TINY}/{name}.parquet'")
    return connection


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(registered.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    df = QUERIES[name](spark, TINY)
    rows = [tuple(r) for r in df.collect()]
    assert rows and all(not isinstance(v, (list, dict)) for v in rows[0])
    if name in ORACLES:
        cursor = database.execute(ORACLES[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        ours = sorted((tuple(r[df.columns.index(c)] for c in sorted(columns)) for r in rows), key=repr)
        assert ours == sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in cursor.fetchall()), key=repr)
