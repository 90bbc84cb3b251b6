"""Every catalogue query that has SQL gives the same rows in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

from tidemark.catalogue import QUERIES, SQL


def normal(value) -> str:
    if value is None or value != value:
        return "null"
    return str(value)


def compare(connection, spark, folder, query, sql) -> None:
    for name in os.listdir(folder):
        connection.sql(f"create or replace view {name.removesuffix('.parquet')} as select * from '{folder}/{name}'")
    got, want = query(spark, folder), connection.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    at = [want.columns.index(c) for c in order]
    mine = sorted(tuple(normal(r[c]) for c in order) for r in got.collect())
    theirs = sorted(tuple(normal(r[i]) for i in at) for r in want.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, spark, tables):
    compare(duckdb.connect(), spark, tables, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(name, spark, tables):
    assert QUERIES[name](spark, tables).count() > 0
