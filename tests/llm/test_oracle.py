"""SQL oracles of the numbered operators on the small tables."""

from __future__ import annotations

import duckdb
import pytest

from tests.test_oracle import compare
from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(name, spark, tables):
    compare(duckdb.connect(), spark, tables, queries.QUERIES[name], queries.SQL[name])
