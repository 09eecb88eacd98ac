"""The queries that SQL can express, against DuckDB."""

from __future__ import annotations

import pytest

from strata.llm.queries import QUERIES
from strata.llm.sql import ORACLE
from strata.plans.compare import compare, duckdb_connection


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_equals_its_sql(spark, sf, key):
    same, told = compare(QUERIES[key](spark, sf).toPandas(), duckdb_connection(sf).sql(ORACLE[key]).df())
    assert same, told
