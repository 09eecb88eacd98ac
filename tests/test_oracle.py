"""Every registered query with an oracle text equals DuckDB on the sf0.001 tables."""

import pytest

from strata.plans import oracle_sql, queries
from strata.plans.compare import compare, duckdb_connection

ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duckdb_connection(sf)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_duckdb(spark, sf, con, key):
    got = queries()[key](spark, sf).toPandas()
    want = con.sql(ORACLES[key]).df()
    ok, msg = compare(got, want)
    assert ok, f"{key}: {msg}"


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(queries())
