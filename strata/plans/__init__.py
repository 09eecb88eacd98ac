"""Registered queries (``queries()``) and their DuckDB oracle texts (``oracle_sql()``)."""

from __future__ import annotations

from . import clean_queries, eval_queries, model_queries, prep_queries, profile_queries, search_queries  # noqa: F401,E501
from .oracle import ORACLE
from .registry import QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in ORACLE.items() if k in QUERIES}
