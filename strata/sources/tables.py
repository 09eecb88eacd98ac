"""Parquet scans of the given tables.

``spark.read.parquet`` gives predicate pushdown and column pruning for free;
callers select only the columns they need and Catalyst narrows the
``ReadSchema`` accordingly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def scan_parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def reject_format(path: str) -> str:
    """File kind by suffix; anything but csv/xlsx/parquet is an error."""
    lowered = path.lower().rstrip("/")
    for suffix in (".csv", ".xlsx", ".parquet"):
        if lowered.endswith(suffix):
            return suffix[1:]
    raise ValueError("Only .xlsx, .csv or .parquet files are supported.")
