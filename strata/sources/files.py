"""Delimited-text input and output.

``read_csv`` reads every column as text (no sampling pass), turns the pandas
default missing-value tokens into NULL and then infers each column's type in
one aggregation pass: BIGINT when every present value is an integer that fits,
DECIMAL(38, 0) for longer integers, text for integers of more than 38 digits,
DOUBLE when every present value is a number, text otherwise.

Fixed values: the missing-value tokens
    '', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan',
    '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a',
    'nan', 'null'
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import NUMERIC_TEXT, qcol
from .tables import reject_format

NA_TOKENS = ('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan',
             '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a',
             'nan', 'null')
INTEGER_TEXT = r"^[+-]?\d+$"


def _na(c):
    return F.when(c.isNull() | F.trim(c).isin(list(NA_TOKENS)), F.lit(None)).otherwise(c)


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header row, all columns as text, missing tokens as NULL."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE").csv(path)
    return raw.select(*[_na(qcol(c)).alias(c) for c in raw.columns])


def infer_types(df: DataFrame) -> DataFrame:
    """Cast text columns to BIGINT / DOUBLE when every present value fits (one aggregation pass)."""
    aggs = []
    for i, c in enumerate(df.columns):
        t = F.trim(qcol(c))
        aggs.append(F.count_if(qcol(c).isNotNull() & ~t.rlike(INTEGER_TEXT)).alias(f"ni{i}"))
        aggs.append(F.count_if(qcol(c).isNotNull() & ~F.lower(t).rlike(NUMERIC_TEXT)).alias(f"nn{i}"))
        aggs.append(F.count_if(qcol(c).isNotNull() & t.try_cast("bigint").isNull()).alias(f"nb{i}"))
        aggs.append(F.count_if(qcol(c).isNotNull() & t.try_cast("decimal(38,0)").isNull()).alias(f"nd{i}"))
    row = df.agg(*aggs).first()  # one row of per-column counts
    cols = []
    for i, c in enumerate(df.columns):
        t = F.trim(qcol(c))
        if row[f"ni{i}"] == 0:
            kind = "bigint" if row[f"nb{i}"] == 0 else "decimal(38,0)" if row[f"nd{i}"] == 0 else "string"
            cols.append(t.try_cast(kind).alias(c))
        elif row[f"nn{i}"] == 0:
            cols.append(F.nanvl(t.try_cast("double"), F.lit(None).cast("double")).alias(c))
        else:
            cols.append(qcol(c))
    return df.select(*cols)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    if reject_format(path) != "csv":
        raise ValueError("read_csv expects a .csv path")
    return infer_types(read_text_table(spark, path))


def write_csv(df: DataFrame, path: str) -> str:
    """Header CSV, NULL as an empty field; Spark writes one part file per task."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)
    return path


def write_parquet(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path
