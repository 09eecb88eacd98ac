"""Upload validation of a cohort table.

All rules are evaluated in one aggregation pass over the table plus one
grouped pass for duplicate IDs; the result is a small report table.
``validate`` raises the first failing rule in the fixed order:
min_columns, id_not_null, id_unique, target_binary, target_not_null,
feature_numeric (per feature, in column order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cohort import Cohort
from ..functions.numeric import NUMERIC_TEXT, as_double, qcol

DUPLICATE_EXAMPLES = 5
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _non_binary(c, dtype):
    """Predicate: a present target value that is not 0 or 1 (text never counts as 0/1)."""
    if isinstance(dtype, T.BooleanType):
        return F.lit(False)
    if isinstance(dtype, NUMERIC):
        v = c.cast("double")
        return v.isNotNull() & ~F.isnan(v) & ~v.isin(0.0, 1.0)
    return c.isNotNull()


def _missing(c, dtype):
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _parses(c, dtype):
    if isinstance(dtype, T.StringType):
        return F.lower(F.trim(c)).rlike(NUMERIC_TEXT)
    return c.isNotNull()


def duplicate_ids(df: DataFrame, id_col: str, k: int = DUPLICATE_EXAMPLES) -> DataFrame:
    """The k smallest IDs that occur more than once (distinct IDs, ascending)."""
    dup = df.groupBy(qcol(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") > 1).where(F.col("id").isNotNull())
    return dup.orderBy("id").limit(k).select("id", F.col("n").cast("bigint").alias("occurrences"))


def validation_report(df: DataFrame, id_col: str | None = None, target_col: str | None = None) -> DataFrame:
    """(pos, check, column, n_bad, passed) for every rule, in rule order."""
    cols = list(df.columns)
    spark = df.sparkSession
    if len(cols) < 3:
        return spark.createDataFrame([(0, "min_columns", None, len(cols), 0)],
                                     "pos int, check string, column string, n_bad bigint, passed int")
    id_col = id_col or cols[0]
    target_col = target_col or cols[-1]
    feats = [c for c in cols if c not in (id_col, target_col)]
    types = {f.name: f.dataType for f in df.schema.fields}
    idc, tc = qcol(id_col), qcol(target_col)
    aggs = [
        F.count_if(_missing(idc, types[id_col])).alias("id_null"),
        F.count_if(_non_binary(tc, types[target_col])).alias("t_bad"),
        F.count_if(_missing(tc, types[target_col])).alias("t_null"),
    ]
    for i, c in enumerate(feats):
        aggs.append(F.count_if(_parses(qcol(c), types[c]) & as_double(qcol(c), types[c]).isNotNull()).alias(f"ok{i}"))
        aggs.append(F.count_if(~_missing(qcol(c), types[c])).alias(f"pr{i}"))
    wide = df.agg(*aggs)
    dup = (df.groupBy(idc.alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_id").isNotNull())
           .agg(F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n") - 1)), F.lit(0)).alias("dup_extra")))
    rows = [
        F.struct(F.lit(0).alias("pos"), F.lit("min_columns").alias("check"), F.lit(None).cast("string").alias("column"),
                 F.lit(0).cast("bigint").alias("n_bad")),
        F.struct(F.lit(1).alias("pos"), F.lit("id_not_null").alias("check"), F.lit(id_col).alias("column"),
                 F.col("id_null").cast("bigint").alias("n_bad")),
        F.struct(F.lit(3).alias("pos"), F.lit("target_binary").alias("check"), F.lit(target_col).alias("column"),
                 F.col("t_bad").cast("bigint").alias("n_bad")),
        F.struct(F.lit(4).alias("pos"), F.lit("target_not_null").alias("check"), F.lit(target_col).alias("column"),
                 F.col("t_null").cast("bigint").alias("n_bad")),
    ]
    for i, c in enumerate(feats):
        bad = F.when((F.col(f"ok{i}") == 0) & (F.col(f"pr{i}") > 0), F.col(f"pr{i}")).otherwise(F.lit(0))
        rows.append(F.struct(F.lit(5 + i).alias("pos"), F.lit("feature_numeric").alias("check"),
                             F.lit(c).alias("column"), bad.cast("bigint").alias("n_bad")))
    main = wide.select(F.inline(F.array(*rows)))
    dup_row = dup.select(F.lit(2).alias("pos"), F.lit("id_unique").alias("check"), F.lit(id_col).alias("column"),
                         F.col("dup_extra").cast("bigint").alias("n_bad"))
    return main.unionByName(dup_row).withColumn("passed", (F.col("n_bad") == 0).cast("int"))


MESSAGES = {
    "min_columns": "Dataset must contain at least three columns (ID, feature(s), target).",
    "id_not_null": "ID column contains missing values. Please ensure all IDs are present.",
    "id_unique": "Duplicate IDs detected: {ids}. IDs must be unique.",
    "target_binary": "Target column must contain only binary values 0 or 1 without NaN.",
    "target_not_null": "Target column contains missing values. Please clean the data before upload.",
    "feature_numeric": "Feature column '{column}' contains non-numeric values.",
}


def validate(df: DataFrame, id_col: str | None = None, target_col: str | None = None) -> Cohort:
    """Raise ``ValueError`` for the first failing rule; else return the coerced cohort."""
    if len(df.columns) < 3:
        raise ValueError(MESSAGES["min_columns"])
    report = validation_report(df, id_col, target_col)
    failed = report.where(F.col("passed") == 0).orderBy("pos").limit(1).collect()
    cohort = Cohort.from_frame(df, id_col, target_col)
    if failed:
        row = failed[0]
        ids = []
        if row["check"] == "id_unique":
            ids = [r["id"] for r in duplicate_ids(df, cohort.id_col).collect()]
        raise ValueError(MESSAGES[row["check"]].format(ids=ids, column=row["column"]))
    return coerce_cohort(cohort)


def coerce_numeric(df: DataFrame, feature_cols, target_col: str | None = None) -> DataFrame:
    """Text features to DOUBLE (unparseable cells become NULL), target to INT.

    Numeric features keep their type (integral columns stay integral, which
    the profile's type rules use); NaN becomes NULL.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in df.columns:
        if c in feature_cols:
            t = types[c]
            if isinstance(t, (T.FloatType, T.DoubleType)):
                out.append(as_double(qcol(c), t).alias(c))
            elif isinstance(t, NUMERIC):
                out.append(qcol(c))
            else:
                out.append(as_double(qcol(c), t).alias(c))
        elif c == target_col:
            out.append(qcol(c).cast("double").cast("int").alias(c))
        else:
            out.append(qcol(c))
    return df.select(*out)


def coerce_cohort(cohort: Cohort) -> Cohort:
    return cohort.with_df(coerce_numeric(cohort.df, cohort.feature_cols, cohort.target_col))
