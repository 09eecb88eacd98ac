"""Cleaning suggestions and their application.

Suggestions come from the profile: one per feature with missing cells, one
per feature with outliers, one per strongly correlated pair.  Applying a
selection always starts from the raw cohort: a row goes if one of its cells is
missing or outside the fences of a selected suggestion (rows without an ID
stay), which is one filter without a shuffle; the selected correlation
suggestions drop their later column.

Fixed texts and formats:
    id:          missing-<col>, outlier-<col>, corr-<a>-<b>
    missing:     Remove rows with missing values in '<col>' (<pct, 2 decimals>% missing).
    outlier:     Remove <count> outlier(s) in '<col>' (IQR-based detection).
    correlation: Remove '<b>' due to high correlation with '<a>' (|r|=<abs r, 2 decimals>).
    reasons:     Missing values can bias model training and need explicit handling.
                 Extreme values may distort model coefficients and should be reviewed.
                 Highly correlated variables can introduce multicollinearity.
    notes:       Removed <n> rows based on selected cleaning suggestions.
                 Removed highly correlated columns based on selected suggestions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cohort import Cohort
from ..functions.numeric import qcol
from . import profile as P
from .evaluation import fmt

REASON_MISSING = "Missing values can bias model training and need explicit handling."
REASON_OUTLIER = "Extreme values may distort model coefficients and should be reviewed."
REASON_CORRELATION = "Highly correlated variables can introduce multicollinearity."
NOTE_ROWS = "Removed {n} rows based on selected cleaning suggestions."
NOTE_COLUMNS = "Removed highly correlated columns based on selected suggestions."

SUGGESTION_COLUMNS = ("pos", "suggestion_id", "type", "description", "variable", "var_a", "var_b", "value",
                      "drop_column", "reason")


def suggest_missing(cohort: Cohort, stats: DataFrame | None = None) -> DataFrame:
    mi = P.missing_info(cohort, stats)
    return mi.select(
        F.col("ordinal").alias("pos"),
        F.concat(F.lit("missing-"), F.col("variable")).alias("suggestion_id"),
        F.lit("missing").alias("type"),
        F.concat(F.lit("Remove rows with missing values in '"), F.col("variable"), F.lit("' ("),
                 fmt(F.col("percentage"), 2), F.lit("% missing).")).alias("description"),
        "variable", F.lit(None).cast("string").alias("var_a"), F.lit(None).cast("string").alias("var_b"),
        F.col("percentage").alias("value"), F.lit(None).cast("string").alias("drop_column"),
        F.lit(REASON_MISSING).alias("reason"))


def suggest_outliers(cohort: Cohort, info: DataFrame | None = None) -> DataFrame:
    oi = info if info is not None else P.outlier_info(cohort)
    return oi.select(
        (F.col("ordinal") + 10_000).alias("pos"),
        F.concat(F.lit("outlier-"), F.col("variable")).alias("suggestion_id"),
        F.lit("outlier").alias("type"),
        F.concat(F.lit("Remove "), F.col("count").cast("string"), F.lit(" outlier(s) in '"), F.col("variable"),
                 F.lit("' (IQR-based detection).")).alias("description"),
        "variable", F.lit(None).cast("string").alias("var_a"), F.lit(None).cast("string").alias("var_b"),
        F.col("count").cast("double").alias("value"), F.lit(None).cast("string").alias("drop_column"),
        F.lit(REASON_OUTLIER).alias("reason"))


def suggest_correlation(cohort: Cohort, pairs: DataFrame | None = None) -> DataFrame:
    cp = pairs if pairs is not None else P.correlated_pairs(cohort)
    return cp.select(
        (F.col("i") * 100_000 + F.col("j") + 20_000).alias("pos"),
        F.concat(F.lit("corr-"), F.col("var_a"), F.lit("-"), F.col("var_b")).alias("suggestion_id"),
        F.lit("correlation").alias("type"),
        F.concat(F.lit("Remove '"), F.col("var_b"), F.lit("' due to high correlation with '"), F.col("var_a"),
                 F.lit("' (|r|="), fmt(F.abs(F.col("r")), 2), F.lit(").")).alias("description"),
        F.lit(None).cast("string").alias("variable"), "var_a", "var_b", F.col("r").alias("value"),
        F.col("drop_column"), F.lit(REASON_CORRELATION).alias("reason"))


def suggestions(cohort: Cohort) -> DataFrame:
    """Missing, then outlier, then correlation suggestions; ``pos`` keeps that order."""
    return (suggest_missing(cohort).unionByName(suggest_outliers(cohort))
            .unionByName(suggest_correlation(cohort))
            .withColumn("pos", F.col("pos").cast("bigint")))


def select_suggestions(sugg: DataFrame, keep: Sequence[str] | None = None, skip: Sequence[str] = ()) -> DataFrame:
    """All suggestions are pre-selected; ``keep`` restricts, ``skip`` unticks. Unknown IDs are ignored."""
    out = sugg
    if keep is not None:
        out = out.where(F.col("suggestion_id").isin(list(keep)))
    if skip:
        out = out.where(~F.col("suggestion_id").isin(list(skip)))
    return out


def filter_missing(cohort: Cohort, variables: DataFrame) -> DataFrame:
    """(variable, id) of rows where a named variable is missing (one pass via the long form)."""
    lv = P.long_values(cohort)
    v = variables.select(F.col("variable").alias("_v")).distinct()
    # the variable list is bounded by the column count
    return (lv.where(F.col("value").isNull()).join(F.broadcast(v), F.col("variable") == F.col("_v"))
            .select("variable", "id"))


def removal_condition(cohort: Cohort, selected: DataFrame) -> Column:
    """True for the rows that the selected missing and outlier suggestions remove.

    Read off the row itself: the selection and the fences (at most one row per
    column each) are collected, so no row data is shuffled.
    """
    kinds = ("missing", "outlier")
    chosen = {(r["type"], r["variable"]) for r in
              selected.where(F.col("type").isin(*kinds)).select("type", "variable").distinct().collect()}
    condition = F.lit(False)
    for name in sorted(v for t, v in chosen if t == "missing"):
        condition = condition | P.cell(cohort, name).isNull()
    if any(t == "outlier" for t, _ in chosen):
        for r in P.iqr_fences(cohort).collect():
            if ("outlier", r["variable"]) in chosen:
                x = P.cell(cohort, r["variable"])
                condition = condition | F.coalesce(
                    (x < F.lit(r["lower_bound"])) | (x > F.lit(r["upper_bound"])), F.lit(False))
    return condition & qcol(cohort.id_col).isNotNull()


def removed_ids(cohort: Cohort, selected: DataFrame) -> DataFrame:
    """IDs removed by the selected missing and outlier suggestions (NULL dropped; IDs are unique)."""
    return cohort.df.where(removal_condition(cohort, selected)).select(qcol(cohort.id_col).alias("id"))


def removed_columns(selected: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct drop columns of the selected correlation suggestions that exist in the table."""
    return (selected.where(F.col("type") == "correlation")
            .select(F.coalesce(F.col("drop_column"), F.col("var_b")).alias("column"))
            .where(F.col("column").isin(list(columns))).distinct())


def anti_join_removed(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Rows whose ID is not in ``ids``."""
    return df.join(ids.select(F.col("id").alias("_rid")), qcol(id_col) == F.col("_rid"), "left_anti")


def apply_cleaning(raw: Cohort, selected: DataFrame) -> tuple[Cohort, DataFrame, list[str]]:
    """(cleaned cohort, removed IDs, dropped columns).  Always starts from ``raw``."""
    remove = removal_condition(raw, selected)
    drop = [r["column"] for r in removed_columns(selected, raw.df.columns).collect()]  # at most the column count
    ids = raw.df.where(remove).select(qcol(raw.id_col).alias("id"))
    df = raw.df.where(~remove)
    if drop:
        df = df.drop(*drop)
    feats = [c for c in df.columns if c not in (raw.id_col, raw.target_col)]
    return raw.with_df(df, feats), ids, sorted(drop)


def cleaning_summary(raw: Cohort, cleaned: Cohort, ids: DataFrame, dropped: Sequence[str]) -> DataFrame:
    """rows_removed, cols_removed, final_rows, final_cols, notes."""
    tagged = (raw.df.select(F.lit(1).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"))
              .unionByName(cleaned.df.select(F.lit(0).alias("a"), F.lit(1).alias("b"), F.lit(0).alias("c")))
              .unionByName(ids.select(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(1).alias("c"))))
    counts = tagged.agg(F.sum("a").alias("n_raw"), F.sum("b").alias("n_clean"), F.sum("c").alias("n_ids"))
    note = (F.when(F.col("n_ids") > 0, F.format_string(NOTE_ROWS.replace("{n}", "%d"), F.col("n_ids")))
            .when(F.lit(len(dropped) > 0), F.lit(NOTE_COLUMNS)))
    return counts.select(
        (F.col("n_raw") - F.col("n_clean")).cast("bigint").alias("rows_removed"),
        F.lit(len(dropped)).cast("bigint").alias("cols_removed"),
        F.col("n_clean").cast("bigint").alias("final_rows"),
        F.lit(len(cleaned.feature_cols)).cast("bigint").alias("final_cols"),
        note.alias("notes"))
