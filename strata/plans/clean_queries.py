"""Registered validation, cleaning and set-operation queries (2.1-2.4, 2.9, 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cohort import Cohort
from ..operators import cleaning as C
from ..operators import profile as P
from ..operators import validation as V
from ..session import scratch_path
from ..sources import files
from ..sources import fixtures as X
from .registry import finish, register

SELECTION = ("missing-sum_qty", "outlier-avg_disc", "corr-n_lines-sum_qty", "no-such-suggestion")


def _ord(spark, sf):
    return X.ord_cohort(spark, sf)


def _cleaned(spark, sf):
    raw = _ord(spark, sf)
    sel = C.select_suggestions(C.suggestions(raw))
    return raw, C.apply_cleaning(raw, sel)


# ------------------------------------------------------------ validation
def _report_row(df, check):
    return V.validation_report(df).where(F.col("check") == check).select("check", "column", "n_bad", "passed")


@register("id_not_null")
def q_id_not_null(spark, sf):
    return finish(_report_row(X.bad_id_null(spark, sf), "id_not_null"))


@register("id_unique")
def q_id_unique(spark, sf):
    """The first five duplicated IDs (distinct, ascending) of ``lineitem`` keyed by order."""
    return finish(V.duplicate_ids(X.bad_dup(spark, sf), "id"))


@register("target_binary")
def q_target_binary(spark, sf):
    return finish(_report_row(X.bad_target(spark, sf), "target_binary"))


@register("target_not_null")
def q_target_not_null(spark, sf):
    return finish(_report_row(X.bad_target_null(spark, sf), "target_not_null"))


@register("feature_numeric")
def q_feature_numeric(spark, sf):
    return finish(_report_row(X.bad_feature(spark, sf), "feature_numeric"))


@register("validation_report")
def q_validation_report(spark, sf):
    return finish(V.validation_report(X.bad_feature(spark, sf)))


@register("coerce_numeric")
def q_coerce_numeric(spark, sf):
    df = X.mixed_feature(spark, sf)
    return finish(V.coerce_numeric(df, ["sum_qty", "mixed"], "target"))


@register("cast_target")
def q_cast_target(spark, sf):
    c = V.coerce_cohort(Cohort.from_frame(X.bad_target_null(spark, sf)))
    return finish(c.df.select("id", "target"))


# ------------------------------------------------------------ sources
@register("read_csv")
def q_read_csv(spark, sf):
    """Round trip of ``ord`` through a header CSV in the shared scratch folder."""
    path = files.write_csv(_ord(spark, sf).df, scratch_path(spark, "ord") + ".csv")
    return finish(files.read_csv(spark, path))


@register("read_workbooks")
def q_read_workbooks(spark, sf):
    """Round trip of ``ord`` through .xlsx workbooks (one per partition) in the shared scratch folder."""
    from ..sources import workbooks

    folder = workbooks.write_workbooks(_ord(spark, sf).df.repartition(4), scratch_path(spark, "ord-xlsx"))
    return finish(workbooks.read_workbooks(spark, folder))


@register("write_cleaned")
def q_write_cleaned(spark, sf):
    """The cleaned cohort written as parquet and read back (long form for the check)."""
    raw, (clean, _, _) = _cleaned(spark, sf)
    back = spark.read.parquet(files.write_parquet(clean.df, scratch_path(spark, "cleaned")))
    return finish(P.long_values(Cohort.from_frame(back)).select("id", "variable", "value"))


@register("preview")
def q_preview(spark, sf):
    return finish(_ord(spark, sf).df.orderBy("id").limit(10))


@register("dataset_summary")
def q_dataset_summary(spark, sf):
    c = _ord(spark, sf)
    t = F.col(c.target_col)
    return finish(c.df.agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        F.lit(len(c.df.columns)).cast("bigint").alias("cols"),
        F.lit(c.id_col).alias("id_column"), F.lit(c.target_col).alias("target_column"),
        F.lit(",".join(c.feature_cols)).alias("feature_columns"),
        F.count_if(t == 0).cast("bigint").alias("class_0"), F.count_if(t == 1).cast("bigint").alias("class_1")))


# ------------------------------------------------------------ cleaning
@register("suggest_missing")
def q_suggest_missing(spark, sf):
    return finish(C.suggest_missing(_ord(spark, sf)))


@register("suggest_outliers")
def q_suggest_outliers(spark, sf):
    return finish(C.suggest_outliers(_ord(spark, sf)))


@register("suggest_correlation")
def q_suggest_correlation(spark, sf):
    return finish(C.suggest_correlation(_ord(spark, sf)))


@register("union_suggestions")
def q_union_suggestions(spark, sf):
    return finish(C.suggestions(_ord(spark, sf)))


@register("select_suggestions")
def q_select_suggestions(spark, sf):
    """All suggestions pre-selected, with the missing-value one of ``n_lines`` unticked."""
    return finish(C.select_suggestions(C.suggestions(_ord(spark, sf)), skip=["missing-n_lines"])
                  .select("suggestion_id", "type"))


@register("filter_in_set")
def q_filter_in_set(spark, sf):
    """Suggestions whose ID is in a selection list; unknown IDs are ignored."""
    return finish(C.select_suggestions(C.suggestions(_ord(spark, sf)), keep=SELECTION).select("suggestion_id", "type"))


@register("filter_missing")
def q_filter_missing(spark, sf):
    c = _ord(spark, sf)
    return finish(C.filter_missing(c, P.missing_info(c).select("variable")))


@register("union_removed_ids")
def q_union_removed_ids(spark, sf):
    c = _ord(spark, sf)
    return finish(C.removed_ids(c, C.suggestions(c)))


@register("removed_columns")
def q_removed_columns(spark, sf):
    c = _ord(spark, sf)
    return finish(C.removed_columns(C.suggestions(c), c.df.columns))


@register("anti_join_removed")
def q_anti_join_removed(spark, sf):
    """IDs of the rows left after removing every suggested row."""
    c = _ord(spark, sf)
    return finish(C.anti_join_removed(c.df, c.id_col, C.removed_ids(c, C.suggestions(c))).select("id"))


@register("drop_columns")
def q_drop_columns(spark, sf):
    """Columns left after dropping the suggested correlated columns, in order."""
    raw, (clean, _, _) = _cleaned(spark, sf)
    return finish(spark.createDataFrame([(i, c) for i, c in enumerate(clean.df.columns)], "pos int, column string"))


@register("select_features")
def q_select_features(spark, sf):
    """The cleaned cohort's current feature columns, long form (id, variable, value)."""
    raw, (clean, _, _) = _cleaned(spark, sf)
    return finish(P.long_values(clean).select("id", "variable", "value"))


@register("apply_cleaning")
def q_apply_cleaning(spark, sf):
    """Cleaned cohort (all suggestions applied) in long form: rows kept x columns kept."""
    raw, (clean, _, _) = _cleaned(spark, sf)
    return finish(P.long_values(clean, include_target=True).select("id", "variable", "value"))


@register("cleaning_summary")
def q_cleaning_summary(spark, sf):
    raw, (clean, ids, dropped) = _cleaned(spark, sf)
    return finish(C.cleaning_summary(raw, clean, ids, dropped))
