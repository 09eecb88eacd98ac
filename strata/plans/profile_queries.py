"""Registered profile queries over the ``ord`` cohort (2.5 of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators.topk import top_k_per_group
from ..sources.fixtures import ord_cohort
from .registry import finish, register


@register("table_shape")
def q_table_shape(spark, sf):
    return finish(P.table_shape(ord_cohort(spark, sf)))


@register("missing_pct")
def q_missing_pct(spark, sf):
    return finish(P.missing_pct(ord_cohort(spark, sf)))


@register("missing_info")
def q_missing_info(spark, sf):
    return finish(P.missing_info(ord_cohort(spark, sf)))


@register("distinct_count")
def q_distinct_count(spark, sf):
    return finish(P.distinct_count(ord_cohort(spark, sf)))


@register("example_values")
def q_example_values(spark, sf):
    return finish(P.example_values(ord_cohort(spark, sf)))


@register("variable_type")
def q_variable_type(spark, sf):
    return finish(P.variable_types(ord_cohort(spark, sf)))


@register("variable_info")
def q_variable_info(spark, sf):
    return finish(P.variable_info(ord_cohort(spark, sf)))


@register("target_distribution")
def q_target_distribution(spark, sf):
    return finish(P.target_distribution(ord_cohort(spark, sf)))


@register("class_distribution")
def q_class_distribution(spark, sf):
    return finish(P.class_distribution(ord_cohort(spark, sf)))


@register("positive_pct")
def q_positive_pct(spark, sf):
    return finish(P.positive_pct(ord_cohort(spark, sf)))


@register("issue_count")
def q_issue_count(spark, sf):
    return finish(P.issue_count(ord_cohort(spark, sf)))


@register("quartiles")
def q_quartiles(spark, sf):
    return finish(P.quartiles(ord_cohort(spark, sf)))


@register("iqr_fences")
def q_iqr_fences(spark, sf):
    return finish(P.iqr_fences(ord_cohort(spark, sf)))


@register("outlier_info")
def q_outlier_info(spark, sf):
    return finish(P.outlier_info(ord_cohort(spark, sf)))


@register("outlier_ids")
def q_outlier_ids(spark, sf):
    return finish(P.outlier_ids(ord_cohort(spark, sf)))


@register("filter_outliers")
def q_filter_outliers(spark, sf):
    """IDs of rows strictly outside the fences of at least one feature."""
    c = ord_cohort(spark, sf)
    return finish(P.outlier_ids(c).select("id").distinct())


@register("box_plot")
def q_box_plot(spark, sf):
    return finish(P.box_plot(ord_cohort(spark, sf)))


@register("histogram")
def q_histogram(spark, sf):
    return finish(P.histogram(ord_cohort(spark, sf)))


@register("histogram_labels")
def q_histogram_labels(spark, sf):
    return finish(P.histogram_labels(P.histogram(ord_cohort(spark, sf))))


@register("correlation_matrix")
def q_correlation_matrix(spark, sf):
    return finish(P.correlation_matrix(ord_cohort(spark, sf)))


@register("correlated_pairs")
def q_correlated_pairs(spark, sf):
    return finish(P.correlated_pairs(ord_cohort(spark, sf)))


@register("chart_subset")
def q_chart_subset(spark, sf):
    """First four box plots in feature order with the first five outlier IDs of each, and the first four histograms."""
    c = ord_cohort(spark, sf)
    ranked_box = top_k_per_group(P.box_plot(c), [], [F.col("ordinal")], 4, "chart_pos")
    ids = top_k_per_group(P.outlier_ids(c), ["ordinal", "variable"], [F.col("id")], 5, "id_pos")
    boxes = (ranked_box.select("ordinal", "variable", "chart_pos")
             .join(ids.select("ordinal", "id", "id_pos"), "ordinal", "left").withColumn("chart", F.lit("box")))
    hist = P.histogram(c)
    first = top_k_per_group(hist.select("ordinal").distinct(), [], [F.col("ordinal")], 4, "chart_pos")
    bars = hist.join(first, "ordinal").select("ordinal", "variable", "chart_pos", "bin", "bin_lo", "bin_hi", "count",
                                              F.lit("histogram").alias("chart"))
    return finish(boxes.unionByName(bars, allowMissingColumns=True))
