"""Registered evaluation queries over the synthetic ``scores`` table (2.6, 2.15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import grids as G
from ..sources.fixtures import SCORE_MODELS, scores_frame
from .registry import finish, register


def _scores(spark, sf):
    return scores_frame(spark, sf)


@register("scan_parquet")
def q_scan_parquet(spark, sf):
    """The synthetic score table itself: parquet scans, joins, folds."""
    return finish(_scores(spark, sf))


@register("confusion_matrix")
def q_confusion_matrix(spark, sf):
    return finish(E.confusion_matrix(_scores(spark, sf)))


def _rate(name):
    def q(spark, sf):
        return finish(E.rates(E.confusion_matrix(_scores(spark, sf))).select("model", "fold", name))
    q.__doc__ = f"{name} per fold and pooled"
    return q


for _key, _col in (("sensitivity", "sensitivity"), ("specificity", "specificity"), ("ppv", "vpp"),
                   ("npv", "vpn"), ("accuracy", "accuracy"), ("f1", "f1_score")):
    register(_key)(_rate(_col))


@register("auc_exact")
def q_auc_exact(spark, sf):
    return finish(E.auc_exact(_scores(spark, sf)))


@register("roc_curve")
def q_roc_curve(spark, sf):
    return finish(E.roc_curve(_scores(spark, sf)))


@register("usable_scores")
def q_usable_scores(spark, sf):
    return finish(E.usable_scores(_scores(spark, sf)))


@register("minmax_scores")
def q_minmax_scores(spark, sf):
    return finish(E.minmax_scores(_scores(spark, sf).where(F.col("model") != "none")))


@register("fold_std")
def q_fold_std(spark, sf):
    return finish(E.fold_std(_scores(spark, sf)))


@register("metrics_table")
def q_metrics_table(spark, sf):
    return finish(E.metrics_table(_scores(spark, sf)))


@register("best_model")
def q_best_model(spark, sf):
    m = E.order_by_request(E.metrics_table(_scores(spark, sf)), SCORE_MODELS)
    return finish(E.best_model(m, F.col("request_pos")))


@register("filter_metrics_present")
def q_filter_metrics_present(spark, sf):
    return finish(E.filter_metrics_present(E.metrics_table(_scores(spark, sf))).select("model", "auc"))


@register("format_metric")
def q_format_metric(spark, sf):
    return finish(E.formatted_metrics(E.metrics_table(_scores(spark, sf))))


@register("comparison_lines")
def q_comparison_lines(spark, sf):
    return finish(E.comparison_lines(E.metrics_table(_scores(spark, sf))))


@register("export_metrics_csv")
def q_export_metrics_csv(spark, sf):
    return finish(E.metrics_csv_rows(E.metrics_table(_scores(spark, sf))))


@register("order_results")
def q_order_results(spark, sf):
    """Results of a request in its order, the clustering last."""
    asked = [G.KMEANS, *SCORE_MODELS]
    return finish(E.order_results(E.metrics_table(_scores(spark, sf)), asked, [n for n in asked if n in G.CLUSTERING_MODELS]))


@register("results_document")
def q_results_document(spark, sf):
    """The results as JSON parts: metrics, confusion matrix and hyperparameters, ROC points, members of (fixed) clusters."""
    from .search_queries import fixed_assignment

    s = _scores(spark, sf)
    clusters = fixed_assignment(spark, sf).withColumn("model", F.lit(G.KMEANS))
    return E.results_document(E.metrics_table(s), E.roc_curve(s), F.lit(G.format_hyperparameters({"source": "score table"})), clusters)
