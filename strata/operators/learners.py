"""Learners expressed as aggregations and joins.

Inputs are long prepared tables (id, target, d, value) with one row per
feature cell, so a learner's fit is a grouped aggregation whose result has
one row per (class, feature) and is broadcast onto the rows it scores.

* Gaussian naive Bayes: class priors, per-class means and population
  variances plus ``var_smoothing`` times the largest feature variance of the
  training rows; log-likelihoods summed per row, positive-class probability by
  a stable logistic of the difference; ties predict class 0.
* threshold classifier (the extension example): threshold = exact median of
  the first feature; predicts 1 when x >= threshold; exposes no score.
* voting: soft = mean of the base models' positive-class scores (optionally
  weighted), hard = share of positive votes; a tie predicts class 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOG_2PI = math.log(2 * math.pi)


def wide_to_long(df: DataFrame, id_col: str, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).alias("d"), F.col(f"`{c}`").cast("double").alias("value"))
                      for i, c in enumerate(cols)])
    return df.select(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{k}`") for k in keep], F.inline(cells))


def gaussian_nb_fit(train: DataFrame, var_smoothing: float = 1e-9) -> DataFrame:
    """(target, d, mean, var, log_prior) from long training rows (id, target, d, value)."""
    # every row has one cell per feature: the cells of a feature count the rows, repeated rows included
    per = train.groupBy("target", "d").agg(
        F.avg("value").alias("mean"), F.var_pop("value").alias("var0"), F.count(F.lit(1)).alias("n_c"))
    # two scalars from one-row aggregates: the largest feature variance and the row count
    max_var = train.groupBy("d").agg(F.var_pop("value").alias("v")).agg(F.max("v").alias("m")).first()["m"]
    eps = float(var_smoothing) * float(max_var or 0.0)
    n = F.sum("n_c").over(Window.partitionBy("d"))  # one row per class
    return per.select("target", "d", "mean", (F.col("var0") + F.lit(eps)).alias("var"),
                      F.log(F.col("n_c") / n).alias("log_prior"))


def gaussian_nb_score(test: DataFrame, params: DataFrame) -> DataFrame:
    """(id, score, prediction) for long test rows (id, d, value)."""
    # params: one row per (class, feature): bounded by 2 x the column count
    j = test.join(F.broadcast(params), "d")
    term = F.lit(-0.5) * (F.lit(LOG_2PI) + F.log("var") + (F.col("value") - F.col("mean")) ** 2 / F.col("var"))
    jll = j.groupBy("id", "target").agg((F.sum(term) + F.first("log_prior")).alias("jll"))
    wide = jll.groupBy("id").agg(F.max(F.when(F.col("target") == 1, F.col("jll"))).alias("j1"),
                                 F.max(F.when(F.col("target") == 0, F.col("jll"))).alias("j0"))
    diff = F.col("j1") - F.col("j0")
    score = F.when(diff >= 0, 1 / (1 + F.exp(-diff))).otherwise(F.exp(diff) / (1 + F.exp(diff)))
    return wide.select("id", score.alias("score"), (diff > 0).cast("int").alias("prediction"))


def threshold_predict(df: DataFrame, feature: str, threshold: float) -> DataFrame:
    return df.select(F.col("id"), F.lit(None).cast("double").alias("score"),
                     (F.col(feature) >= F.lit(threshold)).cast("int").alias("prediction"))


THRESHOLD_STATUS = "{name} does not expose probability estimates; AUC and ROC curves are unavailable for this model."


def voting_soft(scores: DataFrame, models: Sequence[str], weights: Sequence[float] | None = None) -> DataFrame:
    """(fold, id, label, score, prediction): weighted mean of base scores per row."""
    w = weights or [1.0] * len(models)
    wmap = F.create_map(*[x for m, wt in zip(models, w) for x in (F.lit(m), F.lit(float(wt)))])
    base = scores.where(F.col("model").isin(list(models))).withColumn("_w", wmap[F.col("model")])
    agg = base.groupBy("fold", "id", "label").agg(
        (F.sum(F.col("_w") * F.col("score")) / F.sum("_w")).alias("score"))
    return agg.withColumn("prediction", (F.col("score") > 0.5).cast("int"))


def voting_hard(scores: DataFrame, models: Sequence[str]) -> DataFrame:
    """(fold, id, label, score, prediction): share of positive votes; a tie predicts 0."""
    base = scores.where(F.col("model").isin(list(models)))
    agg = base.groupBy("fold", "id", "label").agg(F.avg(F.col("prediction").cast("double")).alias("score"))
    return agg.withColumn("prediction", (F.col("score") > 0.5).cast("int"))
