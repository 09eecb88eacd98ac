"""Model evaluation over a long score table.

Input rows: (model, fold, id, label, score, prediction) with one row per
model and out-of-fold prediction.  Everything here is relational, so it works
for any learner and for any number of rows:

* confusion counts and rates per fold and pooled (pooled rows carry
  ``fold = -1``), zero when a rate is undefined;
* exact ROC AUC with half credit for ties: per (model, fold, score) counts of
  positives and negatives, then the running count of negatives below each
  score from ``running_totals`` (no single-task window per model);
* the ROC curve with collinear interior points dropped;
* sample standard deviations over folds, NULL with fewer than two values.

Fixed values: labels are 0 and 1 with 1 positive; min-max scaling adds 1e-9
to the range; formatted metrics use 3 decimals (accuracy as a percentage
with 1 decimal) and the CSV export 4 decimals with 'N/A' for missing values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from .prefix import running_totals
from .topk import top_k_per_group

POOLED = -1
METRICS = ("sensitivity", "specificity", "vpp", "vpn", "accuracy", "f1_score", "auc")
MINMAX_EPS = 1e-9


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def confusion_matrix(scores: DataFrame) -> DataFrame:
    """(model, fold, tp, fp, tn, fn, n) per fold plus pooled rows with fold = -1."""
    y, p = F.col("label"), F.col("prediction")
    per_fold = scores.groupBy("model", "fold").agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 1) & (p == 0)).alias("fn"))
    pooled = per_fold.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")]).select(
        "model", F.lit(POOLED).alias("fold"), "tp", "fp", "tn", "fn")
    out = per_fold.unionByName(pooled)
    return out.select("model", F.col("fold").cast("int").alias("fold"),
                      *[F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "tn", "fn")],
                      (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).cast("bigint").alias("n"))


def rates(cm: DataFrame) -> DataFrame:
    """Sensitivity, specificity, PPV (vpp), NPV (vpn), accuracy, F1 from confusion counts."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return cm.select(
        "*",
        ratio(tp, tp + fn).alias("sensitivity"),
        ratio(tn, tn + fp).alias("specificity"),
        ratio(tp, tp + fp).alias("vpp"),
        ratio(tn, tn + fn).alias("vpn"),
        ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
    )


def score_counts(scores: DataFrame, pooled: bool = True) -> DataFrame:
    """(model, fold, score, pos, neg) per fold and, if ``pooled``, pooled (fold = -1), finite scores only."""
    y = F.col("label")
    per_fold = (scores.where(_finite(F.col("score")))
                .groupBy("model", "fold", "score")
                .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")))
    rows = per_fold
    if pooled:
        whole = per_fold.groupBy("model", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        rows = per_fold.unionByName(whole.withColumn("fold", F.lit(POOLED)), allowMissingColumns=False)
    return rows.select(
        "model", F.col("fold").cast("int").alias("fold"), "score",
        F.col("pos").cast("bigint").alias("pos"), F.col("neg").cast("bigint").alias("neg"))


def missing_scores(scores: DataFrame) -> DataFrame:
    """(model, fold, n_bad) rows with NULL or NaN scores, per fold and pooled."""
    per_fold = scores.groupBy("model", "fold").agg(F.count_if(~_finite(F.col("score"))).alias("n_bad"))
    pooled = per_fold.groupBy("model").agg(F.sum("n_bad").alias("n_bad")).withColumn("fold", F.lit(POOLED))
    return per_fold.unionByName(pooled).select("model", F.col("fold").cast("int").alias("fold"),
                                               F.col("n_bad").cast("bigint").alias("n_bad"))


def auc_exact(scores: DataFrame, pooled: bool = True) -> DataFrame:
    """(model, fold, auc): exact ROC AUC with ties counted half; NULL when a class is
    absent or any score of the scope is missing.  ``pooled`` False: folds only, which
    is half the rows to sort."""
    sc = running_totals(score_counts(scores, pooled), ["model", "fold"], ["score"], ["neg"])
    part = sc.groupBy("model", "fold").agg(
        F.sum(F.col("pos") * (F.col("neg_before") + 0.5 * F.col("neg"))).alias("_num"),
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    auc = F.when((F.col("_p") > 0) & (F.col("_n") > 0) & (F.coalesce(F.col("n_bad"), F.lit(0)) == 0),
                 F.col("_num") / (F.col("_p").cast("double") * F.col("_n").cast("double")))
    bad = missing_scores(scores) if pooled else missing_scores(scores).where(F.col("fold") != POOLED)
    return bad.join(part, ["model", "fold"], "left").select("model", "fold", auc.alias("auc"))


def usable_scores(scores: DataFrame) -> DataFrame:
    """(model, usable): pooled scores are kept only if every row has a finite score."""
    return scores.groupBy("model").agg(F.every(_finite(F.col("score"))).cast("int").alias("usable"))


def roc_curve(scores: DataFrame) -> DataFrame:
    """Pooled ROC points (model, point, fpr, tpr) for models with usable scores and both classes.

    Point 0 is the origin; then one point per distinct score, descending,
    keeping the first, the last and every point where the slope changes.
    """
    counts = score_counts(scores).where(F.col("fold") == POOLED).drop("fold").withColumn(
        "one", F.lit(1).cast("bigint"))
    pts = running_totals(counts, ["model"], [("score", True)], ["pos", "neg", "one"])
    totals = counts.groupBy("model").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"),
                                         F.sum("one").alias("n_pts"))
    ok = usable_scores(scores).where(F.col("usable") == 1).join(totals, "model").where(
        (F.col("P") > 0) & (F.col("N") > 0))
    pts = pts.select("model", F.col("one_before").alias("idx"),
                     (F.col("pos_before") + F.col("pos")).alias("tps"),
                     (F.col("neg_before") + F.col("neg")).alias("fps"), "pos", "neg")
    nxt = pts.select("model", (F.col("idx") - 1).alias("idx"), F.col("pos").alias("pos_next"),
                     F.col("neg").alias("neg_next"))
    kept = (pts.join(nxt, ["model", "idx"], "left").join(ok, "model")
            .where((F.col("idx") == 0) | F.col("pos_next").isNull()
                   | (F.col("pos_next") != F.col("pos")) | (F.col("neg_next") != F.col("neg"))))
    curve = kept.select("model", (F.col("idx") + 1).cast("bigint").alias("point"),
                        (F.col("fps") / F.col("N")).alias("fpr"), (F.col("tps") / F.col("P")).alias("tpr"))
    origin = ok.select("model", F.lit(0).cast("bigint").alias("point"), F.lit(0.0).alias("fpr"),
                       F.lit(0.0).alias("tpr"))
    return origin.unionByName(curve)


def fold_metrics(scores: DataFrame) -> DataFrame:
    """Per (model, fold >= 0): the six rates and the fold AUC."""
    r = rates(confusion_matrix(scores)).where(F.col("fold") != POOLED)
    return r.join(auc_exact(scores, pooled=False), ["model", "fold"], "left")


def fold_std(scores: DataFrame, fm: DataFrame | None = None) -> DataFrame:
    """Sample standard deviation over folds of every metric; NULL with fewer than 2 values."""
    fm = fm if fm is not None else fold_metrics(scores)
    aggs = []
    for m in METRICS:
        aggs.append(F.when(F.count(m) >= 2, F.stddev_samp(m)).alias(f"{m}_std"))
    return fm.groupBy("model").agg(*aggs)


def metrics_table(scores: DataFrame) -> DataFrame:
    """Pooled out-of-fold metrics per model with the seven fold standard deviations.

    Pooled and fold rows of the counts and AUCs are computed together and told apart in one last aggregation.
    """
    both = rates(confusion_matrix(scores)).join(auc_exact(scores), ["model", "fold"], "left")
    pooled = F.col("fold") == POOLED
    whole = [F.max(F.when(pooled, F.col(c))).alias(c) for c in
             ("tp", "fp", "tn", "fn", "sensitivity", "specificity", "vpp", "vpn", "accuracy", "f1_score", "auc")]
    spread = [F.when(F.count(x) >= 2, F.stddev_samp(x)).alias(f"{m}_std")
              for m in METRICS for x in [F.when(~pooled, F.col(m))]]
    return both.groupBy("model").agg(*whole, *spread)


def minmax_scores(scores: DataFrame) -> DataFrame:
    """(model, fold, id, score): decision values scaled by (s - min) / (range + 1e-9) per test fold."""
    lim = scores.groupBy("model", "fold").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    return scores.join(lim, ["model", "fold"]).select(
        "model", "fold", "id", ((F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + MINMAX_EPS))
        .alias("score"))


def best_model(metrics: DataFrame, request_pos: Column) -> DataFrame:
    """Highest AUC; the first model in request order wins ties; missing AUC is ignored."""
    cand = metrics.where(_finite(F.col("auc"))).withColumn("request_pos", request_pos)
    return top_k_per_group(cand, [], [F.col("auc").desc(), F.col("request_pos")], 1, "rank").select(
        "model", "auc", "request_pos")


def half_up(c: Column, digits: int) -> Column:
    """Round half up in double arithmetic (same result in every engine)."""
    scale = float(10 ** digits)
    return F.floor(c * scale + 0.5) / scale


def fmt(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", half_up(c, digits))


def format_metric(value: Column, std: Column, percent: bool = False) -> Column:
    """'v ± sd' with 3 decimals (accuracy: percent with 1 decimal); 'N/A' when missing."""
    if percent:
        v, s = F.concat(fmt(value * 100, 1), F.lit("%")), F.concat(fmt(std * 100, 1), F.lit("%"))
    else:
        v, s = fmt(value, 3), fmt(std, 3)
    return (F.when(~_finite(value), F.lit("N/A"))
            .when(~_finite(std), v)
            .otherwise(F.concat(v, F.lit(" ± "), s)))


def formatted_metrics(metrics: DataFrame) -> DataFrame:
    """One display string per metric and model, as the results page shows them."""
    return metrics.select(
        "model",
        format_metric(F.col("auc"), F.col("auc_std")).alias("auc_text"),
        format_metric(F.col("accuracy"), F.col("accuracy_std"), percent=True).alias("accuracy_text"),
        format_metric(F.col("f1_score"), F.col("f1_score_std")).alias("f1_text"),
        format_metric(F.col("sensitivity"), F.col("sensitivity_std")).alias("sensitivity_text"),
        format_metric(F.col("specificity"), F.col("specificity_std")).alias("specificity_text"),
        format_metric(F.col("vpp"), F.col("vpp_std")).alias("vpp_text"),
        format_metric(F.col("vpn"), F.col("vpn_std")).alias("vpn_text"),
    )


def comparison_lines(metrics: DataFrame) -> DataFrame:
    """One text line per model with a valid AUC: AUC, accuracy, sensitivity, specificity, F1."""
    return metrics.where(_finite(F.col("auc"))).select(
        "model",
        F.concat(F.lit("Model: "), F.col("model"),
                 F.lit(" | AUC: "), fmt(F.col("auc"), 3),
                 F.lit(" | Accuracy: "), fmt(F.col("accuracy") * 100, 1), F.lit("%"),
                 F.lit(" | Sensitivity (Recall): "), fmt(F.col("sensitivity"), 3),
                 F.lit(" | Specificity: "), fmt(F.col("specificity"), 3),
                 F.lit(" | F1-Score: "), fmt(F.col("f1_score"), 3)).alias("line"))


CSV_METRICS = (("AUC", "auc"), ("Accuracy", "accuracy"), ("Sensitivity", "sensitivity"),
               ("Specificity", "specificity"), ("VPP", "vpp"), ("VPN", "vpn"), ("F1", "f1_score"))


def metrics_csv_rows(metrics: DataFrame, hyperparameters: Column | None = None) -> DataFrame:
    """Rows of the metrics report: Model, <metric>, <metric>_SD ..., TP, FP, TN, FN, Hyperparameters."""
    def cell(c):
        return F.when(_finite(F.col(c)), fmt(F.col(c), 4)).otherwise(F.lit("N/A"))

    cols = [F.col("model").alias("Model")]
    for label, key in CSV_METRICS:
        cols += [cell(key).alias(label), cell(f"{key}_std").alias(f"{label}_SD")]
    cols += [F.col(c).cast("string").alias(c.upper()) for c in ("tp", "fp", "tn", "fn")]
    cols.append((hyperparameters if hyperparameters is not None else F.lit("N/A")).alias("Hyperparameters"))
    return metrics.where(F.col("tp").isNotNull()).select(*cols)


def filter_metrics_present(metrics: DataFrame) -> DataFrame:
    """Models whose pooled AUC is a number (the ones charts and comparisons use)."""
    return metrics.where(_finite(F.col("auc")))


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV export (one folder of part files; Spark writes it in parallel)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def order_by_request(df: DataFrame, names: Sequence[str], col: str = "model") -> DataFrame:
    """Attach the request position of each model name (unknown names get NULL)."""
    pos = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    return df.withColumn("request_pos", pos[F.col(col)])


def order_results(metrics: DataFrame, requested: Sequence[str], clustering: Sequence[str] = ()) -> DataFrame:
    """(model, request_pos, is_clustering, auc) of every requested name: in request order, clusterings last."""
    names = [n for n in dict.fromkeys(requested) if n not in clustering]
    names += [n for n in dict.fromkeys(requested) if n in clustering]
    order = metrics.sparkSession.createDataFrame([(n, i, int(n in clustering)) for i, n in enumerate(names)],
                                                 "model string, request_pos int, is_clustering int")  # the request's names
    return order.join(metrics.select("model", "auc"), "model", "left")


#: Points or members in one part of a result document.
PART_ROWS = 1000


def results_document(metrics: DataFrame, roc: DataFrame, hyperparameters: Column | None = None,
                     clusters: DataFrame | None = None) -> DataFrame:
    """The results of a request as JSON parts (model, part, document).

    Part 0 has name, metrics with the confusion matrix, hyperparameters and the number of ROC points; the parts behind it
    have ``PART_ROWS`` points of the ROC curve each, in order.  ``clusters`` (model, cluster, id) adds parts with as many
    members.  A curve or a cluster that grows with the data is thus never one value.
    """
    n_pts = roc.groupBy("model").agg(F.count(F.lit(1)).alias("_n_pts"))
    m = metrics.join(n_pts, "model", "left")
    metric_cols = ("sensitivity", "specificity", "vpp", "vpn", "accuracy", "f1_score", "auc")
    head = F.struct(
        F.col("model").alias("name"),
        F.struct(F.struct("tp", "fp", "tn", "fn").alias("confusion_matrix"),
                 *[F.col(c) for c in metric_cols], *[F.col(f"{c}_std") for c in metric_cols]).alias("metrics"),
        F.coalesce(F.col("_n_pts"), F.lit(0)).alias("roc_points"),
        (hyperparameters if hyperparameters is not None else F.lit(None).cast("string")).alias("hyperparameters"))
    out = m.select("model", F.lit(0).cast("bigint").alias("part"), F.to_json(head).alias("document"))
    points = roc.groupBy("model", (F.floor(F.col("point") / PART_ROWS) + 1).cast("bigint").alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("point", "fpr", "tpr"))).alias("roc_curve"))
    out = out.unionByName(points.select("model", "part", F.to_json(F.struct("roc_curve")).alias("document")))
    if clusters is not None:
        # members are dealt into parts by a hash, about ``PART_ROWS`` in each
        parts = clusters.groupBy(F.col("model").alias("_m"), F.col("cluster").alias("_c")).agg(
            F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("_parts"))
        dealt = clusters.join(parts, (F.col("model") == F.col("_m")) & (F.col("cluster") == F.col("_c"))).withColumn(
            "part", F.pmod(F.xxhash64("id"), F.col("_parts")) + 1)
        members = dealt.groupBy("model", "cluster", "part").agg(F.array_sort(F.collect_list("id")).alias("members"))
        out = out.unionByName(members.select("model", "part", F.to_json(F.struct("cluster", "members")).alias("document")))
    return out
