"""Registered learner, search and clustering queries (2.13-2.15, rows-only checks).

Learners are cross-validated on the ``ord`` cohort with ``target_signal``.
They run their whole light grids on ten tuning folds and evaluate the best
candidate on ten evaluation folds; only the LightGBM preset and the forest of
the importances run one custom candidate (README).  Results of one (model,
grid) are memoized per application and data folder because several queries
read them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clustering as CL
from ..operators import evaluation as E
from ..operators import grids as G
from ..operators import search as S
from ..operators.topk import top_k_per_group
from ..sources import fixtures as X
from .registry import finish, register

CUSTOM = {
    G.RANDOM_FOREST: {"n_estimators": ["30"], "max_depth": ["8"], "min_samples_split": ["2"]},
    G.LIGHTGBM: {"n_estimators": ["15"], "learning_rate": ["0.1"], "num_leaves": ["15"], "max_depth": ["-1"]},
}
KMEANS_K = 3
_MEMO: dict = {}


def _memo(spark, sf, what, make):
    """Results of one running application only: an earlier session's frames cannot be read any more."""
    application = spark.sparkContext.applicationId
    for key in [k for k in _MEMO if k[0] != application]:
        del _MEMO[key]
    if (application, sf, what) not in _MEMO:
        _MEMO[application, sf, what] = make()
    return _MEMO[application, sf, what]


def _signal(spark, sf):
    return X.ord_cohort(spark, sf, target="target_signal")


def context(spark, sf):
    """One search context (cohort, kinds, fold plans) shared by all learners, as in one training request."""
    return _memo(spark, sf, "context", lambda: S.SearchContext(_signal(spark, sf)))


def trained(spark, sf, model):
    mode = "custom" if model == G.LIGHTGBM else "light"
    return _memo(spark, sf, model, lambda: S.train_model(context(spark, sf), model, mode=mode, custom=CUSTOM, parallelism=8))


def _metrics(spark, sf, model):
    return finish(E.metrics_table(trained(spark, sf, model).scores))


for _key, _model in (("logistic", G.LOGISTIC), ("elastic_net", G.ELASTIC_NET), ("svm_rbf", G.SVM),
                     ("random_forest", G.RANDOM_FOREST), ("gradient_boosting", G.GRADIENT_BOOSTING),
                     ("gbt_preset_xgb", G.XGBOOST), ("gbt_preset_lgbm", G.LIGHTGBM),
                     ("gbt_preset_catboost", G.CATBOOST)):
    register(_key)(lambda spark, sf, _m=_model: _metrics(spark, sf, _m))


@register("cv_search")
def q_cv_search(spark, sf):
    """Candidate ranking of the logistic light grid (mean exact fold AUC, ties by grid order)."""
    return finish(trained(spark, sf, G.LOGISTIC).candidates)


@register("grid_rank")
def q_grid_rank(spark, sf):
    """Mean exact fold AUC and rank of the score table's models as candidates (no AUC counts as -1, ties by order)."""
    auc = E.auc_exact(X.scores_frame(spark, sf)).where(F.col("fold") != E.POOLED)
    place = F.create_map(*[F.lit(x) for i, m in enumerate(X.SCORE_MODELS) for x in (m, i)])
    return finish(S.grid_rank(auc.select(place[F.col("model")].alias("candidate"), "fold", "auc")))


@register("grid_winner")
def q_grid_winner(spark, sf):
    """The winning candidate of the logistic search with its parameters."""
    r = trained(spark, sf, G.LOGISTIC)
    best = r.candidates.where(F.col("rank") == 1).select("candidate", "mean_auc")
    return finish(best.withColumn("C", F.lit(float(r.best_params.get("C")))))


@register("cv_evaluate")
def q_cv_evaluate(spark, sf):
    """Out-of-fold metrics of the best logistic candidate on the evaluation folds (seed 137)."""
    return finish(E.metrics_table(trained(spark, sf, G.LOGISTIC).scores))


@register("oof_assemble")
def q_oof_assemble(spark, sf):
    """Every row's out-of-fold naive Bayes score from the tuning folds (one row per ID)."""
    plan = context(spark, sf).plan(S.TUNING_SEED)
    bayes = S.LEARNERS[G.NAIVE_BAYES]
    scores = S.out_of_fold(plan, bayes, [{"var_smoothing": 1e-9}], lambda ci: G.NAIVE_BAYES)
    return finish(scores.select("fold", "id", "label", "score", "prediction"))


@register("oof_logistic")
def q_oof_logistic(spark, sf):
    """Every row's out-of-fold score of the best logistic candidate from the evaluation folds."""
    return finish(trained(spark, sf, G.LOGISTIC).scores)


@register("positive_score")
def q_positive_score(spark, sf):
    """Calibrated positive-class scores of the SVM approximation (margin -> probability)."""
    return finish(trained(spark, sf, G.SVM).scores.select("fold", "id", "score", "prediction"))


@register("best_params")
def q_best_params(spark, sf):
    r = trained(spark, sf, G.LOGISTIC)
    rows = [(k, "None" if v is None else str(v)) for k, v in r.hyperparameters.items()]
    return spark.createDataFrame(rows, "key string, value string")


@register("format_hyperparameters")
def q_format_hyperparameters(spark, sf):
    r = trained(spark, sf, G.LOGISTIC)
    return spark.createDataFrame([(G.LOGISTIC, G.format_hyperparameters(r.hyperparameters))],
                                 "model string, hyperparameters string")


@register("feature_importance")
def q_feature_importance(spark, sf):
    """Random-forest importances refitted on all rows with the custom candidate."""
    params = G.expand_grid(G.select_grid(G.RANDOM_FOREST, "custom", CUSTOM))[0]
    return finish(S.feature_importance(_signal(spark, sf), params))


@register("top_features")
def q_top_features(spark, sf):
    """The six most important features, importance descending (the reference lists the first six unsorted)."""
    params = G.expand_grid(G.select_grid(G.RANDOM_FOREST, "custom", CUSTOM))[0]
    imp = S.feature_importance(_signal(spark, sf), params)
    return finish(top_k_per_group(imp, [], [F.col("importance").desc(), F.col("pos")], 6, "rank"))


@register("naive_bayes_cv")
def q_naive_bayes_cv(spark, sf):
    return _metrics(spark, sf, G.NAIVE_BAYES)


@register("knn_cv")
def q_knn_cv(spark, sf):
    return _metrics(spark, sf, G.KNN)


@register("voting_cv")
def q_voting_cv(spark, sf):
    """Soft voting of logistic regression and naive Bayes over their out-of-fold scores."""
    a = trained(spark, sf, G.LOGISTIC).scores
    b = trained(spark, sf, G.NAIVE_BAYES).scores
    from ..operators.learners import voting_soft
    v = voting_soft(a.unionByName(b), [G.LOGISTIC, G.NAIVE_BAYES]).withColumn("model", F.lit(G.VOTING))
    return finish(E.metrics_table(v.select("model", "fold", "id", "label", "score", "prediction")))


@register("stacking")
def q_stacking(spark, sf):
    """Logistic meta-model over base scores from five inner folds, on all evaluation folds; C searched over 0.5 and 1."""
    bases = [(m, trained(spark, sf, m).best_params) for m in (G.LOGISTIC, G.NAIVE_BAYES)]
    cs = G.LIGHT_GRIDS[G.STACKING]["final_estimator__C"]
    return finish(E.metrics_table(_memo(spark, sf, G.STACKING, lambda: S.train_stacking(context(spark, sf), bases, cs)).scores))


@register("train_request")
def q_train_request(spark, sf):
    """A whole request: results in request order with the clustering last, AUC, status and the sanitized name."""
    asked = [G.KMEANS, G.VOTING, G.NAIVE_BAYES, G.LOGISTIC]
    done = S.train_models(context(spark, sf), asked)
    pooled = [E.metrics_table(r.scores).select("model", "auc") for r in done if r.name != G.KMEANS]
    auc = reduce(DataFrame.unionByName, pooled)
    order = spark.createDataFrame([(i, r.name, slug, int(r.name == G.KMEANS), r.status) for i, (r, slug) in enumerate(
        zip(done, G.sanitize_names([r.name for r in done])))],
        "position int, model string, slug string, is_clustering int, status string")  # a row per requested model
    return finish(order.join(auc, "model", "left").select("position", "model", "slug", "is_clustering", "auc", "status"))


@register("status_row")
def q_status_row(spark, sf):
    """Result rows for models without scores: the threshold learner (no probabilities)."""
    from .model_queries import doc_folded
    from ..operators.foldstats import leave_fold_out_median
    from ..operators.learners import THRESHOLD_STATUS
    c, k = doc_folded(spark, sf)
    thr = leave_fold_out_median(c.df, "n_chars", "fold", k)
    oof = c.df.join(F.broadcast(thr), "fold").select(
        F.lit("Threshold").alias("model"), "fold", "id", F.col("target").alias("label"),
        F.lit(None).cast("double").alias("score"), (F.col("n_chars") >= F.col("median")).cast("int").alias("prediction"))
    m = E.metrics_table(oof)
    return finish(m.select("model", "auc", "accuracy", F.when(F.col("auc").isNull(), F.lit(
        THRESHOLD_STATUS.format(name="Threshold"))).alias("status_message")))


# ---------------------------------------------------------------- clustering
def _kfit(spark, sf):
    return _memo(spark, sf, "kmeans", lambda: CL.kmeans(X.ord_cohort(spark, sf), KMEANS_K))


def _elbow(spark, sf):
    return _memo(spark, sf, "elbow", lambda: CL.kmeans_elbow(X.ord_cohort(spark, sf)).checkpoint(eager=True))


@register("kmeans")
def q_kmeans(spark, sf):
    f = _kfit(spark, sf)
    return finish(CL.cluster_analysis(f.assignments, f.k).withColumn("inertia", F.lit(f.cost)))


@register("kmeans_elbow")
def q_kmeans_elbow(spark, sf):
    return finish(_elbow(spark, sf))


#: Centroids that are the same in every feature (scaled): with them SQL can follow the outputs of a clustering.
FIXED_CENTROIDS = (-1.0, 0.0, 1.0, 2.0, -2.0, 0.5)


def _fixed(spark, sf):
    def make():
        data, cols = CL.prepared_points(X.ord_cohort(spark, sf))
        return data, [[c] * len(cols) for c in FIXED_CENTROIDS]
    return _memo(spark, sf, "fixed centroids", make)


def fixed_assignment(spark, sf):
    data, centers = _fixed(spark, sf)
    return CL.assigned(data, centers[:KMEANS_K])


def _fixed_elbow(spark, sf):
    """Inertia of the first k fixed centroids, k = 1 to 6, from one pass."""
    data, centers = _fixed(spark, sf)
    rows = CL.prefix_inertia(data, centers)
    return spark.createDataFrame([(k + 1, float(v)) for k, v in enumerate(rows)], "k int, inertia double")


@register("one_cluster_inertia")
def q_one_cluster_inertia(spark, sf):
    """The elbow at k = 1, in closed form."""
    data, centers = _fixed(spark, sf)
    return finish(spark.createDataFrame([(1, CL.one_cluster_inertia(data, len(centers[0])))], "k int, inertia double"))


@register("suggest_k")
def q_suggest_k(spark, sf):
    """The k suggested by the inertias of growing sets of fixed centroids."""
    return finish(CL.suggest_k(_fixed_elbow(spark, sf)))


@register("fixed_elbow")
def q_fixed_elbow(spark, sf):
    return finish(_fixed_elbow(spark, sf))


@register("suggest_k_elbow")
def q_suggest_k_elbow(spark, sf):
    """The k suggested by the elbow of fitted clusterings."""
    return finish(CL.suggest_k(_elbow(spark, sf)))


@register("cluster_analysis")
def q_cluster_analysis(spark, sf):
    return finish(CL.cluster_analysis(fixed_assignment(spark, sf), KMEANS_K))


@register("cluster_members")
def q_cluster_members(spark, sf):
    return finish(CL.cluster_members(fixed_assignment(spark, sf)))


@register("attach_cluster")
def q_attach_cluster(spark, sf):
    return finish(fixed_assignment(spark, sf))


@register("export_clusters_csv")
def q_export_clusters_csv(spark, sf):
    return finish(CL.clusters_csv_rows(fixed_assignment(spark, sf)))


@register("balanced_fit")
def q_balanced_fit(spark, sf):
    """Logistic regression (light grid) on ``doc`` with SMOTE applied to each training fold only (never to test rows)."""
    fit = _memo(spark, sf, "balanced", lambda: S.train_model(X.doc_cohort(spark, sf), G.LOGISTIC, balance="smote"))
    return finish(E.metrics_table(fit.scores))


@register("balanced_bayes")
def q_balanced_bayes(spark, sf):
    """Naive Bayes on ``doc`` with random oversampling of each training fold."""
    fit = _memo(spark, sf, "balanced bayes",
                lambda: S.train_model(X.doc_cohort(spark, sf), G.NAIVE_BAYES, balance="oversample"))
    return finish(E.metrics_table(fit.scores))


@register("balanced_knn")
def q_balanced_knn(spark, sf):
    """KNN on ``doc`` with SMOTE of each training fold, its whole light grid."""
    fit = _memo(spark, sf, "balanced knn", lambda: S.train_model(X.doc_cohort(spark, sf), G.KNN, balance="smote"))
    return finish(E.metrics_table(fit.scores))
