"""Cross-validated hyperparameter search and out-of-fold evaluation.

Flow per model (the cohort tool's semantics):

1. two stratified fold plans with the same k: tuning (seed 42) and
   evaluation (seed 137);
2. preparation is fitted on the training rows of every fold; all k fits come
   from one pass each for medians (``running_totals`` over per-fold counts),
   modes and moments (per-fold sums; training = total - fold);
3. every candidate x tuning fold is fitted (batched passes, tree growths in
   tasks, or Spark ML jobs in ``parallelism`` driver threads); the fold scores of all candidates form one long score
   table whose exact fold AUCs rank the candidates (mean AUC, ties by grid
   position);
4. the best candidate is refitted on every evaluation fold; the out-of-fold
   scores are the long table (model, fold, id, label, score, prediction) that
   ``evaluation`` turns into metrics, fold spreads and the ROC curve.

Learners: logistic / elastic net (``LogisticRegression`` with
regParam = 1 / (C * n)), random forest, gradient boosting and three labelled
presets of ``GBTClassifier`` (all but LightGBM grown by ``trees`` where a task
can hold the rows), an RBF-SVM approximation (random Fourier
features + ``LinearSVC`` + logistic calibration of the margin), and the
relational learners (KNN, Gaussian naive Bayes).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cohort import Cohort
from ..functions.numeric import qcol
from . import balance as B
from . import evaluation as E
from . import folds as FO
from . import grids as G
from . import learners as L
from . import batched as BT
from . import trees as T
from .foldstats import leave_out_medians
from .knn import FoldView, knn_scores, knn_votes, votes_out_of_folds
from ..session import scratch_path, spread
from .prep import FeatureTypes, Preparation, split_feature_types

TUNING_SEED = 42
EVALUATION_SEED = 137
INNER_SEED = 211
MAX_SPARK_DEPTH = 30
#: Default settings of the SVM fit; a request's ``rff_features`` and ``max_iter`` replace them.
RFF_FEATURES = 256
SVM_MAX_ITER = 100
#: Training rows per core that the fits running at a time may hold: Spark's trees keep their rows in memory, 200 to 400 bytes each.
HELD_ROWS = 1_000_000


# ---------------------------------------------------------------- fold-aware preparation
IMPUTER_KEY = "continuous__imputer__strategy"
IMPUTER_STRATEGIES = ("median", "mean", "constant")


def fit_fold_preparations(cohort: Cohort, fold_col: str, k: int, types: FeatureTypes,
                          strategy: str = "median") -> dict[int, Preparation]:
    """Preparation fitted on the training rows of each of the k folds."""
    fitted = fit_preparations(cohort, [(f, -1) for f in range(k)], types, strategy, fold_col)
    return {f: prep for (f, _), prep in fitted.items()}


def fit_preparations(cohort: Cohort, left_out: Sequence[tuple[int, int]], types: FeatureTypes, strategy: str = "median",
                     fold_col: str = "fold", inner_col: str | None = None) -> dict[tuple[int, int], Preparation]:
    """Preparations on the rows outside (fold, inner fold), for all of ``left_out`` in three passes; inner -1: only the fold.

    ``strategy`` is the continuous imputer: median (default), mean of the
    present training values, or the constant 0.
    """
    if strategy not in IMPUTER_STRATEGIES:
        raise ValueError(f"unsupported imputer strategy {strategy!r}; use one of {IMPUTER_STRATEGIES}")
    df, keys = cohort.df, list(left_out)
    fold, inner = qcol(fold_col), qcol(inner_col) if inner_col else F.lit(-1)
    cont, binr = list(types.continuous), list(types.binary)
    med_cols = cont if (cont or not binr) else []
    if not cont and not binr:
        med_cols = list(cohort.feature_cols)
    fills: dict[tuple[int, int], dict] = {key: {} for key in keys}
    if med_cols and strategy == "constant":
        for key in keys:
            fills[key].update({c: 0.0 for c in med_cols})
    elif med_cols and (strategy == "median" or not cont):
        out = [(fold == f) | (inner == g) if g >= 0 else fold == f for f, g in keys]
        for r in leave_out_medians(df, med_cols, out).collect():  # a row per feature and key
            fills[keys[r["fold"]]][r["variable"]] = r["median"]
    # sums per (fold, inner fold): a key's training sums are those of the cells outside it
    shift = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(qcol(c)).alias(f"c{i}") for i, c in enumerate(cont)]).first()
    centre = [float(shift[f"c{i}"] or 0.0) for i in range(len(cont))]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(binr):
        aggs += [F.count_if(qcol(c) == 1).alias(f"one{i}"), F.count_if(qcol(c) == 0).alias(f"zero{i}")]
    for i, c in enumerate(cont):
        x = qcol(c).cast("double") - F.lit(centre[i])
        aggs += [F.sum(x).alias(f"s1_{i}"), F.sum(x * x).alias(f"s2_{i}"), F.count(x).alias(f"np_{i}")]
    cells = df.groupBy(fold.alias("_f"), inner.alias("_g")).agg(*aggs).collect() if cont or binr else []  # folds x inner folds
    preps = {}
    for key in keys:
        f, g = key
        used = [r for r in cells if r["_f"] != f and (g < 0 or r["_g"] != g)]
        total = lambda name, used=used: sum(r[name] or 0 for r in used)
        fill, mean, scale, n = fills[key], {}, {}, total("n")
        for i, c in enumerate(binr):
            fill[c] = 1.0 if total(f"one{i}") > total(f"zero{i}") else 0.0
        for i, c in enumerate(cont):
            s1, s2, present = total(f"s1_{i}"), total(f"s2_{i}"), total(f"np_{i}")
            if strategy == "mean":
                fill[c] = centre[i] + (s1 / present if present else 0.0)
            gap = fill[c] - centre[i] if fill.get(c) is not None else 0.0
            t1, t2 = s1 + (n - present) * gap, s2 + (n - present) * gap * gap
            mean[c] = centre[i] + (t1 / n if n else 0.0)
            sd = math.sqrt(max(t2 / n - (t1 / n) ** 2, 0.0) if n else 0.0)
            scale[c] = sd if sd > 1e-12 * max(1.0, abs(mean[c])) else 1.0
        preps[key] = Preparation(types, fill, mean, scale)
    return preps


# ---------------------------------------------------------------- learners
@dataclass
class Learner:
    name: str
    fit_score: Callable  # (train, test, cols, params, n_train) -> DataFrame(id, score, prediction)
    fixed: dict = field(default_factory=dict)
    unused: tuple[str, ...] = ()  # grid keys without a Spark counterpart: not fitted apart, not reported
    # (train rows, model keys, candidates) -> Fitted: all folds and candidates together
    fit_all: Callable | None = None
    calibrated: bool = False  # scores of the chosen candidate are calibrated on inner folds
    stop: Callable | None = None  # params -> trees.Stop: all folds and candidates grown as bytes in tasks

    def distinct(self, candidates: Sequence[dict]) -> list[dict]:
        """Candidates without the unused keys, each different fit once, in grid order."""
        out: list[dict] = []
        for params in candidates:
            used = {key: v for key, v in params.items() if key not in self.unused}
            if used not in out:
                out.append(used)
        return out


def _assembled(df: DataFrame, cols) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(df)


def _spark_ml(make: Callable) -> Callable:
    def fit_score(train, test, cols, params, n_train):
        est = make(params, n_train)
        model = est.fit(_assembled(train, cols).withColumnRenamed("target", "label"))
        out = model.transform(_assembled(test, cols))
        return out.select("id", vector_to_array("probability")[1].alias("score"),
                          F.col("prediction").cast("int").alias("prediction")), model
    return fit_score


def _logistic(params, n):
    c = float(params.get("C", 1.0))
    return LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=float(params.get("l1_ratio", 0.0)),
                              standardization=False, maxIter=100, tol=1e-6)


def _depth(v):
    return MAX_SPARK_DEPTH if v is None or int(v) <= 0 else min(int(v), MAX_SPARK_DEPTH)


def _forest(params, n):
    return RandomForestClassifier(numTrees=int(params.get("n_estimators", 100)), maxDepth=_depth(params.get("max_depth")),
                                  minInstancesPerNode=int(params.get("min_samples_leaf", 1) or 1), seed=TUNING_SEED)


def _boosting(params, n):
    return GBTClassifier(maxIter=int(params.get("n_estimators", 100)), stepSize=float(params.get("learning_rate", 0.1)),
                         maxDepth=_depth(params.get("max_depth", 3)),
                         subsamplingRate=float(params.get("subsample", 1.0) or 1.0), seed=TUNING_SEED)


def _xgb_preset(params, n):
    col = params.get("colsample_bytree")
    return GBTClassifier(maxIter=int(params.get("n_estimators", 100)), stepSize=float(params.get("learning_rate", 0.1)),
                         maxDepth=_depth(params.get("max_depth", 6)),
                         subsamplingRate=float(params.get("subsample", 1.0) or 1.0),
                         featureSubsetStrategy=str(col) if col not in (None, 1, 1.0) else "all", seed=TUNING_SEED)


def _lgbm_preset(params, n):
    leaves = int(params.get("num_leaves", 31))
    depth = int(math.ceil(math.log2(max(leaves, 2))))
    md = params.get("max_depth", -1)
    if md is not None and int(md) > 0:
        depth = min(depth, int(md))
    return GBTClassifier(maxIter=int(params.get("n_estimators", 100)), stepSize=float(params.get("learning_rate", 0.1)),
                         maxDepth=_depth(depth), subsamplingRate=float(params.get("subsample", 1.0) or 1.0),
                         seed=TUNING_SEED)


def _catboost_preset(params, n):
    return GBTClassifier(maxIter=int(params.get("iterations", 100)), stepSize=float(params.get("learning_rate", 0.1)),
                         maxDepth=_depth(params.get("depth", 6)), seed=TUNING_SEED)


def _forest_stop(p: Mapping) -> T.Stop:
    depth = _depth(p.get("max_depth"))
    return T.Stop(T.Growth("forest", depth, features=0.0, least=float(p.get("min_samples_leaf", 1) or 1)),
                  int(p.get("n_estimators", 100)), depth)


def _boosting_stop(trees: str, depth: str, deep: int) -> Callable[[Mapping], T.Stop]:
    """The same settings that ``_boosting``, ``_xgb_preset`` and ``_catboost_preset`` read."""
    def stop(p: Mapping) -> T.Stop:
        growth = T.Growth("boost", _depth(p.get(depth, deep)), float(p.get("learning_rate", 0.1)),
                          float(p.get("subsample", 1.0) or 1.0), float(p.get("colsample_bytree") or 1.0))
        return T.Stop(growth, int(p.get(trees, 100)), growth.depth)

    return stop


def _rff(df: DataFrame, cols, gamma: float, dim: int, seed: int) -> DataFrame:
    """Random Fourier features of the RBF kernel exp(-gamma |x - y|^2) (Rahimi and Recht, 2007)."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(dim, len(cols)))
    b = rng.uniform(0.0, 2.0 * math.pi, size=dim)
    x = F.array(*[qcol(c).cast("double") for c in cols])
    feats = []
    for i in range(dim):
        wi = F.array(*[F.lit(float(v)) for v in w[i]])
        dot = F.aggregate(F.zip_with(x, wi, lambda a, c: a * c), F.lit(0.0), lambda acc, v: acc + v)
        feats.append((F.lit(math.sqrt(2.0 / dim)) * F.cos(dot + F.lit(float(b[i])))).alias(f"_rff{i}"))
    return df.select("*", *feats)


def _svm_fit_score(train, test, cols, params, n_train):
    gamma = float(params.get("gamma", 0.1))
    c = float(params.get("C", 1.0))
    kernel = str(params.get("kernel", "rbf"))
    if kernel == "linear":
        tr, te = _assembled(train, cols).withColumnRenamed("target", "label"), _assembled(test, cols)
    elif kernel == "rbf":
        dim = int(params.get("rff_features", RFF_FEATURES))
        names = [f"_rff{i}" for i in range(dim)]
        tr = _assembled(_rff(train, cols, gamma, dim, TUNING_SEED), names).withColumnRenamed("target", "label")
        te = _assembled(_rff(test, cols, gamma, dim, TUNING_SEED), names)
    else:
        raise ValueError(f"unsupported kernel {kernel!r}; use rbf or linear")
    svm = LinearSVC(regParam=1.0 / (c * n_train), maxIter=int(params.get("max_iter", SVM_MAX_ITER)), tol=1e-4).fit(tr)
    margin = vector_to_array("rawPrediction")[1]
    cal_in = svm.transform(tr).select(margin.alias("m0"), "label")
    cal = LogisticRegression(regParam=0.0, maxIter=100).fit(
        VectorAssembler(inputCols=["m0"], outputCol="features").transform(cal_in))
    # predictions come from the margin, scores from the calibrated margin (they can disagree at 0.5)
    scored = svm.transform(te).select("id", margin.alias("m0"), F.col("prediction").cast("int").alias("svm_pred"))
    out = cal.transform(VectorAssembler(inputCols=["m0"], outputCol="features").transform(scored))
    return out.select("id", vector_to_array("probability")[1].alias("score"),
                      F.col("svm_pred").alias("prediction")), svm


def _knn_fit_score(train, test, cols, params, n_train):
    vec = F.array(*[qcol(c).cast("double") for c in cols]).alias("vec")
    # a drawn row is a row of its own: (draw, id) is unique where the id is not
    ref = train.select(F.col("row_key").alias("id"), vec, "target")
    q = test.select("id", vec)
    return knn_scores(q, ref, int(params.get("n_neighbors", 5)), str(params.get("weights", "uniform"))), None


def _nb_fit_score(train, test, cols, params, n_train):
    tr = L.wide_to_long(train, "id", cols, ["target"])
    te = L.wide_to_long(test, "id", cols)
    return L.gaussian_nb_score(te, L.gaussian_nb_fit(tr, float(params.get("var_smoothing", 1e-9)))), None


# ---------------------------------------------------------------- all folds and candidates together
def _logistic_all(train: BT.Rows, keys: Sequence[BT.ModelKey], candidates: Sequence[dict]) -> BT.Fitted:
    return BT.fit_logistic(train, keys, [(float(p.get("C", 1.0)), float(p.get("l1_ratio", 0.0))) for p in candidates])


def _bayes_all(train: BT.Rows, keys: Sequence[BT.ModelKey], candidates: Sequence[dict]) -> BT.Fitted:
    return BT.fit_bayes(train, keys, [float(p.get("var_smoothing", 1e-9)) for p in candidates])


def _svm_feature(params: Mapping) -> BT.Feature:
    kernel = str(params.get("kernel", "rbf"))
    if kernel == "linear":
        return BT.Feature()
    if kernel != "rbf":
        raise ValueError(f"unsupported kernel {kernel!r}; use rbf or linear")
    return BT.Feature(float(params.get("gamma", 0.1)), int(params.get("rff_features", RFF_FEATURES)), TUNING_SEED)


def _svm_all(train: BT.Rows, keys: Sequence[BT.ModelKey], candidates: Sequence[dict]) -> BT.Fitted:
    steps = max((int(p.get("max_iter", SVM_MAX_ITER)) for p in candidates), default=SVM_MAX_ITER)
    return BT.fit_hinge(train, keys, [(float(p.get("C", 1.0)), _svm_feature(p)) for p in candidates], max_steps=steps)


def _logit(margin: Column) -> Column:
    """Probability of log odds; a margin that could not be computed gives none."""
    return F.when(~F.isnan(margin), 1.0 / (1.0 + F.exp(-margin)))


def calibration(margins: DataFrame) -> dict[int, tuple[float, float]]:
    """Platt's sigmoid per fold from (fold, label, margin) of rows that the margins' models did not see: {fold: (slope, offset)}.

    Targets are smoothed by the class sizes, so that separable margins have a finite fit.
    """
    sizes = {(r["fold"], int(r["label"])): r["count"] for r in margins.groupBy("fold", "label").count().collect()}
    folds = sorted({f for f, _ in sizes})
    if not folds:
        return {}
    aim = F.create_map(*[F.lit(x) for f in folds for x in (
        f, (sizes.get((f, 1), 0) + 1.0) / (sizes.get((f, 1), 0) + 2.0))])
    low = F.create_map(*[F.lit(x) for f in folds for x in (f, 1.0 / (sizes.get((f, 0), 0) + 2.0))])
    target = F.when(F.col("label") == 1, aim[F.col("fold")]).otherwise(low[F.col("fold")])
    rows = BT.own_rows(margins.select("fold", F.lit(-1).alias("inner"), target.alias("label"), F.array("margin").alias("x")), 1)
    fitted = BT.fit_logistic(rows, [BT.ModelKey(f, 0) for f in folds], [(math.inf, 0.0)])
    return {f: (float(fitted.of(f, 0)[0]), float(fitted.of(f, 0)[1])) for f in folds}


LEARNERS: dict[str, Learner] = {
    G.LOGISTIC: Learner(G.LOGISTIC, _spark_ml(_logistic), {"penalty": "l2", "solver": "newton"}, fit_all=_logistic_all),
    G.ELASTIC_NET: Learner(G.ELASTIC_NET, _spark_ml(_logistic), {"penalty": "elasticnet", "solver": "proximal newton"},
                           fit_all=_logistic_all),
    G.RANDOM_FOREST: Learner(G.RANDOM_FOREST, _spark_ml(_forest), unused=("min_samples_split",), stop=_forest_stop),
    G.GRADIENT_BOOSTING: Learner(G.GRADIENT_BOOSTING, _spark_ml(_boosting), {"loss": "log_loss"},
                                  stop=_boosting_stop("n_estimators", "max_depth", 3)),
    G.XGBOOST: Learner(G.XGBOOST, _spark_ml(_xgb_preset), {"implementation": "GBTClassifier preset"},
                       stop=_boosting_stop("n_estimators", "max_depth", 6)),
    G.LIGHTGBM: Learner(G.LIGHTGBM, _spark_ml(_lgbm_preset), {"implementation": "GBTClassifier preset"}),
    G.CATBOOST: Learner(G.CATBOOST, _spark_ml(_catboost_preset), {"implementation": "GBTClassifier preset"},
                        ("l2_leaf_reg",), stop=_boosting_stop("iterations", "depth", 6)),
    G.SVM: Learner(G.SVM, _svm_fit_score, {"implementation": "random Fourier features + hinge loss (approximation)"},
                   fit_all=_svm_all, calibrated=True),
    G.KNN: Learner(G.KNN, _knn_fit_score, {"metric": "minkowski"}),
    G.NAIVE_BAYES: Learner(G.NAIVE_BAYES, _nb_fit_score, fit_all=_bayes_all),
}


# ---------------------------------------------------------------- search
@dataclass
class FoldPlan:
    cohort: Cohort          # with a "fold" column
    k: int
    preps: dict[int, Preparation]
    types: FeatureTypes | None = None
    by_strategy: dict = field(default_factory=dict)

    def preps_for(self, strategy: str) -> dict[int, Preparation]:
        if strategy == "median":
            return self.preps
        if strategy not in self.by_strategy:
            self.by_strategy[strategy] = fit_fold_preparations(self.cohort, "fold", self.k, self.types, strategy)
        return self.by_strategy[strategy]

    def tree_rows(self) -> tuple:
        """Rows as bytes for tree fits, written once, and the columns' cut points."""
        if "trees" not in self.by_strategy:
            c = self.cohort
            self.by_strategy["trees"] = T.plan_chunks(c.df, c.id_col, c.target_col, self.preps[0].output_cols)
        return self.by_strategy["trees"]

    def nested(self, inner_k: int) -> Cohort:
        """The cohort with an ``inner`` fold per row beside ``fold``, stratified by the target, written once."""
        if inner_k not in self.by_strategy:
            c = self.cohort
            apart = c.df.withColumnRenamed("fold", "_outer")
            both = FO.stratified_folds(apart, c.id_col, c.target_col, inner_k, INNER_SEED, fold_col="inner")
            self.by_strategy[inner_k] = c.with_df(spread(both.withColumnRenamed("_outer", "fold"), "folds"))
        return self.by_strategy[inner_k]


def fold_plan(cohort: Cohort, k: int, seed: int, types: FeatureTypes) -> FoldPlan:
    # written once in the shared folder: every fit of the search reads it
    df = spread(FO.stratified_folds(cohort.df, cohort.id_col, cohort.target_col, k, seed), "folds")
    c = cohort.with_df(df)
    return FoldPlan(c, k, fit_fold_preparations(c, "fold", k, types), types)


def _fold_data(plan: FoldPlan, f: int, balance: str | None, strategy: str = "median"):
    c = plan.cohort
    prep = plan.preps_for(strategy)[f]
    cols = list(prep.output_cols)
    base = c.df.withColumnRenamed(c.id_col, "id").withColumnRenamed(c.target_col, "target")
    train = prep.transform(base.where(F.col("fold") != f), "id", ["target"])
    test = prep.transform(base.where(F.col("fold") == f), "id", ["target"])
    if balance:
        tc = Cohort(train, "id", "target", tuple(cols))
        drawn = B.random_oversample(tc) if balance == "oversample" else B.smote(tc, cols)
        base_id = F.coalesce("id", "base_id") if "base_id" in drawn.columns else F.col("id")
        drawn = drawn.select("id", "target", *[qcol(c) for c in cols], F.struct("draw", base_id.alias("id")).alias("row_key"))
        # every candidate reads the balanced rows: written once, not drawn again for each
        path = scratch_path(c.df.sparkSession, "balanced")
        drawn.write.parquet(path)
        train = c.df.sparkSession.read.parquet(path)
    else:
        train = train.withColumn("row_key", F.struct(F.lit(-1).cast("bigint").alias("draw"), F.col("id").alias("id")))
    return train, test, cols


CALIBRATION_FOLDS = 5


def _balanced_rows(plan: FoldPlan, balance: str, strategy: str, inner_k: int = 0) -> BT.Rows:
    """Balanced training rows of all folds; copies and offspring of a row share its inner fold."""
    parts = None
    for f in range(plan.k):
        train, _, cols = _fold_data(plan, f, balance, strategy)
        inner = F.pmod(F.xxhash64("row_key.id"), F.lit(inner_k)).cast("int") if inner_k else F.lit(-1)
        part = train.select(F.lit(f).alias("fold"), inner.alias("inner"), F.col("target").cast("double").alias("label"),
                            F.array(*[qcol(c).cast("double") for c in cols]).alias("x"))
        parts = part if parts is None else parts.unionByName(part)
    return BT.own_rows(parts, len(cols))


def _run_all(plan: FoldPlan, learner: Learner, candidates: Sequence[dict], balance: str | None,
             tag: Callable[[int], str], final: bool) -> DataFrame:
    """All folds and candidates of a learner in the passes of one batched fit (per imputer strategy)."""
    spark, c = plan.cohort.df.sparkSession, plan.cohort
    root = scratch_path(spark, "scores")
    for strategy in sorted({str(p.get(IMPUTER_KEY) or "median") for p in candidates}):
        places = [ci for ci, p in enumerate(candidates) if str(p.get(IMPUTER_KEY) or "median") == strategy]
        some = [{key: v for key, v in candidates[ci].items() if "__" not in key} for ci in places]
        preps = {(f, -1): prep for f, prep in plan.preps_for(strategy).items()}
        calibrate = final and learner.calibrated
        inner_k = CALIBRATION_FOLDS if calibrate else 0
        source = plan.nested(inner_k).df if calibrate else c.df
        rows = BT.raw_rows(source, preps, c.target_col, inner=F.col("inner") if calibrate else None,
                           keep=[qcol(c.id_col).alias("id")])
        train = _balanced_rows(plan, balance, strategy, inner_k) if balance else rows
        keys = [BT.ModelKey(f, i) for f in range(plan.k) for i in range(len(some))]
        if calibrate:  # the chosen candidate: its models without inner folds are fitted in the same passes
            keys += [BT.ModelKey(f, 0, g) for f in range(plan.k) for g in range(inner_k)]
        fitted = learner.fit_all(train, keys, some)
        found = BT.margins(rows, fitted.part(False))
        names = F.create_map(*[x for i, ci in enumerate(places) for x in (F.lit(i), F.lit(tag(ci)))])
        score = _logit(F.col("margin"))
        if learner.calibrated and not calibrate:
            score = F.col("margin")  # the order is all that a ranking needs
        elif calibrate:
            unseen = BT.margins(rows, fitted.part(True), inner=True).select("fold", "label", "margin")
            path = scratch_path(spark, "margins")
            unseen.write.parquet(path)
            curves = calibration(spark.read.parquet(path))
            slope, offset = (F.create_map(*[F.lit(x) for f, ab in curves.items() for x in (f, ab[k])])[F.col("fold")] for k in (0, 1))
            score = _logit(slope * F.col("margin") + offset)
        found.select(names[F.col("candidate")].alias("model"), "fold", "id", F.col("label").cast("int").alias("label"),
                     score.alias("score"), (~F.isnan("margin") & (F.col("margin") > 0)).cast("int").alias("prediction")
                     ).write.parquet(f"{root}/job={places[0]}")
    return spark.read.parquet(root).drop("job")


def _fold_view(prep: Preparation) -> FoldView:
    """A fold's preparation as arrays, one number per output column."""
    fill = [prep.fill.get(c) for c in prep.output_cols]
    return FoldView(np.array([np.nan if v is None else v for v in fill], float),
                    np.array([prep.mean.get(c, 0.0) for c in prep.output_cols], float),
                    np.array([prep.scale[c] if c in prep.mean else 1.0 for c in prep.output_cols], float))


def _run_knn(plan: FoldPlan, learner: Learner, candidates: Sequence[dict], balance: str | None,
             tag: Callable[[int], str]) -> DataFrame:
    """All folds, numbers of neighbours and weightings from one join (per imputer strategy) at the largest number."""
    spark = plan.cohort.df.sparkSession
    root = scratch_path(spark, "scores")
    for strategy in sorted({str(p.get(IMPUTER_KEY) or "median") for p in candidates}):
        places = [ci for ci, p in enumerate(candidates) if str(p.get(IMPUTER_KEY) or "median") == strategy]
        wanted = [(int(candidates[ci].get("n_neighbors", 5)), str(candidates[ci].get("weights", "uniform"))) for ci in places]
        names = F.create_map(*[x for i, ci in enumerate(places) for x in (F.lit(i), F.lit(tag(ci)))])
        if not balance:  # a row is a reference of every other fold: stored once, prepared for a fold where it is compared
            c, preps = plan.cohort, plan.preps_for(strategy)
            rows = c.df.select(qcol(c.id_col).alias("id"), F.array(*[qcol(x).cast("double") for x in preps[0].output_cols]).alias("vec"),
                               "fold", qcol(c.target_col).cast("int").alias("label"))
            voted = votes_out_of_folds(rows, wanted, "label", views={f: _fold_view(prep) for f, prep in preps.items()}, keep="label")
            (voted.where(F.col("id").isNotNull()).select(names[F.col("candidate")].alias("model"), F.col("grp").alias("fold"), "id", "label",
                                                         "score", "prediction").write.parquet(f"{root}/job={places[0]}"))
            continue
        queries = ref = None
        for f in range(plan.k):
            train, test, cols = _fold_data(plan, f, balance, strategy)
            vec, at = F.array(*[qcol(c).cast("double") for c in cols]).alias("vec"), F.lit(f).alias("fold")
            # a drawn row is a row of its own: (draw, id) is unique where the id is not
            own = F.col("row_key").alias("id")
            q, r = test.select(at, "id", vec, "target"), train.select(at, own, vec, "target")
            queries, ref = (q, r) if queries is None else (queries.unionByName(q), ref.unionByName(r))
        path = scratch_path(spark, "queries")
        queries.write.parquet(path)
        queries = spark.read.parquet(path)
        votes = knn_votes(queries, ref, wanted, group="fold")
        labels = queries.select(F.col("fold").alias("grp"), F.col("id").alias("_id"), F.col("target").alias("label"))
        (votes.join(labels, (votes["grp"] == labels["grp"]) & (votes["id"] == labels["_id"]))
         .select(names[F.col("candidate")].alias("model"), votes["grp"].cast("int").alias("fold"), "id",
                 F.col("label").cast("int").alias("label"), "score", "prediction").write.parquet(f"{root}/job={places[0]}"))
    return spark.read.parquet(root).drop("job")


def _run_trees(plan: FoldPlan, learner: Learner, candidates: Sequence[dict], tag: Callable[[int], str]) -> DataFrame:
    """All folds and candidates of a tree learner; those that differ in where they stop share a growth."""
    spark = plan.cohort.df.sparkSession
    root = scratch_path(spark, "scores")
    chunks, cuts = plan.tree_rows()
    names = F.create_map(*[x for i in range(len(candidates)) for x in (F.lit(i), F.lit(tag(i)))])
    for strategy in sorted({str(p.get(IMPUTER_KEY) or "median") for p in candidates}):
        stops = {ci: learner.stop({key: v for key, v in p.items() if "__" not in key}) for ci, p in enumerate(candidates)
                 if str(p.get(IMPUTER_KEY) or "median") == strategy}
        fills = {f: [prep.fill.get(c) for c in prep.output_cols] for f, prep in plan.preps_for(strategy).items()}
        found = T.out_of_fold(chunks, cuts, fills, stops, range(plan.k))
        # the plan's k tests are all of its rows; a missing ID has never had a score
        found.where(F.col("id").isNotNull()).select(names[F.col("candidate")].alias("model"), "fold", "id", "label", "score",
                                                    "prediction").write.parquet(f"{root}/job={min(stops)}")
    return spark.read.parquet(root).drop("job")


def _run(plan: FoldPlan, learner: Learner, candidates: Sequence[dict], balance: str | None, parallelism: int,
         tag: Callable[[int], str], final: bool = True) -> DataFrame:
    """Out-of-fold scores of all candidates; ``final`` False: for ranking only, scores need not be probabilities."""
    if learner.fit_all:
        return _run_all(plan, learner, candidates, balance, tag, final)
    if learner.name == G.KNN:
        return _run_knn(plan, learner, candidates, balance, tag)
    if learner.stop and not balance and plan.cohort.df.count() * len(plan.preps[0].output_cols) <= T.HELD_CELLS:
        return _run_trees(plan, learner, candidates, tag)
    jobs = []
    data = {}
    strategies = sorted({str(p.get(IMPUTER_KEY) or "median") for p in candidates})
    for strategy in strategies:
        for f in range(plan.k):
            train, test, cols = _fold_data(plan, f, balance, strategy)
            data[(strategy, f)] = (train, test, cols, train.count())
    for f in range(plan.k):
        for ci, params in enumerate(candidates):
            jobs.append((f, ci, params))

    spark = plan.cohort.df.sparkSession
    root = scratch_path(spark, "scores")

    def one(job):
        f, ci, params = job
        train, test, cols, n_train = data[(str(params.get(IMPUTER_KEY) or "median"), f)]
        learner_params = {key: v for key, v in params.items() if "__" not in key}
        scores, _ = learner.fit_score(train, test, cols, learner_params, n_train)
        out = scores.join(test.select("id", F.col("target").alias("label")), "id").select(
            F.lit(tag(ci)).alias("model"), F.lit(f).cast("int").alias("fold"), "id", "label", "score",
            "prediction")
        # every fit writes its own sub-folder of one table in the shared folder: the search
        # result is then one scan, however many candidates and folds there are
        out.write.mode("overwrite").parquet(f"{root}/job={ci * plan.k + f}")
        return job

    largest = max(n_train for *_, n_train in data.values())
    with ThreadPoolExecutor(max_workers=fits_at_once(largest, parallelism, spark.sparkContext.defaultParallelism)) as pool:
        list(pool.map(one, jobs))
    return spark.read.parquet(root).drop("job")


def fits_at_once(n_train: int, parallelism: int, cores: int) -> int:
    """Fits that run side by side: ``parallelism`` of small ones; of large ones only as many as keep their rows in memory.

    A large fit occupies every core by itself, and rows that do not fit are written and read again in each of its passes.
    """
    return max(1, min(parallelism, HELD_ROWS * cores // max(1, n_train)))


def out_of_fold(plan: FoldPlan, learner: Learner, candidates: Sequence[dict], tag: Callable[[int], str],
                balance: str | None = None, parallelism: int = 4) -> DataFrame:
    """(model, fold, id, label, score, prediction): every row scored, for every candidate, by a fit without its fold."""
    return _run(plan, learner, candidates, balance, parallelism, tag)


def grid_rank(fold_auc: DataFrame) -> DataFrame:
    """(candidate, mean_auc, rank): best mean fold AUC first; ties keep grid order."""
    per = fold_auc.groupBy("candidate").agg(F.avg("auc").alias("mean_auc"))
    from .topk import top_k_per_group
    n = per.count()
    return top_k_per_group(per.fillna({"mean_auc": -1.0}), [], [F.col("mean_auc").desc(), F.col("candidate")],
                           max(1, n), "rank")


@dataclass
class ModelResult:
    name: str
    best_params: dict
    hyperparameters: dict
    scores: DataFrame       # long out-of-fold score table of the evaluation plan
    candidates: DataFrame   # grid_rank output
    status: str | None = None


class SearchContext:
    """What every model of one training request shares: the materialized cohort, feature kinds,
    k and the two fold plans (built on first use)."""

    def __init__(self, cohort: Cohort, k: int | None = None):
        cohort.require_features()
        # the cohort is read by every fit: materialize it once (lineage cut, shared folder)
        self.cohort = cohort.with_df(spread(cohort.df, "cohort"))
        self.k = k or FO.resolve_fold_count(self.cohort.df, self.cohort.target_col)
        self.types = split_feature_types(self.cohort)
        self.n_rows = self.cohort.df.count()
        self._plans: dict[int, FoldPlan] = {}

    def plan(self, seed: int) -> FoldPlan:
        if seed not in self._plans:
            self._plans[seed] = fold_plan(self.cohort, self.k, seed, self.types)
        return self._plans[seed]


def train_model(cohort: Cohort | SearchContext, model: str, mode: str = "light", custom: Mapping | None = None,
                balance: str | None = None, parallelism: int = 4, svm_flexibility: str = "Medium (Balanced)",
                k: int | None = None) -> ModelResult:
    """Search the grid on the tuning folds, then evaluate the best candidate on the evaluation folds."""
    ctx = cohort if isinstance(cohort, SearchContext) else SearchContext(cohort, k)
    learner = LEARNERS[model]
    grid = G.select_grid(model, mode, custom, ctx.n_rows, svm_flexibility)
    candidates = learner.distinct(G.expand_grid(grid))
    spark = ctx.cohort.df.sparkSession
    if len(candidates) > 1:
        tuned = _run(ctx.plan(TUNING_SEED), learner, candidates, balance, parallelism, lambda ci: str(ci), False)
        fold_auc = E.auc_exact(tuned, pooled=False).select(
            F.col("model").cast("int").alias("candidate"), "fold", "auc")
        ranked = grid_rank(fold_auc)
        best = ranked.where(F.col("rank") == 1).first()["candidate"]
    else:
        # one candidate: nothing to choose, the tuning folds are not needed
        ranked = spark.createDataFrame([(0, None, 1)], "candidate int, mean_auc double, rank int")
        best = 0
    params = candidates[best]
    scores = _run(ctx.plan(EVALUATION_SEED), learner, [params], balance, parallelism, lambda ci: model)
    hyper = {**{key: v for key, v in params.items()}, **learner.fixed}
    return ModelResult(model, params, hyper, scores, ranked)


def feature_importance(cohort: Cohort, params: dict, model: str = G.RANDOM_FOREST) -> DataFrame:
    """(feature, importance) of a tree model refitted on all rows (prepared on all rows)."""
    from .prep import fit_preparation

    types = split_feature_types(cohort)
    prep = fit_preparation(cohort, types)
    base = cohort.df.withColumnRenamed(cohort.id_col, "id").withColumnRenamed(cohort.target_col, "target")
    data = prep.transform(base, "id", ["target"])
    cols = list(prep.output_cols)
    make = {G.RANDOM_FOREST: _forest, G.GRADIENT_BOOSTING: _boosting, G.XGBOOST: _xgb_preset,
            G.LIGHTGBM: _lgbm_preset, G.CATBOOST: _catboost_preset}[model]
    fitted = make(params, 1).fit(_assembled(data, cols).withColumnRenamed("target", "label"))
    imp = fitted.featureImportances.toArray()
    spark = cohort.df.sparkSession
    return spark.createDataFrame([(i, c, float(imp[i])) for i, c in enumerate(cols)],
                                 "pos int, feature string, importance double")


STACKING_FOLDS = 5


def _meta_fit_score(train: DataFrame, test: DataFrame, cols: Sequence[str], c: float) -> DataFrame:
    """Logistic meta-model on base scores: (id, score, prediction) of ``test``."""
    n = train.count()
    model = LogisticRegression(regParam=1.0 / (c * n), standardization=False).fit(_assembled(train, cols))
    out = model.transform(_assembled(test, cols))
    return out.select("id", vector_to_array("probability")[1].alias("score"), F.col("prediction").cast("int").alias("prediction"))


def _stacked_rows(parts: Sequence[DataFrame]) -> DataFrame:
    """Margins of the bases (id, inner_of, fold, label, margin) as one row of scores per fold and id: own rows of ``batched``."""
    every = None
    for i, part in enumerate(parts):
        one = part.select("id", "inner_of", "fold", "label", F.lit(i).alias("base"), _logit(F.col("margin")).alias("score"))
        every = one if every is None else every.unionByName(one)
    scores = [F.max(F.when(F.col("base") == i, F.col("score"))) for i in range(len(parts))]
    return every.groupBy("fold", "id").agg(F.first("inner_of").alias("inner"), F.first("label").alias("label"), F.array(*scores).alias("x")
                                           ).select("fold", "inner", "label", "x", "id")


def _nested_stacking(ctx: SearchContext, bases: Sequence[tuple[str, dict]], cs: Sequence[float], balance: str | None,
                     inner_k: int) -> tuple[DataFrame, dict[float, int]]:
    """(out-of-fold scores, folds won per C): outer and inner folds of all bases as data, a few batched fits in all."""
    plan = ctx.plan(EVALUATION_SEED)
    spark, c = plan.cohort.df.sparkSession, plan.nested(inner_k)
    folds, inner = range(plan.k), range(inner_k)
    pairs = [(f, -1) for f in folds] + [(f, g) for f in folds for g in inner]
    by_strategy, unseen, seen = {}, [], []
    for name, params in bases:
        strategy = str(params.get(IMPUTER_KEY) or "median")
        if strategy not in by_strategy:
            preps = fit_preparations(c, pairs, plan.types, strategy, "fold", "inner")
            by_strategy[strategy] = BT.raw_rows(c.df, preps, c.target_col, inner=F.col("inner"),
                                                keep=[qcol(c.id_col).alias("id"), F.col("inner").alias("inner_of")])
        rows = by_strategy[strategy]
        train = _balanced_rows(plan, balance, strategy, inner_k) if balance else rows
        own = {key: v for key, v in params.items() if "__" not in key}
        fit_all = LEARNERS[name].fit_all
        unseen.append(BT.margins(rows, fit_all(train, [BT.ModelKey(f, 0, g) for f in folds for g in inner], [own]), inner=True))
        seen.append(BT.margins(rows, fit_all(train, [BT.ModelKey(f, 0) for f in folds], [own])))
    path = scratch_path(spark, "stacking")
    _stacked_rows(unseen).write.parquet(path)
    meta = BT.own_rows(spark.read.parquet(path), len(bases))
    best = dict.fromkeys(folds, 0)
    if len(cs) > 1:
        keys = [BT.ModelKey(f, i, g) for f in folds for i in range(len(cs)) for g in inner]
        kept = BT.own_rows(meta.frame.select("fold", "inner", "label", "x", F.col("inner").alias("held")), len(bases))
        tried = BT.margins(kept, BT.fit_logistic(meta, keys, [(x, 0.0) for x in cs]), inner=True)
        auc = E.auc_exact(tried.select(F.concat_ws(":", "fold", "candidate").alias("model"), F.col("held").alias("fold"),
                                       "label", F.col("margin").alias("score")), pooled=False)
        mean = {r["model"]: r["a"] for r in auc.groupBy("model").agg(F.avg("auc").alias("a")).collect()}  # folds x C
        for f in folds:
            best[f] = max(range(len(cs)), key=lambda i, f=f: (mean.get(f"{f}:{i}") or -1.0, -i))
    final = BT.fit_logistic(meta, [BT.ModelKey(f, best[f]) for f in folds], [(x, 0.0) for x in cs])
    outer = BT.own_rows(_stacked_rows(seen), len(bases))
    scored = BT.margins(outer, final).select("id", "fold", F.col("label").cast("int").alias("label"),
                                             _logit(F.col("margin")).alias("score"), (F.col("margin") > 0).cast("int").alias("prediction"))
    path = scratch_path(spark, "stacking")
    scored.select(F.lit(G.STACKING).alias("model"), "fold", "id", "label", "score", "prediction").write.parquet(path)
    votes = {x: sum(best[f] == i for f in folds) for i, x in enumerate(cs)}
    return spark.read.parquet(path), votes


def _wide_scores(scores: Sequence[DataFrame]) -> DataFrame:
    """One row per id: label, fold and the score of every base (b0, b1, ...)."""
    wide = None
    for i, s in enumerate(scores):
        part = s.select("fold", "id", "label", F.col("score").alias(f"b{i}"))
        wide = part if wide is None else wide.join(part.drop("label", "fold"), "id")
    return wide


def train_stacking(ctx: SearchContext, bases: Sequence[tuple[str, dict]], cs: Sequence[float] = (0.5, 1.0),
                   balance: str | None = None, parallelism: int = 4) -> ModelResult:
    """Stacking: a logistic meta-model on the positive-class scores of two or more trained bases.

    For each evaluation fold, inner folds (``min(5, k)``) of its training rows
    alone give the bases' out-of-fold scores; the meta-model's ``C`` is chosen by
    cross-fitting on them, the meta-model is fitted on all of them, and it scores
    the fold's rows from bases fitted on the training rows.  No row of a fold
    reaches a fit that scores it.  Where all bases can be fitted together, so
    are all outer and inner folds (an SVM enters by the logistic of its margin);
    else the outer folds run one after the other.
    """
    if len(bases) < 2:
        raise ValueError(STACKING_STATUS)
    if all(LEARNERS[name].fit_all for name, _ in bases):
        scores, votes = _nested_stacking(ctx, bases, [float(c) for c in cs], balance, min(STACKING_FOLDS, ctx.k))
        return _stacking_result(ctx, bases, cs, scores, votes)
    plan = ctx.plan(EVALUATION_SEED)
    spark = plan.cohort.df.sparkSession
    cols = [f"b{i}" for i in range(len(bases))]
    inner_k = min(STACKING_FOLDS, ctx.k)
    root = scratch_path(spark, "stacking")
    votes: dict[float, float] = {}
    cs = [float(c) for c in cs]
    for f in range(plan.k):
        sub = plan.cohort.with_df(plan.cohort.df.where(F.col("fold") != f).drop("fold"))
        inner = fold_plan(sub, inner_k, TUNING_SEED, plan.types)
        wide = _wide_scores([_run(inner, LEARNERS[name], [params], balance, parallelism, lambda ci, name=name: name)
                             for name, params in bases]).checkpoint(eager=True)
        tried = []
        for g in range(inner_k if len(cs) > 1 else 0):
            fit, held = wide.where(F.col("fold") != g), wide.where(F.col("fold") == g)
            for c in cs:
                scored = _meta_fit_score(fit, held, cols, c).join(held.select("id", "label"), "id")
                tried.append(scored.select(F.lit(str(c)).alias("model"), F.lit(g).alias("fold"), "id", "label", "score",
                                           "prediction"))
        best = cs[0]
        if tried:
            both = tried[0]
            for t in tried[1:]:
                both = both.unionByName(t)
            ranked = grid_rank(E.auc_exact(both, pooled=False).select(
                F.col("model").cast("double").alias("candidate"), "fold", "auc"))
            best = ranked.where(F.col("rank") == 1).first()["candidate"]
        votes[best] = votes.get(best, 0) + 1
        train, test, features = _fold_data(plan, f, balance)
        n_train = train.count()
        parts = []
        for name, params in bases:
            learner_params = {key: v for key, v in params.items() if "__" not in key}
            scores, _ = LEARNERS[name].fit_score(train, test, features, learner_params, n_train)
            parts.append(scores.select("id", "score").join(test.select("id", F.col("target").alias("label")), "id")
                         .withColumn("fold", F.lit(f).cast("int")))
        outer = _wide_scores(parts)
        out = _meta_fit_score(wide, outer, cols, best).join(outer.select("id", "label", "fold"), "id")
        out.select(F.lit(G.STACKING).alias("model"), "fold", "id", "label", "score", "prediction").write.parquet(f"{root}/job={f}")
    scores = spark.read.parquet(root).drop("job")
    return _stacking_result(ctx, bases, cs, scores, votes)


def _stacking_result(ctx: SearchContext, bases: Sequence[tuple[str, dict]], cs: Sequence[float], scores: DataFrame,
                     votes: Mapping[float, float]) -> ModelResult:
    params = {"final_estimator__C": max(votes, key=lambda c: (votes[c], -c))}
    names = ", ".join(n for n, _ in G.collect_bases([b for b, _ in bases], dict(bases)))
    won = [(float(c), int(votes.get(c, 0))) for c in cs]
    return ModelResult(G.STACKING, params, {**params, "estimators": names}, scores,
                       ctx.cohort.df.sparkSession.createDataFrame(won, "candidate double, folds_won int"))


# ---------------------------------------------------------------- fixed values: status texts
VOTING_STATUS = "Voting Classifier requires at least two trained supervised models."
STACKING_STATUS = "Stacking Classifier requires at least two trained supervised models."
# ---------------------------------------------------------------- end of fixed values


def train_voting(ctx: SearchContext, results: Sequence[ModelResult]) -> ModelResult:
    """Soft voting over the out-of-fold scores of two or more trained bases (hard where one has no scores)."""
    if len(results) < 2:
        raise ValueError(VOTING_STATUS)
    names = [r.name for r in results]
    rows = results[0].scores
    for r in results[1:]:
        rows = rows.unionByName(r.scores)
    hard = rows.where(F.col("score").isNull()).limit(1).count() > 0
    voted = L.voting_hard(rows, names) if hard else L.voting_soft(rows, names)
    scores = voted.select(F.lit(G.VOTING).alias("model"), "fold", "id", "label", "score", "prediction")
    kind = {"voting": "hard" if hard else "soft", "weights": None}
    return ModelResult(G.VOTING, {"weights": None}, kind, scores, results[0].candidates.limit(0))


def train_models(cohort: Cohort | SearchContext, requested: Sequence[str], mode: str = "light",
                 custom: Mapping | None = None, balance: str | None = None, parallelism: int = 4,
                 svm_flexibility: str = "Medium (Balanced)", k: int | None = None) -> list[ModelResult]:
    """One result per different requested model, in request order, K-Means last.

    Ensembles use the requested bases that could be trained.  A model that
    cannot be trained keeps a result without scores, with ``status`` saying why.
    """
    ctx = cohort if isinstance(cohort, SearchContext) else SearchContext(cohort, k)
    kinds = G.filter_models(list(dict.fromkeys(requested)))
    spark = ctx.cohort.df.sparkSession
    done: dict[str, ModelResult] = {}

    def attempt(name: str, train: Callable[[], ModelResult]) -> None:
        try:
            done[name] = train()
        except ValueError as problem:  # a request that cannot be met, not a failed job
            empty = spark.createDataFrame([], "model string, fold int, id bigint, label int, score double, prediction int")
            done[name] = ModelResult(name, {}, {}, empty, empty, status=str(problem))

    for name in kinds["base"]:
        attempt(name, lambda name=name: train_model(ctx, name, mode, custom, balance, parallelism, svm_flexibility))
    bases = [r for r in done.values() if r.status is None]
    for name in kinds["ensemble"]:
        if name == G.VOTING:
            attempt(name, lambda: train_voting(ctx, bases))
        else:
            cs = G.select_grid(name, mode, custom).get("final_estimator__C", [1.0])
            attempt(name, lambda cs=cs: train_stacking(ctx, [(r.name, r.best_params) for r in bases], cs, balance, parallelism))
    for name in kinds["clustering"]:
        from .clustering import cluster_request

        attempt(name, lambda name=name: cluster_request(ctx.cohort, parallelism))
    wanted = [n for n in dict.fromkeys(requested) if n not in kinds["clustering"]] + kinds["clustering"]
    return [done[n] for n in wanted]
