"""The chosen candidate refitted on all rows: preparation and model as one value that scores new rows.

``refit`` fits the preparation and the model of a ``ModelResult`` on the whole cohort, ``save`` writes them to a folder
(parameters as one JSON row; the trees as a Spark ML model; the reference rows of KNN as a table) and ``load`` reads them
back, in any session.  ``score`` gives (id, score, prediction) of a table with the same feature columns, with no target.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import qcol
from ..session import scratch_path
from . import batched as BT
from . import grids as G
from . import search as S
from .knn import knn_votes
from .prep import FeatureTypes, Preparation

#: No row is in this fold: its models are fitted on all rows.
ALL = -1
TREES = {G.RANDOM_FOREST: RandomForestClassificationModel, G.GRADIENT_BOOSTING: GBTClassificationModel,
         G.XGBOOST: GBTClassificationModel, G.LIGHTGBM: GBTClassificationModel, G.CATBOOST: GBTClassificationModel}


@dataclass
class FittedModel:
    """``weights``: of a linear model, or a ``Bayes``; ``trees``: a Spark ML model; ``rows``: (id, vec, target) of KNN."""

    name: str
    params: dict
    prep: Preparation
    weights: np.ndarray | BT.Bayes | None = None
    feature: BT.Feature = BT.Feature()
    curve: tuple[float, float] | None = None  # Platt's slope and offset
    trees: object = None
    rows: DataFrame | None = field(default=None, repr=False)

    def score(self, df: DataFrame, id_col: str) -> DataFrame:
        """(id, score, prediction) of every row of ``df``."""
        cols = list(self.prep.output_cols)
        if self.trees is not None:
            ready = S._assembled(self.prep.transform(df.withColumnRenamed(id_col, "id"), "id"), cols)
            return self.trees.transform(ready).select("id", vector_to_array("probability")[1].alias("score"),
                                                      F.col("prediction").cast("int").alias("prediction"))
        if self.rows is not None:
            asked = self.prep.transform(df.withColumnRenamed(id_col, "id"), "id").select("id", F.array(*map(qcol, cols)).alias("vec"))
            wanted = [(int(self.params.get("n_neighbors", 5)), str(self.params.get("weights", "uniform")))]
            return knn_votes(asked, self.rows, wanted).drop("candidate")
        rows = BT.raw_rows(df.withColumns({"_all": F.lit(ALL), "_none": F.lit(0)}), {(ALL, -1): self.prep}, "_none", "_all",
                           keep=[qcol(id_col).alias("id")])
        found = BT.margins(rows, BT.Fitted([BT.ModelKey(ALL, 0)], [self.feature], [self.weights], [True], 0))
        slope, offset = self.curve or (1.0, 0.0)
        return found.select("id", S._logit(F.lit(slope) * F.col("margin") + F.lit(offset)).alias("score"),
                            (~F.isnan("margin") & (F.col("margin") > 0)).cast("int").alias("prediction"))

    def save(self, spark: SparkSession, path: str) -> None:
        w = self.weights
        kept = {"name": self.name, "params": self.params, "continuous": self.prep.types.continuous, "binary": self.prep.types.binary,
                "fill": self.prep.fill, "mean": self.prep.mean, "scale": self.prep.scale, "curve": self.curve,
                "feature": [self.feature.gamma, self.feature.features, self.feature.seed],
                "weights": w.tolist() if isinstance(w, np.ndarray) else None,
                "bayes": [w.mean.tolist(), w.var.tolist(), w.log_prior.tolist()] if isinstance(w, BT.Bayes) else None}
        spark.createDataFrame([(json.dumps(kept),)], "model string").write.text(f"{path}/parameters")
        if self.trees is not None:
            self.trees.save(f"{path}/trees")
        if self.rows is not None:
            self.rows.write.parquet(f"{path}/rows")


def load(spark: SparkSession, path: str) -> FittedModel:
    kept = json.loads(spark.read.text(f"{path}/parameters").first()[0])
    prep = Preparation(FeatureTypes(tuple(kept["continuous"]), tuple(kept["binary"])), kept["fill"], kept["mean"], kept["scale"])
    weights = np.array(kept["weights"]) if kept["weights"] is not None else None
    if kept["bayes"] is not None:
        weights = BT.Bayes(*map(np.array, kept["bayes"]))
    return FittedModel(kept["name"], kept["params"], prep, weights, BT.Feature(*kept["feature"]),
                       tuple(kept["curve"]) if kept["curve"] else None,
                       TREES[kept["name"]].load(f"{path}/trees") if kept["name"] in TREES else None,
                       spark.read.parquet(f"{path}/rows") if kept["name"] == G.KNN else None)


def refit(ctx: S.SearchContext, result: S.ModelResult, balance: str | None = None) -> FittedModel:
    """The best candidate of a search, fitted on all rows of its cohort (balanced, if asked for)."""
    c, spark = ctx.cohort, ctx.cohort.df.sparkSession
    learner = S.LEARNERS.get(result.name)
    if learner is None:
        raise ValueError(f"{result.name} has no fit of its own")
    strategy = str(result.best_params.get(S.IMPUTER_KEY) or "median")
    params = {key: v for key, v in result.best_params.items() if "__" not in key}
    whole = c.with_df(c.df.withColumn("fold", F.lit(0)))
    prep = S.fit_preparations(whole, [(ALL, -1)], ctx.types, strategy)[ALL, -1]
    plan = S.FoldPlan(whole, 1, {ALL: prep}, ctx.types, {strategy: {ALL: prep}})
    train, _, cols = S._fold_data(plan, ALL, balance, strategy)
    if learner.fit_all is None:
        if result.name == G.KNN:
            path = scratch_path(spark, "reference")
            train.select(F.col("row_key" if balance else "id").alias("id"), F.array(*map(qcol, cols)).alias("vec"), "target").write.parquet(path)
            return FittedModel(result.name, params, prep, rows=spark.read.parquet(path))
        _, model = learner.fit_score(train, train.limit(0), cols, params, train.count())
        return FittedModel(result.name, params, prep, trees=model)
    inner_k = S.CALIBRATION_FOLDS if learner.calibrated else 0
    inner = F.pmod(F.xxhash64("row_key.id"), F.lit(inner_k)).cast("int") if inner_k else F.lit(-1)
    # prepared rows that train the models of fold ``ALL``
    rows = BT.own_rows(train.select(F.lit(ALL).alias("fold"), inner.alias("inner"), F.col("target").cast("double").alias("label"),
                                    F.array(*[qcol(x).cast("double") for x in cols]).alias("x")), len(cols))
    fitted = learner.fit_all(rows, [BT.ModelKey(ALL, 0)] + [BT.ModelKey(ALL, 0, g) for g in range(inner_k)], [params])
    curve = None
    if learner.calibrated:
        curve = S.calibration(BT.margins(rows, fitted.part(True), inner=True).select("fold", "label", "margin")).get(ALL)
    return FittedModel(result.name, params, prep, fitted.of(ALL, 0), fitted.part(False).features[0], curve)
