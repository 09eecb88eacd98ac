"""Trees grown in tasks: equal to Spark ML fits and to fits of their own, whole grids, leaks."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array

from strata.cohort import Cohort
from strata.operators import grids as G
from strata.operators import search as S
from strata.operators import trees as T
from strata.plans import search_queries as Q


def table(n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 20, n), rng.integers(0, 30, n), rng.integers(0, 2, n)]).astype(float)
    y = (x[0] + 6 * x[2] + rng.normal(0, 4, n) > 12).astype(int)
    return x, y


def cohort(spark, n=240):
    x, y = table(n)
    rows = [(i, None if i % 11 == 0 else float(x[0, i]), float(x[1, i]), float(x[2, i]), int(y[i])) for i in range(n)]
    return Cohort.from_frame(spark.createDataFrame(rows, "id long, a double, b double, c double, target int"))


def as_bytes(x):
    cuts = [T.cut_points(v) for v in x]
    return np.stack([np.searchsorted(c, v, side="left").astype(np.uint8) for c, v in zip(cuts, x)])


@pytest.mark.parametrize("depth", [2, 4])
def test_boosting_is_that_of_spark(spark, depth):
    x, y = table()
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame(
        [(i, float(x[0, i]), float(x[1, i]), float(x[2, i]), int(y[i])) for i in range(len(y))], "id long, a double, b double, c double, label int"))
    train = np.arange(len(y)) < 500
    model = GBTClassifier(maxIter=8, stepSize=0.1, maxDepth=depth).fit(df.where("id < 500"))
    want = [r[0] for r in model.transform(df.where("id >= 500")).orderBy("id").select(vector_to_array("probability")[1]).collect()]
    found = T.boosted(as_bytes(x), y.astype(float), train, np.arange(len(y)), T.Growth("boost", depth), [8])[8]
    assert np.allclose(1 / (1 + np.exp(-2 * found)), want, atol=1e-9)


def test_what_stops_earlier_is_read_off_a_longer_growth():
    x, y = table()
    bins, y, key, train = as_bytes(x), y.astype(float), np.arange(len(y)) * 7919, np.arange(len(y)) % 5 > 0
    for growth in (T.Growth("boost", 3), T.Growth("boost", 3, share=0.8, features=0.7)):
        long = T.boosted(bins, y, train, key, growth, [4, 9])
        assert (long[4] == T.boosted(bins, y, train, key, growth, [4])[4]).all() and (long[4] != long[9]).any()
    deep = T.Growth("forest", 12, features=0.0)
    long = T.forest(bins, y, train, key, deep, [3, 6], [2, 12])
    for trees, depth in long:
        alone = T.forest(bins, y, train, key, T.Growth("forest", depth, features=0.0), [trees], [depth])
        assert np.allclose(long[trees, depth], alone[trees, depth])
    assert (long[3, 2] != long[3, 12]).any() and (long[3, 12] != long[6, 12]).any()


def test_a_tree_splits_where_the_squared_error_falls_most():
    rng = np.random.default_rng(5)
    bins, target, weight = rng.integers(0, 6, (3, 80)).astype(np.uint8), rng.normal(size=80), rng.integers(0, 3, 80).astype(float)

    def error(rows):
        w = weight[rows].sum()
        return (weight[rows] * (target[rows] - (weight[rows] * target[rows]).sum() / w) ** 2).sum() if w else np.inf

    j, cut = min(((j, c) for j in range(3) for c in range(5)), key=lambda jc: error(bins[jc[0]] <= jc[1]) + error(bins[jc[0]] > jc[1]))
    left = bins[j] <= cut
    want = np.where(left, np.average(target[left], weights=weight[left]), np.average(target[~left], weights=weight[~left]))
    assert np.allclose(T.grow(bins, target, weight, [0, 1])[1], want)
    assert np.allclose(T.grow(bins, target, weight, [0, 1])[0], np.average(target, weights=weight))


@pytest.mark.parametrize("model, candidates", [(G.CATBOOST, 8), (G.XGBOOST, 16), (G.GRADIENT_BOOSTING, 8), (G.RANDOM_FOREST, 6)])
def test_registered_tree_learners_run_their_whole_light_grid(monkeypatch, model, candidates):
    asked = {}
    monkeypatch.setattr(Q, "context", lambda *a: None)
    monkeypatch.setattr(Q, "_memo", lambda spark, sf, what, make: make())
    monkeypatch.setattr(S, "train_model", lambda ctx, name, **how: asked.update(how, name=name))
    Q.trained(None, None, model)
    grid = G.select_grid(model, asked["mode"], asked["custom"])
    assert grid == G.LIGHT_GRIDS[model] and len(S.LEARNERS[model].distinct(G.expand_grid(grid))) == candidates


@pytest.mark.parametrize("model", [G.CATBOOST, G.XGBOOST, G.GRADIENT_BOOSTING, G.RANDOM_FOREST])
def test_every_candidate_scores_every_row_once(spark, monkeypatch, model):
    small = {"n_estimators": [3, 6], "iterations": [3, 6]}
    grid = {key: small.get(key, v) for key, v in G.LIGHT_GRIDS[model].items()}
    monkeypatch.setitem(G.LIGHT_GRIDS, model, grid)
    monkeypatch.setattr(S.LEARNERS[model], "fit_score", None)  # no fit of its own per candidate and fold
    ctx = S.SearchContext(cohort(spark), 2)
    candidates = S.LEARNERS[model].distinct(G.expand_grid(grid))
    tuned = S.out_of_fold(ctx.plan(S.TUNING_SEED), S.LEARNERS[model], candidates, str)
    rows = tuned.groupBy("model").agg({"id": "count", "fold": "max"}).collect()
    assert len(rows) == len(candidates) and {r["count(id)"] for r in rows} == {240}
    assert tuned.select("model", "id").distinct().count() == 240 * len(candidates)
    result = S.train_model(ctx, model)
    assert result.scores.count() == 240 and result.candidates.count() == len(candidates)
    hits = result.scores.where("prediction = label").count()
    assert hits > 160


def test_labels_of_a_fold_do_not_reach_its_scores(spark):
    from pyspark.sql import functions as F

    plan = S.SearchContext(cohort(spark), 3).plan(S.TUNING_SEED)
    turned = plan.cohort.with_df(plan.cohort.df.withColumn("target", F.when(F.col("fold") == 1, 1 - F.col("target")).otherwise(F.col("target"))))
    for model, params in ((G.GRADIENT_BOOSTING, {"n_estimators": 4}), (G.RANDOM_FOREST, {"n_estimators": 4})):
        one, two = ({r["id"]: r["score"] for r in S.out_of_fold(S.FoldPlan(c, 3, plan.preps, plan.types), S.LEARNERS[model], [params], str)
                     .where("fold = 1").collect()} for c in (plan.cohort, turned))
        assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_large_tables_are_left_to_spark(spark, monkeypatch):
    monkeypatch.setattr(T, "HELD_CELLS", 10)
    monkeypatch.setattr(T, "out_of_fold", lambda *a: 1 / 0)
    ctx = S.SearchContext(cohort(spark, 60), 2)
    assert S.train_model(ctx, G.GRADIENT_BOOSTING, "custom", {G.GRADIENT_BOOSTING: {"n_estimators": ["2"]}}).scores.count() == 60
