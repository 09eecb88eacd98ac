"""Models refitted on all rows: saved, loaded and scoring new rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.cohort import Cohort
from strata.operators import grids as G
from strata.operators import refit as R
from strata.operators import search as S
from strata.session import scratch_path


@pytest.fixture(scope="module")
def ctx(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (200, 2))
    rows = [(k, None if k % 19 == 0 else float(a), float(b), float(k % 3 == 0), int(a - b + rng.normal(0, 0.5) > 0))
            for k, (a, b) in enumerate(x)]
    return S.SearchContext(Cohort.from_frame(spark.createDataFrame(rows, "id long, a double, b double, c double, target int")), k=2)


@pytest.mark.parametrize("model,params", [
    (G.LOGISTIC, {"C": 1.0}), (G.ELASTIC_NET, {"C": 1.0, "l1_ratio": 0.5}), (G.NAIVE_BAYES, {"var_smoothing": 1e-9}),
    (G.SVM, {"C": 1.0, "gamma": 0.1, "kernel": "rbf", "rff_features": 32}), (G.KNN, {"n_neighbors": 7, "weights": "distance"}),
    (G.RANDOM_FOREST, {"n_estimators": 5, "max_depth": 3}), (G.GRADIENT_BOOSTING, {"n_estimators": 3, "max_depth": 2})])
def test_saved_models_score_as_before(spark, ctx, model, params):
    fitted = R.refit(ctx, S.ModelResult(model, params, {}, None, None))
    path = scratch_path(spark, "model")
    fitted.save(spark, path)
    new = spark.createDataFrame([(900 + k, None if k % 4 == 0 else k / 5 - 2, 1 - k / 9, float(k % 2)) for k in range(20)],
                                "key long, a double, b double, c double")
    before = {r["id"]: (r["score"], r["prediction"]) for r in fitted.score(new, "key").collect()}
    after = {r["id"]: (r["score"], r["prediction"]) for r in R.load(spark, path).score(new, "key").collect()}
    assert set(before) == set(range(900, 920)) and before == after
    # the model has learned from the cohort: most of its own rows come out right
    own = fitted.score(ctx.cohort.df.drop("target"), "id").join(ctx.cohort.df.select("id", "target"), "id")
    assert own.agg(F.avg((F.col("prediction") == F.col("target")).cast("double"))).first()[0] > 0.75
    assert all(0 <= s <= 1 for s, _ in before.values())


def test_the_refit_uses_all_rows(spark, ctx):
    """Coefficients equal those of one fit on the whole prepared table."""
    from pyspark.ml.classification import LogisticRegression

    fitted = R.refit(ctx, S.ModelResult(G.LOGISTIC, {"C": 2.0}, {}, None, None))
    data = fitted.prep.transform(ctx.cohort.df, "id", ["target"])
    ready = S._assembled(data, fitted.prep.output_cols).withColumnRenamed("target", "label")
    single = LogisticRegression(regParam=1.0 / (2.0 * 200), standardization=False, maxIter=500, tol=1e-13).fit(ready)
    assert np.allclose(fitted.weights, np.append(single.coefficients.toArray(), single.intercept), atol=1e-6)
