"""Models of all folds and candidates fitted together, against single fits and brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from strata.cohort import Cohort
from strata.operators import batched as BT
from strata.operators import clustering as CL
from strata.operators import folds as FO
from strata.operators import grids as G
from strata.operators import knn as K
from strata.operators import profile as P
from strata.operators import search as S
from strata.operators.prep import split_feature_types


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (400, 4))
    y = (x[:, 0] - 0.7 * x[:, 1] + rng.normal(0, 1, 400) > 0).astype(int)
    rows = [(k, None if k % 17 == 0 else float(a), float(b), float(c), float(d > 0), int(t))
            for k, ((a, b, c, d), t) in enumerate(zip(x, y))]
    return Cohort.from_frame(spark.createDataFrame(rows, "id long, a double, b double, c double, d double, target int"))


@pytest.fixture(scope="module")
def plan(cohort):
    return S.fold_plan(cohort, 3, 137, split_feature_types(cohort))


@pytest.fixture(scope="module")
def rows(plan):
    return BT.raw_rows(plan.cohort.df, {(f, -1): p for f, p in plan.preps.items()}, "target", keep=[F.col("id")])


@pytest.mark.parametrize("penalties", [[(0.01, 0.0), (1.0, 0.0), (10.0, 0.0)], [(0.1, 0.2), (0.1, 0.8), (1.0, 0.5)]])
def test_batched_logistic_reaches_the_optimum_of_single_fits(plan, rows, penalties):
    keys = [BT.ModelKey(f, i) for f in range(3) for i in range(3)]
    fitted = BT.fit_logistic(rows, keys, penalties)
    assert all(fitted.converged) and fitted.passes <= 30  # as many passes as the slowest model takes steps
    for f in range(3):
        train, _, cols = S._fold_data(plan, f, None)
        data = VectorAssembler(inputCols=list(cols), outputCol="features").transform(train).withColumnRenamed("target", "label")
        n = train.count()
        for i, (c, part) in enumerate(penalties):
            single = LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=part, standardization=False, maxIter=1000,
                                        tol=1e-14).fit(data)
            want = np.append(single.coefficients.toArray(), single.intercept)
            assert np.allclose(fitted.of(f, i), want, atol=1e-5 if part else 1e-6), (f, i)


def test_groups_of_models_give_the_same_result(rows, monkeypatch):
    keys = [BT.ModelKey(f, i) for f in range(3) for i in range(2)]
    whole = BT.fit_logistic(rows, keys, [(1.0, 0.0), (0.1, 0.5)])
    monkeypatch.setattr(BT, "STATE", 100)
    parts = BT.fit_logistic(rows, keys, [(1.0, 0.0), (0.1, 0.5)])
    assert parts.passes > whole.passes and all(np.allclose(a, b) for a, b in zip(whole.weights, parts.weights))


def _collected(frame):
    return [(r["fold"], r["inner"], r["label"], np.array([math.nan if v is None else v for v in r["x"]]), r["id"]) for r in frame.collect()]


def test_hinge_fit_is_a_minimum(rows):
    feature = BT.Feature(0.2, 40, 7)
    keys = [BT.ModelKey(f, 0) for f in range(3)]
    fitted = BT.fit_hinge(rows, keys, [(1.0, feature)], tol=1e-9, max_steps=500)
    data = _collected(rows.frame)
    for f in range(3):
        x = feature.of(BT.prepared(np.stack([d[3] for d in data if d[0] != f]), rows.preps, f, -1))
        y = np.array([d[2] for d in data if d[0] != f])
        ridge = np.append(np.full(40, 1.0 / len(y)), 0.0)

        def cost(w, x=x, y=y, ridge=ridge):
            return BT._hinge_sums(x, y, w[None], np.ones(len(y), bool))[0, 0] / len(y) + 0.5 * (ridge * w * w).sum()

        w, rng = fitted.of(f, 0), np.random.default_rng(f)
        assert all(cost(w) <= cost(w + rng.normal(0, s, len(w))) + 1e-6 for s in (1e-3, 1e-2, 1e-1) for _ in range(50))
        assert (((x @ w) > 0) == (y > 0.5)).mean() > 0.7


def test_bayes_of_all_folds_from_one_pass(rows):
    keys = [BT.ModelKey(f, i) for f in range(3) for i in range(2)]
    fitted = BT.fit_bayes(rows, keys, [1e-9, 1e-2])
    assert fitted.passes == 1
    data = _collected(rows.frame)
    for f in range(3):
        x = BT.prepared(np.stack([d[3] for d in data if d[0] != f]), rows.preps, f, -1)
        y = np.array([d[2] for d in data if d[0] != f])
        for i, smoothing in enumerate((1e-9, 1e-2)):
            got = fitted.of(f, i)
            for c in (0, 1):
                assert np.allclose(got.mean[c], x[y == c].mean(0)) and got.log_prior[c] == pytest.approx(math.log((y == c).mean()))
                assert np.allclose(got.var[c], x[y == c].var(0) + smoothing * x.var(0).max())


def _flipped(frame, fold):
    """The same rows with the labels of one fold turned round."""
    return frame.withColumn("label", F.when(F.col("fold") == fold, 1 - F.col("label")).otherwise(F.col("label")))


def test_no_row_reaches_a_fit_that_scores_it(plan):
    """Scores of a fold's rows do not change when that fold's labels do; nor inner margins with the inner fold's labels."""
    c = plan.nested(4)
    preps = S.fit_preparations(c, [(f, -1) for f in range(3)] + [(f, g) for f in range(3) for g in range(4)], plan.types, "median",
                               "fold", "inner")
    rows = BT.raw_rows(c.df, preps, "target", inner=F.col("inner"), keep=[F.col("id"), F.col("inner").alias("inner_of")])
    other = BT.Rows(_flipped(rows.frame, 1), rows.preps, rows.width)

    def scores(r, keys, inner):
        return {(x["id"], x["fold"]): (x["margin"], x["inner_of"]) for x in
                BT.margins(r, BT.fit_logistic(r, keys, [(1.0, 0.0)]), inner).collect()}

    outer = [BT.ModelKey(f, 0) for f in range(3)]
    a, b = scores(rows, outer, False), scores(other, outer, False)
    assert len(a) == 400
    assert all((abs(a[k][0] - b[k][0]) < 1e-6) == (k[1] == 1) for k in a)
    inner = [BT.ModelKey(f, 0, g) for f in range(3) for g in range(4)]
    a = scores(rows, inner, True)
    assert len(a) == 800  # every row, for each of the two other folds
    folds = {r["id"]: (r["fold"], r["inner"]) for r in c.df.select("id", "fold", "inner").collect()}
    assert all(folds[i][0] != f and folds[i][1] == g for (i, f), (_, g) in a.items())
    swapped = BT.Rows(rows.frame.withColumn("label", F.when(F.col("inner") == 2, 1 - F.col("label")).otherwise(F.col("label"))),
                      rows.preps, rows.width)
    b = scores(swapped, inner, True)
    assert all(abs(a[k][0] - b[k][0]) < 1e-6 for k in a if a[k][1] == 2)


def test_nested_preparations_match_single_ones(plan):
    c = plan.nested(4)
    got = S.fit_preparations(c, [(0, -1), (1, 2)], plan.types, "median", "fold", "inner")
    from strata.operators.prep import fit_preparation
    for (f, g), prep in got.items():
        kept = c.df.where((F.col("fold") != f) & ((F.col("inner") != g) if g >= 0 else F.lit(True)))
        want = fit_preparation(plan.cohort.with_df(kept.drop("fold", "inner")), plan.types)
        assert prep.fill == pytest.approx(want.fill) and prep.mean == pytest.approx(want.mean) and prep.scale == pytest.approx(want.scale)


def test_calibration_is_platts_sigmoid(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(1.5 * m - 0.5)))).astype(float)
    df = spark.createDataFrame([(k % 2, float(t), float(v)) for k, (t, v) in enumerate(zip(y, m))], "fold int, label double, margin double")
    got = S.calibration(df)
    assert set(got) == {0, 1} and all(abs(a - 1.5) < 0.2 and abs(b + 0.5) < 0.2 for a, b in got.values())
    apart = spark.createDataFrame([(0, float(k > 5), float(k - 5.5)) for k in range(12)], "fold int, label double, margin double")
    slope, offset = S.calibration(apart)[0]
    assert math.isfinite(slope) and slope > 0 and abs(offset) < 10


@pytest.mark.parametrize("model", [G.SVM, G.ELASTIC_NET, G.KNN])
def test_whole_light_grids(cohort, model):
    """A score for every row and candidate; probabilities on the evaluation folds."""
    ctx = S.SearchContext(cohort, k=2)
    r = S.train_model(ctx, model)
    n = len(S.LEARNERS[model].distinct(G.expand_grid(G.select_grid(model, "light", None, ctx.n_rows))))
    assert r.candidates.count() == n and sorted(x["rank"] for x in r.candidates.collect()) == list(range(1, n + 1))
    got = r.scores.agg(F.count(F.lit(1)), F.countDistinct("id"), F.min("score"), F.max("score")).first()
    assert got[0] == got[1] == 400 and 0 <= got[2] < got[3] <= 1


def test_grouped_neighbours_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(K, "CELL_ROWS", 40)
    monkeypatch.setattr(K, "BLOCK", 50)
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(0, 1, (600, 3)), 1)
    x[:200] = x[0]  # one vector in a third of the rows
    df = spark.createDataFrame([(k, [float(v) for v in r], k % 3, k % 2) for k, r in enumerate(x)], "id long, vec array<double>, g int, target int")
    ref = df.select("id", "vec", "target", F.explode(F.filter(F.array(*map(F.lit, range(3))), lambda f: f != F.col("g"))).alias("g"))
    far = np.zeros((600, 600))
    for j in range(3):
        far += (x[:, None, j] - x[None, :, j]) ** 2
    far = np.sqrt(far)
    far[np.arange(600)[:, None] % 3 == np.arange(600) % 3] = np.inf
    order = np.lexsort((np.broadcast_to(np.arange(600), far.shape), far), axis=1)[:, :9]
    got = {}
    for r in K.knn_join(df, ref, 9, group="g", with_candidates=True).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["rid"], r["dist"]))
    assert all([v[1] for v in sorted(got[i])] == list(order[i]) for i in range(600))
    votes = {(r["id"], r["candidate"]): r["score"] for r in K.knn_votes(df, ref, [(1, "uniform"), (4, "uniform"), (9, "distance")],
                                                                        group="g").collect()}
    for i in range(0, 600, 7):
        y, d = order[i] % 2, far[i][order[i]]
        w = (d == 0).astype(float) if (d == 0).any() else 1 / np.where(d == 0, 1, d)
        assert [votes[i, 0], votes[i, 1], votes[i, 2]] == pytest.approx([y[0], y[:4].mean(), (w * y).sum() / w.sum()])


def test_cells_far_away_are_not_visited(spark, monkeypatch):
    monkeypatch.setattr(K, "CELL_ROWS", 50)
    rng = np.random.default_rng(1)
    centers = rng.normal(0, 50, (20, 6))
    x = np.concatenate([c + rng.normal(0, 1, (50, 6)) for c in centers])
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id long, vec array<double>")
    seen = K.knn_join(df, df, 5, exclude_self=True, with_candidates=True).agg(F.avg("candidates")).first()[0]
    assert seen < 300  # of 1,000


def test_batched_kmeans(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in (-3, 0, 3)])
    df = spark.createDataFrame([(k, 0, [float(v) for v in r]) for k, r in enumerate(x)], "id long, target int, x array<double>")
    fits = CL.fit_runs(df, [2, 3, 4], 5)
    for k, run in fits.items():
        far = ((x[:, None] - run.centers[None]) ** 2).sum(2)
        assert run.cost == pytest.approx(far.min(1).sum()) and run.done
        means = np.stack([x[far.argmin(1) == c].mean(0) for c in range(k)])
        assert np.allclose(means, run.centers, atol=1e-3)  # no further step would move them
    assert fits[3].cost < 1.05 * sum(((g - g.mean(0)) ** 2).sum() for g in np.split(x, 3))
    runs = [CL.Restart(3, s, CL._spread_start(x, 3, s)) for s in range(4)]
    assert CL.lloyd(df, runs) < 40 and all(r.done for r in runs)
    got = {r["id"]: r["cluster"] for r in CL.assigned(df, fits[3].centers).collect()}
    assert [got[k] for k in range(180)] == ((x[:, None] - fits[3].centers[None]) ** 2).sum(2).argmin(1).tolist()


def test_correlation_of_incomplete_columns(spark, monkeypatch):
    monkeypatch.setattr(P, "GRAM_BLOCK", 2)
    rng = np.random.default_rng(4)
    x = rng.normal(1e6, 1, (300, 5))
    x[:, 3] = x[:, 0] * 0.5 + rng.normal(0, 0.1, 300)
    x[:, 4] = 7.25
    x[rng.random((300, 5)) < 0.2] = np.nan
    rows = [(k, *[None if math.isnan(v) else float(v) for v in r], k % 2) for k, r in enumerate(x)]
    c = Cohort.from_frame(spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double, target int").repartition(4))
    got = {(r["i"], r["j"]): r["r"] for r in P.correlation_matrix(c).collect()}
    assert set(got) == {(i, j) for j in range(4) for i in range(j)}
    for (i, j), r in got.items():
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert r == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-8)


def test_stacking_of_all_folds_as_data(cohort):
    ctx = S.SearchContext(cohort, k=3)
    bases = [(G.LOGISTIC, {"C": 1.0}), (G.NAIVE_BAYES, {"var_smoothing": 1e-9})]
    r = S.train_stacking(ctx, bases, (0.5, 1.0))
    assert r.scores.count() == 400 and r.scores.select("id").distinct().count() == 400
    assert sum(x["folds_won"] for x in r.candidates.collect()) == 3
    folds = {x["id"]: x["fold"] for x in ctx.plan(S.EVALUATION_SEED).cohort.df.select("id", "fold").collect()}
    assert all(folds[x["id"]] == x["fold"] for x in r.scores.collect())
    assert FO.resolve_fold_count(cohort.df, "target") == 10


def test_result_documents_in_parts(spark, monkeypatch):
    import json

    from strata.operators import evaluation as E

    monkeypatch.setattr(E, "PART_ROWS", 3)
    rng = np.random.default_rng(6)
    rows = [(m, k % 2, k, int(rng.random() < 0.5), float(rng.random()), int(k % 3 == 0)) for m in ("x", "y") for k in range(40)]
    scores = spark.createDataFrame(rows, "model string, fold int, id long, label int, score double, prediction int")
    roc = E.roc_curve(scores)
    clusters = spark.createDataFrame([("km", k % 2, k) for k in range(20)], "model string, cluster int, id long")
    parts = [(r["model"], r["part"], json.loads(r["document"])) for r in
             E.results_document(E.metrics_table(scores), roc, F.lit("C: 1"), clusters).collect()]
    for m in ("x", "y"):
        head = next(d for n, k, d in parts if n == m and k == 0)
        points = [p for _, _, d in sorted((x for x in parts if x[0] == m and x[1] > 0), key=lambda x: x[1]) for p in d["roc_curve"]]
        assert head["name"] == m and head["hyperparameters"] == "C: 1" and head["roc_points"] == len(points)
        assert head["metrics"]["confusion_matrix"]["tp"] >= 0
        want = sorted(tuple(r)[1:] for r in roc.where(F.col("model") == m).collect())  # points on a line are left out: gaps
        assert [(p["point"], p["fpr"], p["tpr"]) for p in points] == want and points[0] == {"point": 0, "fpr": 0.0, "tpr": 0.0}
    members = {}
    for n, _, d in parts:
        if n == "km":
            members.setdefault(d["cluster"], []).extend(d["members"])
    assert {c: sorted(v) for c, v in members.items()} == {c: list(range(c, 20, 2)) for c in (0, 1)}


def test_request_order_has_clusterings_last(spark):
    from strata.operators import evaluation as E

    metrics = spark.createDataFrame([("b", 0.7), ("a", 0.6)], "model string, auc double")
    got = sorted(map(tuple, E.order_results(metrics, ["k", "a", "b", "a"], ["k"]).select("request_pos", "model", "is_clustering", "auc").collect()))
    assert got == [(0, "a", 0, 0.6), (1, "b", 0, 0.7), (2, "k", 1, None)]
