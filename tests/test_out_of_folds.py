"""The join of cross-validation: every row against the rows of all other folds, stored once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.cohort import Cohort
from strata.operators import grids as G
from strata.operators import knn as K
from strata.operators import search as S
from strata.plans import model_queries as MQ


@pytest.fixture
def small(monkeypatch):
    for name, value in {"CELL_ROWS": 20, "NEAR": 25, "REGION_ROWS": 60}.items():
        monkeypatch.setattr(K, name, value)
    monkeypatch.setattr(K, "REGION_CAP", 60)


def brute(x, fold, k, prepared=None):
    """Places of the k nearest rows of other folds; ``prepared``: the rows as each fold sees them."""
    out = []
    for i in range(len(x)):
        seen = x if prepared is None else prepared[fold[i]]
        far = np.zeros(len(x))
        for j in range(x.shape[1]):
            far += (seen[i, j] - seen[:, j]) ** 2
        far = np.sqrt(far)
        far[fold == fold[i]] = np.inf
        out.append(np.lexsort((np.arange(len(x)), far))[:k].tolist())
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
def test_rows_of_other_folds_match_brute_force(spark, small, kind):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(0, 1, (600, 3)), 1).astype("f4").astype(float)
    x[:200] = x[0]  # one vector in a third of the rows: its cell is larger than a region
    fold = rng.integers(0, 3, 600)
    df = spark.createDataFrame([(k, [float(v) for v in r], int(f)) for k, (r, f) in enumerate(zip(x, fold))],
                               f"id long, vec array<{kind}>, fold int")
    got = {}
    for r in K.knn_out_of_folds(df, 9).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["rid"]))
    want = brute(x, fold, 9)
    assert all([v for _, v in sorted(got[i])] == want[i] for i in range(600))


def test_rows_without_vectors_and_text_ids(spark, small):
    rows = [("a", [0.0], 0), ("b", [1.0], 1), ("c", [3.0], 1), ("d", None, 1), ("e", [None], 0), ("f", [9.0], None)]
    df = spark.createDataFrame(rows, "id string, vec array<double>, fold int")
    got = sorted((r["qid"], r["rank"], r["rid"], r["dist"]) for r in K.knn_out_of_folds(df, 5).collect())
    assert got == [("a", 1, "b", 1.0), ("a", 2, "c", 3.0), ("b", 1, "a", 1.0), ("c", 1, "a", 3.0)]
    assert K.knn_out_of_folds(df.where("false"), 5).count() == 0


def test_folds_with_views_of_their_own(spark, small):
    rng = np.random.default_rng(1)
    x = rng.normal(0, [1, 30, 0.2], (400, 3))
    x[rng.random((400, 3)) < 0.1] = np.nan
    fold = np.arange(400) % 4
    views = {f: K.FoldView(rng.normal(0, [1, 30, 0.2]), rng.normal(0, 1, 3), rng.uniform(0.5, 2, 3) * [1, 30, 0.2]) for f in range(4)}
    df = spark.createDataFrame([(k, [None if np.isnan(v) else float(v) for v in r], int(f)) for k, (r, f) in enumerate(zip(x, fold))],
                               "id long, vec array<double>, fold int")
    got = {}
    for r in K.knn_out_of_folds(df, 6, views=views).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["rid"]))
    want = brute(x, fold, 6, {f: v.of(x) for f, v in views.items()})
    assert all([v for _, v in sorted(got[i])] == want[i] for i in range(400))


def test_search_equals_a_join_per_fold(spark, small):
    """Scores of the search, incomplete rows included, are those of a join of every fold's own train and test rows."""
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (240, 3))
    x[rng.random((240, 3)) < 0.1] = np.nan
    rows = [(k, *[None if np.isnan(v) else float(v) for v in r], int(k % 3 == 0), int(rng.random() < 0.4)) for k, r in enumerate(x)]
    ctx = S.SearchContext(Cohort.from_frame(spark.createDataFrame(rows, "id long, a double, b double, c double, d int, target int")), k=3)
    plan, candidates = ctx.plan(S.TUNING_SEED), [{"n_neighbors": 1}, {"n_neighbors": 7, "weights": "distance"}]
    got = {(r["model"], r["id"]): (r["fold"], r["label"], r["score"]) for r in S.out_of_fold(plan, S.LEARNERS[G.KNN], candidates, str).collect()}
    assert len(got) == 480
    for f in range(3):
        train, test, cols = S._fold_data(plan, f, None)
        labels = {r["id"]: r["target"] for r in test.collect()}
        for i, params in enumerate(candidates):
            for r in S._knn_fit_score(train, test, cols, params, 0)[0].collect():
                assert got[str(i), r["id"]] == (f, labels[r["id"]], pytest.approx(r["score"]))


def test_rows_are_stored_once(spark, monkeypatch, sf):
    """Before, every embedding was written once per fold that refers to it, and shuffled to each block of queries."""
    written, write = [], K._written

    def counted(df, name):
        out = write(df, name)
        written.append(out.count() if "vec" in out.columns else 0)
        return out

    monkeypatch.setattr(K, "_written", counted)
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert MQ.q_knn(spark, sf).count() == n and sum(written) <= n
