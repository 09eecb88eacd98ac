"""Whole training requests: order, ensembles, status rows, stacking without leaks."""

from __future__ import annotations

import random

import pytest

from strata.cohort import Cohort
from strata.operators import grids as G
from strata.operators import search as S


@pytest.fixture(scope="module")
def ctx(spark):
    rng = random.Random(2)
    rows = [(k, rng.gauss(0, 1) + 2 * (k % 2), rng.gauss(0, 1), k % 2) for k in range(48)]
    return S.SearchContext(Cohort.from_frame(spark.createDataFrame(rows, "id long, a double, b double, target int")), k=2)


def test_request(ctx, monkeypatch):
    seen = []
    meta = S._meta_fit_score

    def watched(train, test, cols, c):
        seen.append(({r["id"] for r in train.select("id").collect()}, {r["id"] for r in test.select("id").collect()}))
        return meta(train, test, cols, c)

    monkeypatch.setattr(S, "_meta_fit_score", watched)
    custom = {G.NAIVE_BAYES: {"var_smoothing": ["1e-9"]}, G.LOGISTIC: {"C": ["1"]}, G.STACKING: {"final_estimator__C": ["0.5", "1"]}}
    got = S.train_models(ctx, [G.VOTING, G.NAIVE_BAYES, G.LOGISTIC, G.STACKING, G.VOTING], mode="custom", custom=custom)
    assert [r.name for r in got] == [G.VOTING, G.NAIVE_BAYES, G.LOGISTIC, G.STACKING]
    assert all(r.status is None and sorted(x["id"] for x in r.scores.select("id").collect()) == list(range(48)) for r in got)
    assert got[3].best_params["final_estimator__C"] in (0.5, 1.0)
    # test_batched.py shows that no scored row is among the rows of its fit
    assert all(not fit & held for fit, held in seen)
    assert not seen  # bases that can be fitted together have no fits of their own per fold


def test_status_rows(ctx):
    got = S.train_models(ctx, [G.STACKING, G.VOTING])
    assert [(r.name, r.status) for r in got] == [(G.STACKING, S.STACKING_STATUS), (G.VOTING, S.VOTING_STATUS)]
    assert all(r.scores.count() == 0 for r in got)
