"""What fold statistics and rankings sort: few values for medians, no pooled rows for fold AUCs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import batched as BT
from strata.operators import evaluation as E
from strata.operators import foldstats as FS


@pytest.fixture
def sorted_rows(monkeypatch):
    """Rows that each running total was given."""
    seen = []
    for module in (FS, E):
        whole = module.running_totals
        monkeypatch.setattr(module, "running_totals", lambda df, *a, _w=whole, **k: (seen.append(df.count()), _w(df, *a, **k))[1])
    return seen


def test_medians_sort_the_values_near_them_only(spark, sorted_rows):
    r = random.Random(3)
    rows = [(i, r.gauss(0, 1) if i % 9 else None, float(i), r.choice([0.0, 1.0, float("nan")]), i % 3) for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, fold int").repartition(4)
    got = {(x["variable"], x["fold"]): x["median"] for x in FS.leave_fold_out_medians(df, ["a", "b", "c"], "fold", 3).collect()}
    want = {(c, f): np.median([t[j] for t in rows if t[4] != f and t[j] is not None and t[j] == t[j]])
            for f in range(3) for j, c in ((1, "a"), (2, "b"), (3, "c"))}
    assert got == want and sorted_rows[0] < 400
    # a left-out part on one side moves the median far away: those columns are counted whole
    got = {x["variable"]: x["median"] for x in FS.leave_out_medians(df, ["a", "b"], [F.col("id") < 2000]).collect()}
    assert got == {c: np.median([t[j] for t in rows if t[0] >= 2000 and t[j] is not None]) for j, c in ((1, "a"), (2, "b"))}


def test_fold_aucs_sort_no_pooled_rows(spark, sorted_rows):
    rows = [("m", i % 2, i, i % 3 == 0, (i * 37) % 101 / 101.0) for i in range(200)]
    s = spark.createDataFrame(rows, "model string, fold int, id int, label boolean, score double").withColumn("label", F.col("label").cast("int"))
    both = {(r["model"], r["fold"]): r["auc"] for r in E.auc_exact(s).collect()}
    own = {(r["model"], r["fold"]): r["auc"] for r in E.auc_exact(s, pooled=False).collect()}
    assert own == {k: v for k, v in both.items() if k[1] != E.POOLED} and len(own) == 2
    assert sorted_rows[1] < sorted_rows[0]


@pytest.mark.parametrize("width", [4, BT.PAIRED_WIDTH + 2])
def test_logistic_sums_match_a_loop(width):
    rng = np.random.default_rng(2)
    x, y, w = rng.normal(0, 1, (50, width)), rng.integers(0, 2, 50).astype(float), rng.normal(0, 30, (3, width))
    there = rng.random(50) < 0.8
    got = BT._logistic_sums(x, y, w, there)
    for m in range(3):
        z = x[there] @ w[m]
        p = 1 / (1 + np.exp(-z))
        assert np.isclose(got[m, 0], (np.logaddexp(0, z) - y[there] * z).sum())
        assert np.allclose(got[m, 1:1 + width], (p - y[there]) @ x[there])
        assert np.allclose(got[m, 1 + width:].reshape(width, width), (x[there].T * (p * (1 - p))) @ x[there])
