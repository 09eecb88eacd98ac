"""Fits over many rows: what a pass deals out, keeps and holds in memory."""

import re

import numpy as np

from strata.cohort import Cohort
from strata.operators import clustering as CL
from strata.operators import folds as FO
from strata.operators import prep as PR
from strata.operators import profile as P
from strata.operators import search as S


def cohort(spark, n=400):
    rng = np.random.default_rng(7)
    rows = [(i, None if i % 9 == 0 else float(rng.normal()), float(rng.integers(0, 3)), None, int(rng.random() < 0.3), int(i % 3 == 0))
            for i in range(n)]
    return Cohort.from_frame(spark.createDataFrame(rows, "id long, a double, b double, none double, flag int, target int"))


def test_preparation_counts_no_whole_columns(spark, monkeypatch):
    c = cohort(spark)
    want = {r["variable"]: r["median"] for r in P.quartiles(c, probs=((0.5, "median"),)).collect()}
    assert {r["variable"]: r["median"] for r in PR.medians(c).collect()} == want
    monkeypatch.setattr(P, "shared_value_counts", lambda *a: 1 / 0)  # a row per distinct value of every column
    monkeypatch.setattr(P, "quartiles", lambda *a, **k: 1 / 0)
    prep = PR.fit_preparation(c)
    assert prep.fill["a"] == want["a"] and prep.fill["b"] == want["b"] and prep.fill["flag"] == 0.0
    assert PR.fit_preparation(c, scale_all=True).fill["a"] == want["a"]


def test_points_read_a_written_cohort(spark):
    c = cohort(spark)
    joined = c.with_df(c.df.join(spark.range(400), "id"))
    data, cols = CL.prepared_points(joined)
    assert "Join" not in data._jdf.queryExecution().toString() and data.count() == 400 and "a" in cols


def test_large_tree_fits_run_one_by_one():
    assert S.fits_at_once(10_000, 8, 12) == 8 and S.fits_at_once(0, 8, 12) == 8
    assert S.fits_at_once(4_000_000, 8, 12) == 3 and S.fits_at_once(50_000_000, 8, 12) == 1


def test_hash_of_folds_is_not_dealt_out(spark):
    c = cohort(spark)
    plan = FO.stratified_folds(c.df, "id", "target", 5)._jdf.queryExecution().executedPlan().toString()
    dealt = [i for i, line in enumerate(plan.splitlines()) if re.search(r"Exchange hashpartitioning\(target#\d+, _bucket", line)]
    hashed = [i for i, line in enumerate(plan.splitlines()) if re.search(r"Project .* AS _h#", line)]
    assert len(dealt) == 1 and hashed and max(hashed) < dealt[0]  # a plan is read from below
