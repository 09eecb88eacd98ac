"""Balanced training, running totals and long integers against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.cohort import Cohort
from strata.operators import folds as FO
from strata.operators import search as S
from strata.operators.prefix import running_totals
from strata.session import scratch_path
from strata.sources import files


@pytest.fixture(scope="module")
def plan(spark):
    rng = random.Random(6)
    rows = [(k, rng.gauss(0, 1) + (k % 5 == 0), rng.gauss(0, 1), int(k % 5 == 0)) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, b double, target int")
    c = Cohort.from_frame(df)
    from strata.operators.prep import split_feature_types

    return S.fold_plan(c, 3, 137, split_feature_types(c))


@pytest.mark.parametrize("method", ["oversample", "smote"])
def test_balanced_neighbours_and_bayes_match_brute_force(plan, method):
    for f in range(plan.k):
        train, test, cols = S._fold_data(plan, f, method)
        rows = [(np.array([r[c] for c in cols]), r["target"]) for r in train.collect()]
        assert sum(y for _, y in rows) * 2 == len(rows)  # balanced
        ids = {r["id"]: np.array([r[c] for c in cols]) for r in test.collect()}
        scores, _ = S._knn_fit_score(train, test, cols, {"n_neighbors": 5}, len(rows))
        got = {r["id"]: r["score"] for r in scores.collect()}
        assert set(got) == set(ids)
        for i, x in ids.items():
            far = sorted(float(np.sqrt(((x - v) ** 2).sum())) for v, _ in rows)
            near = [y for v, y in rows if np.sqrt(((x - v) ** 2).sum()) <= far[4] + 1e-12]
            if len(near) == 5:  # no tie at the fifth distance
                assert got[i] == pytest.approx(sum(near) / 5)
        bayes, _ = S._nb_fit_score(train, test, cols, {}, len(rows))
        got = {r["id"]: r["score"] for r in bayes.collect()}
        means, spread = {}, {}
        x = np.array([v for v, _ in rows])
        y = np.array([t for _, t in rows])
        for t in (0, 1):
            means[t], spread[t] = x[y == t].mean(0), x[y == t].var(0) + 1e-9 * x.var(0).max()
        for i, v in ids.items():
            like = [math.log(0.5) - 0.5 * (np.log(2 * np.pi * spread[t]) + (v - means[t]) ** 2 / spread[t]).sum()
                    for t in (0, 1)]
            assert got[i] == pytest.approx(1 / (1 + math.exp(like[0] - like[1])), abs=1e-9)


def test_running_totals_leave_every_column_alone(spark):
    big = 1 << 60
    rows = [(k % 3, k, None if k % 7 == 0 else big + k, 1 if k % 4 else None) for k in range(500)]
    df = spark.createDataFrame(rows, "g int, o long, x long, w long").repartition(5)
    got = {r["o"]: r for r in running_totals(df, ["g"], ["o"], ["w"]).collect()}
    sums = {0: 0, 1: 0, 2: 0}
    for g, o, x, w in rows:
        assert (got[o]["x"], got[o]["w"], got[o]["w_before"]) == (x, w, sums[g])
        sums[g] += w or 0


def test_folds_are_even_and_leave_rows_alone(spark):
    big = 1 << 60
    rows = [(k, int(k % 9 == 0), None if k % 5 == 0 else big + k) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, target int, x long")
    got = FO.stratified_folds(df, "id", "target", 4).collect()
    assert {r["id"]: (r["target"], r["x"]) for r in got} == {i: (t, x) for i, t, x in rows}
    for t in (None, 0, 1):
        sizes = [sum(r["fold"] == f and t in (None, r["target"]) for r in got) for f in range(4)]
        assert max(sizes) - min(sizes) <= 1


def test_no_python_in_folds_and_totals(spark):
    df = spark.range(100).select("id", (F.col("id") % 2).cast("int").alias("target"))
    for out in (FO.stratified_folds(df, "id", "target", 4), running_totals(df, ["target"], ["id"], ["id"])):
        plan = out._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_long_integers_round_trip(spark):
    ids = ["9007199254740993123", "9007199254740993124", "12"]
    longer = ["99999999999999999999999999", "1", "-5"]
    longest = ["1" * 40, "2", "3"]
    df = spark.createDataFrame(list(zip(ids, longer, longest, ["1", "2.5", None])), "id string, d string, t string, x string")
    path = scratch_path(spark, "long") + ".csv"
    files.write_csv(df, path)
    back = files.read_csv(spark, path)
    assert dict(back.dtypes) == {"id": "bigint", "d": "decimal(38,0)", "t": "string", "x": "double"}
    assert sorted(str(r["id"]) for r in back.collect()) == sorted(ids)
    assert sorted(str(r["d"]) for r in back.collect()) == sorted(longer)


def test_candidates_without_a_counterpart_are_fitted_once():
    from strata.operators import grids as G

    forest = S.LEARNERS[G.RANDOM_FOREST].distinct(G.expand_grid(G.LIGHT_GRIDS[G.RANDOM_FOREST]))
    assert len(forest) == 6 and all("min_samples_split" not in p for p in forest)
