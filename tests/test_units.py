"""Unit tests: literals from the cohort tool's own tests and invariants of our operators."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strata.cohort import Cohort
from strata.operators import evaluation as E
from strata.operators import grids as G
from strata.operators import validation as V
from strata.operators.foldstats import leave_fold_out_medians
from strata.operators.knn import knn_join
from strata.operators.prefix import running_totals
from strata.operators.topk import top_k_per_group


# ---------------------------------------------------------------- grids (ported expectations)
def test_light_hard_custom_grid_selection():
    assert G.select_grid(G.LOGISTIC, "light") == {"C": [0.01, 0.1, 1.0, 10.0]}
    assert G.select_grid(G.LOGISTIC, "HARD") == {"C": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]}
    custom = {G.GRADIENT_BOOSTING: {"learning_rate": ["0.01", "0.1"], "max_depth": ["3", "5"]}}
    grid = G.select_grid(G.GRADIENT_BOOSTING, "custom", custom)
    assert grid == {"learning_rate": [0.01, 0.1], "max_depth": [3, 5]}
    # custom mode without a grid for the model falls back to the light grid
    assert G.select_grid(G.LOGISTIC, "custom", custom) == {"C": [0.01, 0.1, 1.0, 10.0]}


def test_param_coercion_and_keys():
    assert G.coerce_param("none") is None and G.coerce_param("NULL") is None
    assert G.coerce_param("true") is True and G.coerce_param("False") is False
    assert G.coerce_param("1e-3") == 0.001 and G.coerce_param("5") == 5 and G.coerce_param("rbf") == "rbf"
    assert G.normalize_param_key("C") == "classifier__C"
    assert G.normalize_param_key(" ") == "classifier__param"
    assert G.normalize_param_key("preprocessor__x") == "preprocessor__x"
    assert G.parse_param_list(" 1, 2,, 3 ,") == ["1", "2", "3"]


def test_balance_config():
    assert G.balance_strategy(None) is None
    assert G.balance_strategy({"enabled": False}) is None
    assert G.balance_strategy({"enabled": True, "method": "OVERSAMPLE"}) == "oversample"
    assert G.balance_strategy({"enabled": True, "method": "other"}) == "smote"
    assert G.balance_default(True) == {"enabled": True, "method": "smote"}


def test_expand_grid_order_and_names():
    c = G.expand_grid({"b": [1, 2], "a": ["x", "y"]})
    assert c == [{"a": "x", "b": 1}, {"a": "x", "b": 2}, {"a": "y", "b": 1}, {"a": "y", "b": 2}]
    assert G.sanitize_names(["Random Forest", "random-forest", "Ü"]) == ["randomforest", "randomforest_2", "model"]
    assert G.format_hyperparameters({}) == "N/A"
    assert G.format_hyperparameters({"C": 1.0, "x": None}) == "C: 1.0 | x: None"
    assert G.filter_models([G.KMEANS, G.VOTING, G.LOGISTIC])["base"] == [G.LOGISTIC]
    with pytest.raises(ValueError):
        G.model_class("Nope")


# ---------------------------------------------------------------- metrics (ported literals)
def _metrics_row(spark):
    return spark.createDataFrame(
        [("m", 7, 1, 9, 3, 0.9123, 0.8, 0.7, 0.9, 0.875, 0.75, 0.778,
          0.0100, 0.02, 0.01, 0.01, 0.01, 0.01, 0.01)],
        "model string, tp bigint, fp bigint, tn bigint, fn bigint, auc double, accuracy double, sensitivity double, "
        "specificity double, vpp double, vpn double, f1_score double, auc_std double, accuracy_std double, "
        "sensitivity_std double, specificity_std double, vpp_std double, vpn_std double, f1_score_std double")


def test_rates_from_confusion_counts(spark):
    cm = spark.createDataFrame([("m", -1, 7, 1, 9, 3)], "model string, fold int, tp bigint, fp bigint, tn bigint, fn bigint")
    r = E.rates(cm).first()
    assert r["sensitivity"] == pytest.approx(0.7)
    assert r["specificity"] == pytest.approx(0.9)
    assert r["vpp"] == pytest.approx(0.875)
    assert r["vpn"] == pytest.approx(0.75)
    assert r["accuracy"] == pytest.approx(0.8)
    assert r["f1_score"] == pytest.approx(14 / 18)


def test_formatted_metric_and_csv(spark):
    m = _metrics_row(spark)
    t = E.formatted_metrics(m).first()
    assert t["auc_text"] == "0.912 ± 0.010"
    assert t["accuracy_text"] == "80.0% ± 2.0%"
    row = E.metrics_csv_rows(m).first()
    assert (row["AUC"], row["AUC_SD"]) == ("0.9123", "0.0100")
    assert (row["TP"], row["FP"], row["TN"], row["FN"]) == ("7", "1", "9", "3")


def test_auc_ties_and_missing(spark):
    rows = [("a", 0, i, y, s, 0) for i, (y, s) in enumerate([(0, 0.1), (1, 0.1), (1, 0.9), (0, 0.4)])]
    rows += [("b", 0, 10 + i, y, None, 0) for i, y in enumerate([0, 1])]
    df = spark.createDataFrame(rows, "model string, fold int, id int, label int, score double, prediction int")
    auc = {r["model"]: r["auc"] for r in E.auc_exact(df).where("fold = -1").collect()}
    assert auc["a"] == pytest.approx(0.625)
    assert auc["b"] is None


def test_roc_drops_collinear_points(spark):
    rows = [("a", 0, i, y, s, 0) for i, (y, s) in enumerate([(1, 0.9), (1, 0.8), (0, 0.7), (0, 0.6), (1, 0.5)])]
    df = spark.createDataFrame(rows, "model string, fold int, id int, label int, score double, prediction int")
    pts = [(r["fpr"], r["tpr"]) for r in E.roc_curve(df).orderBy("point").collect()]
    assert pts == [(0.0, 0.0), (0.0, 1 / 3), (0.0, 2 / 3), (1.0, 2 / 3), (1.0, 1.0)]


# ---------------------------------------------------------------- primitives against brute force
def test_running_totals_hot_group(spark):
    rnd = random.Random(7)
    rows = [("hot" if rnd.random() < 0.6 else f"g{rnd.randint(0, 5)}", rnd.randint(0, 50), rnd.randint(1, 3))
            for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, w bigint").groupBy("g", "v").agg(F.sum("w").alias("w"))
    got = running_totals(df, ["g"], ["v"], ["w"]).toPandas().sort_values(["g", "v"])
    pdf = df.toPandas().sort_values(["g", "v"])
    pdf["w_before"] = pdf.groupby("g")["w"].cumsum() - pdf["w"]
    assert got["w_before"].tolist() == pdf["w_before"].tolist()


def test_top_k_per_group_exact(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 2), i, rnd.random()) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, id int, x double")
    got = top_k_per_group(df, ["g"], [F.col("x").desc(), F.col("id")], 5, "r").toPandas()
    pdf = pd.DataFrame(rows, columns=["g", "id", "x"]).sort_values(["g", "x", "id"], ascending=[True, False, True])
    want = pdf.groupby("g").head(5)
    assert sorted(got["id"]) == sorted(want["id"])


def test_knn_join_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    pts = rng.normal(size=(400, 3))
    pts[:80] = pts[0]  # a heap of duplicates
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    q = df.where("id % 7 = 0")
    got = knn_join(q, df, 4, exclude_self=True).toPandas()
    for qid, grp in got.groupby("qid"):
        d = np.sqrt(((pts - pts[qid]) ** 2).sum(axis=1))
        order = sorted((d[j], j) for j in range(len(pts)) if j != qid)[:4]
        assert grp.sort_values("rank")["rid"].tolist() == [j for _, j in order]


def test_leave_fold_out_medians(spark):
    rnd = random.Random(5)
    rows = [(i, i % 4, float(rnd.randint(0, 30))) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, fold int, x double")
    got = {r["fold"]: r["median"] for r in leave_fold_out_medians(df, ["x"], "fold", 4).collect()}
    for f in range(4):
        assert got[f] == pytest.approx(float(np.median([x for _, g, x in rows if g != f])))


# ---------------------------------------------------------------- validation
def test_validation_raises_in_rule_order(spark):
    df = spark.createDataFrame([(1, 1.0, 0), (1, 2.0, 1), (2, 3.0, 1)], "id int, x double, target int")
    with pytest.raises(ValueError, match=r"Duplicate IDs detected: \[1\]"):
        V.validate(df)
    two = spark.createDataFrame([(1, 0)], "id int, target int")
    with pytest.raises(ValueError, match="at least three columns"):
        V.validate(two)
    bad = spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "id int, x string, target int")
    with pytest.raises(ValueError, match="Feature column 'x'"):
        V.validate(bad)
    ok = spark.createDataFrame([(1, "1.5", 0), (2, "x", 1)], "id int, x string, target int")
    c = V.validate(ok)
    assert [r["x"] for r in c.df.orderBy("id").collect()] == [1.5, None]


def test_empty_feature_list_is_an_error(spark):
    df = spark.createDataFrame([(1, 0)], "id int, target int")
    with pytest.raises(ValueError):
        Cohort(df, "id", "target", ()).require_features()


def test_catalog_and_model_filter(spark):
    got = [(r["request_pos"], r["model"], r["class"]) for r in
           G.filter_models_frame(spark, [G.KMEANS, G.LOGISTIC, G.VOTING]).orderBy("request_pos").collect()]
    assert got == [(0, G.KMEANS, "clustering"), (1, G.LOGISTIC, "base"), (2, G.VOTING, "ensemble")]
    with pytest.raises(ValueError):
        G.filter_models_frame(spark, ["Nope"])
    bases = G.collect_bases([G.LOGISTIC, G.VOTING, G.LOGISTIC, G.KNN], {G.LOGISTIC: 1, G.KNN: 2})
    assert bases == [("logisticregression", 1), ("knearestneighborsknn", 2)]


def test_prepare_fallback_and_reset(spark):
    from strata.operators.prep import FeatureTypes, fit_preparation
    df = spark.createDataFrame([(1, None, 0), (2, 4.0, 1), (3, 5.0, 0)], "id int, x double, target int")
    raw = Cohort.from_frame(df)
    prep = fit_preparation(raw, FeatureTypes((), ()))
    assert prep.output_cols == ("x",) and prep.fill["x"] == 4.5 and prep.mean == {}
    # a cleaned cohort is a new value: the raw one is untouched ("reset" = keep using raw)
    cleaned = raw.with_df(df.where("id > 1"), ["x"])
    assert raw.df.count() == 3 and cleaned.df.count() == 2


def test_reject_format():
    from strata.sources.tables import reject_format
    assert reject_format("a/b.CSV") == "csv"
    with pytest.raises(ValueError):
        reject_format("a/b.xls")


def test_fold_sizes_and_balanced_training_folds(spark):
    from strata.operators import search as S
    from strata.operators.folds import stratified_folds
    rows = [(i, float(i % 17), int(i % 4 == 0)) for i in range(203)]
    df = spark.createDataFrame(rows, "id int, x double, target int")
    f = stratified_folds(df, "id", "target", 5, 42).toPandas()
    sizes = f.groupby("fold").size()
    assert sizes.max() - sizes.min() <= 1
    per_class = f.groupby(["target", "fold"]).size().unstack()
    assert (per_class.max(axis=1) - per_class.min(axis=1)).max() <= 1
    ctx = S.SearchContext(Cohort.from_frame(df), k=5)
    plan = ctx.plan(S.EVALUATION_SEED)
    train, test, _ = S._fold_data(plan, 0, "oversample")
    counts = train.groupBy("target").count().toPandas().set_index("target")["count"]
    assert counts[0] == counts[1]
    assert test.count() == int((plan.cohort.df.toPandas()["fold"] == 0).sum())
