"""Registered fold, preparation and balancing queries (2.7, 2.11, 2.12)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import balance as B
from ..operators import folds as FO
from ..operators import prep as PR
from ..operators.search import fit_fold_preparations
from ..session import spread
from ..sources import fixtures as X
from .registry import finish, register

SEED = 42


def signal_cohort(spark, sf):
    return X.ord_cohort(spark, sf, target="target_signal")


def folded(spark, sf, seed=SEED):
    c = signal_cohort(spark, sf)
    k = FO.resolve_fold_count(c.df, c.target_col)
    return c, c.with_df(FO.stratified_folds(c.df, c.id_col, c.target_col, k, seed)), k


@register("stratified_folds")
def q_stratified_folds(spark, sf):
    _, c, _ = folded(spark, sf)
    return finish(c.df.select("id", "target", "fold"))


@register("fold_count")
def q_fold_count(spark, sf):
    c = signal_cohort(spark, sf)
    return finish(FO.fold_count(c.df, c.target_col))


@register("fold_split")
def q_fold_split(spark, sf):
    """Test rows of every fold (a fold's training rows are the complement)."""
    _, c, k = folded(spark, sf)
    parts = [FO.fold_split(c.df, f)[1].select(F.lit(f).alias("fold"), "id", "target") for f in range(k)]
    return finish(reduce(DataFrame.unionByName, parts))


@register("split_feature_types")
def q_split_feature_types(spark, sf):
    return finish(PR.feature_type_table(signal_cohort(spark, sf)))


def fold_preparations(spark, sf):
    """Cohort, folds, and the preparation fitted on the training rows of every fold, in three passes."""
    _, lazy, k = folded(spark, sf)
    cf = lazy.with_df(spread(lazy.df, "folds"))  # every pass reads the rows, none joins and deals them again
    return cf, k, fit_fold_preparations(cf, "fold", k, PR.split_feature_types(cf))


def _fitted(spark, preps, kind):
    """(fold, pos, variable, fill, mean, scale) of every fold's preparation: folds x features rows."""
    rows = [(f, pos, v, p.fill.get(v), p.mean.get(v), p.scale.get(v)) for f, p in preps.items()
            for pos, v in enumerate(p.output_cols) if kind is None or v in getattr(p.types, kind)]
    return spark.createDataFrame(rows, "fold int, pos int, variable string, fill double, mean double, scale double")


@register("impute_median")
def q_impute_median(spark, sf):
    """Exact medians of the continuous features on the training rows of every fold."""
    _, _, preps = fold_preparations(spark, sf)
    return finish(_fitted(spark, preps, "continuous").select("fold", "variable", F.col("fill").alias("median")))


@register("impute_mode")
def q_impute_mode(spark, sf):
    """Most frequent value (smallest on ties) of the binary features on the training rows of every fold."""
    _, _, preps = fold_preparations(spark, sf)
    return finish(_fitted(spark, preps, "binary").select("fold", "variable", F.col("fill").alias("mode")))


@register("standardize")
def q_standardize(spark, sf):
    """Fitted fill, mean and population std per prepared feature on the training rows of every fold."""
    _, _, preps = fold_preparations(spark, sf)
    return finish(_fitted(spark, preps, None))


@register("assemble")
def q_assemble(spark, sf):
    """Every row prepared by the fit of its own fold's training rows, long form (fold, id, variable, value)."""
    c, k, preps = fold_preparations(spark, sf)
    parts = []
    for f in range(k):
        t = preps[f].transform(FO.fold_split(c.df, f)[1], "id")
        cells = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).alias("value")) for v in preps[f].output_cols])
        parts.append(t.select(F.lit(f).alias("fold"), "id", F.inline(cells)))
    return finish(reduce(DataFrame.unionByName, parts))


@register("random_oversample")
def q_random_oversample(spark, sf):
    """Minority rows of ``doc`` drawn with replacement up to the majority size (originals kept)."""
    c = X.doc_cohort(spark, sf)
    return finish(B.random_oversample(c, seed=SEED).select("id", "target", "draw"))
