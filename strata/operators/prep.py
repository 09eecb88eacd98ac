"""Feature preparation, fitted on training rows only.

* ``split_feature_types``: a feature is binary when its present values are a
  subset of {0, 1}, continuous otherwise; all-missing features are dropped.
  Decided once on the whole table (one aggregation).
* continuous features: exact median imputation, then ``(x - mean) / std``
  with the population std of the imputed column (std 0 becomes 1);
* binary features: most frequent value imputation (smallest on ties);
* neither group: median imputation of every feature.

Medians are exact (the values near the middle are counted and summed up, no
single task per column); modes come from per-value counts with a salted top-1
per feature.  The fitted parameters
form a small table (one row per feature) that is broadcast onto the rows it
transforms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cohort import Cohort
from ..functions.numeric import qcol
from . import profile as P
from .foldstats import leave_out_medians
from .topk import top_k_per_group


@dataclass(frozen=True)
class FeatureTypes:
    continuous: tuple[str, ...]
    binary: tuple[str, ...]

    @property
    def ordered(self) -> tuple[str, ...]:
        return self.continuous + self.binary


def feature_type_table(cohort: Cohort) -> DataFrame:
    """(ordinal, variable, kind) with kind continuous / binary / empty; one scan, two counts per feature."""
    counts = []
    for i, c in enumerate(cohort.feature_cols):
        v = P.cell(cohort, c)
        counts += [F.count(v).alias(f"present{i}"), F.count_if(v.isNotNull() & ~v.isin(0.0, 1.0)).alias(f"other{i}")]
    kind = lambda i: (F.when(F.col("_n") == 0, F.lit(None)).when(F.col(f"present{i}") == 0, F.lit("empty"))
                      .when(F.col(f"other{i}") == 0, F.lit("binary")).otherwise(F.lit("continuous")))
    cells = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("variable"), kind(i).alias("kind"))
                      for i, c in enumerate(cohort.feature_cols)])
    return cohort.df.agg(F.count(F.lit(1)).alias("_n"), *counts).select(F.inline(cells)).where(F.col("kind").isNotNull())


def split_feature_types(cohort: Cohort) -> FeatureTypes:
    rows = feature_type_table(cohort).collect()  # one row per feature
    rows.sort(key=lambda r: r["ordinal"])
    return FeatureTypes(tuple(r["variable"] for r in rows if r["kind"] == "continuous"),
                        tuple(r["variable"] for r in rows if r["kind"] == "binary"))


def medians(cohort: Cohort) -> DataFrame:
    """(ordinal, variable, median) exact, per feature; only values near the middle are counted one by one."""
    cells = cohort.df.select(*[P.cell(cohort, c).alias(c) for c in cohort.feature_cols])
    place = F.create_map(*[F.lit(x) for i, c in enumerate(cohort.feature_cols) for x in (c, i)])
    return leave_out_medians(cells, list(cohort.feature_cols), [F.lit(False)]).select(
        place[F.col("variable")].alias("ordinal"), "variable", "median")


def modes(cohort: Cohort, vc: DataFrame | None = None) -> DataFrame:
    """(ordinal, variable, mode): most frequent present value, smallest on ties."""
    vc = (vc if vc is not None else P.value_counts(cohort)).where(F.col("value").isNotNull())
    top = top_k_per_group(vc, ["ordinal", "variable"], [F.col("cnt").desc(), F.col("value")], 1, "r")
    return top.select("ordinal", "variable", F.col("value").alias("mode"))


def _imputed(cohort: Cohort, fills: dict[str, float]) -> DataFrame:
    cols = [qcol(cohort.id_col)]
    for c in cohort.feature_cols:
        v = qcol(c).cast("double")
        cols.append((F.coalesce(v, F.lit(fills[c])) if fills.get(c) is not None else v).alias(c))
    cols.append(qcol(cohort.target_col))
    return cohort.df.select(*cols)


@dataclass(frozen=True)
class Preparation:
    types: FeatureTypes
    fill: dict
    mean: dict
    scale: dict

    @property
    def output_cols(self) -> tuple[str, ...]:
        return self.types.ordered if self.types.ordered else tuple(self.fill)

    def transform(self, df: DataFrame, id_col: str, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
        """Imputed (and scaled) feature columns in assembler order plus ID and ``keep`` columns."""
        cols = [qcol(id_col)] + [qcol(k) for k in keep]
        for c in self.output_cols:
            v = qcol(c).cast("double")
            if self.fill.get(c) is not None:
                v = F.coalesce(v, F.lit(float(self.fill[c])))
            if c in self.mean:
                v = (v - F.lit(float(self.mean[c]))) / F.lit(float(self.scale[c]))
            cols.append(v.alias(c))
        return df.select(*cols)


def fit_preparation(train: Cohort, types: FeatureTypes | None = None, scale_all: bool = False) -> Preparation:
    """Fit imputation and scaling on the training rows.

    ``scale_all`` (used by K-Means) median-imputes and scales every feature.
    """
    types = types or split_feature_types(train)
    if scale_all:
        types = FeatureTypes(tuple(train.feature_cols), ())
    cont, binr = list(types.continuous), list(types.binary)
    fill: dict = {}
    med_cols = cont if (cont or not binr) else []
    if not cont and not binr:
        med_cols = list(train.feature_cols)
    if med_cols:
        med = medians(train.with_df(train.df, med_cols)).collect()  # one row per feature
        fill.update({r["variable"]: r["median"] for r in med})
    if binr:
        md = modes(train.with_df(train.df, binr)).collect()  # one row per feature
        fill.update({r["variable"]: r["mode"] for r in md})
    mean, scale = {}, {}
    if cont:
        imp = _imputed(train.with_df(train.df, cont), fill)
        aggs = []
        for i, c in enumerate(cont):
            aggs += [F.avg(qcol(c)).alias(f"m{i}"), F.stddev_pop(qcol(c)).alias(f"s{i}")]
        row = imp.agg(*aggs).first()  # one row: two numbers per feature
        for i, c in enumerate(cont):
            s = row[f"s{i}"]
            mean[c] = row[f"m{i}"] if row[f"m{i}"] is not None else 0.0
            scale[c] = s if (s is not None and s != 0) else 1.0
    if not cont and not binr:
        types = FeatureTypes((), ())
    return Preparation(types, fill, mean, scale)


def params_table(spark, prep: Preparation) -> DataFrame:
    rows = [(i, c, prep.fill.get(c), prep.mean.get(c), prep.scale.get(c))
            for i, c in enumerate(prep.output_cols)]
    return spark.createDataFrame(rows, "pos int, variable string, fill double, mean double, scale double")


def assemble(df: DataFrame, cols, output: str = "features") -> DataFrame:
    """Continuous block then binary block into one vector column (other columns kept)."""
    return VectorAssembler(inputCols=list(cols), outputCol=output, handleInvalid="keep").transform(df)
