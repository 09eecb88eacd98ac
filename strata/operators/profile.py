"""Column profile of a cohort.

All sections come from two shared intermediate tables instead of one job per
column:

* ``long_values``  the features unpivoted to (id, ordinal, variable, value)
  with one generator, values as DOUBLE and NaN as NULL;
* ``value_counts`` (ordinal, variable, value, cnt, first_id): one shuffle for
  all columns, with map-side partial aggregation, so a value repeated in a
  third of the rows collapses to one row before the shuffle.

Exact quartiles use the running-sum ECDF over ``value_counts`` (no single task
per column).  Correlations are pairwise-complete moments of all pairs from one
scan: masked matrix products of column blocks (each task holds 48 bytes per pair
of features).

Fixed values that results depend on:
    correlation threshold 0.8 (inclusive), imbalance threshold 0.47 (strict),
    low-cardinality threshold 15 (inclusive), 20 histogram bins,
    fence factor 1.5, 3 example values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cohort import Cohort
from ..functions.numeric import as_double, qcol, ratio
from ..session import checkpoint_root, ship_package
from .prefix import running_totals
from .topk import top_k_per_group

# fixed values
CORRELATION_THRESHOLD = 0.8
IMBALANCE_THRESHOLD = 0.47
LOW_CARDINALITY_THRESHOLD = 15
HISTOGRAM_BINS = 20
FENCE_FACTOR = 1.5
EXAMPLE_VALUES = 3
#: Columns per block of the correlation's products.
GRAM_BLOCK = 128

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def long_values(cohort: Cohort, include_target: bool = False) -> DataFrame:
    """(id, ordinal, variable, value) with one row per feature cell."""
    df = cohort.df
    cols = list(cohort.feature_cols) + ([cohort.target_col] if include_target else [])
    cells = F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("variable"),
                 as_double(qcol(c), _dtype(df, c)).alias("value"))
        for i, c in enumerate(cols)
    ])
    return df.select(qcol(cohort.id_col).alias("id"), F.inline(cells))


def cell(cohort: Cohort, name: str) -> Column:
    """A feature cell as ``long_values`` shows it."""
    return as_double(qcol(name), _dtype(cohort.df, name))


def value_counts(cohort: Cohort, include_target: bool = False) -> DataFrame:
    """(ordinal, variable, value, cnt, first_id); value NULL counts the missing cells."""
    return (long_values(cohort, include_target)
            .groupBy("ordinal", "variable", "value")
            .agg(F.count(F.lit(1)).alias("cnt"), F.min("id").alias("first_id")))


def shared_value_counts(cohort: Cohort) -> DataFrame:
    """``value_counts`` materialized once in the shared checkpoint folder.

    Sections that read it several times (statistics, exact quantiles, outlier
    counts, histograms) then scan this table instead of re-running the
    source plan (scans, joins, the unpivot and its shuffle) for every reader.
    """
    if "vc" not in cohort.cache:
        checkpoint_root(cohort.df.sparkSession)
        cohort.cache["vc"] = value_counts(cohort).checkpoint(eager=True)
    return cohort.cache["vc"]


def column_stats(cohort: Cohort, vc: DataFrame | None = None) -> DataFrame:
    """Per feature: rows, missing, non-null count, distinct, min, max, integral flag."""
    vc = vc if vc is not None else value_counts(cohort)
    stats = vc.groupBy("ordinal", "variable").agg(
        F.sum("cnt").cast("bigint").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("cnt"))), F.lit(0)).cast("bigint").alias("n_missing"),
        F.count("value").cast("bigint").alias("n_distinct"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.count_if(F.col("value").isNotNull() & ~F.col("value").isin(0.0, 1.0)).alias("n_non_binary"),
    )
    flags = [(i, c, isinstance(_dtype(cohort.df, c), INTEGRAL)) for i, c in enumerate(cohort.feature_cols)]
    integral = F.create_map(*[x for i, _, flag in flags for x in (F.lit(i), F.lit(flag))]) if flags else None
    stats = stats.withColumn("n_present", F.col("n_rows") - F.col("n_missing"))
    if integral is not None:
        stats = stats.withColumn("is_integral", integral[F.col("ordinal")])
    return stats


def variable_type_expr() -> F.Column:
    """Rule chain over ``column_stats`` columns."""
    return (
        F.when(F.col("n_non_binary") == 0, F.lit("Binary"))
        .when((F.col("n_distinct") <= LOW_CARDINALITY_THRESHOLD) & F.col("is_integral") & (F.col("n_missing") == 0),
              F.lit("Categorical (Low Cardinality)"))
        .otherwise(F.lit("Continuous"))
    )


def variable_types(cohort: Cohort, stats: DataFrame | None = None) -> DataFrame:
    stats = stats if stats is not None else column_stats(cohort)
    return stats.select("ordinal", "variable", variable_type_expr().alias("type"))


def table_shape(cohort: Cohort) -> DataFrame:
    return cohort.df.agg(F.count(F.lit(1)).cast("bigint").alias("total_rows")).withColumn(
        "total_cols", F.lit(len(cohort.df.columns)).cast("bigint"))


def missing_pct(cohort: Cohort) -> DataFrame:
    """Missing share in percent for the ID, every feature and the target."""
    df = cohort.df
    cols = cohort.columns
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        v = as_double(qcol(c), _dtype(df, c)) if c != cohort.id_col else qcol(c)
        aggs.append(F.count_if(v.isNull()).alias(f"_m{i}"))
    wide = df.agg(*aggs)
    cells = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("variable"),
                               F.col(f"_m{i}").cast("bigint").alias("n_missing")) for i, c in enumerate(cols)])
    return wide.select(F.col("_n").alias("n_rows"), F.inline(cells)).select(
        "ordinal", "variable", "n_missing",
        (ratio(F.col("n_missing"), F.col("n_rows")) * 100).alias("missing_pct"))


def missing_info(cohort: Cohort, stats: DataFrame | None = None) -> DataFrame:
    """Features with missing cells, in feature order, percentage of rows."""
    stats = stats if stats is not None else column_stats(cohort)
    return stats.where(F.col("n_missing") > 0).select(
        "ordinal", "variable", (ratio(F.col("n_missing"), F.col("n_rows")) * 100).alias("percentage"))


def example_values(cohort: Cohort, vc: DataFrame | None = None, k: int = EXAMPLE_VALUES) -> DataFrame:
    """First k distinct non-null values per feature in order of first appearance (by ID)."""
    vc = vc if vc is not None else value_counts(cohort)
    present = vc.where(F.col("value").isNotNull()).select("ordinal", "variable", "value", "first_id")
    return top_k_per_group(present, ["ordinal", "variable"], [F.col("first_id"), F.col("value")], k, "pos").select(
        "variable", "pos", "value")


def distinct_count(cohort: Cohort, stats: DataFrame | None = None) -> DataFrame:
    stats = stats if stats is not None else column_stats(cohort)
    return stats.select("variable", "n_distinct")


def example_text(value: Column) -> Column:
    """A number as text: whole numbers without a fraction, others with at most six places."""
    whole = value == F.floor(value)
    return F.when(whole, F.format_string("%.0f", value)).otherwise(
        F.regexp_replace(F.format_string("%.6f", value), r"0+$", ""))


def variable_info(cohort: Cohort) -> DataFrame:
    """Name, type, missing %, distinct count and example values for the ID, the features and the target.

    Examples are three distinct present values as text, joined by ", ": those of a feature by their first ID, the
    smallest IDs and target values.
    """
    df = cohort.df
    vc = shared_value_counts(cohort)
    stats = column_stats(cohort, vc)
    examples = example_values(cohort, vc).groupBy("variable").agg(
        F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_v"))  # three per feature
    feats = stats.select(
        (F.col("ordinal") + 1).alias("ordinal"), F.col("variable").alias("name"), variable_type_expr().alias("type"),
        (ratio(F.col("n_missing"), F.col("n_rows")) * 100).alias("missing"),
        F.col("n_distinct").alias("distinct_values")).join(
            examples.select(F.col("variable").alias("name"), F.array_join(F.transform("_v", lambda x: example_text(x["value"])), ", ")
                            .alias("examples")), "name", "left").select(
            "ordinal", "name", "type", "missing", "distinct_values", F.coalesce("examples", F.lit("")).alias("examples"))
    idc, tc = qcol(cohort.id_col), qcol(cohort.target_col)
    ends = df.agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(idc.isNull()).alias("_mid"), F.countDistinct(idc).alias("_did"),
        F.count_if(tc.isNull()).alias("_mt"), F.countDistinct(tc).alias("_dt"),
    )

    def lowest(c: Column, name: str) -> DataFrame:
        """One row: the three smallest values as text."""
        few = df.where(c.isNotNull()).select(c.alias("v")).distinct().orderBy("v").limit(EXAMPLE_VALUES)
        return few.agg(F.array_join(F.transform(F.array_sort(F.collect_list("v")), lambda x: x.cast("string")), ", ").alias(name))

    ends = ends.crossJoin(lowest(idc, "_ei")).crossJoin(lowest(tc, "_et"))  # one row each
    nf = len(cohort.feature_cols)
    id_row = ends.select(F.lit(0).alias("ordinal"), F.lit(cohort.id_col).alias("name"), F.lit("ID").alias("type"),
                         (ratio(F.col("_mid"), F.col("_n")) * 100).alias("missing"),
                         F.col("_did").cast("bigint").alias("distinct_values"), F.col("_ei").alias("examples"))
    t_row = ends.select(F.lit(nf + 1).alias("ordinal"), F.lit(cohort.target_col).alias("name"),
                        F.lit("Target").alias("type"), (ratio(F.col("_mt"), F.col("_n")) * 100).alias("missing"),
                        F.col("_dt").cast("bigint").alias("distinct_values"), F.col("_et").alias("examples"))
    return id_row.unionByName(feats).unionByName(t_row)


def target_distribution(cohort: Cohort) -> DataFrame:
    t = qcol(cohort.target_col)
    agg = cohort.df.agg(F.count_if(t == 0).cast("bigint").alias("class0"),
                        F.count_if(t == 1).cast("bigint").alias("class1"))
    total = F.when(F.col("class0") + F.col("class1") == 0, F.lit(1)).otherwise(F.col("class0") + F.col("class1"))
    return agg.select("class0", "class1", ((F.least("class0", "class1") / total) < IMBALANCE_THRESHOLD)
                      .cast("int").alias("imbalance"))


def class_distribution(cohort: Cohort) -> DataFrame:
    """Value counts of the target including missing; labels '0' and '1' always present."""
    t = qcol(cohort.target_col)
    d = _dtype(cohort.df, cohort.target_col)
    if isinstance(d, (T.FloatType, T.DoubleType)):
        label = (F.when(F.isnan(t) | t.isNull(), F.lit("nan"))
                 .when(t == F.floor(t), F.floor(t).cast("string")).otherwise(F.format_string("%.4g", t)))
    else:
        label = F.coalesce(t.cast("string"), F.lit("nan"))
    counts = cohort.df.groupBy(label.alias("label")).agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    base = counts.sparkSession.createDataFrame([("0",), ("1",)], "label string")
    return (counts.join(F.broadcast(base), "label", "full")
            .select("label", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def positive_pct(cohort: Cohort) -> DataFrame:
    t = qcol(cohort.target_col)
    return cohort.df.agg(F.round(100 * F.avg(t.cast("double")), 1).alias("positive_pct"))


# ---------------------------------------------------------------- quantiles
QUARTILES = ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))


def quartiles(cohort: Cohort, vc: DataFrame | None = None, stats: DataFrame | None = None,
              probs=QUARTILES) -> DataFrame:
    """Exact linear-interpolation quantiles per feature (pandas/DuckDB ``quantile_cont``).

    The value at 0-based rank r is the distinct value whose running count
    interval [before, before + cnt) contains r.
    """
    if vc is None:
        # reuse the materialized value counts when a section already made them; a one-off
        # quantile query reads the plan directly
        vc = cohort.cache.get("vc") if "vc" in cohort.cache else value_counts(cohort)
    stats = stats if stats is not None else column_stats(cohort, vc)
    present = vc.where(F.col("value").isNotNull()).select("ordinal", "variable", "value", "cnt")
    ecdf = running_totals(present, ["ordinal"], ["value"], ["cnt"], max_groups=len(cohort.feature_cols))
    n = F.col("n_present")
    targets = []
    for p, name in probs:
        h = (n - 1) * F.lit(p)
        targets.append(F.struct(F.lit(name).alias("q"), h.alias("h"), F.floor(h).cast("bigint").alias("pos")))
        targets.append(F.struct(F.lit(name).alias("q"), h.alias("h"), F.ceil(h).cast("bigint").alias("pos")))
    tgt = (stats.where(n > 0).select(F.col("ordinal").alias("t_ordinal"), F.inline(F.array(*targets)))
           .dropDuplicates(["t_ordinal", "q", "pos"]))
    # at most 6 rows per feature: bounded by the column count, broadcast
    hit = ecdf.join(F.broadcast(tgt), (F.col("ordinal") == F.col("t_ordinal"))
                    & (F.col("cnt_before") <= F.col("pos")) & (F.col("pos") < F.col("cnt_before") + F.col("cnt")))
    per_q = hit.groupBy("ordinal", "variable", "q").agg(
        F.first("h").alias("h"),
        F.min_by("value", "pos").alias("v_lo"), F.max_by("value", "pos").alias("v_hi"),
        F.min("pos").alias("lo"))
    val = F.col("v_lo") + (F.col("h") - F.col("lo")) * (F.col("v_hi") - F.col("v_lo"))
    out = per_q.groupBy("ordinal", "variable").pivot("q", [name for _, name in probs]).agg(F.first(val))
    return out


def _shared_quartiles(cohort: Cohort, vc: DataFrame, stats: DataFrame) -> DataFrame:
    """Default quartiles of a cohort, computed once per cohort value (small: 3 numbers per feature)."""
    if "quartiles" not in cohort.cache:
        cohort.cache["quartiles"] = quartiles(cohort, vc, stats).checkpoint(eager=True)
    return cohort.cache["quartiles"]


def iqr_fences(cohort: Cohort, q: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """Fences for features with more than 15 distinct values and a non-zero IQR."""
    default = q is None and stats is None
    if default and "fences" in cohort.cache:
        return cohort.cache["fences"]
    if q is None or stats is None:
        vc = shared_value_counts(cohort)
        stats = stats if stats is not None else column_stats(cohort, vc)
        q = q if q is not None else _shared_quartiles(cohort, vc, stats)
    iqr = F.col("q3") - F.col("q1")
    fences = (q.join(stats.select("ordinal", "n_distinct"), "ordinal")
              .where((F.col("n_distinct") > LOW_CARDINALITY_THRESHOLD) & (iqr != 0))
              .select("ordinal", "variable", "q1", "q3",
                      (F.col("q1") - FENCE_FACTOR * iqr).alias("lower_bound"),
                      (F.col("q3") + FENCE_FACTOR * iqr).alias("upper_bound")))
    if default:
        cohort.cache["fences"] = fences
    return fences


def outlier_ids(cohort: Cohort, fences: DataFrame | None = None, lv: DataFrame | None = None) -> DataFrame:
    """(ordinal, variable, id) for cells strictly outside the fences; NULL never qualifies."""
    fences = fences if fences is not None else iqr_fences(cohort)
    lv = lv if lv is not None else long_values(cohort)
    f = fences.select(F.col("ordinal").alias("f_ordinal"), "lower_bound", "upper_bound")
    # one row per feature at most: bounded by the column count
    return (lv.join(F.broadcast(f), F.col("ordinal") == F.col("f_ordinal"))
            .where((F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound")))
            .select("ordinal", "variable", "id"))


def outlier_info(cohort: Cohort) -> DataFrame:
    """Variable, outlier count and fences, only for features that have outliers."""
    vc = shared_value_counts(cohort)
    fences = iqr_fences(cohort)
    f = fences.select(F.col("ordinal").alias("f_ordinal"), "lower_bound", "upper_bound")
    # count from the value counts: one row per distinct value, not per cell
    counts = (vc.join(F.broadcast(f), F.col("ordinal") == F.col("f_ordinal"))
              .where((F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound")))
              .groupBy("ordinal").agg(F.sum("cnt").cast("bigint").alias("count")))
    return fences.join(counts, "ordinal").select("ordinal", "variable", "count", "lower_bound", "upper_bound")


def box_plot(cohort: Cohort) -> DataFrame:
    """Median, quartiles, theoretical whiskers and outlier count for features with > 1 distinct value."""
    vc = shared_value_counts(cohort)
    stats = column_stats(cohort, vc)
    q = _shared_quartiles(cohort, vc, stats)
    fences = iqr_fences(cohort).select(F.col("ordinal").alias("f_ordinal"), "lower_bound", "upper_bound")
    out_counts = (vc.join(F.broadcast(fences), F.col("ordinal") == F.col("f_ordinal"))
                  .where((F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound")))
                  .groupBy(F.col("f_ordinal").alias("ordinal")).agg(F.sum("cnt").cast("bigint").alias("n_outliers")))
    iqr = F.col("q3") - F.col("q1")
    return (q.join(stats.select("ordinal", "n_distinct"), "ordinal").where(F.col("n_distinct") > 1)
            .join(out_counts, "ordinal", "left")
            .select("ordinal", "variable", "median", "q1", "q3",
                    (F.col("q1") - FENCE_FACTOR * iqr).alias("lower_whisker"),
                    (F.col("q3") + FENCE_FACTOR * iqr).alias("upper_whisker"),
                    F.coalesce("n_outliers", F.lit(0)).cast("bigint").alias("n_outliers")))


# ---------------------------------------------------------------- histogram
def histogram(cohort: Cohort) -> DataFrame:
    """Equal-width histogram, min(20, distinct) bins, last bin closed; features with > 1 distinct.

    Bin of v: floor((v - lo) * (n / (hi - lo))), then corrected against the
    computed edges the way numpy does, and clipped to the last bin.
    Long output (ordinal, variable, bin, bin_lo, bin_hi, count) with empty bins.
    """
    vc = shared_value_counts(cohort)
    stats = column_stats(cohort, vc)
    st = (stats.where(F.col("n_distinct") > 1)
          .select(F.col("ordinal").alias("s_ordinal"), F.col("min_value").alias("lo"), F.col("max_value").alias("hi"),
                  F.least(F.lit(HISTOGRAM_BINS), F.col("n_distinct")).cast("int").alias("nb")))
    v, lo, hi, nb = F.col("value"), F.col("lo"), F.col("hi"), F.col("nb")
    step = (hi - lo) / nb

    def edge(i):
        return F.when(i >= nb, hi).otherwise(i * step + lo)

    raw = F.floor((v - lo) * (nb / (hi - lo))).cast("int")
    dec = F.when(v < edge(raw), raw - 1).otherwise(raw)
    inc = F.when((v >= edge(dec + 1)) & (dec != nb - 1), dec + 1).otherwise(dec)
    bin_ = F.least(F.greatest(inc, F.lit(0)), nb - 1)
    counts = (vc.where(v.isNotNull()).join(F.broadcast(st), F.col("ordinal") == F.col("s_ordinal"))
              .groupBy("ordinal", bin_.alias("bin")).agg(F.sum("cnt").cast("bigint").alias("count")))
    bins = st.select("s_ordinal", "lo", "hi", "nb", F.explode(F.sequence(F.lit(0), nb - 1)).alias("b"))
    names = stats.select(F.col("ordinal").alias("n_ordinal"), "variable")
    b = F.col("b")
    return (bins.join(counts, (F.col("s_ordinal") == F.col("ordinal")) & (b == F.col("bin")), "left")
            .join(names, F.col("s_ordinal") == F.col("n_ordinal"))
            .select(F.col("s_ordinal").alias("ordinal"), "variable", b.alias("bin"),
                    edge(b).alias("bin_lo"), edge(b + 1).alias("bin_hi"),
                    F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def histogram_labels(hist: DataFrame) -> DataFrame:
    """"lo - hi" labels with two decimals (from values rounded to 2 places)."""
    return hist.select("variable", "bin", F.format_string(
        "%.2f - %.2f", F.round("bin_lo", 2), F.round("bin_hi", 2)).alias("label"), "count")


# ---------------------------------------------------------------- correlation
def _gram_rows(batches: Iterator[pa.RecordBatch], shift: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """Per pair of column blocks: products of values, squares and presence over the rows of this task.

    Per cell (i, j), over rows where both are present: count, sums of i and j, of their squares, of their product.
    """
    d = len(shift)
    starts = range(0, d, block)
    total = {(a, b): np.zeros((6, min(block, d - a), min(block, d - b))) for a in starts for b in starts if a <= b}
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d) - shift
        there = (~np.isnan(x)).astype(float)
        x = np.where(there > 0, x, 0.0)
        square = x * x
        for (a, b), sums in total.items():
            i, j = slice(a, a + block), slice(b, b + block)
            for k, (left, right) in enumerate(((there, there), (x, there), (there, x), (square, there), (there, square), (x, x))):
                sums[k] += left[:, i].T @ right[:, j]
    keys = sorted(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array([a for a, _ in keys], pa.int32()), pa.array([b for _, b in keys], pa.int32()),
         pa.array([total[key].ravel() for key in keys], pa.list_(pa.float64()))], ["a", "b", "sums"])


def correlation_matrix(cohort: Cohort) -> DataFrame:
    """Pearson r for every feature pair (upper triangle), pairwise complete; undefined pairs dropped.

    One scan, however many features: masked products of column blocks per task, summed per block and place.
    """
    df, feats = cohort.df, list(cohort.feature_cols)
    spark, d = df.sparkSession, len(feats)
    if d < 2:
        return spark.createDataFrame([], "i int, j int, var_a string, var_b string, r double")
    ship_package(spark)
    values = df.select(F.array(*[as_double(qcol(c), _dtype(df, c)) for c in feats]).alias("x"))
    # a value near the column's keeps the sums of squares exact; any present value will do
    first = df.agg(*[F.first(as_double(qcol(c), _dtype(df, c)), ignorenulls=True) for c in feats]).first()
    shift = np.array([float(v) if v is not None and math.isfinite(v) else 0.0 for v in first])
    parts = values.mapInArrow(lambda batches: _gram_rows(batches, shift, GRAM_BLOCK), "a int, b int, sums array<double>")
    sums = parts.select("a", "b", F.posexplode("sums").alias("at", "v")).groupBy("a", "b", "at").agg(F.sum("v").alias("v"))
    # place of a value in its block: [kind][row][column]
    rows, cols = F.least(F.lit(GRAM_BLOCK), F.lit(d) - F.col("a")), F.least(F.lit(GRAM_BLOCK), F.lit(d) - F.col("b"))
    kind = F.floor(F.col("at") / (rows * cols)).cast("int")
    cell = F.col("at") % (rows * cols)
    placed = sums.select((F.col("a") + F.floor(cell / cols)).cast("int").alias("i"), (F.col("b") + cell % cols).cast("int").alias("j"),
                         kind.alias("kind"), "v").where("i < j")
    names = ("n", "si", "sj", "sii", "sjj", "sij")
    pair = placed.groupBy("i", "j").agg(*[F.sum(F.when(F.col("kind") == k, F.col("v"))).alias(x) for k, x in enumerate(names)])
    n = F.nullif(F.col("n"), F.lit(0.0))
    cov = F.col("sij") / n - F.col("si") / n * (F.col("sj") / n)
    spread = [F.col(f"s{x}{x}") / n - F.pow(F.col(f"s{x}") / n, F.lit(2)) for x in "ij"]
    # a spread within rounding of its sums is none
    some = [F.when(v > 1e-13 * (F.col(f"s{x}{x}") / n), v) for x, v in zip("ij", spread)]
    r = cov / F.sqrt(some[0] * some[1])
    table = F.array(*[F.lit(c) for c in feats])
    # greatest and least pass over missing numbers: undefined pairs go before
    defined = pair.withColumn("r", r).where(F.col("r").isNotNull() & ~F.isnan("r"))
    return defined.select("i", "j", table[F.col("i")].alias("var_a"), table[F.col("j")].alias("var_b"),
                          F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r"))).alias("r"))


def correlated_pairs(cohort: Cohort, matrix: DataFrame | None = None) -> DataFrame:
    m = matrix if matrix is not None else correlation_matrix(cohort)
    return m.where(F.abs("r") >= CORRELATION_THRESHOLD).select(
        "i", "j", "var_a", "var_b", "r", F.col("var_b").alias("drop_column"))


def issue_count(cohort: Cohort) -> DataFrame:
    """Missing + outlier + correlation findings, and the feature count (columns - 2)."""
    findings = (missing_info(cohort).select("variable")
                .unionByName(outlier_info(cohort).select("variable"))
                .unionByName(correlated_pairs(cohort).select(F.col("var_b").alias("variable"))))
    return findings.agg(F.count(F.lit(1)).cast("bigint").alias("issues")).withColumn(
        "n_features", F.lit(len(cohort.df.columns) - 2).cast("bigint"))
