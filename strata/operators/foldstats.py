"""Statistics of "all rows except fold f" for every fold in one pass.

Per (feature, distinct value) the number of rows outside every fold is kept (k
columns); their running sums over the sorted values give,
for all k training sets and all features at once, the exact ECDF, hence exact
medians.  Only the few values around the overall median are sorted; those below
them are a number per feature and training set.  No per-fold or per-feature jobs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import running_totals


#: Half the share of the values around the overall median that is looked through first, and the precision of its ends.
NEAR, PRECISION = 0.01, 2000


def leave_out_medians(df: DataFrame, value_cols: Sequence[str], left_out: Sequence[Column]) -> DataFrame:
    """(variable, fold, median) per condition ``left_out[fold]``: over the rows for which it does not hold.

    Linear interpolation, every column and condition at once.  Only values near the overall median are counted one by one,
    the smaller and larger ones as two numbers per column and condition; a column whose median lies elsewhere for any
    condition is counted whole.
    """
    out = df.select(*[c.alias(f"_out{f}") for f, c in enumerate(left_out)],
                    *[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(f"_v{i}") for i, c in enumerate(value_cols)])
    ends = out.agg(*[F.percentile_approx(f"_v{i}", [0.5 - NEAR, 0.5 + NEAR], PRECISION).alias(f"e{i}")
                     for i in range(len(value_cols))]).first()
    near = {i: tuple(ends[f"e{i}"]) for i in range(len(value_cols)) if ends[f"e{i}"]}
    counts = []
    for i, (low, high) in near.items():
        v = F.col(f"_v{i}")
        counts += [F.count(v).alias(f"n{i}"), F.count_if(v < low).alias(f"below{i}"), F.count_if(v.between(low, high)).alias(f"in{i}")]
    # rows for which the same conditions hold are counted together: a row per fold (and inner fold)
    kept = F.array(*[F.coalesce(~F.col(f"_out{f}"), F.lit(False)) for f in range(len(left_out))])
    n = out.groupBy(kept.alias("kept")).agg(*counts).collect() if counts else []
    sizes, found, bounds = [], [], {}
    for i, name in enumerate(value_cols):
        if i not in near:  # no value at all
            continue
        own = []
        for f in range(len(left_out)):
            total, below, inside = (sum(r[f"{what}{i}"] for r in n if r["kept"][f]) for what in ("n", "below", "in"))
            own.append((name, f, total, below, not total or below <= (total - 1) // 2 and total // 2 < below + inside))
        if all(ok for *_, ok in own):
            bounds[name] = near[i]
        else:
            own = [(name, f, total, 0, True) for name, f, total, _, _ in own]
        sizes += [(name, f, total, below) for name, f, total, below, _ in own if total]
        found.append(name)
    return _medians_of(out, [(c, f"_v{i}") for i, c in enumerate(value_cols) if c in found], bounds, len(left_out), sizes)


def _medians_of(out: DataFrame, columns: Sequence[tuple[str, str]], bounds: Mapping[str, tuple[float, float]], k: int,
                sizes: Sequence[tuple[str, int, int, int]]) -> DataFrame:
    """Medians from the values inside ``bounds`` (without: all); ``sizes``: (variable, fold, values, smaller ones left aside)."""
    spark = out.sparkSession
    if not sizes:
        return spark.createDataFrame([], "variable string, fold int, median double")
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), (F.when(F.col(v).between(*bounds[c]), F.col(v)) if c in bounds
                                                             else F.col(v)).alias("value")) for c, v in columns])
    long = out.select(*[f"_out{f}" for f in range(k)], F.inline(cells))
    w = long.where(F.col("value").isNotNull()).groupBy("variable", "value").agg(
        *[F.count_if(~F.col(f"_out{f}")).alias(f"w{f}") for f in range(k)])
    rt = running_totals(w, ["variable"], ["value"], [f"w{f}" for f in range(k)], max_groups=len(columns))
    # at most 2 rows per feature and condition, whatever the rows: broadcast
    tgt = spark.createDataFrame([(c, f, (n - 1) * 0.5, pos, below) for c, f, n, below in sizes
                                 for pos in sorted({(n - 1) // 2, n // 2})],
                                "t_var string, t_fold int, h double, pos bigint, below bigint")
    per_fold = rt.select("variable", "value", F.inline(F.array(*[
        F.struct(F.lit(f).alias("fold"), F.col(f"w{f}").alias("w"), F.col(f"w{f}_before").alias("before"))
        for f in range(k)])))
    before = F.col("before") + F.col("below")
    hit = per_fold.join(F.broadcast(tgt), (F.col("variable") == F.col("t_var")) & (F.col("fold") == F.col("t_fold"))
                        ).where((before <= F.col("pos")) & (F.col("pos") < before + F.col("w")))
    per = hit.groupBy("variable", "fold").agg(
        F.first("h").alias("h"), F.min("pos").alias("lo"),
        F.min_by("value", "pos").alias("v_lo"), F.max_by("value", "pos").alias("v_hi"))
    return per.select("variable", F.col("fold").cast("int").alias("fold"),
                      (F.col("v_lo") + (F.col("h") - F.col("lo")) * (F.col("v_hi") - F.col("v_lo"))).alias("median"))


def leave_fold_out_medians(df: DataFrame, value_cols: Sequence[str], fold_col: str, k: int) -> DataFrame:
    """(variable, fold, median) over the rows outside each fold."""
    return leave_out_medians(df, value_cols, [F.col(f"`{fold_col}`") == f for f in range(k)])


def leave_fold_out_median(df: DataFrame, value_col: str, fold_col: str, k: int) -> DataFrame:
    """(fold, median) for one column."""
    return leave_fold_out_medians(df, [value_col], fold_col, k).select("fold", "median")
