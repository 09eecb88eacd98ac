"""Running totals over an ordered table without a global window.

``Window.orderBy`` without ``partitionBy`` (or partitioned by a key that holds
a third of the rows) pulls everything into one task.  This module computes
exclusive running sums in two levels, in DataFrame operations only:

1. range-partition on (group, order) and write the rows with the number of
   their range to the shared scratch folder: the ranges are fixed from then on,
   even if executors are lost and tasks re-run;
2. a window over each (range, group), whose size the ranges bound, gives the
   sums inside it;
3. the totals per (range, group), at most ``ranges + groups`` rows, are summed
   by a second window and joined back as offsets.

No value passes through Python, so every column keeps its type and its bits.
Callers aggregate to unique (group, order) keys first (value counts, score
counts) or add a unique tie-breaker, so equal keys never split a hot value
across tasks and the order is total.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import num_partitions, scratch_path

# The offsets table has one row per (range, group); above this many rows it is
# joined with a shuffle instead of being broadcast (the result is the same).
BROADCAST_OFFSET_ROWS = 200_000


def running_totals(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str | tuple[str, bool]],
    weight_cols: Sequence[str],
    suffix: str = "_before",
    max_groups: int | None = None,
) -> DataFrame:
    """Add ``<w><suffix>`` = sum of ``w`` over earlier rows of the same group.

    ``order_cols`` items are names (ascending) or ``(name, descending)``.
    Integral weights give BIGINT sums, others DOUBLE.  ``max_groups`` is a
    caller-proven bound on the number of groups (features, models x folds,
    classes); with it the size of the offsets table is known without a job.
    """
    spark = df.sparkSession
    groups = list(group_cols)
    orders = [(o, False) if isinstance(o, str) else (o[0], bool(o[1])) for o in order_cols]
    inside = [F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_first() for c, d in orders]
    n_ranges = num_partitions(spark)
    ranged = df.repartitionByRange(n_ranges, *[F.col(g).asc_nulls_first() for g in groups], *inside)
    path = scratch_path(spark, "ranges")
    ranged.withColumn("_range", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)

    kind = {w: "bigint" if isinstance(df.schema[w].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
            else "double" for w in weight_cols}
    amount = {w: F.coalesce(F.col(w).cast(kind[w]), F.lit(0)) for w in weight_cols}
    zero = {w: F.lit(0).cast(kind[w]) for w in weight_cols}
    local = Window.partitionBy("_range", *groups).orderBy(*inside).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_range", *groups).agg(*[F.sum(amount[w]).alias(f"_sum_{w}") for w in weight_cols])
    offsets = totals.select(
        F.col("_range").alias("_o_range"), *[F.col(g).alias(f"_o_{g}") for g in groups],
        *[F.coalesce(F.sum(f"_sum_{w}").over(earlier), zero[w]).alias(f"_off_{w}") for w in weight_cols])
    if max_groups is not None or not groups:
        n_offsets = n_ranges + (max_groups or 1)  # a range spans consecutive groups
    else:
        n_offsets = offsets.count()
    right = F.broadcast(offsets) if n_offsets <= BROADCAST_OFFSET_ROWS else offsets
    same = F.col("_range") == F.col("_o_range")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    summed = rows.select("*", *[F.coalesce(F.sum(amount[w]).over(local), zero[w]).alias(f"_in_{w}") for w in weight_cols])
    return summed.join(right, same, "left").select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.col(f"_in_{w}") + F.coalesce(F.col(f"_off_{w}"), zero[w])).alias(f"{w}{suffix}") for w in weight_cols])
