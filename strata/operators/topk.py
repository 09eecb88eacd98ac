"""Top-k rows per group.

``row_number() <= k`` over the group: Spark plans a group limit before the
shuffle, so every map task sends at most k rows of a group, however large the
group is.  Without groups ``orderBy().limit(k)`` (a per-partition top-k followed
by a merge) is used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], k: int,
                    rank_col: str = "rank") -> DataFrame:
    groups = list(group_cols)
    if not groups:
        ranked = df.orderBy(*order).limit(k)
        return ranked.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)).cast("int"))
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn(rank_col, place).where(F.col(rank_col) <= k).withColumn(rank_col, F.col(rank_col).cast("int"))
