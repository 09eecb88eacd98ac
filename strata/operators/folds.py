"""Stratified k folds, fold count and fold split.

Fold assignment is a deterministic shuffle: within each class, rows are
ordered by ``md5('<seed>:<id>')`` (ties by ID) and dealt round robin to the k
folds.  The row number inside a class is made of two parts: the rows of the
class in lower buckets (a bucket is the first four hex digits of the hash; one
table of at most 65,536 counts per class) and the row number inside the bucket.
A class that holds most of the rows is thus spread over all tasks, and the only
shuffle of whole rows is the one on (class, bucket).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_FOLDS = 10
BUCKET_DIGITS = 4


def fold_count(df: DataFrame, target_col: str, max_folds: int = MAX_FOLDS) -> DataFrame:
    """One row: smallest class, rows, k = min(smallest class, rows, 10), ok flag."""
    counts = df.groupBy(target_col).agg(F.count(F.lit(1)).alias("n"))
    agg = counts.agg(
        F.min("n").cast("bigint").alias("smallest_class"),
        F.sum("n").cast("bigint").alias("n_rows"),
        F.count(F.lit(1)).cast("bigint").alias("n_classes"),
    )
    k = F.least(F.col("smallest_class"), F.col("n_rows"), F.lit(max_folds))
    return agg.select(
        "smallest_class", "n_rows", "n_classes",
        k.cast("int").alias("k"),
        ((k >= 2) & (F.col("n_classes") >= 2)).cast("int").alias("ok"),
    )


def resolve_fold_count(df: DataFrame, target_col: str, max_folds: int = MAX_FOLDS) -> int:
    """k as a Python int; raises when a class has fewer than two rows or only one class exists."""
    row = fold_count(df, target_col, max_folds).first()
    if row is None or row["ok"] != 1:
        raise ValueError("Each class must contain at least two observations to perform stratified cross-validation.")
    return int(row["k"])


def stratified_folds(df: DataFrame, id_col: str, target_col: str, k: int, seed: int = 42,
                     offset_classes: bool = True, fold_col: str = "fold") -> DataFrame:
    """Add ``fold`` in [0, k).

    With ``offset_classes`` the round robin continues from one class into the
    next (so fold sizes differ by at most one overall); without it every class
    starts at fold 0.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    bucket = F.conv(F.substring(h, 1, BUCKET_DIGITS), 16, 10).cast("int")
    counts = df.groupBy(F.col(target_col).alias("_class"), bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    # the hash (32 random characters) and the offsets are added behind the shuffle, which the window uses as it is
    keyed = df.withColumn("_bucket", bucket).repartition(target_col, "_bucket").withColumn("_h", h)
    # at most classes x 16^BUCKET_DIGITS small rows: one window, then a broadcast
    before = Window.orderBy("_class", "_b") if offset_classes else Window.partitionBy("_class").orderBy("_b")
    offsets = counts.select("_class", "_b", F.coalesce(
        F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(target_col, "_bucket").orderBy("_h", id_col)
    same = keyed[target_col].eqNullSafe(offsets["_class"]) & (keyed["_bucket"].eqNullSafe(offsets["_b"]))
    place = F.col("_before") + F.row_number().over(inside) - 1
    return keyed.join(F.broadcast(offsets), same).withColumn(fold_col, (place % k).cast("int")).drop(
        "_h", "_bucket", "_class", "_b", "_before")


def fold_split(df: DataFrame, fold: int, fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(train, test) rows for one fold; a filter on the stored fold column, no join."""
    return df.where(F.col(fold_col) != fold), df.where(F.col(fold_col) == fold)
