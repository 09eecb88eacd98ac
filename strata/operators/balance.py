"""Class balancing of training rows (after preparation, before the learner).

Draws are deterministic: ``u(seed, stream, j)`` is the first 32 bits of
``md5('<seed>:<stream>:<j>')`` over 2^32.  Minority rows are indexed
0..m-1 in ID order by ``running_totals`` (no single-task window); draw j picks
row ``floor(u * m)``.  The draws are a generated range of length
majority - minority, equi-joined to the indexed minority rows.

* random oversampling: the picked rows are copied;
* SMOTE (k = 1): the synthetic row is x + u' * (nn(x) - x) with nn(x) the
  nearest other minority row (exact, see ``knn``), for every feature
  including binary ones;
* fewer than two minority rows: SMOTE falls back to oversampling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cohort import Cohort
from ..functions.numeric import qcol, unit_draw
from .prefix import running_totals

STREAM_PICK = "pick"
STREAM_GAP = "gap"


def class_sizes(cohort: Cohort) -> tuple[int, int, int, int]:
    """(minority label, minority size, majority label, majority size); smaller label on equal sizes."""
    rows = cohort.df.groupBy(qcol(cohort.target_col).alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()
    rows = sorted(((r["n"], r["t"]) for r in rows if r["t"] is not None))  # at most two classes
    if len(rows) < 2:
        raise ValueError("balancing needs two classes")
    (m, lab_min), (big, lab_max) = rows[0], rows[-1]
    if m == big:
        lab_min, lab_max = min(lab_min, lab_max), max(lab_min, lab_max)
    return lab_min, m, lab_max, big


def indexed_minority(cohort: Cohort, label) -> DataFrame:
    minority = cohort.df.where(qcol(cohort.target_col) == F.lit(label)).withColumn("_one", F.lit(1).cast("bigint"))
    ranked = running_totals(minority, [], [cohort.id_col], ["_one"])
    return ranked.withColumnRenamed("_one_before", "_idx").drop("_one")


def draws(spark, n: int, m: int, seed: int) -> DataFrame:
    """(draw, _idx, _gap) for draw = 0..n-1."""
    j = F.col("id")
    return spark.range(n).select(
        j.alias("draw"),
        F.floor(unit_draw(F.lit(str(seed)), F.lit(STREAM_PICK), j) * m).cast("bigint").alias("_idx"),
        unit_draw(F.lit(str(seed)), F.lit(STREAM_GAP), j).alias("_gap"))


def random_oversample(cohort: Cohort, seed: int = 42) -> DataFrame:
    """Original rows (draw = -1) plus copies of drawn minority rows (draw = 0..)."""
    lab_min, m, _, big = class_sizes(cohort)
    base = cohort.df.withColumn("draw", F.lit(-1).cast("bigint"))
    if big == m:
        return base
    idx = indexed_minority(cohort, lab_min)
    d = draws(cohort.df.sparkSession, big - m, m, seed)
    copies = d.join(idx, "_idx").select(*[qcol(c) for c in cohort.df.columns], "draw")
    return base.unionByName(copies)


def smote(cohort: Cohort, feature_cols, seed: int = 42, k: int = 1) -> DataFrame:
    """Original rows (draw = -1) plus synthetic minority rows x + u * (nn(x) - x) (draw = 0..).

    ``nn(x)`` is x's nearest other minority row (exact k-NN join, the k-th
    neighbour with k = 1 by default); features must be prepared (no NULL).
    Synthetic rows have a NULL ID.  Fewer than two minority rows fall back to
    random oversampling.
    """
    from .knn import knn_join

    lab_min, m, _, big = class_sizes(cohort)
    if m < 2:
        return random_oversample(cohort, seed)
    base = cohort.df.withColumn("draw", F.lit(-1).cast("bigint"))
    if big == m:
        return base
    feats = list(feature_cols)
    vec = F.array(*[qcol(c).cast("double") for c in feats])
    idx = indexed_minority(cohort, lab_min).select(F.col(cohort.id_col).alias("id"), "_idx", vec.alias("vec"))
    nn = knn_join(idx.select("id", "vec"), idx.select("id", "vec"), k, exclude_self=True).where(F.col("rank") == k)
    d = draws(cohort.df.sparkSession, big - m, m, seed)
    picked = (d.join(idx, "_idx").join(nn.select(F.col("qid").alias("id"), "rid"), "id")
              .join(idx.select(F.col("id").alias("rid"), F.col("vec").alias("nvec")), "rid"))
    synth = F.zip_with("vec", "nvec", lambda x, y: x + F.col("_gap") * (y - x))
    out = picked.select("draw", F.col("id").alias("base_id"), "rid", synth.alias("_s"))
    cols = [F.lit(None).cast(cohort.df.schema[cohort.id_col].dataType).alias(cohort.id_col)]
    cols += [F.col("_s")[i].alias(c) for i, c in enumerate(feats)]
    cols += [F.lit(lab_min).cast(cohort.df.schema[cohort.target_col].dataType).alias(cohort.target_col)]
    synthetic = out.select(*cols, "draw", "base_id", "rid")
    return base.withColumn("base_id", F.lit(None).cast(synthetic.schema["base_id"].dataType)).withColumn(
        "rid", F.lit(None).cast(synthetic.schema["rid"].dataType)).unionByName(synthetic)
