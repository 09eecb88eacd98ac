"""K-Means clustering of a cohort, the elbow curve and cluster reports.

Every feature (binary ones too) is median-imputed and scaled to unit
population variance.  All runs (ten starts for every k) advance together: the
centroids of all of them are one broadcast, one aggregation per step sums up
each centroid's points, and runs that have settled leave the next pass, so an
elbow takes as many passes as its slowest run takes steps.  Starts are
k-means++ on a bounded sample; the lowest inertia wins (k is clamped to
[1, rows]).  Cluster labels are numbered by the lexicographic order of the
centroids so that equal fits give equal labels.  k = 1 is computed in closed
form: the inertia of one cluster is the sum over features of n times the
population variance of the scaled feature.

Members stay a long (id, cluster) table; nothing is collected per cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cohort import Cohort
from ..functions.numeric import qcol
from ..session import ship_package, spread
from .prep import fit_preparation
from .sums import added, tasks_of

N_INIT = 10
SEED = 42
MAX_ELBOW_K = 10
MAX_ITER = 300
#: Rows that the starts are drawn from, and rows that are worked on at once in a task.
START_ROWS, SLAB = 5_000, 256


@dataclass
class KMeansFit:
    k: int
    cost: float
    assignments: DataFrame   # (id, target, cluster)
    centers: list


@dataclass
class Restart:
    """One run of Lloyd's steps: centroids, and the inertia of the last assignment to them."""

    k: int
    seed: int
    centers: np.ndarray
    cost: float = math.inf
    done: bool = False


def prepared_points(cohort: Cohort) -> tuple[DataFrame, list[str]]:
    """(id, target, x) with all features imputed and scaled, and the features' names."""
    cohort.require_features()
    # written once: the fit's passes and those over the points read rows, none joins them again
    cohort = cohort.with_df(spread(cohort.df.select(*map(qcol, cohort.columns)), "cohort"))
    prep = fit_preparation(cohort, scale_all=True)
    base = cohort.df.withColumnRenamed(cohort.id_col, "id").withColumnRenamed(cohort.target_col, "target")
    data = prep.transform(base, "id", ["target"])
    cols = list(prep.output_cols)
    return data.select("id", "target", F.array(*[qcol(c) for c in cols]).alias("x")), cols


def _points(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width) if len(column) else np.empty((0, width))


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all centroids."""
    return np.maximum((x * x).sum(1)[:, None] + (centers * centers).sum(1) - 2.0 * (x @ centers.T), 0.0)


class _SlabSums:
    """Per centroid of every run: points, summed squared distances, summed coordinates; the first centroid on ties.

    Runs of the same k lie next to each other and are compared together, in arrays that are made once.
    """

    def __init__(self, starts: np.ndarray, centers: np.ndarray):
        self.starts, self.centers, self.arrays = starts, centers, {}
        # squared distances less the point's own square: one product for all runs, centroids as rows
        self.left = np.concatenate([-2.0 * centers, (centers * centers).sum(1)[:, None]], 1)
        sizes, edges = np.diff(starts), [0]
        edges += [i for i in range(1, len(sizes)) if sizes[i] != sizes[i - 1]] + [len(sizes)]
        self.alike = [(i, j, int(sizes[i])) for i, j in zip(edges, edges[1:]) if j > i]
        self.sums, self.cost = np.zeros((len(centers), centers.shape[1] + 1)), np.zeros(len(sizes))

    def add(self, x: np.ndarray) -> None:
        n = len(x)
        if n not in self.arrays:
            self.arrays = {} if len(self.arrays) > 3 else self.arrays
            total, runs = len(self.centers), len(self.cost)
            self.arrays[n] = (np.ones((x.shape[1] + 1, n)), np.empty((total, n)), np.empty((total, n), bool),
                              np.empty((total, n)), np.empty((runs, n)))
        ones, far, nearest, hot, near = self.arrays[n]
        ones[:-1] = x.T
        np.matmul(self.left, ones, out=far)
        for i, j, k in self.alike:
            rows = slice(self.starts[i], self.starts[j])
            part, mark = far[rows].reshape(j - i, k, n), nearest[rows].reshape(j - i, k, n)
            np.minimum.reduce(part, axis=1, out=near[i:j])
            np.equal(part, near[i:j, None], out=mark)
            if np.count_nonzero(mark) != (j - i) * n:
                np.equal(part.argmin(1)[:, None], np.arange(k)[:, None], out=mark)
        hot[...] = nearest
        self.sums += hot @ ones.T
        near += (x * x).sum(1)
        self.cost += np.maximum(near, 0.0, out=near).sum(1)

    def total(self) -> np.ndarray:
        out = np.zeros((len(self.centers), 2 + self.centers.shape[1]))
        out[:, 0], out[:, 2:] = self.sums[:, -1], self.sums[:, :-1]
        out[self.starts[:-1], 1] = self.cost  # only a run's whole cost is read
        return out


def _slab_sums(x: np.ndarray, starts: np.ndarray, centers: np.ndarray) -> np.ndarray:
    sums = _SlabSums(starts, centers)
    sums.add(x)
    return sums.total()


def _slab_sums_of_any(x: np.ndarray, starts: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """``_slab_sums`` for points with cells that are no numbers: they reach their own centroid's sums only."""
    total, far = np.zeros((len(centers), 2 + centers.shape[1])), _distances(x, centers)
    for a, b in zip(starts, starts[1:]):
        nearest = a + far[:, a:b].argmin(1)
        total[:, 0] += np.bincount(nearest, minlength=len(total))
        total[:, 1] += np.bincount(nearest, far[np.arange(len(x)), nearest], len(total))
        for j in range(x.shape[1]):
            total[:, 2 + j] += np.bincount(nearest, x[:, j], len(total))
    return total


def _lloyd_rows(batches: Iterator[pa.RecordBatch], starts: np.ndarray, centers: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per centroid of every run: points, summed squared distances (they add up to a run's), summed coordinates."""
    total = np.zeros((len(centers), 2 + centers.shape[1]))
    whole, sums = np.isfinite(centers).all(), _SlabSums(starts, centers)
    for batch in batches:
        points = _points(batch.column(0), centers.shape[1])
        for at in range(0, len(points), SLAB):
            x = points[at:at + SLAB]
            if whole and np.isfinite(x).all():
                sums.add(x)
            else:
                total += _slab_sums_of_any(x, starts, centers)
    total += sums.total()
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(total), dtype=np.int32)),
         pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1, dtype=np.int32) * total.shape[1]), pa.array(total.ravel()))],
        ["center", "sums"])


def _spread_start(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++: each further centroid is a sampled point, drawn by its squared distance to the nearest one so far."""
    rng = np.random.default_rng([SEED, k, seed])
    chosen = [int(rng.integers(len(sample)))]
    near = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        at = int(rng.choice(len(sample), p=near / near.sum())) if near.sum() > 0 else int(rng.integers(len(sample)))
        chosen.append(at)
        near = np.minimum(near, ((sample - sample[at]) ** 2).sum(1))
    return sample[chosen].copy()


def lloyd(points: DataFrame, runs: Sequence[Restart], max_iter: int = MAX_ITER, tol: float = 1e-4) -> int:
    """Moves the centroids of all runs together, one aggregation of ``points`` (x) per step; the number of passes.

    A run is done once no centroid moves by more than ``tol``; a centroid without points stays where it is.  The last pass
    of a run only measures its cost, so that the cost is that of the centroids returned.
    """
    spark, passes, tasks = points.sparkSession, 0, tasks_of(points)
    ship_package(spark)
    settled: set[int] = set()
    while passes < max_iter + 1:
        open_ = [r for r in runs if not r.done]
        if not open_:
            break
        starts = np.cumsum([0] + [r.k for r in open_])
        held = spark.sparkContext.broadcast((starts, np.concatenate([r.centers for r in open_])))
        partial = points.select("x").mapInArrow(lambda b, held=held: _lloyd_rows(b, *held.value), "center int, sums array<double>")
        sums = added(partial, tasks, int(starts[-1]), 2 + open_[0].centers.shape[1])
        held.unpersist()
        passes += 1
        for r, a, b in zip(open_, starts, starts[1:]):
            own = sums[a:b]
            r.cost = float(own[:, 1].sum())
            if id(r) in settled or passes == max_iter + 1:
                r.done = True
                continue
            moved = np.where(own[:, :1] > 0, own[:, 2:] / np.maximum(own[:, :1], 1.0), r.centers)
            if ((moved - r.centers) ** 2).sum(1).max() <= tol * tol:
                settled.add(id(r))
            r.centers = moved
    return passes


def fit_runs(data: DataFrame, ks: Sequence[int], n_init: int = N_INIT) -> dict[int, Restart]:
    """The cheapest of ``n_init`` runs for every k; all runs of all k advance together."""
    some = data.orderBy(F.xxhash64("id"), "id").limit(START_ROWS).select("x").toArrow()  # a bounded sample for the starts
    sample = _points(pa.concat_arrays(some["x"].chunks), len(some["x"][0])) if some.num_rows else np.empty((0, 0))
    runs = [Restart(k, seed, _spread_start(sample, k, seed)) for k in ks for seed in range(n_init)]
    lloyd(data, runs)
    return {k: min((r for r in runs if r.k == k), key=lambda r: (r.cost, r.seed)) for k in ks}


def one_cluster_inertia(data: DataFrame, width: int) -> float:
    row = data.agg(F.count(F.lit(1)).alias("n"), *[F.var_pop(F.col("x")[i]).alias(f"v{i}") for i in range(width)]).first()
    return float(sum((row[f"v{i}"] or 0.0) for i in range(width)) * row["n"])


def assigned(data: DataFrame, centers: Sequence[Sequence[float]]) -> DataFrame:
    """(id, target, cluster): the nearest of fixed centroids, the first one on ties."""
    held = np.array(centers, float)

    def nearest(column: pa.Array) -> pa.Array:
        x = _points(column, held.shape[1])
        far = np.stack([((x - c) ** 2).sum(1) for c in held], 1)
        return pa.array(far.argmin(1).astype(np.int32))

    ship_package(data.sparkSession)
    return data.select("id", "target", F.arrow_udf(nearest, "int")(F.col("x")).alias("cluster"))


def prefix_inertia(data: DataFrame, centers: Sequence[Sequence[float]]) -> list[float]:
    """Inertia of the assignment to the first k of some fixed centroids, for every k, from one pass."""
    runs = [Restart(k, 0, np.array(centers[:k], float)) for k in range(1, len(centers) + 1)]
    lloyd(data, runs, max_iter=0)
    return [r.cost for r in runs]


def kmeans(cohort: Cohort, k: int, n_init: int = N_INIT, parallelism: int = 4) -> KMeansFit:
    data, cols = prepared_points(cohort)
    data = spread(data, "points")  # read by every pass
    n = data.count()
    k = max(1, min(int(k), n))
    if k == 1:
        return KMeansFit(1, one_cluster_inertia(data, len(cols)), data.select("id", "target", F.lit(0).alias("cluster")), [])
    best = fit_runs(data, [k], n_init)[k]
    centers = sorted(list(map(float, c)) for c in best.centers)
    return KMeansFit(k, best.cost, assigned(data, centers), centers)


def kmeans_elbow(cohort: Cohort, max_k: int = MAX_ELBOW_K, n_init: int = N_INIT, parallelism: int = 4) -> DataFrame:
    """(k, inertia) for k = 1 .. min(max_k, rows); the runs of all k share their passes."""
    data, cols = prepared_points(cohort)
    data = spread(data, "points")
    n = data.count()
    best = fit_runs(data, list(range(2, min(max_k, n) + 1)), n_init)
    rows = [(1, one_cluster_inertia(data, len(cols)))] + [(k, r.cost) for k, r in best.items()]
    return cohort.df.sparkSession.createDataFrame(rows, "k int, inertia double")


def suggest_k(elbow: DataFrame) -> DataFrame:
    """k with the largest positive second difference of inertia; 2 without one; first wins ties."""
    w = Window.orderBy("k")  # the elbow table has at most ten rows
    d = elbow.select("k", "inertia", F.lag("inertia").over(w).alias("prev"), F.lead("inertia").over(w).alias("next"))
    diff = (F.col("prev") - F.col("inertia")) - (F.col("inertia") - F.col("next"))
    cand = d.where(F.col("prev").isNotNull() & F.col("next").isNotNull()).select("k", diff.alias("diff"))
    best = cand.where(F.col("diff") > 0).orderBy(F.col("diff").desc(), "k").limit(1)
    fallback = elbow.sparkSession.createDataFrame([(2, None)], "k int, diff double")
    return best.unionByName(fallback).orderBy(F.col("diff").desc_nulls_last()).limit(1).select(
        F.col("k").alias("suggested_k"))


def cluster_analysis(assignments: DataFrame, k: int) -> DataFrame:
    """(cluster, count, positive_rate) for clusters 0..k-1; empty clusters give 0 and 0.0."""
    per = assignments.groupBy("cluster").agg(F.count(F.lit(1)).cast("bigint").alias("count"),
                                             F.avg(F.col("target").cast("double")).alias("positive_rate"))
    all_k = assignments.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
    return all_k.join(per, "cluster", "left").select(
        "cluster", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
        F.coalesce("positive_rate", F.lit(0.0)).alias("positive_rate"))


def cluster_members(assignments: DataFrame) -> DataFrame:
    return assignments.select("cluster", "id")


def clusters_csv_rows(assignments: DataFrame) -> DataFrame:
    """Rows of the cluster export: Cluster, ID as text."""
    return assignments.select(F.col("cluster").cast("string").alias("Cluster"), F.col("id").cast("string").alias("ID"))


def cluster_request(cohort: Cohort, parallelism: int = 4, max_k: int = MAX_ELBOW_K):
    """K-Means as a result of a training request: elbow, suggested k, assignments."""
    from .grids import KMEANS
    from .search import ModelResult

    elbow = kmeans_elbow(cohort, max_k, parallelism=parallelism)
    k = suggest_k(elbow).first()["suggested_k"]
    fit = kmeans(cohort, k, parallelism=parallelism)
    return ModelResult(KMEANS, {"n_clusters": fit.k}, {"n_clusters": fit.k, "n_init": N_INIT}, fit.assignments, elbow)
