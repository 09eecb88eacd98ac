"""Forests and boosted trees of all folds and candidates, one task per fold and different growth.

A tree fit reads its rows hundreds of times, so a pass over a table for every level of every tree is mostly waiting.  Here
a row is a byte per feature (its place among at most ``BINS`` bins, cut as in Spark ML: between neighbouring values of at
most ``CUT_ROWS`` rows) and a task holds all rows of a cohort (of 7 features: some 130 bytes a row with what a boosted fit
keeps beside them, 250 a forest); tables of more than ``HELD_CELLS`` cells are left to Spark ML fits.  The rows are cut and
written once per fold plan.

Candidates that only stop earlier than another one are read off its growth, which changes none of their scores:

* boosting: the first n trees of a longer run are the run of n trees;
* forest: a tree's draws depend on its number alone, so the first n trees are the forest of n, and a tree cut at a depth is
  the tree of that depth (its splits above do not depend on those below).

Both grow the same trees: splits by the largest fall of the squared error (for 0/1 labels that is half the Gini impurity),
means as leaves.  Boosting follows ``GBTClassifier``: the first tree is fitted to labels -1 / 1 and enters whole, the others
to the slopes of log(1 + exp(-2 y F)) and enter by the learning rate; the score is 1 / (1 + exp(-2 F)).  A forest weighs
rows by a Poisson(1) draw per tree, tries ceil(sqrt(features)) features per node and averages the leaves' class shares.
Draws are hashes of a row's ID, so they do not depend on how the rows lie.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import qcol
from ..session import scratch_path, ship_package

BINS, CUT_ROWS = 32, 10_000
#: Rows times features that one task may hold.
HELD_CELLS = 1 << 24
MISSING = 255
SEED = 42


@dataclass(frozen=True)
class Growth:
    """``kind`` boost or forest; ``share`` of the rows (boosting) and ``features`` of a node that are drawn (0: the root of all)."""

    kind: str
    depth: int
    rate: float = 0.1
    share: float = 1.0
    features: float = 1.0
    least: float = 1.0


@dataclass(frozen=True)
class Stop:
    """A candidate: its growth read off after ``trees`` trees, cut at ``depth``."""

    growth: Growth
    trees: int
    depth: int


def grown_together(stops: Sequence[Stop]) -> dict[Growth, list[int]]:
    """Places of the candidates by the growth that they are read off; a forest's depths are one growth, the deepest."""
    deepest = max(s.depth for s in stops)
    out: dict[Growth, list[int]] = defaultdict(list)
    for i, s in enumerate(stops):
        g = s.growth
        out[Growth(g.kind, deepest, g.rate, g.share, g.features, g.least) if g.kind == "forest" else g].append(i)
    return dict(out)


# ---------------------------------------------------------------- one tree
def cut_points(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """At most ``bins`` - 1 thresholds between neighbouring values: all of them, or those that deal the rows out evenly."""
    values, counts = np.unique(values[np.isfinite(values)], return_counts=True)
    middle = (values[1:] + values[:-1]) / 2.0
    if len(middle) < bins:
        return middle
    stride, below = counts.sum() / bins, np.cumsum(counts)
    out, target, before = [], stride, below[0]
    for at in range(1, len(values)):
        if abs(before - target) < abs(below[at] - target):
            out.append(middle[at - 1])
            target += stride
        before = below[at]
    return np.array(out[:bins - 1])


def grow(bins: np.ndarray, target: np.ndarray, weight: np.ndarray, depths: Sequence[int], least: float = 1.0,
         tried: int = 0, rng: np.random.Generator | None = None) -> np.ndarray:
    """Values of all rows in the tree cut at each of ``depths``, fitted to the rows with weight.

    ``bins`` is features x rows; ``tried`` features are drawn per node (0: all).
    """
    p, n = bins.shape
    wide = int(bins.max(initial=0)) + 1
    out = np.empty((len(depths), n))
    rows, b, w, s = np.arange(n), bins, weight, weight * target
    node, total = np.zeros(n, np.int64), w.sum()
    value = np.array([s.sum() / total if total else 0.0])
    for level in range(max(depths) + 1):
        k = len(value)  # rows of finished nodes that were not yet taken out have number k
        for i, d in enumerate(depths):
            if d == level:
                live = node < k
                out[i, rows[live]] = value[node[live]]
        if level == max(depths) or not k or not len(rows):
            break
        base = node * wide
        if tried and tried < p:
            offered = np.argsort(rng.random((k + 1, p)), 1)[:, :tried]
            cells = [b[offered[node, slot], np.arange(len(rows))] for slot in range(tried)]
        else:
            offered, cells = np.broadcast_to(np.arange(p), (k + 1, p)), b
        count, sums = np.empty((k, len(cells), wide)), np.empty((k, len(cells), wide))
        for j, cell in enumerate(cells):
            at = base + cell
            count[:, j] = np.bincount(at, w, (k + 1) * wide).reshape(k + 1, wide)[:k]
            sums[:, j] = np.bincount(at, s, (k + 1) * wide).reshape(k + 1, wide)[:k]
        count, sums = count.cumsum(2), sums.cumsum(2)
        whole, whole_sum = count[:, :1, -1:], sums[:, :1, -1:]
        left, left_sum = count[:, :, :-1], sums[:, :, :-1]
        right, right_sum = whole - left, whole_sum - left_sum
        fine = (left >= least) & (right >= least)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(fine, left_sum ** 2 / left + right_sum ** 2 / right, -np.inf).reshape(k, -1)
            own = (whole_sum ** 2 / np.maximum(whole, 1e-300)).reshape(k)
        if not score.shape[1]:
            best, split = np.zeros(k, np.int64), np.zeros(k, bool)
        else:
            best = score.argmax(1)
            top = score[np.arange(k), best]
            split = np.isfinite(top) & (top - own > 1e-12 * np.maximum(np.abs(top), 1e-300))
        slot, threshold = np.divmod(best, max(wide - 1, 1))
        # rows that end here have their value at every further depth
        ended = np.concatenate([~split, [False]])[node]
        if ended.any():
            at, given = rows[ended], value[node[ended]]
            for i, d in enumerate(depths):
                if d > level:
                    out[i, at] = given
        place = np.arange(k)
        of_left = left_sum[place, slot, threshold] / np.maximum(left[place, slot, threshold], 1e-300) if wide > 1 else np.zeros(k)
        of_right = right_sum[place, slot, threshold] / np.maximum(right[place, slot, threshold], 1e-300) if wide > 1 else np.zeros(k)
        value = np.stack([of_left[split], of_right[split]], 1).ravel()
        child = np.full(k + 1, len(value))
        child[:-1][split] = 2 * np.arange(split.sum())
        alive = np.concatenate([split, [False]])[node]
        if alive.mean() < 0.8:
            rows, b, w, s, node = rows[alive], b[:, alive], w[alive], s[alive], node[alive]
            alive = None
        feature = np.concatenate([offered[place, slot], [0]])
        cell = b[feature[node], np.arange(len(rows))]
        further = cell > np.concatenate([threshold, [0]])[node]
        node = child[node] + (further if alive is None else further & alive)
    return out


# ---------------------------------------------------------------- one growth
def _mixed(key: np.ndarray, stream: int) -> np.ndarray:
    """Numbers in [0, 1) per row and stream (splitmix64 of the row's key)."""
    with np.errstate(over="ignore"):
        x = key.view(np.uint64) + np.uint64((SEED * 1_000_003 + stream) * 0x9E3779B97F4A7C15 & (2 ** 64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


_POISSON = np.cumsum([math.exp(-1.0) / math.factorial(i) for i in range(18)])


def _drawn_features(growth: Growth, p: int) -> int:
    if growth.features >= 1.0:
        return 0
    return math.ceil(math.sqrt(p)) if growth.features <= 0 else max(1, math.ceil(growth.features * p))


def boosted(bins: np.ndarray, label: np.ndarray, train: np.ndarray, key: np.ndarray, growth: Growth,
            trees: Sequence[int]) -> dict[int, np.ndarray]:
    """{number of trees: margins F of the rows that do not train} of one run."""
    y, out = 2.0 * label - 1.0, {}
    margin, held = np.zeros(len(y)), ~train
    tried = _drawn_features(growth, len(bins))
    for t in range(max(trees)):
        target = y if t == 0 else 4.0 * y / (1.0 + np.exp(np.minimum(2.0 * y * margin, 700.0)))
        weight = train.astype(float)
        if growth.share < 1.0:
            weight *= _mixed(key, t) < growth.share
        value = grow(bins, target, weight, [growth.depth], growth.least, tried, np.random.default_rng([SEED, t]))[0]
        margin += value if t == 0 else growth.rate * value
        if t + 1 in trees:
            out[t + 1] = margin[held].copy()
    return out


def forest(bins: np.ndarray, label: np.ndarray, train: np.ndarray, key: np.ndarray, growth: Growth, trees: Sequence[int],
           depths: Sequence[int]) -> dict[tuple[int, int], np.ndarray]:
    """{(number of trees, depth): mean class shares of the rows that do not train}."""
    held, out = ~train, {}
    total = np.zeros((len(depths), int(held.sum())))
    tried = _drawn_features(growth, len(bins))
    for t in range(max(trees)):
        weight = np.searchsorted(_POISSON, _mixed(key, t), side="right") * train
        some = np.flatnonzero((weight > 0) | held)
        value = grow(bins[:, some], label[some], weight[some].astype(float), depths, growth.least, tried, np.random.default_rng([SEED, t]))
        total += value[:, held[some]]
        if t + 1 in trees:
            out.update({(t + 1, d): total[i] / (t + 1) for i, d in enumerate(depths)})
    return out


# ---------------------------------------------------------------- rows of a plan
def _cut(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(values), MISSING, np.searchsorted(cuts, values, side="left")).astype(np.uint8)


def _chunks(batches: Iterator[pa.RecordBatch], cuts: Sequence[np.ndarray], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of one fold as bytes: features x rows, labels, keys, and their IDs."""
    for batch in batches:
        folds = batch.column("fold").to_numpy(zero_copy_only=False)
        label = batch.column("label").to_numpy(zero_copy_only=False)
        if np.isnan(label.astype(float)).any():
            raise ValueError("labels must not be missing")
        label, key = label.astype(np.uint8), batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
        bins = np.stack([_cut(batch.column(f"x{j}").to_numpy(zero_copy_only=False).astype(float), c) for j, c in enumerate(cuts)])
        made = []
        for f in np.unique(folds):
            here = np.flatnonzero(folds == f)
            made.append((int(f), len(here), bins[:, here].tobytes(), label[here].tobytes(), key[here].tobytes(),
                         batch.column("id").take(pa.array(here))))
        columns = [pa.array([m[i] for m in made], schema.field(i).type) for i in range(5)]
        ends = pa.array(np.cumsum([0] + [m[1] for m in made]), pa.int32())
        ids = pa.concat_arrays([m[5] for m in made]) if made else pa.array([], schema.field(5).type.value_type)
        yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, ids)], schema=schema)


@dataclass(frozen=True)
class Job:
    fold: int
    growth: Growth
    candidates: tuple[tuple[int, int, int], ...]  # (place, trees, depth)
    fills: tuple[int, ...]                        # bins of the fold's fills


def _scored(job: Job, chunks: list[tuple]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[pa.Array]]]:
    chunks = sorted(chunks, key=lambda c: (c[0] == job.fold, c[0], c[4][:8], c[1]))  # the fold's own rows last
    p = len(job.fills)
    bins = np.concatenate([np.frombuffer(c[2], np.uint8).reshape(p, c[1]) for c in chunks], 1)
    for j, fill in enumerate(job.fills):
        bins[j][bins[j] == MISSING] = fill
    label = np.concatenate([np.frombuffer(c[3], np.uint8) for c in chunks]).astype(float)
    key = np.concatenate([np.frombuffer(c[4], np.int64) for c in chunks])
    own = [c for c in chunks if c[0] == job.fold]
    held = sum(c[1] for c in own)
    train = np.arange(len(label)) < len(label) - held
    trees, depths = sorted({t for _, t, _ in job.candidates}), sorted({d for *_, d in job.candidates})
    if job.growth.kind == "forest":
        found = forest(bins, label, train, key, job.growth, trees, depths)
        scores = [(place, found[t, d], found[t, d] > 0.5) for place, t, d in job.candidates]
    else:
        found = boosted(bins, label, train, key, job.growth, trees)
        scores = [(place, 1.0 / (1.0 + np.exp(np.minimum(-2.0 * found[t], 700.0))), found[t] > 0) for place, t, _ in job.candidates]
    for place, score, prediction in scores:
        yield place, label[~train], score, prediction, [c[5] for c in own]


def _fit_rows(batches: Iterator[pa.RecordBatch], jobs: Sequence[Job], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    got: dict[int, list[tuple]] = defaultdict(list)
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(6)]  # a row per chunk
        for r, (job, *rest) in enumerate(zip(*columns)):
            got[job].append((*rest, batch.column(6)[r].values))
    for j in sorted(got):
        chunks = got.pop(j)
        for place, label, score, prediction, ids in _scored(jobs[j], chunks):
            ids = pa.concat_arrays([x for x in ids if x is not None]) if ids else pa.array([], schema.field("id").type)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(label), place, np.int32)), pa.array(np.full(len(label), jobs[j].fold, np.int32)), ids,
                 pa.array(label.astype(np.int32)), pa.array(score), pa.array(prediction.astype(np.int32))], schema=schema)


def plan_chunks(df: DataFrame, id_col: str, label_col: str, cols: Sequence[str]) -> tuple[DataFrame, list[np.ndarray]]:
    """The rows of a fold plan as bytes, written once, and the cut points of every column."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    ship_package(spark)
    x = [qcol(c).cast("double").alias(f"x{j}") for j, c in enumerate(cols)]
    rows = df.select(qcol(id_col).alias("id"), F.xxhash64(qcol(id_col)).alias("key"), F.col("fold").cast("int").alias("fold"),
                     qcol(label_col).cast("double").alias("label"), *x)
    some = rows.orderBy("key", "id").limit(CUT_ROWS).select(*[f"x{j}" for j in range(len(cols))]).toArrow()  # bounded
    cuts = [cut_points(some[f"x{j}"].to_numpy().astype(float)) for j in range(len(cols))]
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"fold int, n int, bins binary, label binary, `key` binary, ids array<{kind}>"
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    path = scratch_path(spark, "tree-rows")
    rows.mapInArrow(lambda b: _chunks(b, cuts, arrow), schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path), cuts


def out_of_fold(chunks: DataFrame, cuts: Sequence[np.ndarray], fills: Mapping[int, Sequence[float | None]],
                stops: Mapping[int, Stop], folds: Sequence[int]) -> DataFrame:
    """(candidate, fold, id, label, score, prediction): rows of every fold, scored by fits without it."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, places = chunks.sparkSession, list(stops)
    jobs = []
    for growth, some in grown_together([stops[i] for i in places]).items():
        read = tuple((places[i], stops[places[i]].trees, stops[places[i]].depth) for i in some)
        for f in folds:
            at = [0 if v is None else int(np.searchsorted(c, v, side="left")) for v, c in zip(fills[f], cuts)]
            jobs.append(Job(f, growth, read, tuple(at)))
    jobs.sort(key=lambda j: -j.growth.depth * max(t for _, t, _ in j.candidates))  # the longest first
    n = len(jobs)
    # a key for every job whose hash is its own partition
    own = {r["part"]: r["salt"] for r in spark.range(64 * n + 64).groupBy(F.pmod(F.hash(F.col("id")), F.lit(n)).alias("part"))
           .agg(F.min("id").alias("salt")).collect()}
    salts = [own.get(j, j) for j in range(n)]
    job = F.explode(F.array(*[F.struct(F.lit(j).alias("job"), F.lit(s).cast("bigint").alias("salt"), F.lit(jobs[j].fold).alias("held"))
                              for j, s in enumerate(salts)])).alias("at")
    dealt = chunks.select("*", job).repartition(n, F.col("at.salt")).select(
        F.col("at.job").alias("job"), "fold", "n", "bins", "label", "key",
        F.when(F.col("fold") == F.col("at.held"), F.col("ids")).alias("ids"))  # only the rows that are scored need IDs
    kind = chunks.schema["ids"].dataType.elementType.simpleString()
    schema = f"candidate int, fold int, id {kind}, label int, score double, prediction int"
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    return dealt.mapInArrow(lambda b: _fit_rows(b, jobs, arrow), schema)
