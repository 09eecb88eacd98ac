"""Linear models of all folds and candidates, fitted together.

A model is one (fold, inner fold, candidate).  Its training rows are the rows of the other folds (and, with inner folds, of
the other inner folds), prepared with its own fold's fills, means and scales.  All models advance together: one pass over
the rows gives every model's loss, gradient and, for Newton steps, Hessian as sums (a row prepares itself for each fold in
the task that reads it), the driver takes the steps, and models that have converged leave the next pass.  So a grid takes as
many passes as its slowest model takes steps, however many candidates and folds there are.

* ``fit_logistic``: Newton steps; with an L1 part each step is the minimum of the penalised quadratic model (coordinate
  descent), which is proximal Newton.  The optimum is that of ``LogisticRegression`` with ``regParam = 1 / (C n)`` and
  ``standardization=False``.
* ``fit_bayes``: Gaussian naive Bayes; its statistics add up over folds, so one pass serves all folds and smoothings.
* ``fit_hinge``: L-BFGS on the hinge loss, rounded off on a width of ``ROUNDING``, over random Fourier features of the RBF
  kernel (or the features themselves), which are made in the pass and never written.

What the driver holds grows with models x features^2 (Newton) or models x features (L-BFGS), never with the rows: models
are worked on in groups of at most ``STATE`` sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import qcol
from ..session import ship_package
from .prep import Preparation
from .sums import added, tasks_of

#: Numbers that all models of a group send per task and pass.
STATE = 4_000_000
MAX_STEPS = 100
ROUNDING = 0.1
#: Rows that are worked on at once in a task.
SLAB = 2048
#: The same where they have Fourier features, so that those stay in a core's cache.
FOURIER_SLAB = 1024
#: Columns up to which a slab's products of two columns are made once for all models.
PAIRED_WIDTH = 32


#: Fill, mean and scale of every column.
Arrays = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass(frozen=True)
class ModelKey:
    """``inner`` -1: no inner fold is left out.  ``candidate`` is a place in the caller's list."""

    fold: int
    candidate: int
    inner: int = -1


@dataclass
class Rows:
    """What the passes read: (fold int, inner int, label double, x array<double>).

    ``own`` False: x is raw, every row trains the models of all other folds, prepared by ``preps`` of (fold, inner fold).
    ``own`` True: x is prepared already and the row trains the models of fold ``fold`` only (balanced rows, base scores).
    """

    frame: DataFrame
    preps: dict[tuple[int, int], Arrays]
    width: int
    own: bool = False
    counts: dict[tuple[int, int], int] = field(default_factory=dict)
    parts: int = 0

    def tasks(self) -> int:
        """Tasks of a pass."""
        self.parts = self.parts or tasks_of(self.frame)
        return self.parts

    def training_size(self, key: ModelKey) -> int:
        """Rows that train a model: from one count per (fold, inner fold)."""
        if not self.counts:
            self.counts = {(r["fold"], r["inner"]): r["count"] for r in self.frame.groupBy("fold", "inner").count().collect()}
        return sum(n for (f, g), n in self.counts.items() if (f == key.fold) == self.own and (key.inner < 0 or g != key.inner))

    def plain(self) -> tuple:
        return self.preps, self.width, self.own


def prep_arrays(prep: Preparation) -> Arrays:
    """Fill, mean and scale per output column."""
    cols = prep.output_cols
    fill = np.array([math.nan if prep.fill.get(c) is None else float(prep.fill[c]) for c in cols])
    return (fill, np.array([float(prep.mean.get(c, 0.0)) for c in cols]),
            np.array([float(prep.scale.get(c, 1.0)) for c in cols]))


def raw_rows(df: DataFrame, preps: dict[tuple[int, int], Preparation], label: str, fold: str = "fold",
             inner: Column | None = None, keep: Sequence[Column] = ()) -> Rows:
    """Rows of a cohort with folds; ``keep`` columns come back with the margins."""
    cols = preps[min(preps)].output_cols
    frame = df.select(F.col(fold).cast("int").alias("fold"), (F.lit(-1) if inner is None else inner).cast("int").alias("inner"),
                      qcol(label).cast("double").alias("label"), F.array(*[qcol(c).cast("double") for c in cols]).alias("x"),
                      *keep)
    return Rows(frame, {key: prep_arrays(p) for key, p in preps.items()}, len(cols))


def own_rows(frame: DataFrame, width: int) -> Rows:
    """Rows (fold, inner, label, x, ...) that are prepared already and train the models of their own fold."""
    return Rows(frame, {}, width, True)


def _matrix(x: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column; missing cells are NaN."""
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width) if len(x) else np.empty((0, width))


def prepared(x: np.ndarray, preps: dict[tuple[int, int], Arrays], fold: int, inner: int) -> np.ndarray:
    """Raw rows as the models of a fold see them; without a preparation, as they are."""
    if not preps:
        return x
    fill, mean, scale = preps.get((fold, inner), preps[fold, -1])
    return (np.where(np.isnan(x), fill, x) - mean) / scale


@lru_cache(maxsize=64)
def _waves(width: int, gamma: float, features: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and shifts of the Fourier features."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2.0 * gamma), (width, features)).astype(np.float32)
    return w, rng.uniform(0.0, 2.0 * math.pi, features).astype(np.float32)


def fourier(x: np.ndarray, gamma: float, features: int, seed: int) -> np.ndarray:
    """Random Fourier features of exp(-gamma |x - y|^2) (Rahimi and Recht, 2007) and a column of ones, in single precision."""
    w, shift = _waves(x.shape[1], gamma, features, seed)
    out = np.ones((len(x), features + 1), np.float32)
    angle = x.astype(np.float32) @ w
    angle += shift
    np.multiply(np.cos(angle, out=angle), np.float32(math.sqrt(2.0 / features)), out=out[:, :-1])
    return out


@dataclass(frozen=True)
class Feature:
    """How a model sees prepared rows: as they are, or as Fourier features."""

    gamma: float | None = None
    features: int = 0
    seed: int = 0

    def width(self, d: int) -> int:
        return (self.features if self.gamma is not None else d) + 1

    def of(self, x: np.ndarray) -> np.ndarray:
        """Features, and a column of ones for the intercept."""
        if self.gamma is not None:
            return fourier(x, self.gamma, self.features, self.seed)
        return np.concatenate([x, np.ones((len(x), 1))], 1)


def _logistic_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Per model, over the rows that are ``there``: loss, gradient, Hessian (row by row)."""
    x, y = x[there], y[there]
    z = x @ w.T
    small = np.exp(-np.abs(z))
    loss = (np.maximum(z, 0.0) + np.log1p(small)).sum(0) - y @ z
    p = np.where(z >= 0, 1.0, small) / (1.0 + small)
    grad = (p - y[:, None]).T @ x
    curve = p * (1.0 - p)
    if x.shape[1] <= PAIRED_WIDTH:  # products of two columns are the same for all models
        d, at = x.shape[1], 0
        i, j = np.triu_indices(d)
        columns, products = np.ascontiguousarray(x.T), np.empty((len(i), len(x)))
        for k in range(d):
            np.multiply(columns[k:], columns[k], out=products[at:at + d - k])
            at += d - k
        hess = np.empty((len(w), d, d))
        hess[:, i, j] = hess[:, j, i] = (products @ curve).T
    else:
        hess = np.stack([(x * curve[:, [m]]).T @ x for m in range(len(w))])
    return np.concatenate([loss[:, None], grad, hess.reshape(len(w), -1)], 1)


def _hinge_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Per model, over the rows that are ``there``: loss and gradient of the hinge loss, rounded off below its corner.

    Rows are left out by weight, not by copying their many features.
    """
    sign = (2.0 * y - 1.0).astype(x.dtype)
    gap = 1.0 - sign * np.stack([x @ v for v in w.astype(x.dtype)])  # models x rows
    slope = np.clip(gap / x.dtype.type(ROUNDING), 0.0, 1.0) * there
    loss = np.where(gap > ROUNDING, gap - ROUNDING / 2, slope * slope * ROUNDING / 2) * there
    grad = np.stack([v @ x for v in (-sign * slope).astype(x.dtype)])
    return np.concatenate([loss.sum(1, dtype=np.float64)[:, None], grad.astype(np.float64)], 1)


def _pass_rows(batches: Iterator[pa.RecordBatch], rows: tuple, models: list[tuple[ModelKey, Feature]], weights: np.ndarray,
               sums_of: Callable, size: int) -> Iterator[pa.RecordBatch]:
    """One row of sums per model, over the rows of this task."""
    preps, width, own = rows
    total = None
    groups: dict[tuple, list[int]] = {}
    for m, (key, feature) in enumerate(models):
        groups.setdefault((key.fold, key.inner, feature), []).append(m)
    slab = FOURIER_SLAB if any(feature.gamma is not None for _, feature in models) else SLAB
    for batch in batches:
        for at in range(0, batch.num_rows, slab):
            part = batch.slice(at, slab)
            fold, inner, label = (part.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            x = _matrix(part.column(3), width)
            last: tuple = (None, None)
            for (f, g, feature), members in groups.items():
                mask = (fold == f) if own else (fold != f)
                if g >= 0:
                    mask &= inner != g
                if not mask.any():
                    continue
                # features of a preparation are made once, for all its inner folds and candidates
                g_prep = g if (f, g) in preps else -1
                if last[0] != (f, g_prep, feature):
                    last = (f, g_prep, feature), feature.of(prepared(x, preps, f, g))
                sums = sums_of(last[1], label, weights[members][:, :last[1].shape[1]], mask)
                if total is None:
                    total = np.zeros((len(models), size))
                total[members, :sums.shape[1]] += sums
    if total is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(models), dtype=np.int32)),
             pa.ListArray.from_arrays(pa.array(np.arange(len(models) + 1, dtype=np.int32) * total.shape[1]), pa.array(total.ravel()))],
            ["model", "sums"])


def _one_pass(rows: Rows, models: list[tuple[ModelKey, Feature]], weights: np.ndarray, sums_of: Callable,
              size: int) -> np.ndarray:
    """The sums of all models over all rows (models x size)."""
    spark = rows.frame.sparkSession
    held = spark.sparkContext.broadcast((rows.plain(), models, weights))
    partial = rows.frame.select("fold", "inner", "label", "x").mapInArrow(
        lambda b: _pass_rows(b, *held.value, sums_of, size), "model int, sums array<double>")
    out = added(partial, rows.tasks(), len(models), size)
    held.unpersist()
    return out


class _Newton:
    """Proximal Newton for mean(loss) + ridge / 2 |w|^2 + lasso |w|_1; the last weight (intercept) is free."""

    def __init__(self, width: int, n: int, ridge: float, lasso: float, tol: float):
        self.n, self.tol = n, tol
        self.ridge, self.lasso = np.full(width, ridge), np.full(width, lasso)
        self.ridge[-1] = self.lasso[-1] = 0.0
        self.w, self.at = np.zeros(width), math.inf
        self.trial, self.done = self.w.copy(), False

    def size(self) -> int:
        return 1 + len(self.w) * (len(self.w) + 1)

    def objective(self, loss: float, w: np.ndarray) -> float:
        return loss / self.n + 0.5 * (self.ridge * w * w).sum() + (self.lasso * np.abs(w)).sum()

    def advance(self, sums: np.ndarray) -> None:
        d, value = len(self.w), self.objective(sums[0], self.trial)
        moved = np.abs(self.trial - self.w).max()
        small = moved <= self.tol * max(1.0, np.abs(self.w).max())
        if value > self.at + 1e-13 * abs(self.at) and not small:
            self.trial = (self.w + self.trial) / 2  # no descent: half the step
            return
        first = math.isinf(self.at)
        self.w, self.at = self.trial, min(value, self.at)
        if small and not first:
            self.done = True
            return
        grad, hess = sums[1:1 + d] / self.n, sums[1 + d:].reshape(d, d) / self.n
        self.trial = self._minimum(grad, hess)

    def _minimum(self, grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
        a = hess + np.diag(self.ridge) + np.eye(len(grad)) * 1e-14
        b = hess @ self.w - grad  # the quadratic model is w' a w / 2 - b w
        if not self.lasso.any():
            return np.linalg.lstsq(a, b, rcond=None)[0]
        w = self.w.copy()
        for _ in range(10_000):
            before = w.copy()
            for k in range(len(w)):
                rest = b[k] - a[k] @ w + a[k, k] * w[k]
                w[k] = math.copysign(max(abs(rest) - self.lasso[k], 0.0), rest) / a[k, k]
            if np.abs(w - before).max() <= 1e-12 * max(1.0, np.abs(w).max()):
                break
        return w


class _Lbfgs:
    """L-BFGS for mean(loss) + ridge / 2 |w|^2; the last weight (intercept) is free."""

    MEMORY = 10

    def __init__(self, width: int, n: int, ridge: float, tol: float):
        self.n, self.tol = n, tol
        self.ridge = np.full(width, ridge)
        self.ridge[-1] = 0.0
        self.w, self.at, self.grad = np.zeros(width), math.inf, None
        self.trial, self.pairs, self.rate, self.done = self.w.copy(), [], 1.0, False

    def size(self) -> int:
        return 1 + len(self.w)

    def advance(self, sums: np.ndarray) -> None:
        value = sums[0] / self.n + 0.5 * (self.ridge * self.trial * self.trial).sum()
        grad = sums[1:] / self.n + self.ridge * self.trial
        if self.grad is not None:
            step = self.trial - self.w
            if value > self.at + 1e-4 * (self.grad @ step):
                self.rate /= 2
                self.done = self.rate < 1e-8
                self.trial = self.w + step / 2
                return
            if step @ (grad - self.grad) > 1e-12 * (step @ step):
                self.pairs = [*self.pairs, (step, grad - self.grad)][-self.MEMORY:]
            self.done = self.at - value <= self.tol * max(abs(value), 1e-6)
        self.w, self.at, self.grad, self.rate = self.trial, value, grad, 1.0
        if not self.done:
            way, memory = -grad, []
            for s, y in reversed(self.pairs):
                a = (s @ way) / (s @ y)
                memory.append(a)
                way = way - a * y
            if self.pairs:
                s, y = self.pairs[-1]
                way = way * ((s @ y) / (y @ y))
            else:
                way = way / max(1.0, np.linalg.norm(way))
            for (s, y), a in zip(self.pairs, reversed(memory)):
                way = way + s * (a - (y @ way) / (s @ y))
            self.trial = self.w + way


@dataclass
class Fitted:
    """Weights (intercept last) and how they came about; ``passes`` counts reads of the rows."""

    keys: list[ModelKey]
    features: list[Feature]
    weights: list[np.ndarray | Bayes]
    converged: list[bool]
    passes: int

    def part(self, inner: bool) -> Fitted:
        """The models with, or without, an inner fold left out."""
        at = [m for m, key in enumerate(self.keys) if (key.inner >= 0) == inner]
        pick = lambda values: [values[m] for m in at]
        return Fitted(pick(self.keys), pick(self.features), pick(self.weights), pick(self.converged), self.passes)

    def of(self, fold: int, candidate: int, inner: int = -1) -> np.ndarray | Bayes:
        return self.weights[self.keys.index(ModelKey(fold, candidate, inner))]


def _fit(rows: Rows, models: list[tuple[ModelKey, Feature]], states: list, sums_of: Callable, max_steps: int) -> Fitted:
    ship_package(rows.frame.sparkSession)
    passes, groups, held = 0, [[]], 0
    for m, state in enumerate(states):
        if groups[-1] and held + state.size() > STATE:
            groups.append([])
            held = 0
        groups[-1].append(m)
        held += state.size()
    for group in groups:
        open_ = list(group)
        for _ in range(max_steps):
            weights = np.zeros((len(open_), max((len(states[m].w) for m in open_), default=1)))
            for row, m in enumerate(open_):
                weights[row, :len(states[m].trial)] = states[m].trial
            sums = _one_pass(rows, [models[m] for m in open_], weights, sums_of, max(states[m].size() for m in open_))
            passes += 1
            for row, m in enumerate(open_):
                states[m].advance(sums[row, :states[m].size()])
            open_ = [m for m in open_ if not states[m].done]
            if not open_:
                break
    return Fitted([k for k, _ in models], [f for _, f in models], [s.w for s in states], [s.done for s in states], passes)


def fit_logistic(rows: Rows, keys: Sequence[ModelKey], penalties: Sequence[tuple[float, float]], tol: float = 1e-8,
                 max_steps: int = MAX_STEPS) -> Fitted:
    """``penalties`` per candidate: (C, L1 part)."""
    width, models, states = rows.width + 1, [], []
    for key in keys:
        c, part = penalties[key.candidate]
        n = max(1, rows.training_size(key))
        strength = 1.0 / (c * n) if math.isfinite(c) else 0.0
        models.append((key, Feature()))
        states.append(_Newton(width, n, strength * (1.0 - part), strength * part, tol))
    return _fit(rows, models, states, _logistic_sums, max_steps)


def fit_hinge(rows: Rows, keys: Sequence[ModelKey], settings: Sequence[tuple[float, Feature]], tol: float = 1e-4,
              max_steps: int = MAX_STEPS) -> Fitted:
    """``settings`` per candidate: (C, features)."""
    models, states = [], []
    for key in keys:
        c, feature = settings[key.candidate]
        n = max(1, rows.training_size(key))
        models.append((key, feature))
        states.append(_Lbfgs(feature.width(rows.width), n, 1.0 / (c * n), tol))
    # models with the same features next to each other: a pass makes them once
    order = sorted(range(len(models)), key=lambda m: (models[m][0].fold, str(models[m][1]), models[m][0].inner))
    return _fit(rows, [models[m] for m in order], [states[m] for m in order], _hinge_sums, max_steps)


# ---------------------------------------------------------------- Gaussian naive Bayes from additive statistics
LOG_2PI = math.log(2.0 * math.pi)


@dataclass
class Bayes:
    """Means and variances per class (0, 1) and feature, log priors per class."""

    mean: np.ndarray
    var: np.ndarray
    log_prior: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1; NaN where a class had no training row."""
        x = x[:, :-1]  # without the column of ones
        joint = [-0.5 * (LOG_2PI + np.log(self.var[c]) + (x - self.mean[c]) ** 2 / self.var[c]).sum(1) + self.log_prior[c]
                 for c in (0, 1)]
        return joint[1] - joint[0]


def _moment_rows(batches: Iterator[pa.RecordBatch], width: int, shift: np.ndarray, cells: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Per (fold, inner fold) and class: rows, present values, sums and squares around ``shift``."""
    total = np.zeros((2 * len(cells), 1 + 3 * width))
    for batch in batches:
        fold, inner, label = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        x = _matrix(batch.column(3), width) - shift
        for k, (f, g) in enumerate(cells):
            for c in (0, 1):
                part = x[(fold == f) & (inner == g) & (label == c)]
                total[2 * k + c] += np.concatenate([[len(part)], (~np.isnan(part)).sum(0), np.nansum(part, 0), np.nansum(part * part, 0)])
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(total), dtype=np.int32)),
         pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1, dtype=np.int32) * total.shape[1]), pa.array(total.ravel()))],
        ["model", "sums"])


def fit_bayes(rows: Rows, keys: Sequence[ModelKey], smoothings: Sequence[float]) -> Fitted:
    """Every fold's model and every smoothing value from one pass: training sums are totals less the left-out folds'."""
    spark = rows.frame.sparkSession
    ship_package(spark)
    d = rows.width
    rows.training_size(ModelKey(-1, 0))  # counts the cells
    cells = sorted(rows.counts)
    centre = np.array([float(v or 0.0) for v in rows.frame.select(
        *[F.avg(F.when(~F.isnan(F.col("x")[i]), F.col("x")[i])) for i in range(d)]).first()])
    held = spark.sparkContext.broadcast((d, centre, cells))
    sums = added(rows.frame.select("fold", "inner", "label", "x").mapInArrow(
        lambda b: _moment_rows(b, *held.value), "model int, sums array<double>"), rows.tasks(), 2 * len(cells), 1 + 3 * d)
    out = []
    for key in keys:
        used = [k for k, (f, g) in enumerate(cells) if (f == key.fold) == rows.own and (key.inner < 0 or g != key.inner)]
        per = np.stack([sums[[2 * k + c for k in used]].sum(0) for c in (0, 1)])
        n, present, s1, s2 = per[:, :1], per[:, 1:1 + d], per[:, 1 + d:1 + 2 * d], per[:, 1 + 2 * d:]
        if rows.preps:
            fill, middle, scale = rows.preps.get((key.fold, key.inner), rows.preps[key.fold, -1])
        else:
            fill, middle, scale = np.zeros(d), np.zeros(d), np.ones(d)
        gap = np.nan_to_num(fill - centre)
        t1, t2 = s1 + (n - present) * gap, s2 + (n - present) * gap * gap  # missing cells hold the fill

        def spread(n: np.ndarray, t1: np.ndarray, t2: np.ndarray, scale: np.ndarray = scale) -> tuple[np.ndarray, np.ndarray]:
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = t1 / n
                return mean, np.maximum(t2 / n - mean * mean, 0.0) / scale ** 2

        mean, var = spread(n, t1, t2)
        whole = spread(n.sum(0), t1.sum(0), t2.sum(0))[1]
        with np.errstate(divide="ignore", invalid="ignore"):
            prior = np.log(n[:, 0] / n.sum())
            prior[n[:, 0] == 0] = np.nan
        out.append(Bayes((mean + centre - middle) / scale, var + smoothings[key.candidate] * np.nan_to_num(whole).max(initial=0.0),
                         prior))
    return Fitted(list(keys), [Feature()] * len(keys), out, [True] * len(keys), 1)


def _margin_rows(batches: Iterator[pa.RecordBatch], rows: tuple, fitted: Fitted, inner: bool) -> Iterator[pa.RecordBatch]:
    """(row columns behind the first four, fold, candidate, margin) of the models that did not see the row.

    ``inner``: models whose training rows it would belong to, were its inner fold not left out; else the models of the
    row's own fold.
    """
    preps, width, own = rows
    for batch in batches:
        for at in range(0, batch.num_rows, SLAB):
            part = batch.slice(at, SLAB)
            fold, inner_fold = (part.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            x, last = _matrix(part.column(3), width), (None, None)
            for key, feature, w in zip(fitted.keys, fitted.features, fitted.weights):
                mask = fold == key.fold
                if inner:
                    mask = (mask if own else ~mask) & (inner_fold == key.inner)
                at_rows = np.flatnonzero(mask)
                if not len(at_rows):
                    continue
                prep = (key.fold, key.inner if (key.fold, key.inner) in preps else -1, feature)
                if last[0] != prep:
                    last = prep, feature.of(prepared(x, preps, key.fold, key.inner))
                place = pa.array(at_rows)
                margin = last[1][at_rows] @ w if isinstance(w, np.ndarray) else w.margin(last[1][at_rows])
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(place) for c in part.columns[4:]), pa.array(np.full(len(at_rows), key.fold, np.int32)),
                     pa.array(np.full(len(at_rows), key.candidate, np.int32)), part.column(2).take(place),
                     pa.array(margin, pa.float64(), from_pandas=True)],
                    [*part.schema.names[4:], "fold", "candidate", "label", "margin"])


def margins(rows: Rows, fitted: Fitted, inner: bool = False) -> DataFrame:
    """(kept columns, fold, candidate, label, margin): log odds of rows by models that were fitted without them."""
    spark = rows.frame.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast((rows.plain(), fitted))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.frame.schema.fields[4:])
    shape = (kept + ", " if kept else "") + "fold int, candidate int, label double, margin double"
    return rows.frame.mapInArrow(lambda b: _margin_rows(b, *held.value, inner), shape)
