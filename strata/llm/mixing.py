"""Soft-membership mixing of documents to target token weights per domain.

A classifier fitted on a labelled table gives every document posterior
probabilities ``p`` over domains.  Nonnegative document rates ``r`` are then
fitted so that the expected domain totals ``sum(r * tokens * p_k)`` come closest,
in least squares, to the targets, by projected gradient descent:

    r <- max(0, r - p . M^-1 (A r - T)),   M = sum over r > 0 of tokens * p p^T

(the gradient scaled per document by 1/tokens and by the K x K matrix M).  Rates
start at 1, so they stay as near to equal as the targets allow.  Each step is one
aggregation of K + K*K sums over the membership table; a rate is a function of
the document's own ``p`` and the steps taken, so no rate table is kept or joined.

A fit tells whether its targets were met and by how much each is missed: they may lie
beyond what the documents (or the bounds on rates) can give.

Defined results: a null or empty text has 0 tokens and the posterior of the
class shares; a domain that no document can belong to is left at 0 (its target
is missed); repeated rows are separate documents; empty tables give empty
results; without labelled rows every posterior is uniform.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, materialise, session_of, text_slices
from .text_features import (MAX_FIT_ROWS, Design, bounded_sample, design_of, minimise, select_buckets,
                            training_set)

MAX_STEPS = 25
RIDGE = 1e-3


@dataclass
class DomainModel:
    """Softmax weights (domains x features + shapes + 1) on selected word buckets."""

    domains: tuple[str, ...]
    buckets: np.ndarray
    weights: np.ndarray

    def posteriors(self, design: Design) -> np.ndarray:
        scores = np.stack([design.times(w[:-1]) + w[-1] for w in self.weights], 1)
        scores = np.exp(scores - scores.max(1, keepdims=True))
        return scores / scores.sum(1, keepdims=True)


def fit_domains(labelled: DataFrame, domains: tuple[str, ...], text: str = "text", domain: str = "domain",
                max_rows: int = MAX_FIT_ROWS) -> DomainModel:
    """Multinomial logistic fit; ``labelled`` holds a text and one of ``domains`` per row."""
    session_of(labelled)
    place = F.create_map(*[F.lit(x) for k, d in enumerate(domains) for x in (d, k)])
    rows = (labelled.select(F.element_at(place, F.col(f"`{domain}`")).cast("int").alias("label"),
                            F.col(f"`{text}`").alias("text")).where("label IS NOT NULL AND text IS NOT NULL"))
    buckets = select_buckets(rows)
    design, y = training_set(rows, buckets, max_rows)
    k, width = len(domains), len(buckets) + design.shapes.shape[1] + 1
    hot = np.eye(k)[y] if len(y) else np.zeros((0, k))

    def loss(flat: np.ndarray) -> tuple[float, np.ndarray]:
        w = flat.reshape(k, width)
        p = DomainModel(domains, buckets, w).posteriors(design)
        gap = (p - hot) / max(1, len(y))
        slope = np.stack([np.append(design.back(gap[:, c]), gap[:, c].sum()) for c in range(k)])
        penalty = w * RIDGE
        penalty[:, -1] = 0
        return (-np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).mean() + 0.5 * (penalty * w).sum(),
                (slope + penalty).ravel())

    start = np.zeros(k * width)
    return DomainModel(domains, buckets, (minimise(loss, start) if len(y) else start).reshape(k, width))


def memberships(docs: DataFrame, model: DomainModel, text: str = "text") -> DataFrame:
    """``docs`` with ``tokens`` (words) and ``posterior`` (array, one value per domain)."""
    spark = session_of(docs)
    held = spark.sparkContext.broadcast(model)

    def score(texts: pa.Array) -> pa.Array:
        hashes, sizes, p = WordHashes(), [], []
        for part in text_slices(texts):
            design, n = design_of(part, held.value.buckets, hashes)
            sizes += n.tolist()
            p += held.value.posteriors(design).tolist()
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(p, pa.list_(pa.float64()))],
                                          ["tokens", "posterior"])

    udf = F.arrow_udf(score, "struct<tokens: bigint, posterior: array<double>>")
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("tokens", "posterior")]
    return (docs.withColumn("posterior", udf(F.col(f"`{text}`")))
            .select(*own, F.col("posterior.tokens").alias("tokens"), F.col("posterior.posterior").alias("posterior")))


def _free_rate(steps: list[np.ndarray], posterior: Column, upper: float | None = None) -> Column:
    """The rate before the last step's bounds.  The steps are one literal, folded row by row: the plan does not grow."""
    taken = F.from_json(F.lit(json.dumps([s.tolist() for s in steps])), "array<array<double>>")

    def moved(free: Column, step: Column) -> Column:
        return _bounded(free, upper) - F.aggregate(F.zip_with(posterior, step, lambda x, y: x * y), F.lit(0.0), lambda a, b: a + b)

    return F.aggregate(taken, F.lit(1.0), moved)


def _bounded(free: Column, upper: float | None) -> Column:
    return F.greatest(F.lit(0.0), free if upper is None else F.least(F.lit(float(upper)), free))


@dataclass
class Fit:
    """``steps`` give the rates, ``missed`` by how much each domain's total (or gap of shares) is off its target."""

    steps: list[np.ndarray]
    missed: np.ndarray
    met: bool


def fit_rates(members: DataFrame, targets: list[float], tokens: str = "tokens", posterior: str = "posterior",
              max_steps: int = MAX_STEPS, tolerance: float = 1e-6, upper: float | None = None,
              held: Column | None = None) -> Fit:
    """The steps that bring the expected domain totals to ``targets``; ``met`` tells whether they got there.

    No rate goes over ``upper``; documents for which ``held`` is true count with rate 1 and do not move.
    ``members`` is read once per step: pass a written or persisted table.
    """
    k, goal = len(targets), np.asarray(targets, float)
    p, steps, before = F.col(f"`{posterior}`"), [], None
    while True:
        sums = [F.sum(F.col("_rate") * F.col("_t") * F.col("_p")[i]) for i in range(k)]
        sums += [F.sum(F.when(F.col("_moves"), F.col("_t") * F.col("_p")[i] * F.col("_p")[j]).otherwise(F.lit(0.0)))
                 for i in range(k) for j in range(k)]
        free = F.col("_free")
        now, moves = _bounded(free, upper), (free > 0) if upper is None else (free > 0) & (free <= upper)
        if held is not None:
            now, moves = F.when(F.col("_held"), 1.0).otherwise(now), moves & ~F.col("_held")
        table = members.select(F.col(f"`{tokens}`").cast("double").alias("_t"), p.alias("_p"),
                               _free_rate(steps, p, upper).alias("_free"),
                               F.coalesce(F.lit(False) if held is None else held, F.lit(False)).alias("_held"))
        row = table.select("_t", "_p", now.alias("_rate"), moves.alias("_moves")).agg(*sums).first()
        values = np.array([v or 0.0 for v in row], float)
        reached, m = values[:k], values[k:].reshape(k, k)
        missed = reached - goal
        met = bool(np.abs(missed).max(initial=0) <= tolerance * max(goal.sum(), 1.0))
        # standing still: all that may move is at its bounds, another step would only repeat the last one
        still = before is not None and np.abs(reached - before).max() <= tolerance * 1e-3 * max(goal.sum(), 1.0) and steps[-1].any()
        if met or len(steps) >= max_steps or (still and upper is not None):
            return Fit(steps, missed, met)
        before = reached
        steps.append(np.linalg.pinv(m, rcond=1e-9) @ missed)


def fit_shares(members: DataFrame, shares: list[float], held: Column, tokens: str = "tokens", posterior: str = "posterior",
               max_steps: int = 2 * MAX_STEPS, tolerance: float = 1e-5) -> Fit:
    """Steps for rates from 0 to 1, 1 where ``held``, that bring the domains' shares of the kept tokens to ``shares``.

    A share is linear in the rates as sum(r * tokens * (p_k - share_k)) = 0.  ``missed`` is what each domain misses of
    that, as a part of all tokens; shares that the held documents rule out are missed.
    """
    total = members.agg(F.sum(F.col(f"`{tokens}`").cast("double"))).first()[0] or 1.0
    fit = fit_rates(members.withColumn("_gap", share_gaps(shares, posterior)), [0.0] * len(shares), tokens,
                    "_gap", max_steps, tolerance * total, 1.0, held)
    return Fit(fit.steps, fit.missed / total, fit.met)


def share_gaps(shares: list[float], posterior: str = "posterior") -> Column:
    return F.array(*[F.col(f"`{posterior}`")[i] - F.lit(float(x)) for i, x in enumerate(shares)])


def with_rates(members: DataFrame, steps: list[np.ndarray], scale: float = 1.0, max_copies: int | None = None,
               seed: int = 11, posterior: str = "posterior", keys: tuple[str, ...] = ("doc_id", "text"),
               upper: float | None = None, held: Column | None = None) -> DataFrame:
    """``members`` with ``rate`` and ``copies``: the rate rounded at random, by a hash of ``keys``.

    Equal rows draw the same number, so a recomputed task decides as before.
    """
    rate = _bounded(_free_rate(steps, F.col(f"`{posterior}`"), upper), upper) * F.lit(float(scale))
    if held is not None:
        rate = F.when(held, 1.0).otherwise(rate)
    draw = F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in keys]), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor(F.col("rate") + draw).cast("bigint")
    out = members.withColumn("rate", rate)
    return out.withColumn("copies", F.least(copies, F.lit(max_copies)) if max_copies is not None else copies)


#: Domains of the ``labels`` table.
DOMAINS = ("clean", "toxic", "low")
WEIGHTS = {"clean": 0.97, "toxic": 0.02, "low": 0.01}


def domain_labels(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """(text, domain) of labelled documents: low quality, else toxic, else clean.

    At most about ``max_rows`` labels are used; so few rows of two numbers can be
    broadcast to the documents, whose texts then need no shuffle.
    """
    domain = F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").otherwise("clean")
    some = bounded_sample(labels.select(F.col("doc_id").alias("_id"), domain.alias("domain")), max_rows)
    joined = docs.join(F.broadcast(some), docs["doc_id"] == some["_id"]).select(docs["text"], some["domain"])
    return materialise(docs.sparkSession, joined, "labelled")
