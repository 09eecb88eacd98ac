"""Toxicity as severity grades: cumulative-link ordinal regression on sparse text features.

With grades 0..K-1, ordered thresholds ``theta_1 < ... < theta_{K-1}`` and one
weight vector ``w`` shared by all of them,

    P(grade >= k) = sigmoid(w . x - theta_k),

fitted by penalised maximum likelihood.  The expected severity is the sum of
these probabilities.  Features and the bound on the rows of the fit are those of
``text_features``.

Defined results: a null or empty text has no features (its severity follows from
the thresholds alone); grades need not all occur; repeated rows are scored one
by one; without labelled rows every weight is 0; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, materialise, session_of, text_slices
from .text_features import (MAX_FIT_ROWS, Design, bounded_sample, design_of, minimise, select_buckets,
                            training_set)

RIDGE = 1e-3
MAX_FEATURES = 512


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class SeverityModel:
    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, design: Design) -> np.ndarray:
        """P(grade >= k) for k = 1..K-1, one row per text."""
        return _sigmoid(design.times(self.weights)[:, None] - self.thresholds)


def _thresholds(free: np.ndarray) -> np.ndarray:
    """Ordered thresholds from free numbers: the first, then positive gaps."""
    return np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def fit_severity(labelled: DataFrame, n_grades: int, text: str = "text", grade: str = "grade",
                 max_rows: int = MAX_FIT_ROWS, n_features: int = MAX_FEATURES) -> SeverityModel:
    """Fit on (text, grade) rows with grades 0..n_grades-1; other grades and null texts are left out."""
    session_of(labelled)
    g = F.col(f"`{grade}`").cast("int")
    rows = labelled.select(g.alias("label"), F.col(f"`{text}`").alias("text")).where(
        f"label BETWEEN 0 AND {n_grades - 1} AND text IS NOT NULL")
    buckets = select_buckets(rows, n_features)
    design, y = training_set(rows, buckets, max_rows)
    k, width = n_grades - 1, len(buckets) + design.shapes.shape[1]

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, free = x[:width], x[width:]
        theta = _thresholds(free)
        p = np.concatenate([np.ones((len(y), 1)), _sigmoid(design.times(w)[:, None] - theta), np.zeros((len(y), 1))], 1)
        d = p * (1 - p)
        row = np.arange(len(y))
        chance = np.maximum(p[row, y] - p[row, y + 1], 1e-12)
        to_score = -(d[row, y] - d[row, y + 1]) / chance / len(y)
        to_theta = np.zeros(k + 2)
        np.add.at(to_theta, y, d[row, y] / chance / len(y))
        np.add.at(to_theta, y + 1, -d[row, y + 1] / chance / len(y))
        to_theta = to_theta[1:k + 1]
        tail = np.cumsum(to_theta[::-1])[::-1]
        to_free = np.concatenate([tail[:1], tail[1:] * np.exp(free[1:])])
        return (-np.log(chance).mean() + 0.5 * RIDGE * (w @ w) + 0.5 * RIDGE * (free[1:] @ free[1:]),
                np.concatenate([design.back(to_score) + RIDGE * w,
                                to_free + RIDGE * np.concatenate([[0.0], free[1:]])]))

    x = np.zeros(width + k)
    if len(y):
        x = minimise(loss, x)
    return SeverityModel(buckets, x[:width], _thresholds(x[width:]))


def severity(docs: DataFrame, model: SeverityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``at_least`` (P(grade >= k), k = 1..), ``grade`` (most probable) and ``expected_severity``."""
    spark = session_of(docs)
    held = spark.sparkContext.broadcast(model)

    def score(texts: pa.Array) -> pa.Array:
        hashes, out = WordHashes(), []
        for part in text_slices(texts):
            out += held.value.at_least(design_of(part, held.value.buckets, hashes)[0]).tolist()
        return pa.array(out, pa.list_(pa.float64()))

    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("at_least", "grade", "expected_severity")]
    p = F.concat(F.array(F.lit(1.0)), F.col("at_least"), F.array(F.lit(0.0)))
    each = F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: a - b)
    return (docs.withColumn("at_least", F.arrow_udf(score, "array<double>")(F.col(f"`{text}`")))
            .select(*own, "at_least")
            .withColumn("grade", (F.array_position(each, F.array_max(each)) - 1).cast("int"))
            .withColumn("expected_severity", F.aggregate("at_least", F.lit(0.0), lambda a, b: a + b)))


#: Grades made from the 0/1 labels: 1 toxic, 2 toxic with at least so many marker words per 100.
SEVERE_PER_100 = 1.5
GRADES = 3
MARKERS = 48


def graded_labels(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """(text, grade) of labelled documents, from ``labels.toxic``.

    Grade 0 is not toxic.  Toxic documents are split by the density of marker
    words, the ``MARKERS`` buckets that tell toxic documents apart best: 2 from
    ``SEVERE_PER_100`` per 100 words, else 1.  At most about ``max_rows`` labels
    are used (two numbers each, broadcast).
    """
    spark = session_of(docs)
    some = bounded_sample(labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("label"))
                          .where("label IS NOT NULL"), max_rows)
    rows = materialise(spark, docs.join(F.broadcast(some), docs["doc_id"] == some["_id"])
                       .select(some["label"], docs["text"]).where("text IS NOT NULL"), "labelled")
    markers = select_buckets(rows, MARKERS)
    design, y = training_set(rows, markers, max_rows)
    # only buckets that are commoner in toxic documents mark them
    share = [np.bincount(design.column[(y == v)[design.row]], minlength=len(markers)) / max(1, (y == v).sum()) for v in (0, 1)]
    markers = markers[share[1] > 2 * share[0]]

    def density(texts: pa.Array) -> pa.Array:
        hashes, out = WordHashes(), []
        for part in text_slices(texts):
            d, n = design_of(part, markers, hashes)
            out += (100 * np.bincount(d.row, minlength=d.rows) / np.maximum(n, 1)).tolist()
        return pa.array(out, pa.float64())

    found = F.arrow_udf(density, "double")(F.col("text"))
    return rows.withColumn("_found", found).select(
        "text", F.when(F.col("label") == 0, 0).when(F.col("_found") >= SEVERE_PER_100, 2).otherwise(1).alias("grade"))
