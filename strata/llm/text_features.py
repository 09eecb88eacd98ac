"""Sparse text features and a small dense fit for classifiers on labelled rows.

Features are hashed words (presence) of the buckets that tell the classes apart
best, plus four shape measures.  Bucket statistics cover all labelled rows; the
fit itself uses about ``MAX_FIT_ROWS`` labelled rows at most (a seeded sample if
there are more) of at most ``MAX_FEATURES`` features each, which bounds what the
driver holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, blank_words, session_of

BUCKET_BITS = 18
MAX_FEATURES = 1024
MAX_FIT_ROWS = 20_000
MIN_DOCS = 5
SHAPES = 4
_STRIP = b".,;:!?\"'()[]{}|#*$%&<>"


def features(text: str | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct buckets of the lower-cased words, the shape measures and the word count."""
    words = blank_words(text.lower() if text else None)
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.zeros(SHAPES), 0
    codes = hashes.of([w.strip(_STRIP) for w in words])
    buckets = np.unique(codes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    joined = b"".join(words)
    symbols = len(joined) - len(joined.translate(None, b"#*$%&|<>"))
    same = sum(map(bytes.__eq__, words, words[1:]))
    return buckets, np.array([min(1.0, symbols / n), same / n, len(set(words)) / n, min(1.0, n / 50)]), n


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, size = WordHashes(), 1 << BUCKET_BITS
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts = held.setdefault(label, np.zeros(size, np.int64))
            counts[features(text.as_py(), hashes)[0]] += 1
    for label, counts in held.items():
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), label), pa.int32()), pa.array(some, pa.int32()),
                                          pa.array(counts[some])], ["label", "bucket", "n"])


def select_buckets(labelled: DataFrame, n_features: int = MAX_FEATURES) -> np.ndarray:
    """The buckets whose document frequency differs most between the classes (chi-square), ascending.

    ``labelled``: (label int, text).  At most ``n_features`` rows reach the driver.
    """
    counts = labelled.mapInArrow(_bucket_counts, "label int, bucket int, n bigint").groupBy("label", "bucket").agg(
        F.sum("n").alias("n"))
    sizes = {r[0]: r[1] for r in labelled.groupBy("label").count().collect()}  # one row per class
    total = sum(sizes.values())
    if not total:
        return np.empty(0, np.int64)
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, v / total)])
    everywhere = counts.groupBy("bucket").agg(F.sum("n").alias("df"))
    scored = (counts.join(everywhere, "bucket").where(F.col("df") >= MIN_DOCS)
              .withColumn("e", F.col("df") * F.element_at(share, F.col("label")))
              .groupBy("bucket").agg(F.sum((F.col("n") - F.col("e")) ** 2 / F.col("e")).alias("chi")))
    best = scored.orderBy(F.desc("chi"), "bucket").limit(n_features).select("bucket").toArrow()
    return np.sort(best["bucket"].to_numpy().astype(np.int64))


class Design:
    """Rows of selected features: sparse places and dense shapes."""

    def __init__(self, found: list[np.ndarray], shapes: np.ndarray, n_features: int):
        self.row = np.repeat(np.arange(len(found)), [len(f) for f in found])
        self.column = np.concatenate(found) if found else np.empty(0, np.int64)
        self.shapes = shapes.reshape(len(found), SHAPES)
        self.rows, self.n_features = len(found), n_features

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.rows) + self.shapes @ w[self.n_features:]

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.column, g[self.row], self.n_features), self.shapes.T @ g])


def design_of(texts: list[str | None], buckets: np.ndarray, hashes: WordHashes) -> tuple[Design, np.ndarray]:
    found, shapes, sizes = [], [], []
    for t in texts:
        have, shape, n = features(t, hashes)
        at = np.searchsorted(buckets, have)
        at = np.minimum(at, max(0, len(buckets) - 1))
        found.append(at[buckets[at] == have] if len(buckets) and len(have) else np.empty(0, np.int64))
        shapes.append(shape)
        sizes.append(n)
    return Design(found, np.array(shapes, float), len(buckets)), np.array(sizes, np.int64)


def _sample_rows(batches: Iterator[pa.RecordBatch], buckets: np.ndarray) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        design, _ = design_of(batch.column(1).to_pylist(), buckets, hashes)
        ends = np.concatenate([[0], np.cumsum(np.bincount(design.row, minlength=design.rows))])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(design.column, pa.int32())),
             pa.array(design.shapes.tolist(), pa.list_(pa.float64()))], ["label", "at", "shapes"])


def bounded_sample(rows: DataFrame, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """``rows``, or a seeded sample of about ``max_rows`` of them if there are more (a documented bound)."""
    n = rows.count()
    return rows if n <= max_rows else rows.sample(max_rows / n, seed=7)


def training_set(labelled: DataFrame, buckets: np.ndarray, max_rows: int = MAX_FIT_ROWS) -> tuple[Design, np.ndarray]:
    """Design and labels of the labelled rows, or of a bounded sample of them."""
    session_of(labelled)
    rows = bounded_sample(labelled, max_rows).select("label", "text").mapInArrow(
        lambda b: _sample_rows(b, buckets), "label int, at array<int>, shapes array<double>").toArrow()
    found = [np.asarray(x.as_py(), np.int64) for x in rows["at"]]
    return (Design(found, np.array(rows["shapes"].to_pylist(), float), len(buckets)),
            rows["label"].to_numpy().astype(np.int64))


def minimise(value_and_slope: Callable, x: np.ndarray, rounds: int = 100, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with step halving."""
    value, slope = value_and_slope(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, used = slope.copy(), []
        for s, y in reversed(steps):
            a = (s @ q) / (s @ y)
            q -= a * y
            used.append(a)
        if steps:
            s, y = steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(used)):
            q += s * (a - (y @ q) / (s @ y))
        size = 1.0 if steps else 1.0 / max(1.0, np.abs(slope).sum())
        while size > 1e-10:
            new_value, new_slope = value_and_slope(x - size * q)
            if new_value <= value - 1e-4 * size * (slope @ q):
                break
            size /= 2
        else:
            return x
        step, turn = -size * q, new_slope - slope
        done = value - new_value < 1e-9 * max(1.0, abs(value))
        x, value, slope = x + step, new_value, new_slope
        if step @ turn > 1e-12:
            steps = [*steps, (step, turn)][-memory:]
        if done:
            break
    return x

