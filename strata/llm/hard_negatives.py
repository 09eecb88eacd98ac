"""Hard negatives of anchors: exact integer inner products by Strassen tiles, heaps of positives and windows.

Components become integers, ``floor(scale * x)`` with x as a double.  Anchors are worked on in chunks of about
``CHUNK`` rows, the only data that is broadcast; every task streams its candidates past a chunk in tiles of ``TILE``
rows.  The scores of an anchor tile with a candidate tile are one matrix product by Strassen's recursion on int64
(odd sides are padded with a row or column of zeros, seven half-sized products, integer additions only).  Additions
wrap modulo 2^64, so the scores are exact whenever they fit 64 bits.

Two passes over the candidates: the first keeps, per anchor, a heap of the best rows of its label (the positives);
the second, per anchor and positive, a heap of the best rows of other labels whose score lies in the positive's
window, ``low * positive <= 100 * negative <= high * positive``.  Heaps of tiles and tasks merge by keeping the best
again, so a task sends a bounded number of rows per anchor, whatever it has read.  Higher scores come first, ties go
by smaller id.

Defined results: rows with a null id, label or vector, or with any null or non-finite component, take no part; a
component beyond 64 bits after scaling is an error; shorter vectors are filled up with zeros; repeated rows are
candidates of their own, a repeated anchor row is mined once; a row of the anchor's own id is never its positive; an
anchor without positives, or a window without rows, gives no rows; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import materialise, session_of

CHUNK, TILE = 1024, 2048
#: Sides up to which a product is not split any further.
SMALL = 16
#: Tasks per core of the cluster that stream the candidates; each sends its heaps once.
TASKS_PER_CORE = 4
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _plain_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact product of small tiles; in doubles (fast) where no sum can leave the 53 bits that they hold."""
    largest = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (a, b)]
    if largest[0] * largest[1] * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two int64 matrices, modulo 2^64."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= SMALL:
        return _plain_product(a, b)
    a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out[:m, :n]


class Heaps:
    """The best ``size`` (score, id) of many windows; two sets of heaps merge by pushing one's entries to the other."""

    def __init__(self, windows: int, size: int):
        self.windows, self.size = windows, size
        self.window = self.score = self.id = np.empty(0, np.int64)
        self.worst = np.full(windows, LEAST)  # the score that a newcomer has to reach

    def push(self, window: np.ndarray, score: np.ndarray, row_id: np.ndarray) -> None:
        if not len(window):
            return
        window, score, row_id = (np.concatenate(x) for x in ((self.window, window), (self.score, score), (self.id, row_id)))
        order = np.lexsort((row_id, ~score, window))  # ~ turns the order round without overflow
        window, score, row_id = window[order], score[order], row_id[order]
        place = np.arange(len(window)) - np.searchsorted(window, window)
        kept = place < self.size
        self.window, self.score, self.id = window[kept], score[kept], row_id[kept]
        full = place == self.size - 1
        self.worst[window[full]] = score[full]


def _matrix(vectors: pa.Array, width: int, scale: float) -> np.ndarray:
    """Rows of integers, filled up with zeros to ``width``."""
    ends = vectors.offsets.to_numpy()
    values = vectors.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]].astype(np.float64)
    scaled = np.floor(values * scale)
    if len(scaled) and not (np.abs(scaled) < 2.0 ** 63).all():
        raise ValueError("a scaled component does not fit 64 bits")
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = scaled.astype(np.int64)
    return out


class Anchors:
    """A chunk of anchors as a matrix, and the windows of their positives (one column per positive)."""

    def __init__(self, rows: pa.Table, width: int, scale: float, windows: pa.Table | None, positives: int):
        rows = rows.combine_chunks()
        self.key, self.id, self.label = (rows[c].to_numpy() for c in ("anchor", "id", "label"))
        vectors = rows["vector"].combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.float64()))
        self.matrix = _matrix(vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors, width, scale)
        self.low = np.full((len(self.key), positives), MOST)
        self.high = np.full((len(self.key), positives), LEAST)
        if windows is not None and windows.num_rows:
            order = np.argsort(self.key)
            at = order[np.searchsorted(self.key[order], windows["anchor"].to_numpy())], windows["place"].to_numpy() - 1
            self.low[at], self.high[at] = windows["low"].to_numpy(), windows["high"].to_numpy()


def _tiles(batches: Iterator[pa.RecordBatch], width: int, scale: float) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        for at in range(0, batch.num_rows, TILE):
            part = batch.slice(at, TILE)
            yield part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2), width, scale)


def _heap_rows(heaps: Heaps, anchors: Anchors, positives: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(anchors.key[heaps.window // positives]), pa.array((heaps.window % positives + 1).astype(np.int32)),
         pa.array(heaps.score), pa.array(heaps.id)], ["anchor", "place", "score", "id"])


def _positive_heaps(batches: Iterator[pa.RecordBatch], anchors: Anchors, positives: int, width: int,
                    scale: float) -> Iterator[pa.RecordBatch]:
    heaps = Heaps(len(anchors.key), positives)
    for ids, labels, matrix in _tiles(batches, width, scale):
        scores = strassen(anchors.matrix, np.ascontiguousarray(matrix.T))
        window, row = np.nonzero((anchors.label[:, None] == labels) & (anchors.id[:, None] != ids)
                                 & (scores >= heaps.worst[:, None]))
        heaps.push(window, scores[window, row], ids[row])
    yield _heap_rows(heaps, anchors, 1)


def _negative_heaps(batches: Iterator[pa.RecordBatch], anchors: Anchors, negatives: int, width: int,
                    scale: float) -> Iterator[pa.RecordBatch]:
    positives = anchors.low.shape[1]
    heaps = Heaps(len(anchors.key) * positives, negatives)
    for ids, labels, matrix in _tiles(batches, width, scale):
        scores = strassen(anchors.matrix, np.ascontiguousarray(matrix.T))
        other = anchors.label[:, None] != labels
        for p in range(positives):
            least = np.maximum(anchors.low[:, p], heaps.worst[p::positives])
            anchor, row = np.nonzero(other & (scores >= least[:, None]) & (scores <= anchors.high[:, p, None]))
            heaps.push(anchor * positives + p, scores[anchor, row], ids[row])
    yield _heap_rows(heaps, anchors, positives)


def _best(heaps: DataFrame, size: int, *group: str) -> DataFrame:
    """The merged heaps: the best ``size`` of every group, numbered from 1 in ``rank``."""
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "id")
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def usable(rows: DataFrame, row_id: Column, label: Column, vector: Column) -> DataFrame:
    """(id, label, vector) of the rows that take part."""
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (rows.select(row_id.cast("bigint").alias("id"), label.cast("bigint").alias("label"),
                        vector.cast("array<double>").alias("vector"))
            .where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(sound))


def _streamed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """At most a few tasks per core: each sends its heaps once."""
    return rows.coalesce(TASKS_PER_CORE * max(1, spark.sparkContext.defaultParallelism))


def hard_negatives(rows: DataFrame, is_anchor: Column, row_id: str = "vec_id", label: Column | None = None,
                   vector: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   scale: float = 256.0, chunk: int = CHUNK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on the columns of ``rows``; ``label`` is column ``label`` unless given.  Each chunk of
    anchors is a pass of its own over the candidates, which are never shuffled.
    """
    spark = session_of(rows)
    own_label = F.col("label") if label is None else label
    source = usable(rows, F.col(f"`{row_id}`"), own_label, F.col(f"`{vector}`"))
    asked = usable(rows.where(is_anchor), F.col(f"`{row_id}`"), own_label, F.col(f"`{vector}`")).distinct()
    anchors = materialise(spark, asked.withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    n_chunks = max(1, -(-anchors.count() // chunk))
    anchors = anchors.withColumn("chunk", F.pmod(F.xxhash64("anchor"), F.lit(n_chunks)))
    width = source.agg(F.max(F.size("vector"))).first()[0] or 0

    def passed(kernel, size: int, windows: DataFrame | None, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        for k in range(n_chunks):  # a chunk is about ``chunk`` rows, whatever the input
            some = anchors.where(F.col("chunk") == k).drop("chunk").toArrow()
            own = windows.where(F.col("chunk") == k).drop("chunk").toArrow() if windows is not None else None
            held = spark.sparkContext.broadcast(Anchors(some, width, scale, own, positives))
            (_streamed(spark, source).mapInArrow(lambda b, held=held: kernel(b, held.value, size, width, scale),
                                                 "anchor bigint, place int, score bigint, id bigint")
             .write.mode("append").parquet(path))
            held.unpersist()
        return spark.read.schema("anchor bigint, place int, score bigint, id bigint").parquet(path)

    best = _best(passed(_positive_heaps, positives, None, "positive-heaps").drop("place"), positives, "anchor")
    found = materialise(spark, best.select("anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"),
                                           F.col("score").alias("positive_score")), "positives")
    wide = F.col("positive_score").cast("decimal(38,0)")
    windows = (found.join(anchors.select("anchor", "chunk"), "anchor")
               .select("chunk", "anchor", "place", F.ceil(wide * low / 100).cast("bigint").alias("low"),
                       F.floor(wide * high / 100).cast("bigint").alias("high")))
    windows = materialise(spark, windows, "windows")
    mined = _best(passed(_negative_heaps, negatives, windows, "negative-heaps"), negatives, "anchor", "place")
    return (mined.join(found, ["anchor", "place"]).join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))
