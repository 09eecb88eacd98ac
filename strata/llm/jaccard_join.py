"""N-gram Jaccard join with Bayesian pruning of candidate pairs.

Documents are sets of ``size``-word shingles.  Equal sets form one class (so
copies are never expanded into pairs); classes are joined:

1. Every class gets ``BANDS * ROWS`` MinHash values, one byte each.  Classes that
   agree on all values of a band meet in a bucket.
2. Inside a bucket, pairs are compared incrementally: after every ``STEP`` values
   a pair is dropped when the posterior probability that its similarity reaches
   the threshold (uniform prior) is below ``tolerance``.  What survives is emitted
   as a spanning forest of the bucket, never as pairs.  A bucket of more than
   ``BLOCK`` classes is handed on as a star, unpruned.
3. The forests' connected components hold every candidate pair.  Each component
   is cut into blocks; every pair of blocks is one unit of work of bounded size,
   in which the same incremental comparison prunes and the exact Jaccard
   similarity of the shingle sets decides.  A unit emits link counts and a
   spanning forest of the verified links.
4. Components of the verified forests are the classes of near duplicates.

Pairs at the threshold itself miss every band with probability
``(1 - threshold^ROWS)^BANDS`` = 6.8e-6 at 0.8, and the pruning drops them with
probability below ``tolerance`` per comparison step; both fall steeply above.

Words are ``common.plain_words``; a text of fewer than ``size`` words, but not
none, is one shingle.  Defined results: a null or wordless text has no links and
is a class of its own; repeated rows count as copies; a null doc_id takes part
but never names a class unless it has no other; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (WordHashes, bitmap, bounds_of, folded, materialise, mixed, passes, plain_words, runs_of, session_of,
                     shingle_hashes, text_slices, unfolded)
from .components import components

SIZE = 5
THRESHOLD = 0.8
TOLERANCE = 1e-6
BANDS, ROWS, STEP = 30, 5, 15
#: Most members of a bucket that are compared in place, and of a unit of verification (about).
BLOCK = 256
#: Largest matrix (cells) for counting common shingles of a unit at once; beyond it, pair by pair.
MATRIX_CELLS = 24_000_000

_MULTIPLIERS = np.random.default_rng(20240229).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """Compared values -> fewest equal ones at which P(similarity >= threshold) reaches the tolerance.

    With a uniform prior, m equal of n give a Beta(m + 1, n - m + 1) posterior, and
    its mass above t is P(Binomial(n + 1, t) <= m).
    """
    table = {}
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        mass, m = (1 - threshold) ** (n + 1), 0
        while mass < tolerance:
            m += 1
            mass += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        table[n] = m
    return table


def surviving(signs: np.ndarray, left: np.ndarray, right: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Places in ``left``/``right`` of the pairs that the incremental comparison does not drop."""
    alive, equal = np.arange(len(left)), np.zeros(len(left), np.int32)
    for n, fewest in least.items():
        part = slice(n - STEP, n)
        equal = equal + (signs[left[alive], part] == signs[right[alive], part]).sum(1, dtype=np.int32)
        keep = equal >= fewest
        alive, equal = alive[keep], equal[keep]
        if not len(alive):
            break
    return alive


def shingle_set(text: str | None, hashes: WordHashes, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(hashes.of(plain_words(text)), size))


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``BANDS * ROWS`` bytes per non-empty set."""
    if not sets:
        return np.empty((0, BANDS * ROWS), np.uint8)
    values = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), BANDS * ROWS), np.uint8)
    for k, a in enumerate(_MULTIPLIERS):
        out[:, k] = mixed(np.minimum.reduceat(values * a, starts)).astype(np.uint8)
    return out


def _signed_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        done = 0
        for texts in text_slices(batch.column(0)):
            sets = [shingle_set(t, hashes, size) for t in texts]
            signs = iter(minhashes([s for s in sets if len(s)]))
            rows = [(xxhash.xxh3_128_digest(s.tobytes()), next(signs).tobytes()) if len(s) else (None, None)
                    for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()),
                 batch.column(1).slice(done, len(texts))], ["content", "sign", "doc"])
            done += len(texts)


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights = np.int64(256) ** np.arange(ROWS, dtype=np.int64)
    for batch in batches:
        n = batch.num_rows
        signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, BANDS, ROWS)
        keys = signs.astype(np.int64) @ weights + (np.arange(BANDS, dtype=np.int64) << (8 * ROWS))
        reps = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(reps)], ["bucket", "rep"])


def _shared_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of buckets with two to BLOCK members, and star edges of larger ones.

    Memory stays bounded: only the running bucket's first members are held.
    """
    bucket, held, lead = None, [], 0
    for batch in batches:
        keys, reps = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        if not len(keys):
            continue
        out_key, out_rep, out_to = [], [], []
        bounds = bounds_of(keys).tolist()
        for a, b in zip(bounds, bounds[1:]):
            if keys[a] != bucket:
                if 1 < len(held) <= BLOCK:
                    out_key += [bucket] * len(held)
                    out_rep += held
                    out_to += [None] * len(held)
                bucket, held, lead = keys[a], [], reps[a]
            if b - a == 1 and not held:
                held = [reps[a]]
                continue
            members = reps[a:b].tolist()
            if len(held) <= BLOCK:
                held += members
                members = held if len(held) > BLOCK else []
            out_key += [bucket] * len(members)
            out_rep += members
            out_to += [lead] * len(members)
        yield pa.RecordBatch.from_arrays([pa.array(out_key, pa.int64()), pa.array(out_rep, pa.int64()),
                                          pa.array(out_to, pa.int64())], ["bucket", "rep", "lead"])
    if 1 < len(held) <= BLOCK:
        yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(held), pa.int64()), pa.array(held, pa.int64()),
                                          pa.nulls(len(held), pa.int64())], ["bucket", "rep", "lead"])


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member of each member's component, for ``n`` members and few edges."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, left, root[right])
        np.minimum.at(low, right, root[left])
        low = np.minimum(low, low[low])
        if (low == root).all():
            return root
        root = low


def _bucket_forests(batches: Iterator[pa.RecordBatch], least: dict[int, int]) -> Iterator[pa.RecordBatch]:
    for table in runs_of(batches, 1):
        keys, reps = (table.column(k).to_numpy() for k in (0, 1))
        signs = np.frombuffer(b"".join(table.column(2).to_pylist()), np.uint8).reshape(len(keys), -1)
        bounds = bounds_of(keys)
        sizes = np.diff(bounds)
        tails, heads = [], []
        for size in np.unique(sizes).tolist():  # buckets of equal size together
            first = bounds[:-1][sizes == size]
            i, j = np.triu_indices(size, 1)
            per = max(1, 200_000 // len(i))
            for k in range(0, len(first), per):
                left, right = ((first[k:k + per, None] + x).ravel() for x in (i, j))
                alive = surviving(signs, left, right, least)
                if size == 2:
                    tails.append(right[alive])
                    heads.append(left[alive])
                elif len(alive):
                    near = np.unique(np.concatenate([left[alive], right[alive]]))
                    at = _forest(len(near), np.searchsorted(near, left[alive]), np.searchsorted(near, right[alive]))
                    tails.append(near)
                    heads.append(near[at])
        a = reps[np.concatenate(tails)] if tails else np.empty(0, np.int64)
        b = reps[np.concatenate(heads)] if heads else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _set_rows(batches: Iterator[pa.RecordBatch], bits: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """(content, shingles) of the texts whose class is asked for, as far as the bitmap can tell."""
    hashes = WordHashes()
    for batch in batches:
        for texts in text_slices(batch.column(0)):
            sets = [s for s in (shingle_set(t, hashes, size) for t in texts) if len(s)]
            names = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            low = np.frombuffer(b"".join(names), np.uint8).reshape(-1, 16)[:, 13:].astype(np.uint64)
            low = low @ np.array([65536, 256, 1], np.uint64)
            wanted = np.flatnonzero(passes(bits, low)) if len(names) else []
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in wanted], pa.binary()),
                                              pa.array([sets[k].tobytes() for k in wanted], pa.binary())],
                                             ["content", "shingles"])


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact number of common shingles for each pair."""
    if len(left) > 2 * len(sets):
        values, place = np.unique(np.concatenate(sets), return_inverse=True)
        shared = np.bincount(place) > 1
        n = int(shared.sum())
        if n * len(sets) <= MATRIX_CELLS:
            column = np.cumsum(shared) - 1
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            keep = shared[place]
            has = np.zeros((len(sets), n), np.float32)
            has[owner[keep], column[place[keep]]] = 1
            return (has @ has.T)[left, right].astype(np.int64)
    return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right)], np.int64)


def _verified_rows(batches: Iterator[pa.RecordBatch], least: dict[int, int],
                   threshold: float) -> Iterator[pa.RecordBatch]:
    """Per member of a unit with links: (rep, documents linked here, smallest linked member here)."""
    for table in runs_of(batches, 3):
        keys = [table.column(k).to_numpy() for k in range(3)]
        reps, blocks, copies = (table.column(k).to_numpy() for k in (3, 4, 5))
        signs = np.frombuffer(b"".join(table.column(6).to_pylist()), np.uint8).reshape(len(reps), -1)
        bounds = bounds_of(*keys).tolist()
        out = [], [], []
        for a, b in zip(bounds, bounds[1:]):
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column(7).slice(a, b - a)]
            lengths = np.array([len(s) for s in sets])
            block, inside = blocks[a:b], keys[1][a] == keys[2][a]
            left, right = np.triu_indices(b - a, 1)
            fits = (inside | (block[left] != block[right])) & (
                np.minimum(lengths[left], lengths[right]) >= threshold * np.maximum(lengths[left], lengths[right]) - 1e-9)
            left, right = left[fits], right[fits]
            alive = surviving(signs[a:b], left, right, least)
            left, right = left[alive], right[alive]
            if not len(left):
                continue
            both = common_counts(sets, left, right)
            linked = both >= threshold * (lengths[left] + lengths[right] - both) - 1e-9
            left, right = left[linked], right[linked]
            n = np.bincount(left, copies[a:b][right], b - a) + np.bincount(right, copies[a:b][left], b - a)
            root = _forest(b - a, left, right)
            who = np.flatnonzero(n)
            out[0].append(reps[a:b][who])
            out[1].append(n[who].astype(np.int64))
            out[2].append(reps[a:b][root[who]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out],
                                         ["rep", "linked", "head"])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE,
                    threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document row: (doc_id, class_id, n_links, n_copies).

    ``class_id`` is the smallest doc_id of the documents that are connected by
    links (Jaccard similarity of at least ``threshold``); ``n_links`` counts the
    documents linked to this one, ``n_copies`` those with the same shingle set
    (itself included).
    """
    spark = session_of(docs)
    least = least_matches(threshold, tolerance)
    source = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{doc_id}`").alias("doc"))
    kind = source.schema["doc"].dataType.simpleString()
    signed = materialise(spark, source.mapInArrow(lambda b: _signed_rows(b, size),
                                                  f"content binary, sign binary, doc {kind}"), "signed")
    reps = materialise(spark, signed.where("content IS NOT NULL").groupBy("content")
                       .agg(F.first("sign").alias("sign"), F.count(F.lit(1)).alias("copies"),
                            F.min("doc").alias("least_doc"))
                       .withColumn("rep", F.monotonically_increasing_id()), "classes")

    shared = materialise(spark, reps.select("rep", "sign").mapInArrow(_band_rows, "bucket bigint, rep bigint")
                         .repartition("bucket").sortWithinPartitions("bucket")
                         .mapInArrow(_shared_buckets, "bucket bigint, rep bigint, lead bigint"), "buckets")
    pruned = (shared.where("lead IS NULL").join(reps.select("rep", "sign"), "rep").select("bucket", "rep", "sign")
              .repartition("bucket").sortWithinPartitions("bucket")
              .mapInArrow(lambda b: _bucket_forests(b, least), "a bigint, b bigint"))
    stars = shared.where("lead IS NOT NULL").select(F.col("rep").alias("a"), F.col("lead").alias("b"))
    groups = materialise(spark, components(pruned.union(stars)), "candidates")

    half = BLOCK // 2
    blocks = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n")).select(
        "root", F.when(F.col("n") <= BLOCK, F.lit(1)).otherwise(F.ceil(F.col("n") / half)).cast("int").alias("n_blocks"))
    members = materialise(spark, groups.join(blocks, "root").withColumnRenamed("node", "rep").join(reps, "rep")
                          .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int")), "members")
    low = members.select(F.conv(F.hex(F.substring("content", 14, 3)), 16, 10).cast("bigint").alias("low"))
    bits = spark.sparkContext.broadcast(bitmap(low, "low"))
    sets = (docs.select(F.col(f"`{text}`").alias("text"))
            .mapInArrow(lambda b: _set_rows(b, bits.value, size), "content binary, shingles binary")
            .groupBy("content").agg(F.first("shingles").alias("shingles")))
    units = (members.join(sets, "content")
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
             .select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                     "rep", "block", "copies", "sign", "shingles"))
    verified = materialise(spark, units.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
                           .mapInArrow(lambda b: _verified_rows(b, least, threshold),
                                       "rep bigint, linked bigint, head bigint"), "links")
    links = verified.groupBy("rep").agg(F.sum("linked").alias("linked"))
    near = components(verified.select(F.col("rep").alias("a"), F.col("head").alias("b")))
    near = near.withColumnRenamed("node", "rep")
    names = near.join(reps, "rep").groupBy("root").agg(F.min("least_doc").alias("name"))
    joined = near.join(names, "root").join(links, "rep").select("rep", "name", "linked")
    known = (reps.join(joined, "rep", "left")
             .select("content", "copies", F.coalesce("name", "least_doc").alias("class_id"),
                     (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")))
    return (signed.select("content", "doc").join(known, "content", "left")
            .select(F.col("doc").alias("doc_id"),
                    F.when(F.col("content").isNull(), F.col("doc")).otherwise(F.col("class_id")).alias("class_id"),
                    F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                    F.coalesce("copies", F.lit(1)).cast("bigint").alias("n_copies")))


def one_per_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class of near duplicates, all columns unchanged.

    The row with the smallest (doc_id, text hash) stays; rows that are equal in both are one document
    and leave one row.
    """
    text_hash = F.xxhash64(F.col(f"`{text}`"))
    keyed = docs.select(F.struct(F.col(f"`{doc_id}`").alias("id"), text_hash.alias("h")).alias("doc"),
                        F.col(f"`{text}`").alias("text"))
    stay = (near_duplicates(keyed, "doc", "text", **options).where("doc_id = class_id").groupBy("doc_id")
            .agg(F.count(F.lit(1)).alias("n")))
    stay = materialise(docs.sparkSession, stay.select(F.col("doc_id.id").alias("stay_id"), F.col("doc_id.h").alias("stay_h"), "n"),
                       "stay")
    rows = folded(docs, id=F.col(f"`{doc_id}`"), h=text_hash)
    same = F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("h") == F.col("stay_h"))
    single = rows.join(stay.where("n = 1"), same).select("all")
    many = rows.join(stay.where("n > 1"), same).groupBy("stay_id", "stay_h").agg(F.first("all").alias("all"))
    return unfolded(single.union(many.select("all")), docs.columns)
