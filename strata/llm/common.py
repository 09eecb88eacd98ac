"""Helpers shared by the corpus operators: scratch tables, words, hashes, Arrow columns.

Word rules (fixed by the query contracts):

* ``plain_words``: lower-case A-Z, then runs of digits, letters and non-ASCII
  characters, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
* ``blank_words``: runs of anything but ``[\\x20\\x09-\\x0D]``.

Both work on the UTF-8 bytes: every character above U+007F consists of bytes
above 0x7F, so the byte patterns accept exactly the same words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

PLAIN_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Texts are worked on in slices of about so many bytes, so that a batch of long ones stays small.
SLICE_BYTES = 4 << 20
#: Size of a pre-selection bitmap that goes to the executors: 2^22 bits, 512 KB, whatever the input.
BITMAP_BITS = 22


def plain_words(text: str | None) -> list[bytes]:
    return PLAIN_WORD.findall(text.encode().lower()) if text else []


def blank_words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


class WordHashes(dict):
    """Word to 64-bit hash; forgets all it knows once it holds ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values (multiply and xor-shift)."""
    x = x.copy()
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def shingle_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` word hashes; a shorter text is one run, an empty one none."""
    n = len(codes)
    if n == 0:
        return codes
    size = min(size, n)
    out = np.full(n - size + 1, np.uint64(size))
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k:n - size + 1 + k]
    return mixed(out)


def as_long(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed BIGINT."""
    return x.view(np.int64)


def text_slices(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts as Python strings, in lists of about ``SLICE_BYTES``."""
    part, held = [], 0
    for value in texts:
        text = value.as_py()
        part.append(text)
        held += len(text) if text else 0
        if held >= SLICE_BYTES:
            yield part
            part, held = [], 0
    if part:
        yield part


def array_slices(texts: pa.Array, size: int = 4 * SLICE_BYTES) -> Iterator[pa.Array]:
    """The texts as Arrow slices of about ``size`` bytes, a longer text alone."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, len(texts)
    while at < n:
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column from one numpy array per row."""
    ends = np.cumsum([0] + [len(p) for p in parts])
    values = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def materialise(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back.

    Cuts lineage, fixes generated row keys and survives lost executors.
    """
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def session_of(df: DataFrame) -> SparkSession:
    """The frame's session, with this package made importable on its executors."""
    ship_package(df.sparkSession)
    return df.sparkSession


def bitmap(rows: DataFrame, column: str) -> np.ndarray:
    """Bits set at the low ``BITMAP_BITS`` of a BIGINT column; at most 2^16 rows of 64 bits reach the driver.

    Membership in it is necessary, never sufficient: a pre-selection before an exact join.
    """
    low = F.col(column).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    words = (rows.select(F.shiftright(low, 6).alias("w"),
                             F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
    bits = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    bits[words["w"].to_numpy()] = words["b"].to_numpy()
    return bits


def passes(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    low = codes & np.uint64((1 << BITMAP_BITS) - 1)
    return (bits[(low >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (low & np.uint64(63))) & np.uint64(1) > 0


def runs_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows with equal values in the first ``keys`` columns, as tables of whole runs.

    Batches are joined only as far as a run crosses their border.
    """
    held: list[pa.RecordBatch] = []

    def last_start(batch: pa.RecordBatch) -> int:
        cut = 0
        for k in range(keys):
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change = np.flatnonzero(v[1:] != v[:-1])
            cut = max(cut, int(change[-1]) + 1 if len(change) else 0)
        return cut

    def same_key(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
        return all(a.column(k)[a.num_rows - 1].as_py() == b.column(k)[0].as_py() for k in range(keys))

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and not same_key(held[-1], batch):
            yield pa.Table.from_batches(held)
            held = []
        cut = last_start(batch)
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def bounds_of(*keys: np.ndarray) -> np.ndarray:
    """Borders of the runs of equal keys, first 0 and last the length."""
    change = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [len(keys[0])]])


def flagged(rows: DataFrame, key: Column, ids: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean column ``name``: false only if the BIGINT ``key`` is surely not among ``ids`` (id).

    The same bitmap as ``bitmap``, as a broadcast table of at most 2^16 rows: in DataFrame operations only.
    """
    low = F.col("id").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    bits = (ids.select(F.shiftright(low, 6).alias("_bit_word"), F.expr("shiftleft(1L, cast(id & 63 as int))").alias("_bits"))
            .groupBy("_bit_word").agg(F.bit_or("_bits").alias("_bits")))
    at = F.shiftright(key.bitwiseAND(F.lit((1 << BITMAP_BITS) - 1)), 6) == bits["_bit_word"]
    hit = F.coalesce(F.getbit(F.col("_bits"), key.bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))
    return rows.join(F.broadcast(bits), at, "left").withColumn(name, hit).drop("_bit_word", "_bits")


def folded(docs: DataFrame, **own: Column) -> DataFrame:
    """All columns of ``docs`` in one struct ``all``, beside columns of the operator's own: names cannot clash."""
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all")
    return docs.select(every, *[column.alias(name) for name, column in own.items()])


def unfolded(rows: DataFrame, columns: list[str], **own: Column) -> DataFrame:
    """The columns of ``all`` again; ``own`` columns replace those of the same name or are added."""
    kept = [own.pop(c).alias(c) if c in own else F.col("all").getField(c).alias(c) for c in columns]
    return rows.select(*kept, *[column.alias(name) for name, column in own.items()])
