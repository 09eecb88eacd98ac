"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

An item is cut into windows of ``window`` consecutive words (a shorter item is
one window).  A window is a list of shingles of ``size`` words; its shingles are
ordered by their frequency over all documents, rarest first.  A window that a
document contains shares every shingle with it, so at containment ``threshold``
``t`` it is enough to join the ``n - ceil(t n) + 1`` rarest ones (one at t = 1).
A hit of such a shingle at word ``p`` with offset ``o`` in the window puts the
window at ``p - o``; positional and length bounds drop starts where the document
has no room for it, and the exact comparison runs over the item-sized stretch of
document words.

Data flow: documents are read twice (shingle frequencies; candidates).  Executors
pre-select shingles with a bitmap of fixed size (``common.BITMAP_BITS``), which can only
pass too many; the joins that decide are ordinary Spark joins, with the document
side salted, so neither the benchmark nor the hits have to fit anywhere.  Each
candidate carries its own stretch of words, so texts are never shuffled.

Defined results: null or wordless texts have no words and no hits; null or
wordless items have no windows; an item_id may repeat (its windows are united)
and a null item_id takes no part in ``items``, but its windows still mark words,
so that such a document is contaminated with no item named; repeated document rows
each get their own row; empty tables give empty or all-clean results; other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import (WordHashes, as_long, bitmap, folded, materialise, passes, plain_words, session_of,
                     shingle_hashes, unfolded)

WINDOW = 10
SHINGLE = 2
SALTS = 16
#: Partial counts are emitted whenever so many distinct shingles are held.
HELD_SHINGLES = 200_000


def _spans(words: list[bytes], window: int) -> list[list[bytes]]:
    if not words:
        return []
    return [words[k:k + window] for k in range(max(1, len(words) - window + 1))]


def _window_rows(batches: Iterator[pa.RecordBatch], window: int, size: int) -> Iterator[pa.RecordBatch]:
    """(item, phrase, n_words, shingles) for each window of each item."""
    for batch in batches:
        item, phrase, n, codes = [], [], [], []
        hashes = WordHashes()
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for span in _spans(plain_words(text), window):
                item.append(i)
                phrase.append(b" ".join(span).decode())
                n.append(len(span))
                codes.append(as_long(shingle_hashes(hashes.of(span), size)).tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.string()), pa.array(phrase, pa.string()), pa.array(n, pa.int32()),
             pa.array(codes, pa.list_(pa.int64()))], ["item", "phrase", "n", "shingles"])


def windows_of(items: DataFrame, item_id: str = "item_id", text: str = "text",
               window: int = WINDOW, size: int = SHINGLE) -> DataFrame:
    """Distinct windows with the items they come from: (phrase, n, shingles, items)."""
    rows = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text"))
    rows = rows.mapInArrow(lambda b: _window_rows(b, window, size),
                           "item string, phrase string, n int, shingles array<bigint>")
    return rows.groupBy("phrase").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"),
                                      F.collect_set("item").alias("items"))


def _sizes(codes_of: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """Shingles of the sizes in use: a window shorter than a shingle is one short shingle."""
    return [shingle_hashes(codes_of, k) for k in sizes if len(codes_of) >= k]


def _count_rows(batches: Iterator[pa.RecordBatch], bits: np.ndarray, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    hashes, held = WordHashes(), Counter()

    def flush() -> pa.RecordBatch:
        keys = np.fromiter(held.keys(), np.uint64, len(held))
        out = pa.RecordBatch.from_arrays([pa.array(as_long(keys)), pa.array(list(held.values()), pa.int64())],
                                         ["shingle", "n"])
        held.clear()
        return out

    for batch in batches:
        for text in batch.column(0):
            for codes in _sizes(hashes.of(plain_words(text.as_py())), sizes):
                held.update(codes[passes(bits, codes)].tolist())
            if len(held) >= HELD_SHINGLES:
                yield flush()
    yield flush()


def _candidate_rows(batches: Iterator[pa.RecordBatch], bits: np.ndarray, window: int,
                    sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """Per document its word count and, per passing shingle, (shingle, place, before, words around it)."""
    cand = pa.struct([("shingle", pa.int64()), ("place", pa.int32()), ("before", pa.int32()),
                      ("around", pa.string())])
    hashes = WordHashes()
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            n_words, found = [], []
            for text in part.column(1):
                words = plain_words(text.as_py())
                n_words.append(len(words))
                mine = []
                for codes in _sizes(hashes.of(words), sizes):
                    hits = np.flatnonzero(passes(bits, codes)).tolist()
                    for p, c in zip(hits, as_long(codes[hits]).tolist()):
                        first = max(0, p - window + 1)
                        mine.append((c, p, p - first, b" ".join(words[first:p + window]).decode()))
                found.append(mine)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n_words, pa.int64()),
                 pa.array([[dict(zip(("shingle", "place", "before", "around"), m)) for m in ms] for ms in found],
                          pa.list_(cand)), part.column(2)],
                ["row", "n_words", "found", "doc"])


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  size: int = SHINGLE, threshold: float = 1.0) -> DataFrame:
    """One row per document row: (doc_id, n_words, n_hit, items).

    ``n_hit`` counts the document words inside a stretch that holds a window's
    shingles, each at its own offset, to a share of at least ``threshold`` (1.0:
    the very words of the window); ``items`` are the sorted ids of those items.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold is a share above 0 and up to 1")
    spark = session_of(docs)
    windows = materialise(spark, windows_of(items, item_id, item_text, window, size)
                          .withColumn("unit", F.monotonically_increasing_id()), "windows")
    shingles = windows.select("unit", "n", F.posexplode("shingles").alias("offset", "shingle"))
    sizes = sorted(r[0] for r in windows.select(F.least("n", F.lit(size))).distinct().collect())  # at most ``size`` rows
    all_bits = spark.sparkContext.broadcast(bitmap(shingles, "shingle"))
    source = docs.select(F.col(f"`{text}`").alias("text"))
    counts = (source.mapInArrow(lambda b: _count_rows(b, all_bits.value, sizes), "shingle bigint, n bigint")
              .groupBy("shingle").agg(F.sum("n").alias("df")))
    ranked = (shingles.join(counts, "shingle").groupBy("unit", "n")
              .agg(F.array_sort(F.collect_list(F.struct("df", "shingle", "offset"))).alias("by_rarity"),
                   F.count(F.lit(1)).alias("m")))
    # A window with a shingle that no document has can only match below t = 1: absent shingles rank first, at no cost.
    totals = windows.select("unit", F.size("shingles").alias("total"))
    need = F.col("total") - F.ceil(F.col("total") * F.lit(threshold) - 1e-9).cast("int") + 1
    prefix = (ranked.join(totals, "unit").withColumn("take", need - (F.col("total") - F.col("m").cast("int")))
              .where("take > 0")
              .select("unit", "n", F.explode(F.slice("by_rarity", F.lit(1), F.col("take"))).alias("p"))
              .select("unit", "n", F.col("p.shingle").alias("shingle"), F.col("p.offset").alias("offset")))
    prefix = materialise(spark, prefix, "prefix")
    some_bits = spark.sparkContext.broadcast(bitmap(prefix, "shingle"))

    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{text}`").alias("text"),
                        F.col(f"`{doc_id}`").alias("doc"))
    kind = keyed.schema["doc"].dataType.simpleString()
    rows = materialise(spark, keyed.mapInArrow(
        lambda b: _candidate_rows(b, some_bits.value, window, sizes),
        "row bigint, n_words bigint, found array<struct<shingle: bigint, place: int, before: int, around: string>>, "
        f"doc {kind}"), "candidates")

    found = (rows.select("row", "n_words", F.explode("found").alias("c")).select("row", "n_words", "c.*")
             .withColumn("salt", F.pmod(F.xxhash64("row", "place"), F.lit(SALTS)).cast("int")))
    spread = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = (found.join(spread, ["shingle", "salt"])
              .withColumn("start", F.col("place") - F.col("offset"))
              .where("start >= 0 AND start + n <= n_words")  # positional and length bounds
              .withColumn("stretch", F.array_join(
                  F.slice(F.split("around", " "), F.greatest(F.lit(1), F.col("before") - F.col("offset") + 1), F.col("n")), " "))
              .select("row", "start", "unit", "n", "stretch").distinct())
    if threshold == 1.0:
        matched = placed.join(windows.select(F.col("phrase").alias("stretch"), "unit", "items"), ["unit", "stretch"])
    else:
        runs = lambda c: F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(F.split(c, " ")) - (size - 1), F.lit(1))),
            lambda k: F.array_join(F.slice(F.split(c, " "), k, size), " "))
        near = (placed.join(windows.select("unit", "phrase", "items"), "unit")
                .withColumn("same", F.zip_with(runs("phrase"), runs("stretch"), lambda a, b: a == b)))
        agree = F.size(F.filter("same", lambda x: x))
        matched = near.where(agree >= F.ceil(F.size("same") * F.lit(threshold) - 1e-9))

    hits = matched.groupBy("row", "start").agg(F.max("n").alias("n"))
    order = Window.partitionBy("row").orderBy("start")
    reach = F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    covered = (hits.withColumn("reach", F.coalesce(reach, F.lit(0)))
               .groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("start") + F.col("n")
                                                    - F.greatest("start", "reach"))).cast("bigint").alias("n_hit")))
    named = (matched.select("row", F.explode("items").alias("item")).distinct()
             .groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items")))
    return (rows.select("row", F.col("doc").alias("doc_id"), "n_words")
            .join(covered, "row", "left").join(named, "row", "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def clean_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    max_hits: int = 0) -> DataFrame:
    """``docs`` without the rows that have more than ``max_hits`` words inside benchmark windows.

    Rows are matched by id and text hash, so equal rows share one verdict and all other columns stay as they are.
    """
    key = F.xxhash64(F.col(f"`{text}`"))
    keyed = docs.select(F.struct(F.col(f"`{doc_id}`").alias("id"), key.alias("h")).alias("doc"), F.col(f"`{text}`").alias("text"))
    dirty = (contamination(keyed, items, "doc", "text").where(F.col("n_hit") > max_hits)
             .select(F.col("doc_id.id").alias("_i"), F.col("doc_id.h").alias("_h")).distinct())
    rows = folded(docs, id=F.col(f"`{doc_id}`"), h=key)
    same = F.col("id").eqNullSafe(F.col("_i")) & (F.col("h") == F.col("_h"))
    return unfolded(rows.join(dirty, same, "left_anti"), docs.columns)
