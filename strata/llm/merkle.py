"""Merkle manifest of a dataset: subtree roots meet in a butterfly exchange.

H is the lowercase hex SHA-256 of a concatenation (digests as hex text).  A row is a leaf, ``H`` of its columns, each
written ``-`` if null, else as UTF-8 byte count, ``:`` and value.  Leaves of a group, in key order, are joined
``FANOUT`` consecutive ones at a time (the last run may be shorter, even one) until one node is left, the group's
subroot; the subroots, in group order, make up the top tree and its root in the same way.

1. Every row gets its place in its group: rows are range-partitioned and sorted, and a table with a row per range and
   group gives what lies before each range.
2. Aligned runs of ``FANOUT ** levels`` leaves are the partitions of the tree.  Each hashes its own subtree.
3. Butterfly: in round r, partitions that agree in all base-``FANOUT`` digits of their number but digit r swap their
   subtree roots, at most ``FANOUT`` of them in an exchange, and every one hashes the common parent itself.  So after
   each round every partition knows its ancestor and that level's siblings, and nothing has to be sent down again.
   Where the last subtree is short of partitions, those that it has also answer for the missing ones.
4. The top tree is built by the same steps over the table of subroots, with one group.
5. Each partition writes its leaves with their proofs: per level the siblings before and behind.

The exchange moves one small row per partition and round; the number of rounds is the logarithm of the partitions.

Defined results: equal keys are ordered by leaf, so that repeated rows are leaves of their own with a defined root;
null keys and null groups come first; an empty table has no leaves and gives no rows; a group of one leaf has it as
subroot, and a single subroot is the root; columns that are not named are no part of the leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import materialise, session_of

FANOUT, LEVELS = 8, 3
SIDES = "array<struct<before: string, after: string>>"


def digest(*parts: Column) -> Column:
    """H of the parts, null ones left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def leaf(*values: Column) -> Column:
    """The leaf of a row: ``-`` for null, else byte count, ``:`` and value."""
    return digest(*[F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")),
                               F.lit("-")) for v in values])


def folded_root(start: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its proof lead to."""
    return F.aggregate(proof, start, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""))


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` (grp, key, leaf, ...) with ``place`` in their group and the group's size ``n``.

    Rows are range-partitioned by (grp, key, leaf, row), so equal keys cannot swell one range.
    """
    spark, order = rows.sparkSession, ["grp", "key", "leaf", "_row"]
    ranged = (rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*[F.asc_nulls_first(c) for c in order])
              .sortWithinPartitions(*[F.asc_nulls_first(c) for c in order]).drop("_row"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, group, at = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            places = []
            for g in batch.column(0).to_pylist():
                group, at = (g, at) if g == group else (g, 0)
                places.append(at)
                at += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int32()),
                                              pa.array(places, pa.int64())], [*batch.schema.names, "_part", "_in"])

    shape = StructType([*ranged.schema.fields, StructField("_part", IntegerType()), StructField("_in", LongType())])
    written = materialise(spark, ranged.mapInArrow(numbered, shape), "leaves")
    sizes = written.groupBy("grp", "_part").agg(F.count(F.lit(1)).alias("_n"))  # a row per range and group in it
    ahead = Window.partitionBy("grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("grp").alias("_grp"), F.col("_part").alias("_at"),
                          F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"),
                          F.sum("_n").over(Window.partitionBy("grp")).alias("n"))
    same = F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("_part") == F.col("_at"))
    return (written.join(before, same).withColumn("place", F.col("_before") + F.col("_in"))
            .drop("_grp", "_at", "_part", "_in", "_before"))


def _runs(nodes: list[str]) -> list[list[str]]:
    return [nodes[k:k + FANOUT] for k in range(0, len(nodes), FANOUT)]


def _local_levels(n: int, levels: int) -> int:
    """Levels that a partition hashes by itself: all of a small group's, else ``levels``."""
    height = 0
    while n > 1 and height < levels:
        n, height = -(-n // FANOUT), height + 1
    return height


def _subtrees(leaves: pa.Array, sizes: pa.Array, levels: int) -> pa.Array:
    """Root of each partition's own subtree."""
    out = []
    for nodes, n in zip(leaves.to_pylist(), sizes.to_pylist()):
        for _ in range(_local_levels(n, levels)):
            nodes = [_hex("".join(run)) for run in _runs(nodes)]
        out.append(nodes[0])
    return pa.array(out, pa.string())


def _siblings(nodes: Column, own: Column) -> Column:
    """``nodes``: sorted (digit, node); the siblings before and behind the node of digit ``own``."""
    side = lambda keep: F.array_join(F.transform(F.filter(nodes, keep), lambda x: x["node"]), "")
    return F.struct(side(lambda x: x["digit"] < own).alias("before"), side(lambda x: x["digit"] > own).alias("after"))


def _exchange(parts: DataFrame, parts_of_group: Column, r: int) -> DataFrame:
    """Round r of the butterfly for the partitions (grp, part, n, node, sides) whose groups are not done.

    ``node`` is the partition's ancestor; afterwards it is that ancestor's parent.
    """
    width = FANOUT ** r
    low, digit = F.col("part") % width, F.floor(F.col("part") / width) % FANOUT
    own = parts.select("*", low.alias("low"), digit.alias("digit"), F.floor(F.col("part") / (width * FANOUT)).alias("high"),
                       F.least(F.lit(width), parts_of_group - (F.col("part") - low)).alias("_have"))
    # a subtree with fewer than ``width`` partitions is the last one: its partitions answer for the missing ones
    answers = F.when(F.col("digit") > 0, F.sequence(F.col("low"), F.lit(width - 1).cast("bigint"), F.col("_have")))
    sent = own.withColumn("to", F.explode(F.coalesce(answers, F.array("low")))).drop("_have")
    meet = Window.partitionBy("grp", "high", "to").orderBy("digit").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)  # at most FANOUT rows
    met = sent.withColumn("_met", F.collect_list(F.struct("digit", "node")).over(meet)).where("to = low")
    parent = F.sha2(F.array_join(F.col("_met.node"), ""), 256)
    return met.select("grp", "part", "n", parent.alias("node"),
                      F.array_append("sides", _siblings(F.col("_met"), F.col("digit"))).alias("sides"))


def _trees(leaves: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """From (grp, key, leaf, carry): partitions (grp, part, n, rows), and (grp, part, node, sides) with subroots."""
    spark, size = leaves.sparkSession, FANOUT ** levels
    placed = _placed(leaves).withColumn("part", F.floor(F.col("place") / size))
    rows = F.array_sort(F.collect_list(F.struct("place", "key", "leaf", "carry")))  # at most ``size`` rows
    aligned = materialise(spark, placed.groupBy("grp", "part").agg(F.first("n").alias("n"), rows.alias("rows")), "subtrees")
    root = F.arrow_udf(lambda nodes, n: _subtrees(nodes, n, levels), "string")
    now = aligned.select("grp", "part", "n", root(F.col("rows.leaf"), F.col("n")).alias("node"),
                         F.array().cast(SIDES).alias("sides"))
    now = materialise(spark, now, "butterfly")
    many = F.ceil(F.col("n") / size)
    most = now.agg(F.max(many)).first()[0] or 0
    r = 0
    while FANOUT ** r < most:
        going = many > FANOUT ** r
        now = materialise(spark, _exchange(now.where(going), many, r).union(now.where(~going)), "butterfly")
        r += 1
    return aligned, now


def _leaf_rows(batches: Iterator[pa.RecordBatch], names: list[str], sides: pa.DataType, levels: int) -> Iterator[pa.RecordBatch]:
    """Each partition's leaves, their proofs inside the partition followed by the partition's own."""
    for batch in batches:
        for k in range(batch.num_rows):
            part = batch.slice(k, 1)
            rows, upper = part.column(0).flatten(), part.column(1)[0].as_py()
            level, climbs = rows.field("leaf").to_pylist(), []
            for _ in range(_local_levels(part.column(2)[0].as_py(), levels)):
                runs = _runs(level)
                climbs.append([{"before": "".join(run[:i]), "after": "".join(run[i + 1:])}
                               for run in runs for i in range(len(run))])
                level = [_hex("".join(run)) for run in runs]
            proofs = [[climb[i // FANOUT ** h] for h, climb in enumerate(climbs)] + upper for i in range(len(rows))]
            here = pa.array([0] * len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [rows.field("key"), rows.field("leaf"), rows.field("carry"), *(c.take(here) for c in part.columns[3:]),
                 pa.array(proofs, sides)], names)


def _proved(aligned: DataFrame, done: DataFrame, levels: int, **own: Column) -> DataFrame:
    """(key, leaf, carry, own..., proof) of all leaves; ``own`` and ``sides`` are columns of ``done``."""
    upper = done.select(F.col("grp").alias("_grp"), F.col("part").alias("_part"), F.col("sides").alias("upper"),
                        *[c.alias(name) for name, c in own.items()])
    joined = aligned.join(upper, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("part") == F.col("_part")))
    rows = joined.select("rows", "upper", "n", "grp", *own)
    entry = aligned.schema["rows"].dataType.elementType
    names = ["key", "leaf", "carry", "grp", *own, "proof"]
    kinds = [entry["key"].dataType, entry["leaf"].dataType, entry["carry"].dataType,
             *[rows.schema[c].dataType for c in ("grp", *own)]]
    shape = ", ".join(f"{n} {k.simpleString()}" for n, k in zip(names, kinds)) + f", proof {SIDES}"
    sides = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    return rows.mapInArrow(lambda b: _leaf_rows(b, names, sides, levels), shape)


def manifest(rows: DataFrame, group: Column, key: Column, leaf_of: Column, levels: int = LEVELS, **carry: Column) -> DataFrame:
    """Per row: (group, key, carry..., leaf, subroot, root, proof).

    ``proof`` has per level, from the leaf to the root, the concatenated siblings before and behind: see
    ``folded_root``.  ``carry`` columns pass through.
    """
    spark: SparkSession = session_of(rows)
    kept = F.struct(*[c.alias(name) for name, c in carry.items()] or [F.lit(0).alias("_none")])
    leaves = materialise(spark, rows.select(group.alias("grp"), key.alias("key"), leaf_of.alias("leaf"),
                                            kept.alias("carry")), "rows")
    aligned, done = _trees(leaves, levels)
    # a subroot is a leaf of the top tree, whose only group is null
    subroots = done.where("part = 0").select(F.lit(None).cast("string").alias("grp"), F.col("grp").alias("key"),
                                             F.col("node").alias("leaf"), F.struct(F.lit(0).alias("_none")).alias("carry"))
    top_aligned, top_done = _trees(materialise(spark, subroots, "subroots"), levels)
    tops = _proved(top_aligned, top_done, levels, root=F.col("node")).select(
        F.col("key").alias("_top"), "root", F.col("proof").alias("above"))
    climbed = done.join(tops, F.col("grp").eqNullSafe(F.col("_top"))).select(
        "grp", "part", "node", "root", F.concat("sides", "above").alias("sides"))
    proved = _proved(aligned, climbed, levels, subroot=F.col("node"), root=F.col("root"))
    return proved.select(F.col("grp").alias("group"), "key", *[F.col(f"carry.{name}").alias(name) for name in carry],
                         "leaf", "subroot", "root", "proof")
