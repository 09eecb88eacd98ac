"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_scratch, scratch_path


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a BIGINT, b BIGINT); root is the smallest node.

    Each round is two aggregations and two joins on the node and is written to
    the shared scratch folder; the number of rounds grows with the logarithm of
    the node count.  Only a count and a checksum per round reach the driver.
    """
    spark = edges.sparkSession
    path = scratch_path(spark, "stars")
    (edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
     .write.parquet(path))
    before = None
    while True:
        now = spark.read.schema("u bigint, v bigint").parquet(path)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return (now.select(F.col("u").alias("node"), F.col("v").alias("root"))
                    .union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        following = scratch_path(spark, "stars")
        small.write.parquet(following)
        drop_scratch(path)
        path = following


#: Edges up to which a star's centre may meet all of them in one task (a few tens of MB).
TASK_EDGES = 2_000_000


def connected(edges: DataFrame) -> DataFrame:
    """The same as ``components``, in two shuffles a round while the edges are few.

    Each star is one shuffle on the node: equal edges fall together, a window finds the smallest neighbour.  No task can
    then see more than all edges, so this is used up to ``TASK_EDGES`` of them; beyond it, ``components`` is.
    """
    spark = edges.sparkSession
    path = scratch_path(spark, "stars")
    (edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
     .write.parquet(path))
    before, node = None, Window.partitionBy("u")

    def merged(rows: DataFrame) -> DataFrame:
        """Different edges, and the smallest neighbour of ``u``."""
        return rows.repartition("u").groupBy("u", "v").agg(F.lit(1).alias("_one")).drop("_one").withColumn("m", F.min("v").over(node))

    while True:
        now = spark.read.schema("u bigint, v bigint").parquet(path)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] > TASK_EDGES:
            return components(now.toDF("a", "b"))
        if state == before or state[0] == 0:
            return (now.select(F.col("u").alias("node"), F.col("v").alias("root"))
                    .union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = merged(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        met = merged(large)
        # every node keeps its edge to the smallest neighbour, and so do the others of its neighbours
        ends = F.when(F.col("v") == F.col("m"), F.struct(F.col("u").alias("u"), F.col("m").alias("v"))).otherwise(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        following = scratch_path(spark, "stars")
        met.select(ends.alias("e")).select("e.u", "e.v").distinct().write.parquet(following)
        drop_scratch(path)
        path = following
