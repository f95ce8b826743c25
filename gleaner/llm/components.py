"""Connected components of an edge table, by alternating large and small stars.

Each round is two group-by-minimum passes joined back to the edges; the number of
rounds grows with the logarithm of the longest chain. Minima are taken with
partial aggregation. Where there are few edges (counted), the minima are broadcast to them;
beyond that they're a table of their own, so that a node with very many neighbours is
only a skewed join of two plain shuffles, which adaptive execution splits; no node's
neighbours are gathered in one task. Every round is written to the shared folder, and
the one before it dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import delete_path, scratch_path


#: Edges up to which the minima, a row of 16 bytes for each node, are broadcast.
FEW = 500_000


def _neighbours(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u != v, each once: both ways for a large star, (greater, smaller) for a small one."""
    if large:
        return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _least(neighbours: DataFrame) -> DataFrame:
    return neighbours.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _star(neighbours: DataFrame, least: DataFrame, large: bool) -> DataFrame:
    """The edges after a pass, as (greater, smaller)."""
    joined = neighbours.join(least, "u")
    if large:
        linked = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: u, v (any order, loops and repeats allowed). Returns node, root: the smallest node of its component.

    Nodes without an edge to another node are left out. Null ends are dropped.
    """
    spark, kept = edges.sparkSession, []

    def written(df: DataFrame) -> DataFrame:
        kept.append(scratch_path(spark, "star"))
        df.write.option("compression", "zstd").parquet(kept[-1])
        return spark.read.schema(df.schema).parquet(kept[-1])

    def passed(now: DataFrame, large: bool, few: bool) -> DataFrame:
        near = _neighbours(now, large)
        return _star(near, F.broadcast(_least(near)) if few else written(_least(near)), large)

    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for path in kept[:-1]:
            delete_path(spark, path)
        if not mark[0] or mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        # small stars come first: of many edges to a few hubs, one a node is left
        few, seen = mark[0] <= FEW, mark
        now = written(passed(passed(now, False, few), True, few))
