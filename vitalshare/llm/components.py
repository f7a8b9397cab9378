"""Connected components by alternating large and small stars.

Every round replaces edges by edges to smaller nodes and is written to the shared folder, so
lost executors cost no earlier round; the edges never exceed what came in, and hub nodes are
equi-join keys that adaptive execution may split. The driver sees a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalshare.sources.writers import stage_table


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b); root is the component's smallest node."""
    found = stars(edges)
    roots = found.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return found.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def stars(edges: DataFrame) -> DataFrame:
    """(a, b) for every node a of ``edges`` (a, b) but the smallest of its component, which is b;
    stored. With further edges they may come in again: what is settled stays so."""
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = edges.where("a <> b").select(u, v)
    while True:
        now = stage_table(_small_star(_large_star(now)), "edges")
        if not _unsettled(now):
            return now.select(F.col("u").alias("a"), F.col("v").alias("b"))


def _unsettled(edges: DataFrame) -> int:
    """Nodes with two smaller neighbours, or with a smaller and a larger one."""
    side = lambda c, up: edges.select(F.col(c).alias("node"), F.lit(up).alias("up"))
    ends = side("u", 1).unionByName(side("v", 0)).groupBy("node")
    ends = ends.agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return ends.where("up > 1 or (up = 1 and n > 1)").count()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("x"))
    return larger.join(least, "u").select(F.col("x").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
