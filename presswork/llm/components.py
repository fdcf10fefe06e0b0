"""Connected components of a graph in a DataFrame, by alternating stars.

Each round hangs the larger neighbours of a node, then the smaller ones, on its
least neighbour. The least neighbours come from a partial aggregation and are
written before they are joined: both sides of the join are plain exchanges then,
which Spark splits where a node has very many neighbours. Every round is written
to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    hung = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    out = materialize(hung, "hung")
    release(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges``: larger node first, as the large stars leave them."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    hung = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = materialize(hung.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "stars")
    release(least)
    return out


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one node only, and that on none: one pass, no join."""
    hangs = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    holds = edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    role = hangs.union(holds).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return role.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (u, v: long); the root is the least node.

    Loops and repeated edges are harmless; no edges give no rows. Rounds go on
    until every node hangs on its root.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    while not _settled(now):
        large = _large_star(now)
        new = _small_star(large)
        release(now)
        release(large)
        now = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
