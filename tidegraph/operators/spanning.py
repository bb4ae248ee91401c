"""Minimum spanning forests of many worlds at once, and the edge at which two vertices meet.

When the edges of a world are repaired in the order of their times, two vertices meet
at the latest edge on their way through the minimum spanning tree.  The trees of all
worlds grow in Boruvka's rounds: every component takes its earliest edge to another
one, and components become one by pointer jumping.  Rounds grow with the logarithm
of the vertices of a world, not with the number of worlds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.plans.lineage import cut


def _roots(picks: DataFrame) -> DataFrame:
    """(world, c, root) of (world, c, up), where each component points at the one that its edge leads to."""
    back = picks.select("world", F.col("c").alias("up"), F.col("up").alias("again"))
    # two that point at each other took the same edge; the smaller is the root
    own = picks.join(back, ["world", "up"]).select("world", "c", F.when((F.col("again") == F.col("c")) & (F.col("c") < F.col("up")), F.col("c")).otherwise(F.col("up")).alias("root"))
    own = cut(own)
    while True:
        next_ = own.select("world", F.col("c").alias("root"), F.col("root").alias("further"))
        after = cut(own.join(next_, ["world", "root"]).select("world", "c", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")))
        own = after.select("world", "c", "root")
        if after.where("moved").isEmpty():
            return own


def minimum_spanning(edges: DataFrame) -> DataFrame:
    """(world, edge_id, src, dst, t): the minimum spanning forest of each world of such edges by (t, edge_id), which differ within a world."""
    rows = cut(edges.where("src <> dst").select("world", "edge_id", "src", "dst", "t", F.col("src").alias("ca"), F.col("dst").alias("cb")))
    tree = edges.select("world", "edge_id", "src", "dst", "t").limit(0)
    while not rows.isEmpty():
        edge = F.struct("t", "edge_id", "src", "dst")
        sides = rows.select("world", F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("cb").alias("up")), F.struct(F.col("cb").alias("c"), F.col("ca").alias("up")))).alias("x"), edge.alias("edge"))
        picks = cut(sides.groupBy("world", "x.c").agg(F.min(F.struct("edge", "x.up")).alias("p")).select("world", "c", "p.edge", "p.up"))
        tree = tree.unionByName(picks.select("world", "edge.edge_id", "edge.src", "edge.dst", "edge.t").distinct())
        root = _roots(picks.select("world", "c", "up"))
        for side in ("ca", "cb"):
            rows = rows.join(root.select("world", F.col("c").alias(side), F.col("root").alias("r")), ["world", side]).drop(side).withColumnRenamed("r", side)
        rows = cut(rows.where("ca <> cb"))
    return tree


def meeting_edges(tree: DataFrame, s: int, t: int) -> DataFrame:
    """(world, edge_id, t) of the latest edge between two vertices in each world's tree; no row where they never meet.

    Leaves that are neither of the two go, round by round, until the ways between
    them are left.
    """
    rows = cut(tree.select("world", "edge_id", "src", "dst", "t"))
    while True:
        ends = rows.select("world", F.explode(F.array("src", "dst")).alias("v"))
        leaves = cut(ends.groupBy("world", "v").agg(F.count("*").alias("k")).where((F.col("k") == 1) & ~F.col("v").isin(s, t)).select("world", "v"))
        if leaves.isEmpty():
            latest = rows.groupBy("world").agg(F.max(F.struct("t", "edge_id")).alias("x"))
            return latest.select("world", "x.edge_id", "x.t")
        for side in ("src", "dst"):
            rows = rows.join(leaves.withColumnRenamed("v", side), ["world", side], "left_anti")
        rows = cut(rows.select("world", "edge_id", "src", "dst", "t"))
