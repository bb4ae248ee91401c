"""Connected components of large graphs by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.lineage import written
from tidegraph.llm.skew import join_spread


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b), component being its smallest node.

    Each round points the larger neighbours of a node, then its smaller ones, at
    the smallest neighbour, until nothing moves; the number of rounds grows with
    the logarithm of the longest path.  The edges of a node that has very many are
    spread over tasks.  Rounds are written as tables: a checkpoint would keep Spark's
    estimate of its size, which is the product of all that the rounds before joined,
    until the driver is busy with numbers of millions of digits.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = join_spread(both, low, ["a"], total=2 * state[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down.hint("merge"), "a").select("b", "m").where("b <> m").unionByName(down.select(F.col("a").alias("b"), "m"))
        edges = written(small.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "stars")
    roots = edges.select(F.col("b").alias("a"), "b").distinct()
    return edges.unionByName(roots).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
