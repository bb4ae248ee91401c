"""Splitting with merged particles and the threshold design, as rounds over a table of particles.

A particle is a row (replicate, state, weight); a state says which vertices the edges
that were decided so far have joined.  Each edge splits its rows in two, rows in one
state become one, and of a replicate with more than n rows a sample goes on, drawn with
probabilities in proportion to weight times the chance of the likeliest way to fail
from there.

What an edge does to a state does not depend on the particles in it, so it is found
once for each state: a table of moves, which a round joins to its particles.  While
there are at most n states nothing is drawn and all replicates are alike, so one set of
particles stands for them.  From there on replicates are dealt over the tasks, and go
through the rounds between two checkpoints where they lie, without an exchange as long
as the moves are small enough for a broadcast.  A replicate holds at most 2 n rows,
which is what one task sorts.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidegraph.functions.states import uniform
from tidegraph.operators.mincut import split_size
from tidegraph.plans.lineage import TASK_ROWS, cut, kept
from tidegraph.sources.graphs import Graph

#: Rounds between checkpoints; states that no particle has reached by then are left.
ROUNDS = 4


def _split(states: DataFrame, a: int, b: int, p: float) -> DataFrame:
    """Two rows for each whose ends of the edge lie in different components, and one for the others."""
    one, two = F.col("labels")[a], F.col("labels")[b]
    joined = F.transform("labels", lambda x: F.when(x == F.greatest(one, two), F.least(one, two)).otherwise(x))
    branch = lambda labels, f: F.struct(labels.alias("labels"), F.lit(f).alias("factor"))
    ways = F.when(one == two, F.array(branch(F.col("labels"), 1.0))).otherwise(F.array(branch(joined, p), branch(F.col("labels"), 1.0 - p)))
    return states.select("state", F.explode(ways).alias("x")).select("state", "x.labels", "x.factor")


def _forget(gone: list[int]) -> Column:
    """The labels without the vertices that no later edge touches: -1 for them, for others the first place of their component."""
    left = F.transform("labels", lambda x, i: F.when(i.isin(gone), F.lit(-1)).otherwise(x)) if gone else F.col("labels")
    return F.transform(left, lambda x: F.when(x < 0, x).otherwise((F.array_position(left, x) - 1).cast("int")))


def threshold_by_group(rows: DataFrame, group: str, order: list[str], size: str, n: int, u: Column) -> DataFrame:
    """Add ``pi`` to the rows that the threshold design keeps in each group.

    The scale c of a group solves sum(min(1, c * size)) = n; rows with c * size >= 1
    stay, of the others a systematic sample, in the order of size and ``order``, with
    the group's uniform ``u``.  Groups of at most n rows stay whole.  Rows of size 0 go.
    A group is sorted in one task.
    """
    rows = rows.where(F.col(size) > 0)
    up = Window.partitionBy(group).orderBy(F.asc(size), *map(F.desc, order))
    whole = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum(size).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = rows.withColumns({"_rest": rest, "_rank": F.row_number().over(up), "_count": F.count("*").over(whole)})
    # the scale if just the rows that are greater than this one were certain; the greatest of these is the group's
    scale = F.max((F.lit(n) - F.col("_count") + F.col("_rank")) / F.col("_rest")).over(whole)
    scaled = ranked.withColumn("_scale", scale)
    placed = scaled.withColumn("pi", F.when(F.col("_count") <= n, F.lit(1.0)).otherwise(F.least(F.col("_scale") * F.col(size), F.lit(1.0))))
    # a row takes the stretch of pi that ends at c * rest; u comes up once, since it is costly to form
    taken = (F.col("pi") >= 1) | (F.pmod(F.col("_scale") * F.col("_rest") + u, F.lit(1.0)) < F.col("pi"))
    return placed.where(taken).drop("_rest", "_rank", "_count", "_scale")


def _likeliest(g: Graph, first: int, q: float) -> Callable[..., Column]:
    """The chance that just a minimum cut of the edges from ``first`` on fails, for a state's labels."""

    @F.pandas_udf(DoubleType())
    def chance(labels: pd.Series) -> pd.Series:
        return pd.Series([q ** split_size(x, g.edges[first:], g.terminals) for x in map(tuple, labels)], dtype=float)

    return chance.asNondeterministic()  # so that a filter on its values does not run it again


def _moves(states: DataFrame, g: Graph, k: int, p: float) -> tuple[DataFrame, DataFrame]:
    """(state, next, factor, chance), where edge k leads from each state while the terminals are apart, and (state, labels) of the states that it leads to."""
    last = {v: j for j, e in enumerate(g.edges) for v in e}
    gone = sorted(v for v, at in last.items() if at <= k and v not in g.terminals)
    apart = F.size(F.array_distinct(F.array(*(F.col("labels")[t] for t in sorted(set(g.terminals)))))) > 1
    after = _split(states, *g.edges[k], p).where(apart).select("state", _forget(gone).alias("labels"), "factor")
    # states are numbered in the order of their labels; minimum cuts are much work of little data, so their tasks are not merged by bytes
    each = after.select("labels").distinct().repartitionByRange(states.sparkSession.sparkContext.defaultParallelism, "labels").sortWithinPartitions("labels")
    sized = each.withColumn("chance", _likeliest(g, k + 1, 1 - p)("labels")).where("chance > 0")
    found = kept(sized.withColumn("next", F.monotonically_increasing_id()))
    return kept(after.join(found, "labels").select("state", "next", "factor", "chance")), found.select(F.col("next").alias("state"), "labels")


def splitting(spark: SparkSession, g: Graph, p: float, n: int, replicates: int, seed: int = 1) -> DataFrame:
    """(replicate, estimate): unreliability by merged particles and the threshold design, n particles at most between edges.

    Every estimate is unbiased, and exact where no round has more than n states.
    """
    if not 0 < p < 1 or n < 1:
        raise ValueError("0 < p < 1 and n >= 1 are needed")
    tasks = max(spark.sparkContext.defaultParallelism, -(-replicates * 2 * n // TASK_ROWS))
    each = spark.range(0, replicates, 1, tasks).select(F.col("id").alias("replicate"))
    states = spark.range(1).select(F.col("id").alias("state"), F.array(*map(F.lit, range(g.vertices))).alias("labels"))
    rows, key = states.select("state", F.lit(1.0).alias("weight")), []
    for k in range(len(g.edges)):
        moves, states = _moves(states, g, k, p)
        rows = rows.join(moves, "state").groupBy(*key, F.col("next").alias("state"), "chance").agg(F.sum(F.col("weight") * F.col("factor")).alias("weight"))
        if states.count() > n:
            if not key:
                rows, key = each.crossJoin(F.broadcast(cut(rows))), ["replicate"]  # at most 2 n rows
            sized = rows.withColumn("size", F.col("weight") * F.col("chance"))
            rows = threshold_by_group(sized, "replicate", ["state"], "size", n, uniform(seed, F.col("replicate"), k)).withColumn("weight", F.col("weight") / F.col("pi"))
        rows = rows.select(*key, "state", "weight")
        if k % ROUNDS == ROUNDS - 1 and k + 1 < len(g.edges):
            rows = cut(rows)
            if key:
                states = kept(states.join(rows.select("state").distinct(), "state", "left_semi"))
                rows = rows.repartition(tasks, "replicate")  # a checkpoint forgets how its rows are dealt
    if not key:
        return each.crossJoin(F.broadcast(rows.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("estimate"))))  # one row
    sums = rows.groupBy("replicate").agg(F.sum("weight").alias("estimate"))
    return each.join(sums, "replicate", "left").select("replicate", F.coalesce("estimate", F.lit(0.0)).alias("estimate"))
