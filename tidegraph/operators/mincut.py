"""Minimum cuts: by enumeration of vertex sets in Spark, and by augmenting paths for single states."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.sources.graphs import Graph

#: Vertices up to which all vertex sets are enumerated.
MOST_VERTICES = 20


def _crossing(spark: SparkSession, g: Graph) -> DataFrame:
    """(side, cut) for the vertex sets that hold vertex 0: edges that leave them."""
    if g.vertices > MOST_VERTICES:
        raise ValueError(f"enumeration holds at most {MOST_VERTICES} vertices")
    side = (F.col("id") * 2 + 1).alias("side")
    bit = lambda v: F.call_function("shiftright", F.col("side"), F.lit(v)).bitwiseAND(F.lit(1))
    cut = sum((bit(a).bitwiseXOR(bit(b)) for a, b in g.edges), F.lit(0).cast("long"))
    sets = spark.range(1 << (g.vertices - 1)).select(side).where(F.col("side") < (1 << g.vertices) - 1)
    return sets.select("side", cut.alias("cut"))


def global_mincut(spark: SparkSession, g: Graph) -> DataFrame:
    """(mincut): fewest edges whose loss splits the graph."""
    return _crossing(spark, g).agg(F.min("cut").alias("mincut"))


def _splitting(spark: SparkSession, g: Graph) -> DataFrame:
    want = sum(1 << t for t in set(g.terminals))
    inside = F.col("side").bitwiseAND(F.lit(want))
    return _crossing(spark, g).where((inside != 0) & (inside != want))


def terminal_mincut(spark: SparkSession, g: Graph) -> DataFrame:
    """(mincut): fewest edges whose loss splits the terminals."""
    return _splitting(spark, g).agg(F.min("cut").alias("mincut"))


def mincut_edges(spark: SparkSession, g: Graph) -> DataFrame:
    """(edge_id): edges that lie in some minimum cut of the terminals."""
    sets = _splitting(spark, g)
    least = sets.agg(F.min("cut").alias("least"))
    masks = F.array(*(F.struct(F.lit(k).alias("e"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(g.edges)))
    bit = lambda v: F.call_function("shiftright", F.col("side"), v).bitwiseAND(F.lit(1))
    best = sets.join(F.broadcast(least), F.col("cut") == F.col("least"))  # one row
    return best.select("side", F.explode(masks).alias("x")).where(bit(F.col("x.a")) != bit(F.col("x.b"))).select(F.col("x.e").alias("edge_id")).distinct()


def max_flow(ends: Iterable[tuple[int, int]], s: int, t: int) -> int:
    """Edge-disjoint paths between two vertices of an undirected multigraph."""
    room: dict[int, dict[int, int]] = {}
    for a, b in ends:
        if a != b:
            room.setdefault(a, {})[b] = room.setdefault(a, {}).get(b, 0) + 1
            room.setdefault(b, {})[a] = room.setdefault(b, {}).get(a, 0) + 1
    flow = 0
    while True:
        came = {s: s}
        queue = deque([s])
        while queue and t not in came:
            v = queue.popleft()
            for u, c in room.get(v, {}).items():
                if c and u not in came:
                    came[u] = v
                    queue.append(u)
        if t not in came:
            return flow
        v = t
        while v != s:
            u = came[v]
            room[u][v] -= 1
            room[v][u] = room[v].get(u, 0) + 1
            v = u
        flow += 1


def split_size(labels: Sequence[int], edges: Sequence[tuple[int, int]], terminals: Sequence[int]) -> int | None:
    """Fewest of the given edges whose loss splits the terminals when vertices of one label are one; None if they cannot be split."""
    ends = {labels[t] for t in terminals}
    if len(ends) < 2:
        return None
    first, *rest = sorted(ends)
    live = [(labels[a], labels[b]) for a, b in edges if labels[a] != labels[b]]
    return min(max_flow(live, first, t) for t in rest)
