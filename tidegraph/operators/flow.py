"""Flows and minimum cuts of graphs of any size: searches for augmenting paths, a pair of vertices a row."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.states import FIXED_DOWN
from tidegraph.sources.graphs import Graph


def arc_flows(edges: Sequence[tuple[int, int]], s: int, t: int, room: Sequence[int] | None = None) -> list[int]:
    """Flow of a maximum flow along each edge, from its first end to its second; negative the other way."""
    room = [1] * len(edges) if room is None else list(room)
    flow = [0] * len(edges)
    at: dict[int, list[tuple[int, int, int]]] = {}
    for e, (a, b) in enumerate(edges):
        if a != b:
            at.setdefault(a, []).append((e, b, 1))
            at.setdefault(b, []).append((e, a, -1))
    while True:
        came: dict[int, tuple[int, int, int]] = {s: (-1, s, 0)}
        queue = deque([s])
        while queue and t not in came:
            v = queue.popleft()
            for e, u, way in at.get(v, ()):
                if u not in came and way * flow[e] < room[e]:
                    came[u] = (e, v, way)
                    queue.append(u)
        if t not in came or s == t:
            return flow
        path, v = [], t
        while v != s:
            e, v, way = came[v]
            path.append((e, way))
        least = min(room[e] - way * flow[e] for e, way in path)
        for e, way in path:
            flow[e] += way * least


def value(edges: Sequence[tuple[int, int]], flow: Iterable[int], s: int) -> int:
    """What leaves a vertex."""
    return sum(f * ((a == s) - (b == s)) for (a, b), f in zip(edges, flow))


def cut_sizes(spark: SparkSession, g: Graph, pairs: Sequence[tuple[int, int]], room: Sequence[int] | None = None) -> DataFrame:
    """(s, t, mincut) of each pair of vertices; pairs are spread over the tasks."""
    edges = g.edges

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(mincut=[value(edges, arc_flows(edges, s, t, room), s) for s, t in zip(f["s"].tolist(), f["t"].tolist())])

    rows = spark.createDataFrame([(int(s), int(t)) for s, t in pairs], "s int, t int")
    return rows.repartition(min(len(pairs) or 1, 4 * spark.sparkContext.defaultParallelism)).mapInPandas(run, "s int, t int, mincut long")


def mincut(spark: SparkSession, g: Graph, room: Sequence[int] | None = None) -> DataFrame:
    """(mincut): fewest edges whose loss splits the terminals, or the graph if it has none."""
    first, *rest = sorted(set(g.terminals)) or range(g.vertices)
    return cut_sizes(spark, g, [(first, t) for t in rest], room).agg(F.min("mincut").alias("mincut"))


def flow_arcs(spark: SparkSession, g: Graph, s: int, t: int, states: Sequence[int] | None = None) -> DataFrame:
    """(arc_id, edge_id, src, dst, state, flow): a maximum flow on both arcs of each edge; edges that are fixed down carry none."""
    room = [0 if states and states[e] == FIXED_DOWN else 1 for e in range(len(g.edges))]
    flows = arc_flows(g.edges, s, t, room)
    known = spark.createDataFrame([(e, f, int(states[e]) if states else 4) for e, f in enumerate(flows)], "edge_id int, f int, state int")
    way = F.when(F.col("arc_id") % 2 == 0, F.col("f")).otherwise(-F.col("f"))
    return g.arcs(spark).join(F.broadcast(known), "edge_id").select("arc_id", "edge_id", "src", "dst", "state", F.greatest(way, F.lit(0)).alias("flow"))


def with_flow(arcs: DataFrame) -> DataFrame:
    """The arcs that carry flow, without edges that are fixed down."""
    return arcs.where((F.col("flow") > 0) & (F.col("state") != FIXED_DOWN))


def against_flow(arcs: DataFrame) -> DataFrame:
    """The arcs whose reverse carries flow, without edges that are fixed down."""
    back = with_flow(arcs).select("edge_id", F.col("src").alias("dst"), F.col("dst").alias("src"))
    return arcs.where(F.col("state") != FIXED_DOWN).join(back, ["edge_id", "src", "dst"], "left_semi")
