"""Components, reduced graphs, distances and series-parallel reduction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.states import FIXED_UP, has
from tidegraph.plans.lineage import cut, kept
from tidegraph.sources.graphs import Graph


def component_labels(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, component): smallest vertex that edges (src, dst) reach, for every vertex; by smallest-label propagation with shortcuts."""
    both = edges.select(F.col("src").alias("v"), F.col("dst").alias("u")).unionByName(edges.select(F.col("dst").alias("v"), F.col("src").alias("u"))).distinct()
    state = kept(vertices.select("v", F.col("v").alias("component")))
    while True:
        near = both.join(state.select(F.col("v").alias("u"), F.col("component").alias("c")), "u").groupBy("v").agg(F.min("c").alias("c"))
        low = state.join(near, "v", "left").select("v", F.least("component", "c").alias("component"))
        jump = low.select(F.col("v").alias("component"), F.col("component").alias("root"))
        after = kept(low.join(jump, "component").select("v", F.least("component", "root").alias("component")))
        if after.join(state.withColumnRenamed("component", "was"), "v").where("component <> was").isEmpty():
            return after
        state = after


def fixed_up_labels(vertices: DataFrame, edges: DataFrame, states: int = FIXED_UP) -> DataFrame:
    """(v, component) over the edges (src, dst, state) whose state is one of ``states``."""
    return component_labels(vertices, edges.where(has(F.col("state"), states)))


def terminal_components(labels: DataFrame, terminals: list[int]) -> DataFrame:
    """(n): how many components hold terminals."""
    return labels.where(F.col("v").isin([int(t) for t in terminals])).agg(F.count_distinct("component").alias("n"))


def nearest_vertex(points: DataFrame, g: Graph) -> DataFrame:
    """``points`` (x, y) with v, the graph's vertex nearest to each, ties to the smaller; the graph is part of the expression."""
    if g.positions is None:
        raise ValueError("the graph has no positions")
    far = F.array(*(F.struct((F.pow(F.col("x") - x, 2) + F.pow(F.col("y") - y, 2)).alias("d"), F.lit(v).alias("v")) for v, (x, y) in enumerate(g.positions)))
    return points.withColumn("v", F.array_min(far)["v"])


def reduced_graph(labels: DataFrame, edges: DataFrame, p: float | None = None, loops: bool = True) -> DataFrame:
    """(c1, c2, n_parallel): edges between components, with inop and op probabilities if ``p`` is given."""
    a = labels.select(F.col("v").alias("src"), F.col("component").alias("ca"))
    b = labels.select(F.col("v").alias("dst"), F.col("component").alias("cb"))
    out = edges.join(a, "src").join(b, "dst").groupBy(F.least("ca", "cb").alias("c1"), F.greatest("ca", "cb").alias("c2")).agg(F.count("*").alias("n_parallel"))
    if not loops:
        out = out.where("c1 <> c2")
    if p is not None:
        inop = F.pow(F.lit(1 - p), F.col("n_parallel"))
        out = out.select("*", inop.alias("inop"), (1 - inop).alias("op"))
    return out


def vertex_distances(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(u, v, d): edges on a shortest path, for pairs that are connected; breadth first from every vertex at once."""
    both = cut(edges.select(F.col("src").alias("v"), F.col("dst").alias("w")).unionByName(edges.select(F.col("dst").alias("v"), F.col("src").alias("w"))).distinct())
    seen = cut(vertices.select(F.col("v").alias("u"), "v", F.lit(0).alias("d")))
    front, d = seen, 0
    while True:
        d += 1
        front = cut(front.join(both, "v").select("u", F.col("w").alias("v")).distinct().join(seen, ["u", "v"], "left_anti").withColumn("d", F.lit(d)))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))


def edge_distances(spark: SparkSession, edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(e1, e2, d) for e1 <= e2: 0 for an edge itself, else one more than the least distance of their ends."""
    dist = vertex_distances(vertices, edges)
    ends = edges.select("edge_id", F.explode(F.array("src", "dst")).alias("v"))
    one, two = ends.select(F.col("edge_id").alias("e1"), F.col("v").alias("u")), ends.select(F.col("edge_id").alias("e2"), "v")
    pairs = dist.join(one, "u").join(two, "v").where("e1 <= e2")
    return pairs.groupBy("e1", "e2").agg(F.when(F.col("e1") == F.col("e2"), F.lit(0)).otherwise(F.min("d") + 1).alias("d"))


def spatial_edge_distances(g: Graph, spark: SparkSession) -> DataFrame:
    """(e1, e2, d) for e1 < e2: distance of the edges' middles."""
    at = g.vertex_table(spark)
    mid = g.edge_table(spark).join(at.toDF("src", "ax", "ay"), "src").join(at.toDF("dst", "bx", "by"), "dst").select("edge_id", ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"))
    a, b = mid.toDF("e1", "x1", "y1"), mid.toDF("e2", "x2", "y2")
    return a.join(b, F.col("e1") < F.col("e2")).select("e1", "e2", F.sqrt(F.pow(F.col("x1") - F.col("x2"), 2) + F.pow(F.col("y1") - F.col("y2"), 2)).alias("d"))


def series_parallel(edges: list[tuple[int, int, float]], terminals: set[int]) -> list[tuple[int, int, float]]:
    """Edges (a, b, probability down) after all series, parallel and dangling reductions of vertices that are no terminals."""
    down: dict[tuple[int, int], float] = {}

    def add(a: int, b: int, q: float) -> None:
        if a != b:
            k = (min(a, b), max(a, b))
            down[k] = down.get(k, 1.0) * q

    for a, b, q in edges:
        add(a, b, q)
    while True:
        at: dict[int, list[tuple[int, int]]] = {}
        for k in down:
            for v in k:
                at.setdefault(v, []).append(k)
        v = next((v for v in sorted(at) if v not in terminals and len(at[v]) <= 2), None)
        if v is None:
            return sorted((a, b, q) for (a, b), q in down.items())
        taken = [(k, down.pop(k)) for k in at[v]]
        if len(taken) == 2:
            (k1, q1), (k2, q2) = taken
            add(next(x for x in k1 if x != v), next(x for x in k2 if x != v), 1 - (1 - q1) * (1 - q2))
