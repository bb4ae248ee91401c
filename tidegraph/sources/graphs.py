"""Graphs: construction, files, checks and algebra.

A graph is a small immutable object (the edge list of a network, terminals and
optional positions) next to the DataFrames made from it; the large data are worlds,
samples and particles, which are DataFrames throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """An undirected multigraph with terminals; vertices and edges count from 0."""

    vertices: int
    edges: tuple[tuple[int, int], ...]
    terminals: tuple[int, ...] = ()
    positions: tuple[tuple[float, float], ...] | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        for a, b in self.edges:
            if not (0 <= a < self.vertices and 0 <= b < self.vertices):
                raise ValueError(f"edge ({a}, {b}) names a vertex outside 0..{self.vertices - 1}")
        if self.terminals:
            if len(set(self.terminals)) < 2:
                raise ValueError("at least two terminals are needed")
            if not all(0 <= t < self.vertices for t in self.terminals):
                raise ValueError("a terminal is out of range")

    def with_terminals(self, terminals: Iterable[int]) -> Graph:
        return replace(self, terminals=tuple(terminals))

    def edge_table(self, spark: SparkSession) -> DataFrame:
        """(edge_id, src, dst)."""
        return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(self.edges)], "edge_id int, src int, dst int")

    def vertex_table(self, spark: SparkSession) -> DataFrame:
        """(v, x, y)."""
        at = self.positions or ((None, None),) * self.vertices
        return spark.createDataFrame([(v, *at[v]) for v in range(self.vertices)], "v int, x double, y double")

    def arcs(self, spark: SparkSession) -> DataFrame:
        """Both directions of every edge: (arc_id, edge_id, src, dst), arcs 2e and 2e+1 being each other's reverse."""
        both = F.array(F.struct((2 * F.col("edge_id")).alias("arc_id"), F.col("src").alias("a"), F.col("dst").alias("b")), F.struct((2 * F.col("edge_id") + 1).alias("arc_id"), F.col("dst").alias("a"), F.col("src").alias("b")))
        return self.edge_table(spark).select("edge_id", F.explode(both).alias("x")).select("x.arc_id", "edge_id", F.col("x.a").alias("src"), F.col("x.b").alias("dst"))


def probability(p: float | str) -> float:
    """A probability as a float, checked."""
    value = float(p)
    if not 0 <= value <= 1 or math.isnan(value):
        raise ValueError("a probability lies between 0 and 1")
    return value


def sample_size(n: int) -> int:
    if n < 1:
        raise ValueError("the sample size must be positive")
    return n


def grid(side: int, terminals: Sequence[int] = ()) -> Graph:
    """A square lattice; vertex i + j * side, and for each i, j the edge to the next i before that to the next j."""
    edges = []
    for i in range(side):
        for j in range(side):
            if i + 1 < side:
                edges.append((i + j * side, i + 1 + j * side))
            if j + 1 < side:
                edges.append((i + j * side, i + (j + 1) * side))
    return Graph(side * side, tuple(edges), tuple(terminals), tuple((100.0 * (v % side), 100.0 * (v // side)) for v in range(side * side)))


def complete(vertices: int, terminals: int = 2) -> Graph:
    """All pairs in order of their ends, on a circle; the terminals are the first ones, 0 the last named."""
    edges = tuple((i, j) for i in range(vertices) for j in range(i + 1, vertices))
    turn = [2 * math.pi * v / vertices for v in range(vertices)]
    return Graph(vertices, edges, (*range(1, terminals), 0), tuple((math.cos(t), math.sin(t)) for t in turn))


def torus(side: int) -> Graph:
    raise NotImplementedError("torus graphs are not supported")


def from_edges(edges: Iterable[tuple[int, int]], terminals: Sequence[int] = (), vertices: int | None = None, directed: bool = False) -> Graph:
    """A graph from an edge list."""
    if directed:
        raise ValueError("the graph must be undirected")
    edges = tuple((int(a), int(b)) for a, b in edges)
    return Graph(vertices if vertices is not None else 1 + max((max(e) for e in edges), default=-1), edges, tuple(terminals))


def from_adjacency(matrix: Sequence[Sequence[float]], terminals: Sequence[int] = (), dedupe: bool = True) -> Graph:
    """A graph from a square matrix; with ``dedupe=False`` each entry is an edge, so a symmetric matrix gives each twice."""
    n = len(matrix)
    if any(len(row) != n for row in matrix):
        raise ValueError("an adjacency matrix is square")
    edges = [(i, j) for i in range(n) for j in range(n) if matrix[i][j] > 0]
    if dedupe:
        edges = sorted({(min(e), max(e)) for e in edges})
    return Graph(n, tuple(edges), tuple(terminals))


def from_neighbours(names: Sequence[str], neighbours: Sequence[Sequence[int]], terminals: Sequence[int] = (), dedupe: bool = True) -> Graph:
    """A graph from node names and lists of neighbours counted from 1."""
    if len(set(names)) != len(names):
        raise ValueError("node names must be unique")
    edges = [(i, j - 1) for i, own in enumerate(neighbours) for j in own]
    if dedupe:
        edges = sorted({(min(e), max(e)) for e in edges})
    return Graph(len(names), tuple(edges), tuple(terminals))


def convert(graph: object, terminals: Sequence[int] = (), dedupe: bool = True, form: str | None = None) -> Graph:
    """A graph from any of the accepted forms.

    ``form`` says what rows are: ``edges`` or ``matrix``.  Without it rows of two
    are edges, except that two rows that could be either are refused.
    """
    if form not in (None, "edges", "matrix"):
        raise ValueError("rows are edges or a matrix")
    if isinstance(graph, Graph):
        return graph.with_terminals(terminals) if terminals else graph
    if isinstance(graph, dict):
        return from_neighbours(list(graph), list(graph.values()), terminals, dedupe)
    rows = [tuple(r) for r in graph]
    if form is None and len(rows) == 2 and rows in ([(0, 1), (1, 0)], [(0, 0), (0, 0)]):
        raise ValueError("two rows of two may be edges or a matrix; form says which")
    if form == "matrix" or (form is None and rows and len(rows) == len(rows[0]) and len(rows) != 2):
        return from_adjacency(rows, terminals, dedupe)
    return from_edges(rows, terminals)


def union(*graphs: Graph) -> Graph:
    """Disjoint union; later graphs' vertices are shifted."""
    edges, shift, at = [], 0, []
    for g in graphs:
        edges += [(a + shift, b + shift) for a, b in g.edges]
        at += g.positions or []
        shift += g.vertices
    return Graph(shift, tuple(edges), (), tuple(at) if len(at) == shift else None)


def add_vertices(g: Graph, n: int) -> Graph:
    return replace(g, vertices=g.vertices + n, positions=None)


def add_edges(g: Graph, edges: Iterable[tuple[int, int]]) -> Graph:
    return replace(g, edges=(*g.edges, *edges))


#: The ends of the dodecahedron's edges in file order.
DODECAHEDRON = (
    (0, 2), (1, 0), (1, 4), (1, 5), (3, 0), (3, 8), (4, 9), (4, 10), (6, 2), (6, 5),
    (7, 2), (7, 8), (7, 13), (8, 14), (9, 3), (10, 16), (11, 5), (11, 10), (11, 17), (12, 6),
    (12, 17), (13, 12), (13, 18), (14, 15), (15, 9), (16, 15), (16, 19), (18, 14), (18, 19), (19, 17),
)


def dodecahedron(terminals: Sequence[int] = (0, 19)) -> Graph:
    return from_edges(DODECAHEDRON, terminals, 20)


def dodecahedra_in_series() -> Graph:
    three = union(*[dodecahedron()] * 3)
    return add_edges(three, [(19, 20), (19, 20), (39, 40), (39, 40)]).with_terminals((0, 59))


def dodecahedra_in_parallel() -> Graph:
    three = add_vertices(union(*[dodecahedron()] * 3), 2)
    ends = [(60, v) for v in (0, 20, 40) for _ in range(2)] + [(61, v) for v in (19, 39, 59) for _ in range(2)]
    return add_edges(three, ends).with_terminals((60, 61))


def grid_with_hubs(side: int) -> Graph:
    """A lattice with one more vertex joined to its first row and one to its last."""
    n = side * side
    base = add_vertices(grid(side), 2)
    ends = [(n, v) for v in range(side)] + [(n + 1, v) for v in range(n - side, n)]
    return add_edges(base, ends).with_terminals((n, n + 1))


def read_graphml(spark: SparkSession, path: str, terminals: Sequence[int] = ()) -> Graph:
    """A graph file: node positions x and y, and an edge order that is all zero or distinct and in range."""
    data = "array<struct<_VALUE:string,_key:string>>"
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, data {data}").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, data {data}").load(path)
    keys = {r._id: r["_attr.name"] for r in spark.read.format("xml").option("rowTag", "key").schema("_id string, `_attr.name` string").load(path).collect()}
    names, at = {}, []
    for k, r in enumerate(nodes.collect()):
        names[r._id] = k
        got = {keys.get(d._key, d._key): d._VALUE for d in r.data or ()}
        at.append((float(got.get("x", 0)), float(got.get("y", 0))))
    rows = []
    for k, r in enumerate(edges.collect()):
        got = {keys.get(d._key, d._key): d._VALUE for d in r.data or ()}
        rows.append((int(got.get("order", 0)), k, (names[r._source], names[r._target])))
    if any(o for o, _, _ in rows):
        if any(not 0 <= o < len(rows) for o, _, _ in rows):
            raise ValueError("an edge's order is out of range")
        if len({o for o, _, _ in rows}) != len(rows):
            raise ValueError("an edge's order repeats")
    return Graph(len(names), tuple(e for _, _, e in sorted(rows)), tuple(terminals), tuple(at))


def grid_graphml(spark: SparkSession, side: int, gap: int = 0, first: int = 0) -> DataFrame:
    """Lines (line, value) of a lattice's graph file, edge orders starting at ``first`` with a gap after each column."""
    g = grid(side)
    nodes = g.vertex_table(spark).select((1000 + F.col("v")).cast("long").alias("line"), F.format_string('<node id="n%d"><data key="x">%s</data><data key="y">%s</data></node>', "v", "x", "y").alias("value"))
    column = F.pmod(F.col("src"), F.lit(side))
    edges = g.edge_table(spark).select((1_000_000 + F.col("edge_id")).cast("long").alias("line"), F.format_string('<edge id="e%d" source="n%d" target="n%d"><data key="order">%d</data></edge>', "edge_id", "src", "dst", (F.lit(first) + F.col("edge_id") + F.lit(gap) * column).cast("int")).alias("value"))
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml><key id="x" for="node" attr.name="x" attr.type="float"/><key id="y" for="node" attr.name="y" attr.type="float"/><key id="order" for="edge" attr.name="order" attr.type="int"/>', '<graph edgedefault="undirected">']
    ends = spark.createDataFrame([(k, x) for k, x in enumerate(head)] + [(10_000_000, "</graph></graphml>")], "line long, value string")
    return ends.unionByName(nodes).unionByName(edges).orderBy("line")
