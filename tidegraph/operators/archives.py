"""Saved graphs, observations, collections, level trees and samples as Parquet, with checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.states import DOWN, FIXED_DOWN, FIXED_UP, FREE_UP
from tidegraph.operators.scan import around
from tidegraph.plans.lineage import cut
from tidegraph.sources.graphs import Graph, probability

#: The kinds, each with the columns that its rows have.
KINDS = {
    "context": {"part", "k", "a", "b", "x", "y"},
    "observation": {"obs_id", "state"},
    "collection": {"obs_id", "state", "radius"},
    "tree": {"level", "idx", "parent_idx", "state"},
    "empirical": {"obs_id", "world", "weight"},
}


def save(df: DataFrame, path: str, kind: str) -> None:
    """Rows of a kind, checked for its columns."""
    missing = KINDS[kind] - set(df.columns)
    if missing:
        raise ValueError(f"{kind} rows need {', '.join(sorted(missing))}")
    df.select(*sorted(KINDS[kind]), F.lit(kind).alias("kind")).write.mode("overwrite").parquet(path)


def kind_of(spark: SparkSession, path: str) -> str:
    """The kind of a saved table."""
    rows = spark.read.parquet(path)
    found = [r.kind for r in rows.select("kind").distinct().limit(2).collect()] if "kind" in rows.columns else []
    if len(found) != 1 or found[0] not in KINDS:
        raise ValueError(f"{path} holds {found or 'no known kind'}")
    return found[0]


def load(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """The rows of a saved table, whatever its kind or of the kind that is expected; checked."""
    found = kind_of(spark, path)
    if kind and kind != found:
        raise ValueError(f"expected {kind}, found {found}")
    rows = spark.read.parquet(path).drop("kind")
    if found == "tree":
        check_tree(rows)
    elif found in ("observation", "collection"):
        check_states(rows)
    return rows


def save_context(spark: SparkSession, g: Graph, p: float, path: str) -> None:
    """A graph with its terminals, positions and edge probability."""
    rows = [("vertex", v, None, None, *(g.positions[v] if g.positions else (None, None))) for v in range(g.vertices)]
    rows += [("edge", k, a, b, None, None) for k, (a, b) in enumerate(g.edges)]
    rows += [("terminal", k, t, None, None, None) for k, t in enumerate(g.terminals)]
    rows += [("arcs", 2 * len(g.edges), None, None, probability(p), None)]
    save(spark.createDataFrame(rows, "part string, k int, a int, b int, x double, y double"), path, "context")


def load_context(spark: SparkSession, path: str) -> tuple[Graph, float]:
    """The graph and the probability; the number of arcs must be twice that of the edges."""
    parts: dict[str, list] = {"vertex": [], "edge": [], "terminal": [], "arcs": []}
    for r in load(spark, path, "context").orderBy("part", "k").collect():  # one graph
        parts[r.part].append(r)
    (arcs,) = parts["arcs"]
    if arcs.k != 2 * len(parts["edge"]):
        raise ValueError("the number of arcs is not twice that of the edges")
    at = [(r.x, r.y) for r in parts["vertex"]]
    positions = tuple(at) if at and all(x is not None for x, _ in at) else None
    return Graph(len(at), tuple((r.a, r.b) for r in parts["edge"]), tuple(r.a for r in parts["terminal"]), positions), arcs.x


def check_states(rows: DataFrame) -> DataFrame:
    """Every observation has a state of one known code for each of the same number of edges."""
    known = F.forall("state", lambda s: s.isin(1, 2, 4, 8))
    bad = rows.agg(F.min(F.size("state")).alias("low"), F.max(F.size("state")).alias("high"), F.coalesce(F.bool_and(known), F.lit(True)).alias("known")).first()
    if bad.low != bad.high or not bad.known:
        raise ValueError("states differ in length or have an unknown code")
    return rows


def check_tree(tree: DataFrame) -> DataFrame:
    """Roots are at level 0 alone, and each other node has its parent one level up."""
    root = F.col("parent_idx") == -1
    if not tree.where(root != (F.col("level") == 0)).isEmpty():
        raise ValueError("a node without a parent is not at level 0, or one at level 0 has a parent")
    up = tree.select((F.col("level") + 1).alias("level"), F.col("idx").alias("parent_idx")).distinct()
    if not tree.where("level > 0").join(up, ["level", "parent_idx"], "left_anti").isEmpty():
        raise ValueError("a node's parent is not one level up")
    return tree


def level_offsets(tree: DataFrame) -> DataFrame:
    """(level, size, first): nodes of each level and how many come before it."""
    sizes = cut(tree.groupBy("level").agg(F.count("*").alias("size")))
    before = around(sizes.select(F.col("level").cast("long").alias("part"), F.array("size").alias("value")), lambda a, b: a + b, [0])
    return sizes.join(before, F.col("level") == F.col("part")).select("level", "size", F.col("before")[0].alias("first"))


def leftmost_child(tree: DataFrame, left: Column) -> DataFrame:
    """(level, idx, child): of the nodes with children, the child with the least place, ties to the smaller index."""
    return tree.where("level > 0").groupBy((F.col("level") - 1).alias("level"), F.col("parent_idx").alias("idx")).agg(F.min_by("idx", F.struct(left, "idx")).alias("child"))


def row(rows: DataFrame, number: int, key: str = "obs_id") -> DataFrame:
    """The observation of a number."""
    return rows.where(F.col(key) == number)


def expand(collection: DataFrame, states: str = "state") -> DataFrame:
    """A collection's fixed states as worlds: edges fixed down are down, others up."""
    return collection.withColumn(states, F.transform(states, lambda s: F.when(s.bitwiseAND(F.lit(DOWN)) != 0, F.lit(FIXED_DOWN)).when(s == FREE_UP, F.lit(FIXED_UP)).otherwise(s).cast("tinyint")))
