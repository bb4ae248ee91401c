"""Exact reliability: enumeration of all worlds, polynomials and a merged-state recursion."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.functions.formula import Formula
from tidegraph.functions.states import is_up, up_count
from tidegraph.plans.lineage import cut
from tidegraph.sources.graphs import Graph, probability

#: Edges up to which all worlds are enumerated by default.
MOST_EDGES = 36
#: Worlds of one row of work.
CHUNK_BITS = 16


def connected(world: Column, g: Graph) -> Column:
    """Whether all terminals are in one component of a world, as an expression; for at most 63 vertices."""
    if g.vertices > 63:
        raise ValueError("the expression holds at most 63 vertices")
    masks = F.array(*(F.struct(F.lit(e).alias("e"), F.lit((1 << a) | (1 << b)).cast("long").alias("m")) for e, (a, b) in enumerate(g.edges)))
    want = sum(1 << t for t in set(g.terminals))
    live = F.transform(F.filter(masks, lambda x: is_up(world, x["e"]) == 1), lambda x: x["m"])

    def spread(reach: Column) -> Column:
        return F.aggregate(live, reach, lambda r, m: F.when(r.bitwiseAND(m) != 0, r.bitwiseOR(m)).otherwise(r))

    rounds = F.sequence(F.lit(1), F.lit(max(1, g.vertices - 1)))
    reach = F.aggregate(rounds, F.lit(1 << g.terminals[0]).cast("long"), lambda r, _: spread(r))
    return reach.bitwiseAND(F.lit(want)) == want


def _connected_array(worlds: np.ndarray, g: Graph) -> np.ndarray:
    """The same for an array of worlds; masks of vertices grow along edges that are up until none changes."""
    masks = [np.uint64((1 << a) | (1 << b)) for a, b in g.edges]
    want = np.uint64(sum(1 << t for t in set(g.terminals)))
    reach = np.full(len(worlds), np.uint64(1 << g.terminals[0]))
    up = [((worlds >> np.uint64(e)) & np.uint64(1)).astype(bool) for e in range(len(masks))]
    while True:
        before = reach.copy()
        for m, u in zip(masks, up):
            reach = np.where(u & ((reach & m) != 0), reach | m, reach)
        if (reach == before).all():
            return (reach & want) == want


def with_connected(worlds: DataFrame, g: Graph, world: str = "world", name: str = "connected") -> DataFrame:
    """Add whether the terminals are connected, a batch of worlds at a time; each world is computed once."""
    at = worlds.columns.index(world)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = _connected_array(b.column(at).to_numpy().astype(np.uint64), g)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit)], names=[*b.schema.names, name])

    return worlds.mapInArrow(run, worlds.select("*", F.lit(True).alias(name)).schema)


def check_enumerable(g: Graph, limit: int = MOST_EDGES) -> None:
    if len(g.edges) > limit:
        raise ValueError(f"{len(g.edges)} edges are too many to enumerate; the limit is {limit}")
    if g.vertices > 63:
        raise ValueError("enumeration holds at most 63 vertices")
    if not g.terminals:
        raise ValueError("the graph has no terminals")


def enumerate_counts(spark: SparkSession, g: Graph, disconnected: bool = False, limit: int = MOST_EDGES) -> DataFrame:
    """(n_edges, n): worlds with the terminals connected, or not, by edges up; every n_edges from 0 to m."""
    check_enumerable(g, limit)
    m = len(g.edges)
    bits = min(CHUNK_BITS, m)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(m + 1, np.int64)
        low = np.arange(1 << bits, dtype=np.uint64)
        for f in frames:
            for chunk in f["id"].to_numpy().astype(np.uint64):
                worlds = low | (chunk << np.uint64(bits))
                hit = _connected_array(worlds, g) != disconnected
                total += np.bincount(np.bitwise_count(worlds[hit]), minlength=m + 1)
        yield pd.DataFrame({"n_edges": np.arange(m + 1, dtype=np.int32), "n": total})

    chunks = 1 << (m - bits)
    parts = spark.range(0, chunks, 1, min(chunks, 4 * spark.sparkContext.defaultParallelism))
    return parts.mapInPandas(run, "n_edges int, n long").groupBy("n_edges").agg(F.sum("n").alias("n"))


def counts_by_expression(worlds: DataFrame, g: Graph, world: str = "world") -> DataFrame:
    """(n_edges, n) over given worlds with the terminals connected, in expressions only."""
    return worlds.where(connected(F.col(world), g)).groupBy(up_count(F.col(world)).alias("n_edges")).agg(F.count("*").alias("n"))


def polynomial(counts: DataFrame, m: int, p: float, disconnected: bool = False) -> DataFrame:
    """unreliability of counts by edges up; from counts of connected worlds the others are formed first, as integers."""
    p = probability(p)
    if disconnected:
        down = F.col("n").cast("double")
    else:
        row = F.array(*(F.lit(math.comb(m, k)).cast("decimal(38,0)") for k in range(m + 1)))
        every = counts.sparkSession.range(m + 1).select(F.col("id").cast("int").alias("n_edges"))
        counts = every.join(counts, "n_edges", "left")
        down = (F.element_at(row, F.col("n_edges") + 1) - F.coalesce("n", F.lit(0)).cast("decimal(38,0)")).cast("double")
    term = down * F.pow(F.lit(p), F.col("n_edges")) * F.pow(F.lit(1 - p), F.lit(m) - F.col("n_edges"))
    return counts.agg(F.sum(term).alias("unreliability"))


def binomials(m: int) -> list[int]:
    """Worlds of m edges by edges up."""
    return [math.comb(m, k) for k in range(m + 1)]


def function_counts(worlds: DataFrame, g: Graph, formulas: list[Formula], world: str = "world", limit: int = MOST_EDGES) -> DataFrame:
    """(fn, n_edges, value, n): values of each formula over the worlds whose terminals are not connected."""
    check_enumerable(g, limit)
    w = F.col(world)
    values = F.array(*(F.struct(F.lit(k).alias("fn"), f.column(lambda e: is_up(w, e)).alias("value")) for k, f in enumerate(formulas)))
    rows = with_connected(worlds.select(world), g, world).where("not connected").select(up_count(w).alias("n_edges"), F.explode(values).alias("x"))
    return rows.groupBy("x.fn", "n_edges", "x.value").agg(F.count("*").alias("n"))


def function_range(spark: SparkSession, formulas: list[Formula]) -> DataFrame:
    """(fn, low, high): least and greatest value of each formula over the states of the edges that it names."""
    out = None
    for k, f in enumerate(formulas):
        named = f.edges
        if len(named) > MOST_EDGES:
            raise ValueError(f"{len(named)} edges are too many to enumerate")
        value = f.column(lambda e: is_up(F.col("world"), named.index(e)))
        row = all_worlds(spark, len(named)).agg(F.min(value).alias("low"), F.max(value).alias("high")).select(F.lit(k).alias("fn"), F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))
        out = row if out is None else out.unionByName(row)
    return out


def function_expectation(counts: DataFrame, m: int, p: float) -> DataFrame:
    """(fn, expectation): mean of each formula given that the terminals are not connected."""
    share = F.col("n") * F.pow(F.lit(probability(p)), F.col("n_edges")) * F.pow(F.lit(1 - p), F.lit(m) - F.col("n_edges"))
    return counts.groupBy("fn").agg((F.sum(share * F.col("value")) / F.sum(share)).alias("expectation"))


def all_worlds(spark: SparkSession, m: int) -> DataFrame:
    """(world) for all masks of m edges; meant for small m."""
    return spark.range(1 << m).select(F.col("id").alias("world"))


def report(counts: DataFrame, g: Graph, formulas: list[str]) -> DataFrame:
    """(line, value): an enumeration as text, three lines on the graph, one a formula, then one a (function, edges, value)."""
    spark = counts.sparkSession
    head = [f"Graph with {g.vertices} vertices and {len(g.edges)} edges", f"Terminals {' '.join(map(str, g.terminals))}", f"{len(formulas)} functions", *(f"Function {k}: {text}" for k, text in enumerate(formulas))]
    lines = spark.createDataFrame([(k - len(head), x) for k, x in enumerate(head)], "line long, value string")
    place = (F.col("fn").cast("long") * len(g.edges) + F.col("n_edges")) * (1 << 20) + F.dense_rank().over(Window.partitionBy("fn", "n_edges").orderBy("value"))
    return lines.unionByName(counts.select(place.alias("line"), F.format_string("%d edges, value %d:  %d", "n_edges", "value", "n").alias("value")))


def read_report(lines: DataFrame, column: str = "value", head: str = r"^(Graph with |Terminals |\d+ functions$|Function \d+: |\s*$)") -> DataFrame:
    """(n_edges, value, n) of such lines; a line that is neither a count nor of the head is an error."""
    pattern = r"^\s*(\d+) edges, value (-?\d+):\s+(\d+)\s*$"
    part = lambda k: F.regexp_extract(column, pattern, k)
    bad = F.raise_error(F.concat(F.lit("not a line of an enumeration: "), F.col(column)))
    fine = F.when(F.col(column).rlike(pattern), True).when(F.col(column).rlike(head), False).otherwise(bad.cast("boolean"))
    return lines.where(fine).select(part(1).cast("int").alias("n_edges"), part(2).cast("long").alias("value"), part(3).cast("long").alias("n"))


# --- merged states: the uncapped recursion over edges -------------------------


def _canonical(labels: Column, gone: list[int]) -> Column:
    """Each block named by its first vertex that is still kept; dropped vertices get -1."""
    if gone:
        dead = F.array(*map(F.lit, gone))
        labels = F.transform(labels, lambda x, i: F.when(F.array_contains(dead, i), F.lit(-1)).otherwise(x))
    return F.transform(labels, lambda x: F.when(x < 0, F.lit(-1)).otherwise((F.array_position(labels, x) - 1).cast("int")))


def merged_states(spark: SparkSession, g: Graph, p: float | None = None, every: int = 6) -> DataFrame:
    """Exact unreliability (one row), or with ``p=None`` the counts (n_edges, n) of worlds that fail, as decimals from 63 edges on.

    A state is the partition of the vertices by edges that are up so far, of which
    only vertices with edges to come and terminals are kept.  Each edge splits a
    state in two (``explode``) and equal states merge (``groupBy``); states that
    surely fail become one, without labels, and states that surely hold leave.
    """
    edges, terminals = g.edges, sorted(set(g.terminals))
    last = {v: max((k for k, e in enumerate(edges) if v in e), default=-1) for v in range(g.vertices)}
    count = p is None
    kind = "decimal(38,0)" if count else "double"
    lost = F.array().cast("array<int>")
    start = [v for v in range(g.vertices) if last[v] < 0 and v not in terminals]
    states = spark.range(1).select(_canonical(F.array(*map(F.lit, range(g.vertices))), start).alias("labels"), F.lit(1).cast(kind).alias("w"), F.lit(0).alias("k"))
    ts = F.array(*map(F.lit, terminals))
    at = lambda labels, v: F.element_at(labels, v + 1)

    for k, (a, b) in enumerate(edges):
        labels, w, ups = F.col("labels"), F.col("w"), F.col("k")
        down, up = (w, w) if count else (w * (1 - p), w * p)
        la, lb = at(labels, a), at(labels, b)
        joined = F.transform(labels, lambda x: F.when(x == lb, la).otherwise(x))
        row = lambda labels, w, k: F.struct(labels.alias("labels"), w.alias("w"), k.alias("k"))
        over = F.size(labels) == 0
        idle = over | (la == lb)
        # with a probability an edge that changes nothing need not split; counts by edges up always do
        kept = F.array(row(labels, down, ups), row(F.when(idle, labels).otherwise(joined), up, ups + 1))
        if not count:
            kept = F.when(idle, F.array(row(labels, w, ups))).otherwise(F.array(row(labels, down, ups), row(joined, up, ups)))
        gone = [v for v in set(edges[k]) if last[v] == k and v not in terminals]
        live = F.array(*(F.lit(v) for v in range(g.vertices) if last[v] > k)).cast("array<int>")
        split = states.select(F.explode(kept).alias("x")).select(_canonical(F.col("x.labels"), gone).alias("labels"), "x.w", "x.k")
        together = F.forall(ts, lambda t: at(labels, t) == at(labels, F.lit(terminals[0])))
        closed = F.exists(ts, lambda t: ~F.exists(live, lambda v: at(labels, v) == at(labels, t)))
        split = split.where((F.size("labels") == 0) | ~together).withColumn("labels", F.when((F.size("labels") > 0) & closed, lost).otherwise(labels))
        states = split.groupBy("labels", "k").agg(F.sum("w").cast(kind).alias("w"))
        if (k + 1) % every == 0:
            states = cut(states)
    failed = states.where(F.size("labels") == 0)
    if count:
        return failed.select(F.col("k").alias("n_edges"), (F.col("w").cast("long") if len(edges) < 63 else F.col("w")).alias("n"))
    return failed.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("unreliability"))
