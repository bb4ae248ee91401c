"""Stored samples of worlds: expectations, thinning, collections and level trees."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.formula import Formula
from tidegraph.functions.states import DOWN, FIXED, FIXED_DOWN, FIXED_UP, FREE_DOWN, is_up
from tidegraph.operators.exact import with_connected
from tidegraph.sources.graphs import Graph


def weighted_expectation(sample: DataFrame, formulas: Sequence[Formula], world: str = "world", weight: str | None = None) -> DataFrame:
    """(fn, expectation): weighted means of formulas over a sample; equal weights without a weight column."""
    w = F.col(weight) if weight else F.lit(1.0)
    values = F.array(*(F.struct(F.lit(k).alias("fn"), f.column(lambda e: is_up(F.col(world), e)).alias("v")) for k, f in enumerate(formulas)))
    rows = sample.select(w.alias("w"), F.explode(values).alias("x"))
    return rows.groupBy("x.fn").agg((F.sum(F.col("w") * F.col("x.v")) / F.sum("w")).alias("expectation"))


def failed_expectation(worlds: DataFrame, g: Graph, formulas: Sequence[Formula], world: str = "world") -> DataFrame:
    """(fn, n, total): how many worlds have split terminals, and the sum of each formula over them."""
    values = F.array(*(F.struct(F.lit(k).alias("fn"), f.column(lambda e: is_up(F.col(world), e)).alias("v")) for k, f in enumerate(formulas)))
    rows = with_connected(worlds.select(world), g, world).where("not connected").select(F.explode(values).alias("x"))
    return rows.groupBy("x.fn").agg(F.count("*").alias("n"), F.sum("x.v").alias("total"))


def to_collection(sample: DataFrame, states: str = "state") -> DataFrame:
    """A sample as fixed states: up edges fixed up, others fixed down; weights are dropped."""
    fixed = F.transform(states, lambda s: F.when(s.bitwiseAND(F.lit(DOWN)) != 0, F.lit(FIXED_DOWN)).otherwise(F.lit(FIXED_UP)).cast("tinyint"))
    return sample.select("obs_id", fixed.alias("state"))


def _cover(old: np.ndarray, near: Sequence[Sequence[int]]) -> np.ndarray:
    """States (rows: observations) of the greedy cover; ``near`` has the later edges within the radius of each."""
    new, covered, down = np.full(old.shape, FIXED_UP, np.int8), np.zeros(old.shape, bool), old & DOWN != 0
    for e, others in enumerate(near):
        centre = down[:, e] & ~covered[:, e]
        new[centre, e] = FIXED_DOWN
        for k in others:
            hit = centre & down[:, k] & ~covered[:, k]
            covered[:, k] |= hit
            new[hit, k] = np.where(old[hit, k] & FIXED != 0, old[hit, k], FREE_DOWN)
    return new


def _thinned(sample: DataFrame, distances: Sequence[Sequence[float]], radii: Sequence[float]) -> DataFrame:
    """(level, obs_id, state): the sample covered at each radius, in one pass over it."""
    balls = [[[k for k in range(e + 1, len(row)) if row[k] <= r] for e, row in enumerate(distances)] for r in radii]
    m = len(distances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            old = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, m)
            for level, near in enumerate(balls):
                state = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * m, pa.int32()), pa.array(_cover(old, near).ravel(), pa.int8()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, level), pa.int32()), b.column(0), state], names=["level", "obs_id", "state"])

    return sample.select(F.col("obs_id").cast("long"), F.col("state").cast("array<tinyint>")).mapInArrow(run, "level int, obs_id long, state array<tinyint>")


def thin(sample: DataFrame, distances: Sequence[Sequence[float]], radius: float) -> DataFrame:
    """(obs_id, state): edges that are down, covered greedily by balls.

    Edges are visited in order.  An edge that is down and not covered becomes a
    centre and is fixed down; later edges that are down within the radius keep a
    fixed state or become free; everything else is fixed up.
    """
    return _thinned(sample, distances, [radius]).drop("level")


def level_tree(sample: DataFrame, distances: Sequence[Sequence[float]], radii: Sequence[float]) -> DataFrame:
    """(level, idx, parent_idx, state): each observation thinned at falling radii, its parent one level up; -1 at the root."""
    parent = F.when(F.col("level") == 0, F.lit(-1).cast("long")).otherwise(F.col("obs_id"))
    return _thinned(sample, distances, radii).select("level", F.col("obs_id").alias("idx"), parent.alias("parent_idx"), "state")


def levels(first: float, last: float | None = None, steps: int | None = None) -> list[float]:
    """Radii of the levels: first..0 in whole steps, or evenly from first to last in so many steps, then 0."""
    if steps is None:
        if first != int(first) or first < 0:
            raise ValueError("without a number of steps the first radius is a whole number")
        return [float(r) for r in range(int(first), -1, -1)]
    if steps < 2:
        raise ValueError("at least two steps are needed")
    end = 0.0 if last is None else last
    out = [first + (end - first) * k / (steps - 1) for k in range(steps)]
    return out if last is None else [*out, 0.0]


def save(df: DataFrame, path: str, kind: str) -> None:
    """A sample, collection or tree as Parquet, with its kind in a column."""
    df.withColumn("kind", F.lit(kind)).write.mode("overwrite").parquet(path)


def load(spark, path: str, kind: str) -> DataFrame:
    """Rows of a saved table; its kind must be the expected one."""
    df = spark.read.parquet(path)
    other = df.where(F.col("kind") != kind).select("kind").first()
    if other:
        raise ValueError(f"expected {kind}, found {other.kind}")
    return df.drop("kind")
