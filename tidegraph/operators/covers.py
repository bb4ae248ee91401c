"""Greedy covers of the edges that are down, for observations stored as rows: no limit on the graph's edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.states import FIXED, FIXED_DOWN, FREE_DOWN
from tidegraph.operators.empirical import _cover
from tidegraph.plans.lineage import cut

#: Edges and near pairs of a graph whose observations are covered as arrays of all its edges, and cells of such an array.
DENSE, PAIRS, CELLS = 4096, 1 << 16, 1 << 22


def ball_cover(down: DataFrame, near: DataFrame) -> DataFrame:
    """(obs_id, edge_id, state) of the rows (obs_id, edge_id, state) of edges that are down, covered by balls.

    ``near`` has (e1, e2), e1 < e2, for edges within the radius.  Edges are visited in
    order: one that no earlier centre covers becomes a centre and is fixed down, the
    others keep a fixed state or become free.  A round decides, in all observations
    at once, every edge whose earlier neighbours are decided: without an undecided one
    it is a centre, next to a centre it is covered.  Rows must be distinct.
    """
    near = near.select("e1", "e2")
    pairs = [(x.e1, x.e2) for x in near.limit(PAIRS + 1).collect()]
    if len(pairs) <= PAIRS and len({e for p in pairs for e in p}) <= DENSE:
        return _dense(down, pairs)
    return _rounds(down, near)


def _dense(down: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """``ball_cover`` of graphs with few edges: an observation's rows meet in a task, which covers many observations at once."""
    ids = np.array(sorted({e for p in pairs for e in p}), np.int64)
    place = {e: k for k, e in enumerate(ids.tolist())}
    near: list[list[int]] = [[] for _ in place]
    for a, b in sorted(set(pairs)):
        near[place[a]].append(place[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // max(1, len(ids)))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                b = batch.slice(i, step)
                flat = b.column(1).flatten()
                edge, state = (flat.field(c).to_numpy(zero_copy_only=False) for c in range(2))
                row = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy())
                new = np.full(len(row), FIXED_DOWN, np.int8)  # an edge that is near no other is a centre
                if len(ids):
                    at = np.minimum(np.searchsorted(ids, edge), len(ids) - 1)
                    some = ids[at] == edge
                    old = np.zeros((b.num_rows, len(ids)), np.int8)
                    old[row[some], at[some]] = state[some]
                    new[some] = _cover(old, near)[row[some], at[some]]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), flat.field(0), pa.array(new)], names=["obs_id", "edge_id", "state"])

    each = down.select("obs_id", F.struct("edge_id", F.col("state").cast("tinyint").alias("state")).alias("x")).groupBy("obs_id").agg(F.collect_list("x").alias("x"))
    obs, edge = (down.schema[c].dataType.simpleString() for c in ("obs_id", "edge_id"))
    return each.mapInArrow(run, f"obs_id {obs}, edge_id {edge}, state tinyint")


def _rounds(down: DataFrame, near: DataFrame) -> DataFrame:
    """``ball_cover`` by rounds over tables; Spark's estimate of checkpointed rows is too low for a broadcast, so their joins are merged."""
    rows = cut(down.select("obs_id", "edge_id", "state"))
    open_ = rows.select("obs_id", "edge_id")
    first, second = open_.withColumnRenamed("edge_id", "e1"), open_.withColumnRenamed("edge_id", "e2")
    pairs = cut(first.join(near, "e1").join(second.hint("merge"), ["obs_id", "e2"]))
    centres = None
    while True:
        new = cut(open_.join(pairs.select("obs_id", F.col("e2").alias("edge_id")).hint("merge"), ["obs_id", "edge_id"], "left_anti"))
        centres = new if centres is None else centres.unionByName(new)
        if pairs.isEmpty():
            break
        covered = pairs.join(new.withColumnRenamed("edge_id", "e1").hint("merge"), ["obs_id", "e1"]).select("obs_id", F.col("e2").alias("edge_id")).distinct()
        decided = cut(new.unionByName(covered))
        open_ = cut(open_.join(decided.hint("merge"), ["obs_id", "edge_id"], "left_anti"))
        for e in ("e1", "e2"):
            pairs = pairs.join(decided.withColumnRenamed("edge_id", e).hint("merge"), ["obs_id", e], "left_anti")
        pairs = cut(pairs)
    hit = centres.withColumn("centre", F.lit(True))
    kept = F.when(F.col("state").bitwiseAND(F.lit(FIXED)) != 0, F.col("state")).otherwise(F.lit(FREE_DOWN))
    return rows.join(hit.hint("merge"), ["obs_id", "edge_id"], "left").select("obs_id", "edge_id", F.when(F.col("centre"), F.lit(FIXED_DOWN)).otherwise(kept).cast("tinyint").alias("state"))
