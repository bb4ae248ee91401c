"""Permutation Monte Carlo on tables: at which repair the ends of edges meet, and the rates that are left on the way.

Edges of a world are repaired in the order of their times.  Boruvka's components
nest, so the latest repair on the way between two vertices is the latest of the
edges that their components took until both lay in one component.  Every edge, and
every pair of terminals, carries that along while the forests of all worlds grow at
once; rounds grow with the logarithm of a world's vertices.

Worlds of up to ``WORLD`` edges go through these rounds in arrays, many worlds of a
task at once; larger ones as tables.  Wherever edges are asked for, worlds may also
come one a row (world, edges), edges being an array of structs of the other columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidegraph.operators.estimators import hypoexponential_tail
from tidegraph.operators.spanning import _roots
from tidegraph.plans.lineage import cut

_PLACE = "struct<t:double,edge_id:long>"
#: Edges of a world that a task repairs in arrays, and edges that it repairs at once, about.
WORLD, BATCH = 1 << 16, 1 << 18


def _forests(ca: np.ndarray, cb: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """At which of the first m rows, edges in the order of repair, the ends (of n vertices) of each row meet, and whether they do; by Boruvka's rounds."""
    at = np.full(len(ca), -1)
    while True:
        live = np.flatnonzero(ca[:m] != cb[:m])[::-1]
        if not len(live):
            return at, ca == cb
        took = np.full((2, n), m)
        took[0, ca[live]] = live  # the last of these, the earliest edge, stays
        took[1, cb[live]] = live
        took = took.min(0)
        c = np.flatnonzero(took < m)
        up = np.arange(n)
        up[c] = np.where(ca[took[c]] == c, cb[took[c]], ca[took[c]])
        top = c[(up[up[c]] == c) & (c < up[c])]  # two that took the same edge
        up[top] = top
        while not np.array_equal(further := up[up], up):
            up = further
        took[took == m] = -1
        apart = ca != cb
        at = np.where(apart, np.maximum(at, np.maximum(took[ca], took[cb])), at)
        ca, cb = up[ca], up[cb]


def _repaired(size: np.ndarray, edge_id: np.ndarray, src: np.ndarray, dst: np.ndarray, t: np.ndarray, rate: np.ndarray, terminals: list[int]) -> dict[str, pa.Array]:
    """edges, place, critical and path of worlds with so many edges each, loops among them."""
    worlds = len(size)
    w = np.repeat(np.arange(worlds), size)
    order = np.lexsort((edge_id, t, w))
    order = order[(src != dst)[order]]
    w, edge_id, src, dst, t, rate = w[order], edge_id[order], src[order], dst[order], t[order], rate[order]
    m, k = len(w), len(terminals)
    name, number = np.unique(np.r_[src, dst, terminals], return_inverse=True)
    of_world = np.arange(worlds)[:, None] * len(name)
    first, others = of_world + number[2 * m], of_world + number[2 * m + 1 :]
    ends = np.r_[w * len(name) + number[:m], w * len(name) + number[m : 2 * m], np.repeat(first.ravel(), k - 1), others.ravel()]
    vertex, ends = np.unique(ends, return_inverse=True)
    pairs = worlds * (k - 1)
    at, met = _forests(np.r_[ends[:m], ends[2 * m : 2 * m + pairs]], np.r_[ends[m : 2 * m], ends[2 * m + pairs :]], len(vertex), m)
    whole = met[m:].reshape(worlds, k - 1).all(1)
    critical = np.where(whole, at[m:].reshape(worlds, k - 1).max(1), -1)
    edges = np.bincount(w, minlength=worlds)
    begin = np.cumsum(edges) - edges

    live = np.bincount(at[:m], minlength=m)
    steps = np.flatnonzero(live)
    of = w[steps]
    n_steps = np.bincount(of, minlength=worlds)
    back = np.cumsum(n_steps)[of] - 1 - np.arange(len(steps))  # places from a world's last repair on
    sums = np.zeros((2, worlds, max(1, int(n_steps.max(initial=0)))))
    sums[0, of, back], sums[1, of, back] = live[steps], np.bincount(at[:m], weights=rate, minlength=m)[steps]
    sums = sums.cumsum(2)[:, of, back]
    kept = ~whole[of] | (steps <= critical[of])
    steps, of, sums = steps[kept], of[kept], sums[:, kept]
    places = lambda i: [pa.array(t[i]), pa.array(edge_id[i])]
    path = pa.StructArray.from_arrays([*places(steps), pa.array(sums[0].astype(np.int64)), pa.array(sums[1])], names=["t", "edge_id", "live", "rate"])
    none = pa.array(~whole)
    last = np.maximum(critical, 0)
    at_last = places(last) if m else [pa.nulls(worlds, pa.float64()), pa.nulls(worlds, pa.int64())]
    return {
        "edges": pa.array(edges),
        "place": pa.array(critical - begin + 1, mask=~whole),
        "critical": pa.StructArray.from_arrays(at_last, names=["t", "edge_id"], mask=none),
        "path": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(of, minlength=worlds))], pa.int32()), path),
    }


def _solved(edges: DataFrame, terminals: Sequence[int]) -> tuple[DataFrame, DataFrame | None]:
    """(world, edges, place, critical, path) of worlds that a task holds, and the edges of the others, if there are any.

    edges counts them without loops, place those up to the critical repair (null if
    the terminals never all meet), path has (t, edge_id, live, rate) of the repairs up to it.
    """
    first, *others = sorted(set(terminals))
    if not others:
        raise ValueError("two or more different terminals are needed")
    wide = None
    if "edges" not in edges.columns:
        many = edges.groupBy("world").agg(F.count("*").alias("_n")).where(F.col("_n") > WORLD).select("world")
        if not (many := cut(many)).isEmpty():
            wide, edges = edges.join(many, "world", "left_semi"), edges.join(many, "world", "left_anti")
        rate = F.col("rate") if "rate" in edges.columns else F.lit(0.0)
        edges = edges.select("world", F.struct("edge_id", "src", "dst", "t", rate.alias("rate")).alias("e")).groupBy("world").agg(F.collect_list("e").alias("edges"))
    ends = [first, *others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column(1).value_lengths().to_numpy()
            cuts = np.flatnonzero(np.diff(np.cumsum(size) // BATCH)) + 1
            for i, j in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(size)].tolist()):
                flat = b.column(1).slice(i, j - i).flatten()
                columns = [flat.field(c).to_numpy(zero_copy_only=False) for c in range(5)]
                yield pa.RecordBatch.from_pydict({"world": b.column(0).slice(i, j - i), **_repaired(size[i:j], *columns, ends)})

    kinds = {"edge_id": "long", "src": "long", "dst": "long", "t": "double", "rate": "double"}
    each = edges.select("world", F.transform("edges", lambda e: F.struct(*(e[c].cast(k).alias(c) for c, k in kinds.items()))).alias("edges"))
    world = edges.schema["world"].dataType.simpleString()
    return each.mapInArrow(run, f"world {world}, edges long, place long, critical {_PLACE}, path array<struct<t:double,edge_id:long,live:long,rate:double>>"), wide


def meetings(edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(world, edge_id, pair, at): the repair (t, edge_id) at which the ends of each edge, and of each asked pair, meet.

    ``edges`` are (world, edge_id, src, dst, t), told apart within a world by
    (t, edge_id); ``pairs`` are (world, pair, src, dst).  Exactly one of edge_id and
    pair is set.  Edges and pairs whose ends are one vertex, and pairs that never
    meet, have no row.  An edge lies in the minimum spanning forest if it meets at itself.
    """
    none = F.lit(None).cast("long")
    rows = edges.select("world", F.col("edge_id").cast("long").alias("edge_id"), none.alias("pair"), F.col("t").cast("double").alias("t"), F.col("src").alias("ca"), F.col("dst").alias("cb"))
    if pairs is not None:
        rows = rows.unionByName(pairs.select("world", none.alias("edge_id"), F.col("pair").cast("long").alias("pair"), F.lit(None).cast("double").alias("t"), F.col("src").alias("ca"), F.col("dst").alias("cb")))
    rows = cut(rows.where("ca <> cb").withColumn("at", F.lit(None).cast(_PLACE)))
    met = rows.where("ca = cb").select("world", "edge_id", "pair", "at")
    while not rows.where("edge_id is not null").isEmpty():
        sides = F.array(F.struct(F.col("ca").alias("c"), F.col("cb").alias("up")), F.struct(F.col("cb").alias("c"), F.col("ca").alias("up")))
        each = rows.where("edge_id is not null").select("world", "t", "edge_id", F.explode(sides).alias("x"))
        picks = cut(each.groupBy("world", "x.c").agg(F.min(F.struct("t", "edge_id", "x.up")).alias("p")).select("world", "c", F.struct("p.t", "p.edge_id").alias("took"), "p.up"))
        step = cut(_roots(picks.select("world", "c", "up")).join(picks.select("world", "c", "took"), ["world", "c"]))
        # a component that took no edge is whole, so a pair that ends in it and elsewhere never meets
        for side in ("ca", "cb"):
            own = step.select("world", F.col("c").alias(side), "root", "took")
            rows = rows.join(own, ["world", side]).withColumn("at", F.greatest("at", "took")).drop(side, "took").withColumnRenamed("root", side)
        rows = cut(rows)
        met = met.unionByName(rows.where("ca = cb").select("world", "edge_id", "pair", "at"))
        rows = rows.where("ca <> cb")
    return met


def _critical(met: DataFrame, terminals: Sequence[int]) -> DataFrame:
    """(world, critical): the repair that brings the last two terminals together; no row where they never all meet."""
    asked = met.where("pair is not null").groupBy("world").agg(F.count("*").alias("k"), F.max("at").alias("critical"))
    return asked.where(F.col("k") == len(set(terminals)) - 1).select("world", "critical")


def _met(edges: DataFrame, terminals: Sequence[int]) -> DataFrame:
    first, *others = sorted(set(terminals))
    if not others:
        raise ValueError("two or more different terminals are needed")
    pairs = edges.select("world").distinct().select("world", F.posexplode(F.array(*map(F.lit, others))).alias("pair", "dst")).withColumn("src", F.lit(first))
    return cut(meetings(edges, pairs))


def rate_paths(edges: DataFrame, terminals: Sequence[int]) -> DataFrame:
    """(world, step, at, live, rate, connects): the repairs of each world that join two components, up to the one that connects the terminals.

    ``edges`` are (world, edge_id, src, dst, t, rate).  ``live`` edges with rates
    that add up to ``rate`` wait before a repair: those whose ends are not joined yet,
    added up from the last repair backwards, so nothing cancels.  ``connects`` marks
    the last repair; a world whose terminals never meet has all its repairs and no mark.
    The forest of one world, fewer rows than it has vertices, is ordered in one task.
    """
    small, wide = _solved(edges, terminals)
    at = F.struct("x.t", "x.edge_id")
    path = small.select("world", "critical", F.posexplode("path").alias("k", "x")).select("world", (F.col("k") + 1).cast("long").alias("step"), at.alias("at"), "x.live", "x.rate", F.coalesce(at == F.col("critical"), F.lit(False)).alias("connects"))
    return path if wide is None else path.unionByName(_wide_paths(wide, terminals))


def _wide_paths(edges: DataFrame, terminals: Sequence[int]) -> DataFrame:
    """``rate_paths`` by rounds over tables."""
    met = _met(edges, terminals)
    rates = edges.select("world", F.col("edge_id").cast("long").alias("edge_id"), "rate")
    gone = met.where("edge_id is not null").select("world", "edge_id", "at").join(rates, ["world", "edge_id"]).groupBy("world", "at").agg(F.count("*").alias("n"), F.sum("rate").alias("r"))
    back = Window.partitionBy("world").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    path = gone.select("world", "at", F.sum("n").over(back).alias("live"), F.sum("r").over(back).alias("rate"), F.count("*").over(Window.partitionBy("world")).alias("all"), F.row_number().over(Window.partitionBy("world").orderBy(F.desc("at"))).alias("k"))
    path = path.join(_critical(met, terminals), "world", "left").where("critical is null or at <= critical")
    return path.select("world", (F.col("all") - F.col("k") + 1).alias("step"), "at", "live", "rate", F.coalesce(F.col("at") == F.col("critical"), F.lit(False)).alias("connects"))


@F.pandas_udf(DoubleType())
def _tail(rates: pd.Series) -> pd.Series:
    known: dict[bytes, float] = {}  # worlds of equal rates share their paths
    out = []
    for r in rates:
        r = np.asarray(r, float)
        if (key := r.tobytes()) not in known:
            known[key] = hypoexponential_tail(r)
        out.append(known[key])
    return pd.Series(out, dtype=float)


def permutation_estimates(edges: DataFrame, terminals: Sequence[int]) -> DataFrame:
    """(world, steps, estimate): the chance, given a world's order of repairs, that its terminals are apart at time 1.

    The waits between repairs are independent exponentials with the rates of the
    path; a world whose terminals never meet has the estimate 1 and no steps, and so
    has a world whose edges are all loops.
    """
    small, wide = _solved(edges, terminals)
    rates = F.when(F.col("place").isNotNull(), F.transform("path", lambda x: x["rate"])).otherwise(F.array().cast("array<double>"))
    found = small.select("world", rates.alias("rates"))
    if wide is not None:
        paths = _wide_paths(wide, terminals).groupBy("world").agg(F.array_sort(F.collect_list(F.struct("step", "rate"))).alias("path"), F.bool_or("connects").alias("whole"))
        paths = paths.where("whole").select("world", F.transform("path", lambda x: x["rate"]).alias("rates"))
        found = found.unionByName(wide.select("world").distinct().join(paths, "world", "left").select("world", F.coalesce("rates", F.array().cast("array<double>")).alias("rates")))
    steps = F.size("rates").cast("long")
    return found.select("world", steps.alias("steps"), F.when(steps == 0, F.lit(1.0)).otherwise(_tail("rates")).alias("estimate"))


def critical_places(edges: DataFrame, terminals: Sequence[int]) -> DataFrame:
    """(world, place, edges): how many repairs, loops aside, a world needs until its terminals are connected, and how many it has; place is null where that never happens."""
    small, wide = _solved(edges, terminals)
    places = small.where("edges > 0").select("world", "place", "edges")
    return places if wide is None else places.unionByName(_wide_places(wide, terminals).select("world", "place", "edges"))


def critical_repairs(edges: DataFrame, terminals: Sequence[int]) -> DataFrame:
    """(world, edge_id, place): the repair that connects the terminals and its place in the order, loops aside; no row where that never happens."""
    small, wide = _solved(edges, terminals)
    out = small.where("place is not null").select("world", "critical.edge_id", "place")
    return out if wide is None else out.unionByName(_wide_places(wide, terminals).where("place is not null").select("world", "edge_id", "place"))


def _wide_places(edges: DataFrame, terminals: Sequence[int]) -> DataFrame:
    """(world, edge_id, place, edges) of worlds by rounds over tables."""
    rows = edges.where("src <> dst").select("world", F.struct(F.col("t").cast("double").alias("t"), F.col("edge_id").cast("long").alias("edge_id")).alias("own"))
    with_critical = rows.join(_critical(_met(edges, terminals), terminals), "world", "left")
    return with_critical.groupBy("world").agg(F.first("critical.edge_id").alias("edge_id"), F.nullif(F.count_if(F.col("own") <= F.col("critical")), F.lit(0)).alias("place"), F.count("*").alias("edges"))


def fewer_repaired(edges: int, p: float, bound: int) -> float:
    """Chance that fewer than ``bound`` of so many edges, each up with probability p (0 < p < 1), are up; a sum of positive terms."""
    log = lambda k: math.lgamma(edges + 1) - math.lgamma(k + 1) - math.lgamma(edges - k + 1) + k * math.log(p) + (edges - k) * math.log1p(-p)
    return math.fsum(math.exp(log(k)) for k in range(min(bound, edges + 1)))


def conditional_estimates(places: DataFrame, p: float, least_down: int) -> DataFrame:
    """(place, edges, n, estimate): worlds with one place in the order share an estimate, so one row for each place that occurs.

    The estimate is the chance that fewer edges than ``place`` are up, given that
    ``least_down`` are down at least, times the chance of that condition: with a
    minimum cut of that size no other state is disconnected.  A null place has the
    chance of the condition itself.
    """

    @F.pandas_udf(DoubleType())
    def chance(place: pd.Series, edges: pd.Series) -> pd.Series:
        bound = edges - least_down + 1
        need = place.fillna(np.inf).clip(upper=bound)
        return pd.Series([fewer_repaired(int(m), p, int(b)) for m, b in zip(edges, need)], dtype=float)

    rows = places.groupBy("place", "edges").agg(F.count("*").alias("n"))
    return rows.select("place", "edges", "n", chance(F.col("place").cast("double"), F.col("edges")).alias("estimate"))
