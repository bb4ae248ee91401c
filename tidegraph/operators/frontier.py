"""The merged-state recursion over a vertex elimination: exact unreliability of larger graphs.

Vertices leave one by one, in an order that keeps few of them open at a time.  A
state is the partition of the open vertices into blocks by the edges that are up,
and which blocks have met a terminal; it is packed into two longs, whatever the size
of the graph.  A step is one pass of a kernel over a batch of states (it splits them
by the edges of the vertex that leaves, and merges equal ones within the batch) and
one ``groupBy`` on the two longs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.plans.lineage import cut
from tidegraph.sources.graphs import Graph, probability

#: Open vertices that a state holds: four bits each in one long.
MOST_OPEN = 15
#: Passes between two cuts of the lineage; states up to which a pass takes several steps, and edges that these have together.
EVERY, FEW, TOGETHER = 6, 5000, 24


@dataclass(frozen=True)
class Step:
    """One vertex's turn: vertices that open (terminal or not), edges as pairs of places with their numbers, and the places that close."""

    opens: tuple[bool, ...]
    edges: tuple[tuple[int, int, int], ...]
    closes: tuple[int, ...]
    #: Terminals that have not opened yet after the step's openings.
    unseen: int


def elimination_order(g: Graph) -> list[int]:
    """An order of the vertices with few open at a time: greedily from every start, by open vertices and then by age; the best start counts."""
    near: list[set[int]] = [set() for _ in range(g.vertices)]
    for a, b in g.edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    best: tuple[tuple[float, int], list[int]] | None = None
    for start in range(g.vertices):
        done, age, order, cost, widest = set(), {start: 0}, [], 0.0, 0
        while len(order) < g.vertices:
            choice = list(age) or [next(v for v in range(g.vertices) if v not in done)]
            v = min(choice, key=lambda v: (sum(u not in age and u not in done for u in near[v]), age.get(v, 0), v))
            age.setdefault(v, len(order))
            for u in sorted(near[v]):
                if u not in done:
                    age.setdefault(u, len(order) + 1)
            width = len(age)
            widest, cost = max(widest, width), cost + 4.0**width
            order.append(v)
            done.add(v)
            del age[v]
            if best and cost > best[0][0]:
                break
        else:
            if best is None or (cost, widest) < best[0]:
                best = ((cost, widest), order)
    return best[1] if best else []


def steps_of(g: Graph) -> list[Step]:
    """The turns of the vertices in elimination order."""
    at: list[list[int]] = [[] for _ in range(g.vertices)]
    for e, (a, b) in enumerate(g.edges):
        if a != b:
            at[a].append(e)
            at[b].append(e)
    terminals, left = set(g.terminals), [len(x) for x in at]
    opened: list[int] = []
    used, closed, unseen, out = set(), set(), set(terminals), []
    for v in elimination_order(g):
        if v in closed:  # with its last neighbour
            continue
        edges = [e for e in at[v] if e not in used]
        new = [u for u in dict.fromkeys([v, *(x for e in edges for x in g.edges[e])]) if u not in opened]
        opened += new
        unseen -= set(new)
        if len(opened) > MOST_OPEN:
            raise ValueError(f"more than {MOST_OPEN} vertices would be open at a time")
        pairs = []
        for e in edges:
            used.add(e)
            a, b = g.edges[e]
            left[a] -= 1
            left[b] -= 1
            pairs.append((opened.index(a), opened.index(b), e))
        gone = tuple(k for k, u in enumerate(opened) if not left[u])
        out.append(Step(tuple(u in terminals for u in new), tuple(pairs), gone, len(unseen)))
        closed |= {opened[k] for k in gone}
        opened = [u for k, u in enumerate(opened) if k not in gone]
    return out


def _merged(key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of w with equal keys (label, flag)."""
    order = np.lexsort((key[:, 1], key[:, 0]))
    key, w = key[order], w[order]
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]) if len(key) else np.zeros(0, np.int64)
    return key[new], np.add.reduceat(w, new, axis=0) if len(key) else w


def _packed(labels: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Keys of states, blocks numbered as they come; flags by block."""
    rows, width = labels.shape
    number = np.full((rows, MOST_OPEN + 1), -1)
    n, at = np.zeros(rows, np.int64), np.arange(rows)
    key = np.zeros((rows, 2), np.int64)
    for k in range(width):
        own = labels[:, k]
        fresh = number[at, own] < 0
        number[at[fresh], own[fresh]] = n[fresh]
        n += fresh
        block = number[at, own]
        key[:, 0] |= block << 4 * k
        key[:, 1] |= ((flags >> own) & 1) << block
    return key


def turn(key: np.ndarray, w: np.ndarray, width: int, step: Step, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """States (keys, weights), the weight that surely fails, and the width, after a step; p by (edge, scenario).

    A state in which all terminals are in one block leaves; so does one where a
    block with a terminal closes while there are others, into the failures.
    """
    labels = (key[:, :1] >> 4 * np.arange(width)) & 15 if width else np.zeros((len(key), 0), np.int64)
    flags = key[:, 1].copy()
    for terminal in step.opens:
        labels = np.c_[labels, np.full(len(labels), width)]  # blocks are numbered below the width
        flags |= np.int64(terminal) << width
        width += 1
    for a, b, e in step.edges:
        la, lb = labels[:, a], labels[:, b]
        apart = np.flatnonzero(la != lb)
        low, high = np.minimum(la, lb)[apart], np.maximum(la, lb)[apart]
        up = labels[apart]
        up = np.where(up == high[:, None], low[:, None], up)
        flag = flags[apart]
        flag = (flag | ((flag >> high) & 1) << low) & ~(np.int64(1) << high)
        down = w.copy()
        down[apart] *= 1 - p[e]
        keys, w = _merged(_packed(np.concatenate([labels, up]), np.r_[flags, flag]), np.concatenate([down, w[apart] * p[e]]))
        labels, flags = (keys[:, :1] >> 4 * np.arange(width)) & 15, keys[:, 1]
    failed = np.zeros(w.shape[1])
    open_places = [k for k in range(width) if k not in step.closes]
    if not step.unseen:
        apart = np.bitwise_count(flags.view(np.uint64)) > 1
        labels, flags, w = labels[apart], flags[apart], w[apart]
    kept = np.zeros(len(labels), np.int64)
    for k in open_places:
        kept |= np.int64(1) << labels[:, k]
    lost = (flags & ~kept) != 0  # others are left: else the state would have gone
    if lost.any():
        failed += w[lost].sum(0)
        labels, flags, w = labels[~lost], flags[~lost], w[~lost]
    keys, w = _merged(_packed(labels[:, open_places], flags), w)
    return keys, w, failed, len(open_places)


def unreliability(spark: SparkSession, g: Graph, p: Sequence[float | Sequence[float]], every: int = EVERY) -> DataFrame:
    """(scenario, unreliability), exactly, for each of ``p``: one probability for all edges, or one for each edge.

    Failed mass is summed directly, as sums of positive products in doubles.
    """
    if len(set(g.terminals)) < 2:
        raise ValueError("at least two terminals are needed")
    each = np.array([[probability(q) for q in x] if not isinstance(x, (int, float, str)) else [probability(x)] * len(g.edges) for x in p], float).reshape(len(p), len(g.edges)).T
    states = spark.createDataFrame([(0, 0, False, [1.0] * len(p))], "label long, flag long, failed boolean, w array<double>")
    width, passes, few, left = 0, 0, True, steps_of(g)
    while left:
        # while states are few, one task's merging is as good as a shuffle after each step
        now = [left.pop(0)]
        while few and left and sum(len(s.edges) for s in (*now, left[0])) <= TOGETHER:
            now.append(left.pop(0))
        states = _after(states, width, now, each)
        width += sum(len(s.opens) - len(s.closes) for s in now)
        passes += 1
        if passes % every == 0:
            states = cut(states)
            few = states.count() <= FEW
    total = states.where("failed").select(F.posexplode("w").alias("scenario", "w")).groupBy("scenario").agg(F.sum("w").alias("unreliability"))
    every_one = spark.range(len(p)).select(F.col("id").cast("int").alias("scenario"))
    return every_one.join(total, "scenario", "left").select("scenario", F.coalesce("unreliability", F.lit(0.0)).alias("unreliability"))


def _after(states: DataFrame, width: int, steps: list[Step], p: np.ndarray) -> DataFrame:
    scenarios = p.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            over = b.column(2).to_numpy(zero_copy_only=False)
            w = b.column(3).flatten().to_numpy().reshape(-1, scenarios)
            keys, weight, failed, now = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1)[~over], w[~over], w[over].sum(0), width
            for step in steps:
                keys, weight, lost, now = turn(keys, weight, now, step, p)
                failed = failed + lost
            n = len(keys)
            columns = [np.r_[keys[:, 0], 0], np.r_[keys[:, 1], 0], np.r_[np.zeros(n, bool), True], *np.concatenate([weight, failed[None]]).T]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["label", "flag", "failed", *(f"w{s}" for s in range(scenarios))])

    names = [f"w{s}" for s in range(scenarios)]
    split = states.mapInArrow(run, "label long, flag long, failed boolean, " + ", ".join(f"{x} double" for x in names))
    return split.groupBy("label", "flag", "failed").agg(*(F.sum(x).alias(x) for x in names)).select("label", "flag", "failed", F.array(*names).alias("w"))
