"""Rare-event estimators of the probability that terminals are not connected.

One row is one replicate, a whole run of an estimator; replicates are spread over
the cluster and never shuffled, and each is a function of (seed, replicate) alone.
Inside a replicate a particle is the partition of the vertices by edges that are
up, the number of decided edges, a weight and an importance density.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.states import random_world
from tidegraph.operators.exact import with_connected
from tidegraph.operators.mincut import split_size
from tidegraph.operators.sampling import alias, conditional_poisson, inclusion, sampford, threshold
from tidegraph.sources.graphs import Graph, probability, sample_size

Labels = tuple[int, ...]


class Network:
    """A graph with its edge probability; remembers minimum cuts of partitions."""

    def __init__(self, g: Graph, p: float):
        if not g.terminals:
            raise ValueError("the graph has no terminals")
        self.g, self.p, self.q = g, probability(p), 1 - probability(p)
        self.m = len(g.edges)
        self._cuts: dict[tuple[int, Labels], int | None] = {}

    def start(self) -> Labels:
        return tuple(range(self.g.vertices))

    def joined(self, s: Labels, k: int) -> Labels:
        a, b = self.g.edges[k]
        x, y = s[a], s[b]
        if x == y:
            return s
        lo, hi = min(x, y), max(x, y)
        return tuple(lo if v == hi else v for v in s)

    def idle(self, s: Labels, k: int) -> bool:
        """Whether edge k joins what is joined already."""
        a, b = self.g.edges[k]
        return s[a] == s[b]

    def cut(self, s: Labels, k: int) -> int | None:
        """Fewest edges from k on whose loss splits the terminals; None if they are joined, 0 if they are split."""
        key = (k, s)
        if key not in self._cuts:
            if len(self._cuts) > 200_000:
                self._cuts.clear()
            self._cuts[key] = split_size(s, self.g.edges[k:], self.g.terminals)
        return self._cuts[key]

    def down_share(self, s: Labels, k: int) -> float:
        """Importance probability that edge k is down, from the minimum cuts of both outcomes."""
        down, up = self.cut(s, k + 1), self.cut(self.joined(s, k), k + 1)
        a = self.q * self.q ** (down or 0) if down is not None else 0.0
        b = self.p * self.q**up if up is not None else 0.0
        return a / (a + b) if a + b > 0 else 0.5


def importance(net: Network, rng: np.random.Generator, state: Labels | None = None, first: int = 0, weight: float = 1.0) -> float:
    """One likelihood ratio by importance sampling of edges in order; 0 if the terminals stay connected.

    A particle goes on from its state, with its weight, at the edge ``first``.
    """
    s = net.start() if state is None else state
    for k in range(first, net.m):
        c = net.cut(s, k)
        if c is None:
            return 0.0
        if c == 0:
            return weight
        if net.idle(s, k):
            continue
        share = net.down_share(s, k)
        if rng.random() < share:
            weight *= net.q / share
        else:
            weight *= net.p / (1 - share)
            s = net.joined(s, k)
    return weight if net.cut(s, net.m) == 0 else 0.0


def splitting(net: Network, n: int, rng: np.random.Generator, merge: bool, design: str) -> float:
    """Particles split on every edge and at most n go on; equal states merge first if asked.

    ``design``: ``sampford`` or ``threshold``.  With n beyond the number of
    states nothing is sampled and the result is exact.
    """
    rows: list[tuple[Labels, float, float]] = [(net.start(), 1.0, 1.0)]
    failed = 0.0
    for k in range(net.m):
        grown: list[tuple[Labels, float, float]] = []
        for s, w, d in rows:
            if net.idle(s, k):
                grown.append((s, w, d))
                continue
            share = net.down_share(s, k)
            for t, wt, dt in ((s, w * net.q, d * share), (net.joined(s, k), w * net.p, d * (1 - share))):
                c = net.cut(t, k + 1)
                if c == 0:
                    failed += wt
                elif c is not None and dt > 0:
                    grown.append((t, wt, dt))
        if merge:
            held: dict[Labels, list[float]] = {}
            for s, w, d in grown:
                x = held.setdefault(s, [0.0, 0.0])
                x[0] += w
                x[1] += d
            grown = [(s, w, d) for s, (w, d) in held.items()]
        if len(grown) > n:
            size = np.array([d for _, _, d in grown])
            if design == "threshold":
                chosen, c = threshold(size, n, rng)
                grown = [(s, w, d) if c * d >= 1 else (s, w / (c * d), 1 / c) for s, w, d in (grown[i] for i in chosen)]
            else:
                pi = inclusion(size, n)
                grown = [(s, w / x, d / x) for (s, w, d), x in ((grown[i], pi[i]) for i in sampford(pi, rng))]
        rows = grown
    return failed


def splitting_with_variance(net: Network, n: int, rng: np.random.Generator, merge: bool) -> tuple[float, float, list[tuple]]:
    """Estimate, its variance estimate, and the layers of the sampling graph.

    Conditional Poisson samples; the variance follows from the covariances of the
    chosen units' own estimates, carried back layer by layer with the joint
    inclusion probabilities (each layer is one design for all parents together).
    """
    units: list[tuple[Labels, float]] = [(net.start(), 1.0)]
    layers: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # gone, transitions, pi, joint
    for k in range(net.m):
        gone = np.zeros(len(units))
        index: dict[object, int] = {}
        states: list[tuple[Labels, float]] = []
        moves: list[tuple[int, int, float]] = []
        for a, (s, d) in enumerate(units):
            share = net.down_share(s, k)
            both = [(s, 1.0, d)] if net.idle(s, k) else [(s, net.q, d * share), (net.joined(s, k), net.p, d * (1 - share))]
            for t, f, dt in both:
                c = net.cut(t, k + 1)
                if c == 0:
                    gone[a] += f
                elif c is not None and dt > 0:
                    key = t if merge else (a, t)
                    if key not in index:
                        index[key] = len(states)
                        states.append((t, 0.0))
                    i = index[key]
                    states[i] = (t, states[i][1] + dt)
                    moves.append((a, i, f))
        size = np.array([d for _, d in states])
        if len(states) > n:
            target = inclusion(size, n)
            sure = np.flatnonzero(target > 0.9999)
            rest = np.setdiff1d(np.arange(len(states)), sure)
            # with a single place no two units could meet, and the variance could not be estimated
            take = max(2, n - len(sure))
            x = np.minimum(target[rest], 1 - 1e-9)
            s, pi_rest, joint_rest = conditional_poisson(x / (1 - x), min(take, len(rest)), rng)
            chosen = np.r_[sure, rest[s]]
            pi = np.r_[np.ones(len(sure)), pi_rest[s]]
            joint = np.outer(pi, pi)
            joint[len(sure) :, len(sure) :] = joint_rest
        else:
            chosen, pi = np.arange(len(states)), np.ones(len(states))
            joint = np.ones((len(states), len(states)))
        place = {int(i): r for r, i in enumerate(chosen)}
        f = np.zeros((len(units), len(chosen)))
        for a, i, v in moves:
            if i in place:
                f[a, place[i]] += v
        layers.append((gone, f, pi, joint))
        units = [(states[i][0], states[i][1] / pi[place[int(i)]]) for i in chosen]
    mean, cov = np.zeros(len(units)), np.zeros((len(units), len(units)))
    for gone, f, pi, joint in reversed(layers):
        if len(pi):
            y = mean / pi
            inner = (1 - np.outer(pi, pi) / joint) * np.outer(y, y) + cov / joint
            mean, cov = gone + f @ y, f @ inner @ f.T
        else:
            mean, cov = gone, np.zeros((len(gone), len(gone)))
    return float(mean[0]), float(cov[0, 0]), layers


def residual(net: Network, n: int, rng: np.random.Generator) -> float:
    """Importance steps of n particles with residual resampling after each edge; the mean weight at the end."""
    states, w = [net.start()] * n, np.ones(n)
    for k in range(net.m):
        for i in range(n):
            s = states[i]
            if w[i] == 0 or net.idle(s, k) or net.cut(s, k) == 0:
                continue
            share = net.down_share(s, k)
            if rng.random() < share:
                w[i] *= net.q / share
            else:
                w[i] *= net.p / (1 - share)
                states[i] = net.joined(s, k)
        mean = w.mean()
        if mean == 0:
            return 0.0
        copies = np.floor(w / mean).astype(int)
        rest = w - copies * mean
        picked = np.repeat(np.arange(n), copies)
        weight = np.full(len(picked), mean)
        left = n - len(picked)
        if left and rest.sum() > 0:
            more = alias(rest, left, rng)
            picked, weight = np.r_[picked, more], np.r_[weight, np.full(left, rest.sum() / left)]
        states, w = [states[i] for i in picked], weight
        n = len(states)
    return float(w.sum() / len(w)) if len(w) else 0.0


def hypoexponential_tail(rates: np.ndarray, t: float = 1.0) -> float:
    """P(sum of independent exponentials > t) by uniformisation: all terms are positive, so nothing cancels."""
    rates = np.asarray(rates, float)
    if not len(rates):
        return 0.0
    top = rates.max()
    mean = top * t
    state = np.zeros(len(rates))
    state[0] = 1.0
    stay = 1 - rates / top
    total, k, alive = 0.0, 0, 1.0
    most = int(mean + 12 * math.sqrt(mean + 1) + 60) + len(rates)
    while k <= most and alive > 0:
        total += alive * math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) if mean > 0 else alive
        moved = state * (rates / top)
        state = state * stay
        state[1:] += moved[:-1]
        alive = state.sum()
        k += 1
    return min(1.0, total)


def permutation(net: Network, rng: np.random.Generator) -> float:
    """Permutation Monte Carlo with one rate: edges are repaired in random order; the chance that the critical repair comes after time 1."""
    rate = -math.log1p(-net.p)
    order = rng.permutation(net.m)
    label = list(range(net.g.vertices))
    live = [True] * net.m
    n_live, rates = net.m, []
    for e in order.tolist():
        if not live[e]:
            continue
        rates.append(n_live * rate)
        a, b = net.g.edges[e]
        x, y = label[a], label[b]
        label = [x if v == y else v for v in label]
        for f in range(net.m):
            if live[f] and label[net.g.edges[f][0]] == label[net.g.edges[f][1]]:
                live[f] = False
                n_live -= 1
        if len({label[t] for t in net.g.terminals}) == 1:
            return hypoexponential_tail(np.array(rates))
    return 1.0


def conditional_permutation(net: Network, least_down: int, rng: np.random.Generator) -> float:
    """The same given that at least ``least_down`` edges are down: ratio of two tails of the repair times.

    At time 1 fewer than m - least_down + 1 edges are repaired just if the repair
    of that number comes later; self-loops never matter and are left out.
    """
    edges = [e for e in range(net.m) if net.g.edges[e][0] != net.g.edges[e][1]]
    if len({*net.g.terminals}) < 2:
        return 0.0
    if not edges:
        return 1.0
    rate = -math.log1p(-net.p)
    m = len(edges)
    order = [edges[i] for i in rng.permutation(m)]
    label = list(range(net.g.vertices))
    critical = None
    for k, e in enumerate(order):
        a, b = net.g.edges[e]
        x, y = label[a], label[b]
        label = [x if v == y else v for v in label]
        if len({label[t] for t in net.g.terminals}) == 1:
            critical = k + 1
            break
    rates = np.array([(m - k) * rate for k in range(m)])
    bound = m - least_down + 1
    given = hypoexponential_tail(rates[:bound]) if bound <= m else 1.0
    both = given if critical is None else hypoexponential_tail(rates[: min(critical, bound)])
    return both / given


def least_down_share(net: Network, least: int) -> float:
    """Probability that so many edges at least, self-loops aside, are down; a sum of positive terms."""
    m = sum(a != b for a, b in net.g.edges)
    return math.fsum(math.exp(math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1) + k * math.log(net.q) + (m - k) * math.log(net.p)) for k in range(least, m + 1)) if 0 < net.p < 1 else float(net.p == 0 or least == 0)


def _conditional(net: Network, n: int, rng: np.random.Generator) -> list[float]:
    """Permutation estimates given that as many edges are down as a minimum cut has, times the chance of that."""
    least = net.cut(net.start(), 0)
    if least is None:
        return [0.0] * n
    share = least_down_share(net, least)
    return [share * conditional_permutation(net, least, rng) for _ in range(n)]


METHODS: dict[str, Callable[..., tuple[float, float]]] = {
    "importance": lambda net, n, rng: (lambda x: (float(np.mean(x)), float(np.mean(np.square(x)))))([importance(net, rng) for _ in range(n)]),
    "wor": lambda net, n, rng: (splitting(net, n, rng, False, "sampford"), math.nan),
    "wor_merge": lambda net, n, rng: (splitting(net, n, rng, True, "sampford"), math.nan),
    "fearnhead": lambda net, n, rng: (splitting(net, n, rng, False, "threshold"), math.nan),
    "wor_variance": lambda net, n, rng: splitting_with_variance(net, n, rng, False)[:2],
    "wor_merge_variance": lambda net, n, rng: splitting_with_variance(net, n, rng, True)[:2],
    "residual": lambda net, n, rng: (residual(net, n, rng), math.nan),
    "turnip": lambda net, n, rng: (lambda x: (float(np.mean(x)), float(np.mean(np.square(x)))))([permutation(net, rng) for _ in range(n)]),
    "continued_importance": lambda net, n, rng: (float(np.mean([importance(net, rng, first=1, weight=net.q) for _ in range(n)])), math.nan),
    "conditional_turnip": lambda net, n, rng: (lambda x: (float(np.mean(x)), float(np.mean(np.square(x)))))(_conditional(net, n, rng)),
}


def replicates(spark: SparkSession, g: Graph, p: float, method: str, n: int, seed: int = 1, count: int = 1) -> DataFrame:
    """(replicate, estimate, second): runs of an estimator; ``second`` is a second moment or variance estimate where the method has one."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known are {', '.join(sorted(METHODS))}")
    sample_size(n)
    probability(p)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = Network(g, p)
        for f in frames:
            rows = [(r, *METHODS[method](net, n, np.random.Generator(np.random.Philox(key=[seed, r])))) for r in f["id"].tolist()]
            out = pd.DataFrame(rows, columns=["replicate", "estimate", "second"])
            yield out

    parts = min(count, 4 * spark.sparkContext.defaultParallelism)
    return spark.range(0, count, 1, parts).mapInPandas(run, "replicate long, estimate double, second double").withColumn("second", F.nanvl("second", F.lit(None).cast("double")))


def crude(units: DataFrame, unit: str, g: Graph, p: float, seed: int = 1) -> DataFrame:
    """(n, n_failed, estimate): one world for each row, its edges drawn from hashes of the row's key."""
    worlds = units.select(random_world(len(g.edges), probability(p), seed, F.col(unit)).alias("world"))
    worlds = with_connected(worlds, g)
    failed = F.count_if(~F.col("connected"))
    return worlds.agg(F.count("*").alias("n"), failed.alias("n_failed")).select("n", "n_failed", (F.col("n_failed") / F.col("n")).alias("estimate"))


def _failed_batch(g: Graph, up: np.ndarray) -> np.ndarray:
    """Which worlds, rows of edges that are up, have split terminals; smallest labels run along the edges until none changes."""
    label = np.tile(np.arange(g.vertices, dtype=np.int32), (len(up), 1))
    while True:
        before = label.copy()
        for k, (a, b) in enumerate(g.edges):
            low = np.where(up[:, k], np.minimum(label[:, a], label[:, b]), -1)
            label[:, a] = np.where(low < 0, label[:, a], low)
            label[:, b] = np.where(low < 0, label[:, b], low)
        if (label == before).all():
            ends = label[:, list(g.terminals)]
            return (ends != ends[:, :1]).any(1)


def crude_worlds(spark: SparkSession, g: Graph, p: float | str, n: int, seed: int = 1, chunk: int = 4096) -> DataFrame:
    """(n, n_failed, estimate) of n independent worlds of a graph of any size, drawn in chunks that depend on the seed alone."""
    p = probability(p)
    sample_size(n)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            failed = [int(_failed_batch(g, np.random.Generator(np.random.Philox(key=[seed, c])).random((min(chunk, n - c * chunk), len(g.edges))) < p).sum()) for c in f["id"].tolist()]
            yield pd.DataFrame({"failed": failed})

    chunks = -(-n // chunk)
    rows = spark.range(0, chunks, 1, min(chunks, 4 * spark.sparkContext.defaultParallelism)).mapInPandas(run, "failed long")
    return rows.agg(F.lit(n).cast("long").alias("n"), F.sum("failed").alias("n_failed")).select("n", "n_failed", (F.col("n_failed") / F.col("n")).alias("estimate"))


def variance_graph(g: Graph, p: float, n: int, seed: int, merge: bool = True) -> tuple[list[tuple], list[tuple]]:
    """Nodes (stage, unit, inclusion, z, v) and edges (stage, parent, child, weight) of one run's sampling graph.

    z is a unit's own estimate of what fails below it and v that estimate's variance.
    """
    _, _, layers = splitting_with_variance(Network(g, p), n, np.random.Generator(np.random.Philox(key=[seed, 0])), merge)
    edges = [(k, int(a), int(i), float(f[a, i])) for k, (_, f, _, _) in enumerate(layers) for a, i in zip(*np.nonzero(f))]
    last = len(layers[-1][2])
    mean, cov = np.zeros(last), np.zeros((last, last))
    nodes = [(len(layers), i, float(layers[-1][2][i]), 0.0, 0.0) for i in range(last)]
    for k in range(len(layers) - 1, -1, -1):
        gone, f, pi, joint = layers[k]
        if len(pi):
            y = mean / pi
            inner = (1 - np.outer(pi, pi) / joint) * np.outer(y, y) + cov / joint
            mean, cov = gone + f @ y, f @ inner @ f.T
        else:
            mean, cov = gone, np.zeros((len(gone), len(gone)))
        share = layers[k - 1][2] if k else np.ones(1)
        nodes += [(k, i, float(share[i]), float(mean[i]), float(cov[i, i])) for i in range(len(mean))]
    return sorted(nodes), edges


def variance_graphml(spark: SparkSession, g: Graph, p: float, n: int, seed: int, merge: bool = True) -> DataFrame:
    """Lines (line, value) of the sampling graph's file, with stage, inclusion, Z and V of each node and the weight of each edge."""
    nodes, edges = variance_graph(g, p, n, seed, merge)
    keys = [("stage", "node", "int"), ("inclusion", "node", "double"), ("Z", "node", "double"), ("V", "node", "double"), ("weight", "edge", "double")]
    head = ['<?xml version="1.0" encoding="UTF-8"?>', "<graphml>", *(f'<key id="{k}" for="{at}" attr.name="{k}" attr.type="{kind}"/>' for k, at, kind in keys), '<graph edgedefault="directed">']
    lines = head + [f'<node id="n{s}_{u}"><data key="stage">{s}</data><data key="inclusion">{x!r}</data><data key="Z">{z!r}</data><data key="V">{v!r}</data></node>' for s, u, x, z, v in nodes]
    lines += [f'<edge source="n{s}_{a}" target="n{s + 1}_{b}"><data key="weight">{w!r}</data></edge>' for s, a, b, w in edges] + ["</graph></graphml>"]
    return spark.createDataFrame(list(enumerate(lines)), "line long, value string")
