"""Splitting over tables of particles against enumeration, and the design by groups against plain arrays."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tidegraph.operators import mincut, particles
from tidegraph.sources.graphs import Graph

G = Graph(5, ((0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (2, 2), (3, 4), (2, 4)), (0, 3, 4))


def exact(g, p):
    total = 0.0
    for up in itertools.product((0, 1), repeat=len(g.edges)):
        label = list(range(g.vertices))
        for (a, b), on in zip(g.edges, up):
            if on:
                label = [label[a] if x == label[b] else x for x in label]
        if len({label[t] for t in g.terminals}) > 1:
            total += math.prod(p if on else 1 - p for on in up)
    return total


def test_exact_while_all_states_fit_and_near_otherwise(spark):
    want = exact(G, 0.8)
    for x in particles.splitting(spark, G, 0.8, 1000, 3).collect():
        assert x.estimate == pytest.approx(want, rel=1e-12)
    got = [x.estimate for x in particles.splitting(spark, G, 0.8, 3, 600, seed=5).collect()]
    mean = math.fsum(got) / len(got)
    assert len(got) == 600 and len(set(got)) > 1
    error = math.sqrt(math.fsum((x - mean) ** 2 for x in got)) / len(got)
    assert abs(mean - want) < 4 * error and error < 0.02 * want


def test_design_by_plain_arrays(spark):
    r = random.Random(3)
    groups = {w: [r.choice([0.0, 1.0, r.random(), 50 * r.random()]) for _ in range(r.randrange(1, 15))] for w in range(40)}
    groups[40] = [2.0] * 12
    n, rows = 5, [(w, k, s) for w, sizes in groups.items() for k, s in enumerate(sizes)]
    units = spark.createDataFrame(rows, "w int, k int, size double")
    kept = {w: {} for w in groups}
    for x in particles.threshold_by_group(units, "w", ["k"], "size", n, F.lit(0.37)).collect():
        kept[x.w][x.k] = x.pi
    for w, sizes in groups.items():
        some = sorted((-s, k) for k, s in enumerate(sizes) if s > 0)
        if len(some) <= n:
            assert kept[w] == {k: 1.0 for _, k in some}
            continue
        low, high = 0.0, 1e9
        for _ in range(200):
            c = (low + high) / 2
            low, high = (c, high) if sum(min(1, -c * s) for s, _ in some) < n else (low, c)
        line, want = 0.0, {}
        for s, k in some:
            pi = min(1.0, -high * s)
            if pi > 1 - 1e-9:
                want[k] = 1.0
                continue
            if math.floor(line + pi - 0.37) > math.floor(line - 0.37):
                want[k] = pi
            line += pi
        assert kept[w] == {k: pytest.approx(v, rel=1e-6) for k, v in want.items()} and len(kept[w]) == n


def test_a_states_minimum_cut_is_found_once_a_round_for_all_replicates(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cuts")

    def logged(labels, edges, terminals, split_size=mincut.split_size):
        with open(path, "a") as f:
            f.write(f"{len(edges)} {[int(x) for x in labels]}\n")
        return split_size(labels, edges, terminals)

    monkeypatch.setattr(particles, "split_size", logged)
    got = particles.splitting(spark, G, 0.8, 3, 8000).collect()
    with open(path) as f:
        cuts = f.read().splitlines()
    assert len(got) == 8000 and len(cuts) == len(set(cuts)) > len(G.edges)


def test_a_round_deals_no_particles_over_the_tasks_anew(spark):
    few = Graph(5, G.edges[:-1], G.terminals)  # seven edges, so that three rounds follow the last checkpoint
    rounds = particles.splitting(spark, few, 0.8, 2, 500)
    plan = rounds._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window ") >= 2 and plan.count("Exchange hashpartitioning(replicate") <= 2  # after the checkpoint, and of the sides of the last join


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        particles.splitting(spark, G, 1.0, 3, 2)
