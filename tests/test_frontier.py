"""The recursion over a vertex elimination against enumeration and the exact values of the benchmark graphs."""

import itertools
import random

import numpy as np
import pytest

from tidegraph.operators import frontier
from tidegraph.sources import graphs


def by_enumeration(g, p):
    total = 0.0
    for up in itertools.product((0, 1), repeat=len(g.edges)):
        label = list(range(g.vertices))
        for (a, b), u in zip(g.edges, up):
            if u:
                label = [label[a] if x == label[b] else x for x in label]
        if len({label[t] for t in g.terminals}) > 1:
            total += np.prod([q if u else 1 - q for q, u in zip(p, up)])
    return total


def in_one_batch(g, p):
    key, w, width, failed = np.zeros((1, 2), np.int64), np.ones((1, p.shape[1])), 0, np.zeros(p.shape[1])
    for step in frontier.steps_of(g):
        key, w, lost, width = frontier.turn(key, w, width, step, p)
        failed = failed + lost
    return failed


def test_random_graphs_by_enumeration(spark):
    r = random.Random(7)
    for k in range(60):
        n = r.randrange(2, 8)
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(r.randrange(0, 11))]
        g = graphs.from_edges(edges, r.sample(range(n), r.randrange(2, n + 1)), n)
        p = [r.random() for _ in edges]
        want = by_enumeration(g, p)
        assert in_one_batch(g, np.array(p, float).reshape(-1, 1))[0] == pytest.approx(want, abs=1e-12)
        if k < 3:
            got = {x.scenario: x.unreliability for x in frontier.unreliability(spark, g, [p, 0.5, 0.9], every=3).collect()}
            assert got == {0: pytest.approx(want), 1: pytest.approx(by_enumeration(g, [0.5] * len(p))), 2: pytest.approx(by_enumeration(g, [0.9] * len(p)))}


#: Exact unreliability at 0.99 and 0.9999.
BENCHMARK = {
    "dodecahedron": (graphs.dodecahedron, 2.0618910983e-06, 2.0006001801e-12),
    "series": (graphs.dodecahedra_in_series, 2.0617442347e-04, 2.0006001700e-08),
    "parallel": (graphs.dodecahedra_in_parallel, 8.2487112217e-12, 8.0024008403e-24),
    "grid9": (lambda: graphs.grid(9, (0, 80)), 2.0403039808e-04, 2.0004000300e-08),
    "hubs": (lambda: graphs.grid_with_hubs(9), 1.1549057422e-17, 1.0014410445e-35),
}


@pytest.mark.parametrize("name", BENCHMARK)
def test_benchmark_graphs(name):
    make, *want = BENCHMARK[name]
    g = make()
    assert in_one_batch(g, np.tile([0.99, 0.9999], (len(g.edges), 1))) == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("name", ["parallel", "hubs"])
def test_benchmark_graphs_on_tables(spark, name):
    make, *want = BENCHMARK[name]
    got = [r.unreliability for r in frontier.unreliability(spark, make(), [0.99, 0.9999]).orderBy("scenario").collect()]
    assert got == pytest.approx(want, rel=1e-9)


def test_too_many_open_vertices():
    with pytest.raises(ValueError):
        frontier.steps_of(graphs.complete(20, 2))
