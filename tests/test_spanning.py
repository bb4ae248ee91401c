"""Spanning forests and meeting edges of many worlds against plain repair in order."""

import random

from tidegraph.operators import spanning


def plain(edges, s, t):
    """Edges that join two components in order, and the one at which s and t meet."""
    label, tree, meet = {}, [], None
    for _, e, a, b in sorted((x[3], *x[:3]) for x in edges):
        x, y = label.setdefault(a, a), label.setdefault(b, b)
        if x != y:
            tree.append(e)
            label = {v: x if c == y else c for v, c in label.items()}
            if meet is None and label.get(s, s) == label.get(t, t):
                meet = e
    return set(tree), meet


def test_worlds_by_plain_repair(spark):
    r = random.Random(4)
    worlds = {}
    for w in range(25):
        n = r.randrange(2, 12)
        worlds[w] = [(e, r.randrange(n), r.randrange(n), r.choice([0.1, 0.5, r.random()])) for e in range(r.randrange(1, 20))]
    rows = [(w, *x) for w, edges in worlds.items() for x in edges]
    tree = spanning.minimum_spanning(spark.createDataFrame(rows, "world long, edge_id int, src int, dst int, t double"))
    got, meet = {}, {x.world: x.edge_id for x in spanning.meeting_edges(tree, 0, 1).collect()}
    for x in tree.collect():
        got.setdefault(x.world, []).append(x.edge_id)
    for w, edges in worlds.items():
        want, at = plain(edges, 0, 1)
        assert sorted(got.get(w, [])) == sorted(want) and meet.get(w) == at
