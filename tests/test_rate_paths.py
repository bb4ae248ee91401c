"""Meeting repairs and rate paths of many worlds against plain repair in order."""

import itertools
import math
import random

import pytest

from tidegraph.operators import estimators, rate_paths as rp


def plain(edges, terminals):
    """Meeting repair of each edge, the path of (t, edge, live, rate) up to the connecting repair, that repair and its place."""
    label = {v: v for _, a, b, _, _ in edges for v in (a, b)} | {v: v for v in terminals}
    met, path, done = {}, [], None
    real = [x for x in edges if x[1] != x[2]]
    for place, (t, e, a, b, _) in enumerate(sorted((x[3], x[0], x[1], x[2], x[4]) for x in real)):
        if label[a] == label[b]:
            continue
        live = [x for x in real if label[x[1]] != label[x[2]]]
        if done is None:
            path.append((t, e, len(live), math.fsum(x[4] for x in live)))
        label = {v: label[a] if c == label[b] else c for v, c in label.items()}
        for x in live:
            if label[x[1]] == label[x[2]]:
                met[x[0]] = (t, e)
        if done is None and len({label[v] for v in terminals}) == 1:
            done = (t, e, place + 1)
    return met, path, done


@pytest.mark.parametrize("terminals", [(0, 1), (0, 2, 3)])
def test_paths_by_plain_repair(spark, terminals):
    r = random.Random(sum(terminals))
    worlds = {}
    for w in range(25):
        n = r.randrange(4, 13)
        worlds[w] = [(e, r.randrange(n), r.randrange(n), r.choice([0.1, 0.5, r.random()]), r.uniform(0.1, 2)) for e in range(r.randrange(1, 26))]
    worlds[25] = [(k, k, k + 1, k / 20, 1.0) for k in range(12)]  # a way through all vertices
    worlds[26] = [(k, 0, 1 if k else 2, 0.5, 1.0) for k in range(6)]  # ties of parallel edges
    worlds[27] = [(0, 1, 1, 0.2, 1.0)]  # a loop alone
    rows = [(w, *x) for w, edges in worlds.items() for x in edges]
    edges = spark.createDataFrame(rows, "world long, edge_id int, src int, dst int, t double, rate double")
    want = {w: plain(x, terminals) for w, x in worlds.items()}

    got = {w: {} for w in worlds}
    for x in rp.meetings(edges).collect():
        got[x.world][x.edge_id] = (x["at"].t, x["at"].edge_id)
    assert got == {w: met for w, (met, _, _) in want.items()}

    paths = {w: [] for w in worlds}
    for x in sorted(rp.rate_paths(edges, terminals).collect(), key=lambda x: (x.world, x.step)):
        assert x.step == len(paths[x.world]) + 1
        paths[x.world].append((x["at"].t, x["at"].edge_id, x.live, pytest.approx(x.rate, rel=1e-12)))
        last = want[x.world][2]
        assert x.connects == (last is not None and (x["at"].t, x["at"].edge_id) == last[:2])
    assert paths == {w: path for w, (_, path, _) in want.items()}

    for x in rp.permutation_estimates(edges, terminals).collect():
        _, path, done = want[x.world]
        tail = estimators.hypoexponential_tail([p[3] for p in path]) if done else 1.0
        assert x.estimate == pytest.approx(tail, rel=1e-12) and x.steps == (len(path) if done else 0)
    places = {x.world: x.place for x in rp.critical_places(edges, terminals).collect()}
    assert places == {w: done and done[2] for w, (_, _, done) in want.items() if w != 27}


def test_conditional_estimates_by_tails(spark):
    p, least, m = 0.9, 2, 9
    places = spark.createDataFrame([(w, w % 9 + 1 if w < 20 else None, m) for w in range(22)], "world long, place long, edges long")
    rate = -math.log1p(-p)
    rates = [(m - k) * rate for k in range(m)]
    rows = {x.place: (x.n, x.estimate) for x in rp.conditional_estimates(places, p, least).collect()}
    assert rows[None][0] == 2 and sum(n for n, _ in rows.values()) == 22
    for place, (_, estimate) in rows.items():
        bound = m - least + 1
        assert estimate == pytest.approx(estimators.hypoexponential_tail(rates[: min(place or bound, bound)]), rel=1e-9)


def test_empty_and_bad_arguments(spark):
    none = spark.createDataFrame([], "world long, edge_id int, src int, dst int, t double, rate double")
    assert rp.permutation_estimates(none, (0, 1)).count() == 0 and rp.meetings(none).count() == 0
    with pytest.raises(ValueError):
        rp.rate_paths(none, (1, 1))


def test_all_orders_average_to_the_exact_value(spark):
    """Over every order of five edges both estimators' means are the unreliability by enumeration; a minimum cut has two edges."""
    p, ends = 0.8, [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)]
    orders = list(itertools.permutations(range(5)))
    rate = -math.log1p(-p)
    rows = [(w, e, *ends[e], float(place), rate) for w, order in enumerate(orders) for place, e in enumerate(order)]
    edges = spark.createDataFrame(rows, "world long, edge_id int, src int, dst int, t double, rate double")
    exact = 0.0
    for up in itertools.product((0, 1), repeat=5):
        seen = {0}
        for _ in range(4):
            seen |= {v for e, on in zip(ends, up) if on and seen & set(e) for v in e}
        if 3 not in seen:
            exact += math.prod(p if on else 1 - p for on in up)
    turnip = [x.estimate for x in rp.permutation_estimates(edges, (0, 3)).collect()]
    assert len(turnip) == 120 and math.fsum(turnip) / 120 == pytest.approx(exact, rel=1e-9)
    given = rp.conditional_estimates(rp.critical_places(edges, (0, 3)), p, 2).collect()
    assert math.fsum(x.n * x.estimate for x in given) / 120 == pytest.approx(exact, rel=1e-9)


def test_one_row_a_world_and_large_worlds(spark, monkeypatch):
    """Worlds as rows of arrays, in arrays of a task and by rounds over tables give the same."""
    r = random.Random(9)
    rows = [(w, e, r.randrange(6), r.randrange(6), r.random(), r.uniform(0.1, 2)) for w in range(12) for e in range(3 + w)]
    edges = spark.createDataFrame(rows, "world long, edge_id int, src int, dst int, t double, rate double")
    packed = edges.selectExpr("world", "struct(edge_id, src, dst, t, rate) AS e").groupBy("world").agg({"e": "collect_list"}).toDF("world", "edges")
    found = lambda x: [sorted((a.world, a.step, a["at"].edge_id, a.live, round(a.rate, 9), a.connects) for a in rp.rate_paths(x, (0, 1, 2)).collect()), sorted((a.world, a.edge_id, a.place) for a in rp.critical_repairs(x, (0, 1, 2)).collect())]
    want = found(edges)
    assert want[0] and want[1] and found(packed) == want
    monkeypatch.setattr(rp, "WORLD", 8)
    assert found(edges) == want
