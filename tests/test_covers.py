"""Ball covers on rows against the cover of whole state arrays."""

import random

from tidegraph.functions.states import FIXED_DOWN, FREE_DOWN
from tidegraph.operators import covers, empirical


def test_same_as_on_arrays(spark):
    r = random.Random(2)
    m = 12
    place = [r.random() * 10 for _ in range(m)]
    far = [[abs(a - b) for b in place] for a in place]
    states = [(i, [r.choice([1, 2, 4, 8, 8]) for _ in range(m)]) for i in range(60)] + [(60, [4] * m), (61, [8] * m)]
    want = {x.obs_id: list(x.state) for x in empirical.thin(spark.createDataFrame(states, "obs_id long, state array<tinyint>"), far, 2.5).collect()}
    down = [(i, e, s) for i, row in states for e, s in enumerate(row) if s in (FIXED_DOWN, FREE_DOWN)]
    near = [(a, b) for a in range(m) for b in range(a + 1, m) if far[a][b] <= 2.5]
    got = covers.ball_cover(spark.createDataFrame(down, "obs_id long, edge_id int, state tinyint"), spark.createDataFrame(near, "e1 int, e2 int")).collect()
    assert len(got) == len(down) and all(want[x.obs_id][x.edge_id] == x.state for x in got)


def test_arrays_and_rounds_agree(spark, monkeypatch):
    r = random.Random(6)
    down = [(i, e, r.choice([2, 8])) for i in range(20) for e in range(15) if r.random() < 0.5]
    near = spark.createDataFrame([(a, b) for a in range(12) for b in range(a + 1, 12) if r.random() < 0.3], "e1 int, e2 int")
    rows = spark.createDataFrame(down, "obs_id int, edge_id int, state tinyint")
    in_arrays = covers.ball_cover(rows, near)
    monkeypatch.setattr(covers, "PAIRS", 1)
    by_rounds = covers.ball_cover(rows, near)
    assert in_arrays.dtypes == by_rounds.dtypes and sorted(in_arrays.collect()) == sorted(by_rounds.collect()) and in_arrays.count() == len(down)


def test_nothing_down(spark):
    none = spark.createDataFrame([], "obs_id long, edge_id int, state tinyint")
    assert covers.ball_cover(none, spark.createDataFrame([(0, 1)], "e1 int, e2 int")).collect() == []
