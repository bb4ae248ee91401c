"""Scans over parts, and sampling designs against enumeration of all samples."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tidegraph.operators import designs, sampling, scan


def test_prefix_sums_over_many_parts(spark):
    r = random.Random(1)
    rows = [(i, r.randrange(-50, 100), r.randrange(9) if r.random() < 0.9 else None) for i in range(700)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, a long, b long")
    got = scan.prefix_sums(df, ["k"], {"sa": "a", "sb": "b"}, part_rows=40).orderBy("k").collect()
    rows.sort()
    a = list(itertools.accumulate(x[1] for x in rows))
    b = list(itertools.accumulate(x[2] or 0 for x in rows))
    assert [(x.sa, x.sb) for x in got] == list(zip(a, b))
    assert scan.prefix_sums(df.limit(0), ["k"], {"sa": "a"}).collect() == []


def test_tree_of_scans(spark):
    parts = spark.createDataFrame([(i, [i, 1]) for i in range(30) if i % 7], "part long, value array<long>")
    got = {x.part: (x.before, x.after) for x in scan.around(parts, lambda a, b: a + b, [0, 0], fan=3).collect()}
    known = [i for i in range(30) if i % 7]
    assert got == {i: ([sum(k for k in known if k < i), sum(k < i for k in known)], [sum(k for k in known if k > i), sum(k > i for k in known)]) for i in known}


def test_latest_mark(spark):
    marks = spark.createDataFrame([(float(3 * k), k) for k in range(1, 60)], "at double, m long")
    points = spark.createDataFrame([(x / 2, x) for x in range(500)] + [(170.0, 1000 + k) for k in range(300)], "at double, p long")
    got = {r.p: r.m for r in scan.latest(points, marks, "at", "m", part_rows=50).collect()}
    want = lambda x: None if x < 3 else min(59, int(x // 3))
    assert got == {x: want(x / 2) for x in range(500)} | {1000 + k: 56 for k in range(300)}


def scale(sizes, n):
    low, high = 0.0, 1e9
    for _ in range(200):
        c = (low + high) / 2
        low, high = (c, high) if sum(min(1, c * s) for s in sizes) < n else (low, c)
    return low


def test_certain_units_one_after_another(spark):
    sizes = [2**k for k in range(40)] + [3, 3, 0]
    df = spark.createDataFrame(list(enumerate(sizes)), "u long, size long")
    for n in (1, 5, 30, 41):
        c = sampling.threshold_scale(df, "size", n, part_rows=7)
        assert c == pytest.approx(scale(sizes, n), rel=1e-9)
        assert sum(r.pi for r in sampling.inclusion_table(df, "size", n).collect()) == pytest.approx(n)
    got = {r.u: r for r in sampling.threshold_sample(df, "u", "size", 30, 3, part_rows=7).collect()}
    assert len(got) == 30 and all(r.weight == (r.size if r.mass >= 1 else pytest.approx(1 / sampling.threshold_scale(df, "size", 30))) for r in got.values())
    assert sampling.inclusion_table(df, "size", 42).where("pi < 1").count() == 1  # the unit without a size
    assert sampling.threshold_sample(df, "u", "size", 50, 3).count() == 42


def test_alias_draws_by_place(spark):
    df = spark.createDataFrame([(k, 1000 if k == 3 else k % 4) for k in range(90)], "u long, size long")
    got = sampling.alias_draws(df, "u", "size", 600, 5, part_rows=40).collect()
    assert sorted(r.draw for r in got) == list(range(600)) and sum(r.u == 3 for r in got) > 450 and all(r.u == 3 or r.u % 4 for r in got)
    assert sampling.alias_draws(df.where("size < 0"), "u", "size", 5, 5).collect() == []


SIZES = [5.0, 1.0, 3.0, 0.0, 2.0, 2.0, 9.0]


def test_conditional_poisson_by_enumeration(spark):
    n = 3
    df = spark.createDataFrame(list(enumerate(SIZES)), "u long, size double")
    weight = {s: math.prod(SIZES[i] for i in s) for s in itertools.combinations(range(7), n)}
    total = sum(weight.values())
    for part_rows in (100, 2):
        got = designs.conditional_poisson_sample(df, "u", "size", n, 4, part_rows)
        rows = {r.u: r for r in got.collect()}
        assert all(rows[i].pi == pytest.approx(sum(w for s, w in weight.items() if i in s) / total) for i in range(7))
        taken = [i for i in rows if rows[i].taken]
        assert len(taken) == n
        joint = {(r.a, r.b): r.pi_ab for r in designs.joint_inclusion(got, "u", n).collect()}
        assert joint == {(i, j): pytest.approx(sum(w for s, w in weight.items() if {i, j} <= set(s)) / total) for i in taken for j in taken}
    with pytest.raises(ValueError):
        designs.conditional_poisson_sample(df, "u", "size", 7, 4)


def test_parts_do_not_change_the_sample(spark):
    df = spark.range(60).select(F.col("id").alias("u"), (1 + F.col("id") % 5).alias("size"))
    samples = [sorted(r.u for r in designs.conditional_poisson_sample(df, "u", "size", 12, 9, k).where("taken").collect()) for k in (100, 7)]
    assert samples[0] == samples[1] and len(samples[0]) == 12


def test_sampford_by_enumeration(spark):
    pi = [0.9, 0.2, 0.5, 0.7, 0.3, 0.4]  # sums to 3
    df = spark.createDataFrame([*enumerate(pi), (6, 1.0)], "u long, pi double")
    got = designs.fixed_size_sample(df.where("pi < 1").withColumnRenamed("pi", "q").withColumn("w", 1 - F.col("q")), "u", "q", 3, 1, weight="w", part_rows=2)
    assert {r.u: r.pi for r in got.collect()} == {i: pytest.approx(p) for i, p in enumerate(pi)}
    hits = {}
    for seed in range(12):
        s = tuple(sorted(r.u for r in designs.sampford_sample(df, "u", "pi", 4, seed).where("taken").collect()))
        assert len(s) == 4 and s[-1] == 6
        hits[s] = hits.get(s, 0) + 1
    assert len(hits) > 1


def test_steps_draw_sampfords_design():
    import numpy as np

    pi = np.array([0.9, 0.2, 0.5, 0.4])  # sums to 2
    n, w = 2, 1 - pi
    tails = designs._tails(pi, w, designs._start(n, 1), n, 1)
    rng, hits, runs = np.random.default_rng(2), {}, 20_000
    for u in rng.random((runs, 4)):
        state, taken = np.array([n + n + 1]), []
        for i in range(4):
            after = designs._step(state, u[i], pi[i], w[i], tails[i], tails[i + 1])
            if after[0] % (n + 1) != state[0] % (n + 1):
                taken.append(i)
            state = after
        hits[tuple(taken)] = hits.get(tuple(taken), 0) + 1
    odds = {s: math.prod(pi[i] / (1 - pi[i]) for i in s) * sum(1 - pi[i] for i in s) for s in itertools.combinations(range(4), n)}
    total = sum(odds.values())
    assert all(abs(hits.get(s, 0) / runs - o / total) < 0.015 for s, o in odds.items())


def test_units_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def units(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(5000).selectExpr("id", "id % 97 + 1 as size").mapInArrow(units, "id long, size long")
    got = sampling.threshold_sample(rows, "id", "size", 50, 3, part_rows=1 << 10).collect()
    assert seen.value == 5000 and len(got) in (49, 50, 51)
