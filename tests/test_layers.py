"""Layered samples: estimate and variance average to the truth over all samples."""

import itertools
import math
import random

import pytest

from tidegraph.operators import layers


def designs_of(sizes, n):
    """All samples with their probabilities, and joint inclusion probabilities."""
    weight = {s: math.prod(sizes[i] for i in s) for s in itertools.combinations(sorted(sizes), n)}
    total = sum(weight.values())
    p = {s: w / total for s, w in weight.items()}
    joint = {(a, b): sum(q for s, q in p.items() if a in s and b in s) for a in sizes for b in sizes}
    return p, joint


def test_merging_keeps_lineage(spark):
    rows = [(1, "x", 0.5), (2, "x", 0.25), (2, "x", 0.25), (3, "y", 1.0)]
    got = {r.key: (r.weight, [tuple(x) for x in r.lineage]) for r in layers.merged(spark.createDataFrame(rows, "parent long, key string, share double"), ["key"]).collect()}
    assert got == {"x": (1.0, [(1, 0.5), (2, 0.5)]), "y": (1.0, [(3, 1.0)])}


def test_variance_averages_to_the_exact_one(spark):
    """Three layers in which units merge; every combination of samples is a group of its own."""
    r = random.Random(3)
    sizes = [{k: r.uniform(1, 3) for k in range(4)} for _ in range(3)]
    n = [3, 2, 2]
    share = [{(p, c): round(r.uniform(0, 2), 2) for p in (range(1) if k == 0 else range(4)) for c in range(4) if k == 0 or r.random() < 0.8} for k in range(3)]
    z = {c: r.uniform(0.5, 2) for c in range(4)}
    value = dict(z)
    for s in reversed(share):
        value = {p: sum(w * value.get(c, 0) for (q, c), w in s.items() if q == p) for p in {q for q, _ in s}}
    truth = value[0]
    each = [designs_of(sizes[k], n[k]) for k in range(3)]
    tables = [([], []) for _ in range(3)]
    leaves, chance, estimates = [], [], {}
    for number, samples in enumerate(itertools.product(*(d[0] for d in each))):
        chance.append((number, math.prod(d[0][s] for d, s in zip(each, samples))))
        above = (0,)
        for k, s in enumerate(samples):
            tables[k][0].extend((number, a, b, each[k][1][a, b]) for a in s for b in s)
            tables[k][1].extend((number, p, c, w) for (p, c), w in share[k].items() if p in above and c in s)
            above = s
        leaves.extend((number, c, z[c]) for c in samples[-1])
        e = {c: z[c] for c in samples[-1]}
        for k in (2, 1, 0):
            e = {p: sum(w * e.get(c, 0) / each[k][1][c, c] for (q, c), w in share[k].items() if q == p and c in samples[k]) for p in {q for q, _ in share[k]}}
        estimates[number] = e[0]
    frames = [(spark.createDataFrame(j, "s int, a int, b int, pi_ab double"), spark.createDataFrame(x, "s int, parent int, unit int, share double")) for j, x in tables]
    got_z, got_cov = layers.estimate(frames, spark.createDataFrame(leaves, "s int, unit int, z double"), ["s"])
    zs, covs = {x.s: x.z for x in got_z.collect()}, {x.s: x.cov for x in got_cov.collect()}
    assert all(zs.get(k, 0) == pytest.approx(e) for k, e in estimates.items())
    assert sum(p * zs.get(k, 0) for k, p in chance) == pytest.approx(truth)
    exact = sum(p * (estimates[k] - truth) ** 2 for k, p in chance)
    assert sum(p * covs.get(k, 0) for k, p in chance) == pytest.approx(exact)
