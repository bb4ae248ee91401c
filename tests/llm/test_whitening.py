"""Exact cross-products, and whitening against numpy on the distinct vectors."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidegraph.llm import queries, whitening


def test_cross_products_are_exact():
    r = random.Random(2)
    for top in (1, 7, 1 << 20, (1 << 63) - 1, (1 << 64) - 1):
        y = [[r.randrange(top + 1) for _ in range(5)] for _ in range(131)]
        got = whitening.cross_products(np.array(y, np.uint64))
        assert [[int(v) for v in row] for row in got] == [[sum(a[i] * a[j] for a in y) for j in range(5)] for i in range(5)]


def test_sums_undo_the_shift():
    r = random.Random(3)
    x = [[r.randrange(-(1 << 63), 1 << 63), r.randrange(-5, 5), 7] for _ in range(90)]
    s = whitening.Sums(3)
    s.add(np.array(x[:50], np.int64))
    s.add(np.array(x[50:], np.int64))
    i, j, limbs = s.rows()
    value = {(a, b): sum(int(v) << 32 * k for k, v in enumerate(col)) for a, b, col in zip(i.tolist(), j.tolist(), limbs.T.tolist())}
    assert value[-1, -1] == 90 and all(value[k, -1] == sum(v[k] for v in x) for k in range(3))
    assert all(value[a, b] == sum(v[a] * v[b] for v in x) for a in range(3) for b in range(a, 3))


def test_query_against_numpy(spark, tmp_path):
    rng = np.random.default_rng(4)
    v = (rng.normal(size=(400, 6)) * [3, 2, 1.5, 1, 0.5, 0.2]).tolist()
    rows = [(i, x) for i, x in enumerate(v + v[:150])]
    rows += [(2000, None), (2001, [None] * 6), (2002, [float("nan")] + [0.0] * 5), (2003, [float("inf")] + [0.0] * 5), (2004, []), (None, v[0]), (7, v[7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"whitened": F.lit("mine"), "x": F.lit(1)})
    df.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op12_embedding_whitening(spark, str(tmp_path)).collect()
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in x]) for i, x in rows if x and None not in x and all(map(math.isfinite, x))]
    u = [list(t) for t in {tuple(x) for _, x in kept}]
    n, s = len(u), [sum(c) for c in zip(*u)]
    assert len(got) == 4 * len(kept) and {r.n for r in got} == {n} and all(r.identity_error < 1e-9 for r in got)
    cov = np.cov(np.array(u, float).T, bias=True)
    e, w = np.linalg.eigh(cov)
    e, w = e[::-1], w[:, ::-1]
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    sign = {}
    for i, x in kept:
        for c in range(4):
            r = by[i, c + 1][0]
            assert r.deviation == sum((n * a - b) ** 2 for a, b in zip(x, s)) == int(r.deviation_exact)
            assert abs(r.explained / (e[c] / e.sum()) - 1) < 1e-9
            want = float((np.array(x) - np.array(s) / n) @ w[:, c] / math.sqrt(e[c]))
            sign.setdefault(c, math.copysign(1, r.whitened * want))
            assert abs(r.whitened - sign[c] * want) < 1e-9
    assert len(by[7, 1]) == 2


def test_populations_and_degenerate_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [5.0]), (4, [5.0]), (5, [1.0, 2.0, 3.0]), (6, [1e300, -1e300]), (7, [])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in got} == {1, 2, 6}  # the others have no variance
    assert {r.n for r in got} == {3} and all(r.deviation == (1 << 63) - 1 and int(r.deviation_exact) > r.deviation for r in got)
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []


def test_one_vector_for_most_of_the_rows(spark):
    rows = [(i, [1.0, 0.0]) for i in range(900)] + [(1000 + i, [float(i % 7), float(i % 3)]) for i in range(100)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), components=1).collect()
    assert len(got) == 1000 and {r.n for r in got} == {len({tuple(x) for _, x in rows})}
