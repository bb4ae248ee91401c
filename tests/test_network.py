import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.functions import formula, states
from tidegraph.operators import components, empirical, estimators, exact, mincut, sampling
from tidegraph.plans import harness
from tidegraph.plans.catalogue import GOLDEN
from tidegraph.sources import graphs
from tidegraph.streaming import replicates as streaming


def counts(df):
    return [r.n for r in df.orderBy("n_edges").collect()]


def unreliability(g, p):
    total = 0.0
    for up in itertools.product((0, 1), repeat=len(g.edges)):
        label = list(range(g.vertices))
        for (a, b), u in zip(g.edges, up):
            if u:
                x, y = label[a], label[b]
                label = [x if v == y else v for v in label]
        if len({label[t] for t in g.terminals}) > 1:
            total += p ** sum(up) * (1 - p) ** (len(up) - sum(up))
    return total


BRIDGE = graphs.from_edges([(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)], (0, 3))


@pytest.mark.parametrize("name,g", [("grid3_counts", graphs.grid(3, (0, 8))), ("k6_counts", graphs.complete(6, 2))])
def test_golden_counts(spark, name, g):
    want = [int(x) for x in GOLDEN[name]]
    assert counts(exact.enumerate_counts(spark, g)) == want
    m = len(g.edges)
    down = counts(exact.enumerate_counts(spark, g, disconnected=True))
    assert [a + b for a, b in zip(want, down)] == [math.comb(m, k) for k in range(m + 1)]


def test_expression_agrees_with_enumeration(spark):
    g = graphs.grid(3, (0, 2, 8))
    want = {r.n_edges: r.n for r in exact.enumerate_counts(spark, g).where("n > 0").collect()}
    got = {r.n_edges: r.n for r in exact.counts_by_expression(exact.all_worlds(spark, 12), g).collect()}
    assert got == want


def test_polynomial_and_merged_states(spark):
    g = graphs.grid(3, (0, 8))
    value = exact.polynomial(exact.enumerate_counts(spark, g), 12, 0.9).first()[0]
    assert value == pytest.approx(0.027497828593, abs=1e-12)
    assert exact.merged_states(spark, g, 0.9).first()[0] == pytest.approx(value, rel=1e-12)
    down = {r.n_edges: r.n for r in exact.merged_states(spark, g).collect()}
    want = [int(x) for x in GOLDEN["grid3_counts"]]
    assert all(down.get(k, 0) == math.comb(12, k) - want[k] for k in range(13))
    with pytest.raises(ValueError):
        exact.enumerate_counts(spark, graphs.complete(10, 2))
    with pytest.raises(ValueError):
        exact.polynomial(exact.enumerate_counts(spark, g), 12, 1.5)


def test_merged_states_with_three_terminals_and_loops(spark):
    g = graphs.from_edges([(0, 1), (0, 1), (1, 1), (1, 2), (2, 3), (0, 3), (3, 4)], (0, 2, 4))
    assert exact.merged_states(spark, g, 0.8).first()[0] == pytest.approx(unreliability(g, 0.8), rel=1e-12)


def test_formulas(spark):
    fs = formula.parse("e0+e1*2, -(e2-3)/2, (e0-e1)/2", 3)
    world = spark.range(8).select(F.col("id").alias("w"))
    got = world.select("w", *(f.column(lambda e: states.is_up(F.col("w"), e)).alias(f"f{k}") for k, f in enumerate(fs))).collect()
    for r in got:
        e = [(r.w >> k) & 1 for k in range(3)]
        assert (r.f0, r.f1, r.f2) == (e[0] + 2 * e[1], int(-(e[2] - 3) / 2), int((e[0] - e[1]) / 2))
    assert fs[0].edges == [0, 1]
    for bad in ("e3", "", "e0 +", "(e0", "e0 $ e1", "e0 e1", ","):
        with pytest.raises(formula.FormulaError):
            formula.parse(bad, 3)


def test_states_round_trip(spark):
    df = spark.range(16).select(F.col("id").alias("w")).select("w", states.encode(states.decode(F.col("w"), 4)).alias("back"))
    assert all(r.w == r.back for r in df.collect())
    u = spark.range(2000).select(states.uniform(3, F.col("id")).alias("u")).agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(u[0] - 0.5) < 0.03 and 0 < u[1] and u[2] < 1


def test_graph_forms():
    ring = [[0, 1, 1], [1, 0, 1], [1, 1, 0]]
    assert len(graphs.from_adjacency(ring).edges) == 3 and len(graphs.from_adjacency(ring, dedupe=False).edges) == 6
    assert graphs.from_neighbours(["a", "b"], [[2], [1]]).edges == ((0, 1),)
    assert graphs.convert({"a": [2], "b": [1]}).vertices == 2 and graphs.convert(ring).vertices == 3
    assert len(graphs.dodecahedra_in_series().edges) == 94 and len(graphs.dodecahedra_in_parallel().edges) == 102
    assert len(graphs.grid(9).edges) == 144 and len(graphs.grid_with_hubs(9).edges) == 162
    assert graphs.complete(4, 2).terminals == (1, 0)
    for bad in (lambda: graphs.from_neighbours(["a", "a"], [[], []]), lambda: graphs.grid(2, (0,)), lambda: graphs.grid(2, (0, 9)), lambda: graphs.from_edges([(0, 1)], directed=True), lambda: graphs.from_adjacency([[0, 1]]), lambda: graphs.probability("1.2"), lambda: graphs.sample_size(0)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(NotImplementedError):
        graphs.torus(3)


def test_graph_file_round_trip(spark, tmp_path):
    path = tmp_path / "g.graphml"
    path.write_text("\n".join(r.value for r in graphs.grid_graphml(spark, 3).collect()))
    g = graphs.read_graphml(spark, str(path), (0, 8))
    assert g == graphs.grid(3, (0, 8)) and g.positions == graphs.grid(3).positions
    path.write_text(path.read_text().replace('"order">3<', '"order">2<'))
    with pytest.raises(ValueError):
        graphs.read_graphml(spark, str(path))


def test_components_and_distances(spark):
    g = graphs.from_edges([(0, 1), (1, 2), (3, 4), (3, 4), (5, 5)], vertices=7)
    v, e = g.vertex_table(spark).select("v"), g.edge_table(spark)
    labels = components.component_labels(v, e)
    assert {r.v: r.component for r in labels.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6}
    reduced = {(r.c1, r.c2): (r.n_parallel, r.inop) for r in components.reduced_graph(labels, e, 0.9).collect()}
    assert reduced[3, 3] == (2, pytest.approx(0.01)) and reduced[5, 5][0] == 1
    far = {(r.e1, r.e2): r.d for r in components.edge_distances(spark, e, v).collect()}
    assert far[0, 0] == 0 and far[0, 1] == 1 and (0, 2) not in far
    assert g.arcs(spark).count() == 10
    assert components.series_parallel([(0, 1, 0.1), (1, 2, 0.1), (0, 2, 0.5), (2, 3, 0.2)], {0, 2}) == [(0, 2, pytest.approx(0.095))]


def test_minimum_cuts(spark):
    r = random.Random(2)
    for _ in range(3):
        n = 6
        g = graphs.from_edges([(r.randrange(n), r.randrange(n)) for _ in range(10)], (0, 3, 5), n)
        best = min(sum(((s >> a) & 1) != ((s >> b) & 1) for a, b in g.edges) for s in range(1, 1 << n) if 0 < sum((s >> t) & 1 for t in g.terminals) < 3)
        assert mincut.terminal_mincut(spark, g).first()[0] == best
        assert mincut.split_size(range(n), g.edges, g.terminals) == best
    assert mincut.global_mincut(spark, BRIDGE).first()[0] == 2
    assert sorted(r.edge_id for r in mincut.mincut_edges(spark, BRIDGE).collect()) == [0, 1, 3, 4]


@pytest.mark.parametrize("method", ["wor", "wor_merge", "fearnhead", "wor_variance", "wor_merge_variance"])
def test_uncapped_is_exact(spark, method):
    row = estimators.replicates(spark, BRIDGE, 0.7, method, 1 << 30).first()
    assert row.estimate == pytest.approx(unreliability(BRIDGE, 0.7), rel=1e-12)
    if "variance" in method:
        assert row.second == 0


@pytest.mark.parametrize("method,n,count", [("importance", 50, 60), ("wor", 4, 300), ("wor_merge", 3, 300), ("fearnhead", 4, 300), ("wor_variance", 3, 600), ("wor_merge_variance", 2, 600), ("residual", 100, 100), ("turnip", 40, 50)])
def test_estimators_are_unbiased(spark, method, n, count):
    rows = estimators.replicates(spark, BRIDGE, 0.5, method, n, 11, count).collect()
    x = np.array([r.estimate for r in rows])
    assert abs(x.mean() - unreliability(BRIDGE, 0.5)) < 4 * x.std() / math.sqrt(count) + 1e-12
    if "variance" in method:
        v = np.array([r.second for r in rows])
        assert abs(v.mean() - x.var()) < 4 * v.std() / math.sqrt(count) + 4 * ((x - x.mean()) ** 2).std() / math.sqrt(count) + 1e-12


def test_replicates_do_not_depend_on_partitions(spark):
    one = estimators.replicates(spark, BRIDGE, 0.9, "wor", 3, 5, 8)
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, one.repartition(3).collect()), key=str)
    with pytest.raises(ValueError):
        estimators.replicates(spark, BRIDGE, 0.9, "other", 3)


def test_hypoexponential_tail():
    assert estimators.hypoexponential_tail(np.array([2.0])) == pytest.approx(math.exp(-2))
    a, b = 1.0, 3.0
    assert estimators.hypoexponential_tail(np.array([a, b])) == pytest.approx((b * math.exp(-a) - a * math.exp(-b)) / (b - a))
    many = estimators.hypoexponential_tail(np.arange(60, 0, -1) * 0.1)
    assert 0 < many < 1


def test_conditional_permutation():
    net = estimators.Network(BRIDGE, 0.7)
    at_least_2 = 1 - sum(math.comb(5, k) * 0.3**k * 0.7 ** (5 - k) for k in range(2))
    x = [estimators.conditional_permutation(net, 2, np.random.default_rng(k)) for k in range(1500)]
    assert np.mean(x) * at_least_2 == pytest.approx(unreliability(BRIDGE, 0.7), rel=0.06)


def test_designs():
    rng = np.random.default_rng(1)
    size = np.array([1.0, 2, 3, 4, 50])
    pi = sampling.inclusion(size, 3)
    assert pi.sum() == pytest.approx(3) and pi[4] == 1
    for draw in (lambda: sampling.sampford(pi, rng), lambda: sampling.systematic(pi, rng)):
        hits = np.zeros(5)
        for _ in range(3000):
            s = draw()
            assert len(s) == 3
            hits[s] += 1
        assert np.allclose(hits / 3000, pi, atol=0.05)
    w = np.array([0.5, 1.0, 2.0, 1.5])
    hits = np.zeros(4)
    for _ in range(3000):
        s, pi, joint = sampling.conditional_poisson(w, 2, rng)
        hits[s] += 1
    assert pi.sum() == pytest.approx(2) and np.allclose(hits / 3000, pi, atol=0.05)
    assert joint[0, 1] == pytest.approx(w[s[0]] * w[s[1]] / sum(a * b for a, b in itertools.combinations(w, 2)))
    s, c = sampling.threshold(size, 3, rng)
    assert np.minimum(1, c * size).sum() == pytest.approx(3) and 4 in s
    assert np.allclose(np.bincount(sampling.alias(np.array([1.0, 3.0]), 4000, rng)) / 4000, [0.25, 0.75], atol=0.05)


def test_table_designs(spark):
    units = spark.createDataFrame([(k, float(k + 1)) for k in range(40)] + [(99, 1000.0)], "u long, size double")
    pi = sampling.inclusion_table(units, "size", 10)
    assert pi.agg(F.sum("pi")).first()[0] == pytest.approx(10) and pi.where("u = 99").first().pi == 1
    got = sampling.pareto_sample(pi, "u", 10, 3)
    assert got.count() == 10 and got.where("u = 99").count() == 1
    c = sampling.threshold_scale(units, "size", 10)
    assert units.agg(F.sum(F.least(F.lit(1.0), c * F.col("size")))).first()[0] == pytest.approx(10)
    sample = sampling.threshold_sample(units, "u", "size", 10, 3)
    assert abs(sample.count() - 10) <= 1 and sample.where("u = 99").first().weight == 1000
    assert sampling.alias_draws(units, "u", "size", 50, 3).count() == 50


def test_empirical(spark, tmp_path):
    sample = spark.createDataFrame([(0, [4, 8, 8, 4], 1.0), (1, [8, 2, 8, 8], 3.0)], "obs_id long, state array<tinyint>, weight double")
    masks = sample.select(states.encode(F.col("state")).alias("world"), "weight")
    got = empirical.weighted_expectation(masks, formula.parse("e0+e3", 4), weight="weight").first()
    assert got.expectation == pytest.approx(0.5)
    line = [[abs(i - j) for j in range(4)] for i in range(4)]
    thin = {r.obs_id: r.state for r in empirical.thin(sample, line, 1.0).collect()}
    assert thin == {0: [1, 2, 8, 1], 1: [2, 2, 2, 8]} or thin[0] == [1, 2, 8, 1]
    assert empirical.to_collection(sample).where("obs_id = 0").first().state == [1, 2, 2, 1]
    assert empirical.level_tree(sample, line, [2.0, 1.0]).count() == 4
    assert empirical.levels(3) == [3, 2, 1, 0] and empirical.levels(10, 5, 3) == [10, 7.5, 5, 0]
    for bad in (lambda: empirical.levels(1.5), lambda: empirical.levels(3, None, 1), lambda: empirical.levels(math.nan)):
        with pytest.raises(ValueError):
            bad()
    empirical.save(sample, str(tmp_path / "s"), "sample")
    assert empirical.load(spark, str(tmp_path / "s"), "sample").count() == 2
    with pytest.raises(ValueError):
        empirical.load(spark, str(tmp_path / "s"), "tree")


def test_harness(spark, tmp_path):
    grid = harness.scenario_grid(spark, ["a", "b"], [1, 2], ["g"], [0.5], 3)
    assert grid.count() == 4
    done = spark.createDataFrame([(0,), (0,), (0,), (1,)], "scenario_id int")
    assert {r.scenario_id: r.left for r in harness.unfinished(grid, done).collect()} == {1: 2, 2: 3, 3: 3}
    path = str(tmp_path / "runs")
    assert harness.resume(spark, path, 1, BRIDGE, 0.7, "wor", 3, 25, 10) == 3
    assert harness.resume(spark, path, 1, BRIDGE, 0.7, "wor", 3, 25, 10) == 0
    rows = spark.read.parquet(path)
    assert rows.count() == 25
    truth = spark.createDataFrame([(1, unreliability(BRIDGE, 0.7))], "scenario_id int, truth double")
    row = harness.statistics(rows, truth=truth).first()
    assert row.n == 25 and abs(row.bias) < 0.1 and row.mse >= row.var_samp
    assert harness.running(rows.withColumn("o", F.monotonically_increasing_id()), "scenario_id", "o", "estimate", 5).count() == 5
    assert harness.histogram(rows, "estimate", 0.0, 1.0, 10).agg(F.sum("n")).first()[0] == 25


def test_resuming_with_more_replicates(spark, tmp_path):
    path = str(tmp_path / "runs")
    run = lambda reps: harness.resume(spark, path, 1, BRIDGE, 0.7, "wor", 3, reps, 10)
    rows = lambda: {(r.batch, r.replicate): r.estimate for r in spark.read.parquet(path).collect()}
    assert run(15) == 2
    before = rows()
    assert run(5) == 0 and run(28) == 2  # the short batch and a new one
    after = rows()
    assert len(before) == 15 and len(after) == 28 and all(after[k] == x for k, x in before.items())


def test_report_round_trip(spark):
    fs = formula.parse("e0-e1", 5)
    rows = exact.function_counts(exact.all_worlds(spark, 5), BRIDGE, fs)
    lines = exact.report(rows, BRIDGE, ["e0-e1"])
    back = exact.read_report(lines.select("value"))
    with pytest.raises(Exception, match="not a line"):
        exact.read_report(lines.select(F.regexp_replace("value", "value 1:", "val 1:").alias("value"))).collect()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.select("n_edges", "value", "n").collect()))
    e = exact.function_expectation(rows, 5, 0.7).first().expectation
    assert e == pytest.approx(0, abs=1e-12)


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 0.5), (1, 1.5), (2, 3.0)], "scenario_id int, estimate double").write.parquet(src)
    stream = spark.readStream.schema("scenario_id int, estimate double").parquet(src)
    q = streaming.running_totals(stream).writeStream.outputMode("complete").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    got = {r.scenario_id: (r.mean, r.variance) for r in streaming.summary(spark.table("totals")).collect()}
    assert got == {1: (1.0, 0.5), 2: (3.0, None)}


def test_thinning_by_definition(spark):
    import random

    r = random.Random(3)
    m = 7
    far = [[abs(a - b) * 1.0 for b in range(m)] for a in range(m)]
    rows = [(k, [r.choice([1, 2, 4, 8]) for _ in range(m)]) for k in range(60)]
    got = {x.obs_id: x.state for x in empirical.thin(spark.createDataFrame(rows, "obs_id long, state array<tinyint>"), far, 2.0).collect()}
    for k, old in rows:
        new, covered = [1] * m, set()
        for e in range(m):
            if old[e] in (2, 8) and e not in covered:
                new[e] = 2
                for j in range(e + 1, m):
                    if old[j] in (2, 8) and j not in covered and far[e][j] <= 2:
                        covered.add(j)
                        new[j] = old[j] if old[j] == 2 else 8
        assert got[k] == new


def test_flows_and_large_cuts(spark):
    from tidegraph.operators import flow

    import random

    r = random.Random(1)
    for _ in range(20):
        edges = [(r.randrange(7), r.randrange(7)) for _ in range(14)]
        f = flow.arc_flows(edges, 0, 6)
        assert flow.value(edges, f, 0) == mincut.max_flow(edges, 0, 6) == -flow.value(edges, f, 6)
        assert all(flow.value(edges, f, v) == 0 for v in range(1, 6)) and max(map(abs, f)) <= 1
    assert flow.mincut(spark, graphs.grid(9)).first().mincut == 2


def test_archive_checks(spark, tmp_path):
    from tidegraph.operators import archives

    good = spark.createDataFrame([(0, 0, -1, [1]), (1, 0, 0, [2])], "level int, idx long, parent_idx long, state array<tinyint>")
    archives.save(good, str(tmp_path / "t"), "tree")
    assert archives.load(spark, str(tmp_path / "t")).count() == 2
    with pytest.raises(ValueError, match="expected context"):
        archives.load(spark, str(tmp_path / "t"), "context")
    with pytest.raises(ValueError, match="one level up"):
        archives.check_tree(good.withColumn("parent_idx", F.when(F.col("level") == 1, 5).otherwise(-1).cast("long")))
    with pytest.raises(ValueError, match="not at level 0"):
        archives.check_tree(good.withColumn("parent_idx", F.lit(-1).cast("long")))
    with pytest.raises(ValueError, match="differ in length"):
        archives.check_states(spark.createDataFrame([(0, [1]), (1, [1, 2])], "obs_id long, state array<tinyint>"))
    with pytest.raises(ValueError, match="need"):
        archives.save(good.drop("state"), str(tmp_path / "x"), "tree")
    g = graphs.grid(3, (0, 8))
    archives.save_context(spark, g, 0.9, str(tmp_path / "c"))
    back, p = archives.load_context(spark, str(tmp_path / "c"))
    assert (back, p, back.positions) == (g, 0.9, g.positions)
    broken = spark.read.parquet(str(tmp_path / "c")).where("part <> 'edge' or k > 0")
    archives.save(broken.drop("kind"), str(tmp_path / "d"), "context")
    with pytest.raises(ValueError, match="arcs"):
        archives.load_context(spark, str(tmp_path / "d"))


def test_public_functions(spark, tmp_path):
    from tidegraph import api

    ring = [(0, 1), (1, 2), (2, 3), (3, 0)]
    api.set_default_precision(30)
    for disconnected in (False, True):
        assert str(api.exhaustive_probability(api.exhaustive_search(spark, ring, (0, 2), disconnected), "0.9")) == "0.0361"
    row = api.crude_mc(spark, ring, 0.5, 5000, 1, (0, 2)).first()
    assert row.n == 5000 and row.estimate == pytest.approx(0.5625, abs=0.03)
    path = str(tmp_path / "g")
    api.approximate_zero_variance_wor_merge_with_variance(spark, ring, 0.9, 3, 1, (0, 2), graph_file=path)
    assert spark.read.text(path).where("value like '%edge source%'").count() > 0
    with pytest.raises(ValueError):
        api.residual_resampling(spark, ring, 0.9, 3, -1, (0, 2))
    with pytest.raises(ValueError, match="form"):
        graphs.convert([[0, 1], [1, 0]])
    assert len(graphs.convert([[0, 1], [1, 0]], form="matrix").edges) == 1
    f = tmp_path / "f.txt"
    f.write_text("e0+e1, e1*2")
    assert len(formula.source(4, function_file=str(f))) == 2
    with pytest.raises(formula.FormulaError):
        formula.source(4)
