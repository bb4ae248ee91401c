"""Registered queries on fixed graphs, their files and archives; the graphs of the benchmark scenarios among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph import api
from tidegraph.functions import formula
from tidegraph.functions.states import decode, random_world
from tidegraph.operators import archives, components, empirical, estimators, exact, flow
from tidegraph.plans import harness
from tidegraph.plans.catalogue import _BIT, _DOWN, _EXACT, _TRADE, _U, _UNRELIABLE, _WORLDS, EDGES, FORMULAS, ORACLE, QUERIES, SEED, P, _read, query, trade_graph, trade_graph_edges
from tidegraph.plans.lineage import cut, shared_path, spread
from tidegraph.sources import graphs
from tidegraph.sources.graphs import Graph


def _values(rows: list[tuple], names: str) -> str:
    text = lambda x: f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({names})"


#: Connected worlds by edges up.
GRID2 = [0, 0, 2, 4, 1]
COMPLETE7 = [0, 1, 25, 300, 2255, 11525, 40754, 100780, 189285, 283460, 346611, 349976, 293020, 203280, 116250, 54262, 20349, 5985, 1330, 210, 21, 1]
COMPLETE8 = [0, 1, 33, 531, 5490, 40215, 216335, 863175, 2597280, 6226055, 12351771, 20731599, 29817560, 37029795, 39882795, 37333453, 30381045, 21462210, 13120450, 6906480, 3108063, 1184038, 376740, 98280, 20475, 3276, 378, 28, 1]
DODECAHEDRON7 = [0, 0, 0, 0, 0, 0, 0, 0, 3, 77, 994, 8554, 54360, 266255, 1023472, 3112081, 7495879, 14194440, 20709120, 22523773, 17757703, 10558538, 4934166, 1856673, 566860, 139574, 27199, 4053, 435, 30, 1]


def _counts_sql(counts: list[int]) -> str:
    return f"SELECT CAST(k AS INTEGER) AS n_edges, CAST(v AS BIGINT) AS n FROM {_values(list(enumerate(counts)), 'k, v')}"


def _by_states(spark: SparkSession, g: Graph) -> DataFrame:
    down = exact.merged_states(spark, g)
    every = spark.createDataFrame(list(enumerate(exact.binomials(len(g.edges)))), "n_edges int, total long")
    return every.join(down, "n_edges", "left").select("n_edges", (F.col("total") - F.coalesce("n", F.lit(0))).alias("n"))


@query(_counts_sql(GRID2))
def grid2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.enumerate_counts(spark, graphs.grid(2, (0, 3)))


@query(_counts_sql(COMPLETE7))
def k7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.enumerate_counts(spark, graphs.complete(7, 2))


@query(_counts_sql(COMPLETE8))
def k8_dp_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_states(spark, graphs.complete(8, 2))


@query(_counts_sql(DODECAHEDRON7))
def dodecahedron7_dp_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_states(spark, graphs.dodecahedron((0, 3, 6, 9, 12, 15, 19)))


#: Runs of each method: sample size, replicates, and how far their mean may be from the truth, as a share of it.
RUNS = {
    "importance": (100, 100, 0.01), "wor": (10, 100, 0.01), "wor_merge": (10, 100, 0.01), "fearnhead": (10, 100, 0.01), "wor_variance": (10, 100, 0.02), "wor_merge_variance": (10, 100, 0.01),
    "residual": (50, 100, 0.02), "turnip": (100, 100, 0.05), "conditional_turnip": (100, 100, 0.05),
}


def _near(rows: DataFrame, truth: DataFrame, share: float, digits: int = 9) -> DataFrame:
    """(n, unreliability, within): how many estimates, the exact value of one row, and whether their mean is within a share of it that is fixed beforehand."""
    stats = rows.agg(F.count("*").alias("n"), F.avg("estimate").alias("mean"))
    both = stats.crossJoin(F.broadcast(truth.toDF("truth")))  # a row each
    return both.select("n", F.round("truth", digits).alias("unreliability"), (F.abs(F.col("mean") / F.col("truth") - 1) <= share).alias("within"))


def _trade_runs(method: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = trade_graph(spark, sf_dir)[0]
        n, count, share = RUNS[method]
        truth = exact.polynomial(exact.enumerate_counts(spark, g), EDGES, P)
        return _near(estimators.replicates(spark, g, P, method, n, SEED, count), truth, share)

    return run


for _name, (_, _count, _) in RUNS.items():
    QUERIES[f"{_name}_replicates"] = _trade_runs(_name)
    ORACLE[f"{_name}_replicates"] = f"{_WORLDS}{_DOWN} SELECT CAST({_count} AS BIGINT) AS n, round({_UNRELIABLE}, 9) AS unreliability, true AS within FROM down"


#: Graphs of the benchmark scenarios, each with a probability and its exact unreliability.
SCENARIOS = {
    "dodecahedron": (graphs.dodecahedron, 0.9999, 2.0006001801e-12),
    "dodecahedra_in_series": (graphs.dodecahedra_in_series, 0.99, 2.0617442347e-04),
    "dodecahedra_in_parallel": (graphs.dodecahedra_in_parallel, 0.99, 8.2487112217e-12),
    "grid9": (lambda: graphs.grid(9, (0, 80)), 0.9999, 2.0004000300e-08),
    "grid9_hubs": (lambda: graphs.grid_with_hubs(9), 0.99, 1.1549057422e-17),
}


@query(f"SELECT graph, method, CAST(24 AS BIGINT) AS n, true AS within FROM {_values([(g,) for g in SCENARIOS], 'graph')}, (VALUES ('wor_merge'), ('fearnhead')) AS m(method)")
def scenario_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare failures of all benchmark graphs, up to 162 edges, against the exact values: means within a quarter of them.

    Nearly all of so rare an estimate comes from the minimum cuts, which every
    replicate holds; the rest is a tail that few replicates see.
    """
    out = None
    for name, (make, p, true) in SCENARIOS.items():
        truth = spark.createDataFrame([(true,)], "truth double")
        for method in ("wor_merge", "fearnhead"):
            row = _near(estimators.replicates(spark, make(), p, method, 20, SEED, 24), truth, 0.25).select(F.lit(name).alias("graph"), F.lit(method).alias("method"), "n", "within")
            out = row if out is None else out.unionByName(row)
    return out


@query("SELECT CAST(400000 AS BIGINT) AS n, true AS within")
def grid9_crude_mc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """144 edges, more than a mask holds."""
    row = api.crude_mc(spark, graphs.grid(9), "0.99", 400_000, SEED, (0, 80))
    true = 2.0403039808e-04
    return row.select("n", (F.abs(F.col("estimate") - true) < 4 * F.sqrt(F.lit(true) / F.col("n"))).alias("within"))


_CONTINUED = f"{_WORLDS}{_DOWN} SELECT CAST(60 AS BIGINT) AS n, round({_UNRELIABLE}, 9) AS unreliability, true AS within FROM down WHERE (id & 1) = 0"


@query(_CONTINUED)
def continued_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles that go on from the state with edge 0 down, against that state's exact share."""
    g = trade_graph(spark, sf_dir)[0]
    worlds = exact.with_connected(exact.all_worlds(spark, EDGES).where("world % 2 = 0"), g).where("not connected")
    up = F.bit_count("world")
    truth = worlds.agg(F.sum(F.pow(F.lit(P), up) * F.pow(F.lit(1 - P), EDGES - up)))
    return _near(estimators.replicates(spark, g, P, "continued_importance", 100, SEED, 60), truth, 0.01)


@query(f"SELECT graph, CAST(mincut AS BIGINT) AS mincut FROM {_values([('grid9', 2), ('grid9_hubs', 9), ('series', 2), ('parallel', 6), ('dodecahedron', 3), ('grid9 whole', 2), ('doubled', 6)], 'graph, mincut')}")
def large_mincuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts of graphs with up to 162 edges; the last with room for two on every edge."""
    out = None
    for name, g, room in (("grid9", graphs.grid(9, (0, 80)), None), ("grid9_hubs", graphs.grid_with_hubs(9), None), ("series", graphs.dodecahedra_in_series(), None), ("parallel", graphs.dodecahedra_in_parallel(), None), ("dodecahedron", graphs.dodecahedron((0, 7, 19)), None), ("grid9 whole", graphs.grid(9), None), ("doubled", graphs.dodecahedron(), [2] * 30)):
        row = flow.mincut(spark, g, room).select(F.lit(name).alias("graph"), "mincut")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"{_TRADE}, s AS (SELECT count(*) AS m FROM edge), cuts AS (SELECT range AS id FROM range(1, CAST(pow(2, (SELECT count(*) FROM names)) AS BIGINT) - 1)), c AS (SELECT id, count(*) FILTER (WHERE ((id >> a) & 1) <> ((id >> b) & 1)) AS n FROM cuts, edge GROUP BY id) SELECT i AS v, CAST(CASE WHEN i = s THEN least WHEN i = t THEN -least ELSE 0 END AS BIGINT) AS net FROM names, terminal, (SELECT min(n) AS least FROM c, terminal WHERE ((id >> s) & 1) <> ((id >> t) & 1))")
def flow_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(v, net): what a maximum flow brings out of each vertex; arcs against the flow are those with it turned around."""
    g = trade_graph(spark, sf_dir)[0]
    arcs = flow.flow_arcs(spark, g, *g.terminals)
    out = flow.with_flow(arcs).select(F.col("src").alias("v"), F.col("flow").alias("n"))
    back = flow.against_flow(arcs).select(F.col("src").alias("v"), F.lit(-1).alias("n"))
    return g.vertex_table(spark).select("v").join(out.unionByName(back), "v", "left").groupBy("v").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("net"))


@query(f"WITH RECURSIVE k AS (SELECT range AS id FROM range(8)) SELECT CAST(fn AS INTEGER) AS fn, CAST(min(value) AS BIGINT) AS low, CAST(max(value) AS BIGINT) AS high FROM ({' UNION ALL '.join(f'SELECT {k} AS fn, {f.sql(_BIT)} AS value FROM k' for k, f in enumerate(formula.parse(FORMULAS, EDGES)))}) GROUP BY 1")
def function_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.function_range(spark, formula.source(EDGES, function=FORMULAS))


@query(f"{_WORLDS}{_DOWN} SELECT CAST(bit_count(id) AS INTEGER) AS n_edges, CAST({formula.parse('e0*e1+e2', EDGES)[0].sql(_BIT)} AS BIGINT) AS value, CAST(count(*) AS BIGINT) AS n FROM down GROUP BY 1, 2")
def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An enumeration written as text with its head, and read strictly."""
    g, path = trade_graph(spark, sf_dir)[0], shared_path(spark, "report")
    counts = exact.function_counts(exact.all_worlds(spark, EDGES), g, formula.source(EDGES, function="e0*e1+e2"))
    exact.report(counts, g, ["e0*e1+e2"]).orderBy("line").select("value").write.text(path)
    return exact.read_report(spark.read.text(path))


@query(f"{_EXACT.replace('AS estimate', 'AS unreliability')}")
def public_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions that users call, with the graph as a list of edges and fifty digits."""
    g = trade_graph(spark, sf_dir)[0]
    value = api.exhaustive_probability(api.exhaustive_search(spark, list(g.edges), g.terminals), "0.9")
    return spark.createDataFrame([(round(float(value), 9),)], "unreliability double")


@query(f"SELECT name, CAST(n AS BIGINT) AS n FROM {_values([(m, 3) for m in ('fearnhead', 'importance', 'residual', 'wor', 'wor_merge', 'wor_merge_variance', 'wor_variance')], 'name, n')}")
def public_estimators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every estimator by its public name on a matrix, three replicates each, all of them between 0 and 1."""
    matrix = [[0, 1, 1, 0], [1, 0, 1, 1], [1, 1, 0, 1], [0, 1, 1, 0]]
    calls = {"importance": api.approximate_zero_variance, "wor": api.approximate_zero_variance_wor, "wor_merge": api.approximate_zero_variance_wor_merge, "fearnhead": api.approximate_zero_variance_fearnhead, "wor_variance": api.approximate_zero_variance_wor_with_variance, "wor_merge_variance": api.approximate_zero_variance_wor_merge_with_variance, "residual": api.residual_resampling}
    out = None
    for name, call in calls.items():
        row = call(spark, matrix, 0.9, 4, SEED, (0, 3), replicates=3).agg(F.count_if(F.col("estimate").between(1e-6, 1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"SELECT form, CAST(vertices AS INTEGER) AS vertices, CAST(n_edges AS INTEGER) AS n_edges, same FROM {_values([('adjacency', 9, 12, True), ('edges', 9, 12, True), ('file', 9, 12, True), ('hubs', 83, 162, True), ('neighbours', 9, 12, True), ('parallel', 62, 102, True), ('series', 60, 94, True), ('torus', 0, 0, True)], 'form, vertices, n_edges, same')}")
def graph_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lattice in every accepted form and through a graph file, the composed graphs, and a form that is refused."""
    g = graphs.grid(3)
    pairs = sorted((min(e), max(e)) for e in g.edges)
    matrix = [[int((min(a, b), max(a, b)) in pairs) for b in range(9)] for a in range(9)]
    near = {f"v{a}": [b + 1 for b in range(9) if matrix[a][b]] for a in range(9)}
    path = shared_path(spark, "grid")
    graphs.grid_graphml(spark, 3).coalesce(1).sortWithinPartitions("line").select("value").write.text(path)
    forms = {"adjacency": graphs.convert(matrix), "neighbours": graphs.convert(near), "edges": graphs.convert(list(g.edges)), "file": graphs.read_graphml(spark, path)}
    rows = [(k, x.vertices, len(x.edges), sorted((min(e), max(e)) for e in x.edges) == pairs) for k, x in forms.items()]
    rows += [(k, x.vertices, len(x.edges), len(x.terminals) == 2) for k, x in (("series", graphs.dodecahedra_in_series()), ("parallel", graphs.dodecahedra_in_parallel()), ("hubs", graphs.grid_with_hubs(9)))]
    try:
        graphs.torus(3)
    except NotImplementedError:
        rows.append(("torus", 0, 0, True))
    return spark.createDataFrame(rows, "form string, vertices int, n_edges int, same boolean")


@query("WITH o AS (SELECT CAST(count(*) AS BIGINT) AS n FROM orders) SELECT 'context' AS kind, CAST(16 AS BIGINT) AS n FROM o UNION ALL SELECT 'observation', n FROM o UNION ALL SELECT 'collection', n FROM o UNION ALL SELECT 'tree', 3 * n FROM o UNION ALL SELECT 'empirical', n FROM o")
def archive_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind saved, recognised and read back with its checks; n counts edges for the context, else rows."""
    g = trade_graph(spark, sf_dir)[0]
    top = shared_path(spark, "archives")
    worlds = spread(_read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("obs_id")), "obs_id", EDGES).withColumn("world", random_world(EDGES, 0.7, SEED, F.col("obs_id")))
    states = cut(worlds.select("obs_id", decode(F.col("world"), EDGES).alias("state")))
    far = [[float(a != b) * 2 for b in range(EDGES)] for a in range(EDGES)]
    archives.save_context(spark, g, P, f"{top}/context")
    archives.save(states, f"{top}/observation", "observation")
    archives.save(empirical.to_collection(states).withColumn("radius", F.lit(1.0)), f"{top}/collection", "collection")
    archives.save(empirical.level_tree(states, far, [2.0, 1.0, 0.0]), f"{top}/tree", "tree")
    archives.save(worlds.withColumn("weight", F.lit(1.0)), f"{top}/empirical", "empirical")
    out = None
    for name in archives.KINDS:
        kind = archives.kind_of(spark, f"{top}/{name}")
        if kind == "context":
            back, p = archives.load_context(spark, f"{top}/{name}")
            n = spark.createDataFrame([(len(back.edges) if back == g and p == P else -1,)], "n long")
        else:
            n = archives.load(spark, f"{top}/{name}").agg(F.count("*").alias("n"))
        row = n.select(F.lit(kind).alias("kind"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("WITH o AS (SELECT CAST(count(*) AS BIGINT) AS n FROM orders) SELECT CAST(k.range AS INTEGER) AS level, n AS size, CAST(k.range * n AS BIGINT) AS first FROM o, range(3) AS k")
def tree_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = [[float(a != b) for b in range(4)] for a in range(4)]
    orders = spread(_read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("obs_id")), "obs_id", 4)
    states = orders.select("obs_id", decode(random_world(4, 0.5, SEED, F.col("obs_id")), 4).alias("state"))
    return archives.level_offsets(empirical.level_tree(states, far, [2.0, 1.0, 0.0]))


@query("SELECT CAST(0 AS INTEGER) AS level, CAST(o_custkey AS BIGINT) AS idx, CAST(arg_min(o_orderkey, {'p': o_totalprice, 'k': o_orderkey}) AS BIGINT) AS child FROM orders GROUP BY o_custkey")
def leftmost_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers over their orders as a tree of two levels, placed by price."""
    orders = _read(spark, sf_dir, "orders").select(F.lit(1).alias("level"), F.col("o_orderkey").alias("idx"), F.col("o_custkey").alias("parent_idx"), F.col("o_totalprice").alias("x"))
    return archives.leftmost_child(orders, F.col("x"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS obs_id, o_orderstatus FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderkey >= 100)")
def indexed_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("obs_id"), "o_orderstatus")
    number = orders.where("obs_id >= 100").agg(F.min("obs_id")).first()[0]
    return archives.row(orders, number)


@query(f"{_TRADE}, walk(v, u) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT w.v, CASE WHEN top.a = w.u THEN top.b ELSE top.a END FROM walk AS w JOIN top ON (top.a = w.u OR top.b = w.u) AND top.e % 3 = 0), label AS (SELECT v, min(u) AS component FROM walk GROUP BY v) SELECT CAST(count(DISTINCT component) AS BIGINT) AS n FROM label WHERE v IN (SELECT a FROM top UNION SELECT b FROM top)")
def fixed_up_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over the edges that are fixed up, every third, and how many of them hold a nation of the network."""
    edges = trade_graph_edges(spark, sf_dir).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.when(F.col("edge_id") % 3 == 0, 1).otherwise(4).alias("state"))
    labels = components.fixed_up_labels(_read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("v")), edges)
    return components.terminal_components(labels, trade_graph(spark, sf_dir)[1])


@query("WITH p AS (SELECT c_custkey, CAST(c_custkey % 37 AS DOUBLE) * 9 AS x, CAST(c_custkey % 41 AS DOUBLE) * 8 AS y FROM customer), g AS (SELECT range AS v, 100.0 * (range % 4) AS vx, 100.0 * (range // 4) AS vy FROM range(16)) SELECT c_custkey, CAST(arg_min(v, {'d': pow(x - vx, 2) + pow(y - vy, 2), 'v': v}) AS INTEGER) AS v FROM p, g GROUP BY c_custkey")
def nearest_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    points = _read(spark, sf_dir, "customer").select("c_custkey", ((k % 37).cast("double") * 9).alias("x"), ((k % 41).cast("double") * 8).alias("y"))
    return components.nearest_vertex(points, graphs.grid(4)).select("c_custkey", "v")


@query(f"WITH s AS (SELECT o_custkey % 60 AS scenario_id, CAST(count(*) AS BIGINT) AS n, avg(o_totalprice) AS mean, sqrt(var_samp(o_totalprice) / count(*)) / avg(o_totalprice) AS e FROM orders GROUP BY 1), g AS (SELECT CAST(row_number() OVER (ORDER BY method, n, graph, probability) - 1 AS INTEGER) AS scenario_id, method, graph, probability FROM {_values([('importance',), ('wor',), ('wor_merge',), ('fearnhead',)], 'method')}, (VALUES (10), (20), (100)) AS b(n), (VALUES ('dodecahedron'), ('grid9')) AS c(graph), (VALUES (CAST(0.99 AS DOUBLE)), (CAST(0.9999 AS DOUBLE))) AS d(probability)) SELECT g.scenario_id, CASE method WHEN 'wor' THEN 'WOR' ELSE 'IS' END AS method, n, round(mean, 4) AS mean, round(e, 6) AS mean_re FROM g LEFT JOIN s USING (scenario_id) WHERE method IN ('wor', 'importance') AND graph = 'grid9' AND probability = 0.99")
def plotted_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios beside their statistics, two methods on one graph at one probability, under their labels."""
    results = _read(spark, sf_dir, "orders").select((F.col("o_custkey") % 60).cast("int").alias("scenario_id"), F.col("o_totalprice").alias("estimate"))
    both = harness.with_statistics(QUERIES["scenario_grid"](spark, sf_dir), harness.statistics(results))
    rows = harness.plotted(both, {"wor": "WOR", "importance": "IS"}, graph="grid9", probability=0.99)
    return rows.select("scenario_id", "method", "n", F.round("mean", 4).alias("mean"), F.round("mean_re", 6).alias("mean_re"))


@query("WITH s AS (SELECT avg(o_totalprice) AS mean, sqrt(var_samp(o_totalprice) / count(*)) / avg(o_totalprice) AS e FROM orders GROUP BY o_orderstatus) SELECT CAST(count(*) AS BIGINT) AS n, round(sum(mean), 3) AS estimates, round(sum(e), 6) AS errors FROM s")
def estimate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics printed as lines with their relative errors, written as text, and the numbers read back."""
    stats = harness.statistics(_read(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice")
    path = shared_path(spark, "lines")
    harness.estimate_lines(stats).select("value").write.text(path)
    number = lambda k: F.regexp_extract("value", r"^Estimate (\S+), relative error (\S+)$", k).cast("double")
    return spark.read.text(path).agg(F.count("*").alias("n"), F.round(F.sum(number(1)), 3).alias("estimates"), F.round(F.sum(number(2)), 6).alias("errors"))


@query("SELECT CAST(1 AS BIGINT) AS roots, true AS sums, true AS graphml")
def variance_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's sampling graph: its root holds the estimate and variance of the run, and the file has a line for each node and edge."""
    g = trade_graph(spark, sf_dir)[0]
    nodes, edges = estimators.variance_graph(g, P, 10, SEED)
    run = estimators.replicates(spark, g, P, "wor_merge_variance", 10, SEED, 1)
    table = spark.createDataFrame(nodes, "stage int, unit int, inclusion double, z double, v double")
    lines = estimators.variance_graphml(spark, g, P, 10, SEED).agg(F.count_if(F.col("value").startswith("<node")).alias("nodes"), F.count_if(F.col("value").startswith("<edge ")).alias("edges"))
    roots = table.where("stage = 0").agg(F.count("*").alias("roots"), F.max("z").alias("z"), F.max("v").alias("v"))
    same = (F.abs(F.col("z") / F.col("estimate") - 1) < 1e-9) & (F.abs(F.col("v") - F.col("second")) <= 1e-9 * F.abs("second"))
    return roots.crossJoin(run).crossJoin(lines).select("roots", same.alias("sums"), ((F.col("nodes") == len(nodes)) & (F.col("edges") == len(edges))).alias("graphml"))  # a row each


_GRID3 = graphs.grid(3).edges
_NEAR = {e: sum(1 << k for k, x in enumerate(_GRID3) if set(x) & set(_GRID3[e])) for e in range(len(_GRID3))}


@query(
    f"""WITH RECURSIVE near(e, m) AS (VALUES {', '.join(f'({e}, {m})' for e, m in _NEAR.items())}), drawn AS (
  SELECT o_orderkey, CAST(sum(CASE WHEN {_U(SEED, 'o_orderkey', 'e')} < 0.6 THEN CAST(1 AS BIGINT) << e ELSE 0 END) AS BIGINT) AS id FROM orders, near GROUP BY o_orderkey
), walk(o_orderkey, id, e, c) AS (
  SELECT o_orderkey, id, 0, CAST(0 AS BIGINT) FROM drawn
  UNION ALL SELECT o_orderkey, id, walk.e + 1, c + CASE WHEN ((id >> walk.e) & 1) = 0 AND (c & m) = 0 THEN CAST(1 AS BIGINT) << walk.e ELSE 0 END FROM walk JOIN near ON near.e = walk.e
), done AS (SELECT * FROM walk WHERE e = {len(_GRID3)})
SELECT CAST(o_orderkey AS BIGINT) AS obs_id, {' || '.join(f"CASE WHEN ((id >> {e}) & 1) = 1 THEN '1' WHEN ((c >> {e}) & 1) = 1 THEN '2' ELSE '8' END" for e in range(len(_GRID3)))} AS state FROM done"""
)
def thinning_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that are down, covered by balls of radius 1; the state codes of each order's edges in one text."""
    g = graphs.grid(3, (0, 8))
    m = len(g.edges)
    far = [[0.0] * m for _ in range(m)]
    for r in components.edge_distances(spark, g.edge_table(spark), g.vertex_table(spark).select("v")).collect():  # 12 edges
        far[r.e1][r.e2] = far[r.e2][r.e1] = float(r.d)
    orders = spread(_read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("obs_id")), "obs_id", m)
    sample = orders.select("obs_id", decode(random_world(m, 0.6, SEED, F.col("obs_id")), m).alias("state"))
    return empirical.thin(sample, far, 1.0).select("obs_id", F.array_join(F.transform("state", lambda s: s.cast("string")), "").alias("state"))
