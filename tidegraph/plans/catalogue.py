"""Registered queries over the star-schema tables, and DuckDB SQL for those that SQL can express.

The trade network joins customers' and suppliers' nations by line items; its
sixteen busiest pairs are the edges, its lowest and highest nation the terminals.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.formula import parse
from tidegraph.functions.states import decode, random_world, uniform
from tidegraph.operators import components, empirical, estimators, exact, mincut, sampling
from tidegraph.plans import harness
from tidegraph.plans.lineage import cut, shared_path
from tidegraph.sources import graphs
from tidegraph.sources.graphs import Graph

EDGES, P, SEED = 16, 0.9, 7
FORMULAS = "e0+e1+e2, e0*e1*e2, (e0-e1)/2"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, n): line items between two nations, each pair once.

    Line items are first counted by order and supplier's nation, so the widest
    join carries counts instead of rows.
    """
    supplier = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    per_order = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(supplier, "l_suppkey").groupBy("l_orderkey", "s_nationkey").agg(F.count("*").alias("n"))
    customer = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(customer, "o_custkey")
    rows = per_order.join(orders, "l_orderkey").where("c_nationkey <> s_nationkey")
    return rows.groupBy(F.least("c_nationkey", "s_nationkey").alias("a"), F.greatest("c_nationkey", "s_nationkey").alias("b")).agg(F.sum("n").alias("n"))


def _busiest(spark: SparkSession, sf_dir: str) -> list[tuple[int, int, int]]:
    """The busiest pairs (a, b, n); sixteen rows."""
    return [(r.a, r.b, r.n) for r in trade_pairs(spark, sf_dir).orderBy(F.desc("n"), "a", "b").limit(EDGES).collect()]


def trade_graph(spark: SparkSession, sf_dir: str) -> tuple[Graph, list[int]]:
    """The network with vertices numbered anew, and the nation of each."""
    rows = _busiest(spark, sf_dir)
    nations = sorted({v for a, b, _ in rows for v in (a, b)})
    at = {v: k for k, v in enumerate(nations)}
    return graphs.from_edges([(at[a], at[b]) for a, b, _ in rows], (0, len(nations) - 1), len(nations)), nations


_PAIRS = """pairs AS (
  SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b, CAST(count(*) AS BIGINT) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2
), top AS (
  SELECT a, b, n, CAST(k AS INTEGER) AS e FROM (SELECT a, b, n, row_number() OVER (ORDER BY n DESC, a, b) - 1 AS k FROM pairs) WHERE k < 16
), names AS (
  SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS i FROM (SELECT a AS v FROM top UNION SELECT b FROM top)
), edge AS (
  SELECT e, x.i AS a, y.i AS b FROM top JOIN names AS x ON a = x.v JOIN names AS y ON b = y.v
), terminal AS (SELECT min(i) AS s, max(i) AS t FROM names)"""
_REACH = """, worlds AS (SELECT range AS id FROM range(65536)
), reach(id, v) AS (
  SELECT id, s FROM worlds, terminal
  UNION SELECT r.id, CASE WHEN edge.a = r.v THEN edge.b ELSE edge.a END FROM reach AS r JOIN edge ON (edge.a = r.v OR edge.b = r.v) AND ((r.id >> edge.e) & 1) = 1
), ok AS (SELECT DISTINCT reach.id FROM reach, terminal WHERE v = t)"""
_TRADE, _WORLDS = f"WITH RECURSIVE {_PAIRS}", f"WITH RECURSIVE {_PAIRS}{_REACH}"
_BIT = lambda e: f"CAST((id >> {e}) & 1 AS BIGINT)"
_FUNCTIONS = " UNION ALL ".join(f"SELECT {k} AS fn, CAST(bit_count(id) AS INTEGER) AS n_edges, CAST({f.sql(_BIT)} AS BIGINT) AS value FROM down" for k, f in enumerate(parse(FORMULAS, EDGES)))
_DOWN = ", down AS (SELECT id FROM worlds WHERE id NOT IN (SELECT id FROM ok))"


@query(f"{_TRADE} SELECT e AS edge_id, a, b, n FROM top")
def trade_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _busiest(spark, sf_dir)
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "edge_id int, a int, b int, n long")


@query(f"{_WORLDS} SELECT CAST(k.range AS INTEGER) AS n_edges, CAST(count(ok.id) AS BIGINT) AS n FROM range(17) AS k LEFT JOIN ok ON bit_count(ok.id) = k.range GROUP BY 1")
def trade_exhaustive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.enumerate_counts(spark, trade_graph(spark, sf_dir)[0])


@query(f"{_WORLDS} SELECT CAST(bit_count(id) AS INTEGER) AS n_edges, CAST(count(*) AS BIGINT) AS n FROM ok GROUP BY 1")
def trade_counts_by_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.counts_by_expression(exact.all_worlds(spark, EDGES), trade_graph(spark, sf_dir)[0])


_UNRELIABLE = "sum(pow(0.9, bit_count(id)) * pow(0.1, 16 - bit_count(id)))"


@query(f"{_WORLDS}{_DOWN} SELECT round({_UNRELIABLE}, 9) AS unreliability FROM down")
def trade_exhaustive_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = exact.enumerate_counts(spark, trade_graph(spark, sf_dir)[0])
    return exact.polynomial(counts, EDGES, P).select(F.round("unreliability", 9).alias("unreliability"))


def _function_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.function_counts(exact.all_worlds(spark, EDGES), trade_graph(spark, sf_dir)[0], parse(FORMULAS, EDGES))


@query(f"{_WORLDS}{_DOWN} SELECT CAST(fn AS INTEGER) AS fn, n_edges, value, CAST(count(*) AS BIGINT) AS n FROM ({_FUNCTIONS}) GROUP BY 1, 2, 3")
def trade_function_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _function_counts(spark, sf_dir)


_SHARE = "pow(0.9, n_edges) * pow(0.1, 16 - n_edges)"


@query(f"{_WORLDS}{_DOWN} SELECT CAST(fn AS INTEGER) AS fn, round(sum({_SHARE} * value) / sum({_SHARE}), 9) AS expectation FROM ({_FUNCTIONS}) GROUP BY 1")
def trade_function_expectation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.function_expectation(_function_counts(spark, sf_dir), EDGES, P).select("fn", F.round("expectation", 9).alias("expectation"))


#: Connected worlds by edges up.
GOLDEN = {
    "grid3_counts": [0, 0, 0, 0, 6, 48, 166, 312, 334, 192, 64, 12, 1],
    "grid4_counts": [0, 0, 0, 0, 0, 0, 20, 360, 3066, 16332, 60670, 165956, 344033, 547944, 672928, 635632, 460680, 258144, 112742, 38392, 10071, 1976, 274, 24, 1],
    "k6_counts": [0, 1, 18, 151, 754, 2349, 4532, 6187, 6345, 4985, 3001, 1365, 455, 105, 15, 1],
    "dodecahedron_dp_counts": [0, 0, 0, 0, 0, 6, 162, 2094, 17238, 101442, 454071, 1605720, 4597725, 10833306, 21217914, 34721924, 47506734, 54147186, 51033218, 39423228, 24853473, 12875830, 5531394, 1977348, 585436, 141630, 27345, 4058, 435, 30, 1],
}


def _golden(name: str) -> str:
    rows = ", ".join(f"({k}, {v})" for k, v in enumerate(GOLDEN[name]))
    return f"SELECT CAST(k AS INTEGER) AS n_edges, CAST(v AS BIGINT) AS n FROM (VALUES {rows}) AS t(k, v)"


@query(_golden("grid3_counts"))
def grid3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.enumerate_counts(spark, graphs.grid(3, (0, 8)))


@query(_golden("grid4_counts"))
def grid4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.enumerate_counts(spark, graphs.grid(4, (0, 15)))


@query(_golden("k6_counts"))
def k6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.enumerate_counts(spark, graphs.complete(6, 2))


@query(_golden("dodecahedron_dp_counts"))
def dodecahedron_dp_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import math

    m = 30
    down = exact.merged_states(spark, graphs.dodecahedron())
    every = spark.createDataFrame([(k, math.comb(m, k)) for k in range(m + 1)], "n_edges int, total long")
    return every.join(down, "n_edges", "left").select("n_edges", (F.col("total") - F.coalesce("n", F.lit(0))).alias("n"))


@query("SELECT graph, p, log10_unreliability FROM (VALUES ('dodecahedron', 0.99, round(log10(2.0618910983e-06), 6)), ('dodecahedron', 0.9999, round(log10(2.0006001801e-12), 6)), ('grid4', 0.99, round(log10(2.0409116253e-04), 6)), ('grid4', 0.9999, round(log10(2.0004000900e-08), 6))) AS t(graph, p, log10_unreliability)")
def exact_dp_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, g in (("dodecahedron", graphs.dodecahedron()), ("grid4", graphs.grid(4, (0, 15)))):
        for p in (0.99, 0.9999):
            row = exact.merged_states(spark, g, p).select(F.lit(name).alias("graph"), F.lit(p).alias("p"), F.round(F.log10("unreliability"), 6).alias("log10_unreliability"))
            out = row if out is None else out.unionByName(row)
    return out


_EXACT = f"{_WORLDS}{_DOWN} SELECT round({_UNRELIABLE}, 9) AS estimate FROM down"


@query(_EXACT)
def trade_dp_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.merged_states(spark, trade_graph(spark, sf_dir)[0], P).select(F.round("unreliability", 9).alias("estimate"))


def _uncapped(method: str) -> Query:
    return lambda spark, sf_dir: estimators.replicates(spark, trade_graph(spark, sf_dir)[0], P, method, 1 << 40, SEED).select(F.round("estimate", 9).alias("estimate"))


for _name in ("wor", "wor_merge", "fearnhead"):
    QUERIES[f"{_name}_uncapped"] = _uncapped(_name)
    ORACLE[f"{_name}_uncapped"] = _EXACT


_U = lambda *key: "(CAST('0x' || substr(md5(" + " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in key) + "), 1, 12) AS BIGINT) / 281474976710656.0 + 1.7763568394002505e-15)"
_ORDERS = f""", drawn AS (
  SELECT o_orderkey, CAST(sum(CASE WHEN {_U(SEED, "o_orderkey", "e")} < 0.9 THEN CAST(1 AS BIGINT) << e ELSE 0 END) AS BIGINT) AS id FROM orders, edge GROUP BY o_orderkey
)"""


@query(f"{_WORLDS}{_ORDERS} SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE id NOT IN (SELECT id FROM ok)) AS BIGINT) AS n_failed FROM drawn")
def crude_mc_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimators.crude(_read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", trade_graph(spark, sf_dir)[0], P, SEED).select("n", "n_failed")


_SUMS = " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS fn, CAST(count(*) AS BIGINT) AS n, CAST(coalesce(sum({f.sql(_BIT)}), 0) AS BIGINT) AS total FROM drawn WHERE id NOT IN (SELECT id FROM ok)" for k, f in enumerate(parse(FORMULAS, EDGES)))


@query(f"{_WORLDS}{_ORDERS} {_SUMS}")
def crude_mc_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = trade_graph(spark, sf_dir)[0]
    worlds = _read(spark, sf_dir, "orders").select(random_world(EDGES, P, SEED, F.col("o_orderkey")).alias("world"))
    return empirical.failed_expectation(worlds, g, parse(FORMULAS, EDGES))


def _user_sample(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """A user is a sample, an event type it has an edge that is up, its values' sum the weight."""
    events = _read(spark, sf_dir, "events").select("user_id", "event_type", "value")
    kinds = [r.event_type for r in events.select("event_type").distinct().orderBy("event_type").limit(64).collect()]
    if len(kinds) > 63:
        raise ValueError("a mask holds at most 63 event types")
    bit = F.create_map(*(F.lit(x) for k, name in enumerate(kinds) for x in (name, 1 << k)))
    rows = events.groupBy("user_id").agg(F.bit_or(bit[F.col("event_type")].cast("long")).alias("world"), F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("weight"))
    return rows, len(kinds)


_USERS = """WITH kinds AS (
  SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS e FROM (SELECT DISTINCT event_type FROM events)
), drawn AS (
  SELECT user_id, CAST(bit_or(CAST(1 AS BIGINT) << e) AS BIGINT) AS id, CAST(sum(CAST(value AS DECIMAL(18, 6))) AS DOUBLE) AS weight FROM events JOIN kinds USING (event_type) GROUP BY user_id
)"""
_USER_FORMULAS = "e0+e1+e2, e0*e1, e2-e0"


@query(_USERS + " " + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS fn, round(sum(weight * {f.sql(_BIT)}) / sum(weight), 6) AS expectation FROM drawn" for k, f in enumerate(parse(_USER_FORMULAS, 3))))
def empirical_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample, m = _user_sample(spark, sf_dir)
    return empirical.weighted_expectation(sample, parse(_USER_FORMULAS, m), weight="weight").select("fn", F.round("expectation", 6).alias("expectation"))


@query(_USERS + " SELECT user_id AS obs_id, id AS world FROM drawn")
def archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample, m = _user_sample(spark, sf_dir)
    states = cut(sample.select(F.col("user_id").alias("obs_id"), decode(F.col("world"), m).alias("state")))
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/archive-{uuid.uuid4().hex}"
    empirical.save(empirical.to_collection(states), path, "collection")
    from tidegraph.functions.states import encode

    return empirical.load(spark, path, "collection").select("obs_id", encode(F.col("state")).alias("world"))


_CLOSURE = """, walk(v, u) AS (
  SELECT n_nationkey, n_nationkey FROM nation
  UNION SELECT w.v, CASE WHEN top.a = w.u THEN top.b ELSE top.a END FROM walk AS w JOIN top ON top.a = w.u OR top.b = w.u
), label AS (SELECT v, min(u) AS component FROM walk GROUP BY v)"""


def _nation_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = trade_graph_edges(spark, sf_dir).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return components.component_labels(_read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("v")), edges)


@query(f"{_TRADE}{_CLOSURE} SELECT v, component FROM label")
def components_nation_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation_components(spark, sf_dir)


@query(f"{_TRADE}{_CLOSURE} SELECT least(x.component, y.component) AS c1, greatest(x.component, y.component) AS c2, CAST(count(*) AS BIGINT) AS n_parallel FROM pairs JOIN label AS x ON x.v = a JOIN label AS y ON y.v = b GROUP BY 1, 2")
def reduced_graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = trade_pairs(spark, sf_dir).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return components.reduced_graph(_nation_components(spark, sf_dir), edges)


@query(f"{_TRADE}, walk(v, u) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT w.v, CASE WHEN top.a = w.u THEN top.b ELSE top.a END FROM walk AS w JOIN top ON (top.a = w.u OR top.b = w.u) AND top.e % 4 = 0), label AS (SELECT v, min(u) AS component FROM walk GROUP BY v), r AS (SELECT least(x.component, y.component) AS c1, greatest(x.component, y.component) AS c2, CAST(count(*) AS BIGINT) AS n_parallel FROM pairs JOIN label AS x ON x.v = a JOIN label AS y ON y.v = b GROUP BY 1, 2) SELECT c1, c2, n_parallel, round(pow(0.1, n_parallel), 12) AS inop, round(1 - pow(0.1, n_parallel), 12) AS op FROM r WHERE c1 <> c2")
def reduced_graph_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of nations between the components of every fourth busy pair, without loops, with probabilities of being down and up."""
    every = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("v"))
    fixed = trade_graph_edges(spark, sf_dir).where("edge_id % 4 = 0").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    edges = trade_pairs(spark, sf_dir).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    out = components.reduced_graph(components.component_labels(every, fixed), edges, P, loops=False)
    return out.select("c1", "c2", "n_parallel", F.round("inop", 12).alias("inop"), F.round("op", 12).alias("op"))


@query(
    f"""{_TRADE}, walk(u, v, d) AS (
  SELECT i, i, 0 FROM names
  UNION SELECT w.u, CASE WHEN edge.a = w.v THEN edge.b ELSE edge.a END, d + 1 FROM walk AS w JOIN edge ON (edge.a = w.v OR edge.b = w.v) WHERE d < 16
), dist AS (SELECT u, v, min(d) AS d FROM walk GROUP BY u, v
), ends AS (SELECT e, a AS v FROM edge UNION ALL SELECT e, b FROM edge)
SELECT x.e AS e1, y.e AS e2, CAST(CASE WHEN x.e = y.e THEN 0 ELSE min(d) + 1 END AS INTEGER) AS d FROM dist JOIN ends AS x ON x.v = dist.u JOIN ends AS y ON y.v = dist.v WHERE x.e <= y.e GROUP BY x.e, y.e"""
)
def edge_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = trade_graph(spark, sf_dir)[0]
    return components.edge_distances(spark, g.edge_table(spark), g.vertex_table(spark).select("v"))


_GRID_EDGES = ", ".join(f"({k}, {50.0 * (a % 4 + b % 4)}, {50.0 * (a // 4 + b // 4)})" for k, (a, b) in enumerate(graphs.grid(4).edges))


@query(f"WITH m(e, x, y) AS (VALUES {_GRID_EDGES}) SELECT CAST(p.e AS INTEGER) AS e1, CAST(q.e AS INTEGER) AS e2, round(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)), 6) AS d FROM m AS p JOIN m AS q ON p.e < q.e")
def spatial_edge_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.spatial_edge_distances(graphs.grid(4), spark).select("e1", "e2", F.round("d", 6).alias("d"))


_CUTS = f"""{_TRADE}, sides AS (SELECT range AS id FROM range(1, CAST(pow(2, (SELECT count(*) FROM names)) AS BIGINT) - 1) WHERE range & 1 = 1
), cuts AS (SELECT id, count(*) FILTER (WHERE ((id >> a) & 1) <> ((id >> b) & 1)) AS c FROM sides, edge GROUP BY id
), split AS (SELECT cuts.* FROM cuts, terminal WHERE ((id >> s) & 1) <> ((id >> t) & 1))"""


@query(f"{_CUTS} SELECT CAST(min(c) AS BIGINT) AS mincut FROM split")
def kterminal_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mincut.terminal_mincut(spark, trade_graph(spark, sf_dir)[0])


@query(f"{_CUTS} SELECT CAST(min(c) AS BIGINT) AS mincut FROM cuts")
def global_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mincut.global_mincut(spark, trade_graph(spark, sf_dir)[0])


@query(f"{_CUTS} SELECT DISTINCT e AS edge_id FROM split, edge WHERE c = (SELECT min(c) FROM split) AND ((id >> a) & 1) <> ((id >> b) & 1)")
def mincut_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mincut.mincut_edges(spark, trade_graph(spark, sf_dir)[0])


@query("SELECT CAST(0 AS INTEGER) AS a, CAST(5 AS INTEGER) AS b, round((1 - pow(0.9, 2)) * (1 - 0.9 * (1 - 0.1 * (1 - pow(0.9, 2))) * 0.9), 9) AS down")
def series_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = [(0, 1), (1, 5), (0, 2), (2, 3), (2, 4), (4, 3), (3, 5), (3, 6)]
    rows = components.series_parallel([(a, b, 0.1) for a, b in edges], {0, 5})
    return spark.createDataFrame(rows, "a int, b int, down double").select("a", "b", F.round("down", 9).alias("down"))


@query(
    f"""WITH s AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS size FROM part
), t AS (SELECT CAST(sum(size) AS BIGINT) AS total FROM s
), k AS (SELECT p_partkey, size, 50 / CAST(total AS DOUBLE) * size AS pi, {_U(SEED, "p_partkey")} AS u FROM s, t)
SELECT p_partkey, size FROM k ORDER BY (u / (1 - u)) / (pi / (1 - pi)), p_partkey LIMIT 50"""
)
def pareto_sample_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_retailprice") * 100).cast("long").alias("size"))
    return sampling.pareto_sample(sampling.inclusion_table(part, "size", 50), "p_partkey", 50, SEED).select("p_partkey", "size")


@query(
    f"""WITH s AS (SELECT s_suppkey, CAST(round((s_acctbal + 1000) * 100) AS BIGINT) AS size FROM supplier
), c AS (SELECT s_suppkey, sum(size) OVER (ORDER BY s_suppkey) AS hi, sum(size) OVER (ORDER BY s_suppkey) - size AS lo FROM s WHERE size > 0
), d AS (SELECT range AS draw, {_U(SEED, "range")} * (SELECT sum(size) FROM s WHERE size > 0) AS x FROM range(200))
SELECT draw, s_suppkey FROM d JOIN c ON x >= lo AND x < hi"""
)
def alias_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "supplier").select("s_suppkey", F.round((F.col("s_acctbal") + 1000) * 100).cast("long").alias("size"))
    return sampling.alias_draws(rows, "s_suppkey", "size", 200, SEED)


@query(f"WITH s AS (SELECT l_extendedprice AS y, l_quantity / 500 AS pi FROM lineitem WHERE {_U(SEED, 'l_orderkey', 'l_linenumber')} < l_quantity / 500) SELECT round(sum(y / pi) / 1e6, 4) AS total, round(sum((1 - pi) * pow(y / pi, 2)) / 1e12, 4) AS variance FROM s")
def ht_total_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", (F.col("l_quantity") / 500).alias("pi"))
    sample = rows.where(uniform(SEED, F.col("l_orderkey"), F.col("l_linenumber")) < F.col("pi"))
    out = sampling.horvitz_thompson(sample, "l_extendedprice")
    return out.select(F.round(F.col("total") / 1e6, 4).alias("total"), F.round(F.col("variance") / 1e12, 4).alias("variance"))


_METHODS, _SIZES, _GRAPHS, _PS = ["importance", "wor", "wor_merge", "fearnhead"], [10, 20, 100], ["dodecahedron", "grid9"], [0.99, 0.9999]
_values = lambda name, xs: f"(VALUES {', '.join(f'({x!r})' for x in xs)}) AS {name}_t({name})"
_GRID = f"""scenarios AS (
  SELECT CAST(row_number() OVER (ORDER BY method, sample_size, graph, probability) - 1 AS INTEGER) AS scenario_id, method, CAST(sample_size AS INTEGER) AS sample_size, graph,
    CAST(1000 AS INTEGER) AS n_reps, CAST(probability AS DOUBLE) AS probability, concat(method, '-', graph, '-', sample_size, '-', CAST(CAST(probability AS DOUBLE) AS VARCHAR), '.parquet') AS file
  FROM {_values("method", _METHODS)}, {_values("sample_size", _SIZES)}, {_values("graph", _GRAPHS)}, {_values("probability", _PS)})"""


@query(f"WITH {_GRID} SELECT * FROM scenarios")
def scenario_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harness.scenario_grid(spark, _METHODS, _SIZES, _GRAPHS, _PS, 1000)


@query(f"WITH {_GRID}, done AS (SELECT o_custkey % 40 AS scenario_id, count(*) AS done FROM orders GROUP BY 1) SELECT scenarios.*, CAST(n_reps - coalesce(done, 0) AS BIGINT) AS \"left\" FROM scenarios LEFT JOIN done USING (scenario_id) WHERE n_reps > coalesce(done, 0)")
def unfinished_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _read(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).cast("int").alias("scenario_id"))
    return harness.unfinished(scenario_grid(spark, sf_dir), results)


@query(
    """WITH r AS (SELECT CAST(o_custkey % 40 AS INTEGER) AS scenario_id, o_totalprice AS estimate, 1 + o_orderkey % 9 AS seconds FROM orders
), truth AS (SELECT CAST(c_custkey % 40 AS INTEGER) AS scenario_id, 200000 + avg(c_acctbal) AS truth FROM customer WHERE c_custkey % 40 < 30 GROUP BY 1
), s AS (SELECT scenario_id, CAST(count(*) AS BIGINT) AS n, avg(estimate) AS mean, var_samp(estimate) AS v, avg(seconds) AS t FROM r GROUP BY 1)
SELECT scenario_id, n, round(v * t / 1e9, 5) AS wnv, round(v * t / mean / mean, 8) AS wnrv, round(mean - truth, 4) AS bias, round((v + pow(mean - truth, 2)) / 1e9, 5) AS mse FROM s LEFT JOIN truth USING (scenario_id)"""
)
def work_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variances times the work, bias and mean squared error of scenarios; a quarter of them have no known truth."""
    results = _read(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).cast("int").alias("scenario_id"), F.col("o_totalprice").alias("estimate"), (1 + F.col("o_orderkey") % 9).alias("seconds"))
    truth = _read(spark, sf_dir, "customer").where("c_custkey % 40 < 30").groupBy((F.col("c_custkey") % 40).cast("int").alias("scenario_id")).agg((200000 + F.avg("c_acctbal")).alias("truth"))
    out = harness.statistics(results, seconds="seconds", truth=truth)
    return out.select("scenario_id", "n", F.round(F.col("wnv") / 1e9, 5).alias("wnv"), F.round("wnrv", 8).alias("wnrv"), F.round("bias", 4).alias("bias"), F.round(F.col("mse") / 1e9, 5).alias("mse"))


@query("SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(avg(l_extendedprice), 4) AS mean, round(sqrt(var_samp(l_extendedprice)), 4) AS sd, round(sqrt(var_samp(l_extendedprice)) / avg(l_extendedprice), 6) AS re FROM lineitem GROUP BY 1")
def scenario_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = harness.statistics(_read(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice")
    return out.select("l_returnflag", "n", F.round("mean", 4).alias("mean"), F.round(F.sqrt("var_samp"), 4).alias("sd"), F.round("re", 6).alias("re"))


@query("WITH r AS (SELECT l_suppkey, row_number() OVER w AS k, avg(l_extendedprice) OVER w AS mean, sqrt(var_samp(l_extendedprice) OVER w) AS sd FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT l_suppkey, CAST(k AS INTEGER) AS k, round(mean, 6) AS mean, round(sd, 2) AS sd FROM r WHERE k % 100 = 0")
def running_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select("l_suppkey", F.struct("l_orderkey", "l_linenumber").alias("seed"), "l_extendedprice")
    out = harness.running(rows, "l_suppkey", "seed", "l_extendedprice")
    return out.select("l_suppkey", "k", F.round("mean", 6).alias("mean"), F.round(F.sqrt("variance"), 2).alias("sd"))


@query(f"WITH s AS (SELECT CAST(range AS INTEGER) AS rep, o_totalprice FROM orders, range(20) WHERE {_U(SEED, 'range', 'o_orderkey')} < 0.3) SELECT rep, CAST(count(*) AS BIGINT) AS n, round(sqrt(var_samp(o_totalprice)), 3) AS sd FROM s GROUP BY rep")
def bootstrap_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = harness.bootstrap_variance(_read(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", 20, 0.3, SEED)
    return out.select("rep", "n", F.round(F.sqrt("variance"), 3).alias("sd"))


@query(
    f"""WITH r AS (SELECT CAST(range // 20 AS INTEGER) AS batch, CAST(range % 20 AS BIGINT) AS replicate FROM range(45))
SELECT batch, replicate, CAST(count(*) AS BIGINT) AS n, round(avg(o_totalprice), 4) AS estimate FROM r, orders WHERE {_U('3000009 + batch', 'replicate', 'o_orderkey')} < 0.05 GROUP BY 1, 2"""
)
def resumed_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicates of a mean over hashed subsets of the orders: 30 in batches of 20, then 45; the short batch is made good."""
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")

    def run(spark: SparkSession, g: None, p: float, method: str, n: int, seed: int, count: int) -> DataFrame:
        each = orders.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("replicate"))
        return each.where(uniform(seed, F.col("replicate"), F.col("o_orderkey")) < p).groupBy("replicate").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("estimate"))

    path = shared_path(spark, "resumed")
    for reps in (30, 45):
        harness.resume(spark, path, 3, None, 0.05, "mean", 1, reps, 20, run)
    return spark.read.parquet(path).select("batch", "replicate", "n", F.round("estimate", 4).alias("estimate"))


@query("SELECT CAST(CASE WHEN o_totalprice < 0 THEN 0 WHEN o_totalprice >= 400000 THEN 21 ELSE floor(o_totalprice / 20000) + 1 END AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def variance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harness.histogram(_read(spark, sf_dir, "orders"), "o_totalprice", 0.0, 400000.0, 20)


@query("SELECT CAST(level AS INTEGER) AS level, CAST(radius AS DOUBLE) AS radius FROM (VALUES (0, 10.0), (1, 7.5), (2, 5.0), (3, 0.0)) AS t(level, radius)")
def threshold_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(empirical.levels(10, 5, 3))), "level int, radius double")
