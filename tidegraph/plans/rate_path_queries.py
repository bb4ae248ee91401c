"""Registered queries of estimators on tables: each customer is a world with its own hashed repair times, or a replicate."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.states import uniform
from tidegraph.operators import mincut, particles, rate_paths
from tidegraph.plans.catalogue import _DOWN, _PAIRS, _TRADE, _U, _WORLDS, P, SEED, _read, query, trade_graph
from tidegraph.plans.lineage import cut, spread
from tidegraph.plans.network import _UNRELIABLE
from tidegraph.plans.networks_of_tables import nation_pairs
from tidegraph.sources.graphs import Graph

#: A pair of nations with this many line items is as likely up as down: its repair rate is ln(1 + n / ITEMS).
ITEMS = 50.0
#: The terminals of the network of all nations are the nations of this region.
REGION = 0


def _worlds(spark: SparkSession, sf_dir: str, g: Graph) -> DataFrame:
    """(world, edges): the trade network's edges in each customer's world, all with the rate of ``P`` and repair times in the order of uniforms."""
    each = spread(_read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("world")), "world", len(g.edges))
    edge = lambda k, a, b: F.struct(F.lit(k).alias("edge_id"), F.lit(a).alias("src"), F.lit(b).alias("dst"), uniform(SEED, F.col("world"), k).alias("t"), F.lit(-math.log1p(-P)).alias("rate"))
    return each.select("world", F.array(*(edge(k, a, b) for k, (a, b) in enumerate(g.edges))).alias("edges"))  # sixteen edges


# repairs that join two components, one a step, in each customer's world of the sixteen busiest pairs
_WALK = f"""{_TRADE}, size AS (SELECT count(*) AS size FROM names
), times AS (SELECT c_custkey AS w, e, a + 1 AS a, b + 1 AS b, {_U(SEED, 'c_custkey', 'e')} AS t FROM customer, edge
), start AS (SELECT list_transform(range(0, size), lambda x: CAST(x AS BIGINT)) AS lab FROM size
), walk(w, lab, path, last) AS (
  SELECT c_custkey, lab, CAST([] AS BIGINT[]), CAST(-1 AS DOUBLE) FROM customer, start
  UNION ALL SELECT w, list_transform(lab, lambda x: CASE WHEN x = lab[pick.b] THEN lab[pick.a] ELSE x END), list_append(path, live), pick.t
  FROM (SELECT walk.w, lab, path, count(*) AS live, arg_min({{'a': times.a, 'b': times.b, 't': times.t}}, times.t) AS pick
    FROM walk JOIN times ON times.w = walk.w, size WHERE lab[times.a] <> lab[times.b] AND lab[1] <> lab[size] GROUP BY walk.w, lab, path)
), done AS (SELECT w, path, last FROM walk, size WHERE lab[1] = lab[size])"""
# distinct rates: the chance that the waits add up to more than 1 is a sum over the rates
_TAIL = f"list_sum(list_transform(path, lambda x: pow(1 - {P}, x) * list_product(list_concat([CAST(1 AS DOUBLE)], list_transform(list_filter(path, lambda y: y <> x), lambda y: CAST(y AS DOUBLE) / (y - x))))))"
_EACH = f", each AS (SELECT c_custkey AS w, coalesce(CAST(len(path) AS BIGINT), 0) AS steps, CASE WHEN path IS NULL THEN 1 ELSE {_TAIL} END AS estimate FROM customer LEFT JOIN done ON w = c_custkey)"


@query(f"{_WALK}{_EACH} SELECT CAST(w AS BIGINT) AS world, steps, round(estimate, 7) AS estimate FROM each")
def turnip_worlds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's permutation estimate on the trade network, by the rates that wait before each repair that joins components."""
    g = trade_graph(spark, sf_dir)[0]
    found = rate_paths.permutation_estimates(_worlds(spark, sf_dir, g), g.terminals)
    return found.select("world", "steps", F.round("estimate", 7).alias("estimate"))


_COMBINATIONS = "factorial(m) / (factorial(k) * factorial(m - k))"
_CONDITIONAL = f""", sides AS (SELECT 2 * range + 1 AS side FROM range(CAST(pow(2, (SELECT count(*) FROM names) - 2) AS BIGINT))
), least AS (SELECT min(c) AS least FROM (SELECT side, sum(CASE WHEN ((side >> a) & 1) <> ((side >> b) & 1) THEN 1 ELSE 0 END) AS c FROM sides, edge GROUP BY side)
), binomial AS (SELECT k, m, CAST({_COMBINATIONS} AS DOUBLE) * pow(CAST({P} AS DOUBLE), k) * pow(1 - CAST({P} AS DOUBLE), m - k) AS pr FROM (SELECT CAST(range AS INTEGER) AS k, CAST(m AS INTEGER) AS m FROM (SELECT count(*) AS m FROM edge), range(17)) WHERE k <= m
), place AS (SELECT customer.c_custkey AS w, CAST(count(times.w) AS BIGINT) AS place FROM customer LEFT JOIN done ON done.w = c_custkey LEFT JOIN times ON times.w = done.w AND times.t <= done.last GROUP BY c_custkey
), chance AS (SELECT place, count(*) AS n, (SELECT sum(pr) FROM binomial, least WHERE k < m - least + 1 AND (place = 0 OR k < place)) AS estimate FROM place GROUP BY place)"""
_MOMENTS = "CAST({n} AS BIGINT) AS n, round({mean}, 9) AS estimate, round(sqrt(({square}) / pow({mean}, 2) - 1) / sqrt({n}), 6) AS relative_error"


@query(
    f"""{_WALK}{_EACH}{_CONDITIONAL}
SELECT 'turnip' AS method, {_MOMENTS.format(n='count(*)', mean='avg(estimate)', square='avg(estimate * estimate)')} FROM each
UNION ALL SELECT 'conditional_turnip', {_MOMENTS.format(n='sum(n)', mean='(sum(n * estimate) / sum(n))', square='sum(n * estimate * estimate) / sum(n)')} FROM chance"""
)
def permutation_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and relative error over all customers' worlds, of the estimates by rate paths and of those by the critical place given that a minimum cut's number of edges is down."""
    g = trade_graph(spark, sf_dir)[0]
    worlds = _worlds(spark, sf_dir, g)
    turnip = rate_paths.permutation_estimates(worlds, g.terminals).select(F.lit("turnip").alias("method"), F.lit(1).cast("long").alias("n"), "estimate")
    least = mincut.terminal_mincut(spark, g).first().mincut
    given = rate_paths.conditional_estimates(rate_paths.critical_places(worlds, g.terminals), P, least).select(F.lit("conditional_turnip").alias("method"), "n", "estimate")
    sums = turnip.unionByName(given).groupBy("method").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("estimate")).alias("s"), F.sum(F.col("n") * F.col("estimate") * F.col("estimate")).alias("q"))
    mean = F.col("s") / F.col("n")
    return sums.select("method", "n", F.round(mean, 9).alias("estimate"), F.round(F.sqrt(F.col("q") / F.col("n") / (mean * mean) - 1) / F.sqrt("n"), 6).alias("relative_error"))


@query(
    f"""WITH RECURSIVE {_PAIRS.partition('), top AS')[0]}
), num AS (SELECT v, CAST(row_number() OVER (ORDER BY v) AS INTEGER) AS i FROM (SELECT a AS v FROM pairs UNION SELECT b FROM pairs)
), term AS (SELECT list(i) AS term FROM num JOIN nation ON n_nationkey = v WHERE n_regionkey = {REGION}
), times AS (SELECT c_custkey AS w, x.i AS a, y.i AS b, ln(1 + n / CAST({ITEMS} AS DOUBLE)) AS rate, -ln({_U(SEED, 'c_custkey', 'pairs.a', 'pairs.b')}) / ln(1 + n / CAST({ITEMS} AS DOUBLE)) AS t
  FROM pairs JOIN num AS x ON x.v = pairs.a JOIN num AS y ON y.v = pairs.b, customer
), walk(w, lab, steps, live, wait) AS (
  SELECT c_custkey, lab, CAST(0 AS BIGINT), CAST(0 AS HUGEINT), CAST(0 AS DOUBLE) FROM customer, (SELECT list_transform(range(0, count(*)), lambda x: CAST(x AS BIGINT)) AS lab FROM num)
  UNION ALL SELECT w, list_transform(lab, lambda x: CASE WHEN x = lab[pick.b] THEN lab[pick.a] ELSE x END), steps + 1, live + waiting, wait + 1 / rate
  FROM (SELECT walk.w, lab, steps, live, wait, count(*) AS waiting, sum(rate) AS rate, arg_min({{'a': times.a, 'b': times.b}}, times.t) AS pick
    FROM walk JOIN times ON times.w = walk.w, term
    WHERE lab[times.a] <> lab[times.b] AND len(list_distinct(list_transform(term, lambda x: lab[x]))) > 1 GROUP BY walk.w, lab, steps, live, wait))
SELECT CAST(w AS BIGINT) AS world, steps, CAST(live AS BIGINT) AS live, round(wait, 8) AS mean_time FROM walk, term WHERE len(list_distinct(list_transform(term, lambda x: lab[x]))) = 1"""
)
def nation_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network of all nations in each customer's world, repaired at rates that grow with the line items of a pair.

    steps that join components until the nations of one region are connected, edges
    that wait before them in sum, and the mean of the time that they take.
    """
    pairs = cut(nation_pairs(spark, sf_dir))
    terminals = [r.v for r in _read(spark, sf_dir, "nation").where(F.col("n_regionkey") == REGION).select(F.col("n_nationkey").alias("v")).join(pairs.select(F.explode(F.array("src", "dst")).alias("v")).distinct(), "v").collect()]  # a region's nations
    network = pairs.agg(F.collect_list(F.struct("src", "dst", "n")).alias("pairs"))  # as many as pairs of nations
    each = spread(_read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("world")), "world", pairs.count()).crossJoin(F.broadcast(network))

    def edge(x):
        rate = F.log1p(x["n"] / ITEMS)
        return F.struct((x["src"] * 1_000 + x["dst"]).cast("long").alias("edge_id"), x["src"].alias("src"), x["dst"].alias("dst"), (-F.log(uniform(SEED, F.col("world"), x["src"], x["dst"])) / rate).alias("t"), rate.alias("rate"))

    path = rate_paths.rate_paths(each.select("world", F.transform("pairs", edge).alias("edges")), terminals)
    whole = path.groupBy("world").agg(F.count("*").alias("steps"), F.sum("live").alias("live"), F.round(F.sum(1 / F.col("rate")), 8).alias("mean_time"), F.bool_or("connects").alias("whole"))
    return whole.where("whole").drop("whole")


#: Particles of a sampled replicate, and the share that the mean over all replicates may be off, fixed beforehand.
PARTICLES, SHARE = 10, 0.05


@query(f"{_WORLDS}{_DOWN} SELECT (SELECT CAST(count(*) AS BIGINT) FROM customer) AS n, round({_UNRELIABLE}, 9) AS unreliability, true AS within FROM down")
def splitting_on_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade network by splitting over a table of particles: one replicate that keeps every state, and how near to it the mean of small replicates, one a customer, comes."""
    g = trade_graph(spark, sf_dir)[0]
    whole = particles.splitting(spark, g, P, 1 << len(g.edges), 1, SEED).select(F.col("estimate").alias("whole"))
    stats = particles.splitting(spark, g, P, PARTICLES, _read(spark, sf_dir, "customer").count(), SEED).agg(F.count("*").alias("n"), F.avg("estimate").alias("mean"))
    return stats.crossJoin(F.broadcast(whole)).select("n", F.round("whole", 9).alias("unreliability"), (F.abs(F.col("mean") / F.col("whole") - 1) <= SHARE).alias("within"))  # a row each
