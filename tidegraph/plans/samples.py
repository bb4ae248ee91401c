"""Registered queries on sampling designs and scans over whole tables."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators import designs, layers, sampling, scan
from tidegraph.plans.catalogue import _U, SEED, _read, query

#: Units of the fixed-size designs, draws with replacement, and units of the threshold sample.
FIXED, DRAWS, THRESHOLD = 20, 500, 300

_ITEMS = "SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS item, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CASE WHEN l_orderkey % 997 = 0 THEN 1000 ELSE 1 END) AS BIGINT) AS size FROM lineitem GROUP BY 1"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, size): lines of orders by their price in cents, some orders a thousandfold; a line's number may repeat."""
    size = F.round(F.col("l_extendedprice") * 100).cast("long") * F.when(F.col("l_orderkey") % 997 == 0, 1000).otherwise(1)
    return _read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("item"), size.alias("size")).groupBy("item").agg(F.sum("size").alias("size"))


@query(f"WITH s AS ({_ITEMS}) SELECT item, size, CAST(sum(size) OVER (ORDER BY item) AS BIGINT) AS upto FROM s")
def lineitem_prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.prefix_sums(_items(spark, sf_dir), ["item"], {"upto": "size"})


@query(
    f"""WITH s AS ({_ITEMS}), c AS (SELECT item, CAST(sum(size) OVER (ORDER BY item) - size AS DOUBLE) AS low FROM s WHERE size > 0
), t AS (SELECT CAST(sum(size) AS BIGINT) AS total FROM s WHERE size > 0), d AS (SELECT range AS draw, {_U(SEED, 'range')} * total AS place FROM range({DRAWS}), t)
SELECT draw, item FROM d ASOF JOIN c ON place >= low"""
)
def alias_draws_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.alias_draws(_items(spark, sf_dir), "item", "size", DRAWS, SEED)


def _threshold_sql(units: str, unit: str, n: int) -> str:
    return f"""WITH s AS ({units}), g AS (SELECT size, count(*) AS k, sum(size) AS t FROM s WHERE size > 0 GROUP BY size
), r AS (SELECT size, sum(k) OVER w AS above, (SELECT sum(size) FROM s WHERE size > 0) - sum(t) OVER w AS below FROM g WINDOW w AS (ORDER BY size DESC)
), c AS (SELECT coalesce(max(CAST({n} - above AS DOUBLE) / CAST(below AS DOUBLE)) FILTER (WHERE below > 0 AND above < {n} AND CAST({n} - above AS DOUBLE) / CAST(below AS DOUBLE) * size >= 1),
  {n} / (SELECT CAST(sum(size) AS DOUBLE) FROM s WHERE size > 0)) AS c FROM r
), m AS (SELECT {unit}, size, c, c * size AS mass FROM s, c WHERE size > 0
), p AS (SELECT *, CAST(sum(size) OVER (ORDER BY {unit}) AS BIGINT) AS upto FROM m WHERE mass < 1
)
SELECT {unit}, size, round(mass, 9) AS mass, CAST(size AS DOUBLE) AS weight FROM m WHERE mass >= 1
UNION ALL SELECT {unit}, size, round(mass, 9), round(1 / c, 4) FROM p WHERE floor(c * upto - {_U(SEED, "'start'")}) > floor(c * (upto - size) - {_U(SEED, "'start'")})"""


@query(_threshold_sql(_ITEMS, "item", THRESHOLD))
def threshold_sample_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.threshold_sample(_items(spark, sf_dir), "item", "size", THRESHOLD, SEED).select("item", "size", F.round("mass", 9).alias("mass"), F.round("weight", 4).alias("weight"))


@query(_threshold_sql("SELECT c_custkey, CAST(round((c_acctbal + 1000) * 100) AS BIGINT) AS size FROM customer", "c_custkey", 40))
def threshold_sample_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "customer").select("c_custkey", F.round((F.col("c_acctbal") + 1000) * 100).cast("long").alias("size")).where("size > 0")
    return sampling.threshold_sample(rows, "c_custkey", "size", 40, SEED).select("c_custkey", "size", F.round("mass", 9).alias("mass"), F.round("weight", 4).alias("weight"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_retailprice") * 100).cast("long").alias("size"))


_N = FIXED
_PARTS = f"""units AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS size FROM part
), s AS (SELECT p_partkey, size, CAST(row_number() OVER (ORDER BY p_partkey) AS BIGINT) AS i, {_N} * CAST(size AS DOUBLE) / (SELECT CAST(sum(size) AS DOUBLE) FROM units) AS x, {_U(SEED, 'p_partkey')} AS u FROM units
), m AS (SELECT count(*) AS m FROM s)"""
_UNIT = "[CASE WHEN k = 0 THEN CAST(1 AS DOUBLE) ELSE 0 END FOR k IN range(0, {n})]".format(n=_N + 1)
_ZERO = "[CAST(0 AS DOUBLE) FOR k IN range(0, {n})]".format(n=_N + 1)


def _with_unit(poly: str, w: str) -> str:
    """A polynomial, given as a list, times (1 + w z)."""
    return f"list_transform(range(0, {_N + 1}), lambda k: {poly}[k + 1] + CASE WHEN k > 0 THEN {w} * {poly}[k] ELSE 0 END)"


def _coefficient(a: str, b: str, k: int) -> str:
    return f"list_sum(list_transform(range(0, {k + 1}), lambda k: {a}[k + 1] * {b}[{k} - k + 1]))"


_POISSON = f"""WITH RECURSIVE {_PARTS}
, tail(i, t) AS (SELECT CAST(m + 1 AS BIGINT), {_UNIT} FROM m UNION ALL SELECT s.i, {_with_unit('t', 'x')} FROM tail JOIN s ON s.i = tail.i - 1)
, head(i, h) AS (SELECT CAST(0 AS BIGINT), {_UNIT} UNION ALL SELECT s.i, {_with_unit('h', 'x')} FROM head JOIN s ON s.i = head.i + 1)
, ways AS (SELECT t[{_N + 1}] AS ways FROM tail WHERE i = 1)
, walk(i, n_left) AS (SELECT CAST(1 AS BIGINT), CAST({_N} AS BIGINT)
    UNION ALL SELECT walk.i + 1, n_left - CASE WHEN n_left > 0 AND u * a.t[n_left + 1] < x * b.t[n_left] THEN 1 ELSE 0 END FROM walk JOIN s ON s.i = walk.i JOIN tail AS a ON a.i = walk.i JOIN tail AS b ON b.i = walk.i + 1)
, sample AS (SELECT s.*, x * {_coefficient('h', 't', _N - 1)} / ways AS pi, a.n_left > b.n_left AS taken
    FROM s JOIN head ON head.i = s.i - 1 JOIN tail ON tail.i = s.i + 1 JOIN walk AS a ON a.i = s.i JOIN walk AS b ON b.i = s.i + 1, ways)"""


@query(f"{_POISSON} SELECT p_partkey, round(pi, 10) AS pi, taken FROM sample")
def conditional_poisson_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts with their inclusion probability, and the sample."""
    got = designs.conditional_poisson_sample(_parts(spark, sf_dir), "p_partkey", "size", FIXED, SEED)
    return got.select("p_partkey", F.round("pi", 10).alias("pi"), "taken")


@query(
    f"""{_POISSON}
, mid(a, i, h) AS (SELECT s.i, s.i + 1, h FROM sample AS s JOIN head ON head.i = s.i - 1 WHERE taken UNION ALL SELECT a, mid.i + 1, {_with_unit('h', 'x')} FROM mid JOIN s ON s.i = mid.i)
SELECT p.p_partkey AS a, q.p_partkey AS b, round(p.x * q.x * {_coefficient('h', 't', _N - 2)} / ways, 12) AS pi_ab
FROM mid JOIN sample AS p ON p.i = mid.a JOIN sample AS q ON q.i = mid.i AND q.taken JOIN tail ON tail.i = q.i + 1, ways"""
)
def joint_inclusion_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-order inclusion probabilities of the sample's pairs."""
    got = designs.conditional_poisson_sample(_parts(spark, sf_dir), "p_partkey", "size", FIXED, SEED)
    return designs.joint_inclusion(got, "p_partkey", FIXED).where("a < b").select("a", "b", F.round("pi_ab", 12).alias("pi_ab"))


_MARKED = f"""WITH RECURSIVE {_PARTS}, q AS (SELECT *, x / (1 - x) AS o, 1 - x AS w FROM s)
, tail(i, t, v) AS (SELECT CAST(m + 1 AS BIGINT), {_UNIT}, {_ZERO} FROM m
    UNION ALL SELECT q.i, {_with_unit('t', 'o')}, list_transform(range(0, {_N + 1}), lambda k: v[k + 1] + CASE WHEN k > 0 THEN o * (v[k] + w * t[k]) ELSE 0 END) FROM tail JOIN q ON q.i = tail.i - 1)
, walk(i, n_left, marked) AS (SELECT CAST(1 AS BIGINT), CAST({_N} AS BIGINT), true
    UNION ALL SELECT i + 1, n_left - CASE WHEN z < by_mark + plain THEN 1 ELSE 0 END, marked AND z >= by_mark FROM (
      SELECT walk.i, n_left, marked, u * CASE WHEN marked THEN a.v[n_left + 1] ELSE a.t[n_left + 1] END AS z,
        CASE WHEN marked AND n_left > 0 THEN o * w * b.t[n_left] ELSE 0 END AS by_mark, CASE WHEN n_left > 0 THEN o * CASE WHEN marked THEN b.v[n_left] ELSE b.t[n_left] END ELSE 0 END AS plain
      FROM walk JOIN q ON q.i = walk.i JOIN tail AS a ON a.i = walk.i JOIN tail AS b ON b.i = walk.i + 1))"""


@query(f"{_MARKED} SELECT p_partkey, round(x, 10) AS pi FROM q JOIN walk AS a ON a.i = q.i JOIN walk AS b ON b.i = q.i + 1 WHERE a.n_left > b.n_left")
def sampford_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampford's design with inclusion probabilities in proportion to price."""
    units = sampling.inclusion_table(_parts(spark, sf_dir), "size", FIXED)
    return designs.sampford_sample(units, "p_partkey", "pi", FIXED, SEED).where("taken").select("p_partkey", F.round("pi", 10).alias("pi"))


#: Samples of the two layers of ``layered_orders``: market segments, then order priorities.
_LAYERS = (3, 2)
_LAYERED = """WITH o AS (SELECT c_mktsegment AS seg, o_orderpriority AS prio FROM orders JOIN customer ON o_custkey = c_custkey
), cell AS (SELECT seg, prio, CAST(count(*) AS DOUBLE) AS n FROM o GROUP BY 1, 2)"""


def _all_samples(name: str, key: str, n: int) -> str:
    """Every sample of a layer with its probability in proportion to the product of sizes, and its inclusion probabilities."""
    return f""", {name}_u AS (SELECT {key} AS k, sum(n) / (SELECT sum(n) FROM cell) AS size, CAST(row_number() OVER (ORDER BY {key}) - 1 AS INTEGER) AS i FROM cell GROUP BY {key}
), {name}_w AS (SELECT r.range AS s, exp(sum(ln(size))) AS w FROM range(1024) AS r, {name}_u WHERE bit_count(r.range) = {n} AND r.range < (1 << (SELECT count(*) FROM {name}_u)) AND ((r.range >> i) & 1) = 1 GROUP BY 1
), {name}_s AS (SELECT s, w / (SELECT sum(w) FROM {name}_w) AS p FROM {name}_w
), {name}_pi AS (SELECT k, sum(p) AS pi FROM {name}_u, {name}_s WHERE ((s >> i) & 1) = 1 GROUP BY k)"""


@query(
    f"""{_LAYERED}{_all_samples('a', 'seg', _LAYERS[0])}{_all_samples('b', 'prio', _LAYERS[1])}
, est AS (SELECT x.s AS s, y.s AS t, any_value(x.p * y.p) AS p, sum(n / (f.pi * g.pi)) AS est FROM a_s AS x, b_s AS y, cell
    JOIN a_u ON a_u.k = seg JOIN b_u ON b_u.k = prio JOIN a_pi AS f ON f.k = seg JOIN b_pi AS g ON g.k = prio WHERE ((x.s >> a_u.i) & 1) = 1 AND ((y.s >> b_u.i) & 1) = 1 GROUP BY 1, 2)
SELECT CAST(count(*) AS BIGINT) AS n_samples, CAST(round(sum(p * est)) AS BIGINT) AS mean, round(sum(p * pow(est - (SELECT sum(n) FROM cell), 2)) / pow((SELECT sum(n) FROM cell), 2), 9) AS relative_variance FROM est"""
)
def layered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders estimated from three market segments and, within those, two priorities, for every possible sample.

    Orders of one priority merge, with the segments as their lineage.  Each sample's
    variance estimate comes from that sample alone; weighted by the samples'
    probabilities they give the exact variance.
    """
    orders = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    cells = orders.groupBy(F.col("c_mktsegment").alias("parent"), F.col("o_orderpriority").alias("unit")).agg(F.count("*").cast("double").alias("share"))
    units = layers.merged(cells, ["unit"])
    top, low = _design(cells, "parent", _LAYERS[0]), _design(cells, "unit", _LAYERS[1])
    both = top.select(F.col("s").alias("x"), F.col("p").alias("px"), F.col("joint").alias("jx")).crossJoin(low.select(F.col("s").alias("y"), F.col("p").alias("py"), F.col("joint").alias("jy")))  # all samples of both layers, the population of this query
    samples = both.select(F.concat_ws("/", F.concat_ws(",", "x"), F.concat_ws(",", "y")).alias("s"), "x", "y", (F.col("px") * F.col("py")).alias("p"), "jx", "jy")
    pairs = lambda c: samples.select("s", F.explode(c).alias("j")).select("s", "j.a", "j.b", "j.pi_ab")
    first = samples.select("s", F.lit("all").alias("parent"), F.explode("x").alias("unit"), F.lit(1.0).alias("share"))
    second = layers.links(units).join(samples.select("s", F.explode("x").alias("parent"), "y"), "parent").where(F.array_contains("y", F.col("unit"))).select("s", "parent", "unit", "share")
    leaves = samples.select("s", F.explode("y").alias("unit"), F.lit(1.0).alias("z"))
    z, cov = layers.estimate([(pairs("jx"), first), (pairs("jy"), second)], leaves, ["s"])
    total = cells.agg(F.sum("share").alias("total"))
    found = samples.select("s", "p").join(z.select("s", "z"), "s").join(cov.select("s", "cov"), "s").crossJoin(F.broadcast(total))  # one row
    return found.groupBy("total").agg(F.count("*").alias("n_samples"), F.round(F.sum(F.col("p") * F.col("z"))).cast("long").alias("mean"), F.sum(F.col("p") * F.col("cov")).alias("v")).select("n_samples", "mean", F.round(F.col("v") / F.col("total") / F.col("total"), 9).alias("relative_variance"))


def _design(cells: DataFrame, key: str, n: int) -> DataFrame:
    """(s, p, joint) of every sample of n values of a key, probabilities in proportion to the product of shares; for a handful of values."""
    spark = cells.sparkSession
    rows = cells.groupBy(key).agg(F.sum("share").alias("size")).orderBy(key).limit(11).collect()
    if len(rows) > 10:
        raise ValueError("all samples of more than 10 units are too many")
    names, size = [r[0] for r in rows], {r[0]: r["size"] for r in rows}
    chosen = list(itertools.combinations(names, n))
    weight = [math.prod(size[k] / sum(size.values()) for k in s) for s in chosen]
    p = [w / sum(weight) for w in weight]
    pi = {(a, b): sum(q for s, q in zip(chosen, p) if a in s and b in s) for a in names for b in names}
    return spark.createDataFrame([(list(s), q, [(a, b, pi[a, b]) for a in s for b in s]) for s, q in zip(chosen, p)], "s array<string>, p double, joint array<struct<a:string,b:string,pi_ab:double>>")
