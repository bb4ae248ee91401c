"""The functions that a user of the library calls first, one name for each method.

``graph`` is a Graph, a list of edges, an adjacency matrix or neighbour lists by
name; vertices count from 0.  Estimators return a DataFrame of one row a replicate
(replicate, estimate, second); replicates are spread over the cluster.
"""

from __future__ import annotations

import decimal
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators import estimators, exact
from tidegraph.sources.graphs import Graph, convert, probability

_precision = {"digits": 50}


def set_default_precision(digits: int) -> None:
    """Decimal digits of exhaustive_probability."""
    if digits < 1:
        raise ValueError("at least one digit is needed")
    _precision["digits"] = int(digits)


def _graph(graph: object, interest_vertices: Sequence[int]) -> Graph:
    return convert(graph, tuple(interest_vertices))


def _seed(seed: int) -> int:
    if not 0 <= seed < 1 << 63:
        raise ValueError("a seed is a whole number from 0 on that a long holds")
    return seed


def _estimate(spark: SparkSession, method: str, graph: object, p: float | str, n: int, seed: int, interest_vertices: Sequence[int], replicates: int) -> DataFrame:
    return estimators.replicates(spark, _graph(graph, interest_vertices), probability(p), method, n, _seed(seed), replicates)


def crude_mc(spark: SparkSession, graph: object, probability: float | str, n: int, seed: int, interest_vertices: Sequence[int]) -> DataFrame:
    """(n, n_failed, estimate) of n independent worlds; graphs of any size."""
    return estimators.crude_worlds(spark, _graph(graph, interest_vertices), probability, n, _seed(seed))


def approximate_zero_variance(spark: SparkSession, graph: object, probability: float | str, n: int, seed: int, interest_vertices: Sequence[int], replicates: int = 1) -> DataFrame:
    """Importance sampling by minimum cuts."""
    return _estimate(spark, "importance", graph, probability, n, seed, interest_vertices, replicates)


def approximate_zero_variance_wor(spark: SparkSession, graph: object, probability: float | str, n: int, seed: int, interest_vertices: Sequence[int], replicates: int = 1) -> DataFrame:
    """Splitting without replacement."""
    return _estimate(spark, "wor", graph, probability, n, seed, interest_vertices, replicates)


def approximate_zero_variance_wor_merge(spark: SparkSession, graph: object, probability: float | str, n: int, seed: int, interest_vertices: Sequence[int], replicates: int = 1) -> DataFrame:
    """The same with equal states merged."""
    return _estimate(spark, "wor_merge", graph, probability, n, seed, interest_vertices, replicates)


def approximate_zero_variance_fearnhead(spark: SparkSession, graph: object, probability: float | str, n: int, seed: int, interest_vertices: Sequence[int], replicates: int = 1) -> DataFrame:
    """Splitting by threshold sampling."""
    return _estimate(spark, "fearnhead", graph, probability, n, seed, interest_vertices, replicates)


def approximate_zero_variance_wor_with_variance(spark: SparkSession, graph: object, probability: float | str, n: int, seed: int, interest_vertices: Sequence[int], replicates: int = 1) -> DataFrame:
    """Splitting without replacement with a variance estimate in ``second``."""
    return _estimate(spark, "wor_variance", graph, probability, n, seed, interest_vertices, replicates)


def approximate_zero_variance_wor_merge_with_variance(spark: SparkSession, graph: object, probability: float | str, n: int, seed: int, interest_vertices: Sequence[int], replicates: int = 1, graph_file: str = "") -> DataFrame:
    """The same with equal states merged; the first replicate's sampling graph goes to ``graph_file``, as lines of a graph file, if named."""
    if graph_file:
        g = _graph(graph, interest_vertices)
        estimators.variance_graphml(spark, g, float(probability), n, _seed(seed)).coalesce(1).sortWithinPartitions("line").select("value").write.mode("overwrite").text(graph_file)
    return _estimate(spark, "wor_merge_variance", graph, probability, n, seed, interest_vertices, replicates)


def residual_resampling(spark: SparkSession, graph: object, probability: float | str, n: int, seed: int, interest_vertices: Sequence[int], replicates: int = 1) -> DataFrame:
    """Importance steps with residual resampling."""
    return _estimate(spark, "residual", graph, probability, n, seed, interest_vertices, replicates)


def exhaustive_search(spark: SparkSession, graph: object, interest_vertices: Sequence[int], count_disconnected: bool = False) -> DataFrame:
    """(n_edges, n, n_all, disconnected): worlds by edges up."""
    g = _graph(graph, interest_vertices)
    every = F.array(*(F.lit(c).cast("decimal(38,0)") for c in exact.binomials(len(g.edges))))
    return exact.enumerate_counts(spark, g, count_disconnected).select("n_edges", "n", F.element_at(every, F.col("n_edges") + 1).alias("n_all"), F.lit(count_disconnected).alias("disconnected"))


def exhaustive_probability(search: DataFrame, probability: float | str) -> decimal.Decimal:
    """Unreliability from a search, to the digits of set_default_precision; a probability given as text is taken exactly."""
    rows = search.collect()  # one row for each number of edges
    m = max(r.n_edges for r in rows)
    with decimal.localcontext() as c:
        c.prec = _precision["digits"]
        p = decimal.Decimal(probability) if isinstance(probability, str) else decimal.Decimal(repr(float(probability)))
        if not 0 <= p <= 1:
            raise ValueError("a probability lies between 0 and 1")
        power = lambda x, k: x**k if k else decimal.Decimal(1)
        return sum((decimal.Decimal(int(r.n if r.disconnected else r.n_all - r.n)) * power(p, r.n_edges) * power(1 - p, m - r.n_edges) for r in rows), decimal.Decimal(0))
