"""Experiment grids: scenarios, work that is left, statistics and running statistics of replicates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.functions.states import uniform
from tidegraph.operators.estimators import replicates
from tidegraph.sources.graphs import Graph


def scenario_grid(spark: SparkSession, methods: Sequence[str], sizes: Sequence[int], graphs: Sequence[str], probabilities: Sequence[float], reps: int) -> DataFrame:
    """(scenario_id, method, sample_size, graph, n_reps, probability, file): the product of the lists."""
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, methods))).alias("method"))
    for name, values, kind in (("sample_size", sizes, "int"), ("graph", graphs, "string"), ("probability", probabilities, "double")):
        rows = rows.select("*", F.explode(F.array(*(F.lit(v).cast(kind) for v in values))).alias(name))
    file = F.concat_ws("-", "method", "graph", F.col("sample_size").cast("string"), F.col("probability").cast("string"))
    order = Window.orderBy("method", "sample_size", "graph", "probability")
    return rows.select((F.row_number().over(order) - 1).alias("scenario_id"), "method", "sample_size", "graph", F.lit(reps).alias("n_reps"), "probability", F.concat(file, F.lit(".parquet")).alias("file"))


def unfinished(scenarios: DataFrame, results: DataFrame) -> DataFrame:
    """Scenarios with fewer results than replicates, and how many are left."""
    done = results.groupBy("scenario_id").agg(F.count("*").alias("done"))
    rows = scenarios.join(done, "scenario_id", "left").withColumn("left", F.col("n_reps") - F.coalesce("done", F.lit(0)))
    return rows.where(F.col("left") > 0).drop("done")


def resume(spark: SparkSession, path: str, scenario_id: int, g: Graph | None, p: float, method: str, n: int, reps: int, batch: int = 100, run: Callable[..., DataFrame] = replicates) -> int:
    """Write the batches of a scenario that lack replicates, each a partition of its own; returns how many were written.

    A batch's replicates depend on the scenario, the batch and their number alone, so
    a batch that is there but short is written anew, in place of what was there, and
    a call that broke off is made good by the next.  Batches that hold more than is
    asked for stay.
    """
    try:
        rows = spark.read.parquet(path).where(F.col("scenario_id") == scenario_id).groupBy("batch").agg(F.count("*").alias("n"))
        have = {r.batch: r.n for r in rows.collect()}
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        have = {}
    sizes = {b: min(batch, reps - b * batch) for b in range(-(-reps // batch))}
    short = [b for b, size in sizes.items() if have.get(b, 0) < size]
    for b in short:
        rows = run(spark, g, p, method, n, seed=1_000_003 * scenario_id + b, count=sizes[b])
        named = rows.select(F.lit(scenario_id).alias("scenario_id"), F.lit(b).alias("batch"), "*")
        named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scenario_id", "batch").parquet(path)
    return len(short)


def statistics(results: DataFrame, key: str = "scenario_id", estimate: str = "estimate", seconds: str | None = None, truth: DataFrame | None = None) -> DataFrame:
    """Mean, both variances, relative error of one estimate and of the mean, and bias, MSE and work-normalised variances where seconds and truth are known."""
    aggs = [F.count("*").alias("n"), F.avg(estimate).alias("mean"), F.var_samp(estimate).alias("var_samp"), F.var_pop(estimate).alias("var_pop")]
    if seconds:
        aggs.append(F.avg(seconds).alias("seconds"))
    out = results.groupBy(key).agg(*aggs).withColumn("re", F.sqrt("var_samp") / F.col("mean")).withColumn("mean_re", F.sqrt(F.col("var_samp") / F.col("n")) / F.col("mean"))
    if seconds:
        out = out.withColumn("wnv", F.col("var_samp") * F.col("seconds")).withColumn("wnrv", F.col("wnv") / (F.col("mean") * F.col("mean")))
    if truth is not None:
        out = out.join(truth.select(key, "truth"), key, "left").withColumn("bias", F.col("mean") - F.col("truth")).withColumn("mse", F.col("var_samp") + F.col("bias") * F.col("bias"))
    return out


def with_statistics(scenarios: DataFrame, stats: DataFrame) -> DataFrame:
    """Scenarios beside their statistics; those without results have nulls."""
    return scenarios.join(stats, "scenario_id", "left")


def plotted(rows: DataFrame, labels: dict[str, str], **equal: object) -> DataFrame:
    """The rows of the methods in ``labels`` where the named columns have the values, methods under their labels."""
    for name, wanted in equal.items():
        rows = rows.where(F.col(name) == wanted)
    names = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return rows.where(F.col("method").isin(list(labels))).withColumn("method", names[F.col("method")])


def estimate_lines(stats: DataFrame, estimate: str = "mean") -> DataFrame:
    """(value): a line for each row, the estimate and where known the relative error of the mean."""
    error = F.format_string(", relative error %.6e", "mean_re") if "mean_re" in stats.columns else F.lit("")
    return stats.select(F.concat(F.format_string("Estimate %.10e", estimate), F.coalesce(error, F.lit(""))).alias("value"))


def running(results: DataFrame, key: str, order: str, estimate: str, every: int = 100) -> DataFrame:
    """Mean and sample variance of the first k replicates, for every k that is a multiple of ``every``."""
    w = Window.partitionBy(key).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = results.select(key, F.row_number().over(w).alias("k"), F.avg(estimate).over(so_far).alias("mean"), F.var_samp(estimate).over(so_far).alias("variance"))
    return rows.where(F.col("k") % every == 0)


def bootstrap_variance(rows: DataFrame, unit: str, value: str, reps: int, share: float, seed: int) -> DataFrame:
    """(rep, n, variance): sample variances of hashed subsets; each row is tested once for each replicate."""
    each = rows.select(unit, value, F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    return each.where(uniform(seed, F.col("rep"), F.col(unit)) < share).groupBy("rep").agg(F.count("*").alias("n"), F.var_samp(value).alias("variance"))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): counts by equal bins; 0 and bins + 1 are what lies outside."""
    return rows.groupBy(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
