"""Running statistics of replicates that arrive as a stream; an extension of the batch harness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_totals(stream: DataFrame, key: str = "scenario_id", estimate: str = "estimate") -> DataFrame:
    """Count, sum and sum of squares of each scenario so far; for update or complete mode."""
    return stream.groupBy(key).agg(F.count("*").alias("n"), F.sum(estimate).alias("s"), F.sum(F.col(estimate) * F.col(estimate)).alias("ss"))


def summary(totals: DataFrame) -> DataFrame:
    """Mean and sample variance of such totals."""
    return totals.select("*", (F.col("s") / F.col("n")).alias("mean"), F.when(F.col("n") > 1, (F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)).alias("variance"))


def windowed_failures(stream: DataFrame, time: str, failed: str, width: str = "10 minutes", late: str = "20 minutes") -> DataFrame:
    """Share of failed worlds in event-time windows, with late rows up to a watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("n"), F.count_if(failed).alias("n_failed"))
