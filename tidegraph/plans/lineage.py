"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task makes of its own, about, where a query makes many rows or much work of one.
TASK_ROWS = 1 << 20


def _folder(spark: SparkSession) -> str:
    """The folder of the checkpoints; one of our own where spark.checkpoint.dir is unset, as in tests."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="tidegraph-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept in the folder of the checkpoints."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once, as a Parquet table in the folder of the checkpoints.

    For rounds that join their own results: a checkpoint keeps Spark's estimate of its
    size, a join's estimate is the product of its sides', and so the estimates of such
    rounds become numbers of millions of digits.  A table has the size of its files.
    """
    path = shared_path(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A place of its own for a table in the folder of the checkpoints."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def spread(rows: DataFrame, key: str, each: int = 1) -> DataFrame:
    """The rows dealt by their key over tasks that make ``TASK_ROWS`` rows at most, ``each`` of one row; files are split by their bytes alone."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() * each // TASK_ROWS))
    return rows.repartition(tasks, key)
