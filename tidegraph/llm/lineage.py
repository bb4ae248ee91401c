"""Cutting lineage where every executor can read the result."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Seconds after which Py4J, which looks ten times a second, has told the JVM what Python dropped.
TOLD = 0.3


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, as in tests, one of our own."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="tidegraph-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the rows do not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bytes_of(df: DataFrame) -> int | None:
    """Spark's estimate of the size of the rows, from the sizes of the files they come from; None where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 58 else None


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files, broadcasts and checkpoints that nothing refers to any more, before the next large step."""
    for _ in range(2):  # the first frees the plans that hold a shuffle, the second what they held
        gc.collect()
        time.sleep(TOLD)  # until then the JVM holds what Python dropped
        spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table of their own in the shared folder, read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
