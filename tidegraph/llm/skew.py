"""Joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on, so there are fewer than 1 / HOT hot keys.
HOT = 1 / 1000
#: Rows below which no key is hot, and parts that a hot key is spread over.
LEAST, PARTS = 500, 32


def join_spread(large: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", total: int | None = None, share: DataFrame | None = None) -> DataFrame:
    """``large`` joined with ``small``, which has few rows a key; rows of a hot key go to many tasks.

    The hot keys of ``large``, fewer than 1 / HOT by their definition, are broadcast
    as marks; ``small`` has its rows of those keys once a part and is never broadcast,
    since it may grow with the input and the driver would have to build it.  ``large`` is read
    twice and should be written or checkpointed; ``total`` is its number of rows and
    ``share`` that of each key as ``_n``, if known.  Null keys match nothing and are
    spread too.
    """
    share = large.groupBy(*keys).agg(F.count("*").alias("_n")) if share is None else share
    total = large.count() if total is None else total
    hot = F.broadcast(share.where(F.col("_n") > max(LEAST, total * HOT)).select(*keys, F.lit(True).alias("_hot")))
    others = [c for c in large.columns if c not in keys]
    null = F.coalesce(*(F.when(F.col(k).isNull(), F.lit(True)) for k in keys))
    spread = F.when(F.coalesce("_hot", null), F.pmod(F.xxhash64(*others) if others else F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")).otherwise(0)
    left = large.join(hot, keys, "left").withColumn("_part", spread).drop("_hot")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    right = small.join(hot, keys, "left").withColumn("_part", F.explode(parts)).drop("_hot")
    return left.join(right.hint("merge"), [*keys, "_part"], how).drop("_part")
