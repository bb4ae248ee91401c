"""Shuffle files that nothing refers to any more go at the next release."""

import os
import time

from tidegraph.llm import components, skew
from tidegraph.llm.lineage import cut, release


def test_release_drops_shuffle_files(spark):
    tops = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {n for top in tops for _, _, names in os.walk(top) for n in names if n.startswith("shuffle_")}
    before = files()
    kept = cut(spark.range(1000).repartition(3, "id"))
    made = files() - before
    release(spark)
    for _ in range(40):  # the cleaner works beside
        if not made & files():
            break
        time.sleep(0.1)
    assert made and not made & files() and kept.count() == 1000


def test_sides_that_grow_are_not_broadcast(spark):
    large, small = spark.range(2000).selectExpr("id % 700 as k", "id"), spark.range(700).selectExpr("id as k", "id * 2 as x")
    got = skew.join_spread(large, small, ["k"])
    assert got.where("x = 2 * k").count() == 2000
    rows = got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(rows) == 2000 and "SortMergeJoin" in plan.split("== Initial Plan ==")[0]  # the only broadcasts are marks of hot keys


def test_rounds_of_components_do_not_multiply_estimates(spark):
    got = components.components(spark.range(60).selectExpr("id as a", "id + 1 as b"))
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 40
    assert {(x.node, x.component) for x in got.collect()} == {(v, 0) for v in range(61)}
