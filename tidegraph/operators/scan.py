"""Running sums and other scans over ordered rows that no single task sees.

Rows are dealt into parts by ranges of their order.  Each part's total is formed on
its own; the totals go up a tree whose nodes have a bounded number of children and
come down again as what lies before and after each part; then each part is scanned
with what lies before it.  The total may be anything with an associative ``combine``:
a number, a polynomial, a map between states.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.plans.lineage import cut

Combine = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Rows of a part, about, and children of a node of the tree.
PART_ROWS, FAN = 1 << 20, 256


def dealt(rows: DataFrame, order: Sequence[str], part_rows: int = PART_ROWS) -> DataFrame:
    """The rows with ``part``, their range in the order, kept in the shared folder so that parts stay as they are.

    The order should tell rows apart, or rows that share a place share a part.
    """
    n = rows.count()
    return cut(rows.repartitionByRange(max(1, -(-n // part_rows)), *order).withColumn("part", F.spark_partition_id().cast("long")))


def around(parts: DataFrame, combine: Combine, identity: Sequence, fan: int = FAN) -> DataFrame:
    """(part, before, after): what all earlier and all later parts of (part, value) make together; values are arrays."""
    kind = parts.schema["value"].dataType.simpleString()
    parts = cut(parts.select("part", "value"))
    none = np.array(identity)

    def together(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("part")
        return pd.DataFrame({"part": [f["up"].iloc[0]], "value": [reduce(combine, f["value"])]})

    def between(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("part")
        before, after = [f["before"].iloc[0]], [f["after"].iloc[0]]
        values = list(f["value"])
        for v in values[:-1]:
            before.append(combine(before[-1], v))
        for v in values[:0:-1]:
            after.append(combine(v, after[-1]))
        return pd.DataFrame({"part": f["part"], "before": before, "after": after[::-1]})

    up = parts.withColumn("up", F.expr(f"part div {fan}"))
    if parts.count() <= fan:
        # as many rows as a node has children
        edge = F.array(*(F.lit(x) for x in none.tolist())).cast(kind)
        whole = parts.withColumns({"up": F.lit(0).cast("long"), "before": edge, "after": edge})
    else:
        above = around(up.groupBy("up").applyInPandas(together, f"part long, value {kind}"), combine, identity, fan)
        whole = up.join(above.withColumnRenamed("part", "up"), "up")
    return whole.groupBy("up").applyInPandas(between, f"part long, before {kind}, after {kind}")


def prefix_sums(rows: DataFrame, order: Sequence[str], sums: dict[str, str], part_rows: int = PART_ROWS) -> DataFrame:
    """Add a column for each of ``sums`` (name: column): the column's sum over the rows up to and with this one.

    The order must tell rows apart.  Sums of whole numbers are exact.
    """
    parts = dealt(rows, order, part_rows)
    columns = list(sums.values())
    totals = parts.groupBy("part").agg(F.array(*(F.coalesce(F.sum(c), F.lit(0)) for c in columns)).alias("value"))
    before = around(totals, lambda a, b: a + b, [0] * len(columns)).select("part", "before")
    w = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parts.join(before, "part")
    return placed.select(*rows.columns, *((F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col("before")[k]).alias(name) for k, (name, c) in enumerate(sums.items())))


def latest(points: DataFrame, marks: DataFrame, place: str, mark: str, part_rows: int = PART_ROWS) -> DataFrame:
    """The points with ``mark`` of the last mark at or before their place, null if there is none.

    Points and marks are sorted together, so many points after one mark spread
    over parts; marks share no place.
    """
    kind = marks.schema[mark].dataType.simpleString()
    own = marks.select(F.col(place), F.lit(0).alias("_point"), F.col(mark), *(F.lit(None).cast(f.dataType).alias(f.name) for f in points.schema if f.name != place))
    both = points.select(F.col(place), F.lit(1).alias("_point"), F.lit(None).cast(kind).alias(mark), *(c for c in points.columns if c != place))
    parts = dealt(own.unionByName(both), [place, "_point"], part_rows)
    totals = parts.groupBy("part").agg(F.max_by(F.when(F.col("_point") == 0, F.array(mark)), F.when(F.col("_point") == 0, F.col(place))).alias("value")).withColumn("value", F.coalesce("value", F.array().cast(f"array<{kind}>")))
    before = around(totals, lambda a, b: b if len(b) else a, []).select("part", "before")
    w = Window.partitionBy("part").orderBy(place, "_point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = parts.join(before, "part").select(*points.columns, "_point", F.coalesce(F.last(mark, True).over(w), F.try_element_at("before", F.lit(1))).alias(mark))
    return found.where("_point = 1").drop("_point")
