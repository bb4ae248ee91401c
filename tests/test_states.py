"""States of worlds."""

from pyspark.sql import functions as F

from tidegraph.functions.states import decode


def test_a_world_is_formed_once(spark):
    """All edges of a world go by the same draw, so a world that is up or down as a whole stays so."""
    drawn = (F.floor(F.rand(3) * 2) * 15).cast("long")
    rows = [tuple(x.state) for x in spark.range(64).select(decode(drawn, 4).alias("state")).collect()]
    assert set(rows) == {(4,) * 4, (8,) * 4}
