"""Horvitz-Thompson estimates and variances of samples that are drawn layer by layer, on tables.

A layer's units come from the sampled units of the layer above; units that are equal
merge and keep their lineage: from whom they came, and with what share.  Each layer
is sampled anew.  Estimates and covariances go back up the lineage, a layer at a time:

    z(u)      = sum over the sampled children c of share(u, c) z(c) / pi(c)
    cov(u, v) = sum over pairs c, d of share(u, c) share(v, d) k(c, d)
    k(c, d)   = (1 - pi(c) pi(d) / pi(c, d)) z(c) z(d) / (pi(c) pi(d)) + cov(c, d) / pi(c, d)

with pi(c, c) = pi(c).  The variance is unbiased when each layer's inclusion
probabilities are right given the layers above.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.plans.lineage import cut


def merged(children: DataFrame, key: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Children (parent, share, key...) that agree on the key as one unit: (by..., key..., weight, lineage).

    ``weight`` is the sum of shares, ``lineage`` an array of (parent, share), a parent
    once however often it leads here.
    """
    once = children.groupBy(*by, *key, "parent").agg(F.sum("share").alias("share"))
    return once.groupBy(*by, *key).agg(F.sum("share").alias("weight"), F.array_sort(F.collect_list(F.struct("parent", "share"))).alias("lineage"))


def links(units: DataFrame, unit: str = "unit", by: Sequence[str] = ()) -> DataFrame:
    """(by..., parent, unit, share) of merged units."""
    return units.select(*by, F.col(unit).alias("unit"), F.explode("lineage").alias("x")).select(*by, "x.parent", "unit", "x.share")


def up(sampled: DataFrame, joint: DataFrame, lineage: DataFrame, cov: DataFrame | None = None, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Estimates (by..., unit, z) and covariances (by..., a, b, cov) of the layer above.

    ``sampled`` has (by..., unit, z) of the layer's sampled units, ``joint`` (by..., a, b,
    pi_ab) of all their pairs in both orders, a unit with itself included, ``lineage``
    (by..., parent, unit, share), ``cov`` (by..., a, b, cov) of this layer's estimates, none
    where they are known.  A parent without a sampled child gets no row: its estimate
    is 0.
    """
    by = list(by)
    own = joint.where("a = b").select(*by, F.col("a").alias("unit"), F.col("pi_ab").alias("pi"))
    known = sampled.join(own, [*by, "unit"]).select(*by, "unit", "z", "pi")
    z = lineage.join(known, [*by, "unit"]).groupBy(*by, F.col("parent").alias("unit")).agg(F.sum(F.col("share") * F.col("z") / F.col("pi")).alias("z"))
    one = known.select(*by, F.col("unit").alias("a"), F.col("z").alias("za"), F.col("pi").alias("pa"))
    two = known.select(*by, F.col("unit").alias("b"), F.col("z").alias("zb"), F.col("pi").alias("pb"))
    pairs = joint.join(one, [*by, "a"]).join(two, [*by, "b"])
    if cov is not None:
        pairs = pairs.join(cov, [*by, "a", "b"], "left")
    inner = F.coalesce("cov", F.lit(0.0)) if cov is not None else F.lit(0.0)
    product = F.col("pa") * F.col("pb")
    k = (1 - product / F.col("pi_ab")) * F.col("za") * F.col("zb") / product + inner / F.col("pi_ab")
    left = lineage.select(*by, F.col("unit").alias("a"), F.col("parent").alias("u"), F.col("share").alias("su"))
    right = lineage.select(*by, F.col("unit").alias("b"), F.col("parent").alias("v"), F.col("share").alias("sv"))
    # one side at a time, summed in between: rows are parents by units, not parents by parents by pairs
    half = pairs.select(*by, "a", "b", k.alias("k")).join(left, [*by, "a"]).groupBy(*by, "u", "b").agg(F.sum(F.col("su") * F.col("k")).alias("k"))
    out = half.join(right, [*by, "b"]).groupBy(*by, F.col("u").alias("a"), F.col("v").alias("b")).agg(F.sum(F.col("sv") * F.col("k")).alias("cov"))
    return z, out


def estimate(layers: Sequence[tuple[DataFrame, DataFrame]], leaves: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Estimate and covariance of the units above the first layer.

    ``layers`` are (joint, lineage) from the top down, ``leaves`` the values (by..., unit,
    z) of the last layer's sampled units.
    """
    z, cov = leaves, None
    for joint, lineage in reversed(layers):
        z, cov = up(z, joint, lineage, cov, by)
        z, cov = cut(z), cut(cov)
    return z, cov
