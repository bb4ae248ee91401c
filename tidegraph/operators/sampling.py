"""Unequal-probability sampling designs: on DataFrames, and on small arrays inside kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.states import uniform
from tidegraph.operators.scan import PART_ROWS, latest, prefix_sums
from tidegraph.plans.lineage import cut, kept

# --- on DataFrames -------------------------------------------------------------


def inclusion_table(units: DataFrame, size: str, n: int) -> DataFrame:
    """Add ``pi``, proportional to size with sum n and at most 1: units that would exceed 1 are certain, the rest share what is left."""
    c = threshold_scale(units, size, n)
    if np.isinf(c):
        return units.withColumn("pi", F.when(F.col(size) > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return units.withColumn("pi", F.least(F.lit(c) * F.col(size), F.lit(1.0)))


def pareto_sample(units: DataFrame, unit: str, n: int, seed: int) -> DataFrame:
    """The n units with the smallest odds of a uniform against the odds of ``pi``; certain units come first.  A distributed top n."""
    u = uniform(seed, F.col(unit))
    key = F.when(F.col("pi") >= 1, F.lit(-1.0)).otherwise((u / (1 - u)) / (F.col("pi") / (1 - F.col("pi"))))
    return units.withColumn("key", key).orderBy("key", unit).limit(n)


def threshold_scale(units: DataFrame, size: str, n: int, part_rows: int = PART_ROWS) -> float:
    """c with sum(min(1, c * size)) = n, from running sums over the distinct sizes; infinite if no more than n units have a size above 0.

    Fewer than n units are certain, so the n greatest sizes are all that the sums need.
    """
    ranked = units.where(F.col(size) > 0).groupBy(size).agg(F.count("*").alias("k")).select(size, (-F.col(size)).alias("fall"), "k", (F.col(size) * F.col("k")).alias("t"))
    whole = units.where(F.col(size) > 0).agg(F.sum(size).alias("t"), F.count("*").alias("k")).first()
    if whole.k <= n:
        return float("inf")
    if n <= part_rows:
        ranked = cut(ranked.orderBy("fall").limit(n))
    # the units from a size on are certain if the scale that this leaves to the others makes it so; the last such size counts
    rows = prefix_sums(ranked, ["fall"], {"above": "k", "upto": "t"}, part_rows).where(F.col("above") < n)
    c = (F.lit(n) - F.col("above")) / (F.lit(whole.t) - F.col("upto"))
    last = rows.select(c.alias("c"), size).where(F.col("c") * F.col(size) >= 1).agg(F.max("c").alias("c")).first()
    return float(n / whole.t if last.c is None else last.c)


def threshold_sample(units: DataFrame, unit: str, size: str, n: int, seed: int, part_rows: int = PART_ROWS) -> DataFrame:
    """Threshold sampling: units with c * size >= 1 stay with their weight; of the rest a systematic sample gets weight 1 / c.

    The rest lie one after another on a line in the order of ``unit``, which must be
    distinct; one uniform starts the systematic sample.  Units are computed once.
    """
    units = kept(units.where(F.col(size) > 0).select(unit, size))
    c = threshold_scale(units, size, n, part_rows)
    if np.isinf(c):
        return units.select(unit, size, F.lit(1.0).alias("mass"), F.col(size).cast("double").alias("weight"))
    rows = units.withColumn("mass", F.lit(c) * F.col(size))
    sure = rows.where("mass >= 1").select(unit, size, "mass", F.col(size).cast("double").alias("weight"))
    placed = prefix_sums(rows.where("mass < 1"), [unit], {"upto": size}, part_rows)
    at = lambda x: F.floor(F.lit(c) * x - uniform(seed, "start"))
    taken = placed.where(at(F.col("upto")) > at(F.col("upto") - F.col(size)))
    return sure.unionByName(taken.select(unit, size, "mass", F.lit(1 / c).alias("weight")))


def alias_draws(units: DataFrame, unit: str, size: str, draws: int, seed: int, part_rows: int = PART_ROWS) -> DataFrame:
    """(draw, unit): draws with replacement in proportion to size.

    Units lie one after another on a line in the order of ``unit``, which must be
    distinct; a draw is a place on it and finds the last unit that begins before.
    """
    units = kept(units.where(F.col(size) > 0).select(unit, size))
    placed = prefix_sums(units, [unit], {"upto": size}, part_rows)
    marks = placed.select((F.col("upto") - F.col(size)).cast("double").alias("place"), unit)
    total = units.agg(F.sum(size).alias("total")).first().total
    if not total:
        return marks.select(F.lit(0).cast("long").alias("draw"), unit)
    points = units.sparkSession.range(draws).select(F.col("id").alias("draw"), (uniform(seed, F.col("id")) * F.lit(total)).alias("place"))
    return latest(points, marks, "place", unit, part_rows).select("draw", unit)


def horvitz_thompson(sample: DataFrame, value: str, pi: str = "pi") -> DataFrame:
    """(total, variance) of independent inclusions: sum of y / pi, and of (1 - pi) (y / pi)^2."""
    y = F.col(value) / F.col(pi)
    return sample.agg(F.sum(y).alias("total"), F.sum((1 - F.col(pi)) * y * y).alias("variance"))


# --- inside kernels ------------------------------------------------------------


def inclusion(sizes: np.ndarray, n: int) -> np.ndarray:
    """As ``inclusion_table`` for an array."""
    pi, sure = np.zeros(len(sizes)), np.zeros(len(sizes), bool)
    if n >= (sizes > 0).sum():
        return (sizes > 0).astype(float)
    while True:
        left = n - sure.sum()
        pi = np.where(sure, 1.0, sizes * left / sizes[~sure].sum())
        over = ~sure & (pi >= 1)
        if not over.any():
            return pi
        sure |= over


def systematic(pi: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A sample with exactly these inclusion probabilities, systematic over a random order."""
    order = rng.permutation(len(pi))
    edges = np.floor(np.cumsum(pi[order]) + rng.random() + 1e-12)
    return np.sort(order[np.diff(edges, prepend=0.0) > 0])


def sampford(pi: np.ndarray, rng: np.random.Generator, tries: int = 2000) -> np.ndarray:
    """Sampford's rejective design; where it is not accepted within ``tries``, a systematic sample, which has the same inclusion probabilities."""
    sure, maybe = np.flatnonzero(pi >= 1 - 1e-12), np.flatnonzero((pi > 0) & (pi < 1 - 1e-12))
    n = round(float(pi[maybe].sum()))
    if n == 0:
        return sure
    first, other = pi[maybe] / pi[maybe].sum(), pi[maybe] / (1 - pi[maybe])
    a, b = np.cumsum(first), np.cumsum(other / other.sum())
    for _ in range(tries):
        got = {int(np.searchsorted(a, rng.random() * a[-1], "right"))}
        rest = np.searchsorted(b, rng.random(n - 1) * b[-1], "right")
        got.update(rest.tolist())
        if len(got) == n:
            return np.sort(np.r_[sure, maybe[sorted(got)]])
    return np.sort(np.r_[sure, maybe[systematic(pi[maybe], rng)]])


def _symmetric(w: np.ndarray, n: int) -> np.ndarray:
    """Elementary symmetric polynomials 0..n of the weights."""
    e = np.zeros(n + 1)
    e[0] = 1.0
    for x in w:
        e[1:] = e[1:] + x * e[:-1]
    return e


def conditional_poisson(w: np.ndarray, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sample of n units with probability in proportion to the product of their weights, all inclusion probabilities, and the joint ones of the sample."""
    w = w / w.max()
    size = len(w)
    tail = np.zeros((size + 1, n + 1))
    tail[size, 0] = 1.0
    for i in range(size - 1, -1, -1):
        tail[i] = tail[i + 1]
        tail[i, 1:] += w[i] * tail[i + 1, :-1]
    chosen, left = [], n
    for i in range(size):
        if left and rng.random() * tail[i, left] < w[i] * tail[i + 1, left - 1]:
            chosen.append(i)
            left -= 1
    total = tail[0, n]
    pi = np.array([w[i] * _symmetric(np.delete(w, i), n - 1)[n - 1] for i in range(size)]) / total
    s = np.array(chosen)
    joint = np.diag(pi[s])
    for x in range(n):
        for y in range(x):
            rest = _symmetric(np.delete(w, [s[x], s[y]]), n - 2)[n - 2] if n > 1 else 0.0
            joint[x, y] = joint[y, x] = w[s[x]] * w[s[y]] * rest / total
    return s, pi, joint


def threshold(sizes: np.ndarray, n: int, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Sample of about n units and the scale c: units with c * size >= 1 are certain, the rest systematic with probability c * size."""
    if n >= len(sizes):
        return np.arange(len(sizes)), np.inf
    order = np.sort(sizes)[::-1]
    below = np.cumsum(order[::-1])[::-1]
    c = n / sizes.sum()
    for k in range(n):
        c = (n - k) / below[k]
        if c * order[k] < 1:
            break
    mass = np.minimum(c * sizes, 1.0)
    sure, rest = np.flatnonzero(mass >= 1), np.flatnonzero(mass < 1)
    edges = np.floor(np.cumsum(mass[rest]) + rng.random() + 1e-12)
    return np.sort(np.r_[sure, rest[np.diff(edges, prepend=0.0) > 0]]), c


def alias(weights: np.ndarray, draws: int, rng: np.random.Generator) -> np.ndarray:
    """Draws with replacement by the alias method."""
    n = len(weights)
    share = weights * n / weights.sum()
    other = np.arange(n)
    small, large = [i for i in range(n) if share[i] < 1], [i for i in range(n) if share[i] >= 1]
    while small and large:
        s, g = small.pop(), large.pop()
        other[s] = g
        share[g] -= 1 - share[s]
        (small if share[g] < 1 else large).append(g)
    k = rng.integers(0, n, draws)
    return np.where(rng.random(draws) < share[k], k, other[k])
