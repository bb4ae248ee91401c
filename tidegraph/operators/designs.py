"""Samples of fixed size with unequal probabilities: conditional Poisson and Sampford's design on tables.

A design of fixed size is a Poisson sample, in which unit i is taken with probability
p, given that n units were taken.  How many units a stretch of the order takes is a
polynomial whose coefficients are probabilities, so nothing overflows; stretches are
multiplied along a tree (``scan.around``).  Going through the units in order, a unit
is taken with the share of its two ways to end at n; what a stretch does to the
number of places left is a map, known before the number is, and maps are combined
along the same tree.  So the sample is that of one pass over all units with one
uniform each, though no task sees them all.

Sampford's design is the same with one of the taken units marked, the mark weighing
1 - pi: its generating function is sum over samples of prod pi / (1 - pi) times sum
(1 - pi).  Marks double the states; no sample is rejected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.states import uniform
from tidegraph.operators.scan import around, dealt
from tidegraph.sources.graphs import sample_size

#: Numbers that the table of a stretch may hold.
CELLS = 1 << 22


def _times(a: np.ndarray, b: np.ndarray, marks: int) -> np.ndarray:
    """Product of two stretches: coefficients 0..n without a mark, then, if there are marks, with one."""
    n = len(a) // (1 + marks)
    a, b = np.asarray(a).reshape(-1, n), np.asarray(b).reshape(-1, n)
    cut = lambda x, y: np.convolve(x, y)[:n]
    if not marks:
        return cut(a[0], b[0])
    return np.r_[cut(a[0], b[0]), cut(a[0], b[1]) + cut(a[1], b[0])]


def _start(n: int, marks: int) -> np.ndarray:
    out = np.zeros((n + 1) * (1 + marks))
    out[0] = 1.0
    return out


def _grown(x: np.ndarray, p: float, weight: float) -> np.ndarray:
    """A stretch (rows: without, with a mark) and one more unit."""
    out = x * (1 - p)
    out[:, 1:] += p * x[:, :-1]
    if len(x) > 1:
        out[1, 1:] += p * weight * x[0, :-1]
    return out


def _tails(p: np.ndarray, weight: np.ndarray, after: np.ndarray, n: int, marks: int) -> np.ndarray:
    """Stretch from each unit to the end; the last is what lies after the part."""
    out = np.empty((len(p) + 1, 1 + marks, n + 1))
    out[-1] = np.asarray(after).reshape(1 + marks, n + 1)
    for i in range(len(p) - 1, -1, -1):
        out[i] = _grown(out[i + 1], p[i], weight[i])
    return out


def _step(state: np.ndarray, u: float, p: float, weight: float, tail: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """States (left + marked * (n + 1)) after a unit: the places left are fewer by one where it is taken.

    ``tail`` is the stretch from the unit on, ``rest`` the one behind it.  The interval of
    the uniform is cut into taken with the mark, taken without, not taken.
    """
    n = rest.shape[1]
    left, mark = state % n, state // n
    some = left > 0
    before = np.maximum(left - 1, 0)
    total = tail[mark, left]
    marked = np.where(some & (mark > 0), p * weight * rest[0, before], 0.0) if len(rest) > 1 else np.zeros(len(state))
    plain = np.where(some, p * rest[mark, before], 0.0)
    at = u * total
    take_marked, take = at < marked, (at >= marked) & (at < marked + plain)
    return np.where(take_marked, before, np.where(take, before + mark * n, state))


def fixed_size_sample(units: DataFrame, unit: str, p: str, n: int, seed: int, *, weight: str | None = None, part_rows: int | None = None) -> DataFrame:
    """The units with ``pi``, ``taken`` and their other columns: n of them are taken, as in Poisson sampling by ``p`` given n.

    With ``weight`` one taken unit is marked and a sample counts by the sum of its
    units' weights.  Units must be distinct, with p in [0, 1); n of them at least
    must have p above 0.  Each unit has one uniform, by its name and the seed.
    """
    sample_size(n)
    marks = 1 if weight else 0
    states = (n + 1) * (1 + marks)
    rows = units.withColumns({"_p": F.col(p).cast("double"), "_w": (F.col(weight) if weight else F.lit(0)).cast("double"), "_u": uniform(seed, F.col(unit))})
    parts = dealt(rows, [unit], part_rows or max(1, CELLS // states))
    small = parts.select("part", unit, "_p", "_w", "_u")

    def product(f: pd.DataFrame) -> pd.DataFrame:
        x = _start(n, marks).reshape(1 + marks, n + 1)
        for q, w in zip(f["_p"].tolist(), f["_w"].tolist()):
            x = _grown(x, q, w)
        return pd.DataFrame({"part": [f["part"].iloc[0]], "value": [x.ravel()]})

    polynomials = small.groupBy("part").applyInPandas(product, "part long, value array<double>")
    context = around(polynomials, lambda a, b: _times(a, b, marks), _start(n, marks).tolist())

    def table(f: pd.DataFrame, c: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        f = f.sort_values(unit)
        q, w = f["_p"].to_numpy(), f["_w"].to_numpy()
        return f, _tails(q, w, c["after"].iloc[0], n, marks), np.stack([q, w, f["_u"].to_numpy()], 1)

    def transitions(f: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        f, tails, each = table(f, c)
        state = np.arange(states)
        for i, (q, w, u) in enumerate(each.tolist()):
            state = _step(state, u, q, w, tails[i], tails[i + 1])
        return pd.DataFrame({"part": [f["part"].iloc[0]], "value": [state]})

    # what lies around a part comes once a part, not once a unit
    maps = small.groupBy("part").cogroup(context.groupBy("part")).applyInPandas(transitions, "part long, value array<long>")
    came = around(maps, lambda a, b: b[a], list(range(states))).select("part", F.col("before").alias("came"))

    def chosen(f: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        f, tails, each = table(f, c)
        head = np.asarray(c["before"].iloc[0]).reshape(1 + marks, n + 1)
        state = np.array([c["came"].iloc[0][n + marks * (n + 1)]])
        total = float(head[0] @ tails[0][marks, ::-1] + (head[1] @ tails[0][0, ::-1] if marks else 0.0))
        pi, taken = [], []
        for i, (q, w, u) in enumerate(each.tolist()):
            rest = tails[i + 1][:, n - 1 :: -1]
            ways = head[0, :n] @ rest[marks]
            if marks:
                ways += head[1, :n] @ rest[0] + w * (head[0, :n] @ rest[0])
            pi.append(q * float(ways) / total)
            after = _step(state, u, q, w, tails[i], tails[i + 1])
            taken.append(bool(after[0] % (n + 1) != state[0] % (n + 1)))
            head, state = _grown(head, q, w), after
        return pd.DataFrame({"part": f["part"], unit: f[unit], "pi": pi, "taken": taken})

    kind = units.schema[unit].dataType.simpleString()
    out = small.groupBy("part").cogroup(context.join(came, "part").groupBy("part")).applyInPandas(chosen, f"part long, `{unit}` {kind}, pi double, taken boolean")
    kept = [c for c in units.columns if c not in ("pi", "taken")]
    return parts.select("part", *kept).join(out, ["part", unit]).select(*kept, "pi", "taken")


def working_odds(units: DataFrame, size: str, n: int) -> DataFrame:
    """Add ``p`` = s * size / (1 + s * size) for conditional Poisson sampling in proportion to size, s near sum p = n.

    Any s gives the same design; this one keeps the polynomials' coefficients around n large.
    """
    size_of = F.col(size).cast("double")
    total = units.where(size_of > 0).agg(F.sum(size_of).alias("t"), F.count("*").alias("n")).first()
    if total["n"] < n:
        raise ValueError(f"{total['n']} units with a size above 0 do not make a sample of {n}")
    s = n / total.t if total.t else 0.0
    for _ in range(8):  # a few steps of Newton's method on sum p
        x = F.lit(s) * size_of
        got = units.where(size_of > 0).agg(F.sum(x / (1 + x)).alias("f"), F.sum(x / ((1 + x) * (1 + x))).alias("d")).first()
        if abs(got.f - n) < 0.01 or not got.d:
            break
        s *= float(np.exp(np.clip((n - got.f) / got.d, -2, 2)))
    x = F.lit(s) * F.greatest(size_of, F.lit(0.0))
    return units.withColumn("p", x / (1 + x))


def conditional_poisson_sample(units: DataFrame, unit: str, size: str, n: int, seed: int, part_rows: int | None = None) -> DataFrame:
    """n units, a sample's probability in proportion to the product of its sizes: the units' columns, ``p``, ``pi`` and ``taken``, for all units."""
    return fixed_size_sample(working_odds(units, size, n), unit, "p", n, seed, part_rows=part_rows)


def sampford_sample(units: DataFrame, unit: str, pi: str, n: int, seed: int, part_rows: int | None = None) -> DataFrame:
    """n units, of which those with ``pi`` = 1 are certain, by Sampford's design: adds ``taken``.

    ``pi`` sums to n; the inclusion probabilities are exactly these.
    """
    sure = units.where(F.col(pi) >= 1)
    k = sure.count()
    rest = units.where(F.col(pi) < 1).withColumns({"_q": F.col(pi), "_mark": 1 - F.col(pi)})
    certain = sure.withColumn("taken", F.lit(True))
    if k >= n:
        return certain.unionByName(units.where(F.col(pi) < 1).withColumn("taken", F.lit(False)))
    got = fixed_size_sample(rest, unit, "_q", n - k, seed, weight="_mark", part_rows=part_rows)
    return certain.unionByName(got.select(*units.columns, "taken"))


def joint_inclusion(sampled: DataFrame, unit: str, n: int) -> DataFrame:
    """(a, b, pi_ab) for all pairs of the taken units of ``fixed_size_sample`` without marks, a = b included (``pi``).

    The units that are not taken enter as one product of the tree's; each taken unit
    is a task's work, with the n others as small arrays.  Sums of positive products
    throughout.
    """
    others = dealt(sampled.where("not taken").select(unit, "p"), [unit], max(1, CELLS // (n + 1)))

    def product(f: pd.DataFrame) -> pd.DataFrame:
        x = _start(n, 0).reshape(1, n + 1)
        for q in f["p"].tolist():
            x = _grown(x, q, 0.0)
        return pd.DataFrame({"part": [f["part"].iloc[0]], "value": [x.ravel()]})

    polynomials = others.groupBy("part").applyInPandas(product, "part long, value array<double>")
    whole = around(polynomials, lambda a, b: _times(a, b, 0), _start(n, 0).tolist()).join(polynomials, "part").where("part = 0")
    rest = whole.select(F.struct("value", "after").alias("r")).first()  # two polynomials
    r = _times(np.array(rest.r["value"]), np.array(rest.r["after"]), 0) if rest else _start(n, 0)
    own = sampled.where("taken").select(unit, "p", "pi").orderBy(unit).collect()  # the sample, n rows
    names, p, pi = [x[0] for x in own], np.array([x.p for x in own]), np.array([x.pi for x in own])
    held = sampled.sparkSession.sparkContext.broadcast((names, p, pi, r))

    def pairs(frames):
        names, p, pi, r = held.value
        m = len(names)
        everything = r.reshape(1, -1)
        for q in p.tolist():
            everything = _grown(everything, q, 0.0)
        total = everything[0, m]
        for f in frames:
            for i in f["i"].tolist():
                rest = [k for k in range(m) if k != i]
                tail = np.empty((m, n + 1))
                tail[m - 1] = r
                for t in range(m - 2, -1, -1):
                    tail[t] = _grown(tail[t + 1][None], p[rest[t]], 0.0)[0]
                head = _start(n, 0)[None]
                value = np.full(m, pi[i])
                for t, j in enumerate(rest):
                    if m >= 2:
                        value[j] = p[i] * p[j] * float(head[0, : m - 1] @ tail[t + 1][m - 2 :: -1][: m - 1]) / total
                    head = _grown(head, p[j], 0.0)
                yield pd.DataFrame({"a": [names[i]] * m, "b": names, "pi_ab": value})

    kind = sampled.schema[unit].dataType.simpleString()
    rows = sampled.sparkSession.range(len(names)).select(F.col("id").alias("i")).repartition(max(1, min(len(names), sampled.sparkSession.sparkContext.defaultParallelism)))
    return rows.mapInPandas(pairs, f"a {kind}, b {kind}, pi_ab double")
