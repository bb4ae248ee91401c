"""Embedding whitening by bit-sliced scatter.

Vectors become whole numbers.  A task takes its distinct vectors in blocks, shifts
each dimension to start at 0 and packs every bit plane of a dimension across the
rows of the block into 64-bit words.  The cross-product of two dimensions is the
sum of 2^(a+b) times the number of ones that plane a of the one and plane b of the
other have in common, so AND and popcount give it exactly.  Blocks and tasks are
added up in whole numbers, the covariance is centred in whole numbers too, and only
then divided and decomposed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.lineage import written
from tidegraph.llm.textkit import tidy

SCALE, COMPONENTS = 256, 4
#: Rows of a block, at most so many entries of it, and words that one step of AND and popcount holds.
ROWS, ENTRIES, WORDS = 1 << 14, 1 << 21, 1 << 20
#: Sums travel as limbs of 32 bits, the last with the sign.
LIMBS = 6
_LIMB = (1 << 32) - 1
_LONG = (1 << 63) - 1


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, x): floor(scale * c) of each entry c as a long, the nearest long where none holds it.

    Rows whose vector is null, or holds a null or a number that is not finite, are
    left out.  Other columns are ignored; an id may be null or repeat.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    fine = rows.where(F.forall("v", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c)))
    return fine.select("id", F.transform("v", lambda c: F.floor(c * scale)).alias("x"))


def bit_planes(y: np.ndarray) -> np.ndarray:
    """Planes of the non-negative numbers y (rows, dims): words (bit, dimension, word), a bit a row."""
    rows, dims = y.shape
    bits = int(y.max(initial=0)).bit_length()
    words = -(-rows // 64)
    out = np.zeros((bits, dims, words), np.uint64)
    for b in range(bits):
        packed = np.packbits(((y >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=0, bitorder="little")
        full = np.zeros((words * 8, dims), np.uint8)
        full[: len(packed)] = packed
        out[b] = np.ascontiguousarray(full.T).view(np.uint64)
    return out


def cross_products(y: np.ndarray) -> np.ndarray:
    """Exact sums of y[:, i] * y[:, j] as whole numbers, from the bit planes."""
    planes = bit_planes(y)
    bits, dims, words = planes.shape
    small = len(y) << 2 * bits <= _LONG
    total = np.zeros((dims, dims), np.int64 if small else object)
    step = max(1, WORDS // max(1, dims * words))
    for a in range(bits):
        for b in range(a + 1):
            common = np.empty((dims, dims), np.int64)
            for i in range(0, dims, step):
                common[i : i + step] = np.bitwise_count(planes[a, i : i + step, None] & planes[b, None]).sum(2, dtype=np.int64)
            both = common if a == b else common + common.T
            total += both << (a + b) if small else both.astype(object) * (1 << (a + b))
    return total


class Sums:
    """Count, sums and cross-products of vectors of one dimension count, in whole numbers of any size."""

    def __init__(self, dims: int):
        self.n, self.s, self.t = 0, np.zeros(dims, object), np.zeros((dims, dims), object)

    def add(self, x: np.ndarray) -> None:
        low = x.min(0)
        y = x.view(np.uint64) - low.view(np.uint64)  # modulo 2^64, where it is the true difference
        m = low.astype(object)
        u = np.array([int(c) for c in y.sum(0, dtype=np.uint64)] if len(y) * int(y.max(initial=0)) < 1 << 64 else [sum(map(int, c)) for c in y.T], object)
        um = np.outer(u, m)
        self.t += cross_products(y).astype(object) + um + um.T + len(x) * np.outer(m, m)
        self.s += u + len(x) * m
        self.n += len(x)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places (i, j) with j >= i, j = -1 for a sum and i = -1 for the count, and the limbs there."""
        i, j = np.triu_indices(len(self.s))
        value = np.concatenate([self.t[i, j], self.s, np.array([self.n], object)])
        limbs = []
        for _ in range(LIMBS - 1):
            limbs.append((value & _LIMB).astype(np.int64))
            value = value >> 32
        limbs.append(value.astype(np.int64))
        d = len(self.s)
        return np.r_[i, np.arange(d), -1], np.r_[j, np.full(d, -1), -1], np.array(limbs)


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[np.ndarray]:
    """Vectors of the batches as matrices of one dimension count each, of bounded size."""
    held: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for dims, _, x in _matrices(b.column(column)):
            for at in range(0, len(x), most := max(1, min(ROWS, ENTRIES // dims))):
                parts = held.setdefault(dims, [])
                parts.append(x[at : at + most])
                if sum(map(len, parts)) >= most:
                    yield np.concatenate(held.pop(dims))
    for parts in held.values():
        yield np.concatenate(parts)


def _matrices(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dims, places, matrix) of the lists of each length above 0."""
    size = lists.value_lengths().to_numpy()
    flat, first = lists.flatten().to_numpy(), np.cumsum(size) - size
    for dims in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == dims)
        yield dims, at, flat[first[at][:, None] + np.arange(dims)]


@dataclass
class Whitening:
    """What is known of the vectors of one dimension count: count, sums, components (columns), their eigenvalues and shares of the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([s / self.n for s in self.sums])
        return (x - mean) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum of (n x - S)^2 over the dimensions, exactly."""
        top = int(max(-int(x.min(initial=0)), int(x.max(initial=0))))
        most = max(top, max(map(abs, self.sums)))
        wide = x if len(self.sums) * top * most <= _LONG else x.astype(object)
        s = np.array(self.sums, np.int64 if wide is x else object)
        square, cross, last = (wide * wide).sum(1).tolist(), (wide * s).sum(1).tolist(), sum(v * v for v in self.sums)
        return [self.n * self.n * q - 2 * self.n * c + last for q, c in zip(square, cross)]


def decompose(n: int, sums: list[int], cross: dict[tuple[int, int], int], components: int) -> Whitening:
    """Components of the covariance, centred as n * cross - sum * sum in whole numbers before it is divided.

    Numbered by falling eigenvalue; the largest entry of each is positive.
    Directions without variance, to double precision, are no components.
    """
    d = len(sums)
    v = np.empty((d, d))
    for (i, j), t in cross.items():
        v[i, j] = v[j, i] = (n * t - sums[i] * sums[j]) / (n * n)
    e, w = np.linalg.eigh(v)
    e, w, trace = e[::-1], w[:, ::-1], float(np.trace(v))
    keep = np.flatnonzero(e[:components] > d * np.finfo(float).eps * trace)
    w = w[:, keep]
    w = w * np.where(w[np.abs(w).argmax(0), np.arange(len(keep))] < 0, -1.0, 1.0) if len(keep) else w
    return Whitening(n, sums, w, e[keep], e[keep] / trace if len(keep) else e[keep])


def fit(rows: DataFrame, *, components: int = COMPONENTS) -> dict[int, Whitening]:
    """The whitening of the distinct vectors x of (id, x), one for each dimension count above 0.

    The driver gets d(d+1)/2 sums for vectors of d entries, whatever their number.
    """
    distinct = written(rows.select("x").where(F.size("x") > 0).distinct(), "whitening")
    names = [f"l{k}" for k in range(LIMBS)]

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, Sums] = {}
        for x in _blocks(batches, 0):
            total.setdefault(x.shape[1], Sums(x.shape[1])).add(x)
        for dims, s in total.items():
            i, j, limbs = s.rows()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dims, np.int32)), pa.array(i, pa.int32()), pa.array(j, pa.int32()), *map(pa.array, limbs)], names=["dims", "i", "j", *names])

    parts = distinct.mapInArrow(tidy(scatter), "dims int, i int, j int, " + ", ".join(f"{x} long" for x in names))
    found = parts.groupBy("dims", "i", "j").agg(*(F.sum(x).alias(x) for x in names)).collect()
    value = {(r.dims, r.i, r.j): sum(r[x] << 32 * k for k, x in enumerate(names)) for r in found}
    out = {}
    for dims in sorted({k[0] for k in value}):
        sums = [value[dims, i, -1] for i in range(dims)]
        cross = {(i, j): value[dims, i, j] for i in range(dims) for j in range(i, dims)}
        out[dims] = decompose(value[dims, -1, -1], sums, cross, components)
    for dims, error in _identity_errors(distinct, out, components).items():
        out[dims].identity_error = error
    return out


def _identity_errors(distinct: DataFrame, known: dict[int, Whitening], components: int) -> dict[int, float]:
    """Largest entry of the whitened vectors' covariance less the identity, measured on the whitened vectors themselves."""
    held = distinct.sparkSession.sparkContext.broadcast(known)
    names = [f"w{k}" for k in range(components)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dims, at, x in _matrices(b.column(0)):
                w = np.full((len(at), components), np.nan)
                own = held.value[dims].project(x)
                w[:, : own.shape[1]] = own
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), dims, np.int32)), *(pa.array(c, from_pandas=True) for c in w.T)], names=["dims", *names])

    pairs = [(a, b) for a in range(components) for b in range(a + 1)]
    rows = distinct.mapInArrow(tidy(run), "dims int, " + ", ".join(f"{x} double" for x in names))
    found = rows.groupBy("dims").agg(*(F.covar_pop(names[a], names[b]).alias(f"c{a}_{b}") for a, b in pairs)).collect()
    gap = lambda r, a, b: abs(r[f"c{a}_{b}"] - (a == b)) if r[f"c{a}_{b}"] is not None else 0.0
    return {r.dims: max(gap(r, a, b) for a, b in pairs) for r in found}


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector that remains and each component: the id, component (from 1), n, deviation, whitened, explained, identity_error, deviation_exact.

    n counts the distinct vectors; deviation is the sum of (n x - S)^2, the nearest
    long where none holds it, and deviation_exact its digits.  Vectors of another
    number of entries are another population with an n and components of its own;
    an empty vector has no entry and gives no row, nor does a population without
    variance.  There are fewer components where the vectors span fewer dimensions.
    Rows that repeat an id or vector, and rows without an id, get rows each.  Other
    columns are ignored.  An empty table gives an empty result.
    """
    rows = whole_numbers(vectors, id_col, vector_col, scale)
    known = fit(rows, components=components)
    held = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dims, at, x in _matrices(b.column(1)):
                m = held.value[dims]
                w, exact = m.project(x), m.deviations(x)
                k = w.shape[1]
                each = lambda v, kind=None: pa.array(np.repeat(np.array(v), k), kind)
                n = len(at) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()), pa.array(np.full(n, m.n, np.int64)),
                        each([min(v, _LONG) for v in exact], pa.int64()), pa.array(w.ravel()), pa.array(np.tile(m.explained, len(at))), pa.array(np.full(n, m.identity_error)), pa.array([str(v) for v in exact for _ in range(k)], pa.string()),
                    ],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"],
                )

    kind = vectors.schema[id_col].dataType.simpleString()
    ddl = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"
    return rows.where(F.size("x") > 0).mapInArrow(tidy(run), ddl)
