"""Exact top-k inner-product search by columnar branch and bound.

Candidates lie in vertical layout, one array a dimension block.  For each query
the scores grow block by block; the product of the remaining parts' norms bounds
what a candidate can still gain (Cauchy-Schwarz), and candidates whose bound is
below the query's k-th best score so far are compacted away.  Scores are exact
integers: doubles add them up while they hold them exactly, and a candidate that is
too large for that has its score bounded in doubles and counted in whole numbers if
it may be among the best.  Queries go to all tasks in blocks of bounded size; each
task keeps k rows a query, and the few winners of the tasks are merged by query and
written before the next block goes out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.lineage import cut
from tidegraph.llm.textkit import tidy

K, SCALE = 10, 1024
#: Queries that are sent to the tasks at once, at most so many components of them, and dimensions of a block.
QUERY_BLOCK, QUERY_VALUES, BLOCK = 4096, 1 << 22, 16
#: Candidates that a task holds at once, and at most so many components of them.
CANDIDATES, VALUES = 65_536, 1 << 21
#: Doubles hold integers exactly up to here.
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of each component, whole numbers in doubles.

    Rows without an id or vector, or with a component that is null or, scaled, not
    finite, are left out.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double") * scale)
    fit = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where("id is not null and x is not null")
    whole = lambda c: F.when(F.abs(c) < _EXACT, F.floor(c).cast("double")).otherwise(c)
    return rows.where(F.size("x") > 0).where(fit).select("id", F.transform("x", whole).alias("v"))


class Block:
    """Candidates of one dimension count, in vertical layout."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, block: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.wide = ids[order], matrix[order].astype(np.float64)
        self.dims = self.wide.shape[1]
        self.bounds = [*range(0, self.dims, block), self.dims]
        self.weight = np.abs(self.wide).sum(1)
        self.parts = [np.ascontiguousarray(self.wide[:, a:b].T) for a, b in zip(self.bounds, self.bounds[1:])]
        squares = np.array([(p * p).sum(0) for p in self.parts])
        self.rest = np.sqrt(np.cumsum(squares[::-1], 0)[::-1])  # norm of the parts from each block on

    def search(self, own: int, q: np.ndarray, k: int, floor: float) -> list[tuple[int, int]]:
        """The k best (score, id), ties to the smaller id, among candidates that may reach ``floor``."""
        x = q.astype(np.float64)
        large = self.weight * np.abs(x).max(initial=0) >= _EXACT
        others = self.ids != own
        found = self._small(np.flatnonzero(others & ~large), x, k, floor)
        if large.any():
            found += self._large(np.flatnonzero(others & large), x, k, floor)
            found = sorted(found, key=lambda r: (-r[0], r[1]))[:k]
        return found

    def _small(self, alive: np.ndarray, x: np.ndarray, k: int, floor: float) -> list[tuple[int, int]]:
        norms = [np.sqrt((x[a:] ** 2).sum()) for a in self.bounds[:-1]] + [0.0]
        score = np.zeros(len(alive))
        least = floor
        if len(alive) > 4 * k and least == -np.inf:  # a first bound from the candidates with the largest first part
            head = x[self.bounds[0] : self.bounds[1]] @ self.parts[0]
            probe = np.argpartition(head[alive], len(alive) - 2 * k)[-2 * k :]
            least = float(np.sort(self.wide[alive[probe]] @ x)[-k])
        for n, (a, b) in enumerate(zip(self.bounds, self.bounds[1:])):
            part = self.parts[n]
            score = score + x[a:b] @ (part if len(alive) == part.shape[1] else part[:, alive])
            if n + 1 < len(self.parts) and len(alive) > 2 * k:
                bound = score + norms[n + 1] * self.rest[n + 1][alive]
                keep = bound * (1 + 1e-9 * np.sign(bound)) + 1e-6 >= least
                if not keep.all():
                    alive, score = alive[keep], score[keep]
        order = np.lexsort((self.ids[alive], -score))[:k]
        return [(int(score[o]), int(self.ids[alive[o]])) for o in order]

    def _large(self, alive: np.ndarray, x: np.ndarray, k: int, floor: float) -> list[tuple[int, int]]:
        """Bounds in doubles, whole numbers for the candidates that may be among the k best."""
        rows = self.wide[alive]
        score = rows @ x
        slack = (self.dims + 4) * 2.0**-52 * (np.abs(rows) @ np.abs(x))
        least = max(floor, float(np.sort(score - slack)[-k]) if len(alive) > k else -np.inf)
        chosen = alive[score + slack >= least * (1 - 1e-9 * np.sign(least)) if np.isfinite(least) else np.ones(len(alive), bool)]
        whole = [int(v) for v in x.tolist()]
        exact = [(sum(int(a) * b for a, b in zip(self.wide[c].tolist(), whole)), int(self.ids[c])) for c in chosen.tolist()]
        return sorted(exact, key=lambda r: (-r[0], r[1]))[:k]


def _beyond(score: int) -> list[int]:
    """A key that orders scores which a long does not hold: how many digits of 62 bits, and these."""
    if -_LONG - 1 <= score <= _LONG:
        return [0]
    digits, left = [], abs(score)
    while left:
        left, low = divmod(left, 1 << 62)
        digits.append(low)
    digits = [len(digits), *digits[::-1]]
    return digits if score > 0 else [-d for d in digits]


def search(candidates: DataFrame, queries: DataFrame, *, k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k best candidates of each query: query_id, rank (from 1), vec_id, score.

    Both sides are rows (id, v) of whole numbers that doubles hold.  A query does
    not find its own id.  Only vectors of the query's dimension count are compared.
    Queries that repeat an id and vector are answered once; candidates that repeat
    an id are candidates each.  A score beyond a long is given as the nearest long
    and ranked by its exact value.  Empty sides give an empty result.
    """
    spark = candidates.sparkSession
    queries = cut(queries.select("id", F.col("v").cast("array<double>").alias("v")).distinct())
    candidates = candidates.select("id", F.col("v").cast("array<double>").alias("v"))
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("dims")).first()
    n = max(1, -(-size.n // max(1, min(query_block, QUERY_VALUES // max(1, size.dims)))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    out = None
    for part in range(n):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(n)) == part).toArrow()
        flat, ends = rows["v"].combine_chunks().flatten().to_numpy(), np.cumsum(rows["v"].combine_chunks().value_lengths().to_numpy())
        held = spark.sparkContext.broadcast(list(zip(rows["id"].to_pylist(), np.split(flat, ends[:-1]) if len(ends) else [])))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            best: dict[tuple[int, int], list[tuple[int, int]]] = {}
            ids: list[np.ndarray] = []
            rows: list[np.ndarray] = []

            def settle() -> None:
                if not ids:
                    return
                all_ids, lists = np.concatenate(ids), [v for r in rows for v in r]
                size = np.array([len(v) for v in lists])
                for dims in np.unique(size).tolist():
                    at = np.flatnonzero(size == dims)
                    b = Block(all_ids[at], np.stack([lists[p] for p in at]), block)
                    for number, (own, q) in enumerate(held.value):
                        if len(q) == dims:
                            got = best.get((number, own), [])
                            floor = float(got[k - 1][0]) if len(got) >= k else -np.inf
                            got = got + b.search(own, q, k, floor)
                            best[(number, own)] = sorted(got, key=lambda x: (-x[0], x[1]))[:k]
                ids.clear()
                rows.clear()

            count = values = 0
            for batch in batches:
                ids.append(batch.column(0).to_numpy())
                v = batch.column(1)
                flat, ends = v.flatten().to_numpy(), np.cumsum(v.value_lengths().to_numpy())
                rows.append(np.split(flat, ends[:-1]) if len(ends) else [])
                count += batch.num_rows
                values += len(flat)
                if count >= CANDIDATES or values >= VALUES:
                    settle()
                    count = values = 0
            settle()
            table = [(own, i, max(-_LONG - 1, min(_LONG, s)), _beyond(s)) for (_, own), got in best.items() for s, i in got]
            if table:
                c = list(zip(*table))
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(c[0], pa.int64()), "vec_id": pa.array(c[1], pa.int64()), "score": pa.array(c[2], pa.int64()), "beyond": pa.array(c[3], pa.list_(pa.int64()))})

        found = candidates.mapInArrow(tidy(run), "query_id long, vec_id long, score long, beyond array<long>")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if n > 1:  # the winners are few; the plan does not grow with the blocks, nor do the broadcasts
            found = cut(found)
            held.unpersist()
        out = found if out is None else out.unionByName(found)
    return out
