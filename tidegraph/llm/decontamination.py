"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item are compared if the runs of ``TILE`` words that
they share could reach the coverage, so no pair that the tiling accepts is left
out.  Candidates are found by the item's rarer runs: the commonest are left out of
the index as long as the words under them alone fall short of the coverage.  The
comparison repeatedly marks the longest matches of words not
marked yet, found by running Karp-Rabin hashes whose window shrinks, down to
``TILE`` words.  The share of the item's words under tiles decides, so a passage
whose parts were reordered or broken up is caught all the same.

The benchmark's index is sent to every task in blocks of at most ``BLOCK_WORDS``
words; the documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.textkit import Words, chunks, cores, fold_case, mix, span_hashes

TILE, COVERAGE = 3, 0.8
#: Words of benchmark text in one block of its index.
BLOCK_WORDS = 2_000_000
#: Pairs of runs and items looked at once.
PAIRS = 4_000_000
_SEEDS = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, TILE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words without case and outer punctuation, and the first of each text."""
    w = Words(buf, offsets)
    w.buf = fold_case(buf)
    start, end, has = cores(w)
    return span_hashes(w.buf, start, end), np.searchsorted(has, w.first)


def seeds(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of TILE words inside one text, and its first word."""
    n = len(h) - TILE + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s = h[:n] * _SEEDS[0]
    for j in range(1, TILE):
        s += h[j : j + n] * _SEEDS[j]
    after = np.repeat(first[1:], np.diff(first))[:n]
    keep = np.flatnonzero(after - np.arange(n) >= TILE)
    return mix(s[keep]), keep


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of every window, by doubling."""
    out, have, power = h.copy(), 1, _STEP
    powers = {1: (out, _STEP)}
    while have * 2 <= size:
        out = out[:-have] * power + out[have:]
        power = power * power
        have *= 2
        powers[have] = (out, power)
    at, rest = have, size - have
    while rest:
        k = 1 << (rest.bit_length() - 1)
        part, p = powers[k]
        n = len(h) - at - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = out[:n] * p + part[at : at + n]
        at += k
        rest -= k
    return out[: max(0, len(h) - size + 1)]


def tiling(item: np.ndarray, text: np.ndarray, least: int = TILE) -> list[tuple[int, int, int]]:
    """Tiles (start in the item, start in the text, length), longest first; no word is in two."""
    free_i, free_t = np.ones(len(item), bool), np.ones(len(text), bool)
    tiles: list[tuple[int, int, int]] = []
    size = min(len(item), len(text), 32)
    with np.errstate(over="ignore"):
        while size >= least:
            a, b = _runs(item, size), _runs(text, size)
            open_i = np.convolve(free_i, np.ones(size), "valid") > size - 0.5
            open_t = np.r_[0, np.cumsum(free_t)]
            open_t = open_t[size:] - open_t[:-size] == size
            where: dict[int, list[int]] = {}
            for p in np.flatnonzero(open_i).tolist():
                where.setdefault(int(a[p]), []).append(p)
            keys = np.fromiter(where, np.uint64, len(where))
            found: list[tuple[int, int, int]] = []
            for q in np.flatnonzero(open_t & np.isin(b, keys)).tolist():
                for p in where[int(b[q])]:
                    if p and q and free_i[p - 1] and free_t[q - 1] and item[p - 1] == text[q - 1]:
                        continue  # part of the match that starts before it
                    n = 0
                    while p + n < len(item) and q + n < len(text) and free_i[p + n] and free_t[q + n] and item[p + n] == text[q + n]:
                        n += 1
                    if n >= size:
                        found.append((n, p, q))
            if not found:
                size = size - 1 if size <= 2 * least else max(least, size // 2)
                continue
            for n, p, q in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
                if free_i[p : p + n].all() and free_t[q : q + n].all():
                    free_i[p : p + n] = False
                    free_t[q : q + n] = False
                    tiles.append((p, q, n))
    return tiles


class Index:
    """Runs of a block of items."""

    def __init__(self, ids: list[int], texts: list[str], coverage: float = COVERAGE):
        buf_words = [words_of(b, o) for _, _, b, o in chunks(pa.array(texts, pa.large_string()))]
        self.ids, self.coverage = ids, coverage
        self.items = [h[first[k] : first[k + 1]] for h, first in buf_words for k in range(len(first) - 1)]
        self.runs = [seeds(h, np.array([0, len(h)]))[0] for h in self.items]
        none = np.zeros(0, np.uint64)
        runs = np.concatenate([*self.runs, none])
        kinds, which = np.unique(runs, return_inverse=True)
        own = np.unique(np.repeat(np.arange(len(self.runs)), [len(s) for s in self.runs]) * len(kinds) + which)
        items_of = np.bincount(own % max(len(kinds), 1), minlength=len(kinds))[which]
        keys, of, at = [], [], 0
        for k, (h, s) in enumerate(zip(self.items, self.runs)):
            kept = s[self._rare(s, items_of[at : at + len(s)], len(h))]
            at += len(s)
            keys.append(np.unique(kept))
            of.append(np.full(len(keys[-1]), k))
        keys, of = np.concatenate([*keys, none]), np.concatenate([*of, np.zeros(0, np.int64)]).astype(np.int64)
        order = np.lexsort((of, keys))
        self.keys, self.of = keys[order], of[order]
        self.near = np.zeros(1 << 22, dtype=bool)
        self.near[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def _rare(self, s: np.ndarray, items_of: np.ndarray, words: int) -> np.ndarray:
        """Which runs of an item are indexed: a pair that shares none of them cannot reach the coverage."""
        under, covered = bytearray(words), 0
        kept = np.ones(len(s), bool)
        order = np.lexsort((s, -items_of))
        runs, at = s[order], order.tolist()
        cut = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1], True]).tolist() if len(s) else []
        for i, j in zip(cut, cut[1:]):  # a run that repeats in the item goes or stays as a whole
            covered += len({p + x for p in at[i:j] for x in range(TILE) if not under[p + x]})
            if covered >= self.coverage * words:
                break
            for p in at[i:j]:
                kept[p] = False
                under[p : p + TILE] = bytes([1]) * TILE
        return kept

    def _candidates(self, s: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Sorted (document, item) pairs, as one number, that share an indexed run."""
        k = np.flatnonzero(self.near[(s >> np.uint64(42)).astype(np.int64)])
        low = np.searchsorted(self.keys, s[k], "left")
        size = np.searchsorted(self.keys, s[k], "right") - low
        hit = np.flatnonzero(size)
        pair, first = np.unique(docs[k[hit]] * np.int64(len(self.keys) + 1) + low[hit], return_index=True)
        low, size, doc = low[hit][first], size[hit][first], docs[k[hit]][first]
        ends = np.cumsum(size)
        out, i = np.zeros(0, np.int64), 0
        while i < len(pair):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
            n = size[i:j]
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[i:j], n)
            out = np.union1d(out, np.repeat(doc[i:j], n) * len(self.items) + self.of[at])
            i = j
        return out

    def _reach(self, x: int, there: np.ndarray) -> int:
        """Words of an item under runs that a text has, given by their sorted hashes."""
        s = self.runs[x]
        shared = there[np.minimum(np.searchsorted(there, s), len(there) - 1)] == s
        under = np.zeros(len(self.items[x]), bool)
        for j in range(TILE):
            under[j : j + len(s)] |= shared
        return int(under.sum())

    def leaks(self, buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item, words under tiles, words of the item, tiles) of the pairs that reach the coverage."""
        h, first = words_of(buf, offsets)
        s, at = seeds(h, first)
        cut = np.searchsorted(at, first)
        there, last = None, -1
        for pair in self._candidates(s, np.searchsorted(first, at, "right") - 1).tolist():
            d, x = divmod(pair, len(self.items))
            if d != last:
                there, last = np.sort(s[cut[d] : cut[d + 1]]), d
            item = self.items[x]
            if self._reach(x, there) < self.coverage * len(item):
                continue
            tiles = tiling(item, h[first[d] : first[d + 1]])
            covered = sum(t[2] for t in tiles)
            if covered >= self.coverage * len(item):
                yield d, x, covered, len(item), len(tiles)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int, coverage: float) -> Iterator[Index]:
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    size = F.size(F.split("text", r"[\x20\x09-\x0D]+"))
    total = items.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-total // limit))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).orderBy("id", "text").collect()
        yield Index([r.id for r in rows], [r.text for r in rows], coverage)


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Pairs of documents and items that leak: doc_id, item_id, matched_words, item_words, tiles, coverage.

    Null and empty texts match nothing, nor do items of fewer than TILE words.
    Rows that repeat are reported once each.  Other columns are ignored.
    """
    ddl = "doc_id long, item_id long, matched_words long, item_words long, tiles int, coverage double"
    part = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    out = None
    for index in _blocks(benchmark, item_col, item_text, block_words, coverage):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for b in batches:
                ids = b.column(0).to_pylist()
                rows = [(ids[i + d], index.ids[x], m, n, t, m / n) for i, j, buf, offsets in chunks(b.column(1)) for d, x, m, n, t in index.leaks(buf, offsets)]
                if rows:
                    c = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int32()), pa.array(c[5], pa.float64())], names=["doc_id", "item_id", "matched_words", "item_words", "tiles", "coverage"])

        found = part.mapInArrow(run, ddl)
        out = found if out is None else out.unionAll(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns; null and empty texts stay."""
    at = docs.columns.index(text_col)
    for index in _blocks(benchmark, item_col, item_text, block_words, coverage):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for i, j, buf, offsets in chunks(b.column(at)):
                    for d, *_ in index.leaks(buf, offsets):
                        keep[i + d] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
