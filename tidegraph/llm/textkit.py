"""Vectorised views of a batch of texts: bytes, words and word hashes.

Every helper works on whole texts.  Batches are cut at document boundaries into
chunks of bounded size, so memory follows the chunk (or the longest single
document), never the partition.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once (a longer document forms a chunk alone).
CHUNK_BYTES = 1 << 18
#: Words up to this many bytes are hashed position by position.
LONG_WORD = 1 << 14

_U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_POSITION = _rng.integers(0, 1 << 63, LONG_WORD, dtype=np.uint64) * _U64(2) + _U64(1)
_SPAN = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * _U64(2) + _U64(1)

WS = np.zeros(256, dtype=bool)
WS[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Return the freed memory of this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: its own policy holds
        return


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A task's function that leaves no freed memory with the worker, which outlives the task."""

    @functools.wraps(run)
    def wrapped(batches: Batches) -> Batches:
        yield from run(batches)
        give_back()

    return wrapped


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> _U64(30))
    h = h * _U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U64(27))
    h = h * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string column and the offsets between them; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n, at = len(column), column.offset
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64, count=at + n + 1)[at:] if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents (first, after, bytes, offsets) of about ``limit`` bytes."""
    buf, offsets = text_bytes(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a chunk: byte spans, documents and 64-bit hashes."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.buf = LOWER[buf] if lower else buf
        self.offsets = offsets
        n = len(buf)
        inside = np.empty(n + 2, dtype=bool)
        inside[0] = inside[-1] = False
        np.logical_not(WS[buf], out=inside[1:-1])
        begin = inside[1:-1] & ~inside[:-2]
        stop = inside[1:-1] & ~inside[2:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        begin[edges] = inside[1:-1][edges]
        stop[edges - 1] = inside[1:-1][edges - 1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        #: first word of each document, and one after the last
        self.first = np.searchsorted(self.start, offsets, "left")
        self._inside = inside[1:-1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        body = self.buf[self._inside]
        at = np.cumsum(size) - size
        pos = np.arange(len(body), dtype=np.int64)
        pos -= np.repeat(at, size)
        np.minimum(pos, LONG_WORD - 1, out=pos)
        terms = _POSITION[pos]
        terms *= body.astype(np.uint64) + _U64(1)
        h = np.add.reduceat(terms, at)
        for k in np.flatnonzero(size > LONG_WORD):
            import hashlib

            digest = hashlib.blake2b(self.buf[self.start[k] : self.end[k]].tobytes(), digest_size=8).digest()
            h[k] = int.from_bytes(digest, "little")
        return mix(h + size.astype(np.uint64))

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of k words that lies in one document, and the index of its first word."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = hashes[:n] * _SPAN[0]
        for j in range(1, k):
            h += hashes[j : j + n] * _SPAN[j]
        left = np.repeat(self.first[1:], self.counts)[:n] - np.arange(n)
        keep = np.flatnonzero(left >= k)
        return mix(h[keep]), keep


def combine(hashes: np.ndarray) -> int:
    """Hash of a short sequence of word hashes as one unit."""
    h = np.uint64(len(hashes))
    with np.errstate(over="ignore"):
        for x in hashes.tolist():
            h = mix(np.array([h], np.uint64) * _SPAN[1] + np.uint64(x))[0]
    return int(h)


ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = True
ALNUM[97:123] = True
ALNUM[128:] = True


def fold_case(buf: np.ndarray) -> np.ndarray:
    """A-Z and the Latin-1 capitals (C3 80 to C3 9E in UTF-8) as small letters, byte by byte."""
    buf = LOWER[buf]
    if len(buf) > 1:
        buf[1:][(buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)] += 0x20
    return buf


def cores(w: Words, inside: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (start, end) of the words from their first to their last byte of the given kind, and which words have one."""
    hit = inside[w.buf]
    total = np.zeros(len(w.buf) + 1, np.int64)
    np.cumsum(hit, out=total[1:])
    places = np.flatnonzero(hit)
    a, b = total[w.start], total[w.end]
    has = np.flatnonzero(b > a)
    return places[a[has]], places[b[has] - 1] + 1, has


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans do not overlap and are not empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    at = np.cumsum(size) - size
    pos = np.arange(int(size.sum())) - np.repeat(at, size)
    terms = _POSITION[pos % LONG_WORD]
    terms *= buf[pos + np.repeat(start, size)].astype(np.uint64) + _U64(1)
    return mix(np.add.reduceat(terms, at) + size.astype(np.uint64))
