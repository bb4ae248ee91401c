"""Counts of byte 4-grams over folded text, the statistics of the byte-level models.

Folding maps A-Z and a-z to 26 symbols, each byte from 0x80 up to a symbol of its
own and every run of other bytes to one separator; three separators precede each
document, so shorter contexts are sums over the longer ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.textkit import chunks, tidy

SYMBOLS = 27 + 128
#: Context length.
ORDER = 3
#: Counts that a task holds before it sums them by code.
HELD = 1 << 20
FOLD = np.zeros(256, dtype=np.uint8)
FOLD[97:123] = np.arange(1, 27)
FOLD[65:91] = np.arange(1, 27)
FOLD[128:] = np.arange(27, SYMBOLS)


def folded(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols with the separators put in front of each document, the places of the documents' own symbols, and their counts by document."""
    s = FOLD[buf]
    keep = np.ones(len(s), dtype=bool)
    if len(s) > 1:
        np.logical_or(s[1:] != 0, s[:-1] != 0, out=keep[1:])
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(s))]
        keep[edges] = True
    total = np.zeros(len(s) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    counts = np.diff(total[offsets])
    places = np.arange(int(counts.sum())) + np.repeat(ORDER * (1 + np.arange(len(counts))), counts)
    out = np.zeros(len(places) + ORDER * len(counts), dtype=np.uint8)
    out[places] = s[keep]
    return out, places, counts


def grams(symbols: np.ndarray, places: np.ndarray, base: int = SYMBOLS) -> np.ndarray:
    """Code of the symbol at each place with the three before it."""
    s = symbols.astype(np.int64)
    code = s[places - ORDER]
    for j in range(ORDER - 1, -1, -1):
        code *= base
        code += s[places - j]
    return code


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by code."""
    code = np.concatenate([p[0] for p in parts])
    n = np.concatenate([p[1] for p in parts])
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(n, first) if len(code) else n


def count(docs: DataFrame, text_col: str, class_col: str | None = None) -> DataFrame:
    """4-gram counts (cls string, code long, n long) over the whole texts of all rows, by class if there is one.

    Each task sums its own counts before they are shuffled, and gives them out
    where they grow beyond what it holds.
    """

    def given(held: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for c in sorted(held):
            code, n = merged(held[c])
            yield pa.RecordBatch.from_pydict({"cls": pa.array([c] * len(code), pa.string()), "code": code.astype(np.int64), "n": n})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size, limit = 0, HELD
        for b in batches:
            classes = b.column(1).to_pylist()
            for i, j, buf, offsets in chunks(b.column(0)):
                symbols, places, counts = folded(buf, offsets)
                code = grams(symbols, places).astype(np.uint32)
                of = classes[i:j]
                names = sorted(set(of))
                which = np.repeat(np.array([names.index(c) for c in of]), counts)
                for k, name in enumerate(names):
                    part = np.unique(code[which == k] if len(names) > 1 else code, return_counts=True)
                    held.setdefault(name, []).append((part[0], part[1].astype(np.int64)))
                    size += len(part[0])
                if size > limit:
                    held = {c: [merged(p)] for c, p in held.items()}
                    size = sum(len(p[0][0]) for p in held.values())
                    limit = max(HELD, 2 * size)
                if size > 2 * HELD:
                    yield from given(held)
                    held, size, limit = {}, 0, HELD
        yield from given(held)

    cls = F.col(class_col) if class_col else F.lit("")
    part = docs.select(F.col(text_col).cast("string").alias("text"), cls.cast("string").alias("cls")).where("text is not null and cls is not null")
    return part.mapInArrow(tidy(run), "cls string, code long, n long").groupBy("cls", "code").agg(F.sum("n").alias("n"))
