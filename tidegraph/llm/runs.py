"""Periodic runs of words, found from Lyndon roots.

Every run of a text has a root that is the longest Lyndon word at its place, under
an order of the words or under the reverse order.  The first phase of Baier's
suffix sorter groups suffixes by their longest Lyndon prefix, from the highest
group down, so the lengths of the groups' prefixes are the Lyndon array; it is run
under both orders.  Each root that is followed by its own first word is extended
to both sides by longest common extensions, which are read from the numbers of the
substrings of 2^k words.

A run that is asked for repeats a stretch of words within its text, so only
stretches that are covered by repeated windows of a few words are sorted; whatever
is long enough lies inside one of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.lineage import free_name
from tidegraph.llm.textkit import Words, chunks, tidy

#: A run holds at least so many words, and its period so many times.
MIN_LENGTH, EXPONENT = 24, 3


def lyndon_lengths(s: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place of a text of numbers 0, 1, ...: phase one of the suffix sorter.

    A group is named by where its interval begins among the sorted suffixes, so a
    higher group has a higher name.
    """
    n = len(s)
    many = [0] * (max(s, default=0) + 1)
    for c in s:
        many[c] += 1
    start, at = [], 0
    for m in many:
        start.append(at)
        at += m
    group = [start[c] for c in s]
    members: dict[int, list[int]] = {}
    for i, g in enumerate(group):
        members.setdefault(g, []).append(i)
    size = {g: len(m) for g, m in members.items()}
    length, before = [1] * n, [-1] * n
    for g in range(n - 1, -1, -1):
        if g not in size:
            continue
        own = [i for i in members.pop(g) if group[i] == g]
        times: dict[int, int] = {}
        for i in own:  # the nearest place on the left whose group is lower
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = before[p]
            before[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if not times:
            continue
        step = length[own[0]]
        # a prefix grows by the group's as often as it follows; more often is higher, and all stay next to their old group
        for (_, g_old), moved in groupby(sorted(((-k, group[p], p) for p, k in times.items())), key=itemgetter(0, 1)):
            places = [p for _, _, p in moved]
            for p in places:
                length[p] += times[p] * step
            left = size[g_old] - len(places)
            g_new = g_old + left
            if left:
                size[g_old] = left
            for p in places:
                group[p] = g_new
            members[g_new], size[g_new] = places, len(places)
    return length


class Extensions:
    """Longest common extensions in a text of numbers, from the numbers of its substrings of 2^k words."""

    def __init__(self, s: np.ndarray):
        self.levels = [s.astype(np.int64)]
        while 2 << len(self.levels) - 1 <= len(s):
            low, half = self.levels[-1], 1 << len(self.levels) - 1
            key = low[:-half] * (int(low.max()) + 1) + low[half:]
            _, number = np.unique(key, return_inverse=True)
            if len(number) and number.max() + 1 == len(number):  # all differ: nothing longer is common
                break
            self.levels.append(number)
        self.size = len(s)

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common words from i and from j on, i < j."""
        i, j = i.copy(), j.copy()
        first = j.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            of = self.levels[k]
            more = True
            while more:  # the top level may fit more than once
                fit = np.flatnonzero(j + (1 << k) <= self.size)
                fit = fit[of[i[fit]] == of[j[fit]]]
                i[fit] += 1 << k
                j[fit] += 1 << k
                more = bool(len(fit)) and k == len(self.levels) - 1
        return j - first

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common words that end just before i and j, i < j."""
        i, j = i.copy(), j.copy()
        first = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            of = self.levels[k]
            more = True
            while more:
                fit = np.flatnonzero(i - (1 << k) >= 0)
                fit = fit[of[i[fit] - (1 << k)] == of[j[fit] - (1 << k)]]
                i[fit] -= 1 << k
                j[fit] -= 1 << k
                more = bool(len(fit)) and k == len(self.levels) - 1
        return first - i


def runs_of(s: list[int], min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text of numbers with at least ``min_length`` words and ``exponent`` periods, by start, then period."""
    n = len(s)
    if n < max(2, min_length):
        return []
    text, high = np.array(s, np.int64), max(s)
    extend, found = None, []
    for order in (s, [high - c for c in s]):
        period = np.array(lyndon_lengths(order), np.int64)
        i = np.arange(n)
        i = i[(i + period < n) & (exponent * period <= n)]
        i = i[text[i] == text[i + period[i]]]
        if not len(i):
            continue
        extend = extend or Extensions(text)
        p = period[i]
        first, after = i - extend.left(i, i + p), i + p + extend.right(i, i + p)
        found.append(np.stack([first, after - first, p], 1)[after - first >= np.maximum(min_length, exponent * p)])
    if not found:
        return []
    rows = np.unique(np.concatenate(found), axis=0)
    return [tuple(r) for r in rows[np.lexsort((rows[:, 2], rows[:, 0]))].tolist()]


def _stretches(w: Words, window: int) -> list[tuple[int, int]]:
    """(first, after) of the stretches of words that are covered by windows found twice in a document."""
    h, at = w.windows(w.hashes(), window)
    doc = np.searchsorted(w.first, at, "right") - 1
    order = np.lexsort((h, doc))
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    at = at[twice]
    if not len(at):
        return []
    new = np.r_[True, (np.diff(at) > window) | (np.diff(doc[twice]) != 0)]
    first = at[new]
    after = at[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]] + window
    return list(zip(first.tolist(), after.tolist()))


def text_runs(buf: np.ndarray, offsets: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> tuple[np.ndarray, dict[int, list[tuple[int, int, int]]], Words]:
    """Words of each document of a chunk, its runs by document, and the words themselves."""
    w = Words(buf, offsets)
    # a run of period q repeats at least this many words at distance q, whatever q is
    window = min(max(min_length - q, (exponent - 1) * q) for q in range(1, min_length + 1))
    found: dict[int, list[tuple[int, int, int]]] = {}
    for first, after in _stretches(w, max(1, window)):
        if after - first < min_length:
            continue
        numbers: dict[bytes, int] = {}
        words = [numbers.setdefault(buf[a:b].tobytes(), len(numbers)) for a, b in zip(w.start[first:after].tolist(), w.end[first:after].tolist())]
        own = runs_of(words, min_length, exponent)
        if own:
            doc = int(np.searchsorted(w.first, first, "right")) - 1
            shift = first - int(w.first[doc])
            found.setdefault(doc, []).extend((s + shift, n, p) for s, n, p in own)
    return w.counts, found, w


def kept_text(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one blank."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    covered = np.cumsum(change[:-1])
    return b" ".join(words[k] for k in np.flatnonzero(covered == 0).tolist())


def find(docs: DataFrame, *, text_col: str = "text", min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """Add n_words, runs (array of start, length, period, by start, then period) and collapsed to every row.

    Words are ``[^\\x20\\x09-\\x0D]+``.  A run is a stretch of words with smallest
    period q that no neighbouring word extends; it is reported from ``min_length``
    words and ``exponent`` periods on.  ``collapsed`` is the text without the words
    that a run holds after its first period, words joined by one blank.  A null,
    empty or blank text has no words and no runs and collapses to the empty text.
    Each row stands for itself, so repeated rows and ids, and rows without an id,
    are rows like others.  A text is sorted whole, in one task, and memory follows
    the longest one.  Columns of the input stay, but those with the three names are
    replaced.
    """
    if min_length < 2 or exponent < 2:
        raise ValueError("runs have at least two words and two periods")
    docs = docs.drop("n_words", "runs", "collapsed")
    kind = "array<struct<start:bigint,length:bigint,period:bigint>>"
    schema = docs.select("*", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(kind).alias("runs"), F.lit("").alias("collapsed")).schema
    at = docs.columns.index(text_col)
    row = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, offsets in chunks(b.column(at)):
                counts, found, w = text_runs(buf, offsets, min_length, exponent)
                texts = []
                for k in range(j - i):
                    words = buf[offsets[k] : offsets[k + 1]].tobytes().split()
                    texts.append(kept_text(words, found[k]) if k in found else b" ".join(words))
                lists = [[{"start": s, "length": n, "period": p} for s, n, p in found.get(k, ())] for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns), pa.array(counts, pa.int64()), pa.array(lists, row), pa.array(texts, pa.binary()).cast(pa.string())], names=[*b.schema.names, "n_words", "runs", "collapsed"])

    return docs.mapInArrow(tidy(run), schema)


def with_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Let a tenth of the documents go round: a fixture by the crc32 h of the id.

    With g = floor(h / 10): if h % 10 = 0 and there are n > 0 words, each word i
    from a = g % n on becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)),
    and words are joined by one blank.  Other rows, and those without an id or
    text, stay as they are.
    """
    h, words = free_name(docs, "_h"), free_name(docs, "_words")
    split = F.filter(F.split(text_col, "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    rows = docs.withColumn(h, F.crc32(F.col(id_col).cast("string").cast("binary"))).withColumn(words, F.when(F.col(h) % 10 == 0, split))
    g, n = F.floor(F.col(h) / 10), F.size(words)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
    turned = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.element_at(words, (place(i) + 1).cast("int"))), " ")
    return rows.withColumn(text_col, F.when(n > 0, turned).otherwise(F.col(text_col))).drop(h, words)


def digest(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The run with the greatest length / period of each row (ties: smallest start, then period), and hashes of all runs and of what is left."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda best, r: F.when(better(best, r), r).otherwise(best))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    rows = found.select(id_col, "runs", "collapsed", best.alias("best"))
    return rows.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
