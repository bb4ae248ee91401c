"""Toxicity scores over text restored by a noisy-channel decoder.

Writers hide words by leetspeak (``m0r0n``), separators and spacing (``i d i o t``)
and repetition (``stuuupid``).  Each suspicious token becomes a lattice of the
characters it may stand for; the Viterbi path under a character language model
and fixed channel costs restores it.  The language model holds the 4-gram counts
of all documents.  A logistic model then scores whole words and word beginnings of
the text, the restored words included.  It learns from at most ``SAMPLE`` labelled
documents; features are picked by their log-likelihood ratio.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm import bytegrams
from tidegraph.llm.bytegrams import FOLD
from tidegraph.llm.langid import PARTS, PpmModel
from tidegraph.llm.textkit import _POSITION, LONG_WORD, Words, chunks, mix, tidy

#: Labelled documents that the scorer learns from at most, the first by hash of their id.
SAMPLE = 20_000
#: Toxic documents of the sample that a feature needs at least, and its least log-likelihood ratio.
LEAST_DOCS, LEAST_RATIO = 3, 16.0
#: Lengths in bytes of the word beginnings that are features.
STEMS = (4, 5, 6, 7, 8)
#: What a character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¢": "c"}
#: Channel costs in nats: a leet character, a dropped separator, a kept separator, a dropped leet character, a run of a letter cut to 1 or 2.
SWAP, DROP, BREAK, LOSE, SHORT = 1.0, 1.5, 3.0, 6.0, 1.0

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_LEET = np.zeros(256, dtype=bool)
_LEET[[ord(c) for c in LEET if ord(c) < 128 and c not in "!|+("]] = True
_LOOSE = np.zeros(256, dtype=bool)  # leet characters that are common as punctuation
_LOOSE[[ord(c) for c in "!|+("]] = True
_U64 = np.uint64
#: Decoded tokens and costs that a task keeps at hand, and the longest of those tokens.
CACHE, KEPT_TOKEN = 50_000, 64


class Decoder:
    """Viterbi search over character lattices."""

    def __init__(self, model: PpmModel | None):
        self.model = model
        self.known: dict[str, str] = {}
        self.costs: dict[int, float] = {}
        if model is not None:
            self.alphabet: list[int] = model.alphabet.tolist()
            # longest context first; a gram is sought alone, and views are quick to search for one
            self.trees = [(model.base ** (d + 1), memoryview(t.grams), memoryview(t.contexts), memoryview(t.coded), memoryview(t.escape)) for d, t in reversed(list(enumerate(model.trees[0])))]

    def restore(self, token: str) -> str:
        """The likeliest plain words, separated by blanks."""
        if self.model is None:
            return token
        got = self.known.get(token)
        if got is None:
            got = self._viterbi(token)
            if len(token) <= KEPT_TOKEN:
                if len(self.known) > CACHE:
                    self.known.clear()
                self.known[token] = got
        return got

    def _cost(self, gram: int) -> float:
        """Code length in nats of the last symbol of a gram, as ``PpmModel.costs`` gives it."""
        got = self.costs.get(gram)
        if got is None:
            if len(self.costs) > CACHE:
                self.costs.clear()
            got = self.costs[gram] = self._sought(gram) / PARTS
        return got

    def _sought(self, gram: int) -> int:
        base, total = self.model.base, 0
        for size, grams, contexts, coded, escape in self.trees:
            key = gram % size
            at = bisect_left(grams, key)
            if at < len(grams) and grams[at] == key:
                return total + coded[at]
            at = bisect_left(contexts, key // base)
            if at < len(contexts) and contexts[at] == key // base:
                total += escape[at]
        return total + int(np.rint(np.log(base) * PARTS))

    def _symbols(self, text: str) -> list[int]:
        return [self.alphabet[s] for s in FOLD[np.frombuffer(text.encode(), np.uint8)].tolist()] if text else []

    def _options(self, token: str) -> Iterator[list[tuple[str, float]]]:
        i = 0
        while i < len(token):
            c, j = token[i], i + 1
            while j < len(token) and token[j] == c:
                j += 1
            run = j - i
            if c.isalpha():
                yield [(c * run, 0.0)] if run < 3 else [(c, SHORT), (c * 2, SHORT)]
            elif c in LEET:
                whole = [(x * k, SWAP * min(run, 2)) for x in LEET[c] for k in ((run,) if run < 3 else (1, 2))]
                yield [*whole, (" ", BREAK), ("", LOSE)]
            else:
                yield [("", DROP), (" ", BREAK)]
            i = j

    def _viterbi(self, token: str) -> str:
        m = self.model
        order, base = m.order, m.base
        blank = self.alphabet[0]
        mod = base**order
        start = 0
        for _ in range(order):
            start = start * base + blank
        # each path points back to the one that it goes on from
        paths: dict[int, tuple[float, tuple | None]] = {start: (0.0, None)}
        for options in itertools.chain(self._options(token), [[(" ", 0.0)]]):
            best: dict[int, tuple[float, tuple | None]] = {}
            spelled = [(text, extra, self._symbols(text)) for text, extra in options]
            for ctx, (cost, back) in paths.items():
                for text, extra, symbols in spelled:
                    total, state = cost + extra, ctx
                    for s in symbols:
                        if s == blank and state % base == blank:
                            continue
                        at = state * base + s
                        total += self._cost(at)
                        state = at % mod
                    held = best.get(state)
                    if held is None or total < held[0]:
                        best[state] = (total, (back, text))
            paths = best
        back, parts = min(paths.values(), key=lambda x: x[0])[1], []
        while back is not None:
            back, text = back
            parts.append(text)
        return "".join(reversed(parts)).strip()


def _decoder(held) -> Decoder:
    """The decoder of a shared model; it goes with the model once no task of the worker needs that any more."""
    model = held.value
    return Decoder(None) if model is None else model.derived.setdefault("decoder", Decoder(model))


def _span_features(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each span and of its beginnings, and the spans they belong to."""
    size = end - start
    at = np.cumsum(size) - size
    pos = np.arange(int(size.sum())) - np.repeat(at, size)
    terms = _POSITION[np.minimum(pos, LONG_WORD - 1)]
    terms *= buf[pos + np.repeat(start, size)].astype(np.uint64) + _U64(1)
    total = np.zeros(len(terms) + 1, np.uint64)
    np.cumsum(terms, out=total[1:])
    hashes, of = [mix(total[at + size] - total[at] + _U64(1 << 20))], [np.arange(len(start))]
    for p in STEMS:
        k = np.flatnonzero(size > p)
        hashes.append(mix(total[at[k] + p] - total[at[k]] + _U64(p)))
        of.append(k)
    return np.concatenate(hashes), np.concatenate(of)


def _signs(buf: np.ndarray) -> np.ndarray:
    """Where a leet character of several bytes begins."""
    out = np.zeros(len(buf), bool)
    if len(buf) > 1:
        out[:-1] = (buf[:-1] == 0xC2) & ((buf[1:] == 0xA2) | (buf[1:] == 0xA3))
    if len(buf) > 2:
        out[:-2] |= (buf[:-2] == 0xE2) & (buf[1:-1] == 0x82) & (buf[2:] == 0xAC)
    return out


def _single(w: Words, buf: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the words without outer punctuation, and which of them are one character."""
    solid = letter | _LEET[buf]
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(solid, out=total[1:])
    places = np.flatnonzero(solid)
    a, b = total[w.start], total[w.end]
    left, right = w.start.copy(), w.end.copy()
    has = b > a
    left[has], right[has] = places[a[has]], places[b[has] - 1] + 1
    chars = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
    single = chars[right] - chars[left] == 1
    if len(single):
        single &= has | _LOOSE[buf[left]]
    return left, right, single


def features(buf: np.ndarray, offsets: np.ndarray, decoder: Decoder) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of the words of each document, restored words included, and the documents; with repeats."""
    w = Words(buf, offsets, lower=True)
    buf = w.buf
    if len(buf) > 1:  # capitals of the Latin-1 letters, which UTF-8 writes as C3 80 to C3 9E
        buf[1:][(buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)] += 0x20
    letter = _LETTER[buf]
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(letter, out=total[1:])
    places = np.flatnonzero(letter)
    doc = np.repeat(np.arange(len(offsets) - 1), w.counts)
    a, b = total[w.start], total[w.end]
    has = b > a
    start, end, wdoc = w.start[has], w.end[has], doc[has]
    first, last = places[a[has]], places[b[has] - 1]
    odd = (last + 1 - first) > (b - a)[has]
    leet = _LEET[buf] | _LOOSE[buf] | _signs(buf)
    leets = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(leet, out=leets[1:])
    odd |= leets[end] > leets[start]
    if len(buf) > 2:
        run = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(letter[:-2] & (buf[:-2] < 128) & (buf[:-2] == buf[1:-1]) & (buf[1:-1] == buf[2:]), out=run[1:-2])
        run[-2:] = run[-3]
        odd |= run[np.maximum(last - 1, first)] > run[first]
    h, of = _span_features(buf, first, last + 1)
    out, out_doc = [h], [wdoc[of]]

    data = buf.tobytes()
    words: list[bytes] = []
    docs: list[int] = []

    def add(text: str, d: int) -> None:
        for x in decoder.restore(text).split():
            words.append(x.encode())
            docs.append(d)

    for k in np.flatnonzero(odd).tolist():
        add(data[start[k] : end[k]].decode("utf-8", "replace").strip(".,;:?\"')]}<>#%&*~"), int(wdoc[k]))
    left, right, single = _single(w, buf, letter)
    if single.any():
        edge = np.flatnonzero(np.diff(np.r_[False, single, False].astype(np.int8)))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
            spaced: list[str] = []
            for k in range(i, j + 1):
                c = data[left[k] : right[k]].decode("utf-8", "replace") if k < j else ""
                fits = c.isalpha() or c in LEET
                if spaced and (not fits or doc[k] != doc[k - 1]):
                    if len(spaced) >= 3:
                        add("".join(spaced), int(doc[k - 1]))
                    spaced = []
                if fits:
                    spaced.append(c)
    if words:
        size = np.array([len(x) for x in words])
        joined = np.frombuffer(b"".join(words), np.uint8)
        stop = np.cumsum(size)
        h, of = _span_features(joined, stop - size, stop)
        out.append(h)
        out_doc.append(np.array(docs)[of])
    return np.concatenate(out), np.concatenate(out_doc)


class Scorer:
    """Logistic model over the presence of chosen features."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.hashes, self.weights, self.bias = hashes, weights, bias
        self._near = None

    def __getstate__(self):
        return self.hashes, self.weights, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def present(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, feature) pairs of the model's features."""
        if self._near is None:
            self._near = np.zeros(1 << 22, dtype=bool)
            self._near[(self.hashes >> _U64(42)).astype(np.int64)] = True
        k = np.flatnonzero(self._near[(h >> _U64(42)).astype(np.int64)]) if len(self.hashes) else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h[k]), max(len(self.hashes) - 1, 0))
        ok = self.hashes[at] == h[k] if len(k) else np.zeros(0, bool)
        pair = np.unique(doc[k[ok]] * np.int64(len(self.hashes) or 1) + at[ok])
        return pair // (len(self.hashes) or 1), pair % (len(self.hashes) or 1)

    def scores(self, h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        d, f = self.present(h, doc)
        return 1 / (1 + np.exp(-(self.bias + np.bincount(d, self.weights[f], n))))


def language_model(docs: DataFrame, *, text_col: str = "text") -> PpmModel | None:
    """Character model from the 4-gram counts of all documents."""
    rows = bytegrams.count(docs, text_col).select(F.col("code").cast("int").alias("code"), "n").toArrow()
    if not rows.num_rows:
        return None
    return PpmModel([""], rows["code"].to_numpy(), rows["n"].to_numpy(), np.zeros(rows.num_rows, np.int64))


def _fit(d: np.ndarray, f: np.ndarray, y: np.ndarray, width: int, rounds: int = 3000, ridge: float = 0.3) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by accelerated gradient steps."""
    w, v, n = np.zeros(width + 1), np.zeros(width + 1), len(y)
    df = np.bincount(f, minlength=width)
    top = max(4.0, float(np.bincount(d, minlength=n).max(initial=0)) + 1)
    # a step for each coordinate: its own curvature times the most features of a document
    steps = np.r_[1 / (0.25 * top * np.maximum(df, 1) + ridge), 1 / (0.25 * top * n)]
    last = w
    for t in range(rounds):
        v = w + t / (t + 3) * (w - last)
        z = v[-1] + np.bincount(d, v[f], n)
        e = 1 / (1 + np.exp(-z)) - y
        g = np.r_[np.bincount(f, e[d], width) + ridge * v[:-1], e.sum()]
        last, w = w, v - steps * g
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, held, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Scorer | None:
    """A scorer from the documents among the first ``sample`` labelled ids by hash.

    An id with several labels counts as toxic if one of them says so: a label
    above 0 does, null labels count as none.  None if there is no labelled document.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample)
    # at most ``sample`` pairs of numbers
    part = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("text", "y")

    def given(parts: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray) -> pa.RecordBatch:
        key, n = bytegrams.merged(parts) if parts else (np.zeros(0, np.int64),) * 2
        one, none = n >> 32, n & 0xFFFFFFFF
        # a feature without a toxic document here still counts against the same feature elsewhere
        return pa.RecordBatch.from_pydict({"h": np.r_[key, 0], "n1": np.r_[one, rows[1]], "n0": np.r_[none, rows[0]], "total": np.r_[np.zeros(len(key), bool), True]})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(held)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        rows = np.zeros(2, np.int64)
        for b in batches:
            y = b.column(1).to_numpy(zero_copy_only=False)
            rows += np.bincount(y, minlength=2)
            for i, j, buf, offsets in chunks(b.column(0)):
                h, d = features(buf, offsets, decoder)
                order = np.lexsort((d, h))
                h, d = h[order], d[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, bool)
                key = h[new].view(np.int64)
                parts.append(bytegrams.merged([(key, np.where(y[i:j][d[new]] > 0, np.int64(1) << 32, np.int64(1)))]))
                if sum(len(p[0]) for p in parts[1:]) > bytegrams.HELD // 2:
                    parts = [bytegrams.merged(parts)]
                    if len(parts[0][0]) > bytegrams.HELD:
                        yield given(parts, np.zeros(2, np.int64))
                        parts = []
        yield given(parts, rows)

    counted = part.mapInArrow(tidy(count), "h long, n1 long, n0 long, total boolean").groupBy("total", "h").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where(F.col("total") | (F.col("n1") >= LEAST_DOCS))
    table = counted.toArrow()
    n1, n0, total = (table[c].to_numpy() for c in ("n1", "n0", "total"))
    h = table["h"].to_numpy().view(np.uint64)
    if not total.any() or n1[total][0] + n0[total][0] == 0:
        return None
    p1, p0 = float(n1[total][0]), float(n0[total][0])
    h, n1, n0 = h[~total], n1[~total].astype(float), n0[~total].astype(float)
    if p1 == 0 or p0 == 0:
        return Scorer(h[:0], np.zeros(0), np.log((p1 + 0.5) / (p0 + 0.5)))
    share, q = (n1 + 1e-9) / (n1 + n0), p1 / (p1 + p0)
    ratio = 2 * (n1 * np.log(share / q) + n0 * np.log(np.maximum(n0, 1e-9) / (n1 + n0) / (1 - q)))
    good = np.flatnonzero((ratio >= LEAST_RATIO) & (share > q))
    blank = Scorer(np.sort(h[good]), np.zeros(len(good)), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(blank)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, model = _decoder(held), shared.value
        for b in batches:
            for i, j, buf, offsets in chunks(b.column(0)):
                d, f = model.present(*features(buf, offsets, decoder))
                cut = np.searchsorted(d, np.arange(j - i + 1))
                yield pa.RecordBatch.from_pydict({"y": b.column(1).slice(i, j - i), "f": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(f, pa.int32()))})

    seen = part.mapInArrow(tidy(find), "y int, f array<int>").toArrow()
    y = seen["y"].to_numpy()
    lists = seen["f"].combine_chunks()
    f = lists.flatten().to_numpy()
    d = np.repeat(np.arange(len(y)), lists.value_lengths().to_numpy())
    order = np.lexsort((f, d))
    weights, bias = _fit(d[order], f[order], y.astype(float), len(good))
    return Scorer(blank.hashes, weights, bias)


def score(docs: DataFrame, scorer: Scorer | None, held, *, text_col: str = "text") -> DataFrame:
    """Add score (0 to 1) and predicted (1 from 0.5 up) to every row; null and empty texts get the score of no feature.

    Without a scorer every score is 0.  Columns of the input stay, but those with
    the two names are replaced.
    """
    docs = docs.drop("score", "predicted")
    schema = docs.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, model = _decoder(held), shared.value
        for b in batches:
            parts = [np.zeros(0)]
            for i, j, buf, offsets in chunks(b.column(at)):
                parts.append(np.zeros(j - i) if model is None else model.scores(*features(buf, offsets, decoder), j - i))
            s = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(tidy(run), schema)


def fitted(docs: DataFrame, learn: DataFrame, labels: DataFrame, **options) -> tuple[Scorer | None, object]:
    """The scorer from ``learn`` and the shared language model from all of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(language_model(docs))
    return train(learn, labels, held, **options), held


def clean(docs: DataFrame, scorer: Scorer | None, held, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below 0.5, with their columns alone; all rows without a scorer."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, model = _decoder(held), shared.value
        for b in batches:
            keep = [np.zeros(0, bool)]
            for i, j, buf, offsets in chunks(b.column(at)):
                keep.append(np.ones(j - i, bool) if model is None else model.scores(*features(buf, offsets, decoder), j - i) < 0.5)
            yield b.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(tidy(run), docs.schema)
