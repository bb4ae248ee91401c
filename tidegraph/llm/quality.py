"""Quality scores from weak labels.

Heuristic labellers vote good, bad or abstain on each document.  Expectation
maximisation estimates each labeller's accuracy and the share of good documents
from the counts of vote patterns over all documents; a pattern's posterior is the
training label of its documents.  A linear scorer over hashed features learns the
posteriors from at most ``SAMPLE`` documents and scores every whole text.  A row that
is repeated (id and text) counts each time for the labellers and once for the scorer.
Texts of any length are measured whole; a score of exactly 0.5 counts as good.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.textkit import ALNUM, Words, chunks, cores, fold_case, mix, span_hashes, tidy

#: Different documents that the scorer learns from at most, the first by hash of id and text.
SAMPLE = 20_000
#: Hashed features.
WIDTH = 1 << 14
LABELLERS = ("symbols", "capitals", "repeats", "variety", "clean words", "word length", "sentence ends")
_U64 = np.uint64


def _share(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(mask)]
    return np.diff(total[offsets])


def measures(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Shares and counts of each document that labellers and scorer look at."""
    w = Words(buf, offsets)
    n_words, n_bytes = w.counts.astype(float), np.maximum(np.diff(offsets), 1).astype(float)
    letter = ((buf >= 65) & (buf <= 90)) | ((buf >= 97) & (buf <= 122)) | (buf >= 128)
    upper = (buf >= 65) & (buf <= 90)
    digit = (buf >= 48) & (buf <= 57)
    plain = letter | digit | np.isin(buf, np.frombuffer(b" \t\r\n\x0b\x0c.,;:!?'\"()-", np.uint8))
    letters = np.maximum(_share(letter, offsets), 1)
    h = w.hashes()
    doc = np.repeat(np.arange(len(offsets) - 1), w.counts)
    order = np.lexsort((h, doc))
    fresh = np.r_[True, (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])] if len(h) else np.zeros(0, bool)
    distinct = np.bincount(doc[order][fresh], minlength=len(n_words))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    last = buf[w.end - 1] if len(h) else buf[:0]
    stop = np.isin(last, np.frombuffer(b".!?", np.uint8))
    tail = (w.end - w.start >= 2) & ~letter[w.end - 2] & ~letter[w.end - 1] if len(h) else np.zeros(0, bool)
    inner = np.r_[0, np.cumsum(letter)]
    neat = ~tail & (inner[w.end] - inner[w.start] >= np.maximum(w.end - w.start - 1, 1))
    return {
        "words": n_words,
        "clean": np.bincount(doc[neat], minlength=len(n_words)) / np.maximum(n_words, 1),
        "symbols": _share(~plain, offsets) / n_bytes,
        "capitals": _share(upper, offsets) / letters,
        "digits": _share(digit, offsets) / n_bytes,
        "repeats": np.bincount(doc[again], minlength=len(n_words)) / np.maximum(n_words, 1),
        "variety": distinct / np.maximum(np.sqrt(n_words), 1),
        "word_bytes": np.bincount(doc, (w.end - w.start).astype(float), len(n_words)) / np.maximum(n_words, 1),
        "stops": np.bincount(doc[stop], minlength=len(n_words)) / np.maximum(n_words, 1),
        "lines": _share(buf == 10, offsets) / np.maximum(n_words, 1),
    }


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """One column a labeller: 1 good, -1 bad, 0 no opinion."""
    vote = lambda good, bad: np.where(bad, -1, np.where(good, 1, 0))
    some, many = m["words"] >= 8, m["words"] >= 40
    columns = [
        vote(m["symbols"] < 0.002, m["symbols"] > 0.02),
        vote(m["capitals"] < 0.08, (m["capitals"] > 0.3) & some),
        vote(m["repeats"] < 0.02, (m["repeats"] > 0.04) & some),
        vote(m["variety"] > 5.5, (m["variety"] < 4) & many),
        vote(m["clean"] > 0.95, m["clean"] < 0.8),
        vote((m["word_bytes"] > 4.3) & (m["word_bytes"] < 6.3), ((m["word_bytes"] < 4) | (m["word_bytes"] > 7)) & some),
        vote((m["stops"] > 0.03) & (m["stops"] < 0.25), ((m["stops"] > 0.5) | (m["stops"] == 0)) & some),
    ]
    return np.stack(columns, 1).astype(np.int8)


def pattern_of(v: np.ndarray) -> np.ndarray:
    """Number of each vote pattern in base 3."""
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(1)


class LabelModel:
    """Posterior of good for each vote pattern: labellers err independently, each with its own rates in each class."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, labellers: int = len(LABELLERS), rounds: int = 200):
        v = (patterns[:, None] // 3 ** np.arange(labellers)) % 3
        n = counts.astype(float)
        bad = (v == 0).sum(1)
        post = np.where(bad == 0, 0.95, np.where(bad == 1, 0.4, 0.05))
        # the first guess of each labeller's rates, worth a few documents: votes are right rather than wrong
        guess = np.array([[6.0, 0.0, 1.0], [1.0, 0.0, 6.0]])
        for _ in range(rounds):
            self.prior = float((post * n).sum() + 2) / (n.sum() + 3)
            hits = np.array([[[(p * n)[v[:, k] == x].sum() for x in range(3)] for k in range(labellers)] for p in (1 - post, post)])
            rates = hits + guess[:, None, :]
            rates[:, :, 1] = rates[:, :, 0] + rates[:, :, 2]  # no opinion tells nothing: as likely in either class
            self.rates = rates / rates[:, :, 1:2]
            post = self._posterior(v)

    @property
    def accuracy(self) -> np.ndarray:
        """Share of each labeller's votes that agree with the estimated class."""
        bad, good = self.rates[0] * (1 - self.prior), self.rates[1] * self.prior
        return (bad[:, 0] + good[:, 2]) / (bad[:, 0] + bad[:, 2] + good[:, 0] + good[:, 2])

    def _posterior(self, v: np.ndarray) -> np.ndarray:
        k = np.arange(v.shape[1])
        odds = np.log(self.prior / (1 - self.prior)) + (np.log(self.rates[1][k, v]) - np.log(self.rates[0][k, v])).sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def __call__(self, v: np.ndarray) -> np.ndarray:
        return self._posterior(v.astype(np.int64) + 1)


def _features(buf: np.ndarray, offsets: np.ndarray, m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value): hashed words by share of the document, and the measures in steps."""
    w = Words(buf, offsets)
    w.buf = fold_case(buf)
    start, end, has = cores(w, ALNUM)
    doc = np.repeat(np.arange(len(offsets) - 1), w.counts)[has]
    f = (span_hashes(w.buf, start, end) % _U64(WIDTH)).astype(np.int64)
    pair, n = np.unique(doc * WIDTH + f, return_counts=True)
    d, f = pair // WIDTH, pair % WIDTH
    value = n / np.sqrt(np.bincount(d, n.astype(float) ** 2, len(offsets) - 1))[d]
    docs, feats = [d], [f]
    for k, name in enumerate(sorted(m)):
        step = np.minimum(np.floor(np.log2(np.maximum(m[name], 1e-6) * 1e6)), 40).astype(np.int64)
        docs.append(np.arange(len(step)))
        feats.append((mix((step + 64 * (k + 1)).astype(np.uint64)) % _U64(WIDTH)).astype(np.int64))
    extra = sum(map(len, docs[1:]))
    return np.concatenate(docs), np.concatenate(feats), np.r_[value, np.full(extra, 0.5)]


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[LabelModel, np.ndarray] | None:
    """Label model and weights (the bias last); None without documents."""
    part = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for b in batches:
            for _, _, buf, offsets in chunks(b.column(1)):
                total += np.bincount(pattern_of(votes(measures(buf, offsets))), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pattern": at, "n": total[at]})

    rows = part.mapInArrow(tidy(count), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toPandas()
    if not len(rows):
        return None
    model = LabelModel(rows["pattern"].to_numpy(), rows["n"].to_numpy())
    held = docs.sparkSession.sparkContext.broadcast(model)
    part = part.withColumn("h", F.xxhash64("id", "text"))
    limit = part.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = held.value
        for b in batches:
            for i, j, buf, offsets in chunks(b.column(1)):
                m = measures(buf, offsets)
                d, f, x = _features(buf, offsets, m)
                order = np.lexsort((f, d))
                cut_at = np.searchsorted(d[order], np.arange(len(offsets)))
                at = pa.array(cut_at, pa.int32())
                yield pa.RecordBatch.from_pydict({"h": b.column(2).slice(i, j - i), "y": label(votes(m)), "f": pa.ListArray.from_arrays(at, pa.array(f[order], pa.int32())), "x": pa.ListArray.from_arrays(at, pa.array(x[order], pa.float32()))})

    # the scorer's gradient is summed on the driver over at most ``sample`` documents, in the order of their hashes
    chosen = part.where(F.col("h") <= limit).dropDuplicates(["h"])
    seen = chosen.mapInArrow(tidy(learn), "h long, y double, f array<int>, x array<float>").toArrow().sort_by("h")
    lists = seen["f"].combine_chunks()
    f, x = lists.flatten().to_numpy(), seen["x"].combine_chunks().flatten().to_numpy().astype(float)
    y, size = seen["y"].to_numpy(), lists.value_lengths().to_numpy()
    d = np.repeat(np.arange(len(y)), size)
    w, g2 = np.zeros(WIDTH + 1), np.full(WIDTH + 1, 1e-8)
    for _ in range(150):  # adaptive gradient steps
        e = 1 / (1 + np.exp(-(np.bincount(d, w[f] * x, len(y)) + w[-1]))) - y
        g = np.r_[np.bincount(f, e[d] * x, WIDTH), e.sum()] / len(y) + 1e-5 * w
        g2 += g * g
        w -= 0.3 * g / np.sqrt(g2)
    return model, w


def score(docs: DataFrame, fitted: tuple[LabelModel, np.ndarray] | None, *, text_col: str = "text") -> DataFrame:
    """Add weak_label (posterior of the votes), score (of the scorer, 0 to 1) and predicted (1 good from 0.5 up) to every row.

    Null and empty texts count as texts without words.  Without a model both
    numbers are 0.5.  Columns of the input stay, but those with the three names
    are replaced.
    """
    docs = docs.drop("weak_label", "score", "predicted")
    schema = docs.select("*", F.lit(0.0).alias("weak_label"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    held = docs.sparkSession.sparkContext.broadcast(fitted)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = held.value
        for b in batches:
            weak, own = [np.zeros(0)], [np.zeros(0)]
            for i, j, buf, offsets in chunks(b.column(at)):
                if fitted is None:
                    weak.append(np.full(j - i, 0.5))
                    own.append(np.full(j - i, 0.5))
                    continue
                label, w = fitted
                m = measures(buf, offsets)
                d, f, x = _features(buf, offsets, m)
                weak.append(label(votes(m)))
                own.append(1 / (1 + np.exp(-(np.bincount(d, w[f] * x, j - i) + w[-1]))))
            s = np.concatenate(own)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(weak)), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*b.schema.names, "weak_label", "score", "predicted"])

    return docs.mapInArrow(tidy(run), schema)
