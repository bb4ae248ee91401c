"""Language identification by prediction by partial matching.

Training counts byte contexts of length 0 to 3 for each language over all its
documents.  A byte is coded in its longest context; where it was not seen there,
the coder pays the escape (method C: distinct followers against all followers)
and drops to the next shorter context, at last to equal shares.  The counts are
frozen, so the code length of a byte in a context is a constant: the trees hold
the code lengths of the seen grams in sorted order, and a document's code length
under each language is a sum of look-ups over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm import bytegrams
from tidegraph.llm.bytegrams import ORDER, SYMBOLS
from tidegraph.llm.textkit import chunks, tidy

#: Code lengths are kept in so many parts of a nat.
PARTS = 2048
#: Code lengths that a worker keeps at hand.
CACHE = 1 << 21


class Tree:
    """Contexts of one length in one language: sorted codes with code lengths in 1/PARTS nat."""

    def __init__(self, code: np.ndarray, n: np.ndarray, base: int):
        order = np.argsort(code, kind="stable")
        code, n = code[order], n[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        code, n = code[first], np.add.reduceat(n, first).astype(float)
        context = code // base
        at = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        kinds = np.diff(np.r_[at, len(code)]).astype(float)
        total = np.add.reduceat(n, at) + kinds
        self.grams, self.contexts = code.astype(np.int32), context[at].astype(np.int32)
        self.coded = np.minimum(np.rint(np.log(np.repeat(total, kinds.astype(np.int64)) / n) * PARTS), 65535).astype(np.uint16)
        self.escape = np.minimum(np.rint(np.log(total / kinds) * PARTS), 65535).astype(np.uint16)


def _find(keys: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the sought in the sorted keys, and whether they are there."""
    at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
    return at, keys[at] == sought


class PpmModel:
    """Context trees, kept sparsely: ``trees[language][length of the context]``.

    Six bytes for each seen gram, whatever the alphabet; a gram that was not seen
    is found by its escapes.
    """

    order = ORDER

    def __init__(self, languages: list[str], code: np.ndarray, n: np.ndarray, cls: np.ndarray):
        self.languages = languages
        seen = np.unique(code // SYMBOLS**ORDER)
        for k in range(ORDER):
            seen = np.union1d(seen, np.unique(code // SYMBOLS**k % SYMBOLS))
        self.alphabet = np.full(SYMBOLS, len(seen), dtype=np.int64)  # the last is for bytes not seen in training
        self.alphabet[seen] = np.arange(len(seen))
        a = self.base = len(seen) + 1
        self.trees: list[list[Tree]] = []
        totals = np.zeros(len(languages))
        for k in range(len(languages)):
            own = cls == k
            there, count = code[own].astype(np.int64), n[own]
            compact = np.zeros(len(there), np.int64)
            for x in range(ORDER, -1, -1):
                compact = compact * a + self.alphabet[there // SYMBOLS**x % SYMBOLS]
            self.trees.append([Tree(compact % a ** (depth + 1), count, a) for depth in range(ORDER + 1)])
            totals[k] = count.sum()
        self.prior = -np.log(totals / totals.sum())
        self._forget()

    def _forget(self) -> None:
        #: what a task derives from the model; kept as long as its worker holds the model
        self.derived: dict = {}
        self._codes = np.zeros(0, np.int32)
        self._costs = np.zeros((0, len(self.languages)), np.int32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("derived", "_codes", "_costs")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def costs(self, code: np.ndarray) -> np.ndarray:
        """Code length in 1/PARTS nat of the last symbol of each compact gram under each language."""
        out = np.zeros((len(code), len(self.languages)), np.int32)
        for k, trees in enumerate(self.trees):
            left, key = np.arange(len(code)), code.astype(np.int32)
            for depth in range(ORDER, -1, -1):
                tree = trees[depth]
                key = key % np.int32(self.base ** (depth + 1))
                at, there = _find(tree.grams, key)
                out[left[there], k] += tree.coded[at[there]]
                left, key = left[~there], key[~there]
                at, there = _find(tree.contexts, key // np.int32(self.base))
                out[left[there], k] += tree.escape[at[there]]
            out[left, k] += np.int32(np.rint(np.log(self.base) * PARTS))
        return out

    def _held(self, code: np.ndarray) -> np.ndarray:
        """``costs`` of sorted distinct grams, with those of earlier chunks at hand."""
        if len(self._codes):
            at, there = _find(self._codes, code)
        else:
            at, there = np.zeros(len(code), np.int64), np.zeros(len(code), bool)
        new = code[~there]
        fresh = self.costs(new)
        out = np.empty((len(code), len(self.languages)), np.int32)
        out[there], out[~there] = self._costs[at[there]], fresh
        if len(new):
            if self._costs.size > CACHE:
                self._codes, self._costs = self._codes[:0], self._costs[:0]
            put = np.searchsorted(self._codes, new)
            self._codes, self._costs = np.insert(self._codes, put, new), np.insert(self._costs, put, fresh, axis=0)
        return out

    def lengths(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code length in nats of each document under each language, and whether it has an ASCII letter."""
        symbols, places, counts = bytegrams.folded(buf, offsets)
        letters = np.zeros(len(symbols) + 1, np.int64)
        np.cumsum((symbols > 0) & (symbols < 27), out=letters[1:])
        bounds = np.r_[0, np.cumsum(counts + ORDER)]
        out = np.zeros((len(counts), len(self.languages)))
        full = np.flatnonzero(counts)
        if len(full):
            code, of = np.unique(bytegrams.grams(self.alphabet[symbols], places, self.base).astype(np.int32), return_inverse=True)
            first = (np.cumsum(counts) - counts)[full]
            out[full] = np.add.reduceat(self._held(code)[of], first, axis=0, dtype=np.int64) / PARTS
        return out, np.diff(letters[bounds]) > 0


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> PpmModel | None:
    """Context trees from every row with a text and a language; None without any."""
    counts = bytegrams.count(docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()), text_col, lang_col)
    rows = counts.select("cls", F.col("code").cast("int").alias("code"), "n").toArrow()
    if not rows.num_rows:
        return None
    named = rows["cls"].combine_chunks().dictionary_encode()
    names = named.dictionary.to_pylist()
    languages = sorted(names)
    place = np.array([languages.index(x) for x in names])
    return PpmModel(languages, rows["code"].to_numpy(), rows["n"].to_numpy(), place[named.indices.to_numpy()])


def predict(docs: DataFrame, model: PpmModel | None, *, text_col: str = "text") -> DataFrame:
    """Add lang_pred and score (share of the best language, 0 to 1) to every row.

    ``und`` with score 0 where the text is null, empty or without a letter, or
    where nothing was learned.  Ties go to the first language by name.  Columns
    of the input stay, but those with the two names are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            labels: list[str] = []
            scores: list[float] = []
            texts = b.column(at)
            for i, j, buf, offsets in chunks(texts):
                if model is None:
                    labels += ["und"] * (j - i)
                    scores += [0.0] * (j - i)
                    continue
                lengths, letters = model.lengths(buf, offsets)
                lengths += model.prior
                best = lengths.argmin(1)
                share = 1 / np.exp(np.maximum(lengths.min(1, keepdims=True) - lengths, -700)).sum(1)
                for k in range(j - i):
                    ok = letters[k] or (offsets[k + 1] > offsets[k] and any(map(str.isalpha, texts[i + k].as_py())))
                    labels.append(model.languages[best[k]] if ok else "und")
                    scores.append(float(share[k]) if ok else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(tidy(run), schema)
