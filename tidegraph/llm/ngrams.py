"""Language-model scoring with Elias-Fano n-gram tries over all training documents.

The texts are first written as blocks: the distinct words of some megabytes of
text as 64-bit hashes, and the tokens as their numbers.  A block's distinct words,
pairs and triples form a small trie; its parts go to shards by their first word,
with the training counts of the block.  A context that holds a large part of a
shard by itself is spread over the shards by what follows it, so no shard grows
with a frequent word.

A shard adds up the counts and lays out its trie: a level for each length, whose
children of a context are a stretch between two monotone pointers, all in
Elias-Fano form and memory-mapped, with quantised frequencies.  Each distinct gram
asked for is looked up by successor search among the children of its context.  The
answers go back to the blocks, which smooth them (Dirichlet, each order with the
next shorter one) and add up the texts' scores.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.eliasfano import Sequence, encode, mapped
from tidegraph.llm.lineage import release, written
from tidegraph.llm.textkit import Words, chunks, give_back, mix, tidy

_U64 = np.uint64
#: Tokens of a block and of a shard, about (a longer text is a block alone).
BLOCK_TOKENS, SHARD_TOKENS = 1 << 20, 1 << 20
#: A context is spread from this share of a shard on; shares are estimated from one token in so many.
SPREAD, EVERY = 4, 1024
#: Weight of the shorter context's probability, in tokens, for pairs and triples.
WEIGHTS = (400.0, 2.0)
#: Bits that tell the children of a context apart, for pairs and triples.
SECOND, THIRD = 40, 32
#: Hashes of what stands before and after every text.
START, END = _U64(0x9E3779B97F4A7C15), _U64(0xC2B2AE3D27D4EB4F)
_TURN = (_U64(0xD6E8FEB86659FD93), _U64(0xA0761D6478BD642F))
#: Counts below this are kept as they are, larger ones in equal steps of their logarithm.
EXACT = 2048
_STEP = (63 * math.log(2) - math.log(EXACT)) / (65535 - EXACT)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative numbers as byte planes, compressed."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a, _U64)
        width = (int(a.max(initial=0)).bit_length() + 7) // 8
        parts += [struct.pack("<qB", len(a), width), np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(raw: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(raw), 0, []
    while at < len(raw):
        n, width = struct.unpack_from("<qB", raw, at)
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 9).reshape(width, n).T
        out.append(full.view(_U64).ravel())
        at += 9 + n * width
    return out


def quantised(n: np.ndarray) -> np.ndarray:
    """Counts as 16-bit codes: up to 2,047 exactly, beyond that to a relative 0.0003."""
    n = n.astype(float)
    return np.where(n < EXACT, n, EXACT + np.rint(np.log(np.maximum(n, EXACT) / EXACT) / _STEP)).astype(np.uint16)


def restored(code: np.ndarray) -> np.ndarray:
    code = code.astype(float)
    return np.where(code < EXACT, code, EXACT * np.exp((code - EXACT) * _STEP))


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _TURN[0] + b * _TURN[1])


# --- blocks ----------------------------------------------------------------------


def write_blocks(docs: DataFrame, id_col: str, text_col: str, learn: Column) -> DataFrame:
    """A written table (block, ids, n_tokens, n_learnt, sampled, body); the body holds words, tokens, sizes and which texts are learnt from."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        tokens: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        flags: list[np.ndarray] = []
        for b in batches:
            for i, j, buf, offsets in chunks(b.column(1)):
                w = Words(buf, offsets, lower=True)
                tokens.append(np.insert(w.hashes(), w.first[1:], END))
                sizes.append(w.counts + 1)
                ids.append(b.column(0).slice(i, j - i))
                flags.append(b.column(2).slice(i, j - i).to_numpy(zero_copy_only=False))
                if sum(map(len, tokens)) >= BLOCK_TOKENS:
                    yield block(ids, np.concatenate(tokens), np.concatenate(sizes), np.concatenate(flags))
                    ids, tokens, sizes, flags = [], [], [], []
        if ids:
            yield block(ids, np.concatenate(tokens), np.concatenate(sizes), np.concatenate(flags))

    def block(ids: list[pa.Array], h: np.ndarray, sizes: np.ndarray, flags: np.ndarray) -> pa.RecordBatch:
        words, of, n = np.unique(h, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")  # frequent words get small numbers
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        chosen = np.flatnonzero(np.random.default_rng(int(h[0] ^ _U64(len(h)))).random(len(h)) < 1 / EVERY)
        two = chosen[chosen > 0]
        sampled = np.r_[h[chosen], _pair_hash(h[two - 1], h[two])]
        learnt = int(sizes[flags].sum())
        one = lambda v, kind: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v, kind))
        body = pack(words[order], number[of], sizes, flags)
        return pa.RecordBatch.from_arrays([one(pa.concat_arrays(ids), None), pa.array([len(h)], pa.int64()), pa.array([learnt], pa.int64()), one(sampled.view(np.int64), pa.int64()), pa.array([body], pa.binary())], names=["ids", "n_tokens", "n_learnt", "sampled", "body"])

    blocks = rows.mapInArrow(tidy(run), f"ids array<{kind}>, n_tokens long, n_learnt long, sampled array<long>, body binary")
    return written(blocks.withColumn("block", F.monotonically_increasing_id()), "ngram-blocks")


class Grams:
    """The distinct words, pairs and triples of a block, with its training counts, and where each token's are.

    Words are sorted by hash, pairs by word, triples by pair.  The start counts
    once a learnt text, as a context.
    """

    def __init__(self, body: bytes):
        words, tokens, sizes, flags = unpack(body)
        self.sizes, self.learn = sizes.astype(np.int64), flags.astype(bool)
        words = np.r_[words, START]
        order = np.argsort(words)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.hashes, start, v = words[order], int(rank[-1]), len(words)
        tok = self.word = rank[tokens.astype(np.int64)]
        first = np.cumsum(self.sizes) - self.sizes
        before = np.r_[start, tok[:-1]]
        before[first] = start
        self.before = before
        code, of = np.unique(np.r_[before * v + tok, start * v + start], return_inverse=True)
        self.a, self.b = code // v, code % v
        self.pair = of[:-1]
        self.context = np.r_[of[-1], of[:-2]]
        self.context[first] = of[-1]
        code, self.triple = np.unique(self.context * v + tok, return_inverse=True)
        self.ab, self.c = code // v, code % v
        weight = np.repeat(self.learn, self.sizes).astype(float)
        texts = float(self.learn.sum())
        self.n1 = np.bincount(tok, weight, v).astype(np.int64)
        self.n1[start] = texts
        self.n2 = np.bincount(self.pair, weight, len(self.a)).astype(np.int64)
        self.n2[of[-1]] = texts
        self.n3 = np.bincount(self.triple, weight, len(self.ab)).astype(np.int64)

    def parts(self, shards: int, spread: np.ndarray) -> Parts:
        return Parts(self, shards, spread)


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards are equal ranges of the hashes."""
    return ((h >> _U64(32)) * _U64(shards) >> _U64(32)).astype(np.int64)


class Parts:
    """The parts of a block's trie that go to each shard.

    A gram is counted at its home.  A context whose followers are elsewhere stands
    there too, without a count.  ``at`` holds, level by level, the grams in the order
    of the shards, ``home`` whether they are at home, ``ends`` where shards end and
    ``kids`` how many grams of the next level follow.
    """

    def __init__(self, g: Grams, shards: int, spread: np.ndarray):
        v = len(g.hashes)
        home1 = _shard(g.hashes, shards)
        home2 = home1[g.a]
        hot = np.flatnonzero(np.isin(g.hashes, spread)[g.a]) if len(spread) else np.zeros(0, np.int64)
        home2[hot] = _shard(_pair_hash(g.hashes[g.a[hot]], g.hashes[g.b[hot]]), shards)
        home3 = home2[g.ab]
        hot = np.flatnonzero(np.isin(_pair_hash(g.hashes[g.a], g.hashes[g.b]), spread)[g.ab]) if len(spread) else np.zeros(0, np.int64)
        p = g.ab[hot]
        home3[hot] = _shard(_pair_hash(_pair_hash(g.hashes[g.a[p]], g.hashes[g.b[p]]), g.hashes[g.c[hot]]), shards)
        third = np.argsort(home3, kind="stable")
        second, at_home2 = self._stand(home2, home3[third], g.ab[third])
        first, at_home1 = self._stand(home1, second[0], g.a[second[1]])
        self.at = (first[1], second[1], third)
        self.home = (at_home1, at_home2, np.ones(len(third), bool))
        shard = (first[0], second[0], home3[third])
        self.ends = tuple(np.searchsorted(s, np.arange(shards + 1)) for s in shard)
        count = lambda s, own, s_next, parent: np.bincount(np.searchsorted(s * v_max + own, s_next * v_max + parent), minlength=len(own))
        v_max = max(v, len(g.a))
        self.kids = (count(*first, second[0], g.a[second[1]]), count(*second, shard[2], g.ab[third]))

    @staticmethod
    def _stand(home: np.ndarray, shard: np.ndarray, parent: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """(shard, gram) of every gram at home and wherever it is a parent, sorted, and which are at home."""
        away = np.flatnonzero(shard != home[parent])
        extra = np.unique(np.stack([shard[away], parent[away]], 1), axis=0) if len(away) else np.zeros((0, 2), np.int64)
        s, own = np.r_[home, extra[:, 0]], np.r_[np.arange(len(home)), extra[:, 1]]
        order = np.lexsort((own, s))
        return (s[order], own[order]), order < len(home)


def _requests(blocks: DataFrame, shards: int, spread: np.ndarray) -> DataFrame:
    """(shard, block, part): a block's grams of a shard, with their training counts."""
    held = blocks.sparkSession.sparkContext.broadcast(spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, body in zip(b.column(0).to_pylist(), b.column(1)):
                g = Grams(body.as_py())
                p = g.parts(shards, held.value)
                at, n = p.at, [np.where(h, c[i], 0) for c, i, h in zip((g.n1, g.n2, g.n3), p.at, p.home)]
                second, third = g.hashes[g.b[at[1]]] >> _U64(64 - SECOND), g.hashes[g.c[at[2]]] >> _U64(64 - THIRD)
                there = [s for s in range(shards) if p.ends[0][s] < p.ends[0][s + 1]]
                packs = []
                for s in there:
                    x, y, z = (slice(e[s], e[s + 1]) for e in p.ends)
                    packs.append(pack(g.hashes[at[0][x]], n[0][x], p.kids[0][x], second[y], n[1][y], p.kids[1][y], third[z], n[2][z]))
                    if len(packs) == 64:
                        yield rows(there[: len(packs)], block, packs)
                        there, packs = there[len(packs) :], []
                if packs:
                    yield rows(there, block, packs)
                del g, p, at, n, second, third, packs
                give_back()

    def rows(there: list[int], block: int, packs: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array([block] * len(there), pa.int64()), pa.array(packs, pa.binary())], names=["shard", "block", "part"])

    return blocks.select("block", "body").mapInArrow(run, "shard int, block long, part binary")


# --- shards ----------------------------------------------------------------------


class Trie:
    """The counted grams of a shard in memory-mapped levels.

    Grams come as sorted distinct keys: words by hash, pairs and triples by the
    number of their context and the child's bits.  A gram without a count stays only
    where it is the context of one.
    """

    def __init__(self, words: np.ndarray, n1: np.ndarray, pairs: np.ndarray, n2: np.ndarray, triples: np.ndarray, n3: np.ndarray):
        keep3 = n3 > 0
        keep2 = n2 > 0
        keep2[(triples[keep3] >> _U64(THIRD)).astype(np.int64)] = True
        keep1 = n1 > 0
        keep1[(pairs[keep2] >> _U64(SECOND)).astype(np.int64)] = True
        levels: dict[str, np.ndarray] = {}
        self._level(levels, "1", words[keep1], 1 << 64)
        parent = self._children(levels, "2", pairs[keep2], keep1, SECOND)
        self._level(levels, "to2", np.searchsorted(parent, np.arange(keep1.sum() + 1)).astype(_U64), int(keep2.sum()) + 1)
        parent = self._children(levels, "3", triples[keep3], keep2, THIRD)
        self._level(levels, "to3", np.searchsorted(parent, np.arange(keep2.sum() + 1)).astype(_U64), int(keep3.sum()) + 1)
        levels |= {"n1": n1[keep1], "n2": quantised(n2[keep2]), "n3": quantised(n3[keep3])}
        self.levels = mapped(levels)
        self.sequence = {k: Sequence({part: self.levels[f"{k} {part}"] for part in ("shape", "low", "high", "before")}) for k in ("1", "to2", "2", "to3", "3")}

    @staticmethod
    def _level(levels: dict[str, np.ndarray], name: str, values: np.ndarray, top: int) -> None:
        levels |= {f"{name} {part}": a for part, a in encode(values, top).items()}

    def _children(self, levels: dict[str, np.ndarray], name: str, keys: np.ndarray, kept: np.ndarray, bits: int) -> np.ndarray:
        """Store children under their context's number among the kept ones; gives those numbers."""
        number = np.cumsum(kept) - 1
        parent = number[(keys >> _U64(bits)).astype(np.int64)]
        self._level(levels, name, parent.astype(_U64) << _U64(bits) | keys & _U64((1 << bits) - 1), int(kept.sum()) << bits)
        return parent

    def words(self, keys: np.ndarray) -> np.ndarray:
        """Places of sorted words, -1 where they are not."""
        place, same = self.sequence["1"].successor(keys)
        return np.where(same, place, -1)

    def children(self, level: str, context: np.ndarray, child: np.ndarray, bits: int) -> np.ndarray:
        """Places of children of the contexts at these places, ordered by context and child; -1 where they are not.

        The successor of a child counts only within its context's stretch.
        """
        out = np.full(len(context), -1)
        there = np.flatnonzero(context >= 0)
        if len(there):
            own = context[there]
            first, after = self.sequence[f"to{level}"].at(own).astype(np.int64), self.sequence[f"to{level}"].at(own + 1).astype(np.int64)
            place, same = self.sequence[level].successor(own.astype(_U64) << _U64(bits) | child[there])
            out[there] = np.where(same & (place >= first) & (place < after), place, -1)
        return out

    def frequency(self, level: str, place: np.ndarray) -> np.ndarray:
        """Count of words, code of longer grams, 0 where there is none."""
        n = self.levels[f"n{level}"]
        return np.where(place >= 0, n[np.maximum(place, 0)], 0) if len(n) else np.zeros(len(place), n.dtype)


def _answer(parts: list[bytes]) -> tuple[list[bytes], int]:
    """For each block's part the frequencies of its grams, and how many distinct words the shard has counted."""
    got = [unpack(p) for p in parts]
    join = lambda k: np.concatenate([x[k] for x in got])
    words, of1 = np.unique(join(0), return_inverse=True)
    n1 = np.bincount(of1, join(1), len(words)).astype(np.int64)
    parent = np.repeat(of1, join(2).astype(np.int64))
    pairs, of2 = np.unique(parent.astype(_U64) << _U64(SECOND) | join(3), return_inverse=True)
    n2 = np.bincount(of2, join(4), len(pairs)).astype(np.int64)
    parent = np.repeat(of2, join(5).astype(np.int64))
    triples, of3 = np.unique(parent.astype(_U64) << _U64(THIRD) | join(6), return_inverse=True)
    n3 = np.bincount(of3, join(7), len(triples)).astype(np.int64)
    ends = [np.r_[0, np.cumsum([len(x[k]) for x in got])] for k in (0, 3, 6)]
    del got
    trie = Trie(words, n1, pairs, n2, triples, n3)
    low = lambda keys, bits: keys & _U64((1 << bits) - 1)
    high = lambda keys, bits: (keys >> _U64(bits)).astype(np.int64)
    at1 = trie.words(words)
    at2 = trie.children("2", at1[high(pairs, SECOND)], low(pairs, SECOND), SECOND)
    at3 = trie.children("3", at2[high(triples, THIRD)], low(triples, THIRD), THIRD)
    f = [trie.frequency(k, at)[of] for k, at, of in (("1", at1, of1), ("2", at2, of2), ("3", at3, of3))]
    out = [pack(*(x[e[k] : e[k + 1]] for x, e in zip(f, ends))) for k in range(len(parts))]
    return out, int((n1[words != START] > 0).sum())


def _answers(requests: DataFrame, shards: int) -> DataFrame:
    """A written table (block, shard, answer, kinds), kinds in one row of a shard."""

    def run(table: pa.Table) -> pa.Table:
        out, kinds = _answer([p.as_py() for p in table["part"]])
        n = len(out)
        answer = pa.table({"block": table["block"], "shard": table["shard"], "answer": pa.array(out, pa.binary()), "kinds": pa.array([kinds] + [0] * (n - 1), pa.int64())})
        del out
        give_back()
        return answer

    return written(requests.groupBy("shard").applyInArrow(run, "block long, shard int, answer binary, kinds long"), "ngram-answers")


# --- scores ----------------------------------------------------------------------


def _scored(blocks: DataFrame, answers: DataFrame, id_col: str, shards: int, spread: np.ndarray, total: int, kinds: int, weights: tuple[float, float]) -> DataFrame:
    held = blocks.sparkSession.sparkContext.broadcast(spread)
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        g = Grams(left["body"][0].as_py())
        p = g.parts(shards, held.value)
        f = [np.zeros(len(x), np.int64) for x in (g.n1, g.n2, g.n3)]
        for s, raw in zip(right["shard"].to_pylist(), right["answer"]):
            for x, at, home, ends, own in zip(f, p.at, p.home, p.ends, unpack(raw.as_py())):
                part = slice(ends[s], ends[s + 1])
                x[at[part][home[part]]] = own[home[part]]
        n1, n2, n3 = f[0].astype(float), restored(f[1]), restored(f[2])
        space = total + kinds + 1
        c1 = n1[g.word]
        p1 = (c1 + 1) / space
        p2 = (np.minimum(n2[g.pair], n1[g.before]) + weights[0] * p1) / (n1[g.before] + weights[0])  # a quantised count is not above its context's
        p3 = (n3[g.triple] + weights[1] * p2) / (n2[g.context] + weights[1])
        first = np.cumsum(g.sizes) - g.sizes
        add = lambda x: np.add.reduceat(x, first)
        out = {id_col: left["ids"].combine_chunks().flatten(), "n_tokens": pa.array(g.sizes), "n_known": pa.array(add((c1 > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(first), total, np.int64)), "base_score": pa.array(add(np.log10(p1))), "score": pa.array(add(np.log10(p3)))}
        del g, p, f, n1, n2, n3, c1, p1, p2, p3
        give_back()
        return pa.table(out)

    schema = f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.select("block", "ids", "body").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def score(docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", weights: tuple[float, float] = WEIGHTS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """A row for each document: the id, n_tokens, n_known, train_tokens, base_score, score.

    Texts are lower-cased (A-Z); their tokens are the words ``[^\\x20\\x09-\\x0D]+``
    and one end.  The model learns from the documents where ``learn`` is true (null:
    not).  ``base_score`` is the log10 probability under the training tokens' counts
    plus one, ``score`` that under the trie model of up to three tokens; an unknown
    word has the count 0 in both.  A null or empty text has its end alone.  Repeated
    rows and ids, and rows without an id, count and are scored as rows each.  Without
    a document to learn from every token is unknown.  A very long text is a block of
    its own, and memory follows it.  Other columns are ignored.  Words are told apart
    by 64 bits of hash, followers within a context by 40 and 32.
    """
    blocks = write_blocks(docs, id_col, text_col, learn)
    size = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all"), F.coalesce(F.sum("n_learnt"), F.lit(0)).alias("learnt")).first()
    shards = max(1, -(-size["all"] // shard_tokens))
    spread = np.zeros(0, _U64)
    if shards > 1:  # at most 2 * SPREAD * shards contexts
        often = max(2, shard_tokens // SPREAD // EVERY)
        rows = blocks.select(F.explode("sampled").alias("context")).groupBy("context").agg(F.count("*").alias("n")).where(F.col("n") >= often)
        spread = np.array([r.context for r in rows.select("context").collect()], np.int64).view(_U64)
    answers = _answers(_requests(blocks, shards, spread), shards)
    kinds = answers.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
    release(docs.sparkSession)  # the requests
    return _scored(blocks, answers, id_col, shards, spread, size["learnt"], kinds, weights)
