"""Language-model scores against plain counting, and the levels' sequences."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from test_operators import ODD, frame

from tidegraph.llm import eliasfano, ngrams, queries


def test_sequences():
    r = random.Random(1)
    for n, top in ((0, 1), (1, 1), (5, 10), (700, 1 << 64), (1000, 1000), (9000, 1 << 40), (40_000, (1 << 63) + 5), (3000, 4)):
        v = np.sort(np.array([r.randrange(top) for _ in range(n)], np.uint64))
        s = eliasfano.Sequence(eliasfano.mapped(eliasfano.encode(v, top)))
        keys = np.sort(np.r_[v[::3], np.array([r.randrange(top) for _ in range(300)], np.uint64)])
        place, same = s.successor(keys)
        assert (place == np.searchsorted(v, keys)).all() and (same == np.isin(keys, v)).all()
        assert all((s.values(a, min(n, a + 70)) == v[a : a + 70]).all() for a in range(0, n, max(1, n // 37)))
        assert (s.at(np.arange(n)) == v).all()


def test_packing_and_quantising():
    parts = [np.array([], np.uint64), np.array([0, 255, 256], np.uint64), np.array([(1 << 64) - 1, 3], np.uint64)]
    assert [x.tolist() for x in ngrams.unpack(ngrams.pack(*parts))] == [x.tolist() for x in parts]
    n = np.array([0, 1, 2047, 2048, 10**6, 10**15, (1 << 63) - 1])
    assert (np.abs(ngrams.restored(ngrams.quantised(n)) - n) <= 3e-4 * n).all() and (ngrams.restored(ngrams.quantised(n))[:3] == n[:3]).all()


def expected(rows, learn, weights):
    START, END = 0, 1
    tokens = lambda t: [START, START, *(t or "").encode().lower().split(), END]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for i, t in rows:
        if learn(i):
            w = tokens(t)
            c1.update(w[1:])
            c2.update(zip(w, w[1:]))
            c3.update(zip(w, w[1:], w[2:]))
    known = {k: n for k, n in c1.items() if k != START}
    n, v = sum(known.values()), len(known)
    out = []
    for i, t in rows:
        w, base, total = tokens(t), 0.0, 0.0
        for a, b, c in zip(w, w[1:], w[2:]):
            p1 = (known.get(c, 0) + 1) / (n + v + 1)
            p2 = (c2[b, c] - (b == c == START) + weights[0] * p1) / (c1[b] + weights[0])
            p3 = (c3[a, b, c] + weights[1] * p2) / (c2[a, b] + weights[1])
            base += math.log10(p1)
            total += math.log10(p3)
        out.append((i, len(w) - 2, sum(x in known for x in w[2:]), n, base, total))
    return out


def corpus():
    r = random.Random(3)
    words = [f"w{k}" for k in range(40)] + ["É", "A", "a", "x,"]
    rows = [(i, " ".join(r.choices(words, [1 / (k + 1) for k in range(len(words))], k=r.randrange(60)))) for i in range(250)]
    return [*ODD, *rows, *rows[:20], *((2000 + i, "one very common passage of words") for i in range(80))]


def compare(got, want):
    key = lambda r: (r[0] is not None, r)
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert all(abs(a - b) < 1e-6 * max(1, abs(b)) for x, y in zip(got, want) for a, b in zip(x[4:5], y[4:5]))
    # each of two quantised counts is off by a factor of 1.0003 at most
    assert all(abs(x[5] - y[5]) < 1e-6 + 3e-4 * x[1] for x, y in zip(got, want))


def test_scores_by_definition_on_one_and_many_shards(spark, monkeypatch):
    rows, odd = corpus(), F.col("doc_id") % 3 != 0
    want = expected(rows, lambda i: i is not None and i % 3 != 0, ngrams.WEIGHTS)
    docs = frame(spark, rows).repartition(3)
    compare(ngrams.score(docs, odd).collect(), want)
    monkeypatch.setattr(ngrams, "EVERY", 4)  # contexts of the frequent words are spread
    compare(ngrams.score(docs, odd, shard_tokens=500).collect(), want)
    assert ngrams.score(docs.limit(0), odd).collect() == []
    compare(ngrams.score(docs, F.lit(None).cast("boolean")).collect(), expected(rows, lambda i: False, ngrams.WEIGHTS))


def test_parts_hold_every_count_once_however_contexts_are_spread():
    r = random.Random(5)
    h = np.array([r.choice([3, 5, 9, 11, 1 << 63]) * 0x9E3779B97F4A7C15 % (1 << 64) for _ in range(400)] + [int(ngrams.END)], np.uint64)
    words, of, n = np.unique(h, return_inverse=True, return_counts=True)
    g = ngrams.Grams(ngrams.pack(words, of, np.array([len(h)]), np.array([1])))
    spread = np.r_[words[:2], ngrams._pair_hash(words[:2], words[:2])]
    for hot in (spread, spread[:0]):
        p = g.parts(7, hot)
        for at, home, count in zip(p.at, p.home, (g.n1, g.n2, g.n3)):
            assert sorted(at[home].tolist()) == list(range(len(count)))
        assert [int(k.sum()) for k in p.kids] == [len(p.at[1]), len(p.at[2])]
    assert len({s for s in range(7) if p.ends[2][s] < p.ends[2][s + 1]}) <= 7


def test_query(spark, tmp_path):
    rows = corpus()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_lm_scoring(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = got.collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    assert all(r.held_out == out(r.doc_id) for r in got)
    compare([(r[0], *r[2:]) for r in got], expected(rows, lambda i: i is not None and not out(i), ngrams.WEIGHTS))
    held = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
