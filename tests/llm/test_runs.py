"""Periodic runs against their definition."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from test_operators import ODD, frame

from tidegraph.llm import queries, runs


def lyndon_by_definition(s):
    is_lyndon = lambda w: all(w < w[k:] for k in range(1, len(w)))
    return [max(j for j in range(1, len(s) - i + 1) if is_lyndon(s[i : i + j])) for i in range(len(s))]


def runs_by_definition(s, least, times):
    out = set()
    for p in range(1, len(s) // times + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            n = j - i + p
            if j > i and n >= max(least, times * p) and not any(s[i : i + n - q] == s[i + q : i + n] for q in range(1, p)):
                out.add((i, n, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_lyndon_arrays_and_runs():
    r = random.Random(1)
    for _ in range(600):
        k = r.randrange(1, 5)
        s = [r.randrange(k) for _ in range(r.randrange(1, 40))]
        if r.random() < 0.4:
            s = s[: len(s) // 3] + [r.randrange(k) for _ in range(r.randrange(1, 6))] * r.randrange(1, 7) + s[len(s) // 2 :]
        assert runs.lyndon_lengths(s) == lyndon_by_definition(s)
        for least, times in ((2, 2), (6, 3)):
            assert runs.runs_of(s, least, times) == runs_by_definition(s, least, times)


def expected(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs_by_definition(w, 24, 3)
    best = None
    for s, length, q in found:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def documents():
    r = random.Random(5)
    rows = [*(x for x in ODD if len(x[1] or "") < 1000), (903, "x " * 3000), (7, "la " * 23), (8, "la " * 24 + "é"), (9, "a b c d e f g h " * 3), (10, " ".join(["one two"] * 15 + ["two one"] * 15)), (None, "so " * 40)]
    for i in range(200):
        block = [r.choice("abcdefghij") for _ in range(r.randrange(1, 12))]
        rows.append((1000 + i, " \n".join([r.choice("uvwxyz") for _ in range(r.randrange(30))] + block * r.randrange(1, 9) + [r.choice("ab") for _ in range(r.randrange(40))] + block[::-1] * r.randrange(1, 9))))
    return rows


def test_query_by_definition(spark, tmp_path):
    rows = documents()
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is not None, x) for x in r)
    have, want = sorted(map(tuple, got.collect()), key=key), sorted((expected(*r) for r in rows), key=key)
    assert have == want
    assert sum(r[1] > 0 for r in have) > 60 and sum(r[1] > 1 for r in have) > 5


def test_one_word_for_most_of_the_rows(spark):
    rows = [(i, "same " * 50) for i in range(300)] + [(1000 + i, f"w{i} x") for i in range(20)]
    out = runs.find(frame(spark, rows).withColumn("Runs", F.lit(1)), min_length=10, exponent=2).collect()
    assert sum(len(r["runs"]) for r in out) == 300 and {r.collapsed for r in out if r.doc_id < 300} == {"same"}
    assert all(r.score == "mine" for r in out)


def test_empty_table(spark):
    assert runs.digest(runs.find(frame(spark, []))).collect() == []
