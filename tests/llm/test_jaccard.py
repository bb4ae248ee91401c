import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidegraph.llm import jaccard


def brute(rows, k, over, under):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and under * len(a & b) >= over * len(a | b):
                up[root(i)] = root(j)
                links[i] += 1
                links[j] += 1
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[root(i)].append(d)
    least = {r: min((x for x in v if x is not None), default=None) for r, v in groups.items()}
    return sorted(((d, len(s), least[root(i)], links[i]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    header = text(12)
    rows = []
    for b in range(12):
        base = (header if b % 2 else []) + text(r.choice([3, 8, 20, 60, 150]))
        for _ in range(r.choice([1, 2, 8])):
            copy = list(base)
            for _ in range(r.randrange(0, max(1, len(copy) // 18) + 1)):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "One"), (1004, "one"), (1005, "a b c"), (1006, "A B c"), (1007, rows[0][1]), (1007, rows[0][1]), (None, rows[3][1]), (1008, " ".join(text(4000))), (1009, "nur ein text mit nbsp hier drin")]
    return rows


@pytest.mark.parametrize("region", [6_000_000, 150])
@pytest.mark.parametrize("rule", [(4, 85, 100), (5, 80, 100), (1, 60, 100)])
def test_against_all_pairs(spark, rule, region):
    rows = corpus(sum(rule))
    df = spark.createDataFrame([(d, t, 7, "x") for d, t in rows], "doc_id long, text string, node long, g string")
    got = jaccard.join(df, jaccard.Rule(*rule), region=region, pivots=3)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, *rule)


def near_copies(r, n, words=4000):
    """Sets around some centres, at all distances, and some that share only a common part."""
    common = set(range(20))
    centres = [common | {r.randrange(words) for _ in range(80)} for _ in range(5)]
    out = []
    for k in range(n):
        s = set(r.choice(centres)) if k % 10 else common | {r.randrange(words) for _ in range(80)}
        for x in r.sample(sorted(s), r.choice([0, 1, 2, 5, 9, 20])):
            s.discard(x)
            s.add(10_000 + r.randrange(10**9))
        out.append(s)
    return out


def test_region_by_pivots(monkeypatch):
    """Several hundred classes in one task: links of every class and components against all pairs, with and without masks."""
    import numpy as np

    r = random.Random(7)
    for over, wide in ((85, 512), (80, 50), (60, 512)):
        monkeypatch.setattr(jaccard, "WIDE", wide)
        rule = jaccard.Rule(4, over, 100)
        sets = near_copies(r, 400)
        weights = [r.randrange(1, 4) for _ in sets]
        masks = [r.choice([0, 0, 1, 2, 4]) for _ in sets]
        for own in (None, masks):
            region = jaccard.Region([np.array(sorted(s), np.uint64) for s in sets], rule, weights, own)
            region.join()
            assert region.cells > 10 and region.windowed > 0
            links, pairs = [0] * len(sets), []
            for i, a in enumerate(sets):
                for j in range(i):
                    if 100 * len(a & sets[j]) >= over * len(a | sets[j]) and not (own and own[i] & own[j]):
                        links[i] += weights[j]
                        links[j] += weights[i]
                        pairs.append((i, j))
            assert region.links.tolist() == links and len(pairs) > 400

            def labels(edges):
                up = list(range(len(sets)))
                for a, b in edges:
                    a, b = up[a], up[b]
                    up = [min(a, b) if x in (a, b) else x for x in up]
                return up

            assert labels(region.edges) == labels(pairs) and set(region.edges) <= {p for x in pairs for p in (x, x[::-1])}


def test_large_regions_by_pivots(spark):
    """Regions of hundreds of classes, cut into cells and blocks by Spark, against all pairs."""
    r = random.Random(9)
    rows = [(k, " ".join(f"s{x}" for x in sorted(s))) for k, s in enumerate(near_copies(r, 150))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rule, region in (((1, 85, 100), 700), ((1, 60, 100), 3000)):
        got = jaccard.join(df, jaccard.Rule(*rule), region=region, pivots=4).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, *rule)


def test_names_of_own_columns(spark):
    rows = [(1, "a b c d e f", 7), (2, "a b c d e f", 8), (3, "x", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _own_doc long").withColumn("own_tag", F.lit(1)).withColumn("kept_doc", F.lit(2))
    got = jaccard.representatives(df, jaccard.Rule(5, 80, 100))
    assert got.columns == df.columns and sorted(tuple(x)[:3] for x in got.collect()) == [rows[0], rows[2]]


def test_bucket_beyond_what_a_task_holds(spark, monkeypatch):
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    docs = df.select("text")
    rule = jaccard.Rule(4, 85, 100)
    keep = lambda: {(x.key, x.node) for x in jaccard._shared_keys(docs, rule).collect()}
    whole = keep()
    monkeypatch.setattr(jaccard, "BUCKET_KEYS", 10)
    assert whole < keep()  # keys that one class has go on too


def test_representatives(spark):
    rows = corpus(3)
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string")
    got = jaccard.representatives(df, jaccard.Rule(5, 80, 100))
    assert got.columns == df.columns
    want = {d for d, _, c, _ in brute(rows, 5, 80, 100) if d is not None and d == c}
    ids = [r.doc_id for r in got.collect()]
    assert sorted(ids) == sorted(want)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join(df, jaccard.Rule()).collect() == []
    assert jaccard.representatives(df, jaccard.Rule()).collect() == []


def test_covering_never_misses():
    r = random.Random(5)
    import numpy as np

    for over in (60, 80, 85, 95):
        rule = jaccard.Rule(1, over, 100)
        for _ in range(300):
            n = r.choice([1, 2, 3, 5, 7, 8, 13, 40, 90])
            a = {r.getrandbits(64) for _ in range(n)}
            b = set(a)
            for x in r.sample(sorted(b), r.randrange(0, n // 5 + 1)):
                b.discard(x)
            b |= {r.getrandbits(64) for _ in range(r.randrange(0, n // 5 + 1))}
            if a != b and rule.linked(len(a & b), len(a), len(b)):
                ka, kb = (dict(zip(*(x.tolist() for x in rule.keys(np.array(sorted(s), np.uint64))))) for s in (a, b))
                c = rule.size_class(max(len(a), len(b)))
                common = [k for k in ka if k in kb and ka[k] >> 16 == kb[k] >> 16 == c]
                assert len(common) >= max(1, *(x[k] & 65535 for x in (ka, kb) for k in common))
