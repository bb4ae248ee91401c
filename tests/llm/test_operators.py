"""Small fixtures with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import json
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegraph.llm import bytegrams, chat, decontamination, langid, packing, pii, quality, queries, substrings, textkit, topk, toxicity

ODD = [(900, None), (901, ""), (902, " \n "), (903, "x " * 30_000), (904, "tie"), (904, "tie"), (None, "no id")]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"score": F.lit("mine"), "n": F.lit(1)}) if extra else df


def test_words_and_hashes():
    texts = ["a  b\tc\x0bd", "", "é é x", None, " lead", "A" * 40_000 + " b"]
    got = []
    for i, j, buf, offsets in textkit.chunks(pa.array(texts), limit=8):
        w = textkit.Words(buf, offsets)
        h = w.hashes()
        for d in range(j - i):
            part = slice(w.first[d], w.first[d + 1])
            got.append([(bytes(buf[s:e]), int(x)) for s, e, x in zip(w.start[part], w.end[part], h[part])])
    assert [[w for w, _ in g] for g in got] == [(t or "").encode().split() for t in texts]
    seen = {w: h for g in got for w, h in g}
    assert len(set(seen.values())) == len(seen) and all(seen[w] == h for g in got for w, h in g)


# --- op2 --------------------------------------------------------------------------


def test_tiling_by_definition():
    r = random.Random(4)
    for _ in range(60):
        a = [r.randrange(4) for _ in range(r.randrange(3, 14))]
        b = [r.randrange(4) for _ in range(r.randrange(3, 30))]
        free_a, free_b, want = [True] * len(a), [True] * len(b), 0
        while True:
            best = (0, 0, 0)
            for p in range(len(a)):
                for q in range(len(b)):
                    n = 0
                    while p + n < len(a) and q + n < len(b) and free_a[p + n] and free_b[q + n] and a[p + n] == b[q + n]:
                        n += 1
                    if n > best[0]:
                        best = (n, p, q)
            n, p, q = best
            if n < 3:
                break
            want += n
            free_a[p : p + n] = [False] * n
            free_b[q : q + n] = [False] * n
        tiles = decontamination.tiling(np.array(a, np.uint64), np.array(b, np.uint64))
        used_a, used_b = [x for p, _, n in tiles for x in range(p, p + n)], [x for _, q, n in tiles for x in range(q, q + n)]
        assert len(set(used_a)) == len(used_a) and len(set(used_b)) == len(used_b)
        assert all(a[p : p + n] == b[q : q + n] for p, q, n in tiles)
        first = max((n for _, _, n in tiles), default=0)
        assert sum(n for _, _, n in tiles) == want or first >= 3  # equal lengths may be marked in another order


def test_decontamination(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    words = item.split()
    rows = [(1, f"before {item} after"), (2, "x " + " ".join(words[6:] + ["sep"] + words[:6]).upper()), (3, " ".join(words[:5])), (4, "clean text with nothing in it at all"), *ODD]
    bench = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, "too short", 1), (10, "", 1)], "item_id long, text string, doc_id int")
    for block in (2_000_000, 5):
        got = decontamination.leaks(frame(spark, rows), bench, block_words=block).collect()
        assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 7), (2, 7)]
    assert {r.doc_id: r.tiles for r in got} == {1: 1, 2: 2}
    kept = decontamination.clean(frame(spark, rows), bench)
    assert kept.columns == ["doc_id", "text", "score", "n"] and kept.count() == len(rows) - 2
    assert decontamination.leaks(frame(spark, []), bench).count() == 0
    assert decontamination.leaks(frame(spark, rows), bench.limit(0)).count() == 0


def test_leaks_in_short_phrases():
    """Passages in phrases of three words, with every fifth word changed, and short items; all pairs against the tiling."""
    item = [f"w{k}" for k in range(30)]
    phrases = [item[k : k + 3] for k in range(0, 30, 3)]
    texts = [" ".join(w for p in phrases[::-1] for w in (*p, "gap")), " ".join("other" if k % 5 == 4 else w for k, w in enumerate(item)), "see how it goes", "so see how it goes on", None]
    index = decontamination.Index([1, 2, 3], [" ".join(item), "see how it", "see how it goes"])
    ((_, _, buf, offsets),) = textkit.chunks(pa.array(texts))
    got = [(d, x, n, of) for d, x, n, of, _ in index.leaks(buf, offsets)]
    assert got == [(0, 0, 30, 30), (1, 0, 24, 30), (2, 1, 3, 3), (2, 2, 4, 4), (3, 1, 3, 3), (3, 2, 4, 4)]
    r = random.Random(5)
    for vocabulary in (3, 6, 40):
        items = [" ".join(f"v{r.randrange(vocabulary)}" for _ in range(r.randrange(0, 14))) for _ in range(40)]
        texts = [" ".join(f"v{r.randrange(vocabulary)}" for _ in range(r.randrange(0, 40))) for _ in range(40)]
        for t in range(20):
            own = r.choice(items).split()
            at = r.randrange(0, len(own) + 1)
            texts.append(" ".join(own[at:] + ["cut"] + own[:at]))
        index = decontamination.Index(list(range(40)), items)
        ((_, _, buf, offsets),) = textkit.chunks(pa.array(texts))
        h, first = decontamination.words_of(buf, offsets)
        want = []
        for d in range(len(texts)):
            for x, own in enumerate(index.items):
                n = sum(t[2] for t in decontamination.tiling(own, h[first[d] : first[d + 1]]))
                if len(own) and n >= 0.8 * len(own):
                    want.append((d, x))
        assert want and [(d, x) for d, x, *_ in index.leaks(buf, offsets)] == want


# --- op3 --------------------------------------------------------------------------


def ppm_length(docs, text, base):
    """Code length of a text by the definition, with counts taken afresh."""
    fold = lambda t: [s for s in _symbols(t)]
    counts = [{} for _ in range(4)]
    for d in docs:
        s = [0, 0, 0, *fold(d)]
        for i in range(3, len(s)):
            for k in range(4):
                c = counts[k].setdefault(tuple(s[i - k : i]), {})
                c[s[i]] = c.get(s[i], 0) + 1
    total, s = 0.0, [0, 0, 0, *fold(text)]
    for i in range(3, len(s)):
        p, k = 1.0, 3
        while True:
            c = counts[k].get(tuple(s[i - k : i]), {})
            n, q = sum(c.values()), len(c)
            if s[i] in c:
                p *= c[s[i]] / (n + q)
                break
            if n:
                p *= q / (n + q)
            k -= 1
            if k < 0:
                p /= base
                break
        total -= np.log(p)
    return total


def _symbols(text):
    out = []
    for b in text.encode():
        s = int(bytegrams.FOLD[b])
        if s or not out or out[-1]:
            out.append(s)
    return out


def test_code_lengths_by_definition(spark):
    docs = [(1, "the cat and the hat", "en"), (2, "der Hund und die Katze", "de"), (3, "that the", "en"), (4, "Füße über", "de"), (5, None, "en"), (6, "x", None)]
    model = langid.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    for text in ("the hund", "über the", "q!!z", "katze und hat."):
        ((_, _, buf, offsets),) = textkit.chunks(pa.array([text]))
        got, _ = model.lengths(buf, offsets)
        for k, lang in enumerate(model.languages):
            assert got[0, k] == pytest.approx(ppm_length([t for _, t, x in docs if x == lang and t], text, model.base), abs=0.02)


def test_large_alphabets_keep_the_contexts():
    """All 64 continuation bytes in four languages, and forty languages: contexts stay at three bytes."""
    wide = "".join(map(chr, range(0x400, 0x440))) + "の\U0001f600 abcdefghijklmnopqrstuvwxyz"
    for languages in (4, 40):
        texts = [[f"{wide} thab{x}", f"{x}qu{x} abc the thaw"] for x in (chr(97 + k % 26) * (1 + k // 26) for k in range(languages))]
        code, n, cls = [], [], []
        for k, own in enumerate(texts):
            for t in own:
                s = [0, 0, 0, *_symbols(t)]
                c = [sum(x * bytegrams.SYMBOLS ** (3 - j) for j, x in enumerate(s[i - 3 : i + 1])) for i in range(3, len(s))]
                code += c
                cls += [k] * len(c)
        model = langid.PpmModel([f"l{k:02}" for k in range(languages)], np.array(code), np.ones(len(code), np.int64), np.array(cls))
        assert model.order == 3 and model.base > 64
        for text in ("thabc", "the q\U0001f600 я", "zz abd"):
            ((_, _, buf, offsets),) = textkit.chunks(pa.array([text]))
            for _ in range(2):  # the second from the lengths at hand
                got, _ = model.lengths(buf, offsets)
                for k, own in enumerate(texts):
                    assert got[0, k] == pytest.approx(ppm_length(own, text, model.base), abs=0.02)


def test_models_hold_all_grams(spark, monkeypatch):
    """No count is left out of the models: a limit on what they gather would show."""
    docs = [(1, "aaaaaaaa aaaaaaaa aaaaaaaa", "hot"), (2, "xyzzy plugh", "rare"), (3, "Füße über", "de")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    limit = type(df).limit
    monkeypatch.setattr(type(df), "limit", lambda self, n: limit(self, min(n, 3)))
    model = langid.train(df)
    assert model.languages == ["de", "hot", "rare"]
    sizes = np.array([len(_symbols(t)) for _, t, _ in sorted(docs, key=lambda x: x[2])])
    assert model.prior == pytest.approx(-np.log(sizes / sizes.sum()))
    whole = toxicity.language_model(df)
    for m, texts in ((model, [t for _, t, x in docs if x == "rare"]), (whole, [t for _, t, _ in docs])):
        ((_, _, buf, offsets),) = textkit.chunks(pa.array(["xyzzy plugh"]))
        assert m.lengths(buf, offsets)[0][0, -1] == pytest.approx(ppm_length(texts, "xyzzy plugh", m.base), abs=0.02)


def test_language_ids(spark):
    learn = spark.createDataFrame([("the of and this that with", "en"), ("der die das und nicht mit", "de")], "text string, lang string")
    model = langid.train(learn)
    rows = [(1, "this and that"), (2, "nicht das"), (3, "123 ..."), *ODD]
    got = {r.doc_id: r for r in langid.predict(frame(spark, rows), model).collect()}
    assert (got[1].lang_pred, got[2].lang_pred, got[3].lang_pred, got[900].lang_pred, got[901].lang_pred) == ("en", "de", "und", "und", "und")
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1].n == 1
    none = langid.predict(frame(spark, rows), langid.train(learn.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"}


# --- op4 --------------------------------------------------------------------------


def test_toxicity(spark):
    r = random.Random(1)
    syllables = ["ta", "ne", "mo", "ri", "lu", "sen", "dor", "vil"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 4)))
    rows, labels = [], []
    for d in range(300):
        words, bad = [word() for _ in range(30)], d % 3 == 0
        if bad:
            words[r.randrange(30)] = "grumpold"
        rows.append((d, " ".join(words)))
        labels.append((d, int(bad), 5))
    base = " ".join(word() for _ in range(20))
    tests = [(1001, f"{base} grumpold"), (1002, base), (1003, f"{base} gr7mp0ld"[:-8] + "grump0ld"), (1004, f"{base} g r u m p o l d"), (1005, f"{base} GRUMPOOOOLD!!"), (1006, f"{base} g.r.u.m.p.o.l.d"), *ODD]
    docs, marks = frame(spark, rows + tests), spark.createDataFrame([*labels, (None, 1, 5), (3, None, 5)], "doc_id long, toxic int, score int")
    scorer, held = toxicity.fitted(docs, docs, marks)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, scorer, held).collect()}
    assert [got[k] for k in (1001, 1002, 1003, 1004, 1005, 1006)] == [1, 0, 1, 1, 1, 1]
    assert got[900] == got[901] == got[903] == 0
    assert sum(got[d] != y for d, y, _ in labels) == 0
    kept = toxicity.clean(docs, scorer, held)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 105
    blank, held = toxicity.fitted(docs.limit(0), docs.limit(0), marks.limit(0))
    assert blank is None and {r.score for r in toxicity.score(docs, blank, held).collect()} == {0.0}


def test_gate_lets_hidden_words_through():
    class Recorder:
        def restore(self, token):
            seen.append(token)
            return token

    for text, want in (
        ("un i m b é c i l e là", ["imbécile"]),
        ("so i. d. i. o. t. it is", ["idiot"]),
        ("an !diot |diot !!!diot (rap", ["!diot", "|diot", "!!!diot", "(rap"]),
        ("ro++ gr€mp £iar 1234d", ["ro++", "gr€mp", "£iar", "1234d"]),
        ("! d 1 0 t", ["!d10t"]),
        ("a b – c d x", ["cdx"]),
        ("plain words, here. – • é a", []),
    ):
        seen = []
        ((_, _, buf, offsets),) = textkit.chunks(pa.array([text]))
        toxicity.features(buf, offsets, Recorder())
        assert seen == want
    seen = []
    ((_, _, buf, offsets),) = textkit.chunks(pa.array(["x a b", "c d e f", ""]))
    toxicity.features(buf, offsets, Recorder())
    assert seen == ["xab", "cdef"]


def test_decoding_by_brute_force():
    r = random.Random(17)
    parts = []
    for _ in range(60):
        text = " ".join(r.choice(["idiot", "moron", "creep", "tiger", "ole", "boat", "née"]) for _ in range(r.randrange(1, 9)))
        symbols, places, _ = bytegrams.folded(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        parts.append(np.unique(bytegrams.grams(symbols, places), return_counts=True))
    code, n = bytegrams.merged(parts)
    model = langid.PpmModel([""], code.astype(np.int32), n, np.zeros(len(code), np.int64))
    decoder = toxicity.Decoder(model)
    some = np.unique(np.r_[[r.randrange(model.base**4) for _ in range(3000)], [r.randrange(40) for _ in range(20)]])
    want = model.costs(some.astype(np.int32))[:, 0] / langid.PARTS
    assert [decoder._cost(int(g)) for g in some] == want.tolist()

    def length(text_and_extra):
        total, seen = 0.0, [0, 0, 0]
        for text, extra in text_and_extra:
            total += extra
            for s in bytegrams.FOLD[np.frombuffer(text.encode(), np.uint8)].tolist():
                if s or seen[-1]:
                    seen.append(s)
                    gram = 0
                    for x in seen[-4:]:
                        gram = gram * model.base + int(model.alphabet[x])
                    total += float(model.costs(np.array([gram], np.int32))[0, 0]) / langid.PARTS
        return total

    for token in ("1d10t", "m0r0n", "t1g3r", "b0@t", "cr33p", "id-iot", "oooole", "!d|ot", "née", "q7x", "1", "--"):
        paths = [(*p, (" ", 0.0)) for p in itertools.product(*decoder._options(token))]
        costs = [length(p) for p in paths]
        best = {"".join(t for t, _ in p).strip() for p, c in zip(paths, costs) if c < min(costs) + 1e-9}
        assert decoder.restore(token) in best


# --- op5 --------------------------------------------------------------------------


def without_repeats(rows, k):
    low = {}
    for d, t in rows:
        w = (t or "").encode().split()
        if d is not None:
            for i in range(len(w) - k + 1):
                s = tuple(w[i : i + k])
                low[s] = min(low.get(s, d), d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        keep = [True] * len(w)
        for i in range(len(w) - k + 1):
            if d is not None and low[tuple(w[i : i + k])] < d:
                keep[i : i + k] = [False] * k
        kept = [x for x, y in zip(w, keep) if y]
        out.append((d, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("k,m,held", [(13, 3, 1 << 24), (4, 2, 1 << 24), (3, 3, 1 << 24), (4, 2, 300), (13, 3, 1000)])
def test_windows_by_brute_force(spark, monkeypatch, k, m, held):
    monkeypatch.setattr(substrings, "BUCKET_TEXT", held)  # buckets beyond it give out their windows one by one
    r = random.Random(k)
    passage = [f"p{i}" for i in range(25)]
    rows = []
    for d in range(40):
        words = [f"w{r.randrange(60)}" for _ in range(r.randrange(0, 50))]
        if d % 3 == 0:
            at = r.randrange(len(words) + 1)
            words[at:at] = passage[r.randrange(3) : 25 - r.randrange(3)]
        rows.append((r.randrange(30), ("\n" if d % 5 else "  ").join(words)))
    rows += ODD + [(50, rows[3][1]), (51, rows[3][1]), (905, "x " * 500)]
    got = substrings.deduplicate(frame(spark, rows), window=k, minimiser=m, batch_bytes=500)
    assert sorted(map(tuple, got.collect()), key=str) == without_repeats(rows, k)
    assert substrings.deduplicate(frame(spark, [])).count() == 0


def kept_rows(monkeypatch):
    """What substrings keeps in the checkpoint folder, filled as it runs."""
    kept, cut = [], substrings.cut
    monkeypatch.setattr(substrings, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    return kept


def test_buckets_follow_the_text_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET_TEXT", 1 << 20)
    kept = kept_rows(monkeypatch)
    words = F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.substring(F.hex(F.xxhash64(F.col("doc_id") % 3900, i)), 3, 6))
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))
    got = substrings.deduplicate(docs).agg(F.count("*"), F.sum("n_removed"), F.min("doc_id").alias("least")).first()
    assert tuple(got) == (4000, 100 * 300, 0)
    assert all(df.where("one is not null").isEmpty() for df in kept)  # no window on a row of its own, which takes several times its text


def test_turns_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET_TEXT", 2000)
    monkeypatch.setattr(substrings, "TURN_BYTES", 1)
    kept = kept_rows(monkeypatch)
    r = random.Random(5)
    rows = [(r.randrange(100), " ".join(r.choice("ab") for _ in range(r.randrange(120)))) for _ in range(120)]  # few minimisers, so some are beyond a bucket
    rows += [(r.randrange(100, 200), " ".join(f"w{r.randrange(9)}" for _ in range(r.randrange(60)))) for _ in range(60)]
    rows += ODD + [(300, rows[3][1]), (301, rows[3][1]), (302, rows[150][1])]
    got = substrings.deduplicate(frame(spark, rows), batch_bytes=500)
    assert sorted(map(tuple, got.collect()), key=str) == without_repeats(rows, 13)
    assert len(kept) == 2 and any(not df.where("one is not null").isEmpty() for df in kept)


# --- op6 --------------------------------------------------------------------------


def test_search_by_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=20)]) for i in range(300)]
    rows += [(400, rows[0][1]), (401, rows[0][1]), (500, None), (501, [float("nan")] * 20), (502, [1.0] * 19 + [None]), (None, rows[1][1]), (600, [1e20] * 20), (503, []), (700, [1.0, 2.0]), (701, [3.0, 4.0])]
    rows += [(800, [-3e38] * 20), (801, [2.5e20] + [0.0] * 19), (802, [1e20] * 20), (803, [1e9] * 10 + [-1e9] * 10), (804, [1e18, -1e18] * 10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    v = topk.quantised(df, "vec_id", "embedding")
    full = {i: [math.floor(1024 * float(np.float32(x))) for x in e] for i, e in rows if i is not None and e and i not in (500, 501, 502)}
    want = []
    for q in full:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(full[q], full[c])), c) for c in full if c != q and len(full[c]) == len(full[q]))[:10]
            want += [(q, k + 1, c, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for k, (s, c) in enumerate(best)]
    for query_block in (2, 4096):
        got = topk.search(v, v.where("id % 100 = 0"), block=4, query_block=query_block).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert topk.search(v.limit(0), v.limit(0)).count() == 0


def test_large_scores_stay_exact():
    q = np.array([1 << 28] * 4, np.int64)
    m = np.array([[1 << 28, 1, 1, i] for i in range(5)], np.int64)
    got = topk.Block(np.arange(5), m, 2).search(-1, q, 2, -np.inf)
    assert got == [((1 << 28) * ((1 << 28) + 2 + i), i) for i in (4, 3)]
    values = [0, (1 << 63) - 1, -(1 << 63), 1 << 63, 1 << 64, 1 << 200, -(1 << 63) - 1, -(1 << 64), -(1 << 200)]
    clamp = lambda s: (max(-(1 << 63), min((1 << 63) - 1, s)), topk._beyond(s))
    assert sorted(values, key=clamp) == sorted(values)


# --- op7 --------------------------------------------------------------------------


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    assert t.encode("end <|endoftext|> here", add_special_tokens=False).ids[2] == 50256
    texts = ["Hello world", "a  b\n\n c", "<|endoftext|> plain", "end <|endoftext|> here", "a<|endoftext|><|endoftext|>  b", "<|endoftext| >", "日本 語", "it's  ", "word " * 5000, *[f"doc {i} " * (i * 7 % 90) for i in range(60)]]
    rows = [*enumerate(texts), *ODD]
    pieces = packing.pack_documents(frame(spark, rows), queries.vocabulary(), with_ids=True, batch_docs=16).collect()
    want = sorted([*t.encode(x or "", add_special_tokens=False).ids, 1] for _, x in rows)
    whole, sequences = {}, {}
    for p in pieces:
        assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 and len(p.ids) == p.length
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length, p.tier))
    for p in sorted(pieces, key=lambda p: (str(p.doc_id), p.start)):
        if p.doc_id not in (904,):
            whole.setdefault(p.doc_id, []).extend(p.ids)
    doubled = [list(p.ids) for p in pieces if p.doc_id == 904]
    assert sorted(x for x in whole.values()) == sorted(x for x in want if x != t.encode("tie").ids + [1]) and sum(map(len, doubled)) == 2 * len(t.encode("tie").ids + [1])
    for parts in sequences.values():
        at = 0
        for offset, length, tier in sorted(parts):
            assert offset == at
            at += length
        assert at == tier  # full windows, or full at a power of two: no padding
    assert packing.pack_documents(frame(spark, []), queries.vocabulary()).count() == 0


def test_tiers():
    """Units go to the tier of their size, sequences are full at it, and only the rest of a batch is left."""
    r = random.Random(3)
    for tiers in (packing.TIERS, (100, 30, 7), (8,)):
        packer = packing.Packer(tiers)
        sizes = [min(int(r.paretovariate(0.7)), 9000) for _ in range(500)]
        done = 0
        for k, n in enumerate(sizes):
            packer.add(k, n)
            if k % 100 == 99:
                assert all(n <= t and not any(n <= x < t for x in tiers) for t in tiers for n, _, _ in packer.units[t])
                packer.pack()
                assert packer.left < tiers[0] and all(p[5] in tiers for p in packer.pieces[done:])
                done = len(packer.pieces)
        assert len({p[5] for p in packer.pieces}) == len(tiers)  # every tier has sequences of its own
        openers = {p[3]: p[2] for p in packer.pieces if p[4] == 0}
        size = {p[3]: p[5] for p in packer.pieces}
        if tiers == packing.TIERS:  # a sequence opens with a unit of its tier
            assert all(2 * openers[s] > size[s] or size[s] == tiers[-1] for s in openers)
        packer.finish()
        assert packer.left == 0 and not packer.documents()
        filled, tokens = {}, {}
        for d, at, n, s, o, t in packer.pieces:
            assert filled.get(s, 0) == o
            filled[s] = o + n
            tokens.setdefault(d, []).append((at, n))
        assert all(filled[p[3]] == p[5] for p in packer.pieces)
        for d, parts in tokens.items():
            at = 0
            for a, n in sorted(parts):
                assert a == at
                at += n
            assert at == sizes[d]


def test_step_groups_are_even():
    packer = packing.Packer()
    for k in range(400):
        packer.add(k, random.Random(k).randrange(1, 5000))
    packer.pack()
    packer.finish()
    pieces = packer.pieces
    groups = packing.balance(pieces, 16)
    cost = {}
    for _, _, n, s, _, _ in pieces:
        cost[groups[s]] = cost.get(groups[s], 0) + n * n
    assert max(cost.values()) < 1.3 * sum(cost.values()) / len(cost)


# --- op8 --------------------------------------------------------------------------


def test_chat(spark):
    c = lambda *x: json.dumps({"content": "hm\n", "tool_calls": list(x)})
    rows = [
        (1, 0, "user", 'hi "x"'),
        (1, 1, "assistant", c({"id": "a", "name": "search", "arguments": {"query": "q", "limit": 3}}, {"id": "b", "name": "calculator", "arguments": '{"z":1,"expression":"${a}+1"}'})),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "r"})),
        (1, 0, "tool", json.dumps({"tool_call_id": "b", "content": "early"})),
        (2, 0, "assistant", c({"id": "a", "name": "nope", "arguments": {}})),
        (2, 1, "tool", json.dumps({"tool_call_id": "zz"})),
        (3, 0, None, None),
        (None, None, "user", "x"),
        (4, 0, "assistant", c({"id": "p", "name": "search", "arguments": {"query": "${q}"}}, {"id": "q", "name": "search", "arguments": {"query": ["${p}"]}})),
        (4, 1, "assistant", "{bad json"),
        (5, 0, "user", "same"),
        (5, 0, "user", "same"),
        (6, 0, "assistant", c({"id": "d", "name": "search", "arguments": {}}, {"id": "d", "name": "search", "arguments": "no json"})),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(1))
    got = chat.format_messages(df, queries.TOOLS).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn, r.role): r for r in got}
    call = by[1, 1, "assistant"]
    assert (call.n_calls, call.n_linked, call.errors) == (2, 2, "b: unknown fields z")
    assert call.message_json == '{"content":"hm\\n","conv_id":1,"role":"assistant","tool_calls":[{"arguments":{"limit":3,"query":"q"},"id":"a","name":"search"},{"arguments":{"expression":"${a}+1","z":1},"id":"b","name":"calculator"}],"turn":1}'
    order = sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.seq_turn, r.seq_level, r.turn))
    assert [(r.role, r.turn) for r in order] == [("user", 0), ("assistant", 1), ("tool", 0), ("tool", 2)]
    assert by[2, 0, "assistant"].errors == "a: no result; a: unknown tool" and by[2, 1, "tool"].errors == "zz: no call"
    assert "cycle" in by[4, 0, "assistant"].errors and "query is not string" in by[4, 0, "assistant"].errors
    assert by[4, 1, "assistant"].n_calls == 0 and json.loads(by[4, 1, "assistant"].message_json)["content"] == "{bad json"
    assert "identifier used twice" in by[6, 0, "assistant"].errors and "not JSON" in by[6, 0, "assistant"].errors and "query is missing" in by[6, 0, "assistant"].errors
    assert by[3, 0, None].message_json == '{"conv_id":3,"turn":0}' and by[None, None, "user"].message_json == '{"content":"x","role":"user"}'
    assert all(json.loads(r.message_json) is not None for r in got)
    assert chat.format_messages(df.limit(0)).count() == 0
    assert chat.format_messages(df.where("role = 'tool'")).count() == 3


def _plain_chat(rows):
    """(conv, turn, role, seq_turn, seq_level, n_calls, n_linked, errors) of each row by plain loops; no schemas."""
    last = (1 << 63) - 1
    messages = []
    for conv, turn, role, text in rows:
        try:
            j = json.loads(text) if (text or "").lstrip().startswith("{") else {}
        except ValueError:
            j = {}
        calls = [(c.get("id"), c.get("name"), c.get("arguments")) for c in j.get("tool_calls") or ()] if role == "assistant" else []
        result = j.get("tool_call_id") if role == "tool" else None
        messages.append((conv, last if turn is None else turn, role, text, calls, result))
    node = lambda m: (m[0], m[1], m[2], m[3])
    order = {node(m): h for m, h in zip(messages, _plain_chat.hashes(messages))}
    owner, answers = {}, {}
    for m in messages:
        for place, (i, _, _) in enumerate(m[4]):
            if i is not None and m[0] is not None:
                owner[m[0], i] = min(owner.get((m[0], i), (last + 1,)), (m[1], order[node(m)], place, node(m)))
        if m[5] is not None and m[0] is not None:
            answers.setdefault((m[0], m[5]), []).append(m)
    text_of = lambda a: a if isinstance(a, str) else json.dumps(a)
    needs = {}  # call: identifiers
    edges = {}  # message: messages
    for m in messages:
        for i, _, a in m[4]:
            if i is None or m[0] is None:
                continue
            for y in re.findall(r"\$\{([^}]*)\}", text_of(a) or ""):
                if (m[0], y) in owner:
                    needs.setdefault((m[0], i), set()).add((m[0], y))
                    at = owner[m[0], y][3]
                    if at != node(m):
                        edges.setdefault(node(m), set()).add(at)
                        edges[node(m)] |= {node(x) for x in answers.get((m[0], y), ())}
        if m[5] is not None and (m[0], m[5]) in owner:
            edges.setdefault(node(m), set()).add(owner[m[0], m[5]][3])

    def peel(nodes, needs):
        done = {}
        while True:
            new = {x: 1 + max([done[y] for y in needs.get(x, ())], default=-1) for x in nodes if x not in done and all(y in done for y in needs.get(x, ()))}
            if not new:
                return done
            done |= new

    depth = peel(set(owner), needs)
    free = peel({node(m) for m in messages}, edges)
    late = {m[0] for m in edges for d in edges[m] if d[1] >= m[1]}
    places = {}
    for x in sorted(free, key=free.get):
        under = max([places[d] for d in edges.get(x, ())], default=(-1, 0))
        places[x] = (under[0], under[1] + 1) if under[0] >= x[1] else (x[1], 0)
    out = []
    for m in messages:
        seq = places.get(node(m), (m[1], 1 << 20)) if m[0] in late else (m[1], 0)
        errors, linked = [], 0
        per = []
        for place, (i, _, a) in enumerate(m[4]):
            own = owner.get((m[0], i)) if m[0] is not None else None
            first = own is not None and own[:3] == (m[1], order[node(m)], place)
            n = len(answers.get((m[0], i), ())) if m[0] is not None else 0
            linked += first and n > 0
            found = []
            if i is None:
                found.append("?: no identifier")
            elif m[0] is not None and not first:
                found.append(f"{i}: identifier used twice")
            if not n:
                found.append(f"{i if i is not None else '?'}: no result")
            if i is not None and m[0] is not None and ((m[0], i) not in depth or (m[0] in late and node(m) not in places)):
                found.append(f"{i}: cycle")
            per.append((depth.get((m[0], i), 1 << 20), place, found))
        errors = [e for _, _, f in sorted(per) for e in f]
        if m[5] is not None:
            linked = int(m[0] is not None and (m[0], m[5]) in owner)
            errors = [] if linked else [f"{m[5]}: no call"]
        out.append((m[0], None if m[1] == last else m[1], m[2], None if seq[0] == last else seq[0], seq[1], len(m[4]), linked, "; ".join(errors)))
    return sorted(out, key=str), edges


def test_chat_by_definition(spark):
    """Random conversations with nulls, cycles, duplicates, forward references and early results against plain loops."""
    r = random.Random(21)
    ids = ["a", "b", "c", "d", "e", None]
    rows = []
    for conv in [*range(40), None]:
        for turn in range(r.randrange(1, 9)):
            at = r.choice([turn, turn, turn, None, r.randrange(9)])
            kind = r.random()
            if kind < 0.45:
                refs = lambda: " ".join(f"${{{r.choice('abcdef')}}}" for _ in range(r.choice([0, 0, 1, 2])))
                calls = [{"id": r.choice(ids), "name": "f", "arguments": {"x": refs()}} for _ in range(r.randrange(1, 3))]
                rows.append((conv, at, "assistant", json.dumps({"tool_calls": calls})))
            elif kind < 0.85:
                rows.append((conv, at, "tool", json.dumps({"tool_call_id": r.choice("abcde"), "content": str(r.randrange(3))})))
            else:
                rows.append((conv, at, r.choice(["user", None]), "hi"))
            if r.random() < 0.1:
                rows.append(rows[-1])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_messages(df).collect()
    keyed = {(x.role, x.text): x.h for x in df.select("role", "text", F.xxhash64("role", "text").alias("h")).collect()}
    _plain_chat.hashes = lambda messages: [keyed[m[2], m[3]] for m in messages]
    want, edges = _plain_chat(rows)
    assert sorted(((x.conv_id, x.turn, x.role, x.seq_turn, x.seq_level, x.n_calls, x.n_linked, x.errors) for x in got), key=str) == want
    assert sum("cycle" in w[7] for w in want) > 5 and sum(0 < w[4] < 1 << 20 for w in want) > 20
    # the order is topological wherever there is one
    last = (1 << 63) - 1
    place = {}
    for x in got:
        place.setdefault((x.conv_id, x.turn, x.role), []).append((last if x.seq_turn is None else x.seq_turn, x.seq_level))
    for m, needed in edges.items():
        for d in needed:
            mine, other = (place[n[0], None if n[1] == last else n[1], n[2]] for n in (m, d))
            if len(set(mine)) == len(set(other)) == 1 and mine[0][1] < 1 << 20:
                assert (other[0], d[1]) < (mine[0], m[1])


def test_chat_keeps_rows_without_keys(spark):
    c = lambda *x: json.dumps({"tool_calls": list(x)})
    rows = [(None, 0, "assistant", c({"id": "a", "name": "f", "arguments": {}})), (1, None, "assistant", c({"id": "a", "name": "f", "arguments": {}})), (None, None, "tool", json.dumps({"tool_call_id": "a"})), (1, 3, "tool", json.dumps({"tool_call_id": "a"}))]
    rows += [(2, 1, "assistant", c({"id": "x", "name": "f", "arguments": {"v": "${y}"}})), (2, 3, "assistant", c({"id": "y", "name": "f", "arguments": {}})), (2, 4, "tool", json.dumps({"tool_call_id": "y"}))]
    got = {(r.conv_id, r.turn, r.role): r for r in chat.format_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == len(rows)
    assert got[None, 0, "assistant"].errors == "a: no result" and got[None, None, "tool"].errors == "a: no call"
    assert got[1, None, "assistant"].n_linked == 1 and (got[1, 3, "tool"].seq_turn, got[1, 3, "tool"].seq_level) == (None, 1)
    assert (got[2, 1, "assistant"].seq_turn, got[2, 1, "assistant"].seq_level) == (4, 1)


# --- op9 --------------------------------------------------------------------------


def test_quality(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("etaoinsrhld") for _ in range(r.randrange(2, 9)))
    good = lambda: " ".join(" ".join(word() for _ in range(11)) + "." for _ in range(8))
    bad = [lambda: " ".join(word() + "$$#" for _ in range(60)), lambda: "THE " * 80, lambda: " | ".join(word() for _ in range(60)), lambda: " ".join(word().upper() + "!!" for _ in range(70))]
    rows = [(d, bad[d % 4]() if d % 5 == 0 else good()) for d in range(250)]
    docs = frame(spark, rows + ODD)
    fitted = quality.fit(docs)
    got = quality.score(docs, fitted)
    assert got.columns == ["doc_id", "text", "n", "weak_label", "score", "predicted"] and got.count() == len(rows) + len(ODD)
    hit = {x.doc_id: x.predicted for x in got.collect()}
    assert sum(hit[d] != int(d % 5 != 0) for d, _ in rows) <= 5
    assert (fitted[0].accuracy > 0.5).all()
    assert quality.fit(docs.limit(0)) is None and quality.score(docs, None).where("score = 0.5").count() == docs.count()


def _plain_votes(text):
    """The votes of one text, counted byte by byte and word by word."""
    data = (text or "").encode()
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    n, some, many = len(words), len(words) >= 8, len(words) >= 40
    share = lambda k: k / max(n, 1)
    odd = sum(not letter(c) and not 48 <= c <= 57 and c not in b" \t\r\n\x0b\x0c.,;:!?'\"()-" for c in data)
    neat = [w for w in words if sum(map(letter, w)) >= max(len(w) - 1, 1) and not (len(w) >= 2 and not letter(w[-1]) and not letter(w[-2]))]
    symbols, capitals = odd / max(len(data), 1), sum(65 <= c <= 90 for c in data) / max(sum(map(letter, data)), 1)
    repeats, variety = share(sum(a == b for a, b in zip(words, words[1:]))), len(set(words)) / max(math.sqrt(n), 1)
    clean, size, stops = share(len(neat)), share(sum(map(len, words))), share(sum(w[-1:] in (b".", b"!", b"?") for w in words))
    good_bad = [
        (symbols < 0.002, symbols > 0.02), (capitals < 0.08, capitals > 0.3 and some), (repeats < 0.02, repeats > 0.04 and some), (variety > 5.5, variety < 4 and many),
        (clean > 0.95, clean < 0.8), (4.3 < size < 6.3, (size < 4 or size > 7) and some), (0.03 < stops < 0.25, (stops > 0.5 or stops == 0) and some),
    ]
    return tuple(-1 if bad else int(good) for good, bad in good_bad)


def test_quality_by_plain_estimation(spark):
    """Expectation maximisation document by document, posteriors over both classes, and a scorer fitted on a dense matrix."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("etaoinsrhldé") for _ in range(r.randrange(1, 9)))
    kinds = [lambda: " ".join(word() for _ in range(11)) + ".", lambda: word() + "$$#", lambda: "THE THE", lambda: word().upper() + "!!", lambda: word()]
    rows = [(d, " ".join(kinds[0 if r.random() < 0.6 else r.randrange(5)]() for _ in range(r.randrange(1, 25)))) for d in range(160)]
    rows += [rows[3]] * 40 + ODD
    docs = frame(spark, rows)
    v = [_plain_votes(t) for _, t in rows]
    post = [0.95 if not x.count(-1) else 0.4 if x.count(-1) == 1 else 0.05 for x in v]
    guess = [{-1: 6.0, 0: 0.0, 1: 1.0}, {-1: 1.0, 0: 0.0, 1: 6.0}]
    for _ in range(200):
        prior = (math.fsum(post) + 2) / (len(v) + 3)
        rates = []
        for c in (0, 1):
            own = [dict(guess[c]) for _ in range(7)]
            for x, p in zip(v, post):
                for k in range(7):
                    own[k][x[k]] += p if c else 1 - p
            rates.append([{a: 1.0 if a == 0 else o[a] / (o[-1] + o[1]) for a in o} for o in own])
        both = [[(prior if c else 1 - prior) * math.prod(rates[c][k][x[k]] for k in range(7)) for c in (0, 1)] for x in v]
        post = [good / (bad + good) for bad, good in both]

    dense = np.zeros((len(rows), quality.WIDTH + 1))
    for d, (_, t) in enumerate(rows):
        buf, offsets = next((b, o) for _, _, b, o in textkit.chunks(pa.array([t], pa.string())))
        _, f, x = quality._features(buf, offsets, quality.measures(buf, offsets))
        np.add.at(dense[d], f, x.astype(np.float32).astype(float))
    dense[:, -1] = 1
    kept = [rows.index(x) for x in dict.fromkeys(rows)]
    X, y, w, g2 = dense[kept], np.array(post)[kept], np.zeros(quality.WIDTH + 1), np.full(quality.WIDTH + 1, 1e-8)
    for _ in range(150):
        g = X.T @ (1 / (1 + np.exp(-X @ w)) - y) / len(y) + 1e-5 * w
        g2 += g * g
        w -= 0.3 * g / np.sqrt(g2)
    score = 1 / (1 + np.exp(-dense @ w))

    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    got = sorted(quality.score(docs, quality.fit(docs)).collect(), key=key)
    want = sorted(zip(rows, post, score), key=lambda x: key(x[0]))
    assert len(got) == len(want)
    for a, (row, p, s) in zip(got, want):
        assert (a.doc_id, a.text) == row and a.weak_label == pytest.approx(p, abs=1e-6)
        assert a.score == pytest.approx(s, abs=1e-4)
    few = quality.fit(docs, sample=5)
    assert few[1].shape == (quality.WIDTH + 1,) and np.isfinite(few[1]).all()


# --- op10 -------------------------------------------------------------------------


def test_personal_data(spark):
    import re

    samples = ["mail a.b@c.de or x@y, z@@q.com a@b.c_d@e.f", "ip 1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 0255.1.1.1", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 12", "call +1 (555) 123-4567 or +12 +1+2+3", "é𝄞 a@b.co 10.0.0.1", "@", "+", "1" * 5000, "x" * 5000 + "@", "4111111111111111@mail.com"]
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    for t in samples:
        want = []
        for k, p in enumerate(patterns):
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                if k == 1 and any(int(x) > 255 for x in m[0].split(".")):
                    continue
                if k == 2 and not (13 <= len(d) <= 19 and pii._luhn(d)):
                    continue
                if k == 3 and not 9 <= len(d) <= 15:
                    continue
                want.append((k, m.start(), m.end()))
        assert pii.base_spans(t) == want


def test_bootstrapping(spark):
    rows = [(i, f"Contact email: user{i}@mail.com now") for i in range(20)] + [(100, "Contact email: john_doe[at]mail.com now"), (101, "write to john_doe[at]mail.com today"), (102, "clean text of 2024 words"), *ODD]
    got = {r.doc_id: r for r in pii.find(frame(spark, rows)).collect()}
    assert len(pii.find(frame(spark, rows)).collect()) == len(rows)
    assert got[0].spans == "email:15:29" and got[0].n_email == 1 and got[0].base_sha256 == hashlib.sha256(b"email:15:29").hexdigest()
    assert got[100].n_email == 0 and got[100].spans == "email:15:35" and got[100].n_added == 1
    assert got[102].spans == "" and got[900].base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = pii.mask(frame(spark, rows))
    text = {r.doc_id: r.text for r in masked.collect()}
    assert masked.columns == ["doc_id", "text", "score", "n"] and text[0] == "Contact email: [EMAIL] now" and text[100] == "Contact email: [EMAIL] now" and text[900] is None
    assert pii.find(frame(spark, [])).count() == 0


def test_secrets_by_context(spark):
    """Key-shaped strings induce a pattern, which then finds keys of other shapes; alone they are no spans."""
    r = random.Random(2)
    key = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n - 8)) + "a1b2c3d4"
    rows = [(i, f"word{'xyz'[i % 3]} token = \"{key(40)}\" {r.choice(['and', 'so', 'it'])} on") for i in range(30)]
    rows += [(100, 'here token = "hunter_2" is'), (101, f"the sum {key(40)} of it"), (102, 'here token="zz9_zz" is'), (103, "clean v2 text")]
    clash = frame(spark, rows).withColumns({"_id": F.lit(5), "_text": F.lit("x"), "more": F.lit(2), "_more": F.lit(3)})
    plain = {r.doc_id: r.asDict() for r in pii.find(clash).collect()}
    assert plain[0]["n_secret"] == plain[0]["n_added"] == plain[0]["n_spans"] == 1 and plain[0]["spans"].startswith("secret:15:55")
    assert plain[100]["spans"] == "secret:14:22" and plain[101]["spans"] == plain[103]["spans"] == ""
    for block in (pii.BLOCK, 1):  # many blocks of patterns give the same
        assert {r.doc_id: r.asDict() for r in pii.find(clash, block=block).collect()} == plain
        masked = pii.mask(clash, block=block)
        assert masked.columns == clash.columns and masked.where("doc_id = 100").first().text == 'here token = "[SECRET]" is'


def test_bootstrapping_by_definition(spark):
    """All spans against a plain version that holds the whole graph in dictionaries."""
    r = random.Random(12)
    words = ["mail", "at", "to", "call", "id", "from", "and", "ref:", "no"]
    make = [lambda: f"u{r.randrange(30)}@x.org", lambda: f"10.0.0.{r.randrange(40)}", lambda: f"+1 555 010 {r.randrange(1000, 1040)}", lambda: f"a_{r.randrange(20)}", lambda: f"{r.randrange(99)}-{r.randrange(9)}"]
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(r.randrange(0, 8)):
            k = r.randrange(5)
            parts += [words[k] if r.random() < 0.8 else r.choice(words), make[min(k, 2) if r.random() < 0.85 else r.randrange(5)](), r.choice(words)]
        texts.append(" ".join(parts))
    edges = {}
    for t in texts:
        for m in pii.mentions(t, pii.base_spans(t)):
            for p in m["p"]:
                edges[p, m["i"]] = max(m["k"], edges.get((p, m["i"]), -2))
    known = {}
    for (p, i), k in edges.items():
        if k >= 0:
            known[i] = (k, 1.0)
    seeds = dict(known)
    for _ in range(pii.ROUNDS):
        of = {}
        for p, i in edges:
            of.setdefault(p, []).append(i)
        trusted = {}
        for p, strings in of.items():
            for kind in range(4):
                own = [known[i][1] for i in strings if i in known and known[i][0] == kind]
                if own and sum(own) / len(strings) >= pii.TRUST and sum(c >= pii.TRUST for c in own) >= pii.SUPPORT:
                    trusted[p] = (kind, sum(own) / len(strings))
        reached = {}
        for (p, i), k in edges.items():
            if k == -1 and p in trusted:
                kind, conf = trusted[p]
                at = reached.setdefault(i, {})
                at[kind] = at.get(kind, 1.0) * max(1 - conf, 1e-6)
        known = dict(seeds)
        for i, at in reached.items():
            kind = min(at, key=lambda x: (at[x], x))
            known.setdefault(i, (kind, min(1 - at[kind], 0.999999)))
    want = {}
    for d, t in enumerate(texts):
        base = pii.base_spans(t)
        spans = list(base)
        for m in pii.mentions(t, base):
            hits = [(trusted[p][1], -trusted[p][0]) for p in m["p"] if p in trusted]
            if m["k"] < 0 and hits:
                spans.append((-max(hits)[1], m["s"], m["e"]))
        want[d] = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))
    got = {r.doc_id: r for r in pii.find(frame(spark, list(enumerate(texts)))).collect()}
    assert {d: x.spans for d, x in got.items()} == want
    assert sum(x.n_added for x in got.values()) > 10


def test_identifiers_in_groups():
    found = lambda t: [t[x["s"] : x["e"]] for x in pii.mentions(t, pii.base_spans(t)) if x["k"] < 0]
    assert found("call 555 123 4567, 3 times") == ["555 123 4567", "3"]
    assert found("iban DE89 3704 0044 0532 0130 00 or GB29 NWBK 6016 1331 9268 19.") == ["DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19"]
    assert found("card 4111 1111 1111 1112 and (555) 123-4567 NOT") == ["4111 1111 1111 1112", "(555) 123-4567"]
    assert found("one a_1\nb_2 mail a@b.de c_3") == ["a_1", "b_2", "c_3"]
    long = "w" * 999
    p = [pii.mentions(f"{x}{long} a_1 {long}{x}", [])[0]["p"] for x in "ab"]
    assert all(x != y for x, y in zip(*p))


def test_bootstrapping_in_two_steps(spark):
    """Strings found in round one carry a context without any seed, which marks a new one."""
    rows = [(i, f"Reach me under +1 555 010 {1000 + i} daily") for i in range(60)]
    rows += [(100 + i, f"Reach me under 555 123 {4000 + i} daily") for i in range(8)]
    rows += [(200 + i, f"dial quickly 555 123 {4000 + i} tonight") for i in range(8)]
    rows += [(300, "dial quickly 777 888 9999 tonight"), (301, "in the 1990 season")]
    got = {r.doc_id: r for r in pii.find(frame(spark, rows)).collect()}
    assert got[100].spans == "phone:15:27" and got[200].spans == "phone:13:25"
    assert got[300].spans == "phone:13:25" and got[301].spans == ""
    assert {r.doc_id: r.text for r in pii.mask(frame(spark, rows)).collect()}[300] == "dial quickly [PHONE] tonight"
