"""Personal data by fixed patterns and bootstrapped contextual extraction.

Fixed patterns give the base spans (e-mail and IP addresses, card and phone
numbers).  Their strings are seeds, and so are strings of a key's shape (long, of
letters and digits mixed), which are no spans by themselves.  A lexical pattern is
the word before or after an identifier with the signs between, or both, where an
identifier is a base span or a run of identifier-like words across blanks; the
graph of patterns and strings over the whole corpus is scored in rounds: a pattern
by the mean confidence of its distinct strings, a string by the patterns that hold
it.  Patterns that reach ``TRUST`` with ``SUPPORT`` distinct strings of that
confidence, seeds in round one and found strings too from round two on, then mark
further identifiers in their contexts.  Base spans always stay.

The graph takes one pass over the texts and the marking another; no text is
shuffled or written in between.  The trusted patterns are sent to the tasks in
blocks of at most ``BLOCK``; more blocks take more passes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegraph.llm.lineage import cut, free_name
from tidegraph.llm.textkit import tidy

#: Kinds of base spans, and of all spans.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
ROUNDS, TRUST, SUPPORT = 3, 0.8, 5
#: Confidence of a string of a key's shape.
SHAPE = 0.9
#: Trusted patterns that are sent to the tasks at once (17 bytes each).
BLOCK = 1_000_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'()[]{}<>|*#$%&="
_TELLING = re.compile(r"[0-9@_]|\w\.\w")
_BLANKS = re.compile(r"[\x20\t\xa0]+")
_GROUP = re.compile(r"[A-Z]{2,4}")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_ALNUM = re.compile(r"\w")
_ASSIGNED = re.compile(r"[\w.-]+=[\"']?(?=[^=])")
_KEY = re.compile(r"(?=(?:[^0-9]*[0-9]){4})(?=(?:[^A-Za-z]*[A-Za-z]){4})[A-Za-z0-9+/_-]{24,256}")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    out: list[tuple[int, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        i = at
        while i > done and text[i - 1] in _LOCAL:
            i -= 1
        m = _DOMAIN.match(text, at + 1) if i < at else None
        if m:
            out.append((0, i, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
                out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = _NOT_DIGIT.sub("", m[0])
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    out.append((2, m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _key(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(parts).encode(), digest_size=8).digest(), "little", signed=True)


def _runs(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of identifier-like words on a line outside the taken spans; a short word in capitals may stand between two."""
    start = end = last = t = 0  # the run so far and where its last word ends with what follows it
    linked = False  # whether a next word may go on
    for m in _WORD.finditer(text):
        word = m[0]
        core = word.strip(_EDGE)
        s = m.start() + word.find(core)
        e = s + len(core)
        named = _ASSIGNED.match(text, s, e)  # key="value" holds the value
        if named and named.end() < e:
            s, core = named.end(), text[named.end() : e]
        while t < len(taken) and taken[t][1] <= m.start():
            t += 1
        free = not (t < len(taken) and taken[t][0] < m.end())
        goes_on = linked and _BLANKS.fullmatch(text, last, m.start()) and text[m.start() : s] in ("", "(")
        telling = free and core and _TELLING.search(core)
        if telling:
            if not goes_on:
                if end > start:
                    yield start, end
                start = s - (text[m.start() : s][-1:] == "(" and ")" in text[s : m.end()])
            end = e
            linked = text[e : m.end()] in ("", ")")
        elif not (goes_on and free and _GROUP.fullmatch(word)):
            linked = False
        last = m.end()
    if end > start:
        yield start, end


def _nearest(words: list[str]) -> str:
    """The first word with a letter or digit, and the signs before it."""
    out = []
    for w in words:
        out.append(w)
        if _ALNUM.search(w):
            break
    else:
        out.append("\x02")
    return " ".join(out).lower()


def _neighbours(text: str, s: int, e: int) -> tuple[str, str]:
    """The whole words before and after a span, in small letters, with the signs between."""
    size = 200
    while True:
        at = max(0, s - size)
        before = text[at:s].split()
        if at == 0 or any(map(_ALNUM.search, before[1:])) or (before and text[at].isspace() and _ALNUM.search(before[0])):
            break
        size *= 4
    size = 200
    while True:
        after = text[e : e + size].split()
        if e + size >= len(text) or any(map(_ALNUM.search, after[:-1])) or (after and text[e + size - 1].isspace() and _ALNUM.search(after[-1])):
            break
        size *= 4
    return _nearest(before[::-1]), _nearest(after)


def mentions(text: str, base: list[tuple[int, int, int]], others: bool = False) -> list[dict]:
    """Base spans, unless only the others are wanted, and other runs of identifier-like words with their contexts; kind -1 for those, -2 if of a key's shape."""
    if not base and not _TELLING.search(text):
        return []
    spans = [] if others else [(s, e, k) for k, s, e in base]
    spans += [(s, e, -2 if _KEY.fullmatch(text, s, e) else -1) for s, e in _runs(text, sorted((s, e) for _, s, e in base))]
    out = []
    for s, e, k in spans:
        left, right = _neighbours(text, s, e)
        out.append({"s": s, "e": e, "k": k, "i": _key("i", text[s:e]), "p": [_key("l", left), _key("r", right), _key("b", left, right)]})
    return out


def graph(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Edges (p, i, k) of patterns and strings over all documents, each once; k is the string's kind.

    A task sends each edge once a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edges: dict[tuple[int, int], int] = {}
            for t in b.column(0):
                text = t.as_py()
                for m in mentions(text, base_spans(text)):
                    for p in m["p"]:
                        at = (p, m["i"])
                        edges[at] = max(m["k"], edges.get(at, -2))
            if edges:
                p, i = zip(*edges)
                yield pa.RecordBatch.from_pydict({"p": pa.array(p, pa.int64()), "i": pa.array(i, pa.int64()), "k": pa.array(edges.values(), pa.int32())})

    part = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    return part.mapInArrow(tidy(run), "p long, i long, k int").groupBy("p", "i").agg(F.max("k").alias("k"))


def learn(edges: DataFrame, *, rounds: int = ROUNDS, trust: float = TRUST, support: int = SUPPORT) -> DataFrame:
    """Trusted patterns (p, kind, conf), from the graph of patterns and strings of all documents.

    A pattern or string that many documents repeat is one row of each edge.
    """
    edges = cut(edges)
    kind, conf = F.when(F.col("k") >= 0, F.col("k")).otherwise(KINDS.index("secret")), F.when(F.col("k") >= 0, F.lit(1.0)).otherwise(SHAPE)
    seeds = edges.where("k <> -1").groupBy("i").agg(F.max("k").alias("k")).select("i", kind.alias("kind"), conf.alias("conf"))
    known = seeds
    trusted = None
    for _ in range(rounds):
        scored = edges.select("p", "i").join(known, "i", "left").groupBy("p", "kind").agg(F.sum("conf").alias("hit"), F.count_if(F.col("conf") >= trust).alias("sure"), F.count("*").alias("n"))
        total = scored.groupBy("p").agg(F.sum("n").alias("n"))
        trusted = cut(scored.where("kind is not null").drop("n").join(total, "p").select("p", "kind", (F.col("hit") / F.col("n")).alias("conf"), "sure").where((F.col("conf") >= trust) & (F.col("sure") >= support)).drop("sure"))
        reached = edges.where("k = -1").join(trusted, "p").groupBy("i", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-6)))))).alias("c"))
        best = reached.groupBy("i").agg(F.max_by("kind", F.struct("c", -F.col("kind"))).alias("kind"), F.least(F.max("c"), F.lit(0.999999)).alias("conf"))
        known = seeds.unionByName(best.join(seeds.select("i"), "i", "left_anti"))
    return trusted.groupBy("p").agg(F.max_by("kind", F.struct("conf", -F.col("kind"))).alias("kind"), F.max("conf").alias("conf"))


class Patterns:
    """A block of trusted patterns, sorted."""

    def __init__(self, p: np.ndarray, kind: np.ndarray, conf: np.ndarray):
        order = np.argsort(p)
        self.p, self.kind, self.conf = p[order], kind[order].astype(np.int8), conf[order]

    def best(self, keys: list[int]) -> tuple[float, int] | None:
        """Confidence and kind of the most trusted of some patterns, ties to the first kind."""
        found = None
        for key in keys:
            at = int(np.searchsorted(self.p, key))
            if at < len(self.p) and self.p[at] == key:
                this = (float(self.conf[at]), -int(self.kind[at]))
                found = this if found is None else max(found, this)
        return found and (found[0], -found[1])


Span = tuple[int, int, int]
Finish = Callable[[pa.RecordBatch, list[str | None], list[list[Span]], list[list[Span]]], pa.RecordBatch]


def _marked(docs: DataFrame, text_col: str, trusted: DataFrame, block: int, schema: StructType, finish: Finish) -> DataFrame:
    """``finish`` of each batch of ``docs`` with the texts, the base spans and the spans (kind, start, end) that trusted patterns add."""
    n = max(1, -(-trusted.count() // block))
    spark, at, more = docs.sparkSession, docs.columns.index(text_col), free_name(docs, "more")
    kept = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("conf", pa.float64()), ("kind", pa.int32())]))
    for part in range(n):
        rows = trusted.where(F.pmod(F.xxhash64("p"), F.lit(n)) == part).toArrow()
        held = spark.sparkContext.broadcast(Patterns(*(rows[c].to_numpy() for c in ("p", "kind", "conf"))))

        def run(batches: Iterator[pa.RecordBatch], held=held, first=part == 0, last=part == n - 1) -> Iterator[pa.RecordBatch]:
            patterns = held.value
            for b in batches:
                before = None if first else b.column(b.num_columns - 1)
                if not first:
                    b = b.select(list(range(b.num_columns - 1)))
                texts, base, added = [], [], []
                for k, t in enumerate(b.column(at)):
                    text = t.as_py()
                    own = base_spans(text) if text else []
                    found = {} if first else {(x["s"], x["e"]): (x["conf"], x["kind"]) for x in before[k].as_py()}
                    for m in mentions(text, own, others=True) if text else ():
                        got = patterns.best(m["p"])
                        if got is not None:
                            place = (m["s"], m["e"])
                            found[place] = max(got, found.get(place, got), key=lambda x: (x[0], -x[1]))
                    texts.append(text)
                    base.append(own)
                    added.append(found)
                if last:
                    yield finish(b, texts, base, [[(k, s, e) for (s, e), (_, k) in sorted(x.items())] for x in added])
                else:
                    column = pa.array([[{"s": s, "e": e, "conf": c, "kind": k} for (s, e), (c, k) in x.items()] for x in added], kept)
                    yield pa.RecordBatch.from_arrays([*b.columns, column], names=[*b.schema.names, more])

        out = schema if part == n - 1 else docs.select(*docs.columns[: len(docs.columns) - (part > 0)], F.expr("array(named_struct('s', 0, 'e', 0, 'conf', 0d, 'kind', 0))").alias(more)).schema
        docs = docs.mapInArrow(tidy(run), out)
    return docs


def _joined(spans: list[Span]) -> str:
    """kind:start:end of spans, by kind, then start."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, **options) -> DataFrame:
    """Spans of personal data of every row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_secret, n_spans.

    n_added counts the spans that patterns add (of any kind), n_spans all.  A null
    text counts as empty; rows with the same id stay apart; an empty table gives an
    empty result.  Other columns are ignored.
    """
    part = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    numbers = [f"n_{k}" for k in BASE]
    counts = ", ".join(f"{n} long" for n in numbers)
    fields = ["doc_id", *numbers, "base_sha256", "spans", "n_added", "n_secret", "n_spans"]

    def finish(b: pa.RecordBatch, texts: list, base: list[list[Span]], added: list[list[Span]]) -> pa.RecordBatch:
        columns = [b.column(0), *(pa.array([sum(x[0] == k for x in own) for own in base], pa.int64()) for k in range(len(BASE)))]
        columns.append(pa.array([hashlib.sha256(_joined(own).encode()).hexdigest() for own in base], pa.string()))
        columns.append(pa.array([_joined([*own, *more]) for own, more in zip(base, added)], pa.string()))
        columns.append(pa.array(map(len, added), pa.int64()))
        columns.append(pa.array([sum(KINDS[x[0]] == "secret" for x in more) for more in added], pa.int64()))
        columns.append(pa.array([len(own) + len(more) for own, more in zip(base, added)], pa.int64()))
        return pa.RecordBatch.from_arrays(columns, names=fields)

    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(f"doc_id long, {counts}, base_sha256 string, spans string, n_added long, n_secret long, n_spans long")
    return _marked(part, "text", learn(graph(part), **options), block, schema, finish)


def _masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of spans that overlap, as the kind of its first."""
    merged: list[list[int]] = []
    for s, e, k in sorted((s, -e, k) for k, s, e in spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], -e)
        else:
            merged.append([s, -e, k])
    out, at = [], 0
    for s, e, k in merged:
        out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, *, text_col: str = "text", block: int = BLOCK, **options) -> DataFrame:
    """The rows of ``docs``, columns of any name kept, with every span replaced by its kind in brackets; a null text stays null."""
    at = docs.columns.index(text_col)

    def finish(b: pa.RecordBatch, texts: list, base: list[list[Span]], added: list[list[Span]]) -> pa.RecordBatch:
        out = [_masked(t, [*own, *more]) if own or more else t for t, own, more in zip(texts, base, added)]
        columns = [*b.columns]
        columns[at] = pa.array(out, pa.string())
        return pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return _marked(docs, text_col, learn(graph(docs, text_col=text_col), **options), block, docs.schema, finish)
