"""Removal of repeated word windows by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words.  Its minimiser is the smallest hash of
the ``MINIMISER``-word runs in it; consecutive windows that share one form a
super-k-mer, which travels as one packed string to the minimiser's bucket.  Equal
windows have equal minimisers and so meet in one bucket, where sorting finds the
smallest document of each window.  Super-k-mers of one batch for one partition,
which is a group of buckets, are packed and compressed together; a batch sends each
distinct super-k-mer only for its smallest document and settles the others itself, so
a passage that very many documents repeat takes a row a batch.  The number of
partitions follows the bytes of text, which are counted first, even where
``spark.sql.shuffle.partitions`` is smaller.  Minimisers take turns, so that only a
share of the packs lies on disk at a time.  A bucket beyond what a task holds, because very
many contexts share its minimiser, gives out its windows one by one, and these meet
by their own hashes in a second shuffle, where each is settled as it streams by.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.lineage import cut, release
from tidegraph.llm.textkit import Words, chunks, mix, tidy

WINDOW, MINIMISER = 13, 3
#: Buckets of a partition; bytes of super-k-mers of a bucket that a task holds, four times the usual.
BUCKETS, BUCKET_TEXT = 16, 16 << 20
#: Turns that the minimisers take, and the bytes of text from which they do.
TURNS, TURN_BYTES = 2, 64 << 20
#: Bytes that a super-k-mer takes in a pack besides its text, and bytes of packs that are given out at once.
NUMBERS, ROW_BYTES = 20, 4 << 20
#: Bytes of text that are packed together, and the level of compression.
BATCH_BYTES, LEVEL = 24 << 20, 5
_U64 = np.uint64
_LANES = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, (2, 256), dtype=np.uint64) * _U64(2) + _U64(1)


def window_hashes(w: Words, h: np.ndarray, k: int, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words within one document, and its first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s = h[:n] * _LANES[lane, 0]
    for j in range(1, k):
        s += h[j : j + n] * _LANES[lane, j]
    after = np.repeat(w.first[1:], w.counts)[:n]
    keep = np.flatnonzero(after - np.arange(n) >= k)
    return mix(s[keep]), keep


def super_kmers(w: Words, h: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each super-k-mer; at most k windows each."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    runs = h[: len(h) - m + 1] * _LANES[1, 0]
    for j in range(1, m):
        runs += h[j : j + len(runs)] * _LANES[1, j]
    runs = mix(runs)
    low = runs[:n].copy()
    for j in range(1, k - m + 1):
        np.minimum(low, runs[j : j + n], out=low)
    after = np.repeat(w.first[1:], w.counts)[:n]
    at = np.flatnonzero(after - np.arange(n) >= k)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    value = low[at]
    new = np.r_[True, (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)]
    begin = np.flatnonzero(new)
    size = np.diff(np.r_[begin, len(at)])
    pieces = -(-size // k)  # a repeated text can hold one minimiser for long
    first = np.repeat(begin, pieces)
    step = np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = first + step * k
    size = np.minimum(np.repeat(size, pieces) - step * k, k)
    return at[first], size, value[first]


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, all first bytes first, so that their empty high bytes vanish when compressed."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _from_planes(raw: bytes, kind: type, n: int, offset: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, offset).reshape(width, n).T).reshape(-1).view(kind)


def _compact(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one blank after each, and their spans."""
    size = w.end - w.start
    start = np.cumsum(size + 1) - size - 1
    out = np.full(int((size + 1).sum()), 0x20, np.uint8)
    pos = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[pos + np.repeat(start, size)] = w.buf[pos + np.repeat(w.start, size)]
    return out, start, start + size


def _intervals(doc: np.ndarray, tag: np.ndarray, at: np.ndarray, n: np.ndarray, k: int) -> pa.RecordBatch:
    """Word spans covered by runs of windows, those that touch made one."""
    order = np.lexsort((at, tag, doc))
    doc, tag, at, end = doc[order], tag[order], at[order], (at + n + k - 1)[order]
    if len(doc):
        fresh = np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]
        group = np.cumsum(fresh)
        reach = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40)
        new = np.r_[True, fresh[1:] | (at[1:] > reach[:-1])]
        begin = np.flatnonzero(new)
        last = np.r_[begin[1:] - 1, len(doc) - 1]
        doc, tag, at, end = doc[begin], tag[begin], at[begin], reach[last]
    return pa.RecordBatch.from_pydict({"doc": doc, "tag": tag, "s": at, "e": end})


def repeated_spans(docs: DataFrame, *, window: int = WINDOW, minimiser: int = MINIMISER, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Spans of words (doc, tag, s, e) covered by windows that a document of a smaller id holds too; rows of ``docs`` are (doc, tag, text)."""
    import zstandard

    spark = docs.sparkSession
    k = window
    docs = docs.where("doc is not null and text is not null").select("doc", "tag", "text")
    text_bytes = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    turns = TURNS if text_bytes >= TURN_BYTES else 1
    # a super-k-mer has (k - m + 2) / 2 windows on average and repeats k - 1 words of its neighbour; its numbers count as three words more
    raw = text_bytes * (1 + 2 * (k + 2) / (k - minimiser + 2)) / turns
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(raw / (BUCKETS * BUCKET_TEXT / 4)))
    empty = np.zeros(0, np.int64)

    def pack(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if not held:
                return
            doc, tag, at, n, own, head, tail, start, end = (np.concatenate([x[c] for x in held]) for c in range(9))
            shift = np.cumsum([0, *(len(x[9]) for x in held)])[:-1]
            of = np.repeat(np.arange(len(held)), [len(x[0]) for x in held])
            start, end = start + shift[of], end + shift[of]
            text = np.concatenate([x[9] for x in held])
            held.clear()
            size = 0
            order = np.lexsort((doc, n, tail, head))
            same = np.r_[False, (head[order][1:] == head[order][:-1]) & (tail[order][1:] == tail[order][:-1]) & (n[order][1:] == n[order][:-1])]
            first = np.flatnonzero(~same)
            least = doc[order][first][np.cumsum(~same) - 1]
            late = np.zeros(len(doc), bool)
            late[order] = doc[order] > least
            settled = _intervals(doc[late], tag[late], at[late], n[late], k)
            if settled.num_rows:
                to = (mix(settled.column(0).to_numpy().view(np.uint64)) % _U64(partitions)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(to), *settled.columns, pa.nulls(settled.num_rows, pa.binary())], names=["part", "doc", "tag", "s", "e", "pack"])
            send = np.flatnonzero(~late)
            send = send[np.argsort(own[send], kind="stable")]
            to, bucket = np.divmod(own[send], BUCKETS)
            edges = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else empty
            rows, taken = [], 0
            for i, j in zip(edges, np.r_[edges[1:], len(to)]):
                x = send[i:j]
                length = end[x] - start[x]
                pos = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
                body = text[pos + np.repeat(start[x], length)]
                counts = np.bincount(bucket[i:j], minlength=BUCKETS).astype(np.int32)
                blob = squeeze.compress(b"".join([counts.tobytes(), _planes(doc[x]), *(_planes(c.astype(np.int32)) for c in (tag[x], at[x], length)), body.tobytes()]))
                rows.append((int(to[i]), blob))
                taken += len(blob)
                if taken >= ROW_BYTES:
                    yield packed(rows)
                    rows, taken = [], 0
            if rows:
                yield packed(rows)

        def packed(rows: list) -> pa.RecordBatch:
            none = pa.nulls(len(rows), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), none, none, none, none, pa.array([r[1] for r in rows], pa.binary())], names=["part", "doc", "tag", "s", "e", "pack"])

        for b in batches:
            ids, tags = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, j, buf, offsets in chunks(b.column(2)):
                w = Words(buf, offsets)
                h = w.hashes()
                first, n, low = super_kmers(w, h, k, minimiser)
                low = mix(low)
                now = low % _U64(turns) == turn
                first, n, own = first[now], n[now], (low[now] // _U64(turns) % _U64(partitions * BUCKETS)).astype(np.int64)
                if not len(first):
                    continue
                all_hashes, at = window_hashes(w, h, k, 0)
                head = all_hashes[np.searchsorted(at, first)]
                tail = all_hashes[np.searchsorted(at, first + n - 1)]
                text, start, end = _compact(w)
                d = np.searchsorted(w.first, first, "right") - 1
                held.append((ids[i:j][d], tags[i:j][d], first - w.first[d], n, own, head, tail, start[first], end[first + n + k - 2], text))
                size += len(text)
                if size >= batch_bytes:
                    yield from flush()
        yield from flush()

    names = ["doc", "tag", "s", "e", "one", "two"]

    def unpacked(raw: bytes) -> Iterator[tuple[int, tuple[np.ndarray, ...], int]]:
        """Bucket, super-k-mers (document, tag, first word, length, text) and their bytes, of each bucket that a pack has some of; copies, so that none holds the others."""
        counts = np.frombuffer(raw, np.int32, BUCKETS)
        n, at = int(counts.sum()), 4 * BUCKETS
        columns = [_from_planes(raw, np.int64, n, at), *(_from_planes(raw, np.int32, n, at + 8 * n + 4 * n * c) for c in range(3))]
        text = np.frombuffer(raw, np.uint8, offset=at + NUMBERS * n)
        edges = np.r_[0, np.cumsum(counts)]
        places = np.r_[0, np.cumsum(columns[3], dtype=np.int64)][edges]
        for c in np.flatnonzero(counts):
            i, j, a, b = *edges[c : c + 2], *places[c : c + 2]
            yield int(c), (*(x[i:j].copy() for x in columns), text[a:b].copy()), int(b - a + NUMBERS * (j - i))

    def windows(parts: list[tuple]) -> tuple[np.ndarray, ...]:
        """Two hashes, document, tag and first word of each window of unpacked super-k-mers."""
        doc, tag, at, length, text = (np.concatenate([p[c] for p in parts]) for c in range(5))
        tag, at = tag.astype(np.int64), at.astype(np.int64)
        w = Words(text, np.r_[0, np.cumsum(length, dtype=np.int64)])
        h = w.hashes()
        one, place = window_hashes(w, h, k, 0)
        two, _ = window_hashes(w, h, k, 1)
        of = np.searchsorted(w.first, place, "right") - 1
        return one, two, doc[of], tag[of], at[of] + place - w.first[of]

    def spans(doc: np.ndarray, tag: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        out = _intervals(doc, tag, at, np.ones(len(doc), np.int64), k)
        none = pa.nulls(out.num_rows, pa.int64())
        return pa.RecordBatch.from_arrays([*out.columns, none, none], names=names)

    def solve(parts: list[tuple]) -> pa.RecordBatch:
        one, two, owner, tag, at = windows(parts)
        order = np.lexsort((owner, two, one))
        same = np.r_[False, (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])]
        least = owner[order][np.flatnonzero(~same)][np.cumsum(~same) - 1]
        late = np.zeros(len(owner), bool)
        late[order] = owner[order] > least
        x = np.flatnonzero(late)
        return spans(owner[x], tag[x], at[x])

    def loose(parts: list[tuple]) -> pa.RecordBatch:
        one, two, owner, tag, at = windows(parts)
        return pa.RecordBatch.from_arrays([pa.array(owner), pa.array(tag), pa.array(at), pa.nulls(len(at), pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        held, size, whole = [[] for _ in range(BUCKETS)], [0] * BUCKETS, [True] * BUCKETS

        for b in batches:
            settled = b.filter(b.column(1).is_valid())
            if settled.num_rows:
                none = pa.nulls(settled.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*settled.columns[1:5], none, none], names=names)
            for blob in b.column(5).drop_null():
                for c, part, many in unpacked(expand.decompress(blob.as_py())):
                    held[c].append(part)
                    size[c] += many
                    if size[c] > BUCKET_TEXT:
                        yield loose(held[c])
                        held[c], size[c], whole[c] = [], 0, False
        for c in range(BUCKETS):
            if held[c]:
                yield solve(held[c]) if whole[c] else loose(held[c])
                held[c] = []

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows sorted by hashes and document: those behind the first document of theirs."""
        last = None  # hashes and least document of the window that the batch before ended with
        for b in batches:
            doc, tag, at, one, two = (b.column(c).to_numpy() for c in range(5))
            if not len(doc):
                continue
            new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
            least = doc[np.flatnonzero(new)]
            if last is not None and last[:2] == (one[0], two[0]):
                least[0] = last[2]
            least = least[np.cumsum(new) - 1]
            last = (one[-1], two[-1], least[-1])
            late = doc > least
            if late.any():
                yield _intervals(doc[late], tag[late], at[late], np.ones(int(late.sum()), np.int64), k)

    def take(turn: int) -> DataFrame:
        """The spans of the minimisers of a turn."""
        rows = docs.mapInArrow(tidy(lambda batches: pack(batches, turn)), "part int, doc long, tag long, s long, e long, pack binary")
        met = cut(rows.repartitionById(partitions, "part").mapInArrow(tidy(meet), "doc long, tag long, s long, e long, one long, two long"))
        found = met.where("one is null").select("doc", "tag", "s", "e")
        left = met.where("one is not null").select("doc", "tag", "s", "one", "two")
        if left.isEmpty():
            return found
        late = left.repartition("one", "two").sortWithinPartitions("one", "two", "doc").mapInArrow(tidy(settle), "doc long, tag long, s long, e long")
        return found.unionByName(late)

    spans_of_turns = []
    for turn in range(turns):
        spans_of_turns.append(take(turn))
        release(spark)  # the packed super-k-mers
    return functools.reduce(DataFrame.unionByName, spans_of_turns)


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, minimiser: int = MINIMISER, with_text: bool = False, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Remove each word covered by a window that starts in a document of a smaller id too.

    Result: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by
    one blank), and kept_text if ``with_text``.  A null text has no words.  Rows
    that repeat an id, told apart by 31 bits of their text's hash, do not remove words from each other; a row with a null id
    loses none and removes none.  Other columns are ignored.
    """
    if window < minimiser or minimiser < 1 or window > 256:
        raise ValueError("needs 1 <= minimiser <= window <= 256")
    part = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).withColumn("tag", F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)))
    spans = repeated_spans(part, window=window, minimiser=minimiser, batch_bytes=batch_bytes)
    # twice the same span can come from two batches
    lists = spans.groupBy("doc", "tag").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans"))
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            spans_of = b.column(2)
            for k, t in enumerate(b.column(1)):
                words = (t.as_py() or "").encode().split()
                kept, at = [], 0
                for s in spans_of[k].as_py() or ():
                    kept += words[at : max(at, s["s"])]
                    at = max(at, s["e"])
                kept += words[at:]
                joined = b" ".join(kept)
                for c, v in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode())):
                    c.append(v)
            cols = [b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())]
            n = 5 if with_text else 4
            yield pa.RecordBatch.from_arrays(cols[:n], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][:n])

    return part.join(lists, ["doc", "tag"], "left").select("doc", "text", "spans").mapInArrow(tidy(run), ddl)
