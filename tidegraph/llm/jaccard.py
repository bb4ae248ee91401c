"""Exact joins of documents on the Jaccard similarity of their word n-grams.

1. Documents with the same set of shingles are one class.
2. Classes that may link are brought together by an exact covering: the shingle
   space is cut into parts by hash, more parts than two linked sets can differ in,
   so that linked sets agree on some parts.  Classes that share a part's
   content are candidates, unless one of them shares fewer parts with all others
   than linked sets must, and the components of candidates are the first regions;
   classes in different regions cannot link.  (Unrelated texts are all at distance
   1 from any pivot, so pivots alone would put every document into every window.)
   A region that is too large for a task, because its texts share common lines, is
   covered anew by its rarest shingles, counted over the region.
3. A region is a metric space.  Pivots cut it into Voronoi cells: a class belongs to
   its nearest pivot's cell if that is within a radius, else to the outer cell.  A
   cell's window holds the classes of later cells that may link into it: by the
   triangle inequality those within the radius and the threshold of its pivot, and
   at most twice the threshold farther from it than from their own.  Cells with
   their windows join recursively, and two classes are compared in the cell of the
   first of them only.  What pivots divide no further is compared by counting
   common shingles for all of it at once.

Every link between different sets is found and counted; of the links only as many
are given out as connect the classes, since a group of near copies has a link for
each two of them.  Sides of joins that grow with the documents are not broadcast,
since the driver builds what is broadcast and many are built at once.  Regions beyond ``REGION`` shingles are cut into cells by Spark
and, where a cell stays large, into blocks that meet in pairs; no task holds more
than two blocks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.components import components
from tidegraph.llm.lineage import bytes_of, cut, free_name, release
from tidegraph.llm.skew import join_spread
from tidegraph.llm.textkit import Words, chunks, combine, mix, tidy

_U64 = np.uint64
#: Shingles of a region that one task joins at most, and pivots of a larger one.
REGION, PIVOTS = 6_000_000, 8
#: Radius of a pivot's cell.
RADIUS = 0.5
#: Sets of a cell that is joined without further pivots, pivots of a task's cell, and how deep cells nest.
LEAF, TASK_PIVOTS, DEPTH = 8, 4, 12
#: Sets from which on a cell that pivots do not divide is cut by its rarest shingles first.
WIDE = 512
#: Buckets of keys that a shuffle partition works through one by one, at least; bytes of input for a bucket; keys of a bucket that a task holds.
BUCKETS_EACH, BUCKET_BYTES, BUCKET_KEYS = 4, 8 << 20, 2_000_000
GROWTH = 1.3


class Rule:
    """Shingle length and least similarity as a fraction, with the covering's sizes."""

    def __init__(self, words: int = 5, over: int = 80, under: int = 100):
        if words < 1 or not 0 < over <= under:
            raise ValueError("needs a shingle of a word or more and a similarity in (0, 1]")
        self.words, self.over, self.under = words, over, under
        self.low = [1]
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * GROWTH)))

    def linked(self, common, a, b):
        """Whether sets of these sizes with so many common shingles link; numbers or arrays."""
        return self.under * common >= self.over * (a + b - common)

    def differ(self, a: int, b: int) -> int:
        """The most shingles by which linked sets of these sizes can differ."""
        return (self.under - self.over) * (a + b) // (self.under + self.over)

    def size_class(self, n: int) -> int:
        return int(np.searchsorted(self.low, n, "right")) - 1

    def keys(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Covering keys of a sorted set, its parts that are not empty, for each size class of a partner that is no smaller.

        With each key goes the size class and how many of that class's keys a linked
        partner must share: the set's parts less the most that can differ.
        """
        n = len(shingles)
        most = n * self.under // self.over
        out: list[np.ndarray] = [np.zeros(0, np.uint64)]
        need: list[np.ndarray] = [np.zeros(0, np.int32)]
        scrambled = mix(shingles ^ _U64(0x5BD1E995))
        for c in range(self.size_class(n), self.size_class(most) + 1):
            top = self.low[c + 1] - 1
            differ = self.differ(n, min(top, most))
            widest = self.differ(top, top) + 1
            if widest == 1:
                continue  # only equal sets link, and those are one class
            parts = -(-widest * 5 // 4) + 1
            part = ((shingles >> _U64(32)) * _U64(parts)) >> _U64(32)
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            keys = mix(np.add.reduceat(scrambled, first) + mix(part[first] + _U64(c << 44)))
            least = max(0, len(first) - differ)
            if not least:  # so few parts that all may differ: such sets also meet by class
                keys = np.r_[keys, mix(np.array([0xABCDEF + c], np.uint64))]
            out.append(keys)
            need.append(np.full(len(keys), c << 16 | min(least, 65535), np.int32))
        return np.concatenate(out), np.concatenate(need)


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z in lower case; a text of fewer words is one shingle, an empty one none."""
    for _, _, buf, offsets in chunks(column):
        w = Words(buf, offsets, lower=True)
        h = w.hashes()
        s, at = w.windows(h, words)
        cut_at = np.searchsorted(at, w.first)
        for d in range(len(offsets) - 1):
            n = int(w.first[d + 1] - w.first[d])
            if n >= words:
                yield np.unique(s[cut_at[d] : cut_at[d + 1]])
            elif n:
                yield np.array([combine(h[w.first[d] : w.first[d + 1]])], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def class_of(shingles: np.ndarray) -> int:
    """Hash of a whole set."""
    x = mix(shingles + _U64(0x9E3779B97F4A7C15))
    h = mix(np.array([x.sum() + _U64(len(x))], np.uint64)) ^ mix(np.array([np.bitwise_xor.reduce(mix(x))], np.uint64))
    return int(h.view(np.int64)[0])


def _sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc, tag (hash of the text), n and node (its class; null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, node = [], []
            for s in shingle_sets(b.column(2), rule.words):
                n.append(len(s))
                node.append(class_of(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64())], names=["doc", "tag", "n", "node"])

    return docs.select("doc", "tag", "text").mapInArrow(tidy(run), "doc long, tag long, n long, node long")


def _shared_keys(docs: DataFrame, rule: Rule) -> DataFrame:
    """(key, node, need) of the covering keys that several classes have; rows may repeat.

    A task settles the keys that it sees more than once itself and sends each key
    once a batch; the keys of a batch for one bucket travel packed together.
    """
    import zstandard

    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions * BUCKETS_EACH, (bytes_of(docs) or 0) // BUCKET_BYTES)
    names = ["bucket", "key", "node", "need", "pack"]

    def grouped(key: np.ndarray, node: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, ...]:
        """Rows in order, each (key, node) once, where a key begins, and which keys have several nodes."""
        order = np.lexsort((node, key))
        key, node, need = key[order], node[order], need[order]
        one = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        key, node, need = key[one], node[one], need[one]
        new = np.r_[True, key[1:] != key[:-1]]
        size = np.diff(np.r_[np.flatnonzero(new), len(key)])
        return key, node, need, new, np.repeat(size > 1, size)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        held: list[tuple[np.ndarray, np.ndarray, int]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if not size:
                return
            key, need = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            node = np.repeat(np.array([h[2] for h in held]), [len(h[0]) for h in held])
            held.clear()
            size = 0
            key, node, need, new, several = grouped(key, node, need)
            n = int(several.sum())
            if n:
                bucket = (mix(node[several].view(np.uint64)) % _U64(buckets)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(key[several].view(np.int64)), pa.array(node[several]), pa.array(need[several]), pa.nulls(n, pa.binary())], names=names)
            key, node, need = key[new], node[new], need[new]
            bucket = ((key >> _U64(32)) * _U64(buckets) >> _U64(32)).astype(np.int32)
            edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            packs = []
            for i, j in zip(edges, np.r_[edges[1:], len(bucket)]):
                # steps between sorted keys, byte by byte, so that their empty high bytes vanish
                steps = np.diff(key[i:j], prepend=_U64(0)).view(np.uint8).reshape(-1, 8).T
                packs.append(squeeze.compress(np.ascontiguousarray(steps).tobytes() + node[i:j].tobytes() + need[i:j].tobytes()))
            none = pa.nulls(len(packs), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edges]), none, none, pa.nulls(len(packs), pa.int32()), pa.array(packs, pa.binary())], names=names)

        for b in batches:
            for s in shingle_sets(b.column(0), rule.words):
                if len(s):
                    k, need = rule.keys(s)
                    held.append((k, need, class_of(s)))
                    size += len(k)
                    if size > 2_000_000:
                        yield from flush()
        yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()

        def unpacked(pack: bytes) -> tuple[np.ndarray, ...]:
            raw = expand.decompress(pack)
            n = len(raw) // 20
            steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T).reshape(-1).view(np.uint64)
            return np.cumsum(steps, dtype=np.uint64), np.frombuffer(raw, np.int64, n, 8 * n), np.frombuffer(raw, np.int32, n, 16 * n)

        def solve(parts: list[tuple[np.ndarray, ...]], whole: bool) -> pa.RecordBatch:
            key, node, need, _, several = grouped(*(np.concatenate([p[c] for p in parts]) for c in range(3)))
            some = several if whole else np.ones(len(key), bool)
            return pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), pa.array(node[some]), pa.array(need[some])], names=names[1:4])

        now, parts, size, whole = None, [], 0, True
        for b in batches:
            known = b.filter(b.column(1).is_valid())
            if known.num_rows:
                yield pa.RecordBatch.from_arrays(known.columns[1:4], names=names[1:4])
            rest = b.filter(b.column(4).is_valid())
            for bucket, pack in zip(rest.column(0).to_pylist(), rest.column(4)):
                if bucket != now:
                    if parts:
                        yield solve(parts, whole)
                    now, parts, size, whole = bucket, [], 0, True
                parts.append(unpacked(pack.as_py()))
                size += len(parts[-1][0])
                if size > BUCKET_KEYS:  # too many to hold: the keys go on as they are, with those that one class has
                    whole = False
                    yield solve(parts, whole)
                    parts, size = [], 0
        if parts:
            yield solve(parts, whole)

    rows = docs.select("text").mapInArrow(tidy(local), "bucket int, key long, node long, need int, pack binary")
    return rows.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(meet), "key long, node long, need int")


def _candidates(docs: DataFrame, rule: Rule, rounds: int = 2) -> DataFrame:
    """Edges (a, b) that connect all classes that may link.

    A class that shares fewer keys of a size class than a linked partner must
    share has no partner there and leaves, and with it keys that no other class
    has any more; common lines and passages alone do not connect texts.
    """
    rows = cut(_shared_keys(docs, rule).distinct())
    total = rows.count()
    for _ in range(rounds):
        enough = rows.groupBy("node", "need").agg(F.count("*").alias("n")).where(F.col("n") >= F.col("need").bitwiseAND(F.lit(65535)))
        rows = rows.join(enough.select("node", "need").hint("merge"), ["node", "need"], "left_semi")
        lead = rows.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("z"), F.count("*").alias("_n")).where("b <> z")
        rows = cut(join_spread(rows, lead.drop("_n"), ["key"], total=total, share=lead.select("key", "_n")).select("key", "node", "need", "b"))
        pairs, rows = rows.select(F.col("node").alias("a"), "b"), rows.drop("b")
    return pairs.where("a <> b").distinct()


class Region:
    """Exact join of the sets of one region.

    ``links`` counts the documents of the classes that link with each set; ``edges``
    are links that connect all that links connect.  ``masks`` keep pairs apart that
    another task compares: two sets whose masks share a bit are no pair here.
    """

    def __init__(self, sets: list[np.ndarray], rule: Rule, weights: list[int] | None = None, masks: list[int] | None = None):
        n = len(sets)
        self.rule, self.size = rule, np.array([len(s) for s in sets])
        self.flat, at = np.unique(np.concatenate(sets), return_inverse=True)
        self.columns = np.split(at.astype(np.int32), np.cumsum(self.size)[:-1])
        self.weights = np.ones(n, np.int64) if weights is None else np.array(weights, np.int64)
        self.masks = np.zeros(n, np.int64) if masks is None else np.array(masks, np.int64)
        self.links = np.zeros(n, np.int64)
        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []
        self.least = (rule.under - rule.over) / rule.under + 1e-9
        #: cells that pivots made, and sets in their windows
        self.cells = self.windowed = 0

    def join(self) -> None:
        self._run(np.arange(len(self.size)), self.masks, 0)

    def _distances(self, members: np.ndarray, pivot: int) -> np.ndarray:
        mark = np.zeros(len(self.flat), bool)
        mark[self.columns[pivot]] = True
        size = self.size[members]
        hits = mark[np.concatenate([self.columns[x] for x in members])]
        common = np.add.reduceat(hits.astype(np.int64), np.cumsum(size) - size)
        return 1 - common / (size + self.size[pivot] - common)

    def _run(self, members: np.ndarray, masks: np.ndarray, depth: int) -> None:
        n = len(members)
        if n <= LEAF or depth >= DEPTH:
            return self._leaf(members, masks)
        far = [self._distances(members, members[0])]
        while len(far) < TASK_PIVOTS:  # the next pivot is the set that is farthest from all so far
            far.append(self._distances(members, members[np.min(far, 0).argmax()]))
        d = np.stack(far, 1)
        near = d.min(1)
        own = np.where(near <= RADIUS, d.argmin(1), TASK_PIVOTS)
        reach = np.minimum(near + 2 * self.least, RADIUS + self.least)
        cells = []
        for k in range(TASK_PIVOTS + 1):
            inner = own == k
            window = (own > k) & (d[:, k] <= reach) if k < TASK_PIVOTS else np.zeros(n, bool)
            if inner.any():
                cells.append((inner | window, window))
        if max(c.sum() for c, _ in cells) > 0.9 * n:
            return self._leaf(members, masks)
        for cell, window in cells:
            self.cells += 1
            self.windowed += int(window.sum())
            self._run(members[cell], (masks | window.astype(np.int64) << (depth + 3))[cell], depth + 1)

    def _leaf(self, members: np.ndarray, masks: np.ndarray) -> None:
        """Join what pivots do not divide; a wide cell by its rarest shingles, of which linked sets share one."""
        if len(members) < 2:
            return
        parts = self._by_rarest(members) if len(members) > WIDE else np.zeros(len(members), np.int64)
        for part in np.unique(parts):
            own = parts == part
            self._compare(members[own], masks[own])

    def _by_rarest(self, members: np.ndarray) -> np.ndarray:
        """Component of each set by the first shingles of each, rarest first: as many as linked sets cannot all differ in."""
        often = np.zeros(len(self.flat), np.int64)
        for x in members:
            often[self.columns[x]] += 1
        up = list(range(len(members)))

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        first: dict[int, int] = {}
        for k, x in enumerate(members):
            c = self.columns[x]
            keep = len(c) - -(-self.rule.over * len(c) // self.rule.under) + 1
            for h in c[np.lexsort((c, often[c]))[:keep]].tolist():
                a, b = root(first.setdefault(h, k)), root(k)
                up[max(a, b)] = min(a, b)
        return np.array([root(k) for k in range(len(members))])

    def _compare(self, members: np.ndarray, masks: np.ndarray) -> None:
        """Count the common shingles of all pairs and keep what links."""
        n = len(members)
        if n < 2:
            return
        size = self.size[members]
        column = np.concatenate([self.columns[x] for x in members])
        row = np.repeat(np.arange(n), size)
        often = np.bincount(column, minlength=len(self.flat))
        shared = often[column] > 1
        kinds, column = np.unique(column[shared], return_inverse=True)
        row, often = row[shared], often[kinds].astype(float)
        if not len(kinds):
            return
        if n * float(n) * len(kinds) / 100 < (often**2).sum() + 1e4 * n:
            step = max(16, (1 << 21) // len(kinds))
            cut_at = np.searchsorted(row, np.arange(0, n + step, step))

            def dense(k: int) -> np.ndarray:
                out = np.zeros((min(step, n - k * step), len(kinds)), np.float32)
                part = slice(cut_at[k], cut_at[k + 1])
                out[row[part] - k * step, column[part]] = 1
                return out

            blocks = range(-(-n // step))
            for i in blocks:
                a = dense(i)
                for j in range(i, len(blocks)):
                    self._keep(members, masks, size, i * step, j * step, a @ (a if j == i else dense(j)).T)
        else:
            order = np.argsort(column, kind="stable")
            begin = np.searchsorted(column[order], np.arange(len(kinds) + 1))
            holders = row[order]
            own = np.searchsorted(row, np.arange(n + 1))
            for x in range(n):
                c = column[own[x] : own[x + 1]]
                length = begin[c + 1] - begin[c]
                at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + np.repeat(begin[c], length)
                self._keep(members, masks, size, x, 0, np.bincount(holders[at], minlength=n)[None, :])

    def _keep(self, members: np.ndarray, masks: np.ndarray, size: np.ndarray, i: int, j: int, common: np.ndarray) -> None:
        """Links among the pairs of rows from i on and from j on, the first before the second."""
        a, b = np.arange(i, i + common.shape[0]), np.arange(j, j + common.shape[1])
        linked = self.rule.linked(np.rint(common).astype(np.int64), size[a][:, None], size[b][None, :])
        linked &= (a[:, None] < b[None, :]) & ((masks[a][:, None] & masks[b][None, :]) == 0)
        if not linked.any():
            return
        self.links[members[a]] += linked @ self.weights[members[b]]
        self.links[members[b]] += linked.T @ self.weights[members[a]]
        for r in np.flatnonzero(linked.any(1)):
            x, others = members[a[r]], members[b[linked[r]]]
            labels, first = np.unique(self.label[others], return_index=True)
            for other, at in zip(labels.tolist(), first.tolist()):
                mine = self.label[x]
                if other != mine:
                    self.edges.append((int(x), int(others[at])))
                    self.label[self.label == max(mine, other)] = min(mine, other)


def _join_groups(rows: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) that connect, and documents n that link with a class a (b null), inside each group of rows (g, i, j, node, docs, mask, text); groups are of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple[tuple, int, int, int, np.ndarray]]:
            for b in batches:
                for k in range(0, b.num_rows, 64):
                    c = b.slice(k, 64)
                    g = list(zip(*(c.column(x).to_pylist() for x in range(3))))
                    yield from zip(g, *(c.column(x).to_pylist() for x in (3, 4, 5)), shingle_sets(c.column(6), rule.words))

        for _, group in itertools.groupby(stream(), key=lambda r: r[0]):
            _, nodes, docs, masks, sets = zip(*group)
            if len(nodes) < 2:
                continue
            region = Region(list(sets), rule, list(docs), list(masks))
            region.join()
            some = np.flatnonzero(region.links)
            if len(some):
                a, b = [nodes[x] for x, _ in region.edges], [nodes[y] for _, y in region.edges]
                none = [None] * len(some)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a + [nodes[x] for x in some], pa.int64()), "b": pa.array(b + none, pa.int64()), "n": pa.array([None] * len(a) + region.links[some].tolist(), pa.int64())})

    keys = ["g", "i", "j"]
    return rows.select(*keys, "node", "docs", "mask", "text").repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(tidy(run), "a long, b long, n long")


def _refined(rows: DataFrame, rule: Rule) -> DataFrame:
    """(node, part): regions beyond the bound are covered anew by the rarest shingles of each set, as counted in its region.

    Linked sets of n shingles share one of the first n - ceil(least * n) + 1 in any
    order that is the same for the region.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                c = b.slice(i, 256)
                sets = list(shingle_sets(c.column(3), rule.words))
                size = np.array([len(s) for s in sets])
                yield pa.RecordBatch.from_pydict({"g": np.repeat(c.column(0).to_numpy(), size), "node": np.repeat(c.column(1).to_numpy(), size), "n": np.repeat(c.column(2).to_numpy(), size), "s": np.concatenate(sets).view(np.int64)})

    each = rows.select("g", "node", "n", "text").mapInArrow(tidy(spread), "g long, node long, n long, s long")
    often = each.groupBy("g", "s").agg(F.count("*").alias("df")).hint("merge")
    ranked = each.join(often, ["g", "s"]).groupBy("g", "node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("order"))
    first = (F.col("n") - F.ceil(F.lit(rule.over) * F.col("n") / rule.under) + 1).cast("int")
    keys = ranked.select("g", "node", F.explode(F.slice("order", 1, first)).alias("x")).where("x.df > 1").select("g", "node", "x.s")
    lead = keys.groupBy("g", "s").agg(F.min("node").alias("b"))
    return components(keys.join(lead.hint("merge"), ["g", "s"]).select(F.col("node").alias("a"), "b")).select("node", F.col("component").alias("part"))


def _large_regions(rows: DataFrame, rule: Rule, pivots: int, region: int) -> DataFrame:
    """The rows (g, i, j, node, docs, mask, text) of cells and pairs of blocks of regions beyond the bound; ``rows`` have the number of shares of their region."""
    salt = F.pmod(F.xxhash64("node"), F.lit(pivots))
    chosen = rows.groupBy("g", "shares", salt.alias("s")).agg(F.min(F.struct(F.xxhash64("node", F.lit(7)).alias("h"), F.col("node").alias("pivot"))).alias("x")).select("g", "shares", F.col("x.pivot").alias("pivot"))
    of_pivots = chosen.join(rows.select("g", F.col("node").alias("pivot"), F.col("text").alias("pivot_text")), ["g", "pivot"])
    # a region's rows meet its pivots in shares of bounded size
    of_pivots = of_pivots.select("g", "pivot", "pivot_text", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    own_share = F.pmod(F.xxhash64("node", F.lit(5)), F.col("shares")).cast("int")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            out = []
            texts = b.column(4)
            pivots_of = b.column(2).to_pylist()
            for k, (p, s) in enumerate(zip(pivots_of, shingle_sets(b.column(3), rule.words))):
                if p not in held:
                    if len(held) > 64:
                        held.clear()
                    held[p] = next(shingle_sets(texts.slice(k, 1), rule.words))
                q = held[p]
                c = len(np.intersect1d(s, q, assume_unique=True))
                out.append(1 - c / (len(s) + len(q) - c))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.float64())], names=["g", "node", "pivot", "d"])

    meet = rows.select("g", "node", "text", own_share.alias("share")).join(of_pivots, ["g", "share"])
    far = cut(meet.select("g", "node", "pivot", "text", "pivot_text").mapInArrow(tidy(measure), "g long, node long, pivot long, d double"))
    least = (rule.under - rule.over) / rule.under + 1e-9
    best = far.groupBy("g", "node").agg(F.min(F.struct("d", "pivot")).alias("best")).select("g", "node", F.col("best.d").alias("near"), F.when(F.col("best.d") <= RADIUS, F.col("best.pivot")).alias("own"))
    inner = F.coalesce(F.col("pivot") == F.col("own"), F.lit(False))
    later = F.coalesce(F.col("own") > F.col("pivot"), F.lit(True))
    window = later & ~inner & (F.col("d") <= F.least(F.col("near") + 2 * least, F.lit(RADIUS + least)))
    within = far.join(best, ["g", "node"]).where(inner | window).select("node", F.col("pivot").alias("cell"), window.cast("int").alias("window"))
    outer = best.where("own is null").select("node", F.xxhash64("g", F.lit("outer")).alias("cell"), F.lit(0).alias("window"))
    cells = cut(within.unionByName(outer).join(rows.select("node", "n"), "node"))
    blocks = cells.groupBy("cell").agg(F.ceil(2 * F.sum("n") / region).cast("int").alias("blocks"))
    cells = join_spread(cells, blocks, ["cell"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j")))
    placed = cells.select("node", "cell", "window", "block", F.explode(pairs).alias("x"))
    # sets of a window are no pairs with each other, nor sets of one block where two blocks meet
    side = F.when(F.col("x.i") == F.col("x.j"), 0).when(F.col("block") == F.col("x.i"), 2).otherwise(4)
    placed = placed.select("node", F.col("cell").alias("g"), "x.i", "x.j", (F.col("window") + side).cast("long").alias("mask"))
    return placed.join(rows.select("node", "docs", "text"), "node").select("g", "i", "j", "node", "docs", "mask", "text")


def _first(doc: str = "doc", tag: str = "tag") -> Column:
    """A document's place in the order of ids, a null id last."""
    return F.struct(F.col(doc).isNull().alias("none"), F.col(doc).alias("doc"), F.col(tag).alias("tag"))


def _components(docs: DataFrame, rule: Rule, id_col: str, text_col: str, region: int, pivots: int) -> DataFrame:
    """doc, tag, n, n_links and rep, the first document (none, doc, tag) of its component."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).withColumn("tag", F.xxhash64("text"))
    sets = cut(_sets(docs, rule))
    groups = cut(components(_candidates(docs, rule)).select("node", F.col("component").alias("g")))
    classes = sets.where("node is not null").groupBy("node").agg(F.min(_first()).alias("first"), F.first("n").alias("n"), F.count("*").alias("docs"))
    sized = cut(groups.join(classes.hint("merge"), "node").select("g", "node", "n", "docs", "first.none", "first.doc", "first.tag"))
    weight = cut(sized.groupBy("g").agg(F.sum("n").alias("size")))
    release(docs.sparkSession)
    members = join_spread(sized, weight.select("g", (F.col("size") > region).alias("large")), ["g"])

    # an id and a text that repeat are one row here
    own = docs.alias("d").join(members.alias("m").hint("shuffle_hash"), F.expr("d.doc <=> m.doc and d.tag <=> m.tag")).select("m.g", "m.node", "m.n", "m.docs", "m.large", "d.text")
    small = weight.where(F.col("size") > region).isEmpty()
    rows = own.dropDuplicates(["node"]) if small else cut(own.dropDuplicates(["node"]))
    whole = lambda df: df.select("g", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "docs", F.lit(0).cast("long").alias("mask"), "text")
    one = whole(rows.where("not large"))
    if not small:
        wide = rows.where("large").drop("large")
        wide = cut(wide.join(_refined(wide, rule).hint("shuffle_hash"), "node").drop("g").withColumnRenamed("part", "g"))
        shares = wide.groupBy("g").agg(F.ceil(F.sum("n") / region).cast("int").alias("shares"))
        wide = cut(join_spread(wide, shares, ["g"]))
        one = one.unionByName(whole(wide.where("shares = 1")))
        if not wide.where("shares > 1").isEmpty():
            one = one.unionByName(_large_regions(wide.where("shares > 1"), rule, pivots, region))
    links = cut(_join_groups(one, rule))
    found = components(links.where("b is not null").select("a", "b"))
    counted = links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    named = cut(found.join(classes.select("node", "first").hint("merge"), "node"))
    smallest = named.groupBy("component").agg(F.min("first").alias("rep"))
    linked = join_spread(named, smallest, ["component"]).select("node", "rep")
    of_class = classes.join(linked.hint("merge"), "node", "left").join(counted.hint("merge"), "node", "left").select("node", F.coalesce("rep", "first").alias("rep"), (F.col("docs") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return join_spread(sets, of_class, ["node"], "left").select("doc", "tag", "n", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("rep", _first()).alias("rep"))


def join(docs: DataFrame, rule: Rule, *, id_col: str = "doc_id", text_col: str = "text", region: int = REGION, pivots: int = PIVOTS) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest id reachable by links, its own included) and n_links (other documents that it links with).

    A null or empty text has no shingle and no link.  Rows that repeat an id are
    separate documents; a null id is kept and counts as the largest.  An empty
    table gives an empty result.  Other columns are ignored.
    """
    rows = _components(docs, rule, id_col, text_col, region, pivots)
    return rows.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("rep.doc").alias("component_id"), "n_links")


def representatives(docs: DataFrame, rule: Rule, *, id_col: str = "doc_id", text_col: str = "text", region: int = REGION, pivots: int = PIVOTS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the first of their component; of rows with one id and text one stays."""
    rows = _components(docs, rule, id_col, text_col, region, pivots)
    doc, tag, kept_doc, kept_tag = (free_name(docs, x) for x in ("own_doc", "own_tag", "kept_doc", "kept_tag"))
    kept = rows.where(F.col("rep").eqNullSafe(_first())).select(F.col("doc").alias(kept_doc), F.col("tag").alias(kept_tag)).distinct()
    tagged = docs.withColumns({doc: F.col(id_col).cast("long"), tag: F.xxhash64(F.col(text_col).cast("string"))})
    same = F.col(doc).eqNullSafe(F.col(kept_doc)) & (F.col(tag) == F.col(kept_tag))
    return tagged.join(kept.hint("shuffle_hash"), same, "left_semi").dropDuplicates([doc, tag]).select(*docs.columns)
