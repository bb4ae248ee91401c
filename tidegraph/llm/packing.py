"""Hierarchical multi-length packing of tokenised documents.

Whole windows of the longest context size are cut off each document.  What is left
is routed to the tier of its own size, the shortest context size that holds it.
Tiers are packed from the longest down: a sequence of a tier opens with its longest
unit, and its gap takes the longest whole units of the tiers that fit into it; only
a gap that no whole unit fits into cuts one.  So all sequences are full at their
tier's size.  The tokens of a batch that no longer fill a sequence of their tier go
on to the next batch; at the end of a task they form sequences of powers of two,
which need no padding.  Packing works inside a task on batches of bounded size: no
shuffle, no state that grows with the input, and a lost task packs the same rows
again.  Sequences are dealt to step groups so that the groups' attention cost
(sum of squared piece lengths) is even.
"""

from __future__ import annotations

import array
import bisect
import re
import sys
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.textkit import tidy

#: Context sizes.
TIERS = (2048, 1024, 512, 256)
#: Sequences of one training step.
STEP = 32
_ADJACENT = re.compile(r"\s\s")
_PARTS = r"""'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"""


class ByteBpe:
    """Ids of a byte-level BPE vocabulary for whole texts, as ``tokenizers`` gives them without added tokens.

    The pre-tokens of these vocabularies need a look-ahead only where two white
    space characters meet; other texts are cut by the same pattern without it,
    which is faster and gives the same ids.  A text is first cut at the
    vocabulary's special strings, which are ids of their own.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        added = {t["content"]: t for t in model.get("added_tokens", []) if t["content"]}
        table = _byte_alphabet()
        pre = model.get("pre_tokenizer") or {}
        plain = model["model"]["type"] == "BPE" and not model["model"].get("ignore_merges") and model.get("normalizer") is None
        plain = plain and not any(t.get(flag) for t in added.values() for flag in ("single_word", "lstrip", "rstrip"))
        self._ranked = plain and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if self._ranked:
            ranks = {bytes(table[c] for c in w): i for w, i in model["model"]["vocab"].items() if w not in added}
            make = lambda pattern: tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self._plain, self._full = make(_PARTS), make(_PARTS[:-4] + r"|\s+(?!\S)|\s+")
            self._ids = {content: t["id"] for content, t in added.items()}
            self._special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        else:
            from tokenizers import Tokenizer

            self._reference = Tokenizer.from_file(path)

    def _ordinary(self, text: str) -> list[int]:
        return (self._full if _ADJACENT.search(text) else self._plain)(text)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not self._ranked:
            ids = self._reference.encode(text, add_special_tokens=False).ids
        elif self._special is not None and self._special.search(text):
            ids = []
            for k, part in enumerate(self._special.split(text)):
                ids += [self._ids[part]] if k % 2 else self._ordinary(part)
        else:
            ids = self._ordinary(text)
        return np.array(ids, dtype="<u4").tobytes() if sys.byteorder == "big" else array.array("I", ids).tobytes()


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    n = 0
    for b in range(256):
        if b not in plain:
            table[chr(256 + n)] = b
            n += 1
    return table


Piece = tuple[int, int, int, int, int, int]


class Packer:
    """Units (length, document, start) by tier, and the sequences made of them.

    ``pieces`` holds (document, start, length, sequence, offset, size of the
    sequence), every token once.
    """

    def __init__(self, tiers: Sequence[int] = TIERS):
        self.tiers = tuple(tiers)
        self.units: dict[int, list[tuple[int, int, int]]] = {t: [] for t in self.tiers}
        self.left = 0
        self.sequences = 0
        self.pieces: list[Piece] = []

    def add(self, document: int, tokens: int) -> None:
        """Cut off whole windows of the longest tier and route the rest to the tier of its size."""
        at, window = 0, self.tiers[0]
        while tokens - at >= window:
            self.pieces.append((document, at, window, self.sequences, 0, window))
            self.sequences += 1
            at += window
        if tokens > at:
            self._route((tokens - at, document, at))
            self.left += tokens - at

    def _route(self, unit: tuple[int, int, int]) -> None:
        bisect.insort(self.units[min(t for t in self.tiers if t >= unit[0])], unit)

    def _best(self, gap: int) -> tuple[int, int, int] | None:
        """The longest unit that fits whole; taken out."""
        for t in self.tiers:
            pool = self.units[t]
            if pool and pool[0][0] <= gap:
                return pool.pop(bisect.bisect_right(pool, (gap, sys.maxsize, 0)) - 1)
        return None

    def _shortest(self) -> tuple[int, int, int]:
        for t in reversed(self.tiers):
            if self.units[t]:
                return self.units[t].pop(0)
        raise LookupError("no unit is left")

    def _sequence(self, size: int) -> None:
        """One full sequence of a size that the units left can fill."""
        gap = size
        while gap:
            unit = self._best(gap)
            if unit is None:
                n, d, at = self._shortest()
                self._route((n - gap, d, at + gap))
                unit = (gap, d, at)
            n, d, at = unit
            self.pieces.append((d, at, n, self.sequences, size - gap, size))
            gap -= n
        self.sequences += 1
        self.left -= size

    def pack(self) -> None:
        """Fill sequences tier by tier, as long as what is left fills one of the tier."""
        for t in self.tiers:
            while self.units[t] and self.left >= t:
                self._sequence(t)

    def finish(self) -> None:
        """Sequences of powers of two from the rest."""
        while self.left:
            self._sequence(1 << min(self.left.bit_length() - 1, self.tiers[0].bit_length() - 1))

    def documents(self) -> set[int]:
        """The documents with units that are not packed yet."""
        return {d for pool in self.units.values() for _, d, _ in pool}


def balance(pieces: list[Piece], step: int = STEP) -> dict[int, int]:
    """Step group of each sequence: sequences in order of cost are dealt back and forth."""
    cost: dict[int, int] = {}
    for _, _, n, s, _, _ in pieces:
        cost[s] = cost.get(s, 0) + n * n
    groups = max(1, -(-len(cost) // step))
    out = {}
    for k, s in enumerate(sorted(cost, key=lambda s: (-cost[s], s))):
        lap, at = divmod(k, groups)
        out[s] = groups - 1 - at if lap % 2 else at
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", tiers: Sequence[int] = TIERS, end_id: int = 1, step: int = STEP, with_ids: bool = False, batch_docs: int = 2048, batch_tokens: int = 2_000_000) -> DataFrame:
    """Pack every document into sequences of at most ``tiers[0]`` tokens.

    A null text counts as empty: its document is the end id alone.  A null id is
    kept.  Rows with the same id are separate documents.  An empty table gives an
    empty result.  Other columns are ignored.  Result, one row a piece: doc_id,
    start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (the size of
    the sequence), step_group, and ids if ``with_ids``.
    """
    tiers = tuple(tiers)
    if not tiers or any(a <= b for a, b in zip(tiers, tiers[1:])) or tiers[-1] < 1:
        raise ValueError("tiers must fall strictly and be positive")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())]
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
        ddl += ", ids array<int>"
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe = ByteBpe(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        base = TaskContext.get().partitionId() << 38
        groups = base
        packer = Packer(tiers)
        texts: dict[int, tuple] = {}  # document number: (id, token ids)
        number = fresh = held = 0

        def given() -> pa.RecordBatch:
            """The pieces so far; documents with tokens left stay."""
            nonlocal groups, fresh, held
            pieces, packer.pieces = packer.pieces, []
            group = balance(pieces, step)
            rows: list[list] = [[] for _ in fields]
            for d, at, n, s, o, t in pieces:
                name, ids = texts[d]
                part = ids[4 * at : 4 * (at + n)]
                row = [name, at, n, zlib.crc32(part), len(ids) // 4, base + s, o, t, groups + group[s]]
                if with_ids:
                    row.append(np.frombuffer(part, "<u4").astype(np.int32))
                for c, v in zip(rows, row):
                    c.append(v)
            groups += 1 + max(group.values(), default=-1)
            stay = packer.documents()
            for d in [d for d in texts if d not in stay]:
                del texts[d]
            fresh = held = 0
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(rows, schema)], schema=schema)

        for b in batches:
            for d, t in zip(b.column(0), b.column(1)):
                text = t.as_py()
                ids = (bpe.encode(text) if text else b"") + end
                texts[number] = (d.as_py(), ids)
                packer.add(number, len(ids) // 4)
                number += 1
                fresh += 1
                held += len(ids) // 4
                if fresh >= batch_docs or held >= batch_tokens:
                    packer.pack()
                    yield given()
        packer.pack()
        packer.finish()
        if packer.pieces:
            yield given()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), ddl)
