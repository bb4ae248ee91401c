"""Monotone sequences in Elias-Fano form, in memory-mapped scratch files.

A value's low bits are packed side by side; its high bits are a one at place
(high + index) of a bit string, so a sequence takes about log2(top / n) + 2 bits a
value.  A directory counts the ones before every 512 bits.  Sorted keys are looked
up in slices: the directory gives the stretch of the sequence that the slice can
meet, which is decoded, and each key's successor is found in it.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

_U64 = np.uint64
#: Bits between entries of the directory, and keys looked up at once.
SPAN, SLICE = 512, 1 << 15


def mapped(arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The arrays as views of a memory-mapped file that has no name and goes with the last view of it."""
    places, at = {}, 0
    with tempfile.TemporaryFile() as f:
        for name, a in arrays.items():
            places[name] = (a.dtype, len(a), at)
            at += f.write(np.ascontiguousarray(a).data)
            at += f.write(b"\0" * (-at % 8))
        if not at:
            return dict(arrays)
        f.flush()
        whole = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    return {name: np.frombuffer(whole, kind, n, offset) for name, (kind, n, offset) in places.items()}


def _pack(low: np.ndarray, bits: int) -> np.ndarray:
    """Numbers of so many bits side by side in words; 64 numbers take ``bits`` words."""
    groups = -(-len(low) // 64)
    lanes = np.zeros(groups * 64, _U64)
    lanes[: len(low)] = low
    lanes = lanes.reshape(groups, 64)
    words = np.zeros((groups, bits + 1), _U64)
    for j in range(64):
        w, shift = divmod(j * bits, 64)
        words[:, w] |= lanes[:, j] << _U64(shift)
        if shift + bits > 64:
            words[:, w + 1] |= lanes[:, j] >> _U64(64 - shift)
    return words[:, :bits].ravel()


def _unpack(words: np.ndarray, bits: int, first: int, after: int) -> np.ndarray:
    """Numbers first to after of packed ones."""
    if not bits:
        return np.zeros(after - first, _U64)
    g, end = first // 64, -(-after // 64)
    part = words[g * bits : end * bits].reshape(end - g, bits)
    out = np.empty((end - g, 64), _U64)
    mask = _U64((1 << bits) - 1)
    for j in range(64):
        w, shift = divmod(j * bits, 64)
        x = part[:, w] >> _U64(shift)
        if shift + bits > 64:
            x = x | (part[:, w + 1] << _U64(64 - shift))
        out[:, j] = x & mask
    return out.ravel()[first - g * 64 : after - g * 64]


def encode(values: np.ndarray, top: int) -> dict[str, np.ndarray]:
    """Parts of the Elias-Fano form of sorted values below ``top``."""
    n = len(values)
    bits = max(0, (top // max(1, n)).bit_length() - 1)
    ones = (values >> _U64(bits)).astype(np.int64) + np.arange(n)
    size = int(ones[-1]) + 2 if n else 1
    flags = np.zeros(-(-size // SPAN) * SPAN, np.uint8)
    flags[ones] = 1
    high = np.packbits(flags, bitorder="little").view(_U64)
    per = np.bitwise_count(high).reshape(-1, SPAN // 64).sum(1, dtype=np.int64)
    return {"shape": np.array([n, bits], np.int64), "low": _pack(values & _U64((1 << bits) - 1), bits) if bits else np.zeros(0, _U64), "high": high, "before": np.r_[0, np.cumsum(per)]}


class Sequence:
    """Lookups in an encoded sequence."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.bits = map(int, parts["shape"])
        self.low, self.high, self.before = parts["low"], parts["high"], parts["before"]
        self.zeros = np.arange(len(self.before)) * SPAN - self.before

    def _flags(self, first: int, after: int) -> np.ndarray:
        words = SPAN // 64
        return np.unpackbits(np.ascontiguousarray(self.high[first * words : after * words]).view(np.uint8), bitorder="little")

    def _below(self, high: int) -> int:
        """How many values have smaller high bits: the ones in front of the zero that ends those."""
        if high <= 0:
            return 0
        block = int(np.searchsorted(self.zeros, high, "left")) - 1
        if block >= len(self.before) - 1:
            return self.n
        place = np.flatnonzero(self._flags(block, block + 1) == 0)[high - 1 - int(self.zeros[block])]
        return min(self.n, int(self.before[block] + place - (high - 1 - self.zeros[block])))

    def values(self, first: int, after: int) -> np.ndarray:
        """Values first to after, decoded."""
        if after <= first:
            return np.zeros(0, _U64)
        block = int(np.searchsorted(self.before, first, "right")) - 1
        end = int(np.searchsorted(self.before, after, "left"))
        ones = np.flatnonzero(self._flags(block, end)) + block * SPAN
        skip = first - int(self.before[block])
        high = (ones[skip : skip + after - first] - np.arange(first, after)).astype(_U64)
        return (high << _U64(self.bits)) | _unpack(self.low, self.bits, first, after)

    def at(self, places: np.ndarray) -> np.ndarray:
        """Values at sorted places."""
        out = np.empty(len(places), _U64)
        for k in range(0, len(places), SLICE):
            part = places[k : k + SLICE]
            out[k : k + SLICE] = self.values(int(part[0]), int(part[-1]) + 1)[part - part[0]]
        return out

    def successor(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value that is not below each of the sorted keys (n if there is none), and whether it is the key."""
        place, same = np.empty(len(keys), np.int64), np.zeros(len(keys), bool)
        for k in range(0, len(keys), SLICE):
            part = keys[k : k + SLICE]
            first, after = self._below(int(part[0]) >> self.bits), self._below((int(part[-1]) >> self.bits) + 1)
            known = self.values(first, after)
            at = np.searchsorted(known, part)
            place[k : k + SLICE] = first + at
            if len(known):
                same[k : k + SLICE] = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == part)
        return place, same
