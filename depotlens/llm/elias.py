"""Elias-Fano sequences and an n-gram trie over them, in arrays that can be memory-mapped.

A non-decreasing sequence of n values below u keeps the low bits of each value packed and its high part as a unary bit
vector: about 2 + log2(u / n) bits a value.  Places in the bit vector are found through counts of one bit in 512.
"""

from __future__ import annotations

import json
import tempfile
from typing import BinaryIO

import numpy as np

U64 = np.uint64
_IN_BYTE = np.array([[([b for b in range(8) if x >> b & 1] + [0] * 8)[k] for k in range(8)] for x in range(256)], np.int64)
_BLOCK = 8  # words of a count


def _packed(values: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(len(values) * bits // 64 + 2, U64)
    at = np.arange(len(values), dtype=np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(U64)
    np.bitwise_or.at(out, word, values << shift)
    high = np.where(shift > 0, values >> (U64(64) - np.maximum(shift, U64(1))), U64(0))
    np.bitwise_or.at(out, word + 1, high)
    return out


def _unpacked(words: np.ndarray, index: np.ndarray, bits: int) -> np.ndarray:
    at = index * bits
    word, shift = at >> 6, (at & 63).astype(U64)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << (U64(64) - np.maximum(shift, U64(1))), U64(0))
    return (low | high) & U64((1 << bits) - 1)


class Monotone:
    """A non-decreasing sequence of unsigned 64-bit values."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, inner: np.ndarray):
        """ones: set bits before each block; inner: set bits of the block before each word."""
        self.n, self.bits, self.low, self.high, self.ones, self.inner = n, bits, low, high, ones, inner
        self._zeros = np.arange(len(ones), dtype=np.int64) * 64 * _BLOCK - ones

    @classmethod
    def of(cls, values: np.ndarray) -> Monotone:
        values = values.astype(U64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = _packed(values & U64((1 << bits) - 1), bits) if bits else np.zeros(2, U64)
        place = (values >> U64(bits)).astype(np.int64) + np.arange(n)
        words = np.zeros(((int(place[-1]) if n else 0) // 64 + 2 + _BLOCK) // _BLOCK * _BLOCK, U64)
        np.bitwise_or.at(words, place >> 6, U64(1) << (place & 63).astype(U64))
        each = np.cumsum(np.bitwise_count(words).reshape(-1, _BLOCK), axis=1, dtype=np.int64)
        ones = np.concatenate([[0], np.cumsum(each[:, -1])])
        inner = np.concatenate([np.zeros((len(each), 1), np.int64), each[:, :-1]], axis=1).astype(np.uint16).ravel()
        return cls(n, bits, low, words, ones, inner)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th set (or unset) bit: by counts of blocks, of words in a block, then of halves of the word."""
        counts = self.ones if ones else self._zeros
        block = np.searchsorted(counts, k, "right") - 1
        rest = k - counts[block]
        word = block * _BLOCK
        inner = np.zeros(len(k), np.int64)
        for half in (4, 2, 1):
            here = self.inner[word + half].astype(np.int64)
            here = here if ones else 64 * (word + half - block * _BLOCK) - here
            go = rest >= here
            word += half * go
            inner = np.where(go, here, inner)
        rest -= inner
        bits = self.high[word]
        bits = bits if ones else ~bits
        place = word * 64
        for half in (32, 16, 8):
            low = bits & U64((1 << half) - 1)
            n = np.bitwise_count(low)
            go = rest >= n
            rest -= n * go
            place += half * go
            bits = np.where(go, bits >> U64(half), low)
        return place + _IN_BYTE[bits.astype(np.int64) & 255, np.minimum(rest, 7)]

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values at these indices."""
        high = (self._select(i, True) - i).astype(U64) << U64(self.bits)
        return high | _unpacked(self.low, i, self.bits) if self.bits else high

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value that is not below x (its successor)."""
        if not self.n:
            return np.zeros(len(x), np.int64)
        part = np.minimum(x >> U64(self.bits), U64(1 << 62)).astype(np.int64)
        most = len(self.high) * 64 - self.n - 1  # unset bits there are, from 0
        first = np.where(part > 0, self._select(np.minimum(np.maximum(part - 1, 0), most), False) - np.maximum(part - 1, 0), 0)
        last = self._select(np.minimum(part, most), False) - np.minimum(part, most)
        first, last = np.where(part > most, self.n, first), np.where(part > most, self.n, last)
        if not self.bits:
            return first
        want = x & U64((1 << self.bits) - 1)
        while True:  # halve the range of equal high parts
            open_ = first < last
            if not open_.any():
                return first
            mid = (first + last) >> 1
            less = _unpacked(self.low, np.minimum(mid, self.n - 1), self.bits) < want
            first = np.where(open_ & less, mid + 1, first)
            last = np.where(open_ & ~less, mid, last)

    def index(self, x: np.ndarray) -> np.ndarray:
        """Index of x, or -1."""
        place = self.find(x)
        if not self.n:
            return np.full(len(x), -1)
        same = (place < self.n) & (self.at(np.minimum(place, self.n - 1)) == x)
        return np.where(same, place, -1)


class Trie:
    """Two levels: heads, and under each the words that stand beside it, with quantised values.

    ``names`` has the 64-bit hashes of all words.  A tail is kept as its number among the names plus the head's number times
    their count, so the whole level is one rising sequence, and is found by its successor within the head's range.
    """

    def __init__(self, source: BinaryIO):
        size = int.from_bytes(source.read(8), "little")
        shape = json.loads(source.read(size))
        arrays = {}
        for name, (kind, n, start) in shape["arrays"].items():
            arrays[name] = np.memmap(source, kind, "r", 8 + size + start, (n,)) if n else np.zeros(0, kind)
        self.arrays, self.shape = arrays, shape
        self.names, self.heads, self.starts, self.tails = (
            Monotone(*shape["sequences"][s], *(arrays[f"{s}.{a}"] for a in ("low", "high", "ones", "inner"))) for s in ("names", "heads", "starts", "tails"))

    @staticmethod
    def write(to: BinaryIO, names: np.ndarray, heads: np.ndarray, tails: np.ndarray, of: np.ndarray, head_values: np.ndarray, values: np.ndarray,
              extra: dict[str, np.ndarray], bits: int) -> None:
        """names: sorted hashes; heads: sorted numbers; of and tails: (head's place, number) of each pair, sorted."""
        starts = np.searchsorted(of, np.arange(len(heads) + 1))
        sequences = {
            "names": Monotone.of(names), "heads": Monotone.of(heads), "starts": Monotone.of(starts),
            "tails": Monotone.of(of.astype(np.int64) * max(len(names), 1) + tails)}
        arrays: dict[str, np.ndarray] = {}
        for s, m in sequences.items():
            arrays |= {f"{s}.low": m.low, f"{s}.high": m.high, f"{s}.ones": m.ones, f"{s}.inner": m.inner}
        for name, v in (("head", head_values), ("tail", values)):
            codes, levels = quantised(v, bits)
            arrays |= {f"{name}.codes": codes, f"{name}.levels": levels}
        arrays |= extra
        shape, at = {}, 0
        for name, a in arrays.items():
            shape[name] = (a.dtype.str, len(a), at)
            at += -(-a.nbytes // 8) * 8
        text = json.dumps({"sequences": {s: (m.n, m.bits) for s, m in sequences.items()}, "arrays": shape}).encode()
        text += b" " * (-len(text) % 8)
        to.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            to.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
        to.flush()
        to.seek(0)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        return self.names.index(hashes)

    def find(self, head: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """Places of the pairs of these heads (their places, or -1) and tails (hashes), -1 where there is none."""
        tail = self.number(tails)
        place = np.full(len(head), -1)
        at = np.flatnonzero((head >= 0) & (tail >= 0))
        if len(at) and self.tails.n:
            first, last = self.starts.at(head[at]).astype(np.int64), self.starts.at(head[at] + 1).astype(np.int64)
            found = self.tails.index(head[at].astype(U64) * U64(self.names.n) + tail[at].astype(U64))
            place[at] = np.where((found >= first) & (found < last), found, -1)
        return place

    def heads_of(self, hashes: np.ndarray) -> np.ndarray:
        number = self.number(hashes)
        out = np.full(len(hashes), -1)
        at = np.flatnonzero(number >= 0)
        out[at] = self.heads.index(number[at].astype(U64))
        return out

    def value(self, level: str, place: np.ndarray) -> np.ndarray:
        return self.arrays[f"{level}.levels"][self.arrays[f"{level}.codes"][place]]


def quantised(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes, and the value of each code: equal steps between the least and the largest value."""
    if not len(values):
        return np.zeros(0, np.uint16), np.zeros(1)
    low, high = float(values.min()), float(values.max())
    levels = np.linspace(low, high, 1 << bits) if high > low else np.array([low])
    step = levels[1] - levels[0] if len(levels) > 1 else 1.0
    return np.round((values - low) / step).astype(np.uint16), levels


def mapped(write) -> Trie:
    """A trie written by ``write(file)`` to an unnamed temporary file and mapped from there."""
    file = tempfile.TemporaryFile()
    write(file)
    return Trie(file)
