"""Tokens and hashes of text columns, one Arrow batch at a time inside tasks.

Everything here sees a slice of a batch only: words are cut and numbered by Arrow's own kernels,
so a distinct word of a slice is handled in Python once, and all its places in numpy.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Text of one slice: bounds what a task holds at a time, whatever the batch.
SLICE_BYTES = 12_000_000

# ASCII punctuation, turned to blanks by ``plain``.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

U64 = np.uint64


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch holding about ``most`` bytes of text each (one row at least)."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.float64))
    part = (np.cumsum(sizes) // most).astype(np.int64)
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def given_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; at their end the worker, which later tasks use again, gives freed memory back to the machine."""
    yield from batches
    give_back()


def give_back() -> None:
    """Freed memory of this process goes back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The texts, null as empty."""
    return pc.fill_null(batch.column(column), "")


_BLANKED = bytes(32 if i < 32 or chr(i) in PUNCTUATION else i for i in range(256))


def plain(texts: pa.Array) -> pa.Array:
    """Lower case, with ASCII punctuation and control characters as blanks."""
    low = pc.utf8_lower(texts)
    valid, offsets, data = low.buffers()
    if data is None:
        return low
    return pa.StringArray.from_buffers(len(low), offsets, pa.py_buffer(data.to_pybytes().translate(_BLANKED)), valid, offset=low.offset)


class Words:
    """Words of some texts: ``ids`` numbers them in order, ``starts`` has where each text's words begin (and the end)."""

    def __init__(self, texts: pa.Array):
        trimmed = pc.ascii_trim_whitespace(texts)
        cut = pc.ascii_split_whitespace(trimmed)
        flat = cut.flatten()
        counts = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        empty = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
        if empty.any():  # cut to one empty word
            flat = flat.filter(pc.not_equal(flat, ""))
            counts[empty] = 0
        coded = pc.dictionary_encode(flat)
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words: list[str] = coded.dictionary.to_pylist()
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self.counts = counts

    def hashes(self) -> np.ndarray:
        """64-bit hash of each distinct word."""
        return hash_words(self.words)

    def owner(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def hash_words(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=U64, count=len(words))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) | U64(1)


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of all texts, and where each text's begin; a text of 1 to n-1 words has one, of all its words."""
    per_word = words.hashes()[words.ids] if len(words.ids) else np.zeros(0, U64)
    factor = odd_numbers(n, 5)
    short = (words.counts < n) & (words.counts > 0)
    counts = np.where(short, 1, np.maximum(words.counts - n + 1, 0))
    starts = np.concatenate([[0], np.cumsum(counts)])
    first = np.repeat(words.starts[:-1] - starts[:-1], counts) + np.arange(starts[-1])
    own = np.zeros(starts[-1], U64)
    last = len(per_word) - 1
    length = np.repeat(np.minimum(words.counts, n), counts)
    any_short = short.any()
    for k in range(n):
        part = mixed(per_word[np.minimum(first + k, last)] + U64(k + 1)) * factor[k] if last >= 0 else own
        own = own + (np.where(length > k, part, U64(0)) if any_short else part)
    return mixed(own), starts


def crc_of(column: str | Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; NULL for NULL."""
    c = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(modulus))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just these columns, renamed: what else a table has can't clash with an operator's own names."""
    return df.select(*[F.col(old).alias(new) for new, old in columns.items()])
