"""Benchmark decontamination by spaced seeds.

A seed is a window of words in which a fixed mask leaves some positions out, so that a hash of the others
survives a substituted word there.  Hashes of all windows of the texts meet the sorted hashes of all windows of the
benchmark items; around each hit, text and item are laid over each other and the stretch is verified word
by word, with substitutions.  The benchmark is taken in blocks of bounded size, each sent to all tasks, and every
text meets every block; nothing is shuffled.

Beside the masks, ``least_words`` equal words on end are a seed.  Items shorter than a mask have masks of their own length, by
which every stretch of the whole item that passes the verification is found.

Defined cases: NULL text counts as empty and has no match.  Items under ``least_words`` words are found where all of their words
stand in a row, even a single one; empty or NULL ones are never found.  Texts and items are
compared in lower case without ASCII punctuation.  Rows are never joined by id, so repeated and NULL ids keep their rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from depotlens.llm.text import U64, Words, hash_words, mixed, odd_numbers, only, plain, slices, texts_of

# Fixed masks of span 11 and weight 7: 1 is a word that counts.
MASKS = ("11101001011", "11010011101", "10111000111", "11100110101")


@dataclass(frozen=True)
class Settings:
    masks: tuple[str, ...] = MASKS
    least_words: int = 8  # equal words of a verified stretch
    identity: float = 0.8  # equal words among those of the stretch
    block_chars: int = 8_000_000  # of benchmark text sent to tasks at a time


FOUND = StructType([StructField(n, LongType()) for n in ("item_id", "first", "words", "equal")])


def seed_hashes(per_word: np.ndarray, mask: tuple[int, ...], factors: np.ndarray) -> np.ndarray:
    """One hash for each place where the mask fits."""
    n = len(per_word) - mask[-1]
    out = np.zeros(max(n, 0), U64)
    for k in mask if n > 0 else ():
        out += per_word[k:k + n] * factors[k]
    return mixed(out)


def masks_of_length(n: int, s: Settings) -> list[tuple[int, ...]]:
    """Masks for items of ``n`` words, one of which fits whichever words are substituted, as far as the verification allows.

    With d substitutions at most, the words fall into 2 d + 1 blocks, and each mask leaves d of them out.
    """
    d = max(0, n - max(s.least_words, math.ceil(s.identity * n - 1e-9)))
    blocks = np.array_split(np.arange(n), min(2 * d + 1, n))
    counted = [np.concatenate([b for j, b in enumerate(blocks) if j not in out]) for out in combinations(range(len(blocks)), d)]
    return sorted({tuple((m - m[0]).tolist()) for m in counted})


class Items:
    """The seeds and words of a block of benchmark items."""

    def __init__(self, rows: list[tuple[int, str]], s: Settings):
        self.s = s
        self.ids = np.array([r[0] for r in rows], object)
        words = Words(plain(pa.array([r[1] for r in rows], pa.string())))
        hashes = mixed(words.hashes())[words.ids] if words.words else np.zeros(0, U64)
        self.words = [hashes[a:b] for a, b in zip(words.starts[:-1], words.starts[1:], strict=True)]
        masks = [tuple(np.flatnonzero(np.array(list(m)) == "1").tolist()) for m in s.masks]
        span = max(m[-1] + 1 for m in masks)
        masks.append(tuple(range(s.least_words)))
        # Each mask with the number of words of the items it is for; 0: all of least_words.
        of = [(m, 0) for m in masks] + [(m, n) for n in sorted({len(w) for w in self.words if 0 < len(w) < span}) for m in masks_of_length(n, s)]
        self.factors = odd_numbers(max(m[-1] + 1 for m, _ in of), 31)
        self.masks = [m for m, _ in of]
        seeds, owner, place = [], [], []
        for k, (mask, n) in enumerate(of):
            for i, w in enumerate(self.words):
                if len(w) != n if n else len(w) < s.least_words:
                    continue
                own = seed_hashes(w, mask, self.factors) ^ U64(k)
                seeds.append(own)
                owner.append(np.full(len(own), i))
                place.append(np.arange(len(own)))
        seeds = np.concatenate([np.zeros(0, U64), *seeds])
        order = np.argsort(seeds, kind="stable")
        self.seeds = seeds[order]
        self.owner = np.concatenate([np.zeros(0, np.int64), *owner]).astype(np.int64)[order]
        self.place = np.concatenate([np.zeros(0, np.int64), *place]).astype(np.int64)[order]
        self.bits = max(16, int(math.log2(len(seeds) + 1)) + 5)
        self.present = np.zeros(1 << self.bits, bool)
        self.present[(self.seeds >> U64(64 - self.bits)).astype(np.int64)] = True

    def hits(self, per_word: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Distinct (text, item, word of all texts less word of the item) of the seed hits within a text, as rows."""
        found = []
        text_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        for k, mask in enumerate(self.masks):
            own = seed_hashes(per_word, mask, self.factors) ^ U64(k)
            at = np.flatnonzero(self.present[(own >> U64(64 - self.bits)).view(np.int64)])
            at = at[text_of[at] == text_of[at + mask[-1]]]  # a window over two texts is in neither
            first, last = np.searchsorted(self.seeds, own[at], "left"), np.searchsorted(self.seeds, own[at], "right")
            n = last - first
            entry = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            where = np.repeat(at, n)
            found.append(np.stack([text_of[where], self.owner[entry], where - self.place[entry]], axis=1))
        every = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        return pd.DataFrame(every).drop_duplicates().sort_values([0, 1, 2]).to_numpy() if len(every) else every

    def search(self, words: Words) -> list[list[tuple[int, int, int, int]]]:
        """Of each text: (item, first word, words, equal words) of the best verified stretch of each item."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in words.counts]
        if not words.words or not len(self.seeds):
            return out
        per_word = mixed(words.hashes())[words.ids]
        for text, item, shift in self.hits(per_word, words.starts):
            own = self.words[item]
            a = max(words.starts[text], shift)
            b = min(words.starts[text + 1], shift + len(own))
            same = per_word[a:b] == own[a - shift:b - shift]
            for first, last in (best_stretch(same, self.s.identity), (0, len(same))):  # the whole overlap may pass where its densest part is too short
                equal = int(same[first:last].sum())
                if equal >= min(self.s.least_words, len(own)) and equal >= self.s.identity * (last - first) - 1e-9:
                    out[text].append((item, int(a + first - words.starts[text]), int(last - first), equal))
                    break
        return [best_of(found) for found in out]


def best_stretch(same: np.ndarray, identity: float) -> tuple[int, int]:
    """Range of the largest sum, where an equal word gives 1 and another costs what makes the identity break even."""
    sums = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, -identity / (1 - identity)))])
    low = np.minimum.accumulate(sums)
    last = int(np.argmax(sums - low))
    return int(np.argmin(sums[:last + 1])), last


def best_of(found):
    best = {}
    for f in found:
        best[f[0]] = max(best.get(f[0], f), f, key=lambda x: (x[3], -x[1]))
    return [best[k] for k in sorted(best)]


def benchmark_blocks(benchmark: DataFrame, s: Settings):
    """The items in blocks of about ``block_chars``, dealt by a hash of the text."""
    items = only(benchmark, item_id="item_id", text="text").filter("text IS NOT NULL").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / s.block_chars))
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b) if blocks > 1 else items
        yield Items(sorted(map(tuple, own.collect()), key=lambda r: (r[0] is None, r)), s)  # block_chars bounds it


def matched(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings(), column: str = "found") -> DataFrame:
    """The rows of ``docs`` (which needs ``text``) with ``column``: the items found, each with its first word, words and equal words."""
    own = docs.drop(column)
    names = own.columns
    kind = StructType([*own.schema.fields, StructField(column, ArrayType(FOUND))])
    rows = own.withColumn(column, F.lit([]).cast(ArrayType(FOUND)))

    def with_block(items):
        def run(batches):
            for batch in batches:
                for part in slices(batch):
                    found = items.value.search(Words(plain(texts_of(part))))
                    before = part.column(column).to_pylist()
                    ids = items.value.ids
                    now = [old + [{"item_id": ids[i], "first": a, "words": n, "equal": e} for i, a, n, e in new] for old, new in zip(before, found, strict=True)]
                    made = pa.array(now, part.schema.field(column).type)
                    yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], made], [*names, column])
        return run

    for block in benchmark_blocks(benchmark, s):
        rows = rows.mapInArrow(with_block(docs.sparkSession.sparkContext.broadcast(block)), kind)
    return rows


def kept(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents in which no item is found, with their own columns."""
    return matched(docs, benchmark, s, "__found").filter(F.size("__found") == 0).drop("__found")
