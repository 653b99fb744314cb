"""Spelling variants of a corpus's words, grouped through an index of variable-length grams.

Grams of two and three letters are counted over all words.  The dictionary keeps every gram of two letters, and a
longer one only where the gram it lengthens is frequent; so a gram is rare or as long as allowed.  A word's gram at each
place is the longest one of the dictionary.  That choice reads a known stretch of the word, hence one edit can affect
only grams whose stretch it falls into, and the grams of two words one edit apart agree but for those: before the
edit with the word's beginning, after it with its end.  A word is divided into a dozen zones at most; the bound of
a zone are the grams that an edit inside it may affect.  Words whose all other grams agree are found by merging the lists of
these grams, which one key of a zone stands for; every pair that has such a key in common is then verified.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlens.llm import chunks
from depotlens.llm.text import only, slices
from depotlens.session import materialise


GRAM_BYTES = 2_000_000  # of words whose grams are counted together


@dataclass(frozen=True)
class Settings:
    least_letters: int = 7  # code points of a word
    least_count: int = 2
    shorten: int = 31  # runs whose crc32 with the document this divides lose a letter
    dominance: int = 10  # a form occurs so many times as often
    shortest: int = 2
    longest: int = 3
    zones: int = 12
    frequent: float = 1 / 2000  # share of all grams of its length from which a gram is lengthened; bounds the dictionary


def letter_runs(texts: pa.Array) -> chunks.Chunks:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF (two bytes, the first of which is C3), with A-Z in lower case."""
    raw, at = chunks.bytes_of(texts)
    upper = (raw >= 65) & (raw <= 90)
    low = raw + upper * np.uint8(32)
    wide = raw == 0xC3
    inside = (low >= 97) & (low <= 122) | wide
    inside[1:] |= wide[:-1]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], inside[:-1]])[:len(raw)]
    after = np.concatenate([inside[1:], [False]])[:len(raw)]
    first = np.flatnonzero(inside & (~before | edge[:-1]))
    last = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return chunks.Chunks(low[inside], at, first, last)


def _words_of(batch: pa.RecordBatch, settings: Settings) -> Counter:
    """Occurrences of the words of some documents, shortened where the rule says so."""
    cut = letter_runs(batch.column("text"))
    texts = [p.decode() for p in cut.pieces]
    letters = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(batch.num_rows), np.diff(cut.starts))
    long = letters[cut.ids] >= settings.least_letters
    both, times = np.unique(owner[long] * max(1, len(texts)) + cut.ids[long], return_counts=True)
    doc, run = both // max(1, len(texts)), both % max(1, len(texts))
    seeds = [zlib.crc32(b":" if i is None else f"{i}:".encode()) for i in batch.column("doc_id").to_pylist()]
    hashes = np.fromiter((zlib.crc32(cut.pieces[r], seeds[d]) for d, r in zip(doc.tolist(), run.tolist(), strict=True)), np.int64, len(both))
    whole = hashes % settings.shorten != 0
    found = Counter(dict(zip(texts, np.bincount(run[whole], times[whole], len(texts)).astype(np.int64).tolist(), strict=True)))
    for r, h, n in zip(run[~whole].tolist(), hashes[~whole].tolist(), times[~whole].tolist(), strict=True):
        k = h % letters[r]
        if letters[r] > settings.least_letters:
            found[texts[r][:k] + texts[r][k + 1:]] += n
    return found


def word_counts(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(word, n) of all documents; counted per slice of texts, then by word."""
    own = only(docs, doc_id="doc_id", text="text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = {w: n for w, n in _words_of(part, settings).items() if n}
                yield pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    counted = own.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= settings.least_count)


def gram_dictionary(words: DataFrame, settings: Settings = Settings()) -> dict[str, int]:
    """Occurrences of each gram that the pruned dictionary keeps.

    A gram longer than the shortest stays only if the one it lengthens is frequent.  At most 1 / ``frequent`` grams of a
    length are, each lengthened by one of 58 letters, so the dictionary is bounded whatever the corpus.
    """
    sizes = range(settings.shortest, settings.longest + 1)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "word", GRAM_BYTES):
                found: Counter = Counter()
                for w in part.column("word").to_pylist():
                    for k in sizes:
                        found.update(w[i:i + k] for i in range(len(w) - k + 1))
                yield pa.RecordBatch.from_pydict({"gram": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    grams = words.select("word").mapInArrow(counted, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    grams = materialise(grams, "grams")
    totals = {r.k: r.n for r in grams.groupBy(F.length("gram").alias("k")).agg(F.sum("n").alias("n")).collect()}
    kept: dict[str, int] = {}
    longer = grams.filter(F.length("gram") == settings.shortest)
    for k in sizes:
        found = longer.toArrow()
        here = dict(zip(found.column("gram").to_pylist(), found.column("n").to_pylist(), strict=True))
        kept |= here
        often = [g for g, n in here.items() if n > settings.frequent * totals[k]]
        longer = grams.filter((F.length("gram") == k + 1) & F.substring("gram", 1, k).isin(often))
    return kept


class Index:
    """Decomposition of words by a gram dictionary."""

    def __init__(self, kept: dict[str, int], settings: Settings):
        self.kept, self.shortest, self.zones = kept.keys(), settings.shortest, settings.zones
        self.lengthened = {g[:-1] for g in kept}

    def decompose(self, word: str) -> list[tuple[int, int, int]]:
        """(place, end of the gram, last place read) for each place; one past the word where its end is read."""
        found = []
        for p in range(len(word) - self.shortest + 1):
            end = p + self.shortest
            while word[p:end] in self.lengthened and end < len(word) and word[p:end + 1] in self.kept:
                end += 1
            found.append((p, end, end if word[p:end] in self.lengthened else end - 1))
        return found

    def keys(self, word: str, longer: int = 0) -> list[int]:
        """For each zone, one hash of all grams that an edit inside it doesn't affect, as a word of ``longer`` more letters has it too.

        A zone is a stretch of the longer word of a pair.  What stands before it counts as far as grams reach that
        read nothing of it; what stands after it counts whole, as grams read onwards only.
        """
        size = len(word) + longer
        places = sorted({size * k // self.zones for k in range(self.zones + 1)})
        ends = [0] * (size + 1)
        for _, _, read in self.decompose(word):
            if read < size:
                ends[read + 1] = read + 1
        reach = list(accumulate(ends, max))
        return [xxhash.xxh3_64_intdigest(f"{size}.{c}<{word[:reach[c]]}>{word[d - longer:]}") - (1 << 63) for c, d in pairwise(places)]


def one_apart(a: str, b: str) -> bool:
    """Whether different words whose lengths differ by one at most are one inserted, deleted or replaced code point apart.

    The first difference is found by halving, in C and in linear time also for very long words.
    """
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return a[low + (len(a) >= len(b)):] == b[low + (len(b) >= len(a)):]


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array([one_apart(a, b) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)], pa.bool_()))


def near_words(words: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(a, n_a, b, n_b), both ways: pairs of words exactly one inserted, deleted or replaced code point apart."""
    kept = gram_dictionary(words, settings)

    def listed(batches: Iterator[pa.RecordBatch], probing: bool) -> Iterator[pa.RecordBatch]:
        index, names = Index(kept, settings), ["key", "a", "n_a"] if probing else ["key", "b", "n_b"]
        for batch in batches:
            keys = [index.keys(w) + (index.keys(w, 1) if probing else []) for w in batch.column("word").to_pylist()]
            rows = pa.array(np.repeat(np.arange(batch.num_rows), [len(k) for k in keys]))
            yield pa.RecordBatch.from_arrays([pa.array([k for own in keys for k in own], pa.int64()), *(c.take(rows) for c in batch.columns)], names)

    own = words.select("word", "n")
    a = own.mapInArrow(partial(listed, probing=True), "key long, a string, n_a long")
    b = own.mapInArrow(partial(listed, probing=False), "key long, b string, n_b long")
    met = a.join(b, "key").filter((F.length("a") < F.length("b")) | (F.length("a") == F.length("b")) & (F.col("a") < F.col("b"))).select("a", "n_a", "b", "n_b")
    pairs = met.mapInArrow(verified, met.schema).distinct()
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))


def grouped(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the corpus.

    ``form`` is the near word of largest n (ties: smallest in code-point order) if that is at least ``dominance`` times
    the word's own, ``root`` what forms lead to at last.  A null text has no words; a null id counts as an empty one
    in the hash; repeated rows count each; runs of any length are words; an empty table gives no rows; other columns
    of ``docs`` aren't read.
    """
    words = materialise(word_counts(docs, settings), "words")
    near = near_words(words, settings)
    best = near.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), "b")).alias("best"))
    formed = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    strong = -F.col("best.less") >= settings.dominance * F.col("n")
    formed = formed.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.b")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"))
    formed = materialise(formed, "forms")
    roots = _last(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _last(steps: DataFrame) -> DataFrame:
    """(word, root): each word's root replaced by that one's own until none has one; along forms n grows tenfold, so chains are short."""
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = materialise(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        if steps.filter("next IS NOT NULL").isEmpty():
            return steps.select("word", "root")
        steps = steps.select("word", "root")
