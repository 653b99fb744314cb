"""Packing of documents into training sequences by dynamic programming over the places where a window may end.

Documents keep their order.  The token stream of a block of documents is cut into windows of at most ``window``
tokens; a cut costs nothing at the end of a document, ``truncation`` at the end of a sentence or line, and twice
that anywhere else.  A window costs its padding: up to ``window``, or nothing where its length is a power of two.
With p the places and best[j] the least cost up to place j,

    best[j] = cut[j] + min(min over p[j] - p[i] <= window of (best[i] + p[i]) + window - p[j],
                           min over p[j] - p[i] a power of two of best[i])

The first minimum is the head of a monotone queue on best[i] + p[i], the second a look-up of a dozen exact places.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlens.llm import chunks
from depotlens.llm.text import only, slices


@dataclass(frozen=True)
class Settings:
    window: int = 4096
    separator: int = 2  # id after each document
    truncation: int = 64  # cost in tokens of a document cut at the end of a sentence; twice that elsewhere
    long_sentence: int = 512  # tokens without a place to cut after which one is given


@lru_cache(2)
def _tokenizer(json: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
    from tokenizers import Tokenizer

    return Tokenizer.from_str(json)


SENTENCE_END = "[.!?…。！？][\"')\\]}»”’]*$"


def encoded_words(own: list[str], tokenizer, together: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, number of each one's).  Words are encoded some hundred to a text, which costs half of one by one, and told apart by offsets."""
    joined = [" ".join(own[k:k + together]) for k in range(0, len(own), together)]
    flat, sizes = [np.zeros(0, np.uint32)], np.zeros(len(own), np.int64)
    for k, e in enumerate(tokenizer.encode_batch(joined, add_special_tokens=False) if own else []):
        part = own[k * together:(k + 1) * together]
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        flat.append(np.array(e.ids, np.uint32))
        owner = np.searchsorted(ends, np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids)), "right")
        sizes[k * together:k * together + len(part)] = np.bincount(owner, minlength=len(part))
    return np.concatenate(flat), sizes


class Stream:
    """Token ids of some texts, each with the separator: document k is ids ``at[k]`` to ``at[k + 1]``; ``sentences`` are places inside them."""

    def __init__(self, texts: pa.Array, tokenizer, separator: int):
        cut, line_ends = chunks.words(texts)
        own = [p.decode() for p in cut.pieces]
        flat, sizes = encoded_words(own, tokenizer)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        stops = pc.match_substring_regex(pa.array(own, pa.large_string()), SENTENCE_END).to_numpy(zero_copy_only=False).astype(bool)
        ends = np.concatenate([[0], np.cumsum(sizes[cut.ids])])  # tokens of the words before
        n = len(texts)
        self.at = ends[cut.starts] + np.arange(n + 1)
        self.ids = np.full(self.at[-1], separator, np.uint32)
        inside = np.ones(self.at[-1], bool)
        inside[self.at[1:] - 1] = False
        self.ids[inside] = flat[chunks.spans_in(cut.ids, starts)]
        owner = np.repeat(np.arange(n), np.diff(cut.starts))
        self.sentences = (ends[1:] + owner)[stops[cut.ids] | line_ends]


def places(stream: Stream, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(ascending places where a window may begin or end, cost of a cut there); the last window may be cut anywhere."""
    size = stream.at[-1]
    cost = np.full(size + 1, -1, np.int32)
    cost[max(0, size - settings.window):] = 2 * settings.truncation
    known = np.zeros(size + 1, bool)
    known[stream.sentences] = known[stream.at] = True
    found = np.flatnonzero(known)
    for k in np.flatnonzero(np.diff(found) > settings.long_sentence):
        cost[found[k] + settings.long_sentence:found[k + 1]:settings.long_sentence] = 2 * settings.truncation
    cost[stream.sentences] = settings.truncation
    cost[stream.at] = 0
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def windows(at: np.ndarray, cost: np.ndarray, window: int) -> tuple[list[int], int]:
    """(indices into ``at`` of the chosen cuts, first and last place included, and their least cost).

    ``at`` begins with 0 and has no gap above ``window``.  Of equal costs the longest window is taken.
    """
    n = len(at)
    number = np.full(at[-1] + 1, -1, np.int64)
    number[at] = np.arange(n)
    later, sooner = [], []  # places a power of two apart, by their later one, longest last
    power = 1
    while power <= window:
        hit = np.flatnonzero(at >= power)
        before = number[at[hit] - power]
        later.append(hit[before >= 0])
        sooner.append(before[before >= 0])
        power *= 2
    later, sooner = np.concatenate(later), np.concatenate(sooner)
    order = np.argsort(later, kind="stable")
    exact, bounds = sooner[order].tolist(), np.searchsorted(later[order], np.arange(n + 1)).tolist()
    p, cut = at.tolist(), cost.tolist()
    best, back = [0], [0]
    keys, queue, head = [0], [0], 0  # best + place and index, both ascending from the head on
    for j in range(1, n):
        here = p[j]
        while p[queue[head]] < here - window:
            head += 1
        i = queue[head]
        low = keys[head] + window - here
        for k in range(bounds[j + 1] - 1, bounds[j] - 1, -1):
            if best[exact[k]] < low:
                i = exact[k]
                low = best[i]
        low += cut[j]
        best.append(low)
        back.append(i)
        key = low + here
        while len(keys) > head and keys[-1] > key:
            keys.pop()
            queue.pop()
        keys.append(key)
        queue.append(j)
    chosen = [n - 1]
    while chosen[-1]:
        chosen.append(back[chosen[-1]])
    return chosen[::-1], best[-1]


def _pieces(batch: pa.RecordBatch, tokenizer, settings: Settings, first_sequence: int, keep_ids: bool) -> tuple[pa.RecordBatch, int]:
    stream = Stream(batch.column("text"), tokenizer, settings.separator)
    at, cost = places(stream, settings)
    cuts = at[windows(at, cost, settings.window)[0]]
    edges = np.union1d(cuts, stream.at)
    begin, length = edges[:-1], np.diff(edges)
    doc = np.searchsorted(stream.at, begin, "right") - 1
    sequence = np.searchsorted(cuts, begin, "right") - 1
    ids = np.ascontiguousarray(stream.ids, "<u4")
    crc = [zlib.crc32(ids[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    found = {
        "doc_id": batch.column("doc_id").take(pa.array(doc)), "start": begin - stream.at[doc], "length": length, "ids_crc32": pa.array(crc, pa.int64()),
        "doc_tokens": np.diff(stream.at)[doc], "sequence_id": first_sequence + sequence, "offset": begin - cuts[sequence],
    }
    if keep_ids:
        found["ids"] = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int32)))
    return pa.RecordBatch.from_pydict(found), first_sequence + len(cuts) - 1


def packed(docs: DataFrame, tokenizer_json: str, settings: Settings = Settings(), keep_ids: bool = False) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), with ``keep_ids`` also its ids.

    ``tokenizer_json`` is the text of a tokenizer file whose words never cross a blank, or a letter and the full stop or comma that ends its word.  No shuffle: each task packs
    its rows in their order, a slice of texts at a time, so at most one window a slice is short for want of text.
    Sequences are numbered by task; rows must come in a repeatable order (files), so that a task run again gives the
    same.  A null text has the separator only, a null id stays null, repeated rows are packed each, a text of any
    length is cut, an empty table gives no rows; other columns of ``docs`` aren't read.  Equal costs: the longest window.
    """
    own = only(docs, doc_id="doc_id", text="text")
    kind = own.schema["doc_id"].dataType.simpleString()
    names = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch):
                made, sequence = _pieces(part, _tokenizer(tokenizer_json), settings, sequence, keep_ids)
                yield made

    return own.mapInArrow(pack, names + (", ids array<int>" if keep_ids else ""))


def sequences(pieces: DataFrame, window: int = Settings.window) -> DataFrame:
    """(sequence_id, n_tokens, padded_length, ids) of pieces with ids; a sequence holds ``window`` ids at most."""
    full = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    power = F.expr("n_tokens & (n_tokens - 1)") == 0
    return full.select("sequence_id", "n_tokens", F.when(power, F.col("n_tokens")).otherwise(window).alias("padded_length"), F.flatten("_p.ids").alias("ids"))
