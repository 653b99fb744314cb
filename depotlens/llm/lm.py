"""Bigram language model in Elias-Fano tries, built and asked shard by shard.

A token's pairs (token, token before) go to the shard of the token.  One shuffle brings a shard both what it learns from and
what it is asked: pages of each block's distinct pairs, with the texts they stand in.  The shard counts its training pairs,
writes them as a trie of quantised smoothed values, maps that into memory, and answers each pair by a search of the token
and a successor search of the one before within the token's range.

Smoothing is Dirichlet's: p(w | v) = (c(vw) + m p(w)) / (c(v) + m), with p(w) by absolute discounting and an open class for
unknown tokens.  Its logarithm falls into a part that the shard of w knows and one that the shard of v knows, so no counts
travel beyond the pages, and shards answer with sums over texts.  Tokens so frequent that a shard would be mostly theirs
(a bounded number) are dealt over all shards by the token before, their counts being sent to all tasks.

Defined cases: NULL text counts as empty, which is one token, the end.  A NULL id learns (it has no remainder 2).  Rows are
told apart by block and place, so repeated and NULL ids keep their rows.  Without training rows the open class has all
probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlens.llm.elias import Trie, mapped
from depotlens.llm.text import U64, Words, distinct, mixed, only, slices, texts_of
from depotlens.session import materialise

# Blanks can't be in a word, so these are no word's hash.
END, BEGIN = (U64(xxhash.xxh3_64_intdigest(c)) for c in ("\n", "\r"))
BLOCK_ROWS = 1 << 16


@dataclass(frozen=True)
class Settings:
    weight: float = 2000.0  # m: occurrences that p(w) counts for
    bits: int = 14  # of a quantised value
    shard_tokens: int = 1_500_000
    least_shards: int = 48
    hot: float = 1 / 2000  # share of all tokens from which on a token is dealt over all shards


@dataclass(frozen=True)
class Totals:
    tokens: int  # N
    kinds: int  # V
    texts: int
    discount: float
    shards: int
    hot: np.ndarray  # sorted hashes
    hot_counts: np.ndarray

    @property
    def unknown(self) -> float:
        return self.discount * self.kinds / self.tokens if self.tokens else 1.0


def token_hashes(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, the hash of each distinct one, and the numbers of all tokens with their texts: each text ends with the end, numbered last."""
    words = Words(pc.ascii_lower(texts))
    hashes = np.append(words.hashes(), END)
    ids = np.insert(words.ids, words.starts[1:], len(words.words))
    return words, hashes, ids, np.repeat(np.arange(len(words.counts)), words.counts + 1)


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c): how often each token stands in the training texts."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                _, hashes, ids, _ = token_hashes(texts_of(part))
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.bincount(ids, minlength=len(hashes)))], ["h", "c"])

    return docs.filter("NOT held").select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter("c > 0")


def totals_of(counts: DataFrame, tokens_at_most: int, s: Settings) -> Totals:
    n, v, once, twice = counts.agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    n = n or 0
    end = counts.filter(F.col("h") == int(END.view(np.int64))).first()
    hot = counts.filter(F.col("c") > max(1.0, n * s.hot)).collect()  # fewer than 1 / s.hot
    hot = sorted((int(np.int64(r.h).view(U64)), r.c) for r in hot)
    discount = min(max(once / (once + 2 * twice), 0.05), 0.95) if once else 0.5
    return Totals(n, v, end.c if end else 0, discount, max(s.least_shards, math.ceil(tokens_at_most / s.shard_tokens)),
                  np.array([h for h, _ in hot], U64), np.array([c for _, c in hot], np.int64))


PAGE = "shard long, block long, ids array<{id}>, held binary, sizes binary, words binary, pairs binary, before binary, places binary, texts binary, times binary"
_EMPTY = pa.scalar(b"", pa.binary())


def pages(docs: DataFrame, t: Totals, shards: int) -> DataFrame:
    """For each block one page with its rows' ids, and one for each shard with the distinct pairs it is asked for and the texts they are in."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow: dict[str, pa.DataType] = {"shard": pa.int64(), "block": pa.int64()}

    def run(batches):
        number = TaskContext.get().partitionId() << 20
        for batch in batches:
            for piece in slices(batch):
                for a in range(0, piece.num_rows, BLOCK_ROWS):
                    yield from block(piece.slice(a, BLOCK_ROWS), number)
                    number += 1

    def block(part: pa.RecordBatch, number: int) -> Iterator[pa.RecordBatch]:
        words, hashes, ids, text = token_hashes(texts_of(part))
        held = part.column("held").to_numpy(zero_copy_only=False).astype(bool)
        rows = [dict.fromkeys(("words", "pairs", "before", "places", "texts", "times"), b"")
                | {"shard": shards + number % shards, "block": number, "ids": part.column("doc_id").to_pylist(), "held": np.packbits(held).tobytes(), "sizes": (words.counts + 1).tobytes()}]
        size = len(hashes)
        first = np.concatenate([[0], np.cumsum(words.counts + 1)])[:-1]
        before = np.concatenate([[size], ids[:-1]])
        before[first] = size  # the begin
        prior = np.append(hashes, BEGIN)
        # Distinct (pair, text) with their number, ordered by pair; then by shard.
        key = ids * (size + 1) + before
        order = np.argsort(key, kind="stable")
        key, text = key[order], text[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(key)))
        key, text = key[at], text[at]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.flatnonzero(new)
        places = np.diff(np.append(start, len(key)))
        word, back = key[start] // (size + 1), key[start] % (size + 1)
        shard = (mixed(hashes) % U64(shards)).astype(np.int64)[word]
        hot = np.isin(hashes, t.hot)[word]
        shard[hot] = (mixed(mixed(prior[back[hot]]) ^ hashes[word[hot]]) % U64(shards)).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[by], np.arange(shards + 1))
        for k in range(shards):
            pick = by[cuts[k]:cuts[k + 1]]
            if not len(pick):
                continue
            own = word[pick]
            change = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            n = places[pick]
            entry = np.repeat(start[pick] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            rows.append({
                "shard": k, "block": number, "ids": [], "held": np.packbits(held).tobytes(), "sizes": b"", "words": hashes[own[change]].tobytes(),
                "pairs": np.diff(np.append(change, len(own))).astype(np.int32).tobytes(), "before": prior[back[pick]].tobytes(),
                "places": n.astype(np.int32).tobytes(), "texts": text[entry].astype(np.uint16).tobytes(), "times": times[entry].astype(np.int32).tobytes()})
        names = ["shard", "block", "ids", "held", "sizes", "words", "pairs", "before", "places", "texts", "times"]
        ids_kind = pa.list_(part.schema.field("doc_id").type)
        kinds = [arrow["shard"], arrow["block"], ids_kind, *[pa.binary()] * 8]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    return docs.mapInArrow(run, PAGE.format(id=kind))


def answered(asked: DataFrame, t: Totals, s: Settings) -> DataFrame:
    """(row, doc_id, held, tokens, known, base, score): sums over the tokens of each text in a shard, and one row of each text with its id."""
    kind = asked.schema["ids"].dataType.elementType.simpleString()
    names = ["row", "doc_id", "held", "tokens", "known", "base", "score"]

    def out(row, ids, held, tokens, known, base, score) -> pa.Table:
        return pa.Table.from_arrays([
            pa.array(row, pa.int64()), ids, held, pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())], names)

    def run(table: pa.Table) -> pa.Table:
        id_kind = table.schema.field("ids").type.value_type
        if table.column("shard")[0].as_py() >= t.shards:
            parts = []
            for page in table.to_pylist():
                n = len(page["ids"])
                held = np.unpackbits(np.frombuffer(page["held"], np.uint8))[:n].astype(bool)
                sizes = np.frombuffer(page["sizes"], np.int64)
                first = -math.log10(t.texts + s.weight)  # what the begin, as a context, divides by
                parts.append(out((page["block"] << 16) + np.arange(n), pa.array(page["ids"], id_kind), pa.array(held), sizes, np.zeros(n), np.zeros(n), np.full(n, first)))
            return pa.concat_tables(parts)
        return shard_answers(table, t, s, lambda row, *sums: out(row, pa.nulls(len(row), id_kind), pa.nulls(len(row), pa.bool_()), np.zeros(len(row)), *sums))

    return asked.groupBy("shard").applyInArrow(run, f"row long, doc_id {kind}, held boolean, tokens long, known long, base double, score double")


def shard_answers(table: pa.Table, t: Totals, s: Settings, out) -> pa.Table:
    read = lambda name, kind: [np.frombuffer(b.as_py(), kind) for b in table.column(name)]
    blocks, held = table.column("block").to_numpy(), [np.unpackbits(b) for b in read("held", np.uint8)]
    words, pairs, before = read("words", U64), read("pairs", np.int32), read("before", U64)
    places, texts, times = read("places", np.int32), read("texts", np.uint16), read("times", np.int32)
    # Of each distinct pair of a page: its training count there.
    learned = [np.add.reduceat(np.where(h[x] == 0, m, 0), np.cumsum(p) - p) for h, x, m, p in zip(held, texts, times, places, strict=True)]
    word = np.concatenate([np.repeat(w, n)[c > 0] for w, n, c in zip(words, pairs, learned, strict=True)])
    prior = np.concatenate([v[c > 0] for v, c in zip(before, learned, strict=True)])
    count = np.concatenate([c[c > 0] for c in learned]).astype(np.int64)
    names = distinct(np.concatenate([word, prior]))
    # Counts of the pairs and words that were learned.
    key = np.searchsorted(names, word) * max(len(names), 1) + np.searchsorted(names, prior)
    order = np.argsort(key, kind="stable")
    key, own = key[order], count[order]
    del word, prior, count, order
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    both = np.add.reduceat(own, start) if len(start) else np.zeros(0, np.int64)
    heads, of = np.unique(key[start] // max(len(names), 1), return_inverse=True)
    total = np.bincount(of, both, len(heads)).astype(np.int64)
    if len(t.hot):
        place = np.minimum(np.searchsorted(t.hot, names[heads]), len(t.hot) - 1)
        total = np.where(t.hot[place] == names[heads], t.hot_counts[place], total)
    share = (total - t.discount) / max(t.tokens, 1)
    trie = mapped(lambda file: Trie.write(
        file, names, heads, key[start] % max(len(names), 1), of, np.log10(s.weight * share), np.log10(both + s.weight * share[of]), {"count": total}, s.bits))
    # The pages ask, one after another.
    parts = []
    for block, w, n, v, place, text, time in zip(blocks, words, pairs, before, places, texts, times, strict=True):
        head = trie.heads_of(w)
        known = head >= 0
        c, value = np.zeros(len(w)), np.full(len(w), math.log10(s.weight * t.unknown))
        c[known], value[known] = trie.arrays["count"][head[known]], trie.value("head", head[known])
        if len(t.hot):  # a hot token that was learned in other shards only
            at = np.minimum(np.searchsorted(t.hot, w), len(t.hot) - 1)
            hot = (t.hot[at] == w) & ~known
            c[hot] = t.hot_counts[at[hot]]
            value[hot] = np.log10(s.weight * (c[hot] - t.discount) / t.tokens)
        of = np.repeat(np.arange(len(w)), n)
        tail = trie.find(head[of], v)
        score = np.where(tail >= 0, trie.value("tail", np.maximum(tail, 0)) if trie.tails.n else 0.0, value[of])
        score -= np.where(w == END, 0.0, np.log10(c + s.weight))[of]
        size = int(text.max()) + 1
        each = np.repeat(np.arange(len(v)), place)
        known_, base_, score_ = (np.bincount(text, x[each] * time, size) for x in ((c > 0)[of], np.log10(c + 1)[of], score))
        told = np.flatnonzero(np.bincount(text, minlength=size))
        parts.append(out((int(block) << 16) + told, known_[told], base_[told], score_[told]))
    return pa.concat_tables(parts)


def scores(docs: DataFrame, held_out, s: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; rows where ``held_out`` holds are not learned from."""
    rows = only(docs, doc_id="doc_id", text="text").withColumn("held", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    counts = materialise(word_counts(rows), "lm-counts")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    t = totals_of(counts, chars // 6, s)
    sums = answered(pages(rows, t, t.shards), t, s).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held").alias("held_out"), F.sum("tokens").alias("n_tokens"), F.sum("known").alias("n_known"),
        F.sum("base").alias("base"), F.sum("score").alias("score"))
    return sums.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(t.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * math.log10(t.tokens + t.kinds + 1)).alias("base_score"), "score")
