"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms: words and their first four and five letters.  Terms that tell the
labels apart are picked on the labelled sample; the machine gives each a weight and a short vector, and
the products of vectors score pairs (an insult beside a group's name) that single weights miss.

Defined cases: NULL text counts as empty and gets the score of the constant alone; without labels of
both kinds every score is the share of label 1 (0 without labels); rows are never joined by id after
scoring, so repeated or NULL ids keep their rows; a labelled id with several labels has the largest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from depotlens.llm.text import Words, crc_of, distinct, given_back, hash_words, only, plain, slices, texts_of


SLICE_BYTES = 6_000_000


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 20_000  # labelled rows the model is fitted on, at most
    buckets: int = 1 << 18  # of the hashed terms
    terms: int = 4096  # terms kept, those that tell most
    factors: int = 8
    epochs: int = 30
    rate: float = 0.1
    decay: float = 2e-4
    least_docs: int = 3  # documents that hold a kept term


@dataclass(frozen=True)
class Machine:
    constant: float
    place: np.ndarray  # by bucket: index of the term, or -1
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """Scores of n texts from their distinct (text, term) pairs."""
        return 1 / (1 + np.exp(-np.clip(raw(self.constant, self.weights, self.vectors, rows, terms, n), -30, 30)))


def raw(constant, weights, vectors, rows, terms, n):
    sums = np.zeros((n, vectors.shape[1]))
    squares = np.zeros(n)
    np.add.at(sums, rows, vectors[terms])
    np.add.at(squares, rows, (vectors[terms] ** 2).sum(1))
    return constant + np.bincount(rows, weights[terms], n) + 0.5 * ((sums ** 2).sum(1) - squares)


def term_pairs(texts: pa.Array, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, place) pairs of the terms that ``place`` keeps."""
    words = Words(plain(texts))
    if not words.words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    of = [place[(hash_words(parts) & np.uint64(len(place) - 1)).astype(np.int64)] for parts in (
        words.words, [f"5{w[:5]}" for w in words.words], [f"4{w[:4]}" for w in words.words])]
    told = ((of[0] >= 0) | (of[1] >= 0) | (of[2] >= 0))[words.ids]
    once = distinct(words.owner()[told] * len(words.words) + words.ids[told])
    text, word = once // len(words.words), once % len(words.words)
    found = [text[index[word] >= 0] * len(place) + index[word][index[word] >= 0] for index in of]
    both = distinct(np.concatenate(found))
    return both // len(place), both % len(place)


def labelled_sample(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """(text, label) of at most ``s.sample_rows`` labelled ids outside the held-out fifth, picked by a hash of the id."""
    known = only(labels, doc_id="doc_id", label="toxic").filter("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.filter(crc_of("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample_rows)
    rows = only(docs, doc_id="doc_id", text="text").join(F.broadcast(picked), "doc_id")  # sample_rows bounds it
    one = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))  # of a repeated id's texts
    return one.select("text", "label")


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Machine:
    sample = labelled_sample(docs, labels, s)
    everything = np.arange(s.buckets, dtype=np.int64)

    def counted(batches):
        for batch in batches:
            for part in slices(batch, most=SLICE_BYTES):
                rows, terms = term_pairs(texts_of(part), everything)
                label = part.column("label").to_numpy(zero_copy_only=False).astype(np.int64)[rows]
                code, n = np.unique(terms * 2 + label, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code // 2), pa.array(code % 2), pa.array(n)], ["term", "label", "n"])
                n = np.bincount(part.column("label").to_numpy(zero_copy_only=False).astype(np.int64), minlength=2)
                yield pa.RecordBatch.from_arrays([pa.array([-1, -1]), pa.array([0, 1]), pa.array(n)], ["term", "label", "n"])

    counts = sample.mapInArrow(counted, "term long, label long, n long").groupBy("term").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("n1"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("n0"))
    totals = counts.filter("term = -1").first()
    place = np.full(s.buckets, -1, np.int64)
    n1, n0 = (totals.n1, totals.n0) if totals else (0, 0)
    if not n1 or not n0:
        share = min(max(n1 / max(n1 + n0, 1), 1e-13), 1 - 1e-13)
        return Machine(float(np.log(share / (1 - share))), place, np.zeros(0), np.zeros((0, s.factors)))
    # Signed root of the likelihood ratio statistic, as a rank: how surely a term's share of label 1 differs from all.
    share = n1 / (n1 + n0)
    expected = (F.col("n1") + F.col("n0")) * share
    told = F.abs(F.col("n1") - expected) / F.sqrt(expected * (1 - share) + 0.5)
    best = counts.filter((F.col("term") >= 0) & (F.col("n1") + F.col("n0") >= s.least_docs)).orderBy(told.desc(), "term").limit(s.terms)
    kept = sorted(r.term for r in best.select("term").collect())
    place[kept] = np.arange(len(kept))

    def rows_of(batches):
        for batch in batches:
            for part in slices(batch):
                rows, terms = term_pairs(texts_of(part), place)
                cuts = np.searchsorted(rows, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(terms.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("label"), lists], ["label", "terms"])

    kinds = dict(sample.dtypes)
    rows = sample.mapInArrow(rows_of, f"label {kinds['label']}, terms array<int>").collect()
    rows.sort(key=lambda r: (r.label, r.terms))  # the fit doesn't depend on the order of arrival
    return fit(rows, place, len(kept), s)


def fit(rows, place: np.ndarray, n_terms: int, s: Settings) -> Machine:
    """Stochastic gradients with a rate per parameter, over rows in a seeded order."""
    rng = np.random.default_rng(11)
    y = np.array([r.label for r in rows], float)
    lists = [np.array(r.terms, np.int64) for r in rows]
    weights, vectors = np.zeros(n_terms), rng.normal(0, 0.02, (n_terms, s.factors))
    constant = float(np.log(y.mean() / (1 - y.mean())))
    gw, gv, gc = np.full(n_terms, 1e-3), np.full(vectors.shape, 1e-3), 1e-3
    for _ in range(s.epochs):
        order = rng.permutation(len(lists))
        for a in range(0, len(order), 256):
            pick = order[a:a + 256]
            own = [lists[i] for i in pick]
            terms = np.concatenate(own)
            at = np.repeat(np.arange(len(pick)), [len(x) for x in own])
            p = 1 / (1 + np.exp(-np.clip(raw(constant, weights, vectors, at, terms, len(pick)), -30, 30)))
            slope = (p - y[pick]) / len(pick)
            sums = np.zeros((len(pick), s.factors))
            np.add.at(sums, at, vectors[terms])
            touched, back = np.unique(terms, return_inverse=True)
            dw = np.bincount(back, slope[at], len(touched)) + s.decay * weights[touched]
            dv = np.zeros((len(touched), s.factors))
            np.add.at(dv, back, slope[at][:, None] * (sums[at] - vectors[terms]))
            dv += s.decay * vectors[touched]
            gw[touched] += dw ** 2
            gv[touched] += dv ** 2
            gc += slope.sum() ** 2
            weights[touched] -= s.rate * dw / np.sqrt(gw[touched])
            vectors[touched] -= 0.2 * s.rate * dv / np.sqrt(gv[touched])
            constant -= s.rate * slope.sum() / np.sqrt(gc)
    return Machine(constant, place, weights, vectors)


def scored(docs: DataFrame, machine: Machine, column: str = "score") -> DataFrame:
    """The rows of ``docs`` (which needs ``text``) with ``column`` added, in place of one of that name."""
    own = docs.drop(column)
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # Settings bounds its size

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=SLICE_BYTES):
                rows, terms = term_pairs(texts_of(part), shared.value.place)
                score = shared.value.score(rows, terms, part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, column])

    return own.mapInArrow(lambda b: given_back(run(b)), StructType([*own.schema.fields, StructField(column, DoubleType())]))


def kept(docs: DataFrame, labels: DataFrame, limit: float = 0.5, s: Settings = Settings()) -> DataFrame:
    """The documents that score below ``limit``, with their own columns."""
    return scored(docs, train(docs, labels, s), "__toxicity").filter(F.col("__toxicity") < limit).drop("__toxicity")
