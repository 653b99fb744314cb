"""Similarity join of texts by the Jaccard index of their word n-grams, with MinHash banding.

Equal texts are one vertex with a number of copies.  Signatures are cut into bands whose number and width
follow from the recall wanted at the threshold; texts that share a band meet through the least text of the
band, so a band of m texts gives m rows and never its pairs.  Texts connected in this way are brought
together once, and all of their pairs are verified on whole n-gram sets: large components block against
block, where a task holds two blocks and counts links without writing pairs out.

Defined cases: NULL text counts as empty.  Equal texts are always copies of each other, empty ones too.  A text
of fewer words than ``n`` has one n-gram, of all its words; without words it has none and links to equal texts
only.  Rows are told apart by nothing but their text, so repeated and NULL ids keep their rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.llm.graph import components
from depotlens.llm.text import U64, Words, distinct, given_back, grams, mixed, odd_numbers, slices, texts_of
from depotlens.session import materialise


SLICE_BYTES = 6_000_000


@dataclass(frozen=True)
class Settings:
    n: int = 5
    threshold: float = 0.8
    recall: float = 0.999  # of pairs at the threshold; more similar pairs are surer
    hashes: int = 96  # at most
    block_texts: int = 512  # of one block of a large component
    block_chars: int = 8_000_000


def bands_for(s: Settings) -> tuple[int, int]:
    """(bands, rows of a band): the widest bands that reach the recall with the hashes allowed."""
    fits = []
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - s.recall) / math.log(1 - s.threshold ** rows)) if s.threshold < 1 else 1
        if bands * rows <= s.hashes:
            fits.append((bands, rows))
    if not fits:
        raise ValueError("the recall can't be reached with so few hashes")
    return fits[-1]


def text_key(text: str | Column) -> Column:
    """128 bits that stand for a text; NULL as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))))


def word_grams(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    return grams(Words(pc.utf8_lower(texts)), n)


def band_hashes(texts: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(text, band) hashes, and the number of n-grams with repeats of each text."""
    bands, rows = bands_for(s)
    hashes, starts = word_grams(texts, s.n)
    sizes = np.diff(starts)
    full = np.flatnonzero(sizes)
    out = np.zeros((len(texts), bands), U64)
    flips, factors = odd_numbers(bands * rows, 17), odd_numbers(bands * rows, 23)
    for band in range(bands if len(full) else 0):
        own = np.full(len(full), band + 1, U64)
        for k in range(band * rows, (band + 1) * rows):
            own = mixed(own + np.minimum.reduceat((hashes ^ flips[k]) * factors[k], starts[full]))
        out[full, band] = own
    return out, sizes


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """(key, copies, bands) of each distinct text; bands is empty for texts without words."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=SLICE_BYTES):
                bands, sizes = band_hashes(texts_of(part), s)
                count = np.where(sizes > 0, bands.shape[1], 0)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(bands[sizes > 0].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("key"), lists], ["key", "bands"])

    own = docs.select(text_key("text").alias("key"), "text").mapInArrow(lambda b: given_back(run(b)), "key binary, bands array<long>")
    return own.groupBy("key").agg(F.count("*").alias("copies"), F.any_value("bands").alias("bands"))


def candidates(texts: DataFrame) -> DataFrame:
    """(key, comp): texts connected through shared bands."""
    rows = texts.select("key", F.explode("bands").alias("h"))
    heads = rows.groupBy("h").agg(F.min("key").alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n")
    edges = rows.join(heads, "h").filter("key <> head").select(F.col("key").alias("a"), F.col("head").alias("b")).distinct()
    return components(edges).select(F.col("a").alias("key"), F.col("label").alias("comp"))


def linked(left: np.ndarray, across: bool, text: np.ndarray, gram: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """n by n: which texts reach the threshold, from distinct (text, gram) pairs; ``across``: only pairs of a left and a right text."""
    sizes = np.bincount(text, minlength=n)
    order = np.argsort(gram, kind="stable")
    gram, text = gram[order], text[order]
    first = np.concatenate([[True], gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, bool)
    place = np.cumsum(first) - 1
    often = np.bincount(place) > 1 if len(place) else np.zeros(0, bool)  # a gram of one text is in no intersection
    keep = often[place]
    place, text = (np.cumsum(often) - 1)[place[keep]], text[keep]
    shared, width, total = np.zeros((n, n), np.float32), 8192, int(often.sum())
    cuts = np.searchsorted(place, np.arange(0, total + width, width))
    for a, b, at in zip(cuts[:-1], cuts[1:], range(0, total + width, width)):
        held = np.zeros((n, min(width, total - at)), np.float32)
        held[text[a:b], place[a:b] - at] = 1
        shared += held @ held.T
    union = sizes[:, None] + sizes[None, :] - shared
    out = shared >= threshold * union * (1 - 1e-9)
    out &= shared > 0
    np.fill_diagonal(out, False)
    if across:
        out &= left[:, None] != left[None, :]
    return out


def heads_of(link: np.ndarray) -> np.ndarray:
    """The least index that each one is connected with."""
    label = np.arange(len(link))
    while True:
        near = np.where(link, label[None, :], len(link)).min(axis=1, initial=len(link))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verified(docs: DataFrame, comps: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """(key, head, links): for each text with links in a block pair, how many documents it links to and a text it is connected with."""
    one = docs.select(text_key("text").alias("key"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["key"])
    rows = comps.join(texts.select("key", "copies"), "key").join(one, "key")
    rows = materialise(rows.withColumn("chars", F.length("text")), "near-texts")
    size = rows.groupBy("comp").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).select("comp", F.ceil(
        F.greatest(F.col("n") / s.block_texts, F.col("chars") / s.block_chars)).cast("int").alias("blocks"))
    groups = max(1, math.ceil(rows.count() / 1000))
    rows = rows.join(size, "comp").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    rows = rows.withColumn("task", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(groups))).otherwise(F.xxhash64("comp", "i", "j")))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        for (_, i, j), own in frame.groupby(["comp", "i", "j"], sort=False):
            own = own.sort_values("key")
            keys, copies = own["key"].to_numpy(), own["copies"].to_numpy()
            hashes, starts = word_grams(pa.array(own["text"], pa.string()), s.n)
            gram_of, gram = np.unique(hashes, return_inverse=True)
            pair = distinct(np.repeat(np.arange(len(own)), np.diff(starts)) * max(len(gram_of), 1) + gram)
            link = linked((own["own"] == i).to_numpy(), i != j, pair // max(len(gram_of), 1), pair % max(len(gram_of), 1), len(own), s.threshold)
            at = np.flatnonzero(link.any(axis=1))
            head = heads_of(link)
            found.append(pd.DataFrame({"key": keys[at], "head": keys[head[at]], "links": (link[at] @ copies).astype(np.int64)}))
        return pd.concat(found) if found else pd.DataFrame({"key": [], "head": [], "links": []})

    chosen = rows.select("task", "comp", "i", "j", "own", "key", "copies", "text")
    return chosen.groupBy("task").applyInPandas(run, "key binary, head binary, links long")


def classes(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(key, copies, links, class) of each distinct text: links counts the other documents it links to, class is the least key of its component."""
    texts = materialise(signatures(docs, s), "near-signatures")
    found = materialise(verified(docs, candidates(texts), texts, s), "near-links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("key").alias("a"), F.col("head").alias("b"))).select(F.col("a").alias("key"), F.col("label").alias("class"))
    return texts.select("key", "copies").join(links, "key", "left").join(labels, "key", "left").select(
        "key", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("class", "key").alias("class"))


def joined(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, class_id, n_links, class_size) of every row: class_id is the least doc_id of its class, NULL if all are NULL."""
    found = materialise(classes(docs, s), "near-classes")
    rows = docs.select("doc_id", text_key("text").alias("key")).join(found, "key")
    ids = rows.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return rows.join(ids, "class").select("doc_id", "class_id", F.col("links").alias("n_links"), "class_size")


def kept(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row of each class, with its own columns: that of the least doc_id (NULL last; among rows of one id by key and hash)."""
    found = materialise(classes(docs, s), "near-classes").select(F.col("key").alias("__key"), F.col("class").alias("__class"))
    hashed = [f.name for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__hash"))
    named = docs.withColumns({"__key": text_key("text"), "__hash": F.xxhash64(*hashed)})
    # Rows are chosen by key, id and hash alone; their texts come by a semi-join that sorts none of them.
    narrow = named.groupBy("__key").agg(F.min(order).alias("__order"), F.min_by("__hash", order).alias("__hash")).join(found, "__key")
    first = narrow.groupBy("__class").agg(F.min(F.struct("__order", "__key", "__hash")).alias("f")).select("f.__key", "f.__hash")
    first = materialise(first, "near-first")
    same = ["__key", "__hash"]
    alike = named.select(*same).join(first, same, "left_semi").groupBy(*same).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    alike = materialise(alike, "near-alike")  # rows that others equal in all columns: one of them stays
    one = named.join(first.hint("shuffle_hash"), same, "left_semi").join(alike, same, "left_anti")
    again = named.join(alike, same, "left_semi").groupBy(*same).agg(F.any_value(F.struct(*docs.columns)).alias("__row"))
    return one.select(*docs.columns).unionByName(again.select("__row.*"))
