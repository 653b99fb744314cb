"""Secrets: wide candidates, and a random forest that removes false findings.

Candidates are runs of at least 16 key characters, and values of at least 8 characters of any kind given to a name of a secret.  Their features are length, make-up, how usual their character transitions are in
the corpus, how much of them its words cover, the path, and the words beside them.  The transitions and the dictionary count
every document; the forest is fitted on a bounded sample of labelled findings and judges every candidate.

Defined cases: NULL text counts as empty and has no candidates.  Offsets are code points, the end exclusive.  Without labelled
findings of both kinds each score is the share of label 1 (0 without findings).  Repeated rows give repeated findings.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.llm.text import Words, only, plain, slices, texts_of
from depotlens.session import materialise

_RUN = r"[A-Za-z0-9+/_=-]{16,}"
_CANDIDATE = re.compile(_RUN)
_NAME = "(?i:token|secret|password|passwd|api_?key)"
_ASSIGNED = _NAME + r"""["']?\s*[=:]\s*(?:"([^"\s]{8,})"|'([^'\s]{8,})'|([^\s"']{8,}))"""
_VALUE = re.compile(_ASSIGNED)
_SIGNS = b"abcdefghijklmnopqrstuvwxyz0123456789"


@dataclass(frozen=True)
class Settings:
    sample: int = 20_000  # labelled findings the forest is fitted on, at most
    trees: int = 30
    depth: int = 8
    word_buckets: int = 32
    path_buckets: int = 8
    least_uses: int = 3  # of a dictionary word


def _classes() -> np.ndarray:
    """By byte: place among the signs, letters in lower case; the last for all others."""
    out = np.full(256, len(_SIGNS), np.int64)
    for k, c in enumerate(_SIGNS):
        out[c] = out[ord(chr(c).upper())] = k
    return out


CLASSES = _classes()
KINDS = len(_SIGNS) + 1


def transitions(docs: DataFrame) -> np.ndarray:
    """log2 share of each sign after each other, over all documents."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                own = CLASSES[np.frombuffer("\n".join(texts_of(part).to_pylist()).encode(), np.uint8)]
                n = np.bincount(own[:-1] * KINDS + own[1:], minlength=KINDS * KINDS)
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["pair", "n"])

    table = np.ones(KINDS * KINDS)
    for r in docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # KINDS squared at most
        table[r.pair] += r.n
    table = table.reshape(KINDS, KINDS)
    return np.log2(table / table.sum(1, keepdims=True))


def dictionary(docs: DataFrame, s: Settings) -> DataFrame:
    """(word) of at least three letters that the documents use often enough."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                words = Words(plain(texts_of(part)))
                n = np.bincount(words.ids, minlength=len(words.words))
                keep = pc.match_substring_regex(pa.array(words.words, pa.string()), "^[a-z]{3,}$").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(words.words, pa.string()).filter(pa.array(keep)), pa.array(n[keep.astype(bool)])], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= s.least_uses).select("word")


def candidate_spans(text: str) -> list[tuple[int, int]]:
    """Runs that hold a digit or a change of case, or are given a name with = or :, and the values given to names of secrets."""
    out = set()
    for m in _CANDIDATE.finditer(text):
        own = m.group()
        if re.search(r"[0-9]|[a-z][A-Z]|^[A-Z0-9_+/=-]+$", own) or re.search(r"[=:]\s*[\"']?$", text[max(0, m.start() - 4):m.start()]):
            out.add(m.span())
    for m in _VALUE.finditer(text):
        a, b = m.span(m.lastindex)
        b = b if m.lastindex < 3 else a + len(m.group(3).rstrip(",;"))  # bare values end before the sign that follows them
        if b - a >= 8:
            out.add((a, b))
    return sorted(out)


def shape(own: str, before: str, after: str, path: str, usual: np.ndarray, s: Settings) -> list[float]:
    codes = CLASSES[np.frombuffer(own.encode(), np.uint8)]
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "p" for c in own]
    counts = np.bincount(codes, minlength=KINDS)
    share = counts[counts > 0] / len(codes)
    words = [0.0] * s.word_buckets
    for w in re.findall(r"\w+", before.lower())[-3:] + re.findall(r"\w+", after.lower())[:1]:
        words[xxhash.xxh3_64_intdigest(w) % s.word_buckets] += 1
    paths = [0.0] * s.path_buckets
    paths[xxhash.xxh3_64_intdigest(path) % s.path_buckets] = 1
    return [
        float(len(own)), *(kinds.count(k) / len(own) for k in "dulp"), sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / len(own),
        float(-(share * np.log2(share)).sum()), float(usual[codes[:-1], codes[1:]].mean()), float(bool(re.fullmatch("[0-9a-f]+", own))),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(before[-1:] in "\"'" and bool(before)), float(after[:1] in "\"'" and bool(after)), *words, *paths]


def candidates(docs: DataFrame, usual: np.ndarray, s: Settings) -> DataFrame:
    """(id, doc_id, start, end, value, before, runs, x) of each candidate; docs: (doc_id, path, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["id", "doc_id", "start", "end", "value", "before", "runs", "x"]

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch):
                texts = texts_of(part)
                able = np.flatnonzero(pc.match_substring_regex(texts, f"{_RUN}|{_ASSIGNED}").to_numpy(zero_copy_only=False))
                paths, rows, at = part.column("path").to_pylist(), [], []
                for k in able:
                    text = texts[int(k)].as_py()
                    for a, b in candidate_spans(text):
                        own, before = text[a:b], text[max(0, a - 60):a]
                        rows.append((number, a, b, own, before, re.findall("[a-z]{3,}", own.lower()), shape(own, before, text[b:b + 30], paths[k] or "", usual, s)))
                        at.append(k)
                        number += 1
                if rows:
                    own = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                        pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.float64())), strict=True)]
                    yield pa.RecordBatch.from_arrays([own[0], part.column("doc_id").take(pa.array(at)), *own[1:]], names)

    return docs.mapInArrow(run, f"id long, doc_id {kind}, start long, end long, value string, before string, runs array<string>, x array<double>")


def with_coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """Adds to x the share of a candidate's characters that are words of the dictionary."""
    runs = found.select("id", F.explode("runs").alias("word"))
    covered = runs.join(words, "word").groupBy("id").agg(F.sum(F.length("word")).alias("covered"))
    return found.join(covered, "id", "left").withColumn("x", F.concat("x", F.array(F.coalesce(F.col("covered") / F.length("value"), F.lit(0.0))))).drop("covered", "runs")


def known_format(value: Column, before: Column) -> Column:
    """Labels of findings whose kind is beyond doubt: 1 for issued keys and for hex digests given the name of a secret, 0 for words and bare numbers without one; else NULL."""
    named = before.rlike(_NAME + r"[\"']?\s*[=:]\s*[\"']?$")
    issued = value.rlike(r"^(AKIA|ASIA)[A-Z0-9]{16}$") | value.rlike(r"^gh[pousr]_[A-Za-z0-9]{36}$")
    return F.when(issued | named & value.rlike(r"^[0-9a-f]{32,64}$"), 1).when(~named & (value.rlike(r"^[0-9]+$") | ~value.rlike(r"[0-9]")), 0)


def judged(found: DataFrame, label: Column, s: Settings = Settings()) -> DataFrame:
    """The candidates with ``score``: the forest's share of label 1."""
    own = found.withColumn("label", label.cast("double"))
    once = own.filter("label IS NOT NULL").groupBy("value", "before").agg(F.min("label").alias("label"), F.min("x").alias("x"))  # copies count once
    sample = materialise(once.orderBy(F.xxhash64("value", "before"), "value", "before").limit(s.sample).select("label", array_to_vector("x").alias("features")), "secret-sample")
    n = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(n) < 2:
        return own.withColumn("score", F.lit(float(1.0 in n)))
    forest = RandomForestClassifier(numTrees=s.trees, maxDepth=s.depth, seed=5, minInstancesPerNode=2).fit(sample)
    scored = forest.transform(own.withColumn("features", array_to_vector("x")))
    return scored.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def findings(docs: DataFrame, path: str = "source", s: Settings = Settings()) -> DataFrame:
    """(doc_id, start, end, length, value_sha256, label, score, is_secret) of every candidate in every document."""
    rows = only(docs, doc_id="doc_id", path=path, text="text")
    found = materialise(candidates(rows, transitions(rows), s), "secret-candidates")
    own = judged(materialise(with_coverage(found, dictionary(rows, s)), "secret-features"), known_format(F.col("value"), F.col("before")), s)
    return own.select("doc_id", "start", "end", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), F.col("label").cast("int"), "score", (F.col("score") >= 0.5).alias("is_secret"))
