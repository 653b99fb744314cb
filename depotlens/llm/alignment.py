"""Alignment of two tokenizers' tokens over the bytes of each document.

A byte-level tokenizer (A) and a sentencepiece model (B) encode the same bytes, a blank and the text.  Within a
batch, ``merge_asof`` keyed by document finds for each token start the other side's covering token; both
directions together are the overlapping pairs.  Pairs with equal ends cut a document into groups and are its links.

Two tokens that end together are suffixes one of the other, so the vocabularies alone bound the id pairs that can
ever be linked (``linkable``): the corpus-wide counts fit a table of that size, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlens.llm import chunks
from depotlens.llm.text import only, slices
from depotlens.session import materialise

SLICE_BYTES = 4_000_000


@lru_cache(1)
def byte_letters() -> dict[str, int]:
    """Byte of each letter of a byte-level vocabulary: bytes that print stand for themselves, the others for letters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@dataclass(frozen=True)
class Tokenizers:
    """Both files' contents; ``a`` is the text of a byte-level tokenizer's file, ``b`` the bytes of a sentencepiece model."""

    a: str
    b: bytes

    @classmethod
    def read(cls, a_path: str, b_path: str) -> Tokenizers:
        with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
            return cls(a.read(), b.read())

    @cached_property
    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        from tokenizers import Tokenizer

        found = Tokenizer.from_str(self.a)
        found.encode_special_tokens = True  # their strings in a text are ordinary text
        return found

    @cached_property
    def model(self):
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_proto=self.b)

    @cached_property
    def a_bytes(self) -> list[bytes]:
        """By id; empty for special tokens, which no text gives."""
        letters, vocab = byte_letters(), self.tokenizer.get_vocab(with_added_tokens=False)
        found = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            if all(c in letters for c in token):
                found[k] = bytes(letters[c] for c in token)
        return found

    @cached_property
    def b_bytes(self) -> list[bytes]:
        """By id; empty for control and unknown pieces."""
        m, found = self.model, []
        for k in range(m.get_piece_size()):
            piece = m.id_to_piece(k)
            plain = b"" if m.is_control(k) or m.is_unknown(k) else piece.replace("▁", " ").encode()
            found.append(bytes([int(piece[3:5], 16)]) if m.is_byte(k) else plain)
        return found

    @cached_property
    def a_lengths(self) -> np.ndarray:
        return np.fromiter(map(len, self.a_bytes), np.int64, len(self.a_bytes))

    @cached_property
    def b_lengths(self) -> np.ndarray:
        return np.fromiter(map(len, self.b_bytes), np.int64, len(self.b_bytes))

    def _tokens(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(A's ids, B's ids) of each blank-led text."""
        own = [t.decode() for t in texts]
        b = self.model.encode([t.removeprefix(" ") for t in own], num_threads=1)  # the model adds a space
        lone = self.model.piece_to_id("▁")
        for t, x, y in zip(own, self.tokenizer.encode_batch(own, add_special_tokens=False), b, strict=True):
            if t == " ":  # nothing is left, to which the model adds nothing
                y = [lone]
            added = 0 if t[:1] == " " else 1 if y[:1] == [lone] else len(y)
            yield np.array(x.ids, np.int64), np.array(y[added:], np.int64)

    def _side(self, ids: np.ndarray, lengths: np.ndarray, of: list[bytes], ends: np.ndarray, text: bytes) -> np.ndarray | None:
        """Tokens of each piece of a text, if the ids give the text again and some token ends where each piece does."""
        places = np.cumsum(lengths[ids])
        cuts = np.searchsorted(places, ends)
        if len(ids) and places[-1] == ends[-1] and (places[cuts] == ends).all() and b"".join([of[i] for i in ids.tolist()]) == text:
            return np.diff(cuts, prepend=-1)
        return None

    def encode(self, pieces: list[bytes], together: int = 500) -> Coded:
        """Both sides' ids of the distinct pieces of ``blank_led``; some hundred that don't end with a blank are one text, as they can't see each other."""
        alone = np.fromiter((p.decode()[-1].isspace() for p in pieces), bool, len(pieces))
        rest = np.flatnonzero(~alone)
        groups = [rest[k:k + together] for k in range(0, len(rest), together)] + [np.array([k]) for k in np.flatnonzero(alone)]
        order, found, same = [np.zeros(0, np.int64)], [], np.ones(len(pieces), bool)
        while groups:
            own = [[pieces[k] for k in g.tolist()] for g in groups]
            again = []
            for g, parts, (a, b) in zip(groups, own, self._tokens([b"".join(p) for p in own]), strict=True):
                ends, text = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))), b"".join(parts)
                a_sizes = self._side(a, self.a_lengths, self.a_bytes, ends, text)
                b_sizes = self._side(b, self.b_lengths, self.b_bytes, ends, text)
                if a_sizes is None or b_sizes is None:
                    if len(g) > 1:
                        again += [g[k:k + 1] for k in range(len(g))]
                        continue
                    same[g], a, b, a_sizes, b_sizes = False, a[:0], b[:0], np.zeros(1, np.int64), np.zeros(1, np.int64)
                order.append(g)
                found.append((a, a_sizes, b, b_sizes))
            groups = again
        rank = np.empty(len(pieces), np.int64)
        rank[np.concatenate(order)] = np.arange(len(pieces))
        a, a_sizes, b, b_sizes = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in range(4))
        return Coded(rank, same, a, np.concatenate([[0], np.cumsum(a_sizes)]), b, np.concatenate([[0], np.cumsum(b_sizes)]))


@dataclass
class Coded:
    """Ids of distinct pieces: those of piece k stand in run ``rank[k]`` of each side, bounded by ``a_at`` and ``b_at``; none where a side doesn't give its bytes again."""

    rank: np.ndarray
    same: np.ndarray
    a: np.ndarray
    a_at: np.ndarray
    b: np.ndarray
    b_at: np.ndarray


@lru_cache(1)
def _kept(a: str, b: bytes) -> Tokenizers:
    """One per worker."""
    return Tokenizers(a, b)


def linkable(tok: Tokenizers) -> np.ndarray:
    """Ascending keys (A's id x B's size + B's id) of all pairs of which one's bytes end with the other's: those that may be linked."""
    a_of, b_of = tok.a_bytes, tok.b_bytes
    ends: list[tuple[int, int]] = []

    def suffixes(longer: list[bytes], shorter: list[bytes], proper: int):
        by_bytes: dict[bytes, list[int]] = {}
        for k, s in enumerate(shorter):
            by_bytes.setdefault(s, []).append(k)
        by_bytes.pop(b"", None)
        for k, s in enumerate(longer):
            for cut in range(proper, len(s)):
                yield from ((k, other) for other in by_bytes.get(s[cut:], ()))

    ends.extend(suffixes(a_of, b_of, 0))
    ends.extend((a, b) for b, a in suffixes(b_of, a_of, 1))
    pairs = np.array(ends, np.int64).reshape(-1, 2)
    return np.unique(pairs[:, 0] * len(b_of) + pairs[:, 1])


def overlaps(a_start: np.ndarray, a_doc: np.ndarray, b_start: np.ndarray, b_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of overlapping tokens of both sides; starts ascend over all documents, each of which both sides cover whole."""
    a = pd.DataFrame({"at": a_start, "doc": a_doc, "a": np.arange(len(a_start))})
    b = pd.DataFrame({"at": b_start, "doc": b_doc, "b": np.arange(len(b_start))})
    covering_b = pd.merge_asof(a, b, on="at", by="doc")["b"].to_numpy()
    covering_a = pd.merge_asof(b, a, on="at", by="doc")["a"].to_numpy()
    later = a_start[covering_a] < b_start if len(b) else np.zeros(0, bool)  # equal starts are in the first direction already
    return np.concatenate([a["a"].to_numpy(), covering_a[later]]), np.concatenate([covering_b, b["b"].to_numpy()[later]])


class Aligned:
    """Tokens, overlaps, links and groups of some texts, those of document k in place k."""

    def __init__(self, texts: pa.Array, tok: Tokenizers):
        n = len(texts)
        plain = pc.fill_null(texts, "")
        filled = pc.not_equal(plain, "").to_numpy(zero_copy_only=False)
        spaced = pc.if_else(pa.array(filled), pc.binary_join_element_wise(pa.scalar("", plain.type), plain, pa.scalar(" ", plain.type)), plain)
        cut = chunks.blank_led(spaced)
        coded = tok.encode(cut.pieces)
        owner = np.repeat(np.arange(n), np.diff(cut.starts))
        good = filled.copy()
        good[owner[~coded.same[cut.ids]]] = False
        runs, owner = coded.rank[cut.ids[good[owner]]], owner[good[owner]]
        self.a, self.a_doc, a_end = self._side(coded.a, coded.a_at, tok.a_lengths, runs, owner)
        self.b, self.b_doc, b_end = self._side(coded.b, coded.b_at, tok.b_lengths, runs, owner)
        one, other = overlaps(np.concatenate([[0], a_end[:-1]])[:len(a_end)], self.a_doc, np.concatenate([[0], b_end[:-1]])[:len(b_end)], self.b_doc)
        self.n_a, self.n_b, self.n_overlaps = (np.bincount(d, minlength=n) for d in (self.a_doc, self.b_doc, self.a_doc[one]))
        together = a_end[one] == b_end[other]
        order = np.argsort(one[together], kind="stable")
        self.link_a, self.link_b = one[together][order], other[together][order]  # last tokens of each group
        self.link_doc = self.a_doc[self.link_a]
        self.n_groups = np.bincount(self.link_doc, minlength=n)

    @staticmethod
    def _side(ids: np.ndarray, at: np.ndarray, lengths: np.ndarray, runs: np.ndarray, owner: np.ndarray):
        """(ids of the tokens, their documents, where they end in the bytes of all documents)."""
        tokens = ids[chunks.spans_in(runs, at)]
        return tokens, np.repeat(owner, at[runs + 1] - at[runs]), np.cumsum(lengths[tokens])

    def digests(self, names: pa.Array, size: int) -> list[str]:
        """SHA-256 of each document's groups as ``a1,a2|b1;a3|b2,b3``; empty without tokens.  ``names`` are by (separator, id)."""
        a_group = np.zeros(len(self.a), np.int64)
        a_group[self.link_a[:-1] + 1] = 1
        b_group = np.zeros(len(self.b), np.int64)
        b_group[self.link_b[:-1] + 1] = 1
        a_group, b_group = np.cumsum(a_group), np.cumsum(b_group)
        shown = np.zeros(len(self.a) + len(self.b), np.int64)
        a_mark, b_mark = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        a_mark[self.link_a], b_mark[self.link_b] = 1, 2
        before = np.concatenate([[0], self.link_b + 1])  # tokens of B in the groups before
        shown[np.arange(len(self.a)) + before[a_group]] = self.a + a_mark * size
        shown[np.arange(len(self.b)) + self.link_a[b_group] + 1] = self.b + b_mark * size
        _, at, data = names.take(pa.array(shown)).buffers()
        tokens = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])
        at = np.frombuffer(at, np.int64)[tokens] if len(shown) else tokens
        whole = memoryview(data) if data is not None else b""
        return [hashlib.sha256(whole[p:q - 1]).hexdigest() if q > p else "" for p, q in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def pairs(self, keys: np.ndarray, b_size: int) -> tuple[pa.Array, pa.Array]:
        """Per document, the linked pairs as places in ``keys``, and how often each is linked."""
        place = np.searchsorted(keys, self.a[self.link_a] * b_size + self.b[self.link_b])
        both, times = np.unique(self.link_doc * len(keys) + place, return_counts=True)
        at = pa.array(np.searchsorted(both, np.arange(len(self.n_groups) + 1) * len(keys)), pa.int32())
        return tuple(pa.ListArray.from_arrays(at, pa.array(v.astype(np.int32))) for v in (both % len(keys), times))


def names_of(size: int) -> pa.Array:
    """Decimal ids with what follows them: a comma, the end of A's side, the end of a group."""
    return pa.array([f"{k}{mark}" for mark in ",|;" for k in range(size)], pa.large_string())


def linked(docs: DataFrame, tok: Tokenizers, keys: np.ndarray) -> DataFrame:
    """(doc_id, n_a, n_b, n_overlaps, n_groups, groups_sha256, pairs, times): each document aligned alone; ``pairs`` are places in ``keys``."""
    own = only(docs, doc_id="doc_id", text="text")
    kind = own.schema["doc_id"].dataType.simpleString()
    a_text, b_proto = tok.a, tok.b

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = _kept(a_text, b_proto)
        size = max(len(here.a_bytes), len(here.b_bytes))
        names = names_of(size)
        for batch in batches:
            for part in slices(batch, most=SLICE_BYTES):
                found = Aligned(part.column("text"), here)
                pairs, times = found.pairs(keys, len(here.b_bytes))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_a": found.n_a, "n_b": found.n_b, "n_overlaps": found.n_overlaps, "n_groups": found.n_groups,
                    "groups_sha256": pa.array(found.digests(names, size), pa.string()), "pairs": pairs, "times": times})

    return own.mapInArrow(align, f"doc_id {kind}, n_a long, n_b long, n_overlaps long, n_groups long, groups_sha256 string, pairs array<int>, times array<int>")


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n): how many links corpus-wide hold each pair."""
    return found.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").cast("long").alias("n"))


def aligned(docs: DataFrame, tok: Tokenizers) -> DataFrame:
    """One row per document: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps).

    ``n_best`` counts the links whose pair is linked as often as any pair of the same B id, ties included, and
    ``count_sum`` adds up the counts of the document's links.  Documents are aligned and written once; the counts,
    bounded by the vocabularies, then go to every task.  Null and empty texts, and those whose bytes a side doesn't
    give again, have no tokens: zeros and an empty digest.  A null id stays null, repeated rows count each, a long text
    is one row of a slice of its own, an empty table gives no rows; other columns of ``docs`` aren't read.
    """
    keys = linkable(tok)
    b_size = len(tok.b_bytes)
    found = materialise(linked(docs, tok, keys), "aligned")
    rows = pair_counts(found).toArrow()  # at most len(keys) rows
    counts = np.zeros(len(keys), np.int64)
    counts[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    most = np.zeros(b_size, np.int64)
    np.maximum.at(most, keys % b_size, counts)
    best = counts == most[keys % b_size]

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times = (batch.column(c).flatten().to_numpy() for c in ("pairs", "times"))
            at = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("pairs")).to_numpy())])

            def total(v):
                run = np.concatenate([[0], np.cumsum(v)])
                return run[at[1:]] - run[at[:-1]]

            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")), *(pa.array(total(v), pa.int64()) for v in (times, times * best[pairs], times * counts[pairs])),
                 batch.column("groups_sha256"), batch.column("n_overlaps")], schema=pa.schema([pa.field(n, t) for n, t in zip(OUT, [batch.column("doc_id").type, *[pa.int64()] * 6, pa.string(), pa.int64()], strict=True)]))

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(looked_up, f"doc_id {kind}, " + ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in OUT[1:]))


OUT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps"]
