import hashlib
import os

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from depotlens.llm import bpe

TEXTS = ["", None, " ", "the of and", "Eauouon.\nEnpaeux leaux  le ouè\n\n eauenaux!!", "a" * 700, "\x1c\x1d x\x1f y z", "日本語のテキスト 🙂🙂",
         "don't we'll THEY'VE 123456 +1 (743) 555-3824", "\t\t  \n  x", "ab" * 4000, "é" * 30, "<|endoftext|> plain", " " * 500]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 4 else None, t, "x", [1]) for i, t in enumerate(TEXTS + TEXTS[:3])]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, words array<int>")


@pytest.mark.parametrize("most", [64, 3])
def test_ids_and_round_trip(spark, docs, ranks, library, most):
    tokens = bpe.encoded(docs, ranks, public_tokenizers.PATTERN, s=bpe.Settings(fold_bytes=most))
    got = sorted((str(r.doc_id), tuple(r.ids), bytes(r.bytes)) for r in bpe.decoded(tokens, ranks).collect())
    want = sorted((str(r.doc_id), tuple(library.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in docs.collect())
    assert got == want


def test_digests(spark, docs, ranks, library):
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, ranks, public_tokenizers.PATTERN).collect())
    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((str(r.doc_id), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_empty_table(spark, ranks):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(docs, ranks, public_tokenizers.PATTERN).count() == 0


def test_heap_merges_random_bytes(ranks, library):
    for n in (1, 2, 30, 500):
        word = os.urandom(n)
        assert bpe.merged_by_heap(word, ranks) == library._encode_single_piece(word)


@pytest.mark.parametrize("first", [0, 63_200, 120_000])
def test_ranks_of_large_vocabularies(spark, first):
    """Ranks on both sides of every sign that is left out, and over 100,000: the same merges as the heap's."""
    ranks = {bytes([b]): b for b in range(256)} | {p: first + 300 + k for k, p in enumerate((b"ab", b"cd", b"abcd", b"abcdx", b"xy", b"yz", b"xyz") + tuple(bytes([97 + k // 9, 110 + k % 9]) for k in range(60)))}
    docs = spark.createDataFrame([(1, "abcdx xyz abcdxyz anbocp")], "doc_id long, text string")
    got = bpe.encoded(docs, ranks, public_tokenizers.PATTERN).first().ids
    assert got == [i for w in bpe.compiled(public_tokenizers.PATTERN).findall("abcdx xyz abcdxyz anbocp") for i in bpe.merged_by_heap(w.encode(), ranks)]


def test_pairs_of_bytes_come_with_the_words(spark, ranks):
    """A word not merged yet brings what its neighbouring bytes merge to, so that the fold looks up new pairs only; a merged one brings none."""
    docs = spark.createDataFrame([(1, "the \u00e9zqvx the"), (2, None), (3, "x" * 100)], "id long, text string").coalesce(1)
    rows = bpe.blocks(docs, ranks, public_tokenizers.PATTERN, bpe.Settings()).collect()
    got = {w: p for r in rows for w, p in zip(r.words, r.pairs, strict=True)}

    def signs(ids):
        return "".join(map(bpe.sign, ids))

    def pair(a, b):
        return bpe.sign(ranks[bytes([a, b])]) if bytes([a, b]) in ranks else bpe.END

    word = " \u00e9zqvx".encode()
    assert got == {
        signs([ranks[b"the"]]): "", signs([ranks[b" the"]]): "", signs(bpe.merged_by_heap(b"x" * 100, ranks)): "",
        signs(ranks[bytes([b])] for b in word): "".join(map(pair, word, word[1:]))}
    assert [c for r in rows for c in np.frombuffer(r.counts, np.int64)] == [3, 0, 1]
