import math
import random

import public_tokenizers
import pytest

from depotlens.llm import bpe, token_counts


def brute(word, model):
    best = [(0.0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        ways = []
        for start in range(end):
            score = model.scores.get(word[start:end], token_counts.UNKNOWN if end - start == 1 else None)
            if score is not None:
                ways.append((best[start][0] + score, best[start][1] - 1))
        best[end] = max(ways)
    return -best[-1][1], best[-1][0]


def test_trie_agrees_with_each_word_alone():
    rng = random.Random(2)
    ranks = {bytes([c]): i for i, c in enumerate(b"abcd")}
    for i in range(60):
        ranks.setdefault(bytes(rng.choice(b"abcde") for _ in range(rng.randint(2, 5))), 10 + i)
    model = token_counts.Unigram.of(ranks)
    words = [bytes(rng.choice(b"abcdef") for _ in range(rng.randint(0, 12))) for _ in range(500)]
    found, nodes = token_counts.terminal_counts(words, model)
    assert found == [brute(w, model) for w in words]
    assert nodes == 1 + len({w[:i] for w in words for i in range(1, len(w) + 1)})


def test_rows(spark):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    model = token_counts.Unigram.of(ranks)
    texts = ["", None, "The cat and the catalogue, 12 cats.", "é" * 40, "a" * 20_000, "The cat and the catalogue, 12 cats."]
    rows = [(i if i else None, t, "x") for i, t in enumerate(texts)]
    cut = bpe.compiled(public_tokenizers.PATTERN)
    got = token_counts.counted(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), ranks, public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows)
    for (i, text, _), r in zip(sorted(rows, key=lambda x: x[0] or 0), sorted(got, key=lambda x: x.doc_id or 0), strict=True):
        words = [w.encode() for w in cut.findall(text or "")]
        if sum(map(len, words)) < 1000:
            own = [brute(w, model) for w in words]
            assert (r.doc_id, r.n_pre_tokens, r.n_tokens) == (i, len(words), sum(n for n, _ in own))
            assert r.score == pytest.approx(math.fsum(s for _, s in own))
    assert token_counts.counted(spark.createDataFrame([], "doc_id long, text string"), ranks, public_tokenizers.PATTERN).count() == 0
