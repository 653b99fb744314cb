import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from depotlens.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SETTINGS = packing.Settings()
NASTY = ["", None, "   ", "\n\n", "It's 12 o'clock. WE'LL go!\nNew line\n\nlast", "é ́x Été", "日本語のテキスト。次の文。 終", "<|endoftext|> <|startoftext|>x", "a b　c   d", "x\x00y \x01", "😀😀 😀", "a" * 30_000, "Wort! " * 9_000]


def padding(n, window):
    return 0 if n & (n - 1) == 0 else window - n


def plain_least(at, cost, window):
    best = [0] + [None] * (len(at) - 1)
    for j in range(1, len(at)):
        best[j] = cost[j] + min(best[i] + padding(at[j] - at[i], window) for i in range(j) if at[j] - at[i] <= window)
    return best[-1]


@pytest.mark.parametrize("seed", range(20))
def test_least_cost(seed):
    rng = random.Random(seed)
    window = rng.choice([4, 16, 64])
    at = np.concatenate([[0], np.cumsum([rng.randint(1, window) for _ in range(rng.randint(1, 60))])])
    cost = np.array([rng.choice([0, 3, 6]) for _ in at])
    cost[-1] = 0
    chosen, least = packing.windows(at, cost, window)
    lengths = np.diff(at[chosen])
    assert chosen[0] == 0 and chosen[-1] == len(at) - 1 and lengths.max() <= window
    assert least == sum(padding(int(n), window) for n in lengths) + cost[chosen[1:]].sum() == plain_least(at.tolist(), cost.tolist(), window)


def checked(rows, texts, library, window=4096):
    """Every id of every text stands in one piece, sequences are gapless and hold ``window`` ids at most; the share of padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    total = 0
    for doc, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        pieces = sorted(by_doc[doc], key=lambda r: r.start)
        assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist() and {r.doc_tokens for r in pieces} == {len(ids)} == {sum(r.length for r in pieces)}
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes()) and r.length for r in pieces)
    pad = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in pieces])
        assert [r.offset for r in pieces] == [0, *ends[:-1]] and ends[-1] <= window
        pad += padding(int(ends[-1]), window)
    return pad / total


def test_rows(spark):
    with open(PATH, encoding="utf-8") as f:
        json = f.read()
    rows = [(k, t, "x") for k, t in enumerate(NASTY)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string").coalesce(1)
    pieces = packing.packed(docs, json, keep_ids=True)
    got = pieces.collect()
    assert checked(got, dict(enumerate(NASTY)), Tokenizer.from_file(PATH)) < 0.02
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    whole = packing.sequences(pieces).collect()
    assert sum(r.n_tokens for r in whole) == sum(r.length for r in got) and all(len(r.ids) == r.n_tokens <= r.padded_length <= 4096 for r in whole)
    twice = spark.createDataFrame([(None, "a b", 1), (None, "a b", 1)], "doc_id long, text string, offset int")
    assert [(r.doc_id, r.doc_tokens) for r in packing.packed(twice.coalesce(1), json).collect() if not r.start] == [(None, 3)] * 2
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), json).count() == 0
