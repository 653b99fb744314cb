import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from depotlens.llm import variants

SETTINGS = variants.Settings()
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(map(chr, range(0xC0, 0x100)))


def words_of(docs):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_edit(w, letters=LETTERS):
    cut = {w[:i] + w[i + 1:] for i in range(len(w))}
    put = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
    other = {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters}
    return (cut | put | other) - {w}


def apart_by_one(a, b):
    start = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a != b and (a[start + 1:] == b[start + 1:] or a[start:] == b[start + 1:] or a[start + 1:] == b[start:])


def brute(docs):
    words = words_of(docs)
    near = {w: [x for x in (one_edit(w) if len(w) < 40 else (x for x in words if apart_by_one(w, x))) if x in words] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def index_of(words, settings=SETTINGS):
    counts = Counter(w[i:i + k] for w in words for k in (2, 3) for i in range(len(w) - k + 1))
    totals = defaultdict(int)
    for g, n in counts.items():
        totals[len(g)] += n
    kept = {g: n for g, n in counts.items() if len(g) == 2}
    kept |= {g: n for g, n in counts.items() if len(g) == 3 and kept[g[:-1]] > 0.02 * totals[2]}
    return variants.Index(kept, settings)


def test_words_one_edit_apart_share_a_key():
    rng = random.Random(5)
    base = ["".join(rng.choice("aabént") for _ in range(rng.randint(7, 12))) for _ in range(300)] + ["aaaaaaa", "a" * 30, "anananananan", "bbbbbbbb"]
    index = index_of(base)
    for w in base:
        own, onward = set(index.keys(w)), set(index.keys(w, 1))
        for other in rng.sample(sorted(one_edit(w, "aabénx")), 12):
            assert (own & set(index.keys(other, 1)) if len(other) < len(w) else (own if len(other) == len(w) else onward) & set(index.keys(other))), (w, other)


def test_rows(spark):
    rng = random.Random(11)
    common = ["Transport", "Étudiant", "Verkehrsmittel", "abababababab", "zzzzzzzzz", "naïvetés"]
    docs = [(k, " ".join(rng.choice(common) + rng.choice(["", ",", "s", "7x"]) for _ in range(60))) for k in range(80)]
    docs += [(100, None), (None, "transport Transport"), (None, "transport Transport"), (101, ""), (102, "x" * 50_000), (103, "x" * 50_000 + " " + "x" * 50_001), (104, "x" * 50_001), (105, "transport́ tran×sport 123")]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    assert rows_of(variants.grouped(frame)) == brute(docs)
    assert rows_of(variants.grouped(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_dictionary_is_bounded(spark):
    words = spark.createDataFrame([("abcdefgh", 2), ("abcdefgi", 3), ("abcxyzuv", 2)], "word string, n long")
    kept = variants.gram_dictionary(words, variants.Settings(frequent=0.1))
    assert kept["ab"] == 3 and kept["abc"] == 3 and "bcd" in kept and "xyz" not in kept and "xy" in kept


@pytest.mark.parametrize("other", ["transport", "Transports"])
def test_short_runs_are_no_words(spark, other):
    frame = spark.createDataFrame([(1, f"six six seven {other} {other}")], "doc_id long, text string")
    assert all(len(r.word) >= 7 for r in variants.grouped(frame).collect())
