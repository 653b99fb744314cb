import math
import random
import re
import zlib
from collections import Counter

import pytest

from depotlens.llm import lm
from depotlens.llm.text import crc_of

SCHEMA = "doc_id long, text string, score string, h string"


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "</s>"]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def brute(rows, s):
    train = [tokens(r[1]) for r in rows if not held(r[0])]
    one = Counter(t for x in train for t in x)
    two = Counter((v, w) for x in train for v, w in zip(["<s>", *x], x))
    context = Counter(v for x in train for v in ["<s>", *x[:-1]])
    n, v = sum(one.values()), len(one)
    once, twice = (sum(c == k for c in one.values()) for k in (1, 2))
    d = min(max(once / (once + 2 * twice), 0.05), 0.95) if once else 0.5
    out = []
    for r in rows:
        own = tokens(r[1])
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in own)
        score = 0
        for a, w in zip(["<s>", *own], own):
            p = (one[w] - d) / n if one[w] else (d * v / n if n else 1)
            score += math.log10((two[a, w] + s.weight * p) / (context[a] + s.weight))
        out.append((str(r[0]), held(r[0]), len(own), sum(one[w] > 0 for w in own), n, base, score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocabulary = [f"W{int(rng.expovariate(0.02))}é" for _ in range(400)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))), "x", "y") for i in range(120)]
    return rows + [(None, None, None, None), (None, "  \x0b ", None, None), (3, "", "x", "y"), rows[4], (9, "a b c\x1fd " * 3000, "x", "y"), (10, "a" * 50_000, "x", "y")]


@pytest.mark.parametrize("hot", [1 / 2000, 1 / 20, 1 / 100])
def test_agrees_with_plain_counting(spark, rows, hot):
    s = lm.Settings(hot=hot, least_shards=5, bits=16, weight=50.0)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted((str(r.doc_id), *r[1:]) for r in lm.scores(docs, lambda i: crc_of(i, 7) == 2, s).collect())
    for g, w in zip(got, brute(rows, s), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-3)


def test_empty_and_unlearned(spark, rows):
    s = lm.Settings(least_shards=2)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert lm.scores(docs.limit(0), lambda i: crc_of(i, 7) == 2, s).count() == 0
    assert {(r.train_tokens, r.n_known) for r in lm.scores(docs, lambda i: i.isNull() | i.isNotNull(), s).collect()} == {(0, 0)}
