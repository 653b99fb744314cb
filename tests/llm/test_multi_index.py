import math

import numpy as np
import pytest

from depotlens.llm import multi_index

SCHEMA = "vec_id long, embedding array<float>, label int, score string, cell string"


def brute(rows, step):
    own = {}
    for i, v, *_ in rows:
        if i is None or v is None or len(v) != 8 or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        own[i] = min(own.get(i, v), v)
    ids = np.array(sorted(own))
    x = np.array([np.float32(own[i]) for i in ids]).astype(float)
    out = {}
    for i in ids[ids % step == 0]:
        d = np.sqrt(((x - x[ids == i][0]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:10]
        out[int(i)] = [(int(ids[j]), float(d[j])) for j in order]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8))
    rows = [(i, (centres[i % 20] + 0.3 * rng.normal(size=8)).astype(np.float32).tolist(), 0, "x", "y") for i in range(3000)]
    rows += [(i, rows[7][1], 0, "x", "y") for i in range(3000, 4000)]  # one vector with a quarter of all rows
    bad = [None, [0.0] * 8, [1.0, None, *[1.0] * 6], [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [1.0, 2.0], []]
    return rows + [(5000 + 10 * k, v, 0, "x", "y") for k, v in enumerate(bad)] + [(None, rows[0][1], 0, "x", "y"), rows[10], (20, [9.0] * 8, 0, "x", "y")]


def test_recall_and_order(spark, rows):
    got = {}
    for r in multi_index.search(spark.createDataFrame(rows, SCHEMA), lambda i: i % 10 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows, 10)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9
    for found in got.values():
        assert [(d, i) for i, d in found] == sorted((d, i) for i, d in found)


def test_whole_walk_is_exact_and_pieces_agree(spark, rows):
    s = multi_index.Settings(least=10_000, piece=100, group_vectors=300)
    got = {}
    for r in multi_index.search(spark.createDataFrame(rows, SCHEMA), lambda i: i % 50 == 0, s).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute(rows, 50)


def test_few_and_none(spark, rows):
    few = spark.createDataFrame(rows[:4], SCHEMA)
    assert [(r.query_id, r["rank"], r.vec_id) for r in multi_index.search(few, lambda i: i % 10 == 0).orderBy("rank").collect()] == [
        (0, k + 1, i) for k, (i, _) in enumerate(brute(rows[:4], 10)[0])]
    assert multi_index.search(few.limit(0), lambda i: i % 10 == 0).count() == 0
    assert multi_index.search(few, lambda i: i == 99).count() == 0
