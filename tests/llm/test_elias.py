import numpy as np
import pytest

from depotlens.llm import elias


@pytest.mark.parametrize("n, top", [(0, 1), (1, 0), (1, 2**63), (5, 3), (1000, 50), (1000, 10**6), (5000, 2**64 - 1), (70_000, 2**40)])
def test_sequence(n, top):
    rng = np.random.default_rng(n + 1)
    values = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
    own = elias.Monotone.of(values)
    assert (own.at(np.arange(n)) == values).all()
    asked = np.concatenate([values, values + np.uint64(1), rng.integers(0, top, 300, dtype=np.uint64, endpoint=True), np.array([0, 2**64 - 1], np.uint64)])
    asked = asked[: 2 * n + 302] if n else asked
    assert (own.find(asked) == np.searchsorted(values, asked)).all()


def test_trie():
    rng = np.random.default_rng(3)
    names = np.unique(rng.integers(0, 2**64 - 1, 500, dtype=np.uint64))
    pairs = np.unique(rng.integers(0, 100, 3000) * 500 + rng.integers(0, len(names), 3000))
    heads, of = np.unique(pairs // 500, return_inverse=True)
    values = rng.normal(size=len(pairs))
    trie = elias.mapped(lambda f: elias.Trie.write(f, names, heads, pairs % 500, of, np.arange(len(heads)) * 1.0, values, {"n": heads}, 16))
    known = dict(zip(pairs.tolist(), range(len(pairs)), strict=True))
    h, t = rng.integers(0, 120, 5000), rng.integers(0, len(names), 5000)
    head = trie.heads_of(names[h])
    place = trie.find(head, names[t])
    assert (place == np.array([known.get(a * 500 + b, -1) for a, b in zip(h.tolist(), t.tolist(), strict=True)])).all()
    assert (head == np.array([np.searchsorted(heads, a) if a in heads else -1 for a in h])).all()
    found = place >= 0
    assert np.abs(trie.value("tail", place[found]) - values[place[found]]).max() < 1e-3
    assert (trie.heads_of(names[:3] + np.uint64(1)) == -1).all() and (trie.find(head[:3], names[:3] + np.uint64(1)) == -1).all()
