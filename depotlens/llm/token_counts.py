"""Token counts under a unigram model, by dynamic programming over a trie.

A block's distinct pre-tokens are put into one trie of bytes.  The best score of a prefix depends on the prefix alone, so
it is computed once at its node, whatever number of pre-tokens pass through, from the nodes of shorter prefixes and the
pieces that end there; a terminal node keeps the number of tokens of its pre-token.  Counts of texts are sums over
their pre-tokens.  Nothing is shuffled.

Scores follow the rank of a piece (Zipf's law: -log(rank + 1)), as vocabularies come without probabilities; equal scores take fewer tokens.
Defined cases: NULL text counts as empty and has no tokens; a byte that is no piece is one unknown token at a
fixed low score; rows are never joined, so repeated and NULL ids keep their rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from depotlens.llm.bpe import compiled
from depotlens.llm.text import only, slices, texts_of

UNKNOWN = -30.0


@dataclass(frozen=True)
class Unigram:
    scores: dict[bytes, float]
    longest: int

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Unigram:
        total = math.log(sum(1 / (r + 1) for r in ranks.values()) or 1)
        return cls({p: -math.log(r + 1) - total for p, r in ranks.items()}, max(map(len, ranks), default=1))


def terminal_counts(words: list[bytes], model: Unigram) -> tuple[list[tuple[int, float]], int]:
    """(tokens, score) of each pre-token, and how many nodes the trie has."""
    children: dict[int, int] = {}  # by node and byte
    best: list[tuple[float, int]] = [(0.0, 0)]  # of each node: score, less tokens
    out = []
    get, longest = model.scores.get, model.longest
    for word in words:
        path = [0]
        node = 0
        for end, byte in enumerate(word, 1):
            after = children.get(node << 8 | byte)
            if after is None:
                after = len(best)
                children[node << 8 | byte] = after
                found = None
                for start in range(max(0, end - longest), end):
                    score = get(word[start:end])
                    if score is None:
                        if end - start > 1:
                            continue
                        score = UNKNOWN
                    before = best[path[start]]
                    way = (before[0] + score, before[1] - 1)
                    if found is None or way > found:
                        found = way
                best.append(found)
            node = after
            path.append(node)
        out.append((-best[node][1], best[node][0]))
    return out, len(best)


def counted(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_column: str = "doc_id") -> DataFrame:
    """(``id_column``, n_pre_tokens, n_tokens, score) of every row."""
    kind = docs.schema[id_column].dataType.simpleString()
    names = [id_column, "n_pre_tokens", "n_tokens", "score"]

    def run(batches):
        cut, model = compiled(pattern), Unigram.of(ranks)
        for batch in batches:
            for part in slices(batch):
                number: dict[str, int] = {}
                places = [np.fromiter((number.setdefault(w, len(number)) for w in cut.findall(text)), np.int64) for text in texts_of(part).to_pylist()]
                found, _ = terminal_counts([w.encode() for w in number], model)
                tokens, score = np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], float)
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array([len(p) for p in places], pa.int64()), pa.array([int(tokens[p].sum()) for p in places], pa.int64()),
                    pa.array([math.fsum(score[p]) for p in places], pa.float64())], names)

    return only(docs, id=id_column, text="text").mapInArrow(run, f"`{id_column}` {kind}, n_pre_tokens long, n_tokens long, score double")
