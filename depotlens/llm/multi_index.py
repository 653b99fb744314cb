"""Nearest neighbours by an inverted multi-index.

Vectors are cut into halves, each quantised by a codebook of its own; a cell is a pair of centroids.  A query
walks the cells in order of the summed distance of its halves to theirs, with a heap over the two sorted lists, until
they hold enough vectors, and the entries of those cells are ranked by their exact distance.

Equal vectors are one entry with its least ids (as many as a query can need), so copies cost nothing however many
there are.  Large cells, and cells that many queries walk, are cut into pieces that tasks take on their own.

Defined cases: vectors that are NULL, zero, hold NULL or non-finite components, have no id, or another length than that of the
least id's vector take no part.  Of several vectors of one id the least counts.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depotlens.session import materialise


@dataclass(frozen=True)
class Settings:
    k: int = 10
    recall: float = 0.95  # wanted; sets how many vectors a query looks at, through trial queries
    trials: int = 100  # queries answered by brute force for that, at most
    least: int = 200  # distinct vectors a query looks at, at least
    cell_vectors: int = 12  # wanted on average
    group_vectors: int = 1000  # of neighbouring cells that tasks take together, on average
    most_centroids: int = 512  # of a half
    sample: int = 20_000  # vectors the codebooks are fitted on, at most; all are indexed
    rounds: int = 12
    piece: int = 4096  # entries, or queries, of a piece of a group


def taking_part(table: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    own = table.select(F.col("vec_id"), F.col("embedding").alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    first = own.agg(F.min_by(F.size("v"), F.col("vec_id"))).first()[0]
    return own.filter(F.size("v") == (first or 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def entries(vectors: DataFrame, k: int) -> DataFrame:
    """(ids, v) of each distinct vector, with its k + 1 least ids: more can't be among the k nearest of any other."""
    least = Window.partitionBy("v").orderBy("vec_id")
    few = vectors.withColumn("place", F.row_number().over(least)).filter(F.col("place") <= k + 1)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def codebook(x: np.ndarray, n: int, rounds: int) -> np.ndarray:
    """Centroids of Lloyd's rounds from distinct seeds; an empty cluster keeps its centroid."""
    seeds = np.unique(x, axis=0)
    centroids = seeds[np.random.default_rng(7).permutation(len(seeds))[:n]].copy()
    for _ in range(rounds):
        near = nearest(x, centroids)
        count = np.bincount(near, minlength=len(centroids))
        total = np.stack([np.bincount(near, x[:, j], len(centroids)) for j in range(x.shape[1])], axis=1)
        centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centroids)
    return centroids


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (centroids ** 2).sum(1)[None, :] - 2 * x @ centroids.T + (x ** 2).sum(1)[:, None]


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[a:a + 4096], centroids).argmin(1) for a in range(0, len(x), 4096)])


def cells_in_order(first: np.ndarray, second: np.ndarray, counts: np.ndarray, least: float) -> list[int]:
    """Cells by rising sum of the halves' distances, until their vectors are enough; empty cells are left out."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y, n = first[a].tolist(), second[b].tolist(), counts.reshape(len(first), len(second))[np.ix_(a, b)].tolist()
    # A pair is offered when the one before it in its row has gone, and the first of a row when that of the row before has.
    heap, out, held = [(x[0] + y[0], 0, 0)], [], 0
    while heap and held < least:
        _, i, j = heapq.heappop(heap)
        if n[i][j]:
            out.append((i, j))
            held += n[i][j]
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
        if j + 1 < len(y):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
    return [int(a[i]) * len(second) + int(b[j]) for i, j in out]


def matrix(column) -> np.ndarray:
    """Rows of equal length."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def index(vectors: DataFrame, s: Settings) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray], np.ndarray] | None:
    """(cell, ids, v) of every distinct vector, the codebooks and each cell's number of vectors; None without vectors."""
    own = materialise(entries(vectors, s.k), "index-vectors")
    n = own.count()
    if not n:
        return None
    sample = np.array([r.v for r in own.orderBy(F.xxhash64("v"), "v").limit(s.sample).collect()])  # sample bounds it
    half = max(sample.shape[1] // 2, 1)
    size = int(min(s.most_centroids, max(1, round(math.sqrt(n / s.cell_vectors)))))
    books = codebook(sample[:, :half], size, s.rounds), codebook(sample[:, half:] if sample.shape[1] > 1 else sample * 0, size, s.rounds)
    kinds = dict(own.dtypes)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v"))
                cell = nearest(x[:, :half], books[0]) * len(books[1]) + nearest(x[:, half:] if x.shape[1] > 1 else x * 0, books[1])
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), batch.column("ids"), batch.column("v")], ["cell", "ids", "v"])

    placed = materialise(own.select("ids", "v").mapInArrow(run, f"cell long, ids {kinds['ids']}, v {kinds['v']}"), "index-cells")
    counts = np.zeros(len(books[0]) * len(books[1]), np.int64)
    for r in placed.groupBy("cell").count().collect():  # most_centroids squared at most
        counts[r.cell] = r["count"]
    return placed, books, counts


def halves(x: np.ndarray, books) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of the halves to the centroids."""
    half = books[0].shape[1]
    return squared(x[:, :half], books[0]), squared(x[:, half:] if x.shape[1] > 1 else x * 0, books[1])


def needed(queries: DataFrame, placed: DataFrame, books, counts: np.ndarray, s: Settings) -> float:
    """How many vectors trial queries must walk past to meet the wanted share of their true neighbours."""
    trial = [(r.vec_id, np.array(r.v, float)) for r in queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(s.trials).collect()]
    if not trial:
        return 0.0
    x = np.stack([v for _, v in trial])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                y, cell = matrix(batch.column("v")), batch.column("cell").to_numpy()
                for t in range(len(x)):
                    distance = ((y - x[t]) ** 2).sum(1)
                    few = np.argsort(distance, kind="stable")[:s.k + 1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(few), t)), pa.array(distance[few]), pa.array(cell[few])], ["t", "d", "cell"])

    best = Window.partitionBy("t").orderBy("d", "cell")
    true = placed.mapInArrow(run, "t long, d double, cell long").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= s.k + 1).collect()
    first, second = halves(x, books)
    walked = []
    for t in range(len(x)):
        order = cells_in_order(first[t], second[t], counts, math.inf)
        after = dict(zip(order, np.cumsum(counts[order]).tolist(), strict=True))
        walked += [after[r.cell] for r in true if r.t == t]
    return float(np.quantile(walked, s.recall))


def walks(queries: DataFrame, books, counts: np.ndarray, least: float, width: int) -> DataFrame:
    """(query_id, q, group, cells) of the cells each query walks, by groups of ``width`` neighbouring cells."""
    shared = queries.sparkSession.sparkContext.broadcast((books, counts))  # most_centroids bounds it

    def run(batches):
        books, counts = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            first, second = halves(matrix(batch.column("v")), books)
            for at, (f, g) in enumerate(zip(first, second, strict=True)):
                cells = np.sort(cells_in_order(f, g, counts, least))
                group, start = np.unique(cells // width, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(cells)), pa.int32()), pa.array(cells, pa.int64()))
                own = pa.array([at] * len(group), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(own), batch.column("v").take(own), pa.array(group, pa.int64()), lists], ["query_id", "q", "group", "cells"])

    kinds = dict(queries.dtypes)
    return queries.mapInArrow(run, f"query_id {kinds['vec_id']}, q {kinds['v']}, group long, cells array<bigint>")


def ranked(table_q: pd.DataFrame, table_e: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of each query among those of these entries whose cells it walks."""
    y, ids, cell = np.stack(table_e["v"]).astype(np.float64), table_e["ids"].to_numpy(), table_e["cell"].to_numpy()
    least = np.array([i[0] for i in ids])
    out = []
    for query, q, cells in zip(table_q["query_id"], table_q["q"], table_q["cells"], strict=True):
        pick = np.flatnonzero(np.isin(cell, cells))
        distance = np.sqrt(((y[pick] - np.asarray(q, np.float64)) ** 2).sum(1))
        few = np.lexsort((least[pick], distance))[:k + 1]
        out += [(query, d, i) for d, i in sorted((float(distance[e]), int(i)) for e in few for i in ids[pick[e]] if i != query)[:k]]
    return pd.DataFrame(out, columns=["query_id", "score", "vec_id"])


def search(table: DataFrame, is_query, s: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of (vec_id, embedding) for which ``is_query(vec_id)`` holds."""
    vectors = materialise(taking_part(table), "index-input")
    kinds = dict(vectors.dtypes)
    made = index(vectors, s)
    nothing = f"query_id {kinds['vec_id']}, score double, vec_id {kinds['vec_id']}"
    if made is None:
        found = table.sparkSession.createDataFrame([], nothing)
    else:
        placed, books, counts = made
        queries = vectors.filter(is_query(F.col("vec_id")))
        least = max(needed(queries, placed, books, counts, s), s.least, s.k + 1)
        width = max(1, math.ceil(len(counts) * s.group_vectors / max(counts.sum(), 1)))
        asked = materialise(walks(queries, books, counts, least, width), "index-walks")
        placed = placed.withColumn("group", F.floor(F.col("cell") / width))
        pieces = lambda df, name: df.groupBy("group").agg(F.ceil(F.count("*") / s.piece).cast("int").alias(name))
        both = pieces(asked, "of_q").join(pieces(placed, "of_e"), "group")
        key = ["group", "part_q", "part_e"]
        left = asked.join(both, "group").withColumns({
            "part_q": F.pmod(F.xxhash64("query_id"), "of_q").cast("int"), "part_e": F.explode(F.sequence(F.lit(0), F.col("of_e") - 1))})
        right = placed.join(both, "group").withColumns({
            "part_e": F.pmod(F.xxhash64(F.col("ids")[0]), "of_e").cast("int"), "part_q": F.explode(F.sequence(F.lit(0), F.col("of_q") - 1))})

        def run(q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
            return ranked(q, e, s.k) if len(q) and len(e) else pd.DataFrame({"query_id": [], "score": [], "vec_id": []})

        found = left.select(*key, "query_id", "q", "cells").groupBy(*key).cogroup(right.select(*key, "cell", "ids", "v").groupBy(*key)).applyInPandas(run, nothing)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")
