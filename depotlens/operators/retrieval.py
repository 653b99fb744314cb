"""Exact vector search over a distributed table, and text vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Of query vectors sent to tasks at a time, and of queries scored against a batch at a time.
QUERY_BYTES = 64_000_000
SCORED = 512


def _block_topk(docs: DataFrame, queries: list, k: int, cosine: bool, own_tag: bool) -> DataFrame:
    """Best k of every task per query: at most k rows per query leave a task, however many documents tie."""
    shared = docs.sparkSession.sparkContext.broadcast((
        np.array([q["query_id"] for q in queries]), np.array([q["vector"] for q in queries], dtype="float64"), np.array([q["tag"] for q in queries], object)))

    # Everything the tasks run is local to this function, so executors need numpy and
    # pandas but not this package.
    def unit(rows):
        norm = np.linalg.norm(rows, axis=1, keepdims=True)
        return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)

    def best_of(found: pd.DataFrame) -> pd.DataFrame:
        ordered = found.sort_values(["query_id", "score", "doc_id"], ascending=[True, False, True], kind="stable")
        return ordered[ordered.groupby("query_id", sort=False).cumcount() < k]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, matrix, tags = shared.value
        matrix = unit(matrix) if cosine else matrix
        best: dict[int, pd.DataFrame] = {}  # of each chunk of queries, over the batches so far
        for batch in batches:
            if batch.empty:
                continue
            batch = batch.sort_values("doc_id", kind="stable")
            doc_ids, doc_tags = batch["doc_id"].to_numpy(), batch["tag"].to_numpy()
            rows = np.stack(batch["vector"].to_numpy()).astype("float64")
            rows = unit(rows) if cosine else rows
            keep = min(k, len(doc_ids))
            for at in range(0, len(names), SCORED):
                scores = rows @ matrix[at:at + SCORED].T
                if own_tag:
                    scores = np.where(doc_tags[:, None] == tags[None, at:at + SCORED], scores, -np.inf)
                # Rows above the k-th score, and of those that equal it the first by id, until there are k.
                edge = np.partition(scores, len(doc_ids) - keep, axis=0)[len(doc_ids) - keep]
                above, ties = scores > edge, scores == edge
                kept = above | (ties & (np.cumsum(ties, axis=0) <= keep - above.sum(axis=0)))
                doc_at, query_at = np.nonzero(kept & (scores > -np.inf))
                found = pd.DataFrame({
                    "query_id": names[at + query_at], "doc_id": doc_ids[doc_at], "score": scores[doc_at, query_at],
                    "same_tag": np.equal(doc_tags[doc_at], tags[at + query_at]).astype(bool)})
                best[at] = best_of(pd.concat([best[at], found])) if at in best else found
        yield from best.values()

    types = {**dict(docs.dtypes)}
    return docs.select("doc_id", "vector", "tag").mapInPandas(score, f"query_id bigint, doc_id {types['doc_id']}, score double, same_tag boolean")


def vector_topk(
    docs: DataFrame, queries: DataFrame, k: int = 5, cosine: bool = False, filter_mode: str = "none", query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """(query_id, doc_id, score, place): exact nearest documents by inner product.

    ``docs(doc_id, vector[, tag])``, ``queries(query_id, vector[, tag])``.  With
    ``filter_mode='post'`` hits of another tag are dropped after k, so a query may
    get fewer; ``'pre'`` searches only its own tag.

    The documents are read once for each block of queries.  A block is what ``query_bytes`` allows to be sent to tasks, some
    hundred thousand queries; the plan of a block is the same whatever it holds.
    """
    named = [df if "tag" in df.columns else df.withColumn("tag", F.lit(None).cast("bigint")) for df in (docs, queries)]
    docs, queries = named
    n, dims = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    blocks = max(1, -(-n * (dims or 0) * 8 // query_bytes))
    found = None
    for b in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else queries
        some = own.select("query_id", "vector", "tag").collect()  # query_bytes bounds it
        if some:
            part = _block_topk(docs, some, k, cosine, filter_mode == "pre")
            found = part if found is None else found.unionByName(part)
    if found is None:
        empty = f"query_id bigint, doc_id {dict(docs.dtypes)['doc_id']}, score double, place int"
        return docs.sparkSession.createDataFrame([], empty)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    top = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
    return (top.filter("same_tag") if filter_mode == "post" else top).drop("same_tag")


def centroids(docs: DataFrame, group: str) -> DataFrame:
    """Mean vector per group, summed within tasks first; no row is made for an element."""
    mean = Summarizer.mean(array_to_vector(F.col("vector")))
    return docs.groupBy(F.col(group).alias("query_id")).agg(vector_to_array(mean).alias("vector"))


def embed(docs: DataFrame, dims: int = 256) -> DataFrame:
    """Unit-length hashed term vectors of whole texts: (doc_id, vector)."""
    stages = Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"\W+", gaps=True),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims),
        Normalizer(inputCol="_tf", outputCol="_unit", p=2.0),
    ])
    rows = docs.select("doc_id", "text")
    return stages.fit(rows).transform(rows).select("doc_id", vector_to_array("_unit").alias("vector"))
