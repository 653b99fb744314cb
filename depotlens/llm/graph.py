"""Connected components of a large graph by passing least labels and jumping along them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlens.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(a, label) for every vertex of the edges (a, b): label is the least vertex that it is connected with.

    Each round takes the least label among the neighbours and then the label of that label, so a chain of
    n vertices needs about log n rounds.  Rounds are cut by written tables.
    """
    both = materialise(edges.union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, "a").select("a", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = step.select(F.col("a").alias("label"), F.col("label").alias("next"))
        done = materialise(step.join(jump, "label").select("a", F.least("label", "next").alias("label"), "was"), "labels")
        labels = done.select("a", "label")
        if done.filter("label <> was").isEmpty():
            return labels
