"""Exact order statistics that never gather a whole group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlens.operators.ranges import running_total
from depotlens.session import materialise

ACCURACY = 1000


def exact_quantiles(
    df: DataFrame, by: list[str], value: str, probs: list[float], names: list[str], stage: bool = True
) -> DataFrame:
    """Linear-interpolated quantiles per group (or overall), equal to a full sort of each group.

    The values are read twice more after the sketch; ``stage`` writes them once first, which pays off
    unless the input is a plain table scan.

    1. a mergeable sketch brackets each quantile between two values;
    2. one pass counts what lies below the bracket and keeps the values inside it,
       already combined to (value, count);
    3. only the bracket, a few thousandths of the group, is ordered, in ranges of a bounded number of rows.
    """
    eps = 4.0 / ACCURACY
    edges = [e for p in probs for e in (max(p - eps, 0.0), min(p + eps, 1.0))]
    rows = df.filter(F.col(value).isNotNull()).select(*by, value)
    if stage:
        rows = materialise(rows, "quantiles")
    sketch = rows.groupBy(*by).agg(
        F.percentile_approx(value, edges, ACCURACY).alias("e"), F.count("*").alias("n"),
        F.min(value).alias("lo"), F.max(value).alias("hi"),
    )
    wanted = sketch.select(
        *by, "n",
        F.posexplode(F.array(*[
            F.struct(
                (F.col("lo") if p - eps <= 0 else F.get("e", F.lit(2 * i))).alias("a"),
                (F.col("hi") if p + eps >= 1 else F.get("e", F.lit(2 * i + 1))).alias("b"),
                ((F.col("n") - 1) * F.lit(float(p))).alias("pos"),
            )
            for i, p in enumerate(probs)
        ])).alias("q", "w"),
    ).select(*by, "q", "w.*")
    # A sketch depends on the order its parts are merged in, so it must not be computed
    # twice: counting below and looking inside have to use the same bracket.
    wanted = materialise(wanted, "brackets")
    freq = rows.groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    if by:
        joined = freq.join(wanted, by)
    else:
        # A handful of brackets, attached as one scalar value.
        brackets = wanted.agg(F.collect_list(F.struct("q", "a", "b", "pos"))).scalar()
        joined = freq.withColumn("w", F.explode(brackets)).select("v", "c", "w.*")
    slot = [*by, "q"]
    below = joined.groupBy(*slot).agg(
        F.sum(F.when(F.col("v") < F.col("a"), F.col("c")).otherwise(0)).alias("below"),
        F.max(F.when(F.col("v") < F.col("a"), F.col("v"))).alias("prev"),
        F.min(F.when(F.col("v") > F.col("b"), F.col("v"))).alias("next"),
    )
    inside = running_total(joined.filter("v BETWEEN a AND b").join(below, slot), slot, [F.asc("v")], F.col("c"), "_upto")
    inside = inside.withColumn("upto", F.col("below") + F.col("_upto"))
    low, high = F.floor("pos"), F.ceil("pos")

    def at(rank):
        # In small groups the wanted rank can lie one value outside the bracket.
        found = F.min(F.when(F.col("upto") > rank, F.col("v")))
        return F.coalesce(F.max(F.when(rank < F.col("below"), F.col("prev"))), found, F.max("next"))

    picks = inside.groupBy(*slot).agg(
        at(low).alias("x"), at(high).alias("y"), F.max(F.col("pos") - low).alias("t"),
    ).withColumn("value", F.col("x") + (F.col("y") - F.col("x")) * F.col("t"))
    return picks.groupBy(*by).agg(*[F.max(F.when(F.col("q") == i, F.col("value"))).alias(n) for i, n in enumerate(names)])
