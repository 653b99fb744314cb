"""Running totals over an order of any length, by ranges of it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotlens.session import materialise

ROWS_PER_RANGE = 100_000


def running_total(df: DataFrame, by: list[str], order: list[Column], value: Column, name: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds ``name``: the sum of ``value`` from the first row of its ``by`` group to this one, in ``order``.

    ``order`` must tell rows of a group apart.  Rows are dealt into ranges of (by, order), as many as their number asks for, so that
    neither a large group nor many equal leading values meet in one task; each range is summed on its own and shifted by the
    sums of the ranges before it.
    """
    df = materialise(df, "ordered")  # counted, sampled for the ranges and dealt from there
    n = df.count()
    ranges = max(1, math.ceil(n / rows_per_range))
    keys = [F.asc(c) for c in by]
    dealt = df.repartitionByRange(ranges, *keys, *order) if ranges > 1 else df.coalesce(1)
    dealt = materialise(dealt.withColumns({"_range": F.spark_partition_id(), "_v": value}), "ranges")
    group = [*by, "_range"]
    sums = dealt.groupBy(*group).agg(F.sum("_v").alias("_s"))
    # One row of a group and range.
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select(*group, F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_shift"))
    within = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.withColumn("_own", F.sum("_v").over(within))
    same = [rows[c].eqNullSafe(shifts[c]) for c in by] + [rows["_range"] == shifts["_range"]]
    joined = rows.join(shifts, same)
    return joined.select(*[rows[c] for c in df.columns], (rows["_own"] + shifts["_shift"]).alias(name))
