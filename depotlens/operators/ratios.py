"""Workforce ratios against targets, and report grids.

Sheets hold one row per depot and day; every report is one grouping over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotlens.functions.kpi import RATIO_KPIS, drivers_per_schedule_row
from depotlens.functions.numbers import half_even


def drivers_per_schedule(sheet: DataFrame, by: list[str], how: str = "ratio_of_sums") -> DataFrame:
    drivers, schedules = F.col("Total_Drivers"), F.col("Planned_Schedules")
    if how == "ratio_of_sums":
        value = F.try_divide(F.sum(drivers), F.nullif(F.sum(schedules), F.lit(0)))
    else:
        value = F.avg(F.bround(drivers_per_schedule_row(drivers, schedules), 2))
    return sheet.groupBy(*by).agg(value.alias("drivers_per_schedule"))


def eight_ratios(kpis: DataFrame, depots: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Mean of each ratio per depot beside its category target; ``ok`` when not above it."""
    means = kpis.groupBy("depot").agg(
        *[half_even(F.avg(k), 2).alias(k) for k in RATIO_KPIS],
        half_even(F.try_divide(F.sum("Total_Drivers"), F.nullif(F.sum("Planned_Schedules"), F.lit(0))), 2).alias("drivers_per_schedule"),
    )
    long = means.unpivot("depot", [*RATIO_KPIS, "drivers_per_schedule"], "kpi", "value")
    rated = long.join(depots.select("depot", "category"), "depot").join(benchmarks, ["category", "kpi"])
    variance = half_even(F.col("value") - F.col("benchmark"), 2)
    return rated.select("depot", "category", "kpi", "value", "benchmark", variance.alias("variance"), (variance <= 0).cast("int").alias("ok"))


def ratio_trend(kpis: DataFrame, depots: DataFrame, benchmarks: DataFrame, freq: str) -> DataFrame:
    """Mean ratio per depot and period, with the target as a second series."""
    period = {"day": F.col("data_date"), "month": F.trunc("data_date", "MM"), "year": F.trunc("data_date", "YEAR")}[freq]
    means = kpis.groupBy("depot", period.alias("period")).agg(*[F.avg(k).alias(k) for k in RATIO_KPIS])
    long = means.unpivot(["depot", "period"], RATIO_KPIS, "kpi", "value")
    return with_benchmark_series(long, depots, benchmarks)


def with_benchmark_series(long: DataFrame, depots: DataFrame, benchmarks: DataFrame) -> DataFrame:
    target = long.join(depots.select("depot", "category"), "depot").join(benchmarks, ["category", "kpi"])
    series = long.withColumn("series", F.lit("actual"))
    return series.unionByName(target.select("depot", "period", "kpi", F.col("benchmark").alias("value"), F.lit("benchmark").alias("series")))


def ratio_rank(kpis: DataFrame, depots: DataFrame) -> DataFrame:
    """Depots ordered on each ratio with the region mean of depot means.

    One row per depot and ratio, so the window is over the depots only.
    """
    means = kpis.groupBy("depot").agg(*[F.avg(k).alias(k) for k in RATIO_KPIS])
    long = means.unpivot("depot", RATIO_KPIS, "kpi", "value").join(depots.select("depot", "region"), "depot")
    place = Window.partitionBy("kpi").orderBy(F.desc("value"), "depot")
    region = long.groupBy("region", "kpi").agg(F.avg("value").alias("region_mean"))
    return long.withColumn("place", F.row_number().over(place)).join(region, ["region", "kpi"])


def mixed_benchmark(depots: DataFrame, benchmarks: DataFrame, by: str) -> DataFrame:
    """Mean target of a mixed set of depots, and its commonest category (ties to the smallest)."""
    counts = depots.groupBy(by, "category").agg(F.count("*").alias("n"))
    common = counts.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("neg"), "category")).alias("m"))
    return (
        counts.join(benchmarks, "category").groupBy(by, "kpi")
        .agg((F.sum(F.col("benchmark") * F.col("n")) / F.sum("n")).alias("benchmark"))
        .join(common.select(by, F.col("m.category").alias("common_category")), by)
    )


def action_month(kpis: DataFrame, first: str, after: str) -> DataFrame:
    """Means of the ratios and the driver ratio of one month, per depot."""
    day = F.col("data_date")
    month = kpis.filter((day >= F.lit(first).cast("date")) & (day < F.lit(after).cast("date")))
    return month.groupBy("depot").agg(
        *[F.avg(k).alias(k) for k in RATIO_KPIS],
        F.try_divide(F.sum("Total_Drivers"), F.nullif(F.sum("Planned_Schedules"), F.lit(0))).alias("drivers_per_schedule"),
    )


def date_grid(long: DataFrame, dates: list[str], value: Column) -> DataFrame:
    """(label, value per chosen date) from (label, data_date, value) rows."""
    day = F.date_format("data_date", "yyyy-MM-dd")
    cells = [F.max(F.when(day == d, value)).alias(f"d_{d.replace('-', '_')}") for d in dates]
    return long.filter(F.col("data_date").isin([F.lit(d).cast("date") for d in dates])).groupBy("label").agg(*cells)


def corporation_grid(kpis: DataFrame, counts: list[str], shares: list[str], dates: list[str]) -> DataFrame:
    """All depots summed per date; shares are divided by the number of depots, rounded to 2."""
    wanted = kpis.filter(F.col("data_date").isin([F.lit(d).cast("date") for d in dates]))
    totals = wanted.groupBy("data_date").agg(
        *[F.sum(c).cast("double").alias(c) for c in counts],
        *[half_even(F.sum(s) / F.countDistinct("depot"), 2).alias(s) for s in shares],
    )
    return date_grid(totals.unpivot("data_date", [*counts, *shares], "label", "value"), dates, F.col("value"))


def sheet_grid(sheet: DataFrame, labels: dict[str, str], dates: list[str]) -> DataFrame:
    """One depot's sheet with categories as rows and dates as columns."""
    cells = sheet.select("data_date", *[F.col(c).cast("double").alias(c) for c in labels])
    long = cells.unpivot("data_date", list(labels), "column", "value")
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return date_grid(long.withColumn("label", F.element_at(names, F.col("column"))), dates, F.col("value"))


def pending_status(depots: DataFrame, sheet: DataFrame, as_of: str, rule: str = "yesterday") -> DataFrame:
    """Latest entry per depot, days behind yesterday and status.

    ``rule='yesterday'`` counts only yesterday as updated, ``'recent'`` also today.
    """
    from depotlens.operators.joins import latest_by_depot

    yesterday = F.date_sub(F.lit(as_of).cast("date"), 1)
    latest = F.col("latest")
    fresh = latest == yesterday if rule == "yesterday" else latest.isin(yesterday, F.lit(as_of).cast("date"))
    return latest_by_depot(depots, sheet, "data_date").select(
        "depot", "region", "latest", F.datediff(yesterday, latest).alias("days"),
        F.when(F.coalesce(fresh, F.lit(False)), "Updated").otherwise("Pending").alias("status"),
    )


def last_filled(plan: DataFrame, date: str = "data_date") -> DataFrame:
    """Last filled date per depot and calendar quarter."""
    return plan.groupBy("depot", F.year(date).alias("year"), F.concat(F.lit("Q"), F.quarter(date)).alias("quarter")).agg(
        F.max(date).alias("last_date")
    )


def match_labels(names: DataFrame, labels: DataFrame) -> DataFrame:
    """Column name -> label: equal keys, then containment, then equal once blanks are gone.

    Both sides are the column names of one sheet, so the classes are computed over
    their substrings rather than over all pairs.
    """
    from depotlens.functions.clean import label_key
    from depotlens.operators.joins import _substrings

    left = names.select("name", label_key(F.regexp_replace("name", "_", " ")).alias("key")).distinct()
    right = labels.select("label", label_key(F.col("label")).alias("lkey")).distinct()
    longest = right.agg(F.max(F.length("lkey"))).scalar()
    equal = left.join(right, F.col("key") == F.col("lkey")).select("name", F.lit(0).alias("cls"), "label")
    inside = _substrings(left, "key", longest, "lkey").join(right, "lkey").select("name", F.lit(1).alias("cls"), "label")
    spread = left.agg(F.max(F.length("key"))).scalar()
    around = _substrings(right, "lkey", spread, "key").join(left, "key").select("name", F.lit(1).alias("cls"), "label")
    tight = F.regexp_replace
    compact = left.withColumn("c", tight("key", "[ %]", "")).join(right.withColumn("c", tight("lkey", "[ %]", "")), "c").select(
        "name", F.lit(2).alias("cls"), "label")
    best = equal.unionByName(inside).unionByName(around).unionByName(compact).groupBy("name").agg(
        F.min(F.struct("cls", "label")).alias("b"))
    return left.select("name").join(best, "name", "left").select("name", F.col("b.label").alias("label"), F.col("b.cls").alias("cls"))
