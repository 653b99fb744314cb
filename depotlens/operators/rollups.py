"""Roll-ups, averages, rankings.

Facts are combined by their finest needed key first (map-side), and look-ups such
as duty hours join that smaller result, so a depot holding a third of all rows
sends only its combined rows through the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotlens.functions.numbers import half_even
from depotlens.functions.timeparts import month_start
from depotlens.operators.joins import dense_months, with_hours
from depotlens.operators.quantiles import exact_quantiles
from depotlens.operators.ranges import ROWS_PER_RANGE, running_total
from depotlens.session import materialise

MEASURES = ["total_km", "total_hours", "total_earnings"]


def zero(col: Column, value=0.0) -> Column:
    return F.coalesce(col, F.lit(value))


def monthly_rollup(ops: DataFrame, services: DataFrame, keys: list[str], mode: str = "overnight") -> DataFrame:
    """Kilometres, hours and earnings per key and month."""
    combined = ops.groupBy(
        *dict.fromkeys([*keys, "depot", "service_number"]), month_start(F.col("operations_date")).alias("month")
    ).agg(F.sum("opd_kms").alias("km"), F.sum("daily_earnings").alias("earnings"), F.count("*").alias("n"))
    timed = with_hours(combined, services, mode)
    return timed.groupBy(*keys, F.year("month").alias("year"), "month").agg(
        zero(F.sum("km")).alias("total_km"),
        zero(F.sum(F.col("hours") * F.col("n"))).alias("total_hours"),
        zero(F.sum("earnings")).alias("total_earnings"),
    )


def absence_counts(absences: DataFrame, keys: list[str]) -> DataFrame:
    return (
        absences.filter("leave_type IS NOT NULL")
        .groupBy(*keys, F.year("date").alias("year"), month_start(F.col("date")).alias("month"))
        .agg(F.count("*").alias("absenteeism"))
    )


def with_absences(monthly: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    return monthly.join(counts, [*keys, "year", "month"], "left").na.fill(0, ["absenteeism"])


ALL = [*MEASURES, "absenteeism"]


def region_per_depot_month(monthly: DataFrame, depots: DataFrame, months: str = "observed") -> DataFrame:
    """Region total / depots of the region / months.

    ``months='observed'`` divides by the distinct months present, ``'calendar'`` by 12.
    Input is one row per depot-month.
    """
    size = depots.groupBy("region").agg(F.count("*").alias("n_depots"))
    base = monthly.join(depots.select("depot", "region"), "depot")
    totals = base.groupBy("region").agg(*[F.sum(m).alias(m) for m in ALL], F.countDistinct("month").alias("seen"))
    n_months = F.lit(12) if months == "calendar" else F.col("seen")
    return totals.join(size, "region").select(
        "region", "n_depots", n_months.alias("n_months"),
        *[(F.col(m) / F.col("n_depots") / n_months).alias(m) for m in ALL],
    )


def region_mean_of_totals(monthly: DataFrame, depots: DataFrame) -> DataFrame:
    per_depot = monthly.groupBy("depot").agg(*[F.sum(m).alias(m) for m in ALL])
    return per_depot.join(depots.select("depot", "region"), "depot").groupBy("region").agg(
        *[F.avg(m).alias(m) for m in ALL]
    )


def region_mean_of_means(monthly: DataFrame, depots: DataFrame) -> DataFrame:
    per_depot = monthly.groupBy("depot").agg(*[F.avg(m).alias(m) for m in ALL])
    return per_depot.join(depots.select("depot", "region"), "depot").groupBy("region").agg(
        *[F.avg(m).alias(m) for m in ALL]
    )


def depot_metrics(monthly: DataFrame) -> DataFrame:
    """Mean per month, and per day as mean x 12 / 365."""
    means = monthly.groupBy("depot").agg(*[F.avg(m).alias(f"{m}_month") for m in ALL])
    return means.withColumns({f"{m}_day": F.col(f"{m}_month") * 12 / 365 for m in ALL})


def leave_mix(absences: DataFrame) -> DataFrame:
    counts = absences.filter("leave_type IS NOT NULL").groupBy("leave_type").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def grade_counts(health: DataFrame) -> DataFrame:
    return health.groupBy(F.col("final_grading").alias("grade")).agg(F.count("*").alias("n"))


def reason_sums(sheet: DataFrame, groups: dict[str, list[str]], by: list[str]) -> DataFrame:
    """Total of every reason column as rows; zero totals are dropped, labels made readable."""
    cols = [c for members in groups.values() for c in members]
    totals = sheet.groupBy(*by).agg(*[F.sum(c).alias(c) for c in cols])
    cells = F.array(*[
        F.struct(F.lit(g).alias("reason_group"), F.lit(c.replace("_", " ")).alias("reason"), F.col(c).alias("n"))
        for g, members in groups.items() for c in members
    ])
    long = totals.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")
    return long.filter("n <> 0").withColumn("reason", F.initcap("reason"))


def driver_summary(driver_monthly: DataFrame) -> DataFrame:
    return driver_monthly.groupBy("depot", "employee_id").agg(*[F.sum(m).alias(m) for m in ALL])


def driver_vs_depot(ops: DataFrame, absences: DataFrame, services: DataFrame) -> DataFrame:
    """Averages per driver beside the averages of the whole depot, and leave counts by kind.

    Earnings per km is mean earnings / mean km.  Both levels are built from one
    pre-combined table of sums and counts.
    """
    base = ops.groupBy("depot", "employee_id", "service_number").agg(
        F.count("*").alias("n"), F.sum("opd_kms").alias("km"), F.sum("daily_earnings").alias("earn")
    )
    timed = with_hours(base, services, "abs").withColumn("h", F.col("hours") * F.col("n"))
    timed = timed.withColumn("hn", F.when(F.col("hours").isNotNull(), F.col("n")))
    per_driver = timed.groupBy("depot", "employee_id").agg(*[F.sum(c).alias(c) for c in ("n", "km", "earn", "h", "hn")])
    per_depot = per_driver.groupBy("depot").agg(*[F.sum(c).alias(f"d_{c}") for c in ("n", "km", "earn", "h", "hn")])
    leaves = absences.groupBy("employee_id").agg(
        *[F.count_if(F.col("leave_type") == k).alias(f"leave_{k.lower()}") for k in "LSA"]
    )
    return (
        per_driver.join(per_depot, "depot").join(leaves, "employee_id", "left")
        .select(
            "depot", "employee_id",
            (F.col("km") / F.col("n")).alias("km_per_day"),
            F.try_divide("earn", "km").alias("earnings_per_km"),
            F.try_divide("h", "hn").alias("hours_per_day"),
            (F.col("d_km") / F.col("d_n")).alias("depot_km_per_day"),
            F.try_divide("d_earn", "d_km").alias("depot_earnings_per_km"),
            F.try_divide("d_h", "d_hn").alias("depot_hours_per_day"),
            *[zero(F.col(f"leave_{k}"), 0).alias(f"leave_{k}") for k in "lsa"],
        )
    )


def employee_average(ops: DataFrame, mode: str = "totals") -> DataFrame:
    """Depot mean of employee totals (``totals``) or of rows (``rows``)."""
    if mode == "rows":
        return ops.groupBy("depot").agg(F.avg("opd_kms").alias("mean_km"), F.avg("daily_earnings").alias("mean_earnings"))
    per = ops.groupBy("depot", "employee_id").agg(F.sum("opd_kms").alias("km"), F.sum("daily_earnings").alias("earn"))
    return per.groupBy("depot").agg(F.avg("km").alias("mean_km"), F.avg("earn").alias("mean_earnings"))


def driver_months(ops: DataFrame, start: str, end: str) -> DataFrame:
    """Monthly km and earnings per driver on a dense month range, with period total and mean.

    The window partition holds one row per month of the chosen range.
    """
    day = F.col("operations_date")
    inside = ops.filter((day >= F.lit(start).cast("date")) & (day <= F.last_day(F.lit(end).cast("date"))))
    monthly = inside.groupBy("employee_id", month_start(day).alias("month")).agg(
        F.sum("opd_kms").alias("km"), F.sum("daily_earnings").alias("earnings")
    )
    dense = dense_months(monthly, ["employee_id"], start, end, ["km", "earnings"])
    all_months = Window.partitionBy("employee_id")
    return dense.withColumns({
        "km_total": F.sum("km").over(all_months), "km_mean": F.avg("km").over(all_months),
        "earnings_total": F.sum("earnings").over(all_months), "earnings_mean": F.avg("earnings").over(all_months),
    })


def day_night(ops: DataFrame, start: str, end: str) -> DataFrame:
    """Day and night duties per driver and month, dense."""
    day = F.col("operations_date")
    inside = ops.filter((day >= F.lit(start).cast("date")) & (day <= F.last_day(F.lit(end).cast("date"))))
    counts = inside.groupBy("employee_id", month_start(day).alias("month")).agg(
        F.count_if(F.col("day_night") == "D").alias("day_duties"), F.count_if(F.col("day_night") == "N").alias("night_duties")
    )
    return dense_months(counts, ["employee_id"], start, end, ["day_duties", "night_duties"])


def five_numbers(df: DataFrame, group: str, value: str, stage: bool = True) -> DataFrame:
    """Box-plot numbers per group."""
    names = ["low", "q1", "median", "q3", "high"]
    return exact_quantiles(df, [group], value, [0.0, 0.25, 0.5, 0.75, 1.0], names, stage)


def dedupe_duties(ops: DataFrame) -> DataFrame:
    """One row per employee, date, depot and service: smallest hours, summed km."""
    return ops.groupBy("employee_id", "operations_date", "depot", "service_number").agg(
        F.min("steering_hours").alias("steering_hours"), F.sum("opd_kms").alias("opd_kms"),
        F.min("hours_source").alias("hours_source"),
    )


def steering_pivot(duties: DataFrame) -> DataFrame:
    """Employee x date hours as long rows, with the totals of both sides and of all.

    Cells are rounded (half-even) before they are totalled.  Dates stay rows: as columns, years of days would be
    thousands of columns, and a grid of a chosen period is a pivot of the rows it needs.
    """
    cells = materialise(duties.groupBy("employee_id", F.col("operations_date").alias("date")).agg(
        half_even(F.coalesce(F.sum("steering_hours"), F.lit(0.0)), 0).cast("bigint").alias("h")), "cells")
    employee, date = cells.groupBy("employee_id").agg(F.sum("h").alias("h")), cells.groupBy("date").agg(F.sum("h").alias("h"))
    total = date.agg(F.sum("h").alias("h")).filter("h IS NOT NULL")
    named = [df.withColumn("part", F.lit(part)) for df, part in ((cells, "cell"), (employee, "employee"), (date, "date"), (total, "total"))]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.select("employee_id", "date", "part", F.col("h").alias("hours"))


def estimated_mask(duties: DataFrame) -> DataFrame:
    """(employee_id, date, estimated): whether any duty of the cell has estimated hours."""
    return duties.groupBy("employee_id", F.col("operations_date").alias("date")).agg(
        F.coalesce(F.bool_or(F.col("hours_source") != "Actual"), F.lit(False)).cast("int").alias("estimated"))


def entity_averages(ops: DataFrame) -> DataFrame:
    """Employee averages with their depot's averages joined on (both levels pre-combined)."""
    per = ops.groupBy("depot", "employee_id").agg(
        F.count("*").alias("n"), F.sum("opd_kms").alias("km"), F.sum("daily_earnings").alias("earn")
    )
    depot = per.groupBy("depot").agg(
        (F.sum("km") / F.sum("n")).alias("depot_avg_km"), (F.sum("earn") / F.sum("n")).alias("depot_avg_earnings")
    )
    return per.join(depot, "depot").select(
        "depot", "employee_id", (F.col("km") / F.col("n")).alias("emp_avg_km"),
        (F.col("earn") / F.col("n")).alias("emp_avg_earnings"), "depot_avg_km", "depot_avg_earnings",
    )


def mean_daily(fact: DataFrame, value: str, name: str) -> DataFrame:
    """Mean of daily sums per depot."""
    return fact.groupBy("depot", "date").agg(F.sum(value).alias("s")).groupBy("depot").agg(F.avg("s").alias(name))


def rolling_or(gold: DataFrame, days: int = 30, least: int = 5, fallback: float = 0.85) -> DataFrame:
    """Mean occupancy of the last ``days`` of the whole table, else the fallback."""
    cutoff = F.date_sub(gold.agg(F.max("date")).scalar(), days)
    recent = F.when(F.col("date") >= cutoff, F.col("occupancy_ratio"))
    return gold.groupBy("depot").agg(
        F.when(F.count(recent) >= least, half_even(F.avg(recent), 4)).otherwise(fallback).alias("rolling_or")
    )


def clip_iqr(df: DataFrame, group: str, col: str, k: float = 3.0) -> DataFrame:
    """Clip a depot-day measure to [q1 - k iqr, q3 + k iqr] of its depot.

    ``percentile`` keeps one depot's daily values, at most one per calendar day.
    """
    q = df.groupBy(group).agg(F.percentile(col, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    spread = F.col("q")[1] - F.col("q")[0]
    return (
        df.join(q, group)
        .withColumn(col, F.least(F.greatest(F.col(col), F.col("q")[0] - k * spread), F.col("q")[1] + k * spread))
        .drop("q")
    )


def compare_depots(monthly: DataFrame, a: str, b: str) -> DataFrame:
    """Two depots side by side on the union of their months."""
    pair = monthly.filter(F.col("depot").isin(a, b))
    return pair.groupBy("month").agg(*[
        zero(F.sum(F.when(F.col("depot") == d, F.col(m))), 0).alias(f"{m}_{s}") for m in ALL for s, d in (("a", a), ("b", b))
    ])


# ---- rankings ----------------------------------------------------------------
def ranked(df: DataFrame, by: str, tie: list[str], name: str = "rank", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """1..n over a whole table without a single-task window, whatever its size and ties."""
    return running_total(df, [], [F.desc(by), *map(F.asc, tie)], F.lit(1).cast("bigint"), name, rows_per_range)


def top_bottom(df: DataFrame, by: str, tie: list[str], n: int = 5, keys: list[str] | None = None, low_is_best: bool = False) -> DataFrame:
    """Best and worst n per key.  The row_number limits are applied before the shuffle as well."""
    keys = keys or []

    def side(order, label):
        if not keys:
            best = df.orderBy(order, *tie).limit(n)
            window = Window.partitionBy(F.lit(0)).orderBy(order, *tie)
            return best.withColumn("place", F.row_number().over(window)).withColumn("side", F.lit(label))
        window = Window.partitionBy(*keys).orderBy(order, *tie)
        return df.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= n).withColumn("side", F.lit(label))

    first, last = (F.asc(by), F.desc(by)) if low_is_best else (F.desc(by), F.asc(by))
    return side(first, "top").unionByName(side(last, "bottom"))


def driver_performance(ops: DataFrame, services: DataFrame, absences: DataFrame) -> DataFrame:
    """Kilometres, earnings, hours and leave days per driver of a depot."""
    from depotlens.operators.joins import hours_by_employee

    perf = ops.groupBy("depot", "employee_id").agg(F.sum("opd_kms").alias("km"), F.sum("daily_earnings").alias("earnings"))
    leaves = absences.filter(F.col("leave_type").isin("L", "S", "A")).groupBy("employee_id").agg(F.count("*").alias("leaves"))
    return perf.join(hours_by_employee(ops, services), "employee_id", "left").join(leaves, "employee_id", "left").na.fill(
        0, ["hours", "leaves"]
    )


def driver_score(perf: DataFrame, group: str = "depot") -> DataFrame:
    """Sum of km, earnings and hours less leave, each scaled to 0..1 within the depot; a flat measure counts 0.

    The limits are a combined aggregate joined back; the per-driver table is written once because it is read for both.
    """
    perf = materialise(perf, "performance")
    cols = ["km", "earnings", "hours", "leaves"]
    limits = perf.groupBy(group).agg(*[f(c).alias(f"_{p}_{c}") for c in cols for f, p in ((F.min, "lo"), (F.max, "hi"))])
    scaled = perf.join(limits, group)

    def unit(c: str) -> Column:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        return F.when(hi == lo, 0.0).otherwise((F.col(c) - lo) / F.nullif(hi - lo, F.lit(0)))

    return scaled.withColumn("score", unit("km") + unit("earnings") + unit("hours") - unit("leaves")).select(*perf.columns, "score")
