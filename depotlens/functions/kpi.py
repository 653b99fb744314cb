"""Workforce measures derived from one sheet row: one projection, no UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.sources.views import MU_REASONS, SL_REASONS

# Target per category and measure.
BENCHMARKS = {
    "Rural": {
        "pct_weekly_off": 14.0, "pct_special_off": 25.0, "pct_others": 1.7, "pct_leave": 2.0, "pct_sick": 2.0,
        "pct_spot_absent": 1.0, "pct_double_duty": 16.0, "pct_off_cancellation": 2.0, "drivers_per_schedule": 2.18,
    },
    "Urban": {
        "pct_weekly_off": 14.0, "pct_special_off": 27.4, "pct_others": 1.0, "pct_leave": 6.0, "pct_sick": 2.0,
        "pct_spot_absent": 2.0, "pct_double_duty": 8.0, "pct_off_cancellation": 2.0, "drivers_per_schedule": 2.43,
    },
}
RATIO_KPIS = list(BENCHMARKS["Rural"])[:8]


def benchmark_table(spark) -> DataFrame:
    rows = [(cat, kpi, value) for cat, targets in BENCHMARKS.items() for kpi, value in targets.items()]
    return spark.createDataFrame(rows, "category string, kpi string, benchmark double")


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _total(names: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [_n(c) for c in names])


def derive_kpis(sheet: DataFrame, precision: int | None = None, half_even: bool = True) -> DataFrame:
    """Add every derived measure.

    ``precision`` rounds all of them: half-even as the edit page does, or half-up
    (``half_even=False``) as the entry grid does.  Chained ``withColumns`` collapse
    into one projection.
    """
    share = lambda part: F.coalesce(F.try_divide(part * 100.0, F.nullif(F.col("Total_Drivers"), F.lit(0))), F.lit(0.0))
    out = (
        sheet.withColumns({
            "service_variance": _n("Actual_Services") - _n("Planned_Services"),
            "km_variance": _n("Actual_KM") - _n("Planned_KM"),
            "available_1": _n("Total_Drivers") - _n("Medically_Unfit") - _n("Suspended_Drivers"),
            "deductions": _total(["Weekly_Off_National_Off", "Special_Off_Night_Out_IC_Online",
                                  "Training_PME_medical", "Others", "Leave_Absent", "Sick_Leave"]),
            "pct_weekly_off": share(_n("Weekly_Off_National_Off")),
            "pct_special_off": share(_n("Special_Off_Night_Out_IC_Online")),
            "pct_others": share(_n("Training_PME_medical") + _n("Others")),
            "pct_leave": share(_n("Leave_Absent")),
            "pct_sick": share(_n("Sick_Leave")),
            "pct_spot_absent": share(_n("Spot_Absent")),
            "pct_double_duty": share(_n("Double_Duty")),
            "pct_off_cancellation": share(_n("Off_Cancellation")),
            "driver_schedule": F.coalesce(
                F.try_divide(_n("Drivers_Required"), F.nullif(_n("Planned_Schedules"), F.lit(0))), F.lit(0.0)),
            "mu_total": _total(MU_REASONS),
            "sl_total": _total(SL_REASONS),
        })
        .withColumns({
            "available_2": F.col("available_1") - F.col("deductions"),
            "pct_available_1": share(F.col("available_1")),
            "mu_diff": F.col("mu_total") - _n("Medically_Unfit"),
            "sl_diff": F.col("sl_total") - _n("Sick_Leave"),
        })
        .withColumns({
            "pct_available_2": share(F.col("available_2")),
            "attending": F.col("available_2") - _n("Spot_Absent"),
        })
        .withColumns({
            "pct_attending": share(F.col("attending")),
            "shortage": F.greatest(_n("Drivers_Required") - F.col("attending"), F.lit(0)),
            "on_duty": F.col("attending") + _n("Double_Duty") + _n("Off_Cancellation"),
        })
        .withColumn("for_bus", F.col("on_duty") - _n("Drivers_as_Conductors"))
        .withColumns({
            "km_per_driver": F.when(F.col("for_bus") > 0, F.try_divide(_n("Actual_KM"), F.nullif(F.col("for_bus"), F.lit(0))))
            .otherwise(0.0),
            "service_check": F.col("for_bus") - _n("Actual_Services"),
        })
    )
    if precision is None:
        return out
    cut = F.bround if half_even else F.round
    doubles = [c for c, t in out.dtypes if t == "double" and c not in sheet.columns]
    return out.withColumns({c: cut(F.col(c), precision) for c in doubles})


def drivers_per_schedule_row(drivers: Column, schedules: Column) -> Column:
    return F.try_divide(drivers, F.nullif(schedules, F.lit(0)))
