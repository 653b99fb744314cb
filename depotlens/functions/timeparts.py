"""Calendar and duty-time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400
SHORT_NIGHT = 6 * 3600
DAY_COUNTER_START = "2023-01-01"


def duty_hours(dep: Column, arr: Column, code: Column) -> Column:
    """Hours between two clock times.

    A night duty ends the next day, and the day after that when it would last
    under six hours; any other duty ends the next day when it arrives earlier
    than it departs.  NULL when either time is missing.
    """
    gap = arr - dep
    night = F.when(gap + DAY < SHORT_NIGHT, gap + 2 * DAY).otherwise(gap + DAY)
    seconds = F.when(F.coalesce(code == "N", F.lit(False)), night).when(gap < 0, gap + DAY).otherwise(gap)
    return seconds / 3600.0


def plain_hours(dep: Column, arr: Column) -> Column:
    """Absolute difference of two clock times, no overnight rule."""
    return F.abs(dep - arr) / 3600.0


def steering_share(hours: Column, drivers: Column) -> Column:
    """Hours per driver; missing or zero drivers count as one."""
    return hours / F.coalesce(F.nullif(drivers, F.lit(0)), F.lit(1))


def calendar_parts(date: Column, start: str = DAY_COUNTER_START) -> dict[str, Column]:
    dow = F.weekday(date)
    parts = {"dow": dow}
    parts.update({f"dow_{d}": (dow == d).cast("int") for d in range(7)})
    parts.update(
        is_weekend=(dow >= 5).cast("int"),
        day_of_month=F.dayofmonth(date),
        month=F.month(date),
        week_of_year=F.weekofyear(date),
        year=F.year(date),
        day_counter=F.datediff(date, F.lit(start).cast("date")),
    )
    return parts


def financial_year(date: Column) -> Column:
    first = F.year(F.add_months(date, -3))
    return F.concat_ws("-", first.cast("string"), (first + 1).cast("string"))


def quarter_label(date: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(date).cast("string"))


def month_start(date: Column) -> Column:
    return F.trunc(date, "MM")


def between_days(date: Column, start, end) -> Column:
    """Half-open range on the bare column, so it reaches the file scan."""
    return (date >= F.lit(start).cast("date")) & (date < F.lit(end).cast("date"))


def period_range(kind: str, year: int, month: int | None = None, quarter: int | None = None, day: str | None = None):
    """(first day, day after last) of a Daily / Monthly / Quarterly / Yearly selection."""
    import datetime as dt

    def plus_months(y: int, m: int, k: int) -> dt.date:
        total = y * 12 + (m - 1) + k
        return dt.date(total // 12, total % 12 + 1, 1)

    if kind == "Daily":
        first = dt.date.fromisoformat(day)
        return first, first + dt.timedelta(days=1)
    if kind == "Monthly":
        return dt.date(year, month, 1), plus_months(year, month, 1)
    if kind == "Quarterly":
        first_month = 3 * quarter - 2
        return dt.date(year, first_month, 1), plus_months(year, first_month, 3)
    if kind == "Yearly":
        return dt.date(year, 1, 1), dt.date(year + 1, 1, 1)
    raise ValueError(f"unknown period {kind}")


def in_peak(seconds: Column, windows=((6 * 3600, 10 * 3600), (59400, 73800))) -> Column:
    """06:00-10:00 or 16:30-20:30, ends included; unknown time is off-peak."""
    (a, b), (c, d) = windows
    return F.coalesce(seconds.between(a, b) | seconds.between(c, d), F.lit(False))


def weather_parts() -> dict[str, Column]:
    rain = F.col("daily_rainfall")
    return {
        "temp_range": F.col("max_temp") - F.col("min_temp"),
        "avg_temp": (F.col("max_temp") + F.col("min_temp")) / 2,
        "is_rainy": F.coalesce(rain > 0, F.lit(False)).cast("int"),
        "is_heavy_rain": F.coalesce(rain > 10, F.lit(False)).cast("int"),
    }
