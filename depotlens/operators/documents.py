"""One text document per depot-day with its raw and derived measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.functions.numbers import half_even

# Label of each derived measure in a document.
DERIVED_LABELS = {
    "service_variance": "Service Variance", "km_variance": "KM Variance",
    "available_1": "Available Drivers-1", "pct_available_1": "% Available Drivers-1",
    "available_2": "Available Drivers-2", "pct_available_2": "% Available Drivers-2",
    "pct_weekly_off": "% Weekly Off", "pct_special_off": "% Special Off", "pct_others": "% Others",
    "pct_leave": "% Leave & Absent", "pct_sick": "% Sick Leave",
    "attending": "Attending Drivers", "pct_attending": "% Attending Drivers", "pct_spot_absent": "% Spot Absent",
    "shortage": "Driver shortage", "driver_schedule": "Driver schedule", "on_duty": "Drivers on Duty",
    "for_bus": "Driver for Bus Services", "km_per_driver": "KM/Driver", "service_check": "Service/Driver Check",
    "mu_total": "Total Drivers (MU Reasons)", "mu_diff": "Diff (MU Reasons)",
    "sl_total": "Total Drivers (SL Reasons)", "sl_diff": "Diff (SL Reasons)",
}


def _entries(pairs: dict[str, Column]) -> Column:
    return F.create_map(*[x for label, value in pairs.items() for x in (F.lit(label), value)])


def kpi_documents(kpis: DataFrame, raw: list[str]) -> DataFrame:
    date = F.date_format("data_date", "yyyy-MM-dd")
    # Fixed text of a document.
    text = F.format_string(
        "On %s, depot %s had %d drivers. Available Drivers-1 was %d and Available Drivers-2 was %d. "
        "Attending Drivers were %d. Driver shortage was %d. Actual KM was %d giving KM per driver %.2f. "
        "Service variance was %d.",
        date, "depot", "Total_Drivers", "available_1", "available_2", "attending", "shortage", "Actual_KM",
        F.bround("km_per_driver", 2), "service_variance",
    )
    return kpis.select(
        F.concat_ws("_", F.lit("input_data"), "depot", date).alias("doc_id"), "depot", "data_date",
        _entries({c: F.col(c).cast("string") for c in raw}).alias("raw_fields"),
        _entries({label: F.col(c).cast("double") for c, label in DERIVED_LABELS.items()}).alias("calculated_fields"),
        text.alias("text"),
    )


def document_filter(docs: DataFrame, depot: str | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    out = docs
    if depot:
        out = out.filter(F.upper("depot") == depot.strip().upper())
    if first and last:
        out = out.filter(F.col("data_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return out


def kpi_value(kpi: str) -> Column:
    """Derived value when the document has one, else the raw value."""
    return F.coalesce(F.col("calculated_fields")[kpi], F.col("raw_fields")[kpi].try_cast("double"))


def kpi_status(docs: DataFrame, depots: DataFrame, benchmarks: DataFrame, label: str, kpi: str, default: str = "Rural") -> DataFrame:
    """Mean of one measure per depot, rounded to 2, against its category target.

    CONTROL under the target, WITHIN on it, RISK above it, UNKNOWN without a value.
    """
    means = docs.groupBy("depot").agg(half_even(F.avg(kpi_value(label)), 2).alias("value"))
    target = benchmarks.filter(F.col("kpi") == kpi).select("category", "benchmark")
    rated = means.join(depots.select("depot", "category"), "depot", "left").withColumn(
        "category", F.coalesce("category", F.lit(default))
    ).join(target, "category", "left")
    value, goal = F.col("value"), F.col("benchmark")
    status = (
        F.when(value.isNull() | goal.isNull(), "UNKNOWN").when(value < goal, "CONTROL")
        .when(value == goal, "WITHIN").otherwise("RISK")
    )
    return rated.select("depot", "category", "value", "benchmark", status.alias("status"))
