"""Workforce measures (K), ratio reports (A16-A25) and KPI documents (D, A36)."""

from __future__ import annotations

from pyspark.sql import functions as F

from depotlens.functions.kpi import BENCHMARKS, RATIO_KPIS, benchmark_table, derive_kpis
from depotlens.operators import documents, ratios
from depotlens.plans.registry import STEPS, query
from depotlens.sources.views import MU_REASONS, SL_REASONS, Domain

_TD = "Total_Drivers"


def _pct(x: str) -> str:
    return f"coalesce(({x}) * 100::DOUBLE / nullif({_TD}, 0), 0)"


# measure -> SQL over the sheet and the measures before it
_MEASURES = {
    "service_variance": "Actual_Services - Planned_Services",
    "km_variance": "Actual_KM - Planned_KM",
    "available_1": "Total_Drivers - Medically_Unfit - Suspended_Drivers",
    "deductions": "Weekly_Off_National_Off + Special_Off_Night_Out_IC_Online + Training_PME_medical + Others + Leave_Absent + Sick_Leave",
    "pct_weekly_off": _pct("Weekly_Off_National_Off"),
    "pct_special_off": _pct("Special_Off_Night_Out_IC_Online"),
    "pct_others": _pct("Training_PME_medical + Others"),
    "pct_leave": _pct("Leave_Absent"),
    "pct_sick": _pct("Sick_Leave"),
    "pct_spot_absent": _pct("Spot_Absent"),
    "pct_double_duty": _pct("Double_Duty"),
    "pct_off_cancellation": _pct("Off_Cancellation"),
    "driver_schedule": "coalesce(Drivers_Required / nullif(Planned_Schedules, 0)::DOUBLE, 0)",
    "mu_total": " + ".join(MU_REASONS),
    "sl_total": " + ".join(SL_REASONS),
    "available_2": "available_1 - deductions",
    "pct_available_1": _pct("available_1"),
    "mu_diff": "mu_total - Medically_Unfit",
    "sl_diff": "sl_total - Sick_Leave",
    "pct_available_2": _pct("available_2"),
    "attending": "available_2 - Spot_Absent",
    "pct_attending": _pct("attending"),
    "shortage": "greatest(Drivers_Required - attending, 0)",
    "on_duty": "attending + Double_Duty + Off_Cancellation",
    "for_bus": "on_duty - Drivers_as_Conductors",
    "km_per_driver": "CASE WHEN for_bus > 0 THEN Actual_KM / for_bus::DOUBLE ELSE 0 END",
    "service_check": "for_bus - Actual_Services",
}
STEPS["kpis"] = "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _MEASURES.items()) + " FROM sheet"
_DOUBLES = {n for n, e in _MEASURES.items() if "DOUBLE" in e}

# query -> measures
_K = {
    "K01_service_variance": ["service_variance"],
    "K02_km_variance": ["km_variance"],
    "K03_available_1": ["available_1", "pct_available_1"],
    "K04_deductions": ["deductions"],
    "K05_available_2": ["available_2", "pct_available_2"],
    "K06_off_shares": ["pct_weekly_off", "pct_special_off", "pct_leave", "pct_sick"],
    "K07_pct_others": ["pct_others"],
    "K08_attending": ["attending", "pct_attending", "pct_spot_absent"],
    "K09_shortage": ["shortage"],
    "K10_driver_schedule": ["driver_schedule"],
    "K11_on_duty": ["on_duty"],
    "K12_for_bus": ["for_bus"],
    "K13_km_per_driver": ["km_per_driver"],
    "K14_service_check": ["service_check"],
    "K15_medical_reasons": ["mu_total", "mu_diff"],
    "K16_sick_reasons": ["sl_total", "sl_diff"],
    "K17_duty_shares": ["pct_double_duty", "pct_off_cancellation"],
}


def _register(name: str, measures: list[str]) -> None:
    cols = ", ".join(["depot", "data_date", *measures])

    @query(name, f"SELECT {cols} FROM kpis", " ".join(m for m in measures if m in _DOUBLES))
    def build(d: Domain):
        return derive_kpis(d.sheet).select("depot", "data_date", *measures)


for _name, _list in _K.items():
    _register(_name, _list)


@query("K18_rounding_variants", """
    SELECT depot, data_date, round_even(pct_leave, 0) AS half_even, floor(pct_leave + 0.5) AS half_up, round_even(km_per_driver, 1) AS one_place
    FROM kpis""", "half_even half_up one_place")
def k18(d: Domain):
    keys = ["depot", "data_date"]
    even = derive_kpis(d.sheet, precision=0).select(*keys, F.col("pct_leave").alias("half_even"))
    up = derive_kpis(d.sheet, precision=0, half_even=False).select(*keys, F.col("pct_leave").alias("half_up"))
    one = derive_kpis(d.sheet, precision=1).select(*keys, F.col("km_per_driver").alias("one_place"))
    return even.join(up, keys).join(one, keys)


STEPS["benchmarks"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{cat}', '{kpi}', {v}::DOUBLE)" for cat, targets in BENCHMARKS.items() for kpi, v in targets.items()
) + ") AS b(category, kpi, benchmark)"


@query("K19_sheet_vs_benchmark", """
    SELECT k.depot, data_date, b.kpi, benchmark, CASE b.kpi WHEN 'pct_leave' THEN pct_leave ELSE pct_sick END - benchmark AS variance
    FROM kpis k JOIN depots d ON d.depot = k.depot JOIN benchmarks b ON b.category = d.category
    WHERE b.kpi IN ('pct_leave', 'pct_sick')""", "benchmark variance")
def k19(d: Domain):
    long = derive_kpis(d.sheet).unpivot(["depot", "data_date"], ["pct_leave", "pct_sick"], "kpi", "value")
    rated = long.join(d.depots.select("depot", "category"), "depot").join(benchmark_table(d.spark), ["category", "kpi"])
    return rated.select("depot", "data_date", "kpi", "benchmark", (F.col("value") - F.col("benchmark")).alias("variance"))


# ---- ratio reports ------------------------------------------------------------
def _long(source: str, ids: str, kpis: list[str], how: str = "{}") -> str:
    return " UNION ALL ".join(f"SELECT {ids}, '{k}' AS kpi, {how.format(k)} AS value FROM {source}" for k in kpis)


STEPS["ratio_means"] = (
    "SELECT depot, " + ", ".join(f"avg({k}) AS {k}" for k in RATIO_KPIS)
    + ", sum(Total_Drivers)::DOUBLE / nullif(sum(Planned_Schedules), 0) AS drivers_per_schedule FROM kpis GROUP BY 1"
)
STEPS["ratio_long"] = _long("ratio_means", "depot", [*RATIO_KPIS, "drivers_per_schedule"])


@query("A16_eight_ratios", """
    SELECT depot, category, kpi, value, benchmark, round_even(round(value - benchmark, 9), 2) AS variance,
           CASE WHEN round_even(round(value - benchmark, 9), 2) <= 0 THEN 1 ELSE 0 END AS ok
    FROM (SELECT l.depot, d.category, l.kpi, round_even(round(value, 9), 2) AS value, benchmark FROM ratio_long l
          JOIN depots d ON d.depot = l.depot JOIN benchmarks b ON b.category = d.category AND b.kpi = l.kpi)""", "value benchmark variance")
def a16(d: Domain):
    return ratios.eight_ratios(derive_kpis(d.sheet), d.depots, benchmark_table(d.spark))


@query("A17_ratio_of_sums", "SELECT depot, drivers_per_schedule FROM ratio_means", "drivers_per_schedule")
def a17(d: Domain):
    return ratios.drivers_per_schedule(d.sheet, ["depot"])


@query("A18_mean_of_ratios", """
    SELECT depot, avg(round_even(Total_Drivers / nullif(Planned_Schedules, 0)::DOUBLE, 2)) AS drivers_per_schedule FROM sheet GROUP BY 1""",
       "drivers_per_schedule")
def a18(d: Domain):
    return ratios.drivers_per_schedule(d.sheet, ["depot"], "mean_of_ratios")


STEPS["trend"] = " UNION ALL ".join(
    f"SELECT depot, date_trunc('month', data_date)::DATE AS period, '{k}' AS kpi, avg({k}) AS value FROM kpis GROUP BY 1, 2" for k in RATIO_KPIS)


@query("A19_ratio_trend", """
    SELECT depot, period, kpi, value, 'actual' AS series FROM trend UNION ALL
    SELECT t.depot, period, t.kpi, benchmark, 'benchmark' FROM trend t JOIN depots d ON d.depot = t.depot
    JOIN benchmarks b ON b.category = d.category AND b.kpi = t.kpi""", "value")
def a19(d: Domain):
    return ratios.ratio_trend(derive_kpis(d.sheet), d.depots, benchmark_table(d.spark), "month")


@query("U10_daily_with_benchmark", " UNION ALL ".join(
    f"SELECT depot, data_date AS period, '{k}' AS kpi, {k} AS value, 'actual' AS series FROM kpis" for k in RATIO_KPIS) + " UNION ALL " + """
    SELECT k.depot, data_date, kpi, benchmark, 'benchmark' FROM kpis k JOIN depots d ON d.depot = k.depot
    JOIN benchmarks b ON b.category = d.category WHERE kpi <> 'drivers_per_schedule'""", "value")
def u10(d: Domain):
    return ratios.ratio_trend(derive_kpis(d.sheet), d.depots, benchmark_table(d.spark), "day")


@query("A20_ratio_rank", """
    SELECT l.depot, d.region, l.kpi, value, row_number() OVER (PARTITION BY l.kpi ORDER BY round(value, 9) DESC, l.depot) AS place,
           avg(value) OVER (PARTITION BY d.region, l.kpi) AS region_mean
    FROM ratio_long l JOIN depots d ON d.depot = l.depot WHERE l.kpi <> 'drivers_per_schedule'""", "value region_mean")
def a20(d: Domain):
    return ratios.ratio_rank(derive_kpis(d.sheet), d.depots)


@query("A21_mixed_benchmark", """
    SELECT x.region, kpi, benchmark, common_category FROM (
        SELECT region, kpi, avg(benchmark) AS benchmark FROM worked d JOIN benchmarks b ON b.category = d.category GROUP BY 1, 2) x
    JOIN (SELECT region, category AS common_category, row_number() OVER (PARTITION BY region ORDER BY count(*) DESC, category) AS rn
          FROM worked GROUP BY 1, 2) c ON c.region = x.region AND rn = 1""", "benchmark")
def a21(d: Domain):
    worked = d.depots.join(d.operations.select("depot").distinct(), "depot", "left_semi")
    return ratios.mixed_benchmark(worked, benchmark_table(d.spark), "region")


STEPS["worked"] = "SELECT * FROM depots WHERE depot IN (SELECT depot FROM operations)"


@query("A22_action_month", "SELECT * FROM ratio_means", " ".join([*RATIO_KPIS, "drivers_per_schedule"]))
def a22(d: Domain):
    return ratios.action_month(derive_kpis(d.sheet), "2024-01-01", "2024-02-01")


_DATES = ["2024-01-05", "2024-01-06", "2024-01-07"]
_COUNTS = ["Schedules", "Total_Drivers", "Actual_KM", "Spot_Absent"]
_SHARES = ["pct_leave", "pct_sick"]
STEPS["corporation"] = " UNION ALL ".join(
    [f"SELECT '{c}' AS label, data_date, sum({c})::DOUBLE AS value FROM kpis GROUP BY 2" for c in _COUNTS]
    + [f"SELECT '{c}', data_date, round_even(round(sum({c}) / count(DISTINCT depot), 9), 2) FROM kpis GROUP BY 2" for c in _SHARES])


def _cells(dates: list[str]) -> str:
    return ", ".join(f"max(value) FILTER (WHERE data_date = DATE '{x}') AS d_{x.replace('-', '_')}" for x in dates)


_DCOLS = " ".join(f"d_{x.replace('-', '_')}" for x in _DATES)


@query("A23_corporation_grid", f"SELECT label, {_cells(_DATES)} FROM corporation GROUP BY 1", _DCOLS)
def a23(d: Domain):
    return ratios.corporation_grid(derive_kpis(d.sheet), _COUNTS, _SHARES, _DATES)


_LABELS = {"Schedules": "Schedules", "Planned_KM": "Planned KM", "Total_Drivers": "Total Drivers", "Sick_Leave": "Sick Leave",
           "Flu_Fever": "Flu/Fever", "pct_sick": "% Sick Leave"}


@query("U08_sheet_grid", f"SELECT label, {_cells(_DATES)} FROM (" + " UNION ALL ".join(
    f"SELECT '{label}' AS label, data_date, sum({c})::DOUBLE AS value FROM kpis GROUP BY 2" for c, label in _LABELS.items())
    + ") GROUP BY 1", _DCOLS)
def u08(d: Domain):
    summed = derive_kpis(d.sheet).groupBy("data_date").agg(*[F.sum(c).alias(c) for c in _LABELS])
    return ratios.sheet_grid(summed, _LABELS, _DATES)


@query("A24_pending_status", """
    SELECT d.depot, region, latest, date_diff('day', latest, DATE '2024-01-29') AS days,
           CASE WHEN latest = DATE '2024-01-29' THEN 'Updated' ELSE 'Pending' END AS status, 'yesterday' AS rule FROM filled d
    UNION ALL SELECT d.depot, region, latest, date_diff('day', latest, DATE '2024-01-29'),
           CASE WHEN latest IN (DATE '2024-01-29', DATE '2024-01-30') THEN 'Updated' ELSE 'Pending' END, 'recent' FROM filled d""")
def a24(d: Domain):
    return ratios.pending_status(d.depots, d.sheet, "2024-01-30").withColumn("rule", F.lit("yesterday")).unionByName(
        ratios.pending_status(d.depots, d.sheet, "2024-01-30", "recent").withColumn("rule", F.lit("recent")))


STEPS["filled"] = """
    SELECT d.depot, region, max(data_date) AS latest FROM depots d
    LEFT JOIN sheet s ON s.depot = d.depot GROUP BY 1, 2"""


@query("A25_last_filled", "SELECT depot, year(date) AS year, 'Q' || quarter(date) AS quarter, max(date) AS last_date FROM daily GROUP BY 1, 2, 3")
def a25(d: Domain):
    return ratios.last_filled(d.operations.withColumnRenamed("operations_date", "data_date"))


@query("P18_match_labels", """
    SELECT name, label, cls FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY cls, label) AS rn FROM (
        SELECT name, label, CASE WHEN a = b THEN 0 WHEN contains(a, b) OR contains(b, a) THEN 1
                                 WHEN replace(replace(a, ' ', ''), '%', '') = replace(replace(b, ' ', ''), '%', '') THEN 2 END AS cls
        FROM (SELECT DISTINCT p_name AS name, trim(regexp_replace(lower(p_name), '[^a-z0-9%]+', ' ', 'g')) AS a FROM part),
             (SELECT DISTINCT p_type AS label, trim(regexp_replace(lower(p_type), '[^a-z0-9%]+', ' ', 'g')) AS b FROM part)
        WHERE cls IS NOT NULL)) WHERE rn = 1
    UNION ALL SELECT DISTINCT p_name, NULL, NULL FROM part WHERE NOT EXISTS (
        SELECT 1 FROM (SELECT DISTINCT lower(p_type) AS t FROM part) WHERE contains(lower(p_name), t) OR contains(t, lower(p_name)))""")
def p18(d: Domain):
    part = d.raw("part")
    return ratios.match_labels(part.select(F.col("p_name").alias("name")), part.select(F.col("p_type").alias("label")))


# ---- documents -------------------------------------------------------------------
_RAW = ["Total_Drivers", "Actual_KM", "Spot_Absent"]


def kpi_docs(d: Domain):
    return documents.kpi_documents(derive_kpis(d.sheet), _RAW)


STEPS["doc_parts"] = """
    SELECT *, 'input_data_' || depot || '_' || strftime(data_date, '%Y-%m-%d') AS doc_id FROM kpis"""


@query("D01_kpi_documents", """
    SELECT doc_id, depot, data_date, 'On ' || strftime(data_date, '%Y-%m-%d') || ', depot ' || depot || ' had ' || Total_Drivers
        || ' drivers. Available Drivers-1 was ' || available_1 || ' and Available Drivers-2 was ' || available_2
        || '. Attending Drivers were ' || attending || '. Driver shortage was ' || shortage || '. Actual KM was ' || Actual_KM
        || ' giving KM per driver ' || printf('%.2f', round_even(km_per_driver, 2)) || '. Service variance was ' || service_variance || '.' AS text,
        24 AS derived, Spot_Absent::VARCHAR AS raw_spot, km_per_driver AS km_each FROM doc_parts""", "km_each")
def d01(d: Domain):
    return kpi_docs(d).select(
        "doc_id", "depot", "data_date", "text", F.size("calculated_fields").alias("derived"),
        F.col("raw_fields")["Spot_Absent"].alias("raw_spot"), F.col("calculated_fields")["KM/Driver"].alias("km_each"))


@query("D04_document_values", """
    SELECT doc_id, pct_sick AS derived_value, Spot_Absent::DOUBLE AS raw_value, NULL::DOUBLE AS absent_value FROM doc_parts
    WHERE data_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""", "derived_value raw_value")
def d04(d: Domain):
    docs = documents.document_filter(kpi_docs(d), None, "2024-01-05", "2024-01-20")
    return docs.select("doc_id", documents.kpi_value("% Sick Leave").alias("derived_value"),
                       documents.kpi_value("Spot_Absent").alias("raw_value"), documents.kpi_value("nothing").alias("absent_value"))


_STATUS = """
    SELECT m.depot, coalesce(d.category, 'Rural') AS category, value, benchmark,
           CASE WHEN value < benchmark THEN 'CONTROL' WHEN value = benchmark THEN 'WITHIN' ELSE 'RISK' END AS status
    FROM (SELECT depot, round_even(round(avg({k}), 9), 2) AS value FROM kpis GROUP BY 1) m
    LEFT JOIN depots d ON d.depot = m.depot
    LEFT JOIN benchmarks b ON b.category = coalesce(d.category, 'Rural') AND b.kpi = '{k}'"""


@query("A36_kpi_status", _STATUS.format(k="pct_leave"), "value benchmark")
def a36(d: Domain):
    return documents.kpi_status(kpi_docs(d), d.depots, benchmark_table(d.spark), "% Leave & Absent", "pct_leave")


@query("D05_status_default_category", _STATUS.format(k="pct_spot_absent"), "value benchmark")
def d05(d: Domain):
    return documents.kpi_status(kpi_docs(d), d.depots, benchmark_table(d.spark), "% Spot Absent", "pct_spot_absent")
