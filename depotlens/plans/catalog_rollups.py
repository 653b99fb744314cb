"""Aggregation (A) and ranking (T, W24-W27) queries over operations, absences and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from depotlens.operators import joins, rollups
from depotlens.plans.registry import STEPS, query
from depotlens.sources.views import MU_REASONS, SL_REASONS, Domain

STEPS["timed"] = """
    SELECT o.*, date_trunc('month', operations_date)::DATE AS month, hours, plain FROM operations o
    LEFT JOIN duty_hours h ON h.depot = o.depot AND h.service_number = o.service_number"""
STEPS["depot_months"] = """
    SELECT depot, year(month) AS year, month, sum(opd_kms) AS total_km, coalesce(sum(hours), 0) AS total_hours,
           sum(daily_earnings) AS total_earnings FROM timed GROUP BY ALL"""
STEPS["driver_months_raw"] = """
    SELECT depot, employee_id, year(month) AS year, month, sum(opd_kms) AS total_km, coalesce(sum(hours), 0) AS total_hours,
           sum(daily_earnings) AS total_earnings FROM timed GROUP BY ALL"""
STEPS["depot_absent"] = """
    SELECT depot, year(date) AS year, date_trunc('month', date)::DATE AS month, count(*) AS absenteeism
    FROM absences WHERE leave_type IS NOT NULL GROUP BY ALL"""
STEPS["driver_absent"] = """
    SELECT depot, employee_id, year(date) AS year, date_trunc('month', date)::DATE AS month, count(*) AS absenteeism
    FROM absences WHERE leave_type IS NOT NULL GROUP BY ALL"""
STEPS["depot_monthly"] = """
    SELECT m.*, coalesce(absenteeism, 0) AS absenteeism FROM depot_months m
    LEFT JOIN depot_absent a ON a.depot = m.depot AND a.month = m.month"""
STEPS["driver_monthly"] = """
    SELECT m.*, coalesce(absenteeism, 0) AS absenteeism FROM driver_months_raw m
    LEFT JOIN driver_absent a ON a.depot = m.depot AND a.employee_id = m.employee_id AND a.month = m.month"""

ALL = "total_km total_hours total_earnings absenteeism"
_AGG = "{0}(total_km) AS total_km, {0}(total_hours) AS total_hours, {0}(total_earnings) AS total_earnings, {0}(absenteeism) AS absenteeism"


def depot_monthly(d: Domain):
    base = rollups.monthly_rollup(d.operations, d.services, ["depot"])
    return rollups.with_absences(base, rollups.absence_counts(d.absences, ["depot"]), ["depot"])


def driver_monthly(d: Domain):
    keys = ["depot", "employee_id"]
    base = rollups.monthly_rollup(d.operations, d.services, keys)
    return rollups.with_absences(base, rollups.absence_counts(d.absences, keys), keys)


@query("A01_monthly_rollup", "SELECT * FROM depot_months", "total_km total_hours total_earnings")
def a01(d: Domain):
    return rollups.monthly_rollup(d.operations, d.services, ["depot"])


@query("A01_driver_rollup", "SELECT * FROM driver_months_raw", "total_km total_hours total_earnings")
def a01b(d: Domain):
    return rollups.monthly_rollup(d.operations, d.services, ["depot", "employee_id"])


@query("A02_absence_counts", "SELECT depot, year, month, absenteeism FROM depot_monthly")
def a02(d: Domain):
    return depot_monthly(d).select("depot", "year", "month", "absenteeism")


@query("A02_driver_absences", "SELECT depot, employee_id, year, month, absenteeism FROM driver_monthly")
def a02b(d: Domain):
    return driver_monthly(d).select("depot", "employee_id", "year", "month", "absenteeism")


_A03 = """
    SELECT region, n_depots, {months} AS n_months, total_km / n_depots / {months} AS total_km, total_hours / n_depots / {months} AS total_hours,
           total_earnings / n_depots / {months} AS total_earnings, absenteeism / n_depots / {months} AS absenteeism
    FROM (SELECT region, count(DISTINCT month) AS seen, sum(total_km) AS total_km, sum(total_hours) AS total_hours,
                 sum(total_earnings) AS total_earnings, sum(absenteeism) AS absenteeism
          FROM depot_monthly m JOIN depots d ON d.depot = m.depot {where} GROUP BY 1)
    JOIN (SELECT region AS r, count(*) AS n_depots FROM depots GROUP BY 1) ON r = region"""


@query("A03_region_per_depot_month", _A03.format(months="seen", where=""), ALL)
def a03(d: Domain):
    return rollups.region_per_depot_month(depot_monthly(d), d.depots)


@query("A03_region_calendar_year", _A03.format(months="12", where="WHERE year = 1999"), ALL)
def a03b(d: Domain):
    return rollups.region_per_depot_month(depot_monthly(d).filter("year = 1999"), d.depots, months="calendar")


@query("A04_region_mean_of_totals", f"""
    SELECT region, {_AGG.format('avg')} FROM (SELECT depot, {_AGG.format('sum')} FROM depot_monthly GROUP BY 1) t
    JOIN depots d ON d.depot = t.depot GROUP BY 1""", ALL)
def a04(d: Domain):
    return rollups.region_mean_of_totals(depot_monthly(d), d.depots)


@query("A05_region_mean_of_means", f"""
    SELECT region, {_AGG.format('avg')} FROM (SELECT depot, {_AGG.format('avg')} FROM depot_monthly GROUP BY 1) t
    JOIN depots d ON d.depot = t.depot GROUP BY 1""", ALL)
def a05(d: Domain):
    return rollups.region_mean_of_means(depot_monthly(d), d.depots)


_M = ALL.split()


@query("A06_depot_metrics", "SELECT depot, " + ", ".join(f"avg({m}) AS {m}_month, avg({m}) * 12 / 365 AS {m}_day" for m in _M)
       + " FROM depot_monthly GROUP BY 1", " ".join(f"{m}_month {m}_day" for m in _M))
def a06(d: Domain):
    return rollups.depot_metrics(depot_monthly(d))


@query("A07_leave_mix", """
    SELECT leave_type, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM absences
    WHERE leave_type IS NOT NULL GROUP BY 1""", "share", 6)
def a07(d: Domain):
    return rollups.leave_mix(d.absences)


@query("A08_grade_counts", "SELECT final_grading AS grade, count(*) AS n FROM health GROUP BY 1")
def a08(d: Domain):
    return rollups.grade_counts(d.health)


def _label(c: str) -> str:
    return " ".join(w[:1].upper() + w[1:].lower() for w in c.split("_"))


_A09 = " UNION ALL ".join(
    f"SELECT depot, '{g}' AS reason_group, '{_label(c)}' AS reason, sum({c})::BIGINT AS n FROM sheet GROUP BY 1"
    for g, cols in (("medical", MU_REASONS), ("sick", SL_REASONS)) for c in cols)


@query("A09_reason_totals", f"SELECT * FROM ({_A09}) WHERE n <> 0")
def a09(d: Domain):
    return rollups.reason_sums(d.sheet, {"medical": MU_REASONS, "sick": SL_REASONS}, ["depot"])


STEPS["driver_totals"] = f"SELECT depot, employee_id, {_AGG.format('sum')} FROM driver_monthly GROUP BY 1, 2"


@query("A10_driver_summary", "SELECT * REPLACE (absenteeism::BIGINT AS absenteeism) FROM driver_totals", "total_km total_hours total_earnings")
def a10(d: Domain):
    return rollups.driver_summary(driver_monthly(d))


@query("A11_driver_vs_depot", """
    SELECT p.depot, p.employee_id, km_per_day, earnings_per_km, hours_per_day, depot_km_per_day, depot_earnings_per_km,
           depot_hours_per_day, coalesce(l, 0) AS leave_l, coalesce(s, 0) AS leave_s, coalesce(a, 0) AS leave_a
    FROM (SELECT depot, employee_id, avg(opd_kms) AS km_per_day, avg(daily_earnings) / avg(opd_kms) AS earnings_per_km,
                 avg(plain) AS hours_per_day FROM timed GROUP BY 1, 2) p
    JOIN (SELECT depot, avg(opd_kms) AS depot_km_per_day, avg(daily_earnings) / avg(opd_kms) AS depot_earnings_per_km,
                 avg(plain) AS depot_hours_per_day FROM timed GROUP BY 1) q ON q.depot = p.depot
    LEFT JOIN (SELECT employee_id, count(*) FILTER (WHERE leave_type = 'L') AS l, count(*) FILTER (WHERE leave_type = 'S') AS s,
                      count(*) FILTER (WHERE leave_type = 'A') AS a FROM absences GROUP BY 1) x ON x.employee_id = p.employee_id""",
       "km_per_day earnings_per_km hours_per_day depot_km_per_day depot_earnings_per_km depot_hours_per_day")
def a11(d: Domain):
    return rollups.driver_vs_depot(d.operations, d.absences, d.services)


@query("A12_employee_average", """
    SELECT depot, avg(km) AS mean_km, avg(earn) AS mean_earnings, 'totals' AS mode FROM (
        SELECT depot, employee_id, sum(opd_kms) AS km, sum(daily_earnings) AS earn FROM operations GROUP BY 1, 2) GROUP BY 1
    UNION ALL SELECT depot, avg(opd_kms), avg(daily_earnings), 'rows' FROM operations GROUP BY 1""", "mean_km mean_earnings")
def a12(d: Domain):
    return rollups.employee_average(d.operations).withColumn("mode", F.lit("totals")).unionByName(
        rollups.employee_average(d.operations, "rows").withColumn("mode", F.lit("rows")))


@query("A13_driver_months", """
    SELECT s.employee_id, s.month, coalesce(km, 0) AS km, coalesce(earnings, 0) AS earnings,
           sum(coalesce(km, 0)) OVER w AS km_total, avg(coalesce(km, 0)) OVER w AS km_mean,
           sum(coalesce(earnings, 0)) OVER w AS earnings_total, avg(coalesce(earnings, 0)) OVER w AS earnings_mean
    FROM (SELECT employee_id, unnest(generate_series(DATE '1999-04-01', DATE '2000-03-01', INTERVAL 1 MONTH))::DATE AS month
          FROM (SELECT DISTINCT employee_id FROM operations WHERE operations_date BETWEEN DATE '1999-04-01' AND DATE '2000-03-31')) s
    LEFT JOIN (SELECT employee_id, date_trunc('month', operations_date)::DATE AS month, sum(opd_kms) AS km, sum(daily_earnings) AS earnings
               FROM operations GROUP BY 1, 2) m ON m.employee_id = s.employee_id AND m.month = s.month
    WINDOW w AS (PARTITION BY s.employee_id)""", "km earnings km_total km_mean earnings_total earnings_mean")
def a13(d: Domain):
    return rollups.driver_months(d.operations, "1999-04-01", "2000-03-01")


@query("A14_day_night", """
    SELECT s.employee_id, s.month, coalesce(dd, 0) AS day_duties, coalesce(nn, 0) AS night_duties
    FROM (SELECT employee_id, unnest(generate_series(DATE '1999-04-01', DATE '2000-03-01', INTERVAL 1 MONTH))::DATE AS month
          FROM (SELECT DISTINCT employee_id FROM operations WHERE operations_date BETWEEN DATE '1999-04-01' AND DATE '2000-03-31')) s
    LEFT JOIN (SELECT employee_id, date_trunc('month', operations_date)::DATE AS month, count(*) FILTER (WHERE day_night = 'D') AS dd,
                      count(*) FILTER (WHERE day_night = 'N') AS nn FROM operations GROUP BY 1, 2) m
      ON m.employee_id = s.employee_id AND m.month = s.month""")
def a14(d: Domain):
    return rollups.day_night(d.operations, "1999-04-01", "2000-03-01")


def _five(value: str, source: str, group: str) -> str:
    qs = (("low", 0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("high", 1))
    return f"SELECT {group}, " + ", ".join(f"quantile_cont({value}, {p}) AS {n}" for n, p in qs) + f" FROM {source} GROUP BY 1"


@query("A15_hours_by_grade", _five("hours", "driver_hours h JOIN health g ON g.employee_id = h.employee_id", "final_grading"),
       "low q1 median q3 high")
def a15(d: Domain):
    graded = joins.hours_by_grade(joins.hours_by_employee(d.operations, d.services), d.health).filter("final_grading IS NOT NULL")
    return rollups.five_numbers(graded, "final_grading", "hours")


@query("A15_earnings_by_depot", _five("daily_earnings", "operations", "depot"), "low q1 median q3 high")
def a15b(d: Domain):
    return rollups.five_numbers(d.operations, "depot", "daily_earnings", stage=False)


@query("A26_dedupe_duties", """
    SELECT employee_id, operations_date, depot, service_number, min(steering_hours) AS steering_hours, sum(opd_kms) AS opd_kms,
           min(hours_source) AS hours_source FROM steered GROUP BY 1, 2, 3, 4""", "steering_hours")
def a26(d: Domain):
    return rollups.dedupe_duties(joins.with_steering(d.operations, d.steering))


STEPS["duties"] = """
    SELECT employee_id, operations_date, min(steering_hours) AS h, min(hours_source) AS src
    FROM steered GROUP BY employee_id, operations_date, depot, service_number"""
STEPS["duty_cells"] = """
    SELECT employee_id, operations_date AS date, round_even(round(coalesce(sum(h), 0), 9), 0)::BIGINT AS hours FROM duties GROUP BY 1, 2"""


@query("A27_steering_pivot", """
    SELECT employee_id, date, CASE WHEN grouping(employee_id) + grouping(date) = 2 THEN 'total' WHEN grouping(date) = 1 THEN 'employee'
                                   WHEN grouping(employee_id) = 1 THEN 'date' ELSE 'cell' END AS part, sum(hours)::BIGINT AS hours
    FROM duty_cells GROUP BY CUBE (employee_id, date)""")
def a27(d: Domain):
    return rollups.steering_pivot(rollups.dedupe_duties(joins.with_steering(d.operations, d.steering)))


@query("A28_estimated_mask", """
    SELECT employee_id, operations_date AS date, max(CASE WHEN src <> 'Actual' THEN 1 ELSE 0 END) AS estimated FROM duties GROUP BY 1, 2""")
def a28(d: Domain):
    return rollups.estimated_mask(rollups.dedupe_duties(joins.with_steering(d.operations, d.steering)))


@query("A29_entity_averages", """
    SELECT e.depot, employee_id, emp_avg_km, emp_avg_earnings, depot_avg_km, depot_avg_earnings FROM
        (SELECT depot, employee_id, avg(opd_kms) AS emp_avg_km, avg(daily_earnings) AS emp_avg_earnings FROM operations GROUP BY 1, 2) e
    JOIN (SELECT depot, avg(opd_kms) AS depot_avg_km, avg(daily_earnings) AS depot_avg_earnings FROM operations GROUP BY 1) d
      ON d.depot = e.depot""", "emp_avg_km emp_avg_earnings depot_avg_km depot_avg_earnings")
def a29(d: Domain):
    return rollups.entity_averages(d.operations)


@query("A30_mean_daily_pkm", """
    SELECT depot, avg(s) AS mean_pkm FROM (SELECT depot, date, sum(passenger_kms) AS s FROM service_daily GROUP BY 1, 2) GROUP BY 1""", "mean_pkm")
def a30(d: Domain):
    return rollups.mean_daily(d.service_daily, "passenger_kms", "mean_pkm")


@query("A31_distinct_counts", """
    SELECT depot, count(DISTINCT date_trunc('month', operations_date)) AS months, count(DISTINCT operations_date) AS days,
           count(DISTINCT employee_id) AS drivers FROM operations GROUP BY 1""")
def a31(d: Domain):
    return d.operations.groupBy("depot").agg(
        F.countDistinct(F.trunc("operations_date", "MM")).alias("months"), F.countDistinct("operations_date").alias("days"),
        F.countDistinct("employee_id").alias("drivers"))


@query("A32_clip_iqr", """
    SELECT g.depot, date, least(greatest(passenger_kms, q1 - 3 * (q3 - q1)), q3 + 3 * (q3 - q1)) AS passenger_kms FROM gold g
    JOIN (SELECT depot, quantile_cont(passenger_kms, 0.25) AS q1, quantile_cont(passenger_kms, 0.75) AS q3 FROM gold GROUP BY 1) q
      ON q.depot = g.depot""", "passenger_kms")
def a32(d: Domain):
    return rollups.clip_iqr(d.gold, "depot", "passenger_kms").select("depot", "date", "passenger_kms")


@query("A33_rolling_or", """
    SELECT depot, CASE WHEN count(*) FILTER (WHERE date >= cut) >= 5
                       THEN round_even(round(avg(occupancy_ratio) FILTER (WHERE date >= cut), 9), 4) ELSE 0.85 END AS rolling_or
    FROM gold, (SELECT max(date) - 30 AS cut FROM gold) GROUP BY 1""", "rolling_or")
def a33(d: Domain):
    return rollups.rolling_or(d.daily)


@query("A35_monthly_fit", """
    SELECT depot, date_trunc('month', date)::DATE AS month, avg(passenger_kms) AS actual, avg(predicted_passenger_kms) AS predicted
    FROM gold g JOIN ledger l ON l.depot = g.depot AND l.prediction_date = g.date GROUP BY ALL""".replace("SELECT depot", "SELECT g.depot"),
       "actual predicted", digits=9)
def a35(d: Domain):
    both = d.gold.join(d.ledger.withColumnRenamed("prediction_date", "date"), ["depot", "date"])
    return both.groupBy("depot", F.trunc("date", "MM").alias("month")).agg(
        F.avg("passenger_kms").alias("actual"), F.avg("predicted_passenger_kms").alias("predicted"))


@query("A37_compare_depots", "SELECT month, " + ", ".join(
    f"coalesce(sum({m}) FILTER (WHERE depot = '{x}'), 0) AS {m}_{s}" for m in _M for s, x in (("a", "NATION_3"), ("b", "NATION_8")))
    + " FROM depot_monthly WHERE depot IN ('NATION_3', 'NATION_8') GROUP BY 1", " ".join(f"{m}_{s}" for m in _M for s in "ab"))
def a37(d: Domain):
    return rollups.compare_depots(depot_monthly(d), "NATION_3", "NATION_8")


@query("A38_levels", """
    SELECT region, category, s.depot, grouping(region, category, s.depot)::BIGINT AS level, sum(Total_Drivers)::BIGINT AS drivers,
           sum(Total_Drivers)::DOUBLE / sum(Planned_Schedules) AS per_schedule
    FROM sheet s JOIN depots d ON d.depot = s.depot GROUP BY ROLLUP (region, category, s.depot)""", "per_schedule")
def a38(d: Domain):
    base = d.sheet.groupBy("depot").agg(F.sum("Total_Drivers").alias("t"), F.sum("Planned_Schedules").alias("p"))
    return base.join(d.depots, "depot").rollup("region", "category", "depot").agg(
        F.grouping_id().alias("level"), F.sum("t").alias("drivers"), (F.sum("t") / F.sum("p")).alias("per_schedule"))


# ---- rankings -------------------------------------------------------------------
STEPS["performance"] = """
    SELECT depot, p.employee_id, km, earnings, coalesce(hours, 0) AS hours, coalesce(leaves, 0) AS leaves
    FROM (SELECT depot, employee_id, sum(opd_kms) AS km, sum(daily_earnings) AS earnings FROM operations GROUP BY 1, 2) p
    LEFT JOIN driver_hours h ON h.employee_id = p.employee_id LEFT JOIN leave_counts l ON l.employee_id = p.employee_id"""
_UNIT = "coalesce(({0} - min({0}) OVER w) / nullif(max({0}) OVER w - min({0}) OVER w, 0), 0)".format
STEPS["scored"] = f"""
    SELECT depot, employee_id, km, earnings, hours, leaves, {_UNIT('km')} + {_UNIT('earnings')} + {_UNIT('hours')} - {_UNIT('leaves')} AS score
    FROM performance WINDOW w AS (PARTITION BY depot)"""


@query("W24_driver_score", "SELECT * FROM scored", "earnings hours score")
def w24(d: Domain):
    return rollups.driver_score(rollups.driver_performance(d.operations, d.services, d.absences))


@query("W25_rank", "SELECT employee_id, total_km, row_number() OVER (ORDER BY total_km DESC, employee_id) AS rank FROM driver_totals")
def w25(d: Domain):
    totals = d.operations.groupBy("employee_id").agg(F.sum("opd_kms").alias("total_km"))
    return rollups.ranked(totals, "total_km", ["employee_id"])


@query("W25_rank_days", "SELECT depot, date, actual_kms, row_number() OVER (ORDER BY actual_kms DESC, depot, date) AS rank FROM daily")
def w25b(d: Domain):
    return rollups.ranked(d.daily.select("depot", "date", "actual_kms"), "actual_kms", ["depot", "date"])


@query("T04_top_bottom", """
    SELECT depot, employee_id, total_km, place, side FROM (
        SELECT depot, employee_id, total_km, row_number() OVER (PARTITION BY depot ORDER BY total_km DESC, employee_id) AS place, 'top' AS side FROM driver_totals
        UNION ALL SELECT depot, employee_id, total_km, row_number() OVER (PARTITION BY depot ORDER BY total_km, employee_id), 'bottom' FROM driver_totals)
    WHERE place <= 5""")
def t04(d: Domain):
    totals = d.operations.groupBy("depot", "employee_id").agg(F.sum("opd_kms").alias("total_km"))
    return rollups.top_bottom(totals, "total_km", ["employee_id"], keys=["depot"])


@query("T04_absence_reversed", """
    SELECT employee_id, leaves, place, side FROM (
        SELECT *, row_number() OVER (ORDER BY leaves, employee_id) AS place, 'top' AS side FROM leave_counts
        UNION ALL SELECT *, row_number() OVER (ORDER BY leaves DESC, employee_id), 'bottom' FROM leave_counts) WHERE place <= 5""")
def t04b(d: Domain):
    counts = d.absences.filter("leave_type IS NOT NULL").groupBy("employee_id").agg(F.count("*").alias("leaves"))
    return rollups.top_bottom(counts, "leaves", ["employee_id"], low_is_best=True)


@query("T05_top_bottom_score", """
    SELECT depot, employee_id, score, place, side FROM (
        SELECT *, row_number() OVER (PARTITION BY depot ORDER BY round(score, 9) DESC, employee_id) AS place, 'top' AS side FROM scored
        UNION ALL SELECT *, row_number() OVER (PARTITION BY depot ORDER BY round(score, 9), employee_id), 'bottom' FROM scored) WHERE place <= 5""", "score")
def t05(d: Domain):
    scored = rollups.driver_score(rollups.driver_performance(d.operations, d.services, d.absences))
    return rollups.top_bottom(scored.select("depot", "employee_id", F.round("score", 9).alias("score")), "score", ["employee_id"], keys=["depot"])


@query("T06_latest_row", """
    SELECT depot, date, actual_kms FROM (SELECT *, row_number() OVER (PARTITION BY depot ORDER BY date DESC) AS rn FROM daily) WHERE rn = 1""")
def t06(d: Domain):
    return d.daily.groupBy("depot").agg(F.max(F.struct("date", "actual_kms")).alias("r")).select("depot", "r.*")


@query("T08_sorted_distinct", "SELECT DISTINCT year(operations_date) AS year, region FROM operations o JOIN depots d ON d.depot = o.depot")
def t08(d: Domain):
    pairs = d.operations.select(F.year("operations_date").alias("year"), "depot").distinct()
    return pairs.join(d.depots, "depot").select("year", "region").distinct().orderBy("year", "region")


@query("W26_last_rows", """
    SELECT employee_id, date, leave_type, age FROM (
        SELECT employee_id, date, leave_type, row_number() OVER (PARTITION BY employee_id ORDER BY date DESC, leave_type DESC) AS age
        FROM (SELECT DISTINCT employee_id, date, leave_type FROM absences WHERE leave_type IS NOT NULL)) WHERE age <= 15""")
def w26(d: Domain):
    return last_rows(d.absences.filter("leave_type IS NOT NULL").select("employee_id", "date", "leave_type").distinct(),
                     ["employee_id"], ["date", "leave_type"], 15)


def last_rows(df, keys, order, n):
    """Last n rows per key; the limit is applied on both sides of the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= n)


@query("W27_first_per_key", """
    SELECT depot, service_number, operations_date, trip_id FROM (
        SELECT *, row_number() OVER (PARTITION BY depot, service_number ORDER BY operations_date, trip_id) AS rn FROM operations) WHERE rn = 1""")
def w27(d: Domain):
    return joins.first_per_key(d.operations.select("depot", "service_number", "operations_date", "trip_id"),
                               ["depot", "service_number"], ["operations_date", "trip_id"])


@query("T01_multi_sort", """
    SELECT depot, service_number, planned_trips, km_per_trip FROM services ORDER BY planned_trips DESC, km_per_trip, depot, service_number""")
def t01(d: Domain):
    return d.services.select("depot", "service_number", "planned_trips", "km_per_trip").orderBy(
        F.desc("planned_trips"), "km_per_trip", "depot", "service_number")
