"""Join (J) queries, duty-hour look-ups included."""

from __future__ import annotations

from pyspark.sql import functions as F

from depotlens.operators import joins, quality
from depotlens.plans.registry import STEPS, query
from depotlens.sources.views import Domain

STEPS["service_once"] = """
    SELECT service_number, dep_sec, arr_sec, abs(arr_sec - dep_sec) / 3600::DOUBLE AS plain
    FROM (SELECT *, row_number() OVER (PARTITION BY service_number ORDER BY dep_sec, arr_sec) AS rn FROM services) WHERE rn = 1"""
STEPS["shares"] = """
    SELECT depot, service_number, steering_hours / coalesce(nullif(no_of_drvs, 0), 1) AS share FROM steering"""
STEPS["steered"] = """
    SELECT o.depot, o.service_number, operations_date, employee_id, opd_kms,
           CASE WHEN share IS NULL THEN 'Estimated (Median)' ELSE 'Actual' END AS hours_source,
           coalesce(share, (SELECT quantile_cont(share, 0.5) FROM operations x JOIN shares y
                            ON y.depot = x.depot AND y.service_number = x.service_number)) AS steering_hours
    FROM operations o LEFT JOIN shares s ON s.depot = o.depot AND s.service_number = o.service_number"""


@query("J01_with_depot", "SELECT f.depot, date, actual_kms, region, zone, category FROM daily f JOIN depots d ON d.depot = f.depot")
def j01(d: Domain):
    return joins.with_depot(d.daily.select("depot", "date", "actual_kms"), d.depots)


@query("J02_with_service", """
    SELECT f.depot, date, f.service_number, actual_trips, dep_sec, arr_sec, day_night_code
    FROM service_daily f LEFT JOIN services s ON s.depot = f.depot AND s.service_number = f.service_number""")
def j02(d: Domain):
    return joins.with_service(d.service_daily.select("depot", "date", "service_number", "actual_trips"), d.services)


@query("J03_hours_by_service", """
    SELECT f.depot, f.service_number, n, plain AS hours FROM
        (SELECT depot, service_number, count(*) AS n FROM operations GROUP BY 1, 2) f
    LEFT JOIN service_once s ON s.service_number = f.service_number""", "hours")
def j03(d: Domain):
    counts = d.operations.groupBy("depot", "service_number").agg(F.count("*").alias("n"))
    return joins.with_hours(counts, d.services, "abs", keys=("service_number",))


@query("J04_with_calendars", """
    SELECT depot, date, actual_kms, telugu_thithi, telugu_paksham, telugu_month, marriage_day, moudyami_day,
           fes_hol_code, holiday_festival, fes_hol_category, is_fes_hol FROM gold""")
def j04(d: Domain):
    return joins.with_calendars(d.daily.select("depot", "date", "actual_kms"), d.lunar, d.holidays)


@query("J04_service_gold", """
    SELECT f.depot, f.date, service_number, actual_kms, passenger_kms, coalesce(fes_hol_code, 0) AS fes_hol_code,
           CASE WHEN fes_hol_code IS NULL THEN 0 ELSE 1 END AS is_fes_hol, telugu_thithi
    FROM service_daily f LEFT JOIN lunar l ON l.date = f.date LEFT JOIN holidays h ON h.date = f.date""", "passenger_kms")
def j04b(d: Domain):
    return joins.build_service_gold(d.service_daily, d.lunar, d.holidays).select(
        "depot", "date", "service_number", "actual_kms", "passenger_kms", "fes_hol_code", "is_fes_hol", "telugu_thithi")


@query("J05_passenger_kms", "SELECT depot, date, passenger_kms FROM gold", "passenger_kms")
def j05(d: Domain):
    return joins.with_passenger_kms(d.daily, d.depots).select("depot", "date", "passenger_kms")


@query("J06_with_steering", "SELECT depot, service_number, hours_source, steering_hours, count(*) AS n FROM steered GROUP BY ALL",
       "steering_hours")
def j06(d: Domain):
    rows = joins.with_steering(d.operations.select("depot", "service_number"), d.steering)
    return rows.groupBy("depot", "service_number", "hours_source", "steering_hours").agg(F.count("*").alias("n"))


@query("P15_steering_hours", """
    SELECT employee_id, sum(steering_hours) AS hours, count(*) FILTER (WHERE hours_source <> 'Actual') AS estimated
    FROM steered GROUP BY 1""", "hours")
def p15(d: Domain):
    combined = joins.with_steering(d.operations.select("employee_id", "depot", "service_number"), d.steering)
    return combined.groupBy("employee_id").agg(
        F.sum("steering_hours").alias("hours"), F.count_if(F.col("hours_source") != "Actual").alias("estimated"))


@query("J07_with_health", """
    SELECT o.employee_id, o.depot, final_grading, sum(opd_kms) AS km, max(risk_score) AS risk_score
    FROM operations o JOIN health h ON h.employee_id = o.employee_id AND h.depot = o.depot GROUP BY 1, 2, 3""")
def j07(d: Domain):
    per = d.operations.groupBy("employee_id", "depot").agg(F.sum("opd_kms").alias("km"))
    return joins.with_health(per, d.health)


STEPS["driver_hours"] = """
    SELECT employee_id, coalesce(sum(plain), 0) AS hours FROM operations o
    LEFT JOIN service_once s ON s.service_number = o.service_number GROUP BY 1"""


@query("J08_hours_by_grade", """
    SELECT h.employee_id, hours, final_grading FROM driver_hours h
    LEFT JOIN health g ON g.employee_id = h.employee_id""", "hours")
def j08(d: Domain):
    return joins.hours_by_grade(joins.hours_by_employee(d.operations, d.services), d.health)


STEPS["leave_counts"] = "SELECT employee_id, count(*) AS leaves FROM absences WHERE leave_type IS NOT NULL GROUP BY 1"


@query("J09_leaves_by_grade", """
    SELECT coalesce(l.employee_id, g.employee_id) AS employee_id, leaves, final_grading, 'full' AS how
    FROM leave_counts l FULL JOIN health g ON g.employee_id = l.employee_id
    UNION ALL SELECT l.employee_id, leaves, final_grading, 'inner' FROM leave_counts l JOIN health g ON g.employee_id = l.employee_id""")
def j09(d: Domain):
    return joins.leaves_by_grade(d.absences, d.health, "full").withColumn("how", F.lit("full")).unionByName(
        joins.leaves_by_grade(d.absences, d.health, "inner").withColumn("how", F.lit("inner")))


@query("J11_latest_by_depot", """
    SELECT d.depot, region, max(date) AS latest FROM depots d
    LEFT JOIN absences a ON a.depot = d.depot GROUP BY 1, 2""")
def j11(d: Domain):
    return joins.latest_by_depot(d.depots, d.absences, "date")


@query("J12_not_in", "SELECT depot, date, actual_kms FROM daily f WHERE NOT EXISTS (FROM weather w WHERE w.depot = f.depot AND w.date = f.date)")
def j12(d: Domain):
    return joins.not_in(d.daily.select("depot", "date", "actual_kms"), d.weather, ["depot", "date"])


@query("J13_next_unseen_date", """
    SELECT depot, min(prediction_date) AS date FROM ledger l WHERE NOT EXISTS (
        FROM daily x WHERE x.depot = l.depot AND x.date = l.prediction_date) GROUP BY 1""")
def j13(d: Domain):
    return joins.next_unseen_date(d.ledger.select("depot", F.col("prediction_date").alias("date")), d.daily)


@query("J14_exists_flag", """
    SELECT depot, prediction_date AS date, CASE WHEN EXISTS (FROM daily x WHERE x.depot = l.depot AND x.date = l.prediction_date)
           THEN 1 ELSE 0 END AS has_actual FROM ledger l""")
def j14(d: Domain):
    return joins.exists_flag(d.ledger.select("depot", F.col("prediction_date").alias("date")), d.daily, ["depot", "date"], "has_actual")


@query("J15_dense_months", """
    SELECT s.depot, s.day_night, s.month, coalesce(n, 0) AS n FROM (
        SELECT depot, day_night, unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH))::DATE AS month
        FROM (SELECT DISTINCT depot, day_night FROM operations)) s
    LEFT JOIN (SELECT depot, day_night, date_trunc('month', operations_date)::DATE AS month, count(*) AS n FROM operations GROUP BY 1, 2, 3) c
      ON c.depot = s.depot AND c.day_night = s.day_night AND c.month = s.month""")
def j15(d: Domain):
    counts = d.operations.groupBy("depot", "day_night", F.trunc("operations_date", "MM").alias("month")).agg(F.count("*").alias("n"))
    return joins.dense_months(counts, ["depot", "day_night"], "1995-01-01", "2001-12-01", ["n"])


@query("J16_with_weather", """
    SELECT f.depot, f.date, actual_kms, max_temp, min_temp, daily_rainfall FROM daily f
    LEFT JOIN weather w ON w.depot = f.depot AND w.date = f.date""", "max_temp min_temp")
def j16(d: Domain):
    return joins.with_weather(d.daily.select("depot", "date", "actual_kms"), d.weather)


@query("J17_asof_weather", """
    SELECT f.depot, f.date, w.date AS weather_date, max_temp, min_temp, daily_rainfall FROM daily f
    ASOF LEFT JOIN weather w ON w.depot = f.depot AND f.date >= w.date""", "max_temp min_temp")
def j17(d: Domain):
    return joins.asof_weather(d.daily, d.weather)


@query("J18_lookup_default", """
    SELECT f.depot, date, coalesce(category, 'Unknown') AS category FROM daily f
    LEFT JOIN depots d ON d.depot = f.depot""")
def j18(d: Domain):
    return joins.lookup(d.daily.select("depot", "date"), d.depots, "depot", "category")


STEPS["typed_names"] = """
    SELECT DISTINCT CASE c_custkey % 5 WHEN 0 THEN lower(n_name) WHEN 1 THEN 'Depot ' || n_name
        WHEN 2 THEN replace(n_name, '_', ' ') || ' bus' WHEN 3 THEN split_part(n_name, '_', 2) || ' nation' ELSE replace(n_name, 'NATION', 'NATOIN') END AS name
    FROM customer JOIN nation ON c_nationkey = n_nationkey"""
STEPS["name_pairs"] = """
    SELECT name, depot, k, dk, array_to_string(list_filter(a, lambda t: list_contains(b, t)), ' ') AS common,
           trim(common || ' ' || array_to_string(list_filter(a, lambda t: NOT list_contains(b, t)), ' ')) AS l,
           trim(common || ' ' || array_to_string(list_filter(b, lambda t: NOT list_contains(a, t)), ' ')) AS r, len(a) AS n
    FROM (SELECT name, upper(trim(name)) AS k, depot, upper(depot) AS dk,
                 list_sort(list_filter(list_distinct(regexp_split_to_array(upper(name), '[^A-Z0-9]+')), lambda x: x <> '')) AS a,
                 list_sort(list_filter(list_distinct(regexp_split_to_array(upper(depot), '[^A-Z0-9]+')), lambda x: x <> '')) AS b
          FROM typed_names, (SELECT DISTINCT depot FROM depots))"""
_ALIKE = "100 - levenshtein({0}, {1}) * 100::DOUBLE / greatest(length({0}), length({1}), 1)".format
STEPS["name_scores"] = f"""
    SELECT name, depot, CASE WHEN k = dk THEN 0 WHEN contains(k, dk) OR contains(dk, k) THEN 1 ELSE 2 END AS cls,
           CASE WHEN k = dk OR contains(k, dk) OR contains(dk, k) THEN 100 WHEN n = 0 THEN 0 WHEN common = '' THEN {_ALIKE('l', 'r')}
                ELSE greatest({_ALIKE('common', 'l')}, {_ALIKE('common', 'r')}, {_ALIKE('l', 'r')}) END AS score FROM name_pairs"""


@query("J19_fuzzy_depot", """
    SELECT n.name, depot, score FROM typed_names n LEFT JOIN (
        SELECT *, row_number() OVER (PARTITION BY name ORDER BY cls, score DESC, depot) AS rn FROM name_scores WHERE score >= 70) s
      ON s.name = n.name AND rn = 1""", "score")
def j19(d: Domain):
    nation = d.raw("nation")
    k = F.col("c_custkey") % 5
    name = (
        F.when(k == 0, F.lower("n_name")).when(k == 1, F.concat(F.lit("Depot "), "n_name"))
        .when(k == 2, F.concat(F.regexp_replace("n_name", "_", " "), F.lit(" bus")))
        .when(k == 3, F.concat(F.split_part(F.col("n_name"), F.lit("_"), F.lit(2)), F.lit(" nation")))
        .otherwise(F.replace(F.col("n_name"), F.lit("NATION"), F.lit("NATOIN")))
    )
    typed = d.raw("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(name.alias("name"))
    return joins.fuzzy_depot(typed, d.depots)


@query("J20_employee_sums", """
    SELECT employee_id, sum(opd_kms) AS kms, coalesce(sum(share), 0) AS hours FROM operations o
    LEFT JOIN shares s ON s.depot = o.depot AND s.service_number = o.service_number GROUP BY 1""", "hours")
def j20(d: Domain):
    return joins.employee_sums(d.operations, d.steering)


@query("J21_actual_vs_predicted", """
    SELECT g.depot, g.date, passenger_kms AS actual, predicted_passenger_kms AS predicted,
           passenger_kms - predicted_passenger_kms AS variance
    FROM gold g JOIN ledger l ON l.depot = g.depot AND l.prediction_date = g.date""", "actual predicted variance")
def j21(d: Domain):
    actual = d.gold.select("depot", "date", F.col("passenger_kms").alias("actual"))
    predicted = d.ledger.select("depot", F.col("prediction_date").alias("date"), F.col("predicted_passenger_kms").alias("predicted"))
    return joins.actual_vs_predicted(actual, predicted, ["depot", "date"])


@query("J22_with_global", """
    SELECT depot, date, actual_kms, avg(actual_kms) OVER () AS mean_km, min(actual_kms) OVER () AS low, max(actual_kms) OVER () AS high
    FROM daily""", "mean_km")
def j22(d: Domain):
    return joins.with_global(d.daily.select("depot", "date", "actual_kms"), {
        "mean_km": F.avg("actual_kms"), "low": F.min("actual_kms"), "high": F.max("actual_kms")})
