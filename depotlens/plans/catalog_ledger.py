"""Ledger and accuracy (E), prediction records and metrics (F03, F06, F09-F13, F17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from depotlens.operators import ledger as lg
from depotlens.operators import rollups
from depotlens.plans.catalog_supply import slot_plan
from depotlens.plans.registry import STEPS, query
from depotlens.sources.views import Domain

_R = "actual_passenger_kms actual_or actual_kms pkm_error pkm_error_pct km_error km_error_pct estimated_kms predicted_passenger_kms assumed_or"
STEPS["closed"] = """
    SELECT l.depot, l.prediction_date, predicted_passenger_kms, assumed_or, bus_capacity, estimated_kms,
           CASE WHEN hit THEN 'completed' ELSE status END AS status,
           CASE WHEN hit THEN passenger_kms END AS actual_passenger_kms, CASE WHEN hit THEN occupancy_ratio END AS actual_or,
           CASE WHEN hit THEN actual_kms END AS actual_kms,
           CASE WHEN hit AND predicted_passenger_kms <> 0 AND passenger_kms <> 0 THEN predicted_passenger_kms - passenger_kms END AS pkm_error,
           CASE WHEN hit AND passenger_kms > 0 AND predicted_passenger_kms <> 0
                THEN (predicted_passenger_kms - passenger_kms) * 100 / passenger_kms END AS pkm_error_pct,
           CASE WHEN hit AND actual_kms > 0 AND estimated_kms <> 0 THEN estimated_kms - actual_kms END AS km_error,
           CASE WHEN hit AND actual_kms > 0 AND estimated_kms <> 0 THEN (estimated_kms - actual_kms) * 100 / actual_kms END AS km_error_pct
    FROM (SELECT l.*, status = 'pending' AND g.depot IS NOT NULL AS hit, passenger_kms, occupancy_ratio, actual_kms
          FROM ledger l LEFT JOIN gold g ON g.depot = l.depot AND g.date = l.prediction_date) l"""


def closed(d: Domain):
    return lg.close_pending(d.ledger, lg.ledger_actuals(d.gold))


@query("A34_ledger_actuals", """
    SELECT depot, date, avg(occupancy_ratio) AS occupancy_ratio, sum(passenger_kms) AS passenger_kms, sum(actual_kms) AS actual_kms
    FROM service_daily GROUP BY 1, 2""", "occupancy_ratio passenger_kms")
def a34(d: Domain):
    return lg.ledger_actuals(d.service_daily)


@query("E01_close_pending", "SELECT * FROM closed", _R)
def e01(d: Domain):
    return closed(d)


@query("E02_demand_accuracy", """
    SELECT depot, prediction_date, predicted_passenger_kms AS predicted, actual_passenger_kms AS actual, pkm_error AS error,
           pkm_error_pct AS error_pct, status FROM closed""", "predicted actual error error_pct")
def e02(d: Domain):
    return lg.accuracy_table(closed(d), "demand")


@query("E02_supply_accuracy", """
    SELECT depot, prediction_date, estimated_kms AS predicted, actual_kms AS actual, km_error AS error, km_error_pct AS error_pct, status
    FROM closed WHERE status = 'completed' AND actual_kms IS NOT NULL""", "predicted actual error error_pct")
def e02b(d: Domain):
    return lg.accuracy_table(closed(d), "supply")


@query("E03_accuracy_metrics", """
    SELECT count(*) AS records, round_even(round(avg(km_error_pct), 9), 1) AS mean_error, round_even(round(avg(abs(km_error_pct)), 9), 1) AS mean_abs_error,
           round_even(round(median(abs(km_error_pct)), 9), 1) AS median_abs_error,
           round_even(avg(CASE WHEN abs(km_error_pct) <= 10 THEN 1 ELSE 0 END) * 100, 1) AS within_10,
           round_even(avg(CASE WHEN abs(km_error_pct) <= 20 THEN 1 ELSE 0 END) * 100, 1) AS within_20
    FROM closed WHERE km_error_pct IS NOT NULL""", "mean_error mean_abs_error median_abs_error within_10 within_20")
def e03(d: Domain):
    return lg.accuracy_metrics(lg.accuracy_table(closed(d), "supply"))


# ---- schedule against actuals -----------------------------------------------------
STEPS["ran"] = """
    SELECT depot, service_number, sum(passenger_kms) AS actual_pkm, sum(revenue) AS actual_revenue FROM service_daily
    WHERE date >= DATE '2001-10-21' GROUP BY 1, 2"""
STEPS["matched"] = """
    SELECT coalesce(p.depot, a.depot) AS depot, coalesce(p.service_number, a.service_number) AS service_number, p.action, allocated_pkm,
           revenue, actual_pkm, actual_revenue, actual_pkm - allocated_pkm AS pkm_delta,
           (actual_pkm - allocated_pkm) * 100 / nullif(allocated_pkm, 0) AS pkm_delta_pct,
           CASE WHEN a.depot IS NULL THEN 'Scheduled (No Actuals)' WHEN p.depot IS NOT NULL THEN 'Scheduled'
                WHEN regexp_full_match(a.service_number, '[89][0-9]{3}') THEN 'Extra Service' ELSE 'New Service' END AS category
    FROM slot_plan p FULL JOIN ran a ON a.depot = p.depot AND a.service_number = p.service_number"""


def matched(d: Domain):
    ran = d.written("service_daily").filter(F.col("date") >= F.lit("2001-10-21").cast("date")).groupBy("depot", "service_number").agg(
        F.sum("passenger_kms").alias("actual_pkm"), F.sum("revenue").alias("actual_revenue"))
    plan = slot_plan(d).select("depot", "service_number", "action", "allocated_pkm", "revenue")
    return lg.match_schedule(plan, ran, ["depot", "service_number"])


@query("J10_match_schedule", "SELECT * FROM matched", "allocated_pkm revenue actual_pkm actual_revenue pkm_delta pkm_delta_pct", 3)
def j10(d: Domain):
    return matched(d)


@query("E04_schedule_vs_actual", """
    SELECT *, actual - allocated AS pkm_delta, coalesce((actual - allocated) * 100 / nullif(allocated, 0), 0) AS pkm_delta_pct,
           earnings - predicted_revenue AS revenue_delta, coalesce((earnings - predicted_revenue) * 100 / nullif(predicted_revenue, 0), 0) AS revenue_delta_pct
    FROM (SELECT depot, count(*) FILTER (WHERE category LIKE 'Scheduled%') AS scheduled, count(*) FILTER (WHERE category <> 'Scheduled (No Actuals)') AS run,
                 count(*) FILTER (WHERE category = 'Extra Service') AS extra, count(*) FILTER (WHERE category = 'New Service') AS new,
                 count(*) FILTER (WHERE action = 'ADD_SLOT') AS add_slot, count(*) FILTER (WHERE action = 'CUT') AS cut,
                 coalesce(sum(allocated_pkm), 0) AS allocated, coalesce(sum(actual_pkm), 0) AS actual,
                 coalesce(sum(revenue), 0) AS predicted_revenue, coalesce(sum(actual_revenue), 0) AS earnings FROM matched GROUP BY 1)""",
       "allocated actual predicted_revenue earnings pkm_delta pkm_delta_pct revenue_delta revenue_delta_pct", 3)
def e04(d: Domain):
    return lg.schedule_vs_actual(matched(d))


@query("T03_match_order", """
    SELECT depot, service_number, category, action, CASE category WHEN 'New Service' THEN 3 WHEN 'Extra Service' THEN 4
           WHEN 'Scheduled (No Actuals)' THEN 5 ELSE CASE action WHEN 'ADD_SLOT' THEN 0 WHEN 'NO_CHANGE' THEN 1 WHEN 'CUT' THEN 2 END END AS sort_key
    FROM matched""")
def t03(d: Domain):
    key = lg.match_order(F.col("category"), F.col("action"))
    return matched(d).select("depot", "service_number", "category", "action", key.alias("sort_key")).orderBy("sort_key", "service_number", "depot")


# A seven-day mean stands in for a model so that the comparison itself can be checked.
STEPS["absence_pairs"] = """
    SELECT depot, data_date AS date, Leave_Absent AS leave, Sick_Leave AS sick, Spot_Absent AS spot,
           avg(Leave_Absent) OVER w AS pred_leave, avg(Sick_Leave) OVER w AS pred_sick, avg(Spot_Absent) OVER w AS pred_spot
    FROM sheet WINDOW w AS (PARTITION BY depot ORDER BY data_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"""


@query("E05_absence_variance", """
    SELECT depot, date, leave + sick + spot AS actual_total, pred_leave + pred_sick + pred_spot AS pred_total,
           leave + sick + spot - (pred_leave + pred_sick + pred_spot) AS total_variance
    FROM (SELECT *, row_number() OVER (PARTITION BY depot ORDER BY date DESC) AS age FROM absence_pairs)
    WHERE age <= 15 QUALIFY row_number() OVER (PARTITION BY depot ORDER BY date) > 1""", "pred_total total_variance")
def e05(d: Domain):
    from pyspark.sql import Window

    sheet = d.sheet.select("depot", F.col("data_date").alias("date"), F.col("Leave_Absent").alias("leave"),
                           F.col("Sick_Leave").alias("sick"), F.col("Spot_Absent").alias("spot"))
    week = Window.partitionBy("depot").orderBy("date").rowsBetween(-7, -1)
    pred = sheet.select("depot", "date", *[F.avg(c).over(week).alias(f"pred_{c}") for c in ("leave", "sick", "spot")])
    return lg.absence_variance(sheet, pred)


# ---- prediction records --------------------------------------------------------------
STEPS["loads"] = """
    SELECT depot, CASE WHEN count(*) FILTER (WHERE date >= cut) >= 5
                       THEN round_even(round(avg(occupancy_ratio) FILTER (WHERE date >= cut), 9), 4) ELSE 0.85 END::DOUBLE AS rolling_or
    FROM gold, (SELECT max(date) - 30 AS cut FROM gold) GROUP BY 1"""
STEPS["fresh"] = """
    SELECT depot, prediction_date, p AS predicted_passenger_kms, load AS assumed_or, 45 AS bus_capacity, p / (load * 45) AS estimated_kms,
           ceil(p / (load * 45) / 250)::BIGINT AS estimated_buses, 'pending' AS status
    FROM (SELECT w.depot, w.date AS prediction_date, max_temp * 1000 AS p, coalesce(rolling_or, 0.85::DOUBLE) AS load
          FROM weather w LEFT JOIN loads l ON l.depot = w.depot)"""


def fresh(d: Domain):
    preds = d.weather.select(
        "depot", F.col("date").alias("prediction_date"), (F.col("max_temp") * 1000).alias("predicted_passenger_kms"))
    return lg.prediction_rows(preds, rollups.rolling_or(d.daily))


@query("F09_prediction_rows", """
    SELECT depot, prediction_date, predicted_passenger_kms, assumed_or, bus_capacity, estimated_kms, NULL::BIGINT AS estimated_buses, status
    FROM ledger UNION ALL SELECT * FROM fresh f WHERE NOT EXISTS (
        FROM ledger l WHERE l.depot = f.depot AND l.prediction_date = f.prediction_date)""",
       "predicted_passenger_kms assumed_or estimated_kms")
def f09(d: Domain):
    return lg.insert_if_absent(d.ledger, fresh(d), ["depot", "prediction_date"])


@query("F10_backfill", """
    SELECT f.depot, f.prediction_date, predicted_passenger_kms, passenger_kms AS actual_passenger_kms, estimated_kms, estimated_buses,
           predicted_passenger_kms - passenger_kms AS pkm_error,
           CASE WHEN passenger_kms > 0 THEN (predicted_passenger_kms - passenger_kms) * 100 / passenger_kms END AS pkm_error_pct,
           CASE WHEN actual_kms > 0 THEN estimated_kms - actual_kms END AS km_error,
           CASE WHEN actual_kms > 0 THEN (estimated_kms - actual_kms) * 100 / actual_kms END AS km_error_pct, 'completed' AS status
    FROM fresh f JOIN gold g ON g.depot = f.depot AND g.date = f.prediction_date
    WHERE NOT EXISTS (FROM ledger l WHERE l.status = 'completed' AND l.depot = f.depot AND l.prediction_date = f.prediction_date)""",
       "predicted_passenger_kms actual_passenger_kms estimated_kms pkm_error pkm_error_pct km_error km_error_pct")
def f10(d: Domain):
    actual = d.gold.select("depot", F.col("date").alias("prediction_date"), F.col("passenger_kms").alias("actual_passenger_kms"), "actual_kms")
    tested = fresh(d).select("depot", "prediction_date", "predicted_passenger_kms").join(actual, ["depot", "prediction_date"])
    out = lg.backfill(d.ledger, tested, rollups.rolling_or(d.daily))
    return out.drop("actual_kms", "assumed_or", "bus_capacity")


STEPS["naive"] = """
    SELECT depot, date, passenger_kms AS y, lag(passenger_kms, 7) OVER (PARTITION BY depot ORDER BY date) AS p FROM gold"""


@query("F03_time_split", """
    SELECT g.depot, g.date, CASE WHEN g.date >= cut THEN 1 ELSE 0 END AS is_test,
           coalesce(p, (SELECT median(p) FROM naive WHERE date < (SELECT min(d) FROM last_dates))) AS p
    FROM naive g, (SELECT min(d) AS cut FROM last_dates)""", "p")
def f03(d: Domain):
    split = lg.time_split(naive(d).drop("y"), 90)
    return lg.impute_median(split, ["p"])


STEPS["last_dates"] = "SELECT DISTINCT date AS d FROM gold ORDER BY d DESC LIMIT 90"


def naive(d: Domain):
    from depotlens.operators.features import lags

    base = d.gold.select("depot", "date", F.col("passenger_kms").alias("y"))
    return lags(base, "y", [7], "p").withColumnRenamed("p_7", "p")


@query("F06_metrics", """
    SELECT depot, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae, avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END) * 100 AS mape,
           avg(abs(y - p) / (abs(y) + 1)) * 100 AS mape_plus1, 1 - avg((y - p) * (y - p)) / nullif(var_pop(y), 0) AS r2
    FROM naive WHERE p IS NOT NULL GROUP BY 1""", "rmse mae mape mape_plus1 r2", 4)
def f06(d: Domain):
    return lg.metrics(naive(d).filter("p IS NOT NULL"), "y", "p", ["depot"])


STEPS["two_days"] = """
    SELECT depot, avg(passengers_per_day) FILTER (WHERE age <= 7) AS recent_mean,
           avg(passengers_per_day) FILTER (WHERE age <= 30) AS today_raw, max(passengers_per_day) FILTER (WHERE age <= 30) AS tomorrow_raw
    FROM (SELECT *, row_number() OVER (PARTITION BY depot ORDER BY date DESC) AS age FROM daily) GROUP BY 1"""


@query("F12_blend", """
    SELECT depot, today, least(greatest(0.7 * tomorrow_raw + 0.3 * today, today * 0.8), today * 1.2) AS tomorrow
    FROM (SELECT t.depot, tomorrow_raw, coalesce(s.v, 0.65 * today_raw + 0.35 * recent_mean) AS today FROM two_days t
          LEFT JOIN (SELECT depot, CASE WHEN category = 'Rural' THEN avg_seats_per_bus END AS v FROM depots) s ON s.depot = t.depot)""", "today tomorrow")
def f12(d: Domain):
    from pyspark.sql import Window

    aged = d.daily.withColumn("age", F.row_number().over(Window.partitionBy("depot").orderBy(F.desc("date")))).filter("age <= 30")
    raw = aged.groupBy("depot").agg(
        F.avg(F.when(F.col("age") <= 7, F.col("passengers_per_day"))).alias("recent_mean"),
        F.avg("passengers_per_day").alias("today_raw"), F.max("passengers_per_day").cast("double").alias("tomorrow_raw"))
    store = d.depots.select(
        "depot", F.when(F.col("category") == "Rural", F.col("avg_seats_per_bus")).alias("stored_today"), F.lit(None).cast("double").alias("stored_tomorrow"))
    return lg.blend(raw, store)


@query("F13_stored_or_new", """
    SELECT coalesce(l.depot, w.depot) AS depot, coalesce(l.prediction_date, w.date) AS date, coalesce(predicted_passenger_kms, max_temp) AS value
    FROM ledger l FULL JOIN weather w ON w.depot = l.depot AND w.date = l.prediction_date""", "value")
def f13(d: Domain):
    store = d.ledger.select("depot", F.col("prediction_date").alias("date"), F.col("predicted_passenger_kms").alias("value"))
    new = d.weather.select("depot", "date", F.col("max_temp").alias("value"))
    return lg.stored_or_new(store, new, ["depot", "date"], "value")


@query("F17_open_next", """
    SELECT p.depot, p.date, p.max_temp FROM weather p JOIN (SELECT depot, min(date) AS first FROM daily GROUP BY 1) f ON f.depot = p.depot
    WHERE p.date > f.first AND NOT EXISTS (FROM daily x WHERE x.depot = p.depot AND x.date = p.date)
    QUALIFY row_number() OVER (PARTITION BY p.depot ORDER BY p.date) = 1""", "max_temp")
def f17(d: Domain):
    filled = d.daily.groupBy("depot").agg(F.min("date").alias("date"))
    return lg.open_next(d.weather.select("depot", "date", "max_temp"), filled, d.daily)
