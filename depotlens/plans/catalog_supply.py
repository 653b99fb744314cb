"""Supply scheduling (M, W23, W28, T02) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from depotlens.functions.clean import share_from_percent
from depotlens.functions.timeparts import in_peak
from depotlens.operators import supply
from depotlens.plans.registry import STEPS, query
from depotlens.sources.views import Domain

TARGET = "2001-11-05"

STEPS["demand"] = """
    SELECT s.depot, sum(passenger_kms) * (1 + depot_id % 4) AS predicted_pkm
    FROM service_daily s JOIN depots d ON d.depot = s.depot GROUP BY s.depot, depot_id"""
STEPS["recent"] = """
    SELECT depot, service_number, round(avg(occupancy_ratio), 9) AS recent_or FROM service_daily
    WHERE date >= DATE '2001-11-05' - 7 AND date < DATE '2001-11-05' GROUP BY 1, 2"""
STEPS["gap"] = """
    SELECT p.depot, planned_kms, predicted_pkm / greatest(target_share, 1e-6) / seats AS target_kms,
           predicted_pkm / greatest(target_share, 1e-6) / seats - planned_kms AS delta_kms, 0.03::DOUBLE * greatest(planned_kms, 1) AS tolerance_kms,
           abs(predicted_pkm / greatest(target_share, 1e-6) / seats - planned_kms) > 0.03::DOUBLE * greatest(planned_kms, 1) AS act
    FROM (SELECT depot, sum(planned_trips * km_per_trip) AS planned_kms, avg(avg_seats_per_bus) AS seats FROM services GROUP BY 1) p
    JOIN demand f ON f.depot = p.depot JOIN target_share t ON t.depot = p.depot"""
STEPS["cands"] = """
    SELECT s.*, coalesce(recent_or, 0) AS recent_or,
           CASE WHEN dep_sec BETWEEN 21600 AND 36000 OR dep_sec BETWEEN 59400 AND 73800 THEN 1 ELSE 0 END AS is_peak
    FROM services s LEFT JOIN recent r ON r.depot = s.depot AND r.service_number = s.service_number"""


def demand(d: Domain, scale: float = 1.0):
    total = d.written("service_daily").groupBy("depot").agg(F.sum("passenger_kms").alias("t"))
    return total.join(d.depots.select("depot", "depot_id"), "depot").select(
        "depot", (F.col("t") * (1 + F.col("depot_id") % 4) / scale).alias("predicted_pkm"))


def shares(d: Domain):
    return d.depots.select("depot", share_from_percent(F.col("target_or"), 0.75).alias("target_share"))


def gap(d: Domain):
    return supply.depot_gap(d.written("services"), demand(d), shares(d))


def cands(d: Domain):
    return supply.candidates(d.written("services"), supply.recent_or(d.written("service_daily"), TARGET, 7))


@query("M01_depot_gap", "SELECT * FROM gap", "planned_kms target_kms delta_kms tolerance_kms")
def m01(d: Domain):
    return gap(d)


_ADD = "ORDER BY is_peak DESC, recent_or DESC, km_per_trip, service_number"
STEPS["added"] = f"""
    SELECT depot, service_number, 1 AS trip_change, 'INCREASE' AS action, 'Add 1 trip(s), OR=' || printf('%.2f', round(recent_or, 2)) AS reason
    FROM (SELECT *, coalesce(sum(km_per_trip) OVER (PARTITION BY depot {_ADD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                 row_number() OVER (PARTITION BY depot {_ADD}) AS dn
          FROM (SELECT c.*, delta_kms, row_number() OVER (PARTITION BY c.depot, route {_ADD}) AS rn FROM cands c
                JOIN gap g ON g.depot = c.depot WHERE act AND delta_kms > 0 AND recent_or >= 0.65 AND km_per_trip > 0) WHERE rn <= 2)
    WHERE dn <= 25 AND before < delta_kms"""


@query("M02_add_trips", "SELECT * FROM added")
def m02(d: Domain):
    return supply.add_trips(gap(d), cands(d))


_CUT = "ORDER BY is_peak, recent_or, km_per_trip DESC, service_number"
STEPS["removal"] = f"""
    SELECT c.*, delta_kms, CASE WHEN recent_or < 0.45 THEN planned_trips ELSE 1 END AS removed,
           row_number() OVER (PARTITION BY c.depot, route {_CUT}) AS rn
    FROM cands c JOIN gap g ON g.depot = c.depot WHERE act AND delta_kms <= 0 AND can_be_cancelled = 1 AND planned_trips > 0"""
STEPS["removed_trips"] = f"""
    SELECT depot, service_number, -removed AS trip_change, CASE WHEN recent_or < 0.45 THEN 'STOP' ELSE 'DECREASE' END AS action,
           CASE WHEN recent_or < 0.45 THEN 'Stop service, very low OR=' || printf('%.2f', round(recent_or, 2))
                ELSE 'Cut ' || removed || ' trip(s), OR=' || printf('%.2f', round(recent_or, 2)) END AS reason
    FROM (SELECT *, coalesce(sum(km_per_trip * removed) OVER (PARTITION BY depot {_CUT} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                 row_number() OVER (PARTITION BY depot {_CUT}) AS dn FROM removal WHERE rn <= 2)
    WHERE dn <= 25 AND before < -delta_kms"""


@query("M03_cut_trips", "SELECT * FROM removed_trips")
def m03(d: Domain):
    return supply.cut_trips(gap(d), cands(d))


STEPS["plan"] = """
    SELECT c.depot, c.service_number, route, product, dep_sec, is_peak, 0 AS is_protected, planned_trips,
           planned_trips + coalesce(trip_change, 0) AS suggested_trips, coalesce(trip_change, 0) AS trip_change, km_per_trip,
           planned_trips * km_per_trip AS planned_kms_day, (planned_trips + coalesce(trip_change, 0)) * km_per_trip AS suggested_kms_day,
           coalesce(trip_change, 0) * km_per_trip AS kms_change, recent_or, coalesce(action, 'NO_CHANGE') AS action,
           coalesce(reason, 'Within tolerance') AS reason
    FROM cands c LEFT JOIN (SELECT * FROM added UNION ALL SELECT * FROM removed_trips) x
      ON x.depot = c.depot AND x.service_number = c.service_number"""


def trip_plan(d: Domain):
    return supply.trip_schedule(d.written("services"), d.written("service_daily"), demand(d), shares(d), TARGET)


@query("M04_trip_schedule", "SELECT * FROM plan", "kms_change planned_kms_day suggested_kms_day")
def m04(d: Domain):
    return trip_plan(d)


@query("M05_recent_or", """
    SELECT depot, service_number, round(avg(occupancy_ratio), 9) AS recent_or FROM service_daily
    WHERE date >= DATE '2001-10-29' AND date < DATE '2001-11-05' GROUP BY 1, 2""")
def m05(d: Domain):
    return supply.recent_or(d.service_daily, TARGET, 7)


@query("M06_peak_flag", "SELECT depot, service_number, is_peak FROM cands")
def m06(d: Domain):
    return d.services.select("depot", "service_number", in_peak(F.col("dep_sec")).cast("int").alias("is_peak"))


STEPS["rev"] = """
    SELECT depot, service_number, avg(revenue / passenger_kms) AS rev_per_pkm FROM service_daily
    WHERE date >= DATE '2001-10-21' AND date < DATE '2001-11-05' AND passenger_kms > 0 GROUP BY 1, 2"""


@query("M07_rev_per_pkm", "SELECT * FROM rev", "rev_per_pkm")
def m07(d: Domain):
    return supply.rev_per_pkm(d.service_daily, TARGET, 15)


STEPS["weighted"] = """
    SELECT depot, service_number, coalesce(p / nullif(sum(p) OVER (PARTITION BY depot), 0), 0) AS weight
    FROM (SELECT depot, service_number, sum(passenger_kms) AS p FROM service_daily
          WHERE date >= DATE '2001-10-21' AND date < DATE '2001-11-05' GROUP BY 1, 2)"""
STEPS["spread"] = """
    SELECT s.*, predicted_pkm / 25 * coalesce(weight, 0) AS allocated_pkm, predicted_pkm / 25 * coalesce(weight, 0) * coalesce(rev_per_pkm, 0) AS revenue,
           coalesce(breakeven_cpk, 25) AS cpk FROM services s JOIN demand f ON f.depot = s.depot
    LEFT JOIN weighted w ON w.depot = s.depot AND w.service_number = s.service_number
    LEFT JOIN rev r ON r.depot = s.depot AND r.service_number = s.service_number"""
STEPS["earned"] = """
    SELECT *, CASE WHEN planned_kms > 0 THEN revenue / planned_kms ELSE 0 END AS epk,
           CASE WHEN planned_kms * avg_seats_per_bus > 0 THEN allocated_pkm / (planned_kms * avg_seats_per_bus) ELSE 0 END AS "or",
           revenue - cpk * planned_kms AS contribution FROM spread"""
STEPS["judged"] = """
    SELECT *, CASE WHEN epk >= cpk AND "or" >= 0.7 THEN 'UNDERSUPPLY' WHEN epk >= cpk THEN 'OVERSUPPLY'
                   WHEN "or" >= 0.7 THEN 'SOCIAL_OBLIGATION' ELSE 'INEFFICIENT' END AS quadrant,
           CASE WHEN "or" > 0.9 AND epk > 1.05 * cpk THEN 'ADD_SLOT'
                WHEN "or" < 0.5 AND epk < 0.9 * cpk AND can_be_cancelled = 1 THEN 'CUT' ELSE 'NO_CHANGE' END AS action FROM earned"""
STEPS["reasoned"] = """
    SELECT *, CASE action WHEN 'ADD_SLOT' THEN 'OR=' || printf('%.2f', round("or", 2)) || '>0.9, EPK=' || printf('%.2f', round(epk, 2)) || '>1.05*CPK'
                          WHEN 'CUT' THEN 'OR=' || printf('%.2f', round("or", 2)) || '<0.5, EPK=' || printf('%.2f', round(epk, 2)) || '<0.9*CPK'
                          ELSE 'Within policy bounds' END AS reason FROM judged"""
STEPS["slots"] = """
    SELECT depot, route, dep_sec, nx AS next_sec,
           CASE WHEN nx IS NOT NULL THEN printf('%02d:%02d:00', ((dep_sec // 60 + nx // 60) // 2) // 60, ((dep_sec // 60 + nx // 60) // 2) % 60) END AS slot
    FROM (SELECT depot, route, dep_sec, CASE WHEN n > 1 THEN dep_sec ELSE lead(dep_sec) OVER (PARTITION BY depot, route ORDER BY dep_sec) END AS nx
          FROM (SELECT depot, route, dep_sec, count(*) AS n FROM services GROUP BY 1, 2, 3))"""
STEPS["slot_plan"] = """
    SELECT r.depot, service_number, r.route, product, r.dep_sec, allocated_pkm, planned_kms, revenue, epk, "or", cpk, quadrant, contribution,
           action, CASE WHEN action = 'ADD_SLOT' THEN slot END AS suggested_new_slot, reason
    FROM reasoned r LEFT JOIN slots s ON s.depot = r.depot AND s.route = r.route AND s.dep_sec = r.dep_sec"""


def epk_plan(d: Domain):
    return supply.epk(d.written("services"), d.written("service_daily"), demand(d, 25.0), TARGET)


def slot_plan(d: Domain):
    return supply.slot_schedule(d.written("services"), d.written("service_daily"), demand(d, 25.0), TARGET)


@query("M08_epk", 'SELECT depot, service_number, allocated_pkm, revenue, epk, "or" AS load, cpk, contribution FROM earned',
       "allocated_pkm revenue epk load cpk contribution", 4)
def m08(d: Domain):
    return epk_plan(d).select("depot", "service_number", "allocated_pkm", "revenue", "epk", F.col("or").alias("load"), "cpk", "contribution")


@query("M09_quadrant", "SELECT depot, service_number, quadrant FROM judged")
def m09(d: Domain):
    return epk_plan(d).select("depot", "service_number", "quadrant")


@query("M10_decide", "SELECT depot, service_number, action, reason FROM reasoned")
def m10(d: Domain):
    return supply.decide(epk_plan(d)).select("depot", "service_number", "action", "reason")


@query("W23_next_slot", "SELECT * FROM slots")
def w23(d: Domain):
    return supply.next_slot(d.services)


@query("M11_suggest_slot", "SELECT depot, service_number, action, suggested_new_slot FROM slot_plan")
def m11(d: Domain):
    return slot_plan(d).select("depot", "service_number", "action", "suggested_new_slot")


_Q = supply.QUADRANTS
_SUMMARY = (
    ["depot", "count(*) AS total_services"]
    + [f"count(*) FILTER (WHERE action = '{a}') AS count_{a.lower()}" for a in supply.SLOT_ACTIONS]
    + [f"count(*) FILTER (WHERE quadrant = '{q}') AS n_{q.lower()}" for q in _Q]
    + [f"round_even(count(*) FILTER (WHERE quadrant = '{q}') * 100::DOUBLE / count(*), 1) AS pct_{q.lower()}" for q in _Q]
    + [f"sum({m}) AS total_{m}" for m in ("allocated_pkm", "revenue", "contribution", "planned_kms")]
    + ["avg(epk) AS avg_epk", 'avg("or") AS avg_or']
    + [f"coalesce(sum(revenue) FILTER (WHERE quadrant = '{q}'), 0) AS revenue_{q.lower()}" for q in _Q]
    + [f"coalesce(sum(contribution) FILTER (WHERE quadrant = '{q}'), 0) AS contribution_{q.lower()}" for q in _Q]
)
_SUMMARY_SQL = f"SELECT {', '.join(_SUMMARY)} FROM slot_plan GROUP BY 1"
_SUMMARY_R = " ".join(
    [f"pct_{q.lower()}" for q in _Q] + ["total_allocated_pkm", "total_revenue", "total_contribution", "total_planned_kms", "avg_epk", "avg_or"]
    + [f"{m}_{q.lower()}" for m in ("revenue", "contribution") for q in _Q])


@query("M12_slot_summary", _SUMMARY_SQL, _SUMMARY_R, 3)
def m12(d: Domain):
    return supply.slot_summary(slot_plan(d))


@query("M12_trip_summary", "SELECT depot, sum(kms_change) AS total_kms_change, " + ", ".join(
    f"count(*) FILTER (WHERE action = '{a}') AS count_{a.lower()}" for a in supply.TRIP_ACTIONS)
    + ", count(*) FILTER (WHERE action <> 'NO_CHANGE') AS services_changed FROM plan GROUP BY 1", "total_kms_change")
def m12b(d: Domain):
    return supply.trip_summary(trip_plan(d))


@query("M13_resolve_forecast", """
    SELECT depot, predicted_passenger_kms AS predicted_pkm, 'latest' AS how FROM ledger
    WHERE prediction_date = (SELECT max(prediction_date) FROM ledger)
    UNION ALL SELECT depot, avg(s), 'history' FROM (SELECT depot, date, sum(passenger_kms) AS s FROM service_daily GROUP BY 1, 2) GROUP BY 1
    UNION ALL SELECT l.depot, CASE depot_id % 3 WHEN 0 THEN predicted_passenger_kms WHEN 1 THEN estimated_kms * 45 * 0.75::DOUBLE ELSE depot_id * 25 END, 'partly empty'
    FROM ledger l JOIN depots d ON d.depot = l.depot WHERE prediction_date = (SELECT max(prediction_date) FROM ledger)""", "predicted_pkm")
def m13(d: Domain):
    k = F.col("depot_id") % 3
    partly = d.ledger.join(d.depots.select("depot", "depot_id"), "depot").withColumns({
        "predicted_passenger_kms": F.when(k == 0, F.col("predicted_passenger_kms")), "estimated_kms": F.when(k == 1, F.col("estimated_kms")),
        "predicted_passengers": F.col("depot_id")})
    return supply.resolve_forecast(d.ledger, d.written("service_daily")).withColumn("how", F.lit("latest")).unionByName(
        supply.resolve_forecast(d.ledger, d.written("service_daily"), "2030-01-01").withColumn("how", F.lit("history"))).unionByName(
        supply.resolve_forecast(partly, d.written("service_daily")).withColumn("how", F.lit("partly empty")))


@query("M14_overview", _SUMMARY_SQL, _SUMMARY_R, 3)
def m14(d: Domain):
    return supply.overview(slot_plan(d).drop("quadrant", "contribution"))


_T02 = """
    SELECT depot, service_number, action, {1} AS size, '{0}' AS engine, row_number() OVER (PARTITION BY depot ORDER BY
        CASE action {2} END, {1} DESC, service_number) AS line FROM {3}""".format
_TRIP_RANK = " ".join(f"WHEN '{a}' THEN {i}" for i, a in enumerate(supply.TRIP_ACTIONS))
_SLOT_RANK = " ".join(f"WHEN '{a}' THEN {i}" for i, a in enumerate(supply.SLOT_ACTIONS))


@query("T02_action_order", _T02("trips", "kms_change", _TRIP_RANK, "plan") + " UNION ALL " + _T02(
    "slots", "planned_kms", _SLOT_RANK, "slot_plan"), "size")
def t02(d: Domain):
    return supply.action_order(trip_plan(d), "kms_change", supply.TRIP_ACTIONS).withColumn("engine", F.lit("trips")).unionByName(
        supply.action_order(slot_plan(d), "planned_kms", supply.SLOT_ACTIONS).withColumn("engine", F.lit("slots")))


_W28 = "ORDER BY planned_kms DESC, service_number"


@query("W28_capped_allocation", f"""
    SELECT depot, service_number, route, planned_kms FROM (
        SELECT *, coalesce(sum(planned_kms) OVER (PARTITION BY depot {_W28} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
               row_number() OVER (PARTITION BY depot {_W28}) AS dn
        FROM (SELECT *, row_number() OVER (PARTITION BY depot, route {_W28}) AS rn FROM services) WHERE rn <= 3)
    WHERE dn <= 40 AND before < 5000 + avg_seats_per_bus * 20""")
def w28(d: Domain):
    pool = d.services.withColumn("budget", 5000 + F.col("avg_seats_per_bus") * 20)
    taken = supply.capped_allocation(pool, [F.desc("planned_kms"), F.asc("service_number")], "planned_kms", "budget", 3, 40)
    return taken.select("depot", "service_number", "route", "planned_kms")


STEPS["engines"] = """
    SELECT depot, operations_date AS target_date, service_number, CASE WHEN day_night = 'D' THEN 'epk' ELSE 'delta_kms' END AS engine
    FROM operations"""


@query("S11_prefer_engine", """
    SELECT depot, target_date, engine, count(*) AS n FROM engines e WHERE engine = 'epk' OR NOT EXISTS (
        FROM engines x WHERE x.depot = e.depot AND x.target_date = e.target_date AND x.engine = 'epk') GROUP BY 1, 2, 3""")
def s11(d: Domain):
    stored = d.operations.select(
        "depot", F.col("operations_date").alias("target_date"), F.when(F.col("day_night") == "D", "epk").otherwise("delta_kms").alias("engine"))
    return supply.prefer_engine(stored).groupBy("depot", "target_date", "engine").agg(F.count("*").alias("n"))


@query("S11_schedule_dates", "SELECT DISTINCT depot, target_date, row_number() OVER (PARTITION BY depot ORDER BY target_date DESC) AS newest "
       "FROM (SELECT DISTINCT depot, target_date FROM engines)")
def s11b(d: Domain):
    from pyspark.sql import Window

    # One row per depot and calendar day.
    dates = d.operations.select("depot", F.col("operations_date").alias("target_date")).distinct()
    return dates.withColumn("newest", F.row_number().over(Window.partitionBy("depot").orderBy(F.desc("target_date"))))
