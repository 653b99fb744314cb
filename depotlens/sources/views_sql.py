"""The domain mapping of ``views.py`` stated once more as SQL, for the oracle.

``with_views(select)`` prefixes a statement with exactly the views it needs.
"""

from __future__ import annotations

import re

from depotlens.sources.views import MU_REASONS, SL_REASONS

_CENTS = "sum(round({0} * 100)::BIGINT)::BIGINT"


def _sheet() -> str:
    sick = "value >= 10 AND value < 30"
    kind = "count(*) FILTER (WHERE event_type = '{}')".format
    cols = {
        "Schedules": f"100 + {kind('view')}",
        "Schedules_Services": f"200 + {kind('click')}",
        "Schedules_Kms": "20000 + 100 * count(*)",
        "Planned_Schedules": f"CASE WHEN {kind('signup')} = 0 THEN 0 ELSE 90 + {kind('view')} END",
        "Planned_Services": f"180 + {kind('click')}",
        "Planned_KM": "18000 + 90 * count(*)",
        "Actual_Services": f"170 + {kind('purchase')} + {kind('click')}",
        "Actual_KM": "17000 + 95 * count(*)",
        "Total_Drivers": "400 + count(*)",
        "Medically_Unfit": kind("error"),
        "Suspended_Drivers": "count(*) FILTER (WHERE value > 200)",
        "Weekly_Off_National_Off": f"20 + {kind('view')}",
        "Special_Off_Night_Out_IC_Online": f"10 + {kind('click')}",
        "Training_PME_medical": kind("purchase"),
        "Others": kind("signup"),
        "Leave_Absent": "5 + count(*) FILTER (WHERE value < 10)",
        "Sick_Leave": f"count(*) FILTER (WHERE {sick})",
        "Spot_Absent": "count(*) FILTER (WHERE value > 100)",
        "Drivers_Required": f"300 + 2 * {kind('view')}",
        "Double_Duty": f"20 + {kind('purchase')}",
        "Off_Cancellation": f"3 + {kind('signup')}",
        "Drivers_as_Conductors": f"{kind('error')} % 7",
    }
    for i, name in enumerate(MU_REASONS):
        cols[name] = f"count(*) FILTER (WHERE event_type = 'error' AND floor(value)::BIGINT % 6 = {i})"
    for i, name in enumerate(SL_REASONS):
        cols[name] = f"count(*) FILTER (WHERE {sick} AND user_id % 19 = {i})"
    body = ", ".join(f"({e})::BIGINT AS {n}" for n, e in cols.items())
    names = ", ".join(cols)
    return (
        f"SELECT n_name AS depot, data_date, {names} FROM (SELECT user_id % 25 AS k, ts::DATE AS data_date, {body} "
        "FROM events GROUP BY 1, 2) JOIN nation ON k = n_nationkey"
    )


VIEWS: dict[str, str] = {
    "depots": """
        SELECT n_nationkey AS depot_id, n_name AS depot, r_name AS region,
               CASE WHEN n_regionkey <= 1 THEN 'South' ELSE 'North' END AS zone,
               CASE WHEN n_nationkey % 2 = 0 THEN 'Rural' ELSE 'Urban' END AS category,
               (40 + n_nationkey % 10)::DOUBLE AS avg_seats_per_bus,
               CASE n_nationkey % 4 WHEN 0 THEN '80%' WHEN 1 THEN '0.75' WHEN 2 THEN 'n/a' END AS target_or
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "drivers": "SELECT s_suppkey AS employee_id, n_name AS depot FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "operations": """
        SELECT depot, l_shipdate::DATE AS operations_date, employee_id, l_partkey::VARCHAR AS service_number,
               l_quantity AS opd_kms, floor(l_extendedprice) AS daily_earnings,
               CASE WHEN l_linestatus = 'O' THEN 'D' ELSE 'N' END AS day_night, l_returnflag AS service_type,
               l_linenumber AS schedules_count, l_discount AS load_share, l_orderkey AS trip_id
        FROM lineitem JOIN drivers ON l_suppkey = employee_id""",
    "services": """
        SELECT o.depot, o.service_number, p_brand AS route, p_type AS product, p_size % 6 AS planned_trips,
               (5 + p_partkey % 40)::DOUBLE AS km_per_trip, (p_partkey * 37 % 1440) * 60 AS dep_sec,
               (p_partkey * 101 % 1440) * 60 AS arr_sec,
               CASE WHEN p_partkey % 4 = 0 THEN 'N' ELSE 'D' END AS day_night_code,
               p_partkey % 2 AS can_be_cancelled,
               CASE WHEN p_partkey % 7 <> 0 THEN 15 + p_size * 0.5::DOUBLE END AS breakeven_cpk,
               avg_seats_per_bus, (p_size % 6) * (5 + p_partkey % 40)::DOUBLE AS planned_kms
        FROM (SELECT DISTINCT depot, service_number FROM operations) o
        JOIN part ON p_partkey::VARCHAR = o.service_number JOIN depots d ON d.depot = o.depot""",
    "steering": """
        SELECT o.depot, o.service_number, (4 + p_partkey % 9)::DOUBLE AS steering_hours,
               CASE WHEN p_size > 3 THEN p_size % 4 END AS no_of_drvs
        FROM (SELECT DISTINCT depot, service_number FROM operations) o
        JOIN part ON p_partkey::VARCHAR = o.service_number""",
    "absences": """
        SELECT d.employee_id, d.depot,
               CASE o_orderpriority[1] WHEN '1' THEN 'L' WHEN '5' THEN 'L' WHEN '2' THEN 'S' WHEN '3' THEN 'A' END
                   AS leave_type, o_orderdate::DATE AS date
        FROM orders JOIN drivers d ON d.employee_id = o_custkey % (SELECT count(*) FROM supplier)""",
    "health": """
        SELECT d.employee_id, d.depot, final_grading, risk_score FROM (
            SELECT c_custkey % (SELECT count(*) FROM supplier) AS employee_id,
                   CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'A' WHEN 'BUILDING' THEN 'B' WHEN 'FURNITURE' THEN 'C'
                        WHEN 'HOUSEHOLD' THEN 'D' ELSE 'E' END AS final_grading, c_acctbal AS risk_score,
                   row_number() OVER (PARTITION BY c_custkey % (SELECT count(*) FROM supplier) ORDER BY c_custkey) AS rn
            FROM customer) h JOIN drivers d ON d.employee_id = h.employee_id WHERE rn = 1""",
    "daily": f"""
        SELECT depot, operations_date AS date, count(*) * 45 AS passengers_per_day, sum(opd_kms) AS actual_kms,
               {_CENTS.format('load_share')} / (count(*) * 10)::DOUBLE AS occupancy_ratio,
               sum(daily_earnings) AS revenue
        FROM operations GROUP BY 1, 2""",
    "service_daily": f"""
        SELECT s.*, actual_kms * avg_seats_per_bus AS seat_kms,
               occupancy_ratio * actual_kms * avg_seats_per_bus AS passenger_kms
        FROM (SELECT depot, operations_date AS date, service_number, sum(opd_kms) AS actual_kms,
                     count(*) AS actual_trips,
                     {_CENTS.format('load_share')} / (count(*) * 10)::DOUBLE AS occupancy_ratio,
                     sum(daily_earnings) AS revenue
              FROM operations GROUP BY 1, 2, 3) s JOIN depots d ON d.depot = s.depot""",
    "days": """
        SELECT d::DATE AS date, date_diff('day', DATE '1995-01-01', d::DATE) AS n
        FROM (SELECT unnest(generate_series(min(l_shipdate)::DATE, max(l_shipdate)::DATE + 14, INTERVAL 1 DAY)) AS d
              FROM lineitem)""",
    "holidays": """
        SELECT date, (1 + (n // 29) % 7)::INTEGER AS fes_hol_code,
               'FEST_' || (1 + (n // 29) % 7)::INTEGER AS holiday_festival,
               ['MAJOR', 'MINOR', 'STATE'][(1 + (n // 29) % 7)::INTEGER % 3 + 1] AS fes_hol_category
        FROM days WHERE n % 29 IN (0, 1, 2)""",
    "lunar": """
        SELECT date, 'T' || (n % 15) AS telugu_thithi,
               CASE WHEN n % 30 < 15 THEN 'SHUKLA' ELSE 'KRISHNA' END AS telugu_paksham,
               'M' || (n // 30) % 12 AS telugu_month,
               CASE WHEN n % 11 = 0 THEN 1 ELSE 0 END::DOUBLE AS marriage_day,
               CASE WHEN n % 90 < 5 THEN 1 ELSE 0 END::DOUBLE AS moudyami_day FROM days""",
    "lunar_raw": """
        SELECT CASE o_orderstatus WHEN 'O' THEN strftime(o_orderdate, '%d-%m-%Y')
                    WHEN 'F' THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date,
               'T' || (o_orderkey % 15) AS telugu_thithi, o_orderstatus AS telugu_paksham FROM orders""",
    "weather": """
        SELECT n_name AS depot, o_orderdate::DATE AS date, floor(max(o_totalprice)) / 20000 + 15 AS max_temp,
               floor(min(o_totalprice)) / 20000 AS min_temp,
               CASE WHEN max(o_orderstatus) <> 'F'
                    THEN (count(*) FILTER (WHERE o_orderstatus = 'O') * 7)::DOUBLE END AS daily_rainfall
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
    "gold": """
        SELECT f.depot, f.date, passengers_per_day, actual_kms, occupancy_ratio, revenue,
               occupancy_ratio * actual_kms * coalesce(avg_seats_per_bus, 45) AS passenger_kms,
               telugu_thithi, telugu_paksham, telugu_month, marriage_day, moudyami_day,
               coalesce(h.fes_hol_code, 0) AS fes_hol_code, coalesce(holiday_festival, 'NONE') AS holiday_festival,
               coalesce(fes_hol_category, 'NONE') AS fes_hol_category,
               CASE WHEN h.fes_hol_code IS NULL THEN 0 ELSE 1 END AS is_fes_hol
        FROM daily f LEFT JOIN lunar l ON l.date = f.date LEFT JOIN holidays h ON h.date = f.date
        LEFT JOIN depots d ON d.depot = f.depot""",
    "ledger": f"""
        SELECT depot, prediction_date, p AS predicted_passenger_kms, status, 0.85::DOUBLE AS assumed_or,
               45 AS bus_capacity, p / (0.85::DOUBLE * 45) AS estimated_kms
        FROM (SELECT n_name AS depot, o_orderdate::DATE AS prediction_date,
                     {_CENTS.format('o_totalprice')} / 10000::DOUBLE AS p,
                     CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') > 0 THEN 'completed' ELSE 'pending' END AS status
              FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)""",
    "sheet": _sheet(),
    "bronze": """
        SELECT l_orderkey::VARCHAR AS sl_no, ' ' || lower(depot) || CASE WHEN l_linenumber = 1 THEN ' ' ELSE '' END AS depot,
               CASE l_linenumber WHEN 1 THEN strftime(l_shipdate, '%d/%m/%Y') WHEN 2 THEN strftime(l_shipdate, '%Y-%m-%d')
                    WHEN 3 THEN '31-02-2024' ELSE strftime(l_shipdate, '%d-%m-%Y') END AS date,
               CASE WHEN l_linenumber = 4 THEN '' ELSE l_suppkey::VARCHAR END AS drvno, l_partkey::VARCHAR AS serno,
               CASE l_linenumber WHEN 5 THEN '--' WHEN 6 THEN 'N/A' ELSE l_quantity::INTEGER || ',000' END AS kms,
               CASE WHEN l_linenumber = 7 THEN 'none' ELSE lower(l_returnflag) END AS type,
               CASE WHEN l_linenumber = 2 THEN 'NAN' ELSE ' ' || l_linestatus END AS dno
        FROM lineitem JOIN drivers ON l_suppkey = employee_id""",
}

_WORD = re.compile(r"[a-z_]+")


def _needs(text: str, extra: dict[str, str]) -> set[str]:
    known = {**VIEWS, **extra}
    found: set[str] = set()
    todo = [text]
    while todo:
        for word in set(_WORD.findall(todo.pop())):
            if word in known and word not in found:
                found.add(word)
                todo.append(known[word])
    return found


def with_views(select: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``select`` with the views (and ``extra`` named steps) it refers to."""
    extra = extra or {}
    needed = _needs(select, extra)
    steps = [f"{n} AS ({b})" for n, b in {**VIEWS, **extra}.items() if n in needed]
    return f"WITH {', '.join(steps)} {select}" if steps else select
