"""Upserts, set operations, reshaping (U), keyed writes (S17-S20) and label codes (P31)."""

from __future__ import annotations

from pyspark.sql import functions as F

from depotlens.operators import ledger as lg
from depotlens.operators import reshape
from depotlens.plans.registry import STEPS, query
from depotlens.sources.views import Domain

KEYS = ["depot", "date"]
STEPS["inbound"] = "SELECT depot, prediction_date AS date, estimated_kms AS actual_kms FROM ledger"
STEPS["master"] = "SELECT depot, date, actual_kms FROM daily"


def inbound(d: Domain):
    return d.ledger.select("depot", F.col("prediction_date").alias("date"), F.col("estimated_kms").alias("actual_kms"))


def master(d: Domain):
    return d.daily.select("depot", "date", "actual_kms")


_UP = """
    SELECT * FROM master m WHERE NOT EXISTS (FROM inbound i WHERE i.depot = m.depot AND i.date = m.date)
    UNION ALL SELECT * FROM inbound"""


@query("U01_upsert", _UP, "actual_kms")
def u01(d: Domain):
    return reshape.upsert(master(d), inbound(d), KEYS)


@query("U01_upsert_counts", """
    SELECT count(*) FILTER (WHERE m.depot IS NULL) AS inserted, count(*) FILTER (WHERE m.depot IS NOT NULL) AS corrected
    FROM inbound i LEFT JOIN master m ON m.depot = i.depot AND m.date = i.date""")
def u01b(d: Domain):
    return reshape.upsert_counts(master(d), inbound(d), KEYS)


@query("S17_keyed_write", """
    SELECT depot, max(date) AS last, count(*) AS n, sum(actual_kms) AS km FROM (SELECT * FROM master m WHERE NOT EXISTS
        (FROM inbound i WHERE i.depot = m.depot AND i.date = m.date) UNION ALL SELECT * FROM inbound) GROUP BY 1""", "km", 5)
def s17(d: Domain):
    from depotlens.session import work_dir
    from depotlens.sources.files import replace_keyed

    path = work_dir(d.spark, "keyed")
    return replace_keyed(master(d), inbound(d), KEYS, path).groupBy("depot").agg(
        F.max("date").alias("last"), F.count("*").alias("n"), F.sum("actual_kms").alias("km"))


@query("S18_insert_if_absent", """
    SELECT * FROM master UNION ALL SELECT * FROM inbound i WHERE NOT EXISTS (FROM master m WHERE m.depot = i.depot AND m.date = i.date)""", "actual_kms")
def s18(d: Domain):
    return lg.insert_if_absent(master(d), inbound(d), KEYS)


@query("S19_fill_missing", """
    SELECT f.depot, f.date, coalesce(CASE WHEN actual_kms < 10 THEN NULL ELSE actual_kms END, max_temp) AS actual_kms
    FROM master f LEFT JOIN weather w ON w.depot = f.depot AND w.date = f.date""", "actual_kms")
def s19(d: Domain):
    gappy = master(d).withColumn("actual_kms", F.when(F.col("actual_kms") >= 10, F.col("actual_kms")))
    return reshape.fill_missing(gappy, d.weather.withColumnRenamed("max_temp", "actual_kms"), KEYS, "actual_kms")


@query("S20_delete_by_key", "SELECT * FROM master m WHERE NOT EXISTS (FROM absences a WHERE a.depot = m.depot AND a.date = m.date)")
def s20(d: Domain):
    return reshape.delete_keys(master(d), d.absences, KEYS)


@query("U02_union_all", """
    SELECT depot, date, 'km' AS kind, actual_kms AS value FROM daily UNION ALL
    SELECT depot, date, 'trips', actual_trips::DOUBLE FROM (SELECT depot, date, sum(actual_trips) AS actual_trips FROM service_daily GROUP BY 1, 2)""")
def u02(d: Domain):
    km = d.daily.select("depot", "date", F.lit("km").alias("kind"), F.col("actual_kms").alias("value"))
    trips = d.service_daily.groupBy("depot", "date").agg(F.sum("actual_trips").cast("double").alias("value"))
    return km.unionByName(trips.withColumn("kind", F.lit("trips")))


@query("U03_set_operations", """
    SELECT depot, date, 'only_daily' AS part FROM (SELECT depot, date FROM daily EXCEPT SELECT depot, date FROM weather)
    UNION ALL SELECT depot, date, 'either' FROM (SELECT depot, date FROM daily UNION SELECT depot, date FROM weather)
    UNION ALL SELECT depot, date, 'member' FROM daily f WHERE EXISTS (FROM weather w WHERE w.depot = f.depot AND w.date = f.date)""")
def u03(d: Domain):
    a, b = d.daily.select(*KEYS), d.weather.select(*KEYS)
    return (
        a.exceptAll(b).withColumn("part", F.lit("only_daily"))
        .unionByName(a.union(b).distinct().withColumn("part", F.lit("either")))
        .unionByName(a.join(b, KEYS, "left_semi").withColumn("part", F.lit("member")))
    )


STEPS["holiday_cells"] = """
    SELECT fes_hol_code, holiday_festival, fes_hol_category, year(date) || '_dates' AS year_col,
           string_agg(strftime(date, '%d-%m-%Y'), '; ' ORDER BY strftime(date, '%d-%m-%Y')) AS date_list
    FROM holidays GROUP BY 1, 2, 3, 4"""
_YEARS = "(SELECT DISTINCT year(date) || '_dates' AS year_col FROM holidays)"


@query("U04_melt_dates", f"""
    SELECT c.fes_hol_code, c.holiday_festival, c.fes_hol_category, y.year_col, coalesce(date_list, '') AS date_list
    FROM (SELECT DISTINCT fes_hol_code, holiday_festival, fes_hol_category FROM holidays) c CROSS JOIN {_YEARS} y
    LEFT JOIN holiday_cells h ON h.fes_hol_code = c.fes_hol_code AND h.year_col = y.year_col""")
def u04(d: Domain):
    long = reshape.melt_dates(d.holiday_wide, ["fes_hol_code", "holiday_festival", "fes_hol_category"])
    return long.withColumn("date_list", F.coalesce("date_list", F.lit("")))


@query("U05_split_dates", """
    SELECT fes_hol_code, year(date) || '_dates' AS year_col, strftime(date, '%d-%m-%Y') AS date_text FROM holidays""")
def u05(d: Domain):
    return reshape.split_dates(reshape.melt_dates(d.holiday_wide, ["fes_hol_code"]))


@query("U06_holiday_long", "SELECT * FROM holidays")
def u06(d: Domain):
    return reshape.holiday_long(d.holiday_wide)


@query("U07_lunar", """
    SELECT o_orderdate::DATE AS date, min('T' || (o_orderkey % 15)) AS telugu_thithi,
           arg_min(o_orderstatus, ('T' || (o_orderkey % 15)) || '/' || o_orderstatus) AS telugu_paksham FROM orders GROUP BY 1""")
def u07(d: Domain):
    return reshape.lunar(d.lunar_raw)


def _years(d: Domain) -> list[str]:
    """The years of the data, of which there are few."""
    return [str(r.year) for r in d.daily.select(F.year("date").alias("year")).distinct().orderBy("year").collect()]


@query("U09_transpose", " UNION ALL ".join(
    f"SELECT '{m}' AS measure, " + ", ".join(f"sum({m}) FILTER (WHERE year(date) = {y})::DOUBLE AS v_{y}" for y in range(1995, 2002)) + " FROM daily"
    for m in ("actual_kms", "revenue")))
def u09(d: Domain):
    years = d.daily.groupBy(F.year("date").alias("year")).agg(F.sum("actual_kms").alias("actual_kms"), F.sum("revenue").alias("revenue"))
    return reshape.transpose(years, "year", ["actual_kms", "revenue"], _years(d))


STEPS["seen_routes"] = "SELECT DISTINCT route FROM services"


@query("P31_label_codes", """
    SELECT depot, service_number, s.route, coalesce(code, (SELECT count(*) FROM seen_routes))::INTEGER AS route_code FROM services s
    LEFT JOIN (SELECT route, row_number() OVER (ORDER BY route) - 1 AS code FROM seen_routes) c ON c.route = s.route""")
def p31(d: Domain):
    return reshape.encode(d.services.select("depot", "service_number", "route"), "route", reshape.label_codes(d.services, "route"), "route_code")
