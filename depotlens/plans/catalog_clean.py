"""Cleaning (P) and validation (V) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from depotlens.functions import clean, timeparts
from depotlens.operators import quality
from depotlens.plans.registry import STEPS, query
from depotlens.sources.views import Domain

STEPS["arrivals"] = """
    SELECT trip_id, nullif(CASE WHEN d IN ('NAN','NA','NULL','NONE','N/A','-','--') THEN NULL ELSE d END, '') AS depot,
           operations_date, nullif(e, '') AS employee_id, s AS service_number,
           opd_kms, CASE WHEN t IN ('NAN','NA','NULL','NONE','N/A','-','--') THEN NULL ELSE t END AS service_type,
           CASE WHEN n IN ('NAN','NA','NULL','NONE','N/A','-','--') THEN NULL ELSE n END AS day_night
    FROM (SELECT sl_no AS trip_id, upper(trim(depot)) AS d,
                 try_strptime(date, '%d-%m-%Y')::DATE AS operations_date, trim(drvno) AS e, trim(serno) AS s,
                 TRY_CAST(replace(kms, ',', '') AS DOUBLE) AS opd_kms, upper(trim(type)) AS t, upper(trim(dno)) AS n
          FROM bronze)"""


@query("P01_headers", "SELECT 'SLNO,DEPOT,DATE,DRVNO,SERNO,OPTDKMS,TYPE,DNO,REMARKS' AS headers, count(*) AS n FROM bronze")
def p01(d: Domain):
    named = clean.normalise_headers(d.bronze)
    return named.agg(F.lit(",".join(named.columns)).alias("headers"), F.count("SLNO").alias("n"))


@query("P02_known_columns", "SELECT depot, date AS operations_date, drvno AS employee_id, serno AS service_number, kms AS opd_kms, "
       "type AS service_type, dno AS day_night FROM bronze")
def p02(d: Domain):
    return clean.keep_known(clean.normalise_headers(d.bronze))


_DATE3 = """coalesce(try_strptime(trim(date), '%d-%m-%Y'), try_strptime(trim(date), '%d/%m/%Y'),
    try_strptime(trim(date), '%Y-%m-%d'))::DATE"""


@query("P03_parse_date", f"SELECT date AS raw, {_DATE3} AS parsed, count(*) AS n FROM bronze GROUP BY 1, 2")
def p03(d: Domain):
    return d.bronze.groupBy(F.col("Date").alias("raw")).agg(F.count("*").alias("n")).withColumn(
        "parsed", clean.parse_date(F.col("raw")))


@query("P04_parse_number", "SELECT kms AS raw, TRY_CAST(replace(kms, ',', '') AS DOUBLE) AS parsed, count(*) AS n FROM bronze GROUP BY 1, 2")
def p04(d: Domain):
    return d.bronze.groupBy(F.col("`Opt'd KMs.`").alias("raw")).agg(F.count("*").alias("n")).withColumn(
        "parsed", clean.parse_number(F.col("raw")))


@query("P05_tidy_text", "SELECT nullif(upper(trim(depot)), '') AS depot, nullif(upper(trim(drvno)), '') AS driver, count(*) AS n "
       "FROM bronze GROUP BY 1, 2")
def p05(d: Domain):
    return d.bronze.select(clean.tidy(F.col("`Depot `")).alias("depot"), clean.tidy(F.col("`Drv No.`")).alias("driver")) \
        .groupBy("depot", "driver").agg(F.count("*").alias("n"))


@query("P06_missing_words", "SELECT service_type, day_night, count(*) AS n FROM arrivals GROUP BY 1, 2")
def p06(d: Domain):
    typed = clean.tidy_text(clean.keep_known(clean.normalise_headers(d.bronze)))
    return typed.groupBy("service_type", "day_night").agg(F.count("*").alias("n"))


# Depot i of the test tables arrives under the fixed table's name number 4 i.
_RAW = list(clean.DEPOT_NAMES)
_NAMES = "(VALUES " + ", ".join(f"({i}, '{raw}', '{name}')" for i, (raw, name) in enumerate(clean.DEPOT_NAMES.items())) + ") AS t(place, raw_name, canonical_name)"


_MAPPED = f"""
    SELECT coalesce(canonical_name, a.depot) AS depot, count(*) AS n FROM arrivals a
    LEFT JOIN depots d ON upper(d.depot) = a.depot LEFT JOIN (FROM {_NAMES}) m ON m.place = d.depot_id * 4 % {len(_RAW)} GROUP BY 1"""


def raw_names(d: Domain, arrivals):
    """Arrivals under the names that depots have in the files."""
    raw = F.element_at(F.array(*map(F.lit, _RAW)), (F.col("depot_id") * 4 % len(_RAW) + 1).cast("int"))
    known = d.depots.select(F.upper("depot").alias("depot"), raw.alias("raw"))
    return arrivals.join(known, "depot", "left").withColumn("depot", F.coalesce("raw", "depot")).drop("raw")


@query("P07_map_depots", _MAPPED)
def p07(d: Domain):
    named = raw_names(d, clean.clean_operations(d.bronze).groupBy("depot").agg(F.count("*").alias("c")))
    return clean.map_values(named, "depot", clean.depot_name_table(d.spark)).groupBy("depot").agg(F.sum("c").alias("n"))


@query("P08_drop_incomplete", "SELECT depot, count(*) AS n, count(opd_kms) AS with_km FROM arrivals "
       "WHERE depot IS NOT NULL AND operations_date IS NOT NULL AND employee_id IS NOT NULL GROUP BY 1")
def p08(d: Domain):
    kept = clean.clean_operations(d.bronze).na.drop("any", subset=["depot", "operations_date", "employee_id"])
    return kept.groupBy("depot").agg(F.count("*").alias("n"), F.count("opd_kms").alias("with_km"))


@query("P09_service_master", """
    SELECT depot, service_number, CASE WHEN k % 9 <> 0 THEN planned_trips ELSE 0 END AS planned_trips, planned_kms,
           CASE WHEN k % 5 <> 0 THEN km_per_trip ELSE 0 END AS km_per_trip, CASE WHEN k % 13 <> 0 THEN avg_seats_per_bus ELSE 45 END AS avg_seats_per_bus,
           CASE WHEN k % 11 <> 0 THEN can_be_cancelled ELSE 0 END AS can_be_cancelled FROM (SELECT *, service_number::INTEGER AS k FROM services)""", "km_per_trip")
def p09(d: Domain):
    k = F.col("service_number").cast("int")
    arrived = d.services.select(
        F.concat(F.lit(" "), "depot").alias("depot"), F.concat("service_number", F.lit("  ")).alias("service_number"),
        F.when(k % 9 != 0, F.col("planned_trips").cast("string")).otherwise("n/a").alias("planned_trips"), F.col("planned_kms").cast("string").alias("planned_kms"),
        F.when(k % 5 != 0, F.col("km_per_trip")).alias("km_per_trip"), F.when(k % 13 != 0, F.col("avg_seats_per_bus")).alias("avg_seats_per_bus"),
        F.when(k % 11 != 0, F.col("can_be_cancelled")).alias("can_be_cancelled"))
    return clean.clean_service_master(arrived)


@query("P10_clean_daily_ops", """
    SELECT depot, service_number, CASE WHEN k % 13 <> 0 THEN date END AS date, CASE WHEN k % 7 <> 0 THEN actual_kms END AS actual_kms,
           CASE WHEN k % 5 <> 0 THEN actual_trips ELSE 0 END::DOUBLE AS actual_trips, seat_kms, passenger_kms, occupancy_ratio, revenue
    FROM (SELECT *, service_number::INTEGER AS k FROM service_daily)""", "seat_kms passenger_kms occupancy_ratio")
def p10(d: Domain):
    k = F.col("service_number").cast("int")
    arrived = d.service_daily.select(
        F.concat(F.lit(" "), "depot", F.lit(" ")).alias("depot"), F.concat("service_number", F.lit(" ")).alias("service_number"),
        F.when(k % 13 == 0, "31-02-2024").when(k % 2 == 0, F.date_format("date", "dd/MM/yyyy")).otherwise(F.date_format("date", "yyyy-MM-dd")).alias("date"),
        F.when(k % 7 == 0, "--").otherwise(F.col("actual_kms").cast("string")).alias("actual_kms"),
        F.when(k % 5 != 0, F.col("actual_trips").cast("string")).otherwise("").alias("actual_trips"),
        *[F.col(c).cast("string").alias(c) for c in ("seat_kms", "passenger_kms", "occupancy_ratio", "revenue")])
    return clean.clean_daily_services(arrived)


@query("P02_P06_clean_operations", "SELECT depot, employee_id, service_number, operations_date, opd_kms FROM arrivals")
def p02_p06(d: Domain):
    return clean.clean_operations(d.bronze).select("depot", "employee_id", "service_number", "operations_date", "opd_kms")


STEPS["target_share"] = """
    SELECT depot, coalesce(CASE WHEN v > 1 THEN v / 100 ELSE v END, 0.75::DOUBLE) AS target_share
    FROM (SELECT depot, TRY_CAST(replace(target_or, '%', '') AS DOUBLE) AS v FROM depots)"""


@query("P11_percent_share", "SELECT t.depot, target_share, count(*) AS days FROM target_share t JOIN daily d ON d.depot = t.depot GROUP BY 1, 2", "target_share")
def p11(d: Domain):
    shares = d.depots.select("depot", clean.share_from_percent(F.col("target_or"), 0.75).alias("target_share"))
    return d.daily.groupBy("depot").agg(F.count("*").alias("days")).join(shares, "depot")


@query("P12_time_of_day", """
    SELECT hour_text, h * 3600 + m * 60 + s AS seconds, count(*) AS n FROM (
        SELECT strftime(ts, '%H:%M:%S') AS hour_text, hour(ts) AS h, minute(ts) AS m, second(ts) AS s FROM events) GROUP BY 1, 2""")
def p12(d: Domain):
    text = F.date_format("ts", "HH:mm:ss")
    return d.raw("events").groupBy(text.alias("hour_text")).agg(F.count("*").alias("n")).withColumn(
        "seconds", clean.seconds_of_day(F.col("hour_text")))


STEPS["duty_hours"] = """
    SELECT depot, service_number, day_night_code, abs(arr_sec - dep_sec) / 3600::DOUBLE AS plain,
           CASE WHEN day_night_code = 'N' THEN CASE WHEN arr_sec - dep_sec + 86400 < 21600 THEN arr_sec - dep_sec + 172800
                                                    ELSE arr_sec - dep_sec + 86400 END
                WHEN arr_sec < dep_sec THEN arr_sec - dep_sec + 86400 ELSE arr_sec - dep_sec END / 3600::DOUBLE AS hours
    FROM services"""


@query("P13_duty_hours", "SELECT depot, service_number, hours FROM duty_hours", "hours")
def p13(d: Domain):
    return d.services.select("depot", "service_number", timeparts.duty_hours(
        F.col("dep_sec"), F.col("arr_sec"), F.col("day_night_code")).alias("hours"))


@query("P14_plain_hours", "SELECT depot, service_number, plain AS hours FROM duty_hours", "hours")
def p14(d: Domain):
    return d.services.select("depot", "service_number", timeparts.plain_hours(F.col("dep_sec"), F.col("arr_sec")).alias("hours"))


@query("P16_label_key", """
    SELECT trim(regexp_replace(strip_accents(lower(replace(text, '<br>', ' '))), '[_.,()%/\\s-]+', ' ', 'g')) AS key, count(*) AS n FROM documents GROUP BY 1""")
def p16(d: Domain):
    # Counted by a hash; one text of each key travels.
    keys = d.raw("documents").select(clean.label_key(F.col("text")).alias("key"))
    return keys.groupBy(F.xxhash64("key").alias("h")).agg(F.any_value("key").alias("key"), F.count("*").alias("n")).drop("h")


@query("P17_rural_urban", """
    SELECT CASE WHEN t LIKE '%rural%' THEN 'Rural' WHEN t LIKE '%urban%' THEN 'Urban' ELSE 'Unknown' END AS category, count(*) AS n
    FROM (SELECT CASE WHEN category = 'Rural' THEN 'semi-rural area' WHEN region = 'ASIA' THEN 'hill' ELSE ' URBAN ' || region END AS c,
                 lower(trim(c)) AS t FROM operations o JOIN depots d ON d.depot = o.depot) GROUP BY 1""")
def p17(d: Domain):
    text = F.when(F.col("category") == "Rural", "semi-rural area").when(F.col("region") == "ASIA", "hill").otherwise(
        F.concat(F.lit(" URBAN "), "region"))
    per_depot = d.operations.groupBy("depot").agg(F.count("*").alias("c"))
    return per_depot.join(d.depots, "depot").groupBy(clean.rural_or_urban(text).alias("category")).agg(F.sum("c").alias("n"))


@query("P19_period_filter", """
    SELECT 'Yearly' AS period, depot, sum(actual_kms) AS km FROM daily WHERE year(date) = 1998 GROUP BY 2
    UNION ALL SELECT 'Quarterly', depot, sum(actual_kms) FROM daily WHERE year(date) = 1998 AND quarter(date) = 2 GROUP BY 2
    UNION ALL SELECT 'Monthly', depot, sum(actual_kms) FROM daily WHERE year(date) = 1998 AND month(date) = 7 GROUP BY 2""")
def p19(d: Domain):
    spans = [timeparts.period_range("Yearly", 1998), timeparts.period_range("Quarterly", 1998, quarter=2),
             timeparts.period_range("Monthly", 1998, 7)]
    kinds = ["Yearly", "Quarterly", "Monthly"]
    first, last = min(s[0] for s in spans), max(s[1] for s in spans)
    base = d.operations_between(str(first), str(last))
    hits = F.array_compact(F.array(*[
        F.when(timeparts.between_days(F.col("operations_date"), *s), F.lit(k)) for k, s in zip(kinds, spans)]))
    return base.select("depot", "opd_kms", F.explode(hits).alias("period")).groupBy("period", "depot").agg(F.sum("opd_kms").alias("km"))


@query("P20_last_12_months", """
    SELECT depot, count(*) AS days, sum(actual_kms) AS km FROM daily, (SELECT max(date) AS last FROM daily)
    WHERE date > last_day(last - INTERVAL 12 MONTH) GROUP BY 1""")
def p20(d: Domain):
    """The limit is found first, so that the scan of the facts is pruned by a literal."""
    last = d.operations.agg(F.max("operations_date").alias("last")).select(
        F.date_add(F.last_day(F.add_months("last", -12)), 1).alias("first"), F.date_add("last", 1).alias("after")).first()
    if last["first"] is None:
        return d.operations.groupBy("depot").agg(F.countDistinct("operations_date").alias("days"), F.sum("opd_kms").alias("km"))
    recent = d.operations_between(str(last["first"]), str(last["after"]))
    return recent.groupBy("depot").agg(F.countDistinct("operations_date").alias("days"), F.sum("opd_kms").alias("km"))


def scope_filter(df, depots, scope: str, value: str | None = None):
    """All / Region / Rural / Urban / Depot.

    The depots go to the facts: dealt by depot, a task would sort all facts of a depot.
    """
    dim = depots
    if scope == "Region":
        dim = dim.filter(F.col("region") == value)
    elif scope in ("Rural", "Urban"):
        dim = dim.filter(F.col("category") == scope)
    elif scope == "Depot":
        dim = dim.filter(F.col("depot") == value)
    elif scope != "All":
        raise ValueError(f"unknown scope {scope}")
    return df.join(F.broadcast(dim.select("depot", "region", "category")), "depot")


@query("P21_scope_filter", """
    SELECT s.depot, count(*) AS days, sum(actual_kms) AS km FROM daily s JOIN depots d ON d.depot = s.depot
    WHERE region = 'ASIA' GROUP BY 1 UNION ALL
    SELECT s.depot, count(*), sum(actual_kms) FROM daily s JOIN depots d ON d.depot = s.depot WHERE category = 'Rural' GROUP BY 1""")
def p21(d: Domain):
    out = [scope_filter(d.operations, d.depots, "Region", "ASIA"), scope_filter(d.operations, d.depots, "Rural")]
    parts = [x.groupBy("depot").agg(F.countDistinct("operations_date").alias("days"), F.sum("opd_kms").alias("km")) for x in out]
    return parts[0].unionByName(parts[1])


def year_filter(df, date: str, year: int | None):
    """None stands for every year."""
    if year is None:
        return df
    return df.filter(timeparts.between_days(F.col(date), *timeparts.period_range("Yearly", year)))


@query("P22_year_selector", """
    SELECT 'all' AS selection, depot, sum(actual_kms) AS km FROM daily GROUP BY 2 UNION ALL
    SELECT '2000', depot, sum(actual_kms) FROM daily WHERE date >= DATE '2000-01-01' AND date < DATE '2001-01-01' GROUP BY 2""")
def p22(d: Domain):
    def part(label, year):
        return year_filter(d.operations, "operations_date", year).groupBy("depot").agg(
            F.sum("opd_kms").alias("km")).withColumn("selection", F.lit(label))
    return part("all", None).unionByName(part("2000", 2000))


def role_scope(depots, role: str, text: str):
    """Depots a user may see; a regional user's text is a region, or a depot standing for its region."""
    if role == "depot":
        return depots.filter(F.upper("depot") == text.strip().upper()).select("depot")
    if role == "regional":
        wanted = text.strip().upper()
        # A region name beats an equal depot name; whichever matched gives one region.
        hit = depots.filter((F.upper("region") == wanted) | (F.upper("depot") == wanted)).agg(
            F.min(F.struct((F.upper("region") != wanted).alias("second"), "region")).alias("r")).select("r.region")
        return depots.join(hit, "region", "left_semi").select("depot")
    return depots.select("depot")


@query("P23_role_scope", """
    SELECT a.depot, a.leave_type, count(*) AS n FROM absences a JOIN depots d ON d.depot = a.depot
    WHERE region = (SELECT region FROM depots WHERE depot = 'NATION_7') GROUP BY 1, 2""")
def p23(d: Domain):
    seen = role_scope(d.depots, "regional", " nation_7 ")
    return d.absences.join(seen, "depot", "left_semi").groupBy("depot", "leave_type").agg(F.count("*").alias("n"))


_PARTS = ", ".join(f"CASE WHEN isodow(date) - 1 = {i} THEN 1 ELSE 0 END AS dow_{i}" for i in range(7))


@query("P24_calendar_parts", f"""
    SELECT depot, date, isodow(date) - 1 AS dow, {_PARTS}, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
           day(date) AS day_of_month, month(date) AS month, week(date) AS week_of_year, year(date) AS year,
           date_diff('day', DATE '2023-01-01', date) AS day_counter FROM daily""")
def p24(d: Domain):
    return d.daily.select("depot", "date").withColumns(timeparts.calendar_parts(F.col("date")))


@query("P25_financial_year", """
    SELECT depot, year(date - INTERVAL 3 MONTH) || '-' || (year(date - INTERVAL 3 MONTH) + 1) AS fy, sum(actual_kms) AS km
    FROM daily GROUP BY 1, 2""")
def p25(d: Domain):
    return d.operations.groupBy("depot", timeparts.financial_year(F.col("operations_date")).alias("fy")).agg(F.sum("opd_kms").alias("km"))


@query("P26_quarter", "SELECT depot, year(date) AS year, 'Q' || quarter(date) AS quarter, sum(actual_kms) AS km FROM daily GROUP BY 1, 2, 3")
def p26(d: Domain):
    day = F.col("operations_date")
    return d.operations.groupBy("depot", F.year(day).alias("year"), timeparts.quarter_label(day).alias("quarter")).agg(
        F.sum("opd_kms").alias("km"))


@query("P27_weather_parts", """
    SELECT depot, date, max_temp - min_temp AS temp_range, (max_temp + min_temp) / 2 AS avg_temp,
           CASE WHEN daily_rainfall > 0 THEN 1 ELSE 0 END AS is_rainy, CASE WHEN daily_rainfall > 10 THEN 1 ELSE 0 END AS is_heavy_rain
    FROM weather""", "temp_range avg_temp", digits=9)
def p27(d: Domain):
    return d.weather.withColumns(timeparts.weather_parts()).drop("max_temp", "min_temp", "daily_rainfall")


@query("P28_indian_digits", r"""
    SELECT depot, date, regexp_replace(
        CASE WHEN length(v) <= 3 THEN v ELSE
             reverse(regexp_replace(reverse(left(v, -3)), '(\d\d)', '\1,', 'g')) || ',' || right(v, 3) END, '^,', '') AS earned
    FROM (SELECT depot, date, round_even(revenue, 0)::BIGINT::VARCHAR AS v FROM daily)""")
def p28(d: Domain):
    return d.daily.select("depot", "date", clean.indian_digits(F.col("revenue")).alias("earned"))


@query("P29_default_fill", """
    SELECT depot, service_number, coalesce(breakeven_cpk, 25) AS cpk FROM services""", "cpk")
def p29(d: Domain):
    return d.services.select("depot", "service_number", F.coalesce("breakeven_cpk", F.lit(25.0)).alias("cpk"))


@query("P30_forecast_band", """
    SELECT depot, data_date, Spot_Absent AS v, greatest(Spot_Absent - CASE WHEN Spot_Absent >= 10 THEN 3 ELSE 2 END, 0) AS lo,
           Spot_Absent + CASE WHEN Spot_Absent >= 10 THEN 3 ELSE 2 END AS hi FROM sheet""")
def p30(d: Domain):
    lo, hi = clean.forecast_band(F.col("Spot_Absent"))
    return d.sheet.select("depot", "data_date", F.col("Spot_Absent").alias("v"), lo.alias("lo"), hi.alias("hi"))


# ---- validation ---------------------------------------------------------------
@query("V02_null_keys", """
    SELECT * FROM (SELECT 'null_key' AS rule, 'depot' AS "column", count(*) FILTER (WHERE depot IS NULL) AS n FROM arrivals UNION ALL
    SELECT 'null_key', 'employee_id', count(*) FILTER (WHERE employee_id IS NULL) FROM arrivals UNION ALL
    SELECT 'null_key', 'operations_date', count(*) FILTER (WHERE operations_date IS NULL) FROM arrivals) WHERE n > 0""")
def v02(d: Domain):
    return quality.null_keys(clean.clean_operations(d.bronze), ["depot", "employee_id", "operations_date"])


@query("V03_single_date", """
    SELECT trip_id, min(operations_date) AS first_date, max(operations_date) AS last_date, 0 AS undated FROM operations
    GROUP BY 1 HAVING count(DISTINCT operations_date) > 1""")
def v03(d: Domain):
    return quality.single_date(d.operations, "trip_id", "operations_date")


@query("V04_duplicate_keys", """
    SELECT depot, operations_date, service_number, count(*) AS n FROM operations GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def v04(d: Domain):
    return quality.duplicate_keys(d.operations, ["depot", "operations_date", "service_number"])


@query("V05_unknown_members", f"""
    SELECT depot, n FROM ({_MAPPED}) WHERE depot NOT IN (SELECT depot FROM depots)""")
def v05(d: Domain):
    named = raw_names(d, clean.clean_operations(d.bronze).select("depot"))
    return quality.unknown_members(clean.map_values(named, "depot", clean.depot_name_table(d.spark)), d.depots, "depot")


@query("V06_row_count", "SELECT date, count(*) AS n, 25 AS expected FROM daily GROUP BY 1 HAVING count(*) <> (SELECT count(*) FROM depots)")
def v06(d: Domain):
    return quality.row_count_matches(d.daily, d.depots, "date")


@query("V07_bounds", """
    SELECT 'below' AS rule, 'passengers_per_day' AS "column", count(*) FILTER (WHERE passengers_per_day < 0) AS n FROM gold
    UNION ALL SELECT 'below', 'actual_kms', count(*) FILTER (WHERE actual_kms < 30) FROM gold
    UNION ALL SELECT 'below', 'occupancy_ratio', count(*) FILTER (WHERE occupancy_ratio < 0) FROM gold
    UNION ALL SELECT 'above', 'occupancy_ratio', count(*) FILTER (WHERE occupancy_ratio > 0.8) FROM gold
    UNION ALL SELECT 'below', 'passenger_kms', count(*) FILTER (WHERE passenger_kms < 0) FROM gold""")
def v07(d: Domain):
    limits = {**quality.DEPOT_BOUNDS, "actual_kms": (30, None), "occupancy_ratio": (0, 0.8)}
    return quality.bounds(d.gold, limits, keep_zero=True)


@query("V08_missing_report", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS n FROM arrivals"""
    for c in ("depot", "operations_date", "employee_id", "service_number", "opd_kms", "service_type", "day_night")))
def v08(d: Domain):
    return quality.missing_report(clean.clean_operations(d.bronze))


STEPS["files"] = """
    SELECT depot, date, actual_kms, occupancy_ratio,
           CASE WHEN isodow(date) = 7 THEN 'drop_' || strftime(date, '%Y%m%d') || '.csv'
                WHEN isodow(date) = 6 THEN 'ops_daily_' || strftime(date + INTERVAL 1 DAY, '%Y-%m-%d') || '.csv'
                ELSE 'ops_daily_' || strftime(date, '%Y-%m-%d') || '.csv' END AS file FROM daily"""


def arriving_files(d: Domain):
    day = F.col("date")
    name = (
        F.when(F.weekday(day) == 6, F.concat(F.lit("drop_"), F.date_format(day, "yyyyMMdd"), F.lit(".csv")))
        .when(F.weekday(day) == 5, F.concat(F.lit("ops_daily_"), F.date_format(F.date_add(day, 1), "yyyy-MM-dd"), F.lit(".csv")))
        .otherwise(F.concat(F.lit("ops_daily_"), F.date_format(day, "yyyy-MM-dd"), F.lit(".csv")))
    )
    return d.daily.select("depot", "date", "actual_kms", "occupancy_ratio", name.alias("file"))


@query("V09_date_rules", """
    SELECT file, file_date, data_date, rule FROM (
        SELECT file, data_date, try_strptime(regexp_extract(file, 'ops_daily_(\\d{4}-\\d{2}-\\d{2})\\.csv$', 1), '%Y-%m-%d')::DATE AS file_date,
               CASE WHEN file_date IS NULL THEN 'no_date_in_name' WHEN file_date <> data_date THEN 'date_mismatch'
                    WHEN data_date > DATE '2001-01-01' THEN 'future_date' END AS rule
        FROM (SELECT DISTINCT file, date AS data_date FROM files)) WHERE rule IS NOT NULL""")
def v09(d: Domain):
    files = arriving_files(d).select("file", F.col("date").alias("data_date")).distinct()
    files = files.withColumn("file_date", quality.classify_file(F.col("file"))["file_date"])
    return quality.date_rules(files, "2001-01-01")


@query("V10_already_loaded", """
    SELECT date, count(*) AS n FROM daily WHERE date IN (SELECT prediction_date FROM ledger) GROUP BY 1""")
def v10(d: Domain):
    arriving = d.ledger.select(F.col("prediction_date").alias("date"))
    return quality.already_loaded(arriving, d.daily)


@query("V11_date_gaps", """
    SELECT depot, date FROM (SELECT depot, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date
                             FROM daily GROUP BY depot) s WHERE NOT EXISTS (FROM daily x WHERE x.depot = s.depot AND x.date = s.date)""")
def v11(d: Domain):
    return quality.series_gaps(d.daily)


@query("V11_gap_to_arrival", """
    SELECT unnest(generate_series(last + 1, least(last + 30, arrived - 1), INTERVAL 1 DAY))::DATE AS date
    FROM (SELECT max(prediction_date) AS last FROM ledger), (SELECT max(date) AS arrived FROM daily)""")
def v11b(d: Domain):
    arrived = d.operations.agg(F.max("operations_date")).scalar()
    return quality.date_gaps(d.ledger.select(F.col("prediction_date").alias("date")), arrived)


_RULES = {**quality.SHEET_RULES, "Planned_Schedules": (95, 999), "Drivers_Required": (1, 312)}


@query("V12_sheet_rules", " UNION ALL ".join(
    f"""SELECT depot, data_date, '{c}' AS "column", {c} AS value FROM sheet WHERE {c} < {lo}""" + (f" OR {c} > {hi}" if hi else "")
    for c, (lo, hi) in _RULES.items()))
def v12(d: Domain):
    return quality.sheet_rules(d.sheet, _RULES)


@query("V13_reason_totals", "SELECT depot, data_date, mu_diff, sl_diff FROM kpis WHERE mu_diff <> 0 OR sl_diff <> 0")
def v13(d: Domain):
    from depotlens.functions.kpi import derive_kpis

    return quality.reason_totals(derive_kpis(d.sheet))


@query("V14_non_negative_int", """
    SELECT depot, data_date, 'pct_leave' AS "column", pct_leave AS value FROM kpis WHERE pct_leave < 0 OR pct_leave <> floor(pct_leave)
    UNION ALL SELECT depot, data_date, 'available_2', available_2 FROM kpis WHERE available_2 < 0
    UNION ALL SELECT depot, data_date, 'service_check', service_check FROM kpis WHERE service_check < 0""", "value")
def v14(d: Domain):
    from depotlens.functions.kpi import derive_kpis

    cols = ["pct_leave", "available_2", "service_check", "km_variance"]
    cells = derive_kpis(d.sheet).select("depot", "data_date", *[F.col(c).cast("double").alias(c) for c in cols])
    return quality.non_negative_int(cells, ["depot", "data_date"], cols, ["km_variance"])


@query("V15_name_pattern", "SELECT DISTINCT n AS name FROM (SELECT depot || '/' || route AS n, product FROM services) "
       "WHERE NOT regexp_full_match(n, '[A-Za-z][A-Za-z0-9 ._#/\\-]*') OR n LIKE '%2%'")
def v15(d: Domain):
    names = d.services.select(F.concat_ws("/", "depot", "route").alias("name"))
    return quality.name_pattern(names, "name", r"^[A-Za-z][A-Za-z013-9 ._#/\-]*$")


STEPS["service_rows"] = """
    SELECT depot, date, CASE WHEN k % 97 <> 0 THEN service_number END AS service_number, CASE WHEN k % 89 = 0 THEN -1 ELSE revenue END AS revenue,
           CASE WHEN isodow(date) = 7 THEN 'ops_daily_' ELSE 'ops_daily_service_' END || strftime(date, '%Y-%m-%d') || '.csv' AS file
    FROM (SELECT *, service_number::INTEGER AS k FROM service_daily)"""


def arriving_services(d: Domain):
    """Service files: some without a number or with a negative revenue, Sunday's under the name of a depot file."""
    k, day = F.col("service_number").cast("int"), F.date_format("date", "yyyy-MM-dd")
    name = F.concat(F.when(F.weekday("date") == 6, "ops_daily_").otherwise("ops_daily_service_"), day, F.lit(".csv"))
    return d.service_daily.select(
        "depot", "date", F.when(k % 97 != 0, F.col("service_number")).alias("service_number"),
        F.when(k % 89 == 0, -1.0).otherwise(F.col("revenue")).alias("revenue"), name.alias("file"))


_PRE = "DATE '2001-01-01'"


STEPS["file_rows"] = """
    SELECT f.*, regexp_extract(file, 'ops_daily_(\\d{4}-\\d{2}-\\d{2})\\.csv$', 1) AS x,
                      CASE WHEN x = '' THEN NULL ELSE strptime(x, '%Y-%m-%d')::DATE END AS file_date FROM files f"""


@query("V16_preflight", f"""
    SELECT file, rule, n FROM (
        SELECT file, 'bad_name' AS rule, count(*) FILTER (WHERE x = '') AS n FROM file_rows GROUP BY 1 UNION ALL
        SELECT file, 'date_mismatch', count(*) FILTER (WHERE file_date <> date) FROM file_rows GROUP BY 1 UNION ALL
        SELECT file, 'future_date', count(*) FILTER (WHERE date > {_PRE}) FROM file_rows GROUP BY 1 UNION ALL
        SELECT file, 'already_loaded', count(*) FILTER (WHERE date IN (SELECT prediction_date FROM ledger)) FROM file_rows GROUP BY 1 UNION ALL
        SELECT file, 'unknown_depot', count(*) FILTER (WHERE depot NOT IN (SELECT depot FROM depots)) FROM file_rows GROUP BY 1 UNION ALL
        SELECT file, 'range_occupancy_ratio', count(*) FILTER (WHERE occupancy_ratio > 0.9) FROM file_rows GROUP BY 1 UNION ALL
        SELECT file, 'date_gap', greatest(min(date) - (SELECT max(prediction_date) FROM ledger) - 1, 0) FROM file_rows GROUP BY 1 UNION ALL
        SELECT file, 'row_count', CASE WHEN count(*) <> (SELECT count(DISTINCT depot) FROM depots) THEN count(*) ELSE 0 END FROM file_rows GROUP BY 1 UNION ALL
        SELECT file, 'several_dates', CASE WHEN min(date) <> max(date) THEN 1 ELSE 0 END FROM file_rows GROUP BY 1) WHERE n > 0""")
def v16(d: Domain):
    master = d.ledger.select("depot", F.col("prediction_date").alias("date"))
    limits = {"actual_kms": (0, None), "occupancy_ratio": (0, 0.9)}
    return quality.preflight(arriving_files(d), master, d.depots, "2001-01-01", limits)


@query("V16_preflight_services", """
    SELECT file, rule, n FROM (
        SELECT file, 'null_key' AS rule, count(*) FILTER (WHERE service_number IS NULL) AS n FROM service_rows GROUP BY 1 UNION ALL
        SELECT file, 'bad_name', count(*) FILTER (WHERE isodow(date) = 7) FROM service_rows GROUP BY 1 UNION ALL
        SELECT file, 'range_revenue', count(*) FILTER (WHERE revenue < 0) FROM service_rows GROUP BY 1 UNION ALL
        SELECT file, 'duplicate_key', count(*) FILTER (WHERE k > 1) FROM (
            SELECT file, depot, date, service_number, count(*) AS k FROM service_rows GROUP BY 1, 2, 3, 4) GROUP BY 1) WHERE n > 0""")
def v16b(d: Domain):
    master = d.service_daily.select("date").limit(0)
    return quality.preflight(arriving_services(d), master, d.depots, "2030-01-01", kind="service")
