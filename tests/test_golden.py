"""Hand-worked rows for single operators."""

import datetime as dt
import hashlib
import random

import pytest
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from depotlens.functions import clean, timeparts
from depotlens.functions.kpi import derive_kpis
from depotlens.operators import features as ft
from depotlens.operators import joins, ledger, quality, quantiles, ratios, reshape, retrieval, rollups, supply
from depotlens.sources import digests, files
from depotlens.sources.views import MU_REASONS, SL_REASONS


def day(text):
    return dt.date.fromisoformat(text)


def hour(h, m=0):
    return h * 3600 + m * 60


def test_duty_hours(frame):
    df = frame([(1, hour(22), hour(4), "N"), (2, hour(22), hour(3), "N"), (3, hour(6), hour(14), "D"), (4, hour(20), hour(2), "D"),
                (5, None, hour(2), "D"), (6, hour(6), hour(14), None), (7, hour(8), hour(6), "N")], "i int, d int, a int, c string")
    out = df.select("i", timeparts.duty_hours(F.col("d"), F.col("a"), F.col("c")).alias("h"))
    assert [r[1] for r in rows(out, "i")] == [6.0, 29.0, 8.0, 6.0, None, 8.0, 22.0]


def test_dates_numbers_and_missing_words(frame):
    df = frame([("05-03-2024",), ("05/03/2024",), ("2024-03-05",), ("31-02-2024",), (" ",), (None,)], "t string")
    assert [r[0] for r in rows(df.select(clean.parse_date(F.col("t"))))] == [day("2024-03-05")] * 3 + [None] * 3
    nums = frame([("1,234",), (" 7.5 ",), ("--",), (None,)], "t string")
    assert [r[0] for r in rows(nums.select(clean.parse_number(F.col("t"))))] == [1234.0, 7.5, None, None]
    words = frame([(" nan",), ("N/A",), ("--",), (" hcu ",), ("",)], "t string")
    assert [r[0] for r in rows(clean.tidy_text(words))] == [None, None, None, "HCU", None]


def test_operations_file(frame):
    raw = frame([("1", " hcu depot", "05-03-2024", "12", "2,500", "n", "x")],
                "`Sl.No` string, `Depot ` string, `DATE` string, `Drv No.` string, `Opt'd KMs.` string, `D.No` string, junk string")
    out = clean.clean_operations(raw)
    assert out.columns == ["depot", "operations_date", "employee_id", "opd_kms", "day_night"]
    assert rows(out) == [("HCU DEPOT", day("2024-03-05"), "12", 2500.0, "N")]
    named = clean.map_values(out, "depot", clean.depot_name_table(out.sparkSession))
    assert rows(named.select("depot")) == [("HCU",)]


def test_depot_names_are_97(spark):
    table = clean.depot_name_table(spark)
    assert table.count() == 97 and table.select("raw_name").distinct().count() == 97


def test_percent_clock_digits_and_band(frame):
    df = frame([("80%",), ("0.75",), ("1.5",), ("x",), (None,)], "t string")
    assert [r[0] for r in rows(df.select(clean.share_from_percent(F.col("t"), 0.7)))] == [0.8, 0.75, 0.015, 0.7, 0.7]
    clock = frame([("06:30",), ("23:59:59",), ("24:00",), ("6",), (None,)], "t string")
    assert [r[0] for r in rows(clock.select(clean.seconds_of_day(F.col("t"))))] == [23400, 86399, None, None, None]
    num = frame([(1234567.0,), (999.0,), (1000.0,), (100000.4,), (-12345.0,)], "x double")
    assert [r[0] for r in rows(num.select(clean.indian_digits(F.col("x"))))] == ["12,34,567", "999", "1,000", "1,00,000", "-12,345"]
    lo, hi = clean.forecast_band(F.col("x"))
    small = frame([(1,), (9,), (10,)], "x int")
    assert rows(small.select(lo, hi)) == [(0, 3), (7, 11), (7, 13)]


def test_periods_and_labels(frame):
    assert timeparts.period_range("Quarterly", 2024, quarter=4) == (day("2024-10-01"), day("2025-01-01"))
    assert timeparts.period_range("Monthly", 2023, 12) == (day("2023-12-01"), day("2024-01-01"))
    df = frame([(day("2024-03-31"),), (day("2024-04-01"),)], "d date")
    assert [r[0] for r in rows(df.select(timeparts.financial_year(F.col("d"))))] == ["2023-2024", "2024-2025"]
    peak = frame([(hour(6),), (hour(10),), (hour(10, 1),), (hour(16, 30),), (hour(20, 31),), (None,)], "s int")
    assert [r[0] for r in rows(peak.select(timeparts.in_peak(F.col("s"))))] == [True, True, False, True, False, False]


def kpi_row(**over):
    base = {"Schedules": 100, "Planned_Schedules": 90, "Planned_Services": 180, "Planned_KM": 20000, "Actual_Services": 175, "Actual_KM": 19000,
            "Total_Drivers": 400, "Medically_Unfit": 10, "Suspended_Drivers": 5, "Weekly_Off_National_Off": 50,
            "Special_Off_Night_Out_IC_Online": 60, "Training_PME_medical": 4, "Others": 6, "Leave_Absent": 12, "Sick_Leave": 8, "Spot_Absent": 3,
            "Drivers_Required": 260, "Double_Duty": 20, "Off_Cancellation": 2, "Drivers_as_Conductors": 1}
    base.update({c: 2 for c in MU_REASONS})
    base.update({c: 0 for c in SL_REASONS})
    base.update(over)
    return base


def test_kpi_chain(spark):
    cols = list(kpi_row())
    schema = ", ".join(f"{c} bigint" for c in cols)
    zero = kpi_row(Total_Drivers=0, Planned_Schedules=0)
    df = derive_kpis(spark.createDataFrame([tuple(kpi_row().values()), tuple(zero.values())], schema))
    full, empty = df.collect()
    assert (full.service_variance, full.km_variance, full.available_1, full.deductions) == (-5, -1000, 385, 140)
    assert (full.available_2, full.attending, full.shortage, full.on_duty, full.for_bus) == (245, 242, 18, 264, 263)
    assert full.pct_leave == 3.0 and full.pct_others == 2.5
    assert full.km_per_driver == pytest.approx(19000 / 263) and full.service_check == 88
    assert (full.mu_total, full.mu_diff, full.sl_total, full.sl_diff) == (10, 0, 0, -8)
    assert empty.pct_leave == 0 and empty.driver_schedule == 0 and empty.km_per_driver == 0


def test_quality_rules(frame):
    df = frame([("A", day("2024-01-01"), 5.0), ("A", day("2024-01-01"), -1.0), (None, None, 3.0)], "depot string, date date, x double")
    assert rows(quality.null_keys(df, ["depot", "date"])) == [("null_key", "depot", 1), ("null_key", "date", 1)]
    assert rows(quality.duplicate_keys(df, ["depot", "date"])) == [("A", day("2024-01-01"), 2)]
    assert rows(quality.bounds(df, {"x": (0, 4)})) == [("below", "x", 1), ("above", "x", 1)]
    gaps = frame([("A", day("2024-01-01")), ("A", day("2024-01-04"))], "depot string, date date")
    assert [r[1] for r in rows(quality.series_gaps(gaps), "date")] == [day("2024-01-02"), day("2024-01-03")]
    ahead = quality.date_gaps(gaps, F.lit("2024-03-01").cast("date"))
    assert ahead.count() == 30
    assert quality.date_gaps(gaps, F.lit("2024-01-05").cast("date")).count() == 0


def test_append_gate_stops_incomplete_rows(frame, spark, tmp_path):
    good, bad = frame([(1, "a")], "i int, t string"), frame([(2, None)], "i int, t string")
    path = str(tmp_path / "t")
    files.append_complete(good, path)
    with pytest.raises(PySparkException):
        files.append_complete(bad, path)
    assert spark.read.parquet(path).count() == 1


def test_arrivals_are_classified_by_name(spark, tmp_path):
    for name in ("ops_daily_2024-01-05.csv", "ops_daily_service_2024-01-06.csv", "notes.csv"):
        (tmp_path / name).write_text("depot,x\nA,1\n")
    out = files.scan_arrivals(spark, str(tmp_path), "depot string, x int").select("file", "kind", "file_date")
    assert rows(out, "file") == [("notes.csv", "unknown", None), ("ops_daily_2024-01-05.csv", "depot", day("2024-01-05")),
                                 ("ops_daily_service_2024-01-06.csv", "service", day("2024-01-06"))]


def test_hash_of_a_file(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"abc")
    assert files.file_hashes(spark, str(tmp_path)).collect()[0].sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_hash_of_a_file_over_two_gigabytes(spark, tmp_path):
    size = (2 << 30) + 5
    with open(tmp_path / "a.bin", "wb") as file:
        file.truncate(size)  # sparse
        file.seek(size - 1)
        file.write(b"x")
    with open(tmp_path / "a.bin", "rb") as file:
        want = hashlib.file_digest(file, "sha256").hexdigest()
    assert rows(files.file_hashes(spark, str(tmp_path))) == [("a.bin", size, want)]


def test_hashes_by_part(spark, tmp_path, monkeypatch):
    part, want = 1000, []
    for size in (1, 64, part - 1, part, part + 1, 2 * part, 3 * part + 63):
        name, data = f"f {size:04d}%20.bin", random.Random(size).randbytes(size)
        (tmp_path / name).write_bytes(data)
        want.append((name, size, hashlib.sha256(data).hexdigest()))
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.hashes.link./in", tmp_path.as_uri())
    for path in (str(tmp_path), "viewfs://hashes/in"):
        spark.sparkContext.setJobGroup(path, "hashes by part")
        out = files.file_hashes(spark, path, "*.bin", part)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(path)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(jobs) == 1 + 4  # the list of files; each part of the largest
        assert rows(out, "file") == want
    monkeypatch.setattr(digests, "available", lambda: False)
    assert rows(files.file_hashes(spark, str(tmp_path), "*.bin", part), "file") == want


def test_a_file_changed_between_its_parts_fails(tmp_path):
    path = tmp_path / "a.bin"
    path.write_bytes(b"abc")
    modified = path.stat().st_mtime_ns // 1_000_000
    state = digests.add_range(digests.start(), str(path), modified, 0, 2)
    assert digests.finish(digests.add_range(state, str(path), modified, 2, 1)) == hashlib.sha256(b"abc").hexdigest()
    with pytest.raises(OSError):
        digests.add_range(state, str(path), modified, 2, 2)
    with pytest.raises(OSError):
        digests.add_range(state, str(path), modified - 5, 2, 1)


def test_fuzzy_names(frame):
    depots = frame([("HAKIMPET",), ("MIYAPUR-I",), ("MIYAPUR-II",), ("WARANGAL CITY NORTH",)], "depot string")
    typed = frame([("hakimpet ",), ("miyapur",), ("north city warangal",), ("depot hakimpet east",), ("zzz",), ("",), (None,)], "name string")
    got = {r.name: r.depot for r in joins.fuzzy_depot(typed, depots).collect()}
    assert got == {"hakimpet ": "HAKIMPET", "miyapur": "MIYAPUR-I", "north city warangal": "WARANGAL CITY NORTH",
                   "depot hakimpet east": "HAKIMPET", "zzz": None}


def test_asof_and_dense_months(frame):
    wanted = frame([("A", day("2024-01-01")), ("A", day("2024-01-05"))], "depot string, date date")
    weather = frame([("A", day("2024-01-03"), 30.0, 20.0, None)], "depot string, date date, max_temp double, min_temp double, daily_rainfall double")
    got = rows(joins.asof_weather(wanted, weather), "date")
    assert got[0][2] is None and got[1][2:] == (day("2024-01-03"), 30.0, 20.0, None)
    month = frame([("A", day("2024-02-01"), 3)], "k string, month date, n int")
    dense = joins.dense_months(month, ["k"], "2024-01-01", "2024-03-01", ["n"])
    assert [r[2] for r in rows(dense, "month")] == [0, 3, 0]


def test_median_fallback_is_weighted_by_duties(frame):
    ops = frame([("A", "1")] * 3 + [("A", "2"), ("A", "9")], "depot string, service_number string")
    steering = frame([("A", "1", 8.0, 2), ("A", "2", 9.0, 0)], "depot string, service_number string, steering_hours double, no_of_drvs int")
    got = rows(joins.with_steering(ops, steering).select("service_number", "steering_hours", "hours_source").distinct(), "service_number")
    assert got == [("1", 4.0, "Actual"), ("2", 9.0, "Actual"), ("9", 4.0, "Estimated (Median)")]


def test_upsert_and_keyed_writes(frame):
    master = frame([("A", 1, 1.0), ("B", 1, 2.0)], "k string, d int, v double")
    inbound = frame([("B", 1, 9.0), ("C", 1, 3.0)], "k string, d int, v double")
    assert rows(reshape.upsert(master, inbound, ["k", "d"]), "k") == [("A", 1, 1.0), ("B", 1, 9.0), ("C", 1, 3.0)]
    assert rows(reshape.upsert_counts(master, inbound, ["k", "d"])) == [(1, 1)]
    assert rows(ledger.insert_if_absent(master, inbound, ["k", "d"]), "k") == [("A", 1, 1.0), ("B", 1, 2.0), ("C", 1, 3.0)]
    text = frame([("A", ""), ("B", "x"), ("C", None)], "k string, t string")
    new = frame([("A", "n"), ("B", "n")], "k string, t string")
    assert rows(reshape.fill_missing(text, new, ["k"], "t"), "k") == [("A", "n"), ("B", "x"), ("C", None)]


def test_holiday_calendar(frame):
    wide = frame([(2, "b", "X", "01-01-2024; 02-01-2024", None), (1, "a", "Y", "02-01-2024,\n31-02-2024", "05/01/2025|06/01/2025")],
                 "fes_hol_code int, holiday_festival string, fes_hol_category string, `2024_dates` string, `2025_dates` string")
    got = [(str(r.date), r.fes_hol_code) for r in reshape.holiday_long(wide).orderBy("date").collect()]
    assert got == [("2024-01-01", 2), ("2024-01-02", 1), ("2025-01-05", 1), ("2025-01-06", 1)]


def test_close_pending(frame):
    led = frame([("A", day("2024-01-01"), 100.0, 10.0, "pending"), ("A", day("2024-01-02"), 100.0, 10.0, "pending"),
                 ("A", day("2024-01-03"), 100.0, 10.0, "completed"), ("A", day("2024-01-04"), 100.0, 10.0, "pending")],
                "depot string, prediction_date date, predicted_passenger_kms double, estimated_kms double, status string")
    act = frame([("A", day("2024-01-01"), 0.5, 80.0, 8.0), ("A", day("2024-01-02"), 0.5, 0.0, None), ("A", day("2024-01-03"), 0.5, 80.0, 8.0)],
                "depot string, date date, occupancy_ratio double, passenger_kms double, actual_kms double")
    out = {str(r.prediction_date)[-2:]: r for r in ledger.close_pending(led, act).collect()}
    assert (out["01"].status, out["01"].pkm_error, out["01"].pkm_error_pct, out["01"].km_error_pct) == ("completed", 20.0, 25.0, 25.0)
    assert (out["02"].status, out["02"].pkm_error, out["02"].pkm_error_pct, out["02"].km_error) == ("completed", None, None, None)
    assert out["03"].actual_kms is None and out["04"].status == "pending"


def test_schedule_match_categories(frame):
    plan = frame([("A", "100", "CUT", 5.0, 1.0), ("A", "200", "ADD_SLOT", 0.0, 1.0)],
                 "depot string, service_number string, action string, allocated_pkm double, revenue double")
    ran = frame([("A", "100", 6.0, 2.0), ("A", "8123", 1.0, 1.0), ("A", "81234", 1.0, 1.0)],
                "depot string, service_number string, actual_pkm double, actual_revenue double")
    got = {r.service_number: (r.category, r.pkm_delta_pct) for r in ledger.match_schedule(plan, ran, ["depot", "service_number"]).collect()}
    assert got == {"100": ("Scheduled", 20.0), "200": ("Scheduled (No Actuals)", None), "8123": ("Extra Service", None), "81234": ("New Service", None)}
    total = ledger.schedule_vs_actual(ledger.match_schedule(plan, ran, ["depot", "service_number"])).collect()[0]
    assert (total.scheduled, total.run, total.extra, total.new, total.pkm_delta) == (2, 3, 1, 1, 3.0)


def test_next_slot(frame):
    services = frame([("A", "r", hour(6)), ("A", "r", hour(6)), ("A", "r", hour(7, 1)), ("A", "r", hour(9))], "depot string, route string, dep_sec int")
    got = [(r.dep_sec, r.slot) for r in supply.next_slot(services).orderBy("dep_sec").collect()]
    assert got == [(hour(6), "06:00:00"), (hour(7, 1), "08:00:00"), (hour(9), None)]


def test_quadrants(frame):
    df = frame([(30.0, 25.0, 0.7), (25.0, 25.0, 0.69), (10.0, 25.0, 0.9), (10.0, 25.0, 0.1)], "e double, c double, o double")
    out = [r[0] for r in rows(df.select(supply.quadrant(F.col("e"), F.col("c"), F.col("o"))))]
    assert out == ["UNDERSUPPLY", "OVERSUPPLY", "SOCIAL_OBLIGATION", "INEFFICIENT"]


def test_forecast_falls_back_only_without_predictions(frame):
    led = frame([("A", day("2024-01-01"), None, 10.0, 45)], "depot string, prediction_date date, predicted_passenger_kms double, estimated_kms double, bus_capacity int")
    ops = frame([("B", day("2023-01-01"), 5.0)], "depot string, date date, passenger_kms double")
    assert rows(supply.resolve_forecast(led, ops)) == [("A", 10.0 * 45 * 0.75)]
    assert rows(supply.resolve_forecast(led, ops, "2025-01-01")) == [("B", 5.0)]


def test_drivers_per_schedule_definitions(frame):
    sheet = frame([("A", 300, 100), ("A", 100, 30), ("A", 50, 0)], "depot string, Total_Drivers int, Planned_Schedules int")
    assert rows(ratios.drivers_per_schedule(sheet, ["depot"]))[0][1] == pytest.approx(450 / 130)
    assert rows(ratios.drivers_per_schedule(sheet, ["depot"], "mean_of_ratios"))[0][1] == pytest.approx((3.0 + 3.33) / 2)


def test_festival_distance_first_and_last_row(frame):
    flags = [1, 0, 0, 1, 0, 1, 1]
    df = frame([("A", day("2024-01-01") + dt.timedelta(days=i), f, 5 if f else 0) for i, f in enumerate(flags)],
               "depot string, date date, is_fes_hol int, fes_hol_code int")
    got = rows(ft.festival_distance(df).select("days_to_next_festival", "days_since_last_festival", "next_fes_hol_code", "date"), "date")
    assert [g[0] for g in got] == [0, 2, 1, 0, 1, 0, 0] and [g[1] for g in got] == [0, 1, 2, 0, 1, 0, 0]
    runs = rows(ft.festival_runs(df).select("festival_cluster_len", "next_festival_cluster_len", "date"), "date")
    assert [r[0] for r in runs] == [1, 1, 1, 1, 1, 2, 2] and [r[1] for r in runs] == [1, 1, 1, 1, 2, 2, 2]


def test_vector_search_in_chunks_and_with_filters(spark):
    docs = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0], i % 3) for i in range(60)], "doc_id bigint, vector array<double>, tag bigint")
    queries = spark.createDataFrame([(i, [1.0, float(i), 0.5], i % 3) for i in range(9)], "query_id bigint, vector array<double>, tag bigint")
    whole = rows(retrieval.vector_topk(docs, queries, 4), "query_id", "place")
    assert whole == rows(retrieval.vector_topk(docs, queries, 4, query_bytes=64), "query_id", "place")
    own = retrieval.vector_topk(docs, queries, 4, filter_mode="pre").join(docs, "doc_id").join(queries.select("query_id", F.col("tag").alias("qt")), "query_id")
    assert own.filter("tag <> qt").count() == 0 and own.count() == 36
    assert retrieval.vector_topk(docs, queries, 4, filter_mode="post").count() < 36


def test_ranks_are_dense_across_ranges(frame):
    df = frame([(i, float(i * 37 % 101)) for i in range(500)], "id int, v double")
    got = [(r.rank, r.v, r.id) for r in rollups.ranked(df, "v", ["id"]).orderBy("rank").collect()]
    want = sorted(((-v, i) for i, v in df.collect()))
    assert [g[0] for g in got] == list(range(1, 501)) and [(-g[1], g[2]) for g in got] == want


def test_quantiles_of_skewed_group(frame):
    values = [("hot", float(i % 17)) for i in range(3000)] + [("cold", 1.0), ("cold", 2.0)]
    got = {r.k: (r.a, r.m, r.z) for r in quantiles.exact_quantiles(frame(values, "k string, v double"), ["k"], "v", [0.0, 0.5, 1.0], ["a", "m", "z"]).collect()}
    assert got == {"hot": (0.0, 8.0, 16.0), "cold": (1.0, 1.5, 2.0)}


def test_service_master_defaults(frame):
    raw = frame([(" A ", "7 ", "4", "40", None, None, None), ("B", "8", "x", None, 3.0, "50", 1)],
                "depot string, service_number string, planned_trips string, planned_kms string, km_per_trip double, avg_seats_per_bus string, can_be_cancelled int")
    got = {r.depot: r for r in clean.clean_service_master(raw).collect()}
    assert (got["A"].service_number, got["A"].km_per_trip, got["A"].avg_seats_per_bus, got["A"].can_be_cancelled) == ("7", 0.0, 45.0, 0)
    assert (got["B"].planned_trips, got["B"].planned_kms, got["B"].km_per_trip, got["B"].can_be_cancelled) == (0, 0.0, 3.0, 1)
    empty = {r.depot: r for r in clean.clean_service_master(raw.drop("km_per_trip", "can_be_cancelled")).collect()}
    assert (empty["A"].km_per_trip, empty["B"].km_per_trip, empty["A"].can_be_cancelled) == (10.0, 0.0, 1)


def test_daily_services_are_coerced(frame):
    raw = frame([(" A", "7 ", "2024-01-05", "1,2", "", "3.5"), ("B", "8", "31-02-2024", "12", "4", "x")],
                "depot string, service_number string, date string, actual_kms string, actual_trips string, revenue string")
    got = {r.depot: r for r in clean.clean_daily_services(raw).collect()}
    assert (str(got["A"].date), got["A"].actual_kms, got["A"].actual_trips, got["A"].revenue) == ("2024-01-05", None, 0.0, 3.5)
    assert (got["B"].date, got["B"].actual_kms, got["B"].actual_trips, got["B"].revenue) == (None, 12.0, 4.0, None)


def test_label_key_keeps_other_scripts(frame):
    got = [r.k for r in frame([("  Été_(No.%) /x ",), ("हिन्दी-A",)], "t string").select(clean.label_key(F.col("t")).alias("k")).collect()]
    assert got == ["ete no x", "हिन्दी a"]


def test_weighted_mean_reaches_all_rows(spark):
    import pandas as pd

    from depotlens.operators import features as ft

    for span, n in ((180, 400), (7, 3000), (1, 10)):
        y = pd.Series([(i * 37) % 101 for i in range(n)], dtype=float)
        df = spark.createDataFrame([("D", i, float(v)) for i, v in enumerate(y)], "depot string, date int, y double")
        got = [r.ewm_7 for r in ft.ewm(df, "y", span).orderBy("date").collect()]
        want = y.ewm(span=span, adjust=True).mean().shift(1)
        assert got[0] is None and got[1:] == pytest.approx(want.tolist()[1:], rel=1e-9)


def test_pivot_rounds_cells_before_totals(frame):
    from depotlens.operators import rollups

    duties = frame([(1, "2024-01-01", 1.4, "Actual"), (1, "2024-01-02", 1.4, "Mean"), (2, "2024-01-01", 2.5, "Actual"), (2, "2024-01-01", 1.0, "Actual")],
                   "employee_id int, operations_date string, steering_hours double, hours_source string")
    got = {(r.part, r.employee_id, r.date): r.hours for r in rollups.steering_pivot(duties).collect()}
    assert got[("cell", 2, "2024-01-01")] == 4 and got[("employee", 1, None)] == 2 and got[("date", None, "2024-01-01")] == 5 and got[("total", None, None)] == 6
    mask = {(r.employee_id, r.date): r.estimated for r in rollups.estimated_mask(duties).collect()}
    assert mask == {(1, "2024-01-01"): 0, (1, "2024-01-02"): 1, (2, "2024-01-01"): 0}


def test_scores_are_scaled_within_the_depot(frame):
    from depotlens.operators import rollups

    perf = frame([("A", 1, 0.0, 1.0, 0.0, 0), ("A", 2, 10.0, 1.0, 4.0, 2), ("B", 3, 500.0, 9.0, 1.0, 1)],
                 "depot string, employee_id int, km double, earnings double, hours double, leaves int")
    assert {r.employee_id: r.score for r in rollups.driver_score(perf).collect()} == {1: 0.0, 2: 1.0, 3: 0.0}


def test_older_prediction_columns(frame):
    from depotlens.operators import ledger as lg

    rows = frame([("A", "2024-01-01", None, "pending", 7.0, 8.0, -1.0, -12.5), ("B", "2024-01-01", 5.0, "pending", 6.0, None, None, None)],
                 "depot string, prediction_date string, predicted_passenger_kms double, status string, predicted_passengers double, "
                 "actual_passengers double, passenger_error double, passenger_error_pct double")
    got = {r.depot: (r.predicted, r.actual, r.error) for r in lg.accuracy_table(rows, "demand").collect()}
    assert got == {"A": (7.0, 8.0, -1.0), "B": (5.0, None, None)}


def test_names_with_typos_are_matched(frame):
    depots = frame([("HANAMKONDA",), ("NIZAMABAD-I",), ("MIYAPUR-I",), ("MIYAPUR-II",), ("UPPAL",)], "depot string")
    typed = frame([("HANAMKODA",), ("NIZAMABAD DEPOT",), ("miyapur 1",), ("zzz",), (None,), ("uppal",), ("depot uppal",)], "name string")
    got = {r.name: r.depot for r in joins.fuzzy_depot(typed, depots).collect()}
    assert got == {"HANAMKODA": "HANAMKONDA", "NIZAMABAD DEPOT": "NIZAMABAD-I", "miyapur 1": "MIYAPUR-I", "zzz": None, "uppal": "UPPAL", "depot uppal": "UPPAL"}


def test_ranges_split_ties_and_hot_groups(spark):
    n = 40_000
    df = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("v"))
    got = rollups.ranked(df, "v", ["id"], rows_per_range=2_000)
    want = df.orderBy(F.desc("v"), "id").collect()
    assert [r.id for r in got.orderBy("rank").collect()] == [r.id for r in want]
    assert [r["rank"] for r in got.select("rank").orderBy("rank").collect()] == list(range(1, n + 1))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "_range" in plan


def test_search_has_one_plan_for_any_number_of_queries(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.array(F.col("id") * 1.0, F.lit(1.0)).alias("vector"), (F.col("id") % 3).alias("tag"))

    def plan(n, mode):
        queries = spark.range(n).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.col("id") * 1.0).alias("vector"), (F.col("id") % 3).alias("tag"))
        text = retrieval.vector_topk(docs, queries, 3, filter_mode=mode)._jdf.queryExecution().executedPlan().toString()
        return text.count("MapInPandas"), text.count("Range ("), text.count("Exchange")

    for mode in ("none", "pre", "post"):
        assert plan(10, mode) == plan(10_000, mode) and plan(10, mode)[1] == 1


# ---- small cases that the queries over whole tables don't hold ---------------------------------
def test_members_that_a_dimension_lacks(spark, frame):
    from depotlens.operators import joins, quality, reshape

    facts = frame([("A", 1), ("Z", 2), ("Z", 3), (None, 4)], "depot string, x int")
    known = frame([("A", "Rural"), ("B", "Urban")], "depot string, category string")
    assert [(r.depot, r.n) for r in quality.unknown_members(facts, known, "depot").collect() if r.depot] == [("Z", 2)]
    found = {(r.x, r.category) for r in joins.lookup(facts, known, "depot", "category").collect()}
    assert {(1, "Rural"), (2, "Unknown"), (3, "Unknown")} <= found
    codes = reshape.label_codes(frame([("b",), ("a",), ("b",)], "route string"), "route")
    coded = reshape.encode(frame([("a",), ("b",), ("new",)], "route string"), "route", codes, "code")
    assert sorted((r.route, r.code) for r in coded.collect()) == [("a", 0), ("b", 1), ("new", 2)]
    days = frame([("A", 1), ("A", 2)], "depot string, date int")
    assert [r.date for r in reshape.delete_keys(days, frame([("A", 2), ("B", 1)], "depot string, date int"), ["depot", "date"]).collect()] == [1]


def test_hours_and_leaves_without_a_grade(spark, frame):
    from depotlens.operators import joins

    hours = frame([(1, 5.0), (2, 7.0)], "employee_id long, hours double")
    health = frame([(1, "A", "d"), (3, "B", "d")], "employee_id long, final_grading string, depot string")
    assert sorted((r.employee_id, r.final_grading) for r in joins.hours_by_grade(hours, health).collect()) == [(1, "A"), (2, None)]
    absences = frame([(1, "L"), (4, "S")], "employee_id long, leave_type string")
    full = {(r.employee_id, r.leaves, r.final_grading) for r in joins.leaves_by_grade(absences, health, "full").collect()}
    assert full == {(1, 1, "A"), (3, None, "B"), (4, 1, None)}
    assert [r.employee_id for r in joins.leaves_by_grade(absences, health, "inner").collect()] == [1]


def test_equal_vectors_send_k_rows_a_query(spark):
    from depotlens.operators import retrieval

    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector"), F.lit(0).cast("long").alias("tag"))
    queries = spark.createDataFrame([(q, [1.0, float(q)]) for q in range(40)], "query_id long, vector array<double>").withColumn("tag", F.lit(0).cast("long"))
    sent = retrieval._block_topk(docs.repartition(4), queries.collect(), 5, False, False)
    most = sent.groupBy("query_id", F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]
    assert most == 5
    got = retrieval.vector_topk(docs, queries, 5).collect()
    assert len(got) == 200 and all(r.doc_id == r.place - 1 for r in got)


def test_medians_fill_gaps_of_all_columns(frame):
    from depotlens.operators import ledger

    rows = [(1.0, None, 0), (2.0, 4.0, 0), (None, 8.0, 0), (4.0, 6.0, 0), (None, None, 1), (99.0, 99.0, 1)]
    got = ledger.impute_median(frame(rows, "a double, b double, is_test int"), ["a", "b"]).collect()
    assert sorted((r.a, r.b) for r in got) == [(1.0, 6.0), (2.0, 4.0), (2.0, 6.0), (2.0, 8.0), (4.0, 6.0), (99.0, 99.0)]


def test_text_vectors_of_known_texts(spark, frame):
    """Unit length, the same for the same words in any order or case; texts without words have none."""
    from depotlens.operators import retrieval

    got = {r.doc_id: r.vector for r in retrieval.embed(frame([(1, "Depot bus bus"), (2, "bus DEPOT, bus"), (3, "bus"), (4, "...")], "doc_id int, text string"), 64).collect()}
    assert got[1] == got[2] and sum(x * x for x in got[1]) == pytest.approx(1.0) and sum(x * x for x in got[4]) == 0
    assert sorted(x for x in got[1] if x) == pytest.approx([5 ** -0.5, 2 * 5 ** -0.5]) and sum(got[3]) == 1.0
