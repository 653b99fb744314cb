"""Physical plans keep the properties that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from depotlens.operators import joins, rollups, supply
from depotlens.plans import QUERIES
from depotlens.sources import files
from depotlens.sources.views import Domain

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, folder):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    rows = files.scan_table(Domain(spark, folder).raw("orders").withColumn("depot", F.col("o_orderstatus")), "o_orderdate", ["F"], "1998-01-01", "1998-02-01")
    text = plan(rows.select("o_orderkey"))
    assert "PushedFilters: [In(o_orderstatus" in text or "EqualTo(o_orderstatus,F)" in text
    assert "GreaterThanOrEqual(o_orderdate" in text
    ranged = plan(Domain(spark, folder).operations_between("1998-01-01", "1998-02-01").select("opd_kms"))
    assert "GreaterThanOrEqual(l_shipdate" in ranged and "LessThan(l_shipdate" in ranged
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_orderdate:\w+>", text)


def test_caps_are_applied_before_the_shuffle(spark, folder):
    d = Domain(spark, folder)
    pool = d.services.withColumn("budget", F.lit(100.0))
    text = plan(supply.capped_allocation(pool, [F.asc("service_number")], "planned_kms", "budget", 2, 25))
    assert re.search(r"WindowGroupLimit.*Partial", text)


def test_facts_are_combined_before_the_shuffle(spark, folder):
    d = Domain(spark, folder)
    text = plan(rollups.monthly_rollup(d.operations, d.services, ["depot"]))
    assert "partial_sum" in text and "Window" not in text
    once = plan(joins.first_per_key(d.operations, ["depot"], ["operations_date"]))
    assert "partial_min" in once and "Window" not in once


def test_depot_windows_share_one_shuffle(spark, folder):
    from depotlens.operators import features as ft

    text = plan(ft.festival_calendar(Domain(spark, folder).gold.withColumn("is_weekend", F.lit(0))))
    # One for the depot-day grouping, one for all windows.
    assert text.count("Exchange hashpartitioning") == 2


def test_hot_group_is_not_gathered(spark):
    """A third of two million rows in one group: quantiles, ranks and first rows still agree with plain counting."""
    from depotlens.operators.quantiles import exact_quantiles

    n = 2_000_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 1000).cast("string"))).alias("k"),
        (F.pmod(F.xxhash64("id"), F.lit(1_000_003))).cast("double").alias("v"), "id")
    got = exact_quantiles(df, ["k"], "v", [0.5], ["m"]).filter("k = 'hot'").collect()[0].m
    want = df.filter("k = 'hot'").agg(F.percentile("v", F.lit(0.5))).collect()[0][0]
    assert got == want
    top = rollups.top_bottom(df, "v", ["id"], n=3, keys=["k"]).filter("k = 'hot' AND side = 'top'")
    best = df.filter("k = 'hot'").orderBy(F.desc("v"), "id").limit(3)
    assert [r.id for r in top.orderBy("place").collect()] == [r.id for r in best.collect()]
    assert joins.first_per_key(df, ["k"], ["id"]).filter("k = 'hot'").collect()[0].id == 0


def test_checkpoint_folder_comes_from_the_session(spark):
    from depotlens.session import shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_shared_tables_are_read_back_instead_of_the_facts(spark, folder):
    from depotlens.plans import QUERIES

    for name in ("M04_trip_schedule", "M11_suggest_slot", "J10_match_schedule", "E04_schedule_vs_actual", "F01_features", "F07_future_rows"):
        assert "lineitem.parquet" not in plan(QUERIES[name].build(Domain(spark, folder))), name


def test_intermediate_tables_can_be_released(spark, monkeypatch):
    import os

    from depotlens import session

    monkeypatch.setattr(session, "_MADE", [])
    made = session.materialise(spark.range(3), "gone")
    path = session._MADE[0]
    assert made.count() == 3 and os.path.isdir(path)
    assert session.release(spark) == 1 and not os.path.exists(path)


@pytest.mark.parametrize("name", ["P21_scope_filter", "V16_preflight_services"])
def test_facts_are_not_sorted_to_meet_depots(spark, folder, name):
    """However large the tables seem: a task that is dealt the facts of a depot would sort them all."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES[name].run(spark, folder))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "SortMergeJoin [l_suppkey" in text and not re.search(r"SortMergeJoin \[(depot|date)", text)


def test_schedules_meet_the_services_where_they_lie(spark, frame):
    """Gaps, changes, recent days and slots are small beside the master: it isn't shuffled or sorted to meet them."""
    from depotlens.session import materialise

    services = materialise(frame(
        [("A", str(i), f"r{i % 3}", "p", 2, 10.0, 60 * i, 1, 20.0, 40.0, 20.0) for i in range(60)] + [("B", "7", None, "p", 1, 5.0, None, 0, None, 40.0, 5.0)],
        "depot string, service_number string, route string, product string, planned_trips int, km_per_trip double, dep_sec int, can_be_cancelled int, "
        "breakeven_cpk double, avg_seats_per_bus double, planned_kms double"), "services")
    ops = materialise(frame(
        [("A", "2001-11-01", str(i), 0.5, 100.0, 10.0 * i) for i in range(60)] + [("A", "2001-10-01", "1", 0.9, 1.0, 1.0), ("A", "2001-11-01", None, 0.9, 1.0, 1.0)],
        "depot string, date string, service_number string, occupancy_ratio double, revenue double, passenger_kms double").withColumn("date", F.col("date").cast("date")), "ops")
    forecast = materialise(frame([("A", 100.0), ("B", 1.0)], "depot string, predicted_pkm double"), "forecast")
    shares = materialise(frame([("A", 0.75)], "depot string, target_share double"), "shares")
    trips = supply.trip_schedule(services, ops, forecast, shares, "2001-11-05")
    slots = supply.slot_schedule(services, ops, forecast, "2001-11-05")
    for df in (trips, slots):
        assert not re.search(r"SortMergeJoin|Exchange hashpartitioning", plan(df))
        assert df.count() == 61
    assert trips.filter("action = 'DECREASE'").groupBy("route").count().filter("count != 2").count() == 0 and trips.filter("trip_change != 0").count() == 6
    assert slots.agg(F.sum("allocated_pkm")).first()[0] == pytest.approx(100.0 * 17700 / 17701)  # a service without a number isn't in the master


def test_drivers_go_to_the_facts(spark, frame, tmp_path):
    """Their size is known from the written table, not guessed as that of suppliers times nations."""
    tables = {
        "region": ([(0, "R")], "r_regionkey long, r_name string"), "nation": ([(0, "N0", 0), (1, "N1", 0)], "n_nationkey long, n_name string, n_regionkey long"),
        "supplier": ([(1, 0), (2, 1), (3, None), (None, 0)], "s_suppkey long, s_nationkey long"),
    }
    for name, (own, schema) in tables.items():
        frame(own, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.range(20_000).select(
        F.col("id").alias("l_orderkey"), F.nullif(F.col("id") % 4, F.lit(0)).alias("l_suppkey"), F.nullif(F.col("id") % 5, F.lit(0)).alias("l_partkey"), F.lit(1).alias("l_linenumber"),
        F.rand(1).alias("l_quantity"), F.rand(2).alias("l_extendedprice"), F.lit(0.1).alias("l_discount"), F.lit("A").alias("l_returnflag"), F.lit("O").alias("l_linestatus"),
        F.lit("2001-11-01").cast("timestamp_ntz").alias("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        d = Domain(spark, str(tmp_path))
        daily = d.written("service_daily")
        text = plan(d.operations)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "BroadcastHashJoin [l_suppkey" in text and "SortMergeJoin" not in text
    assert {(r.depot, r.service_number, r.actual_trips) for r in daily.collect()} == {(n, k, 1000) for n in ("N0", "N1") for k in ("1", "2", "3", "4", None)}
