"""Streaming (R) queries: each runs a stream over the tables and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from depotlens import jobs
from depotlens.plans.registry import STEPS, query
from depotlens.session import work_dir
from depotlens.sources import snapshots
from depotlens.sources.views import Domain
from depotlens.streaming import ingest as st

STEPS["event_days"] = """
    SELECT n_name AS depot, date, coalesce(n, 0) * 45 AS passengers_per_day, coalesce(v, 0) / 100::DOUBLE AS actual_kms, coalesce(p / n::DOUBLE, 0) AS occupancy_ratio
    FROM (SELECT DISTINCT ts::DATE AS date FROM events), nation LEFT JOIN (
        SELECT user_id % 25 AS k, ts::DATE AS day, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS v, count(*) FILTER (WHERE event_type = 'purchase') AS p
        FROM events GROUP BY 1, 2) ON k = n_nationkey AND day = date"""
_COLS = ["depot", "date", "passengers_per_day", "actual_kms", "occupancy_ratio"]
_FILE_SCHEMA = st.DROP_SCHEMA + ", file string"


def event_days(d: Domain):
    """Every depot on every day of the events, so that a day's file is complete."""
    nation = d.raw("nation").select((F.col("n_nationkey") + 0).cast("int").alias("k"), F.col("n_name").alias("depot"))
    rows = d.raw("events").withColumns({"k": (F.col("user_id") % 25).cast("int"), "date": F.col("ts").cast("date")})
    days = rows.select("date").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(24))))
    sums = rows.groupBy("k", "date").agg(
        F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("v"), F.count_if(F.col("event_type") == "purchase").alias("p"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return days.join(nation, "k").join(sums, ["k", "date"], "left").select(
        "depot", "date", (zero(F.col("n")) * 45).alias("passengers_per_day"), (zero(F.col("v")) / 100.0).alias("actual_kms"),
        F.coalesce(F.col("p") / F.col("n"), F.lit(0.0)).alias("occupancy_ratio"))


def drop_files(rows, path: str) -> str:
    """One CSV drop per ``file`` value, the name kept as the folder name."""
    rows.select(*_COLS, "file").write.mode("append").option("header", True).partitionBy("file").csv(path)
    return path


def daily_name(prefix: str = ""):
    return F.concat(F.lit(prefix + "ops_daily_"), F.date_format("date", "yyyy-MM-dd"), F.lit(".csv"))


def load_all(d: Domain, rows, reject: str):
    """Drop the rows as files, stream them in, return the master path and the error log path."""
    drop, base = work_dir(d.spark, "drop"), work_dir(d.spark, "ingest")
    drop_files(rows, drop)
    stream = st.file_stream(d.spark, drop, _FILE_SCHEMA)
    handler = st.load_handler(f"{base}/master", d.depots, "2024-02-01", f"{base}/errors", reject=reject)
    st.ingest(stream, handler, f"{base}/checkpoint").awaitTermination()
    return f"{base}/master", f"{base}/errors"


@query("R01_file_drop_ingest", "SELECT * FROM event_days", "actual_kms occupancy_ratio")
def r01(d: Domain):
    master, _ = load_all(d, event_days(d).withColumn("file", daily_name()), "batch")
    return snapshots.read(d.spark, master, snapshots.schema(d.spark, master)).select(*_COLS)


STEPS["event_services"] = """
    SELECT n_name AS depot, ts::DATE AS date, event_type AS service_number, sum(round(value * 100)::BIGINT) / 100::DOUBLE AS actual_kms,
           count(*)::DOUBLE AS actual_trips, count(DISTINCT user_id)::DOUBLE AS revenue
    FROM events JOIN nation ON n_nationkey = user_id % 25 GROUP BY 1, 2, 3"""


def event_services(d: Domain):
    """Service-day rows of the events: the type of an event stands for the service."""
    nation = d.raw("nation").select((F.col("n_nationkey") + 0).alias("k"), F.col("n_name").alias("depot"))
    rows = d.raw("events").withColumn("k", (F.col("user_id") % 25).cast("int"))
    return rows.groupBy("k", F.col("ts").cast("date").alias("date"), F.col("event_type").alias("service_number")).agg(
        (F.sum(F.round(F.col("value") * 100).cast("bigint")) / 100.0).alias("actual_kms"), F.count("*").cast("double").alias("actual_trips"),
        F.countDistinct("user_id").cast("double").alias("revenue"),
    ).join(nation, "k").drop("k").withColumns({c: F.lit(1.0) for c in ("seat_kms", "passenger_kms", "occupancy_ratio")})


@query("R01_service_files", "SELECT * FROM event_services", "actual_kms")
def r01b(d: Domain):
    """Files of daily services through the gate of their kind."""
    named = event_services(d).withColumn("file", F.concat(F.lit("ops_daily_service_"), F.date_format("date", "yyyy-MM-dd"), F.lit(".csv")))
    drop, base = work_dir(d.spark, "drop"), work_dir(d.spark, "ingest")
    columns = [c.split()[0] for c in st.SERVICE_SCHEMA.split(", ")]
    named.select(*columns, "file").write.mode("append").option("header", True).partitionBy("file").csv(drop)
    handler = st.load_handler(f"{base}/master", d.depots, "2024-02-01", f"{base}/errors", kind="service")
    st.ingest(st.file_stream(d.spark, drop, st.SERVICE_SCHEMA + ", file string"), handler, f"{base}/checkpoint").awaitTermination()
    return snapshots.read(d.spark, f"{base}/master", snapshots.schema(d.spark, f"{base}/master")).select("depot", "date", "service_number", "actual_kms", "actual_trips", "revenue")


@query("S14_archive_files", "SELECT date, count(*) AS n FROM event_days GROUP BY 1")
def s14(d: Domain):
    """Every file is archived: a closing batch follows the last."""
    drop, base = work_dir(d.spark, "drop"), work_dir(d.spark, "ingest")
    drop_files(event_days(d).withColumn("file", daily_name()), drop)
    handler = st.load_handler(f"{base}/master", d.depots, "2024-02-01", f"{base}/errors")

    def run():
        return st.ingest(st.file_stream(d.spark, drop, _FILE_SCHEMA, archive=f"{base}/archive", max_files=10), handler, f"{base}/checkpoint")

    st.archive_all(d.spark, drop, f"{base}/archive", _COLS, run)
    return st.archived_rows(d.spark, f"{base}/archive").groupBy("date").agg(F.count("*").alias("n"))


@query("R02_gate_quarantine", """
    SELECT depot, date, passengers_per_day, actual_kms, occupancy_ratio FROM event_days WHERE isodow(date) <> 7""", "actual_kms occupancy_ratio")
def r02(d: Domain):
    sunday = F.weekday("date") == 6
    named = event_days(d).withColumn("file", F.when(sunday, F.concat(F.lit("x"), daily_name(), F.lit(".txt"))).otherwise(daily_name()))
    master, _ = load_all(d, named, "file")
    return snapshots.read(d.spark, master, snapshots.schema(d.spark, master)).select(*_COLS)


@query("R02_error_log", """
    SELECT 'xops_daily_' || strftime(date, '%Y-%m-%d') || '.csv.txt' AS file, 'bad_name' AS rule, count(*) AS n FROM event_days
    WHERE isodow(date) = 7 GROUP BY 1""")
def r02b(d: Domain):
    sunday = F.weekday("date") == 6
    named = event_days(d).withColumn("file", F.when(sunday, F.concat(F.lit("x"), daily_name(), F.lit(".txt"))).otherwise(daily_name()))
    _, errors = load_all(d, named, "file")
    return d.spark.read.parquet(errors).drop("batch_id")


@query("R03_late_correction", """
    SELECT depot, date, passengers_per_day, CASE WHEN day(date) > 20 THEN actual_kms * 2 ELSE actual_kms END AS actual_kms, occupancy_ratio
    FROM event_days""", "actual_kms occupancy_ratio")
def r03(d: Domain):
    first = event_days(d).withColumn("file", daily_name("r1_"))
    again = event_days(d).filter(F.dayofmonth("date") > 20).withColumn("actual_kms", F.col("actual_kms") * 2).withColumn("file", daily_name("r2_"))
    drop, base = work_dir(d.spark, "drop"), work_dir(d.spark, "ingest")
    drop_files(first.unionByName(again), drop)

    def handle(batch, epoch):
        st.correct(batch, f"{base}/master", ["depot", "date"])

    st.ingest(st.file_stream(d.spark, drop, _FILE_SCHEMA), handle, f"{base}/checkpoint").awaitTermination()
    return snapshots.read(d.spark, f"{base}/master", snapshots.schema(d.spark, f"{base}/master")).select(*_COLS)


def _events(d: Domain):
    schema = d.raw("events").schema
    return st.event_stream(d.spark, d.folder, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
        "amount", F.round(F.col("value") * 100).cast("bigint"))


@query("R04_daily_stream", """
    SELECT event_type, ts::DATE AS day, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS total,
           (ts::DATE + INTERVAL 1 DAY) <= (SELECT max(ts) - INTERVAL 2 DAY FROM events) AS closed FROM events GROUP BY 1, 2""")
def r04(d: Domain):
    out = work_dir(d.spark, "daily-stream")
    return st.run_to_table(st.daily_rollup(_events(d), ["event_type"], "amount"), f"{out}/table", f"{out}/checkpoint", ["event_type", "day"])


@query("R05_rolling_stream", """
    SELECT event_type, first_day, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS total,
           first_day + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events) AS closed
    FROM (SELECT *, unnest(generate_series(ts::DATE - INTERVAL 6 DAY, ts::DATE, INTERVAL 1 DAY))::DATE AS first_day FROM events) GROUP BY 1, 2""")
def r05(d: Domain):
    out = work_dir(d.spark, "rolling-stream")
    return st.run_to_table(st.rolling_rollup(_events(d), ["event_type"], "amount"), f"{out}/table", f"{out}/checkpoint", ["event_type", "first_day"])


@query("R06_close_stream", """
    SELECT depot, date AS prediction_date, 'completed' AS status, passengers_per_day * 2.0::DOUBLE AS predicted_passenger_kms,
           occupancy_ratio * actual_kms * 45 AS actual_passenger_kms FROM event_days WHERE day(date) <= 20
    UNION ALL SELECT depot, date, 'pending', passengers_per_day * 2.0::DOUBLE, NULL FROM event_days WHERE day(date) > 20""",
       "predicted_passenger_kms actual_passenger_kms")
def r06(d: Domain):
    base = work_dir(d.spark, "closing")
    days = event_days(d)
    predictions = days.select(
        "depot", F.col("date").alias("prediction_date"), (F.col("passengers_per_day") * 2.0).alias("predicted_passenger_kms"),
        F.lit("pending").alias("status"), (F.col("passengers_per_day") / 20.0).alias("estimated_kms"),
        *[F.lit(None).cast(t).alias(c) for c, t in st.lg.ACTUALS.items()], F.trunc("date", "MM").alias("month"))
    snapshots.commit(predictions, f"{base}/ledger")
    drop_files(days.filter(F.dayofmonth("date") <= 20).withColumn("file", daily_name()), f"{base}/drop")
    stream = st.file_stream(d.spark, f"{base}/drop", _FILE_SCHEMA).withColumn(
        "passenger_kms", F.col("occupancy_ratio") * F.col("actual_kms") * 45)
    st.ingest(stream, st.close_handler(f"{base}/ledger"), f"{base}/checkpoint").awaitTermination()
    return snapshots.read(d.spark, f"{base}/ledger", snapshots.schema(d.spark, f"{base}/ledger")).select(
        "depot", "prediction_date", "status", "predicted_passenger_kms", "actual_passenger_kms")


@query("R01_nightly_job", """
    SELECT e.depot, e.date, CASE WHEN isodow(e.date) <> 7 THEN occupancy_ratio * actual_kms * coalesce(avg_seats_per_bus, 45) END AS passenger_kms,
           CASE WHEN isodow(e.date) = 7 THEN NULL WHEN h.date IS NULL THEN 0 ELSE 1 END AS is_fes_hol,
           CASE WHEN isodow(e.date) = 7 THEN 'pending' ELSE 'completed' END AS status,
           CASE WHEN isodow(e.date) <> 7 AND passengers_per_day <> 0 AND occupancy_ratio * actual_kms <> 0
                THEN passengers_per_day * 2.0::DOUBLE - occupancy_ratio * actual_kms * coalesce(avg_seats_per_bus, 45) END AS pkm_error
    FROM event_days e LEFT JOIN depots d ON d.depot = e.depot LEFT JOIN holidays h ON h.date = e.date""", "passenger_kms pkm_error")
def r01c(d: Domain):
    """Drop, gate, master, gold and ledger in one job; Sunday's files have bad names, so their predictions stay open."""
    drop, base = work_dir(d.spark, "drop"), work_dir(d.spark, "nightly")
    days = event_days(d)
    predictions = days.select(
        "depot", F.col("date").alias("prediction_date"), (F.col("passengers_per_day") * 2.0).alias("predicted_passenger_kms"),
        F.lit("pending").alias("status"), (F.col("passengers_per_day") / 20.0).alias("estimated_kms"),
        *[F.lit(None).cast(t).alias(c) for c, t in st.lg.ACTUALS.items()], F.trunc("date", "MM").alias("month"))
    snapshots.commit(predictions, f"{base}/ledger")
    name = F.when(F.weekday("date") == 6, F.concat(F.lit("x"), daily_name(), F.lit(".txt"))).otherwise(daily_name())
    drop_files(days.withColumn("file", name), drop)
    jobs.load_arrivals(d.spark, drop, base, d.depots, d.lunar, d.holidays, "2024-02-01", _FILE_SCHEMA)
    ledger = snapshots.read(d.spark, f"{base}/ledger", snapshots.schema(d.spark, f"{base}/ledger"))
    gold = snapshots.read(d.spark, f"{base}/gold", snapshots.schema(d.spark, f"{base}/gold")).select("depot", F.col("date").alias("prediction_date"), "passenger_kms", "is_fes_hol")
    return ledger.join(gold, ["depot", "prediction_date"], "left").select(
        "depot", F.col("prediction_date").alias("date"), "passenger_kms", "is_fes_hol", "status", "pkm_error")
