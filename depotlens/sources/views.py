"""Domain tables derived from the provided star schema.

Every method is lazy and reads the whole underlying table; only the columns a
query needs reach the scan.  ``views_sql.py`` states the same mapping as SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.session import materialise

EPOCH = "1995-01-01"

# Sheet columns filled from event counts, in sheet order.
MU_REASONS = ["Spondilitis", "Spinal_Disc", "Vision_Color_Blindness", "Neuro_Paralysis_Medical", "Ortho"]
SL_REASONS = [
    "Flu_Fever", "BP", "Orthopedic", "Heart", "Weakness", "Eye", "Accident_Injuries",
    "Neuro_Paralysis_Sick_Leave", "Piles", "Diabetes", "Thyroid", "Gas", "Dental", "Ear",
    "Skin_Allergy", "General_Surgery", "Obesity", "Cancer",
]


def cents(column: str) -> Column:
    """Exact integer sum of a two-decimal amount, so totals do not depend on row order."""
    return F.sum(F.floor(F.col(column) * 100 + 0.5))


class Domain:
    """Lazily built domain tables for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._written: dict[str, DataFrame] = {}

    def written(self, name: str) -> DataFrame:
        """A domain table written once for this job: what reads it several times doesn't go back to the facts."""
        if name not in self._written:
            if name == "services":
                self.written("service_daily")  # the master's pairs come from there
                self.__dict__.pop("services", None)
            if name == "gold":
                self.written("days")  # both calendars come from there
                for built in ("lunar", "holidays", "gold"):
                    self.__dict__.pop(built, None)
            if name in ("gold", "service_daily", "counted_steering"):
                self.written("drivers")  # of a written table Spark knows whether it is small enough to be sent to the facts
                for built in ("operations", "daily", "service_daily", "services", "steering", "gold"):
                    self.__dict__.pop(built, None)
            self._written[name] = materialise(getattr(self, name), name)
        return self._written[name]

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # ---- dimensions -------------------------------------------------------
    @cached_property
    def depots(self) -> DataFrame:
        key = F.col("n_nationkey")
        return (
            self.raw("nation")
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                key.alias("depot_id"),
                F.col("n_name").alias("depot"),
                F.col("r_name").alias("region"),
                F.when(F.col("n_regionkey") <= 1, "South").otherwise("North").alias("zone"),
                F.when(key % 2 == 0, "Rural").otherwise("Urban").alias("category"),
                (F.lit(40.0) + key % 10).alias("avg_seats_per_bus"),
                F.when(key % 4 == 0, "80%").when(key % 4 == 1, "0.75").when(key % 4 == 2, "n/a")
                .alias("target_or"),
            )
        )

    @cached_property
    def driver_count(self) -> DataFrame:
        return self.raw("supplier").agg(F.count("*").alias("n"))

    @cached_property
    def drivers(self) -> DataFrame:
        """employee_id -> home depot."""
        return (
            self.raw("supplier")
            .join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(F.col("s_suppkey").alias("employee_id"), F.col("n_name").alias("depot"))
        )

    # ---- facts ------------------------------------------------------------
    @cached_property
    def operations(self) -> DataFrame:
        return self._operations(self.raw("lineitem"))

    def operations_between(self, first: str, after: str) -> DataFrame:
        """Operations of a half-open date range; the range is stated on the stored column so that the scan prunes by it."""
        day = F.col("l_shipdate")
        low, high = (F.lit(x).cast("timestamp_ntz") for x in (first, after))
        return self._operations(self.raw("lineitem").filter((day >= low) & (day < high)))

    def _operations(self, lineitem: DataFrame) -> DataFrame:
        return (
            lineitem
            .join(self._written.get("drivers", self.drivers), F.col("l_suppkey") == F.col("employee_id"))
            .select(
                "depot",
                F.col("l_shipdate").cast("date").alias("operations_date"),
                "employee_id",
                F.col("l_partkey").cast("string").alias("service_number"),
                F.col("l_quantity").alias("opd_kms"),
                F.floor("l_extendedprice").cast("double").alias("daily_earnings"),
                F.when(F.col("l_linestatus") == "O", "D").otherwise("N").alias("day_night"),
                F.col("l_returnflag").alias("service_type"),
                F.col("l_linenumber").alias("schedules_count"),
                F.col("l_discount").alias("load_share"),
                F.col("l_orderkey").alias("trip_id"),
            )
        )

    @cached_property
    def services(self) -> DataFrame:
        part = F.col("p_partkey")
        seats = self.depots.select("depot", "avg_seats_per_bus")
        pairs = self._written.get("service_daily", self.operations).select("depot", "service_number").distinct()
        master = self.raw("part").select(
            part.cast("string").alias("service_number"),
            F.col("p_brand").alias("route"),
            F.col("p_type").alias("product"),
            (F.col("p_size") % 6).cast("int").alias("planned_trips"),
            (F.lit(5.0) + part % 40).alias("km_per_trip"),
            (((part * 37) % 1440) * 60).cast("int").alias("dep_sec"),
            (((part * 101) % 1440) * 60).cast("int").alias("arr_sec"),
            F.when(part % 4 == 0, "N").otherwise("D").alias("day_night_code"),
            (part % 2).cast("int").alias("can_be_cancelled"),
            F.when(part % 7 != 0, F.lit(15.0) + F.col("p_size") * 0.5).alias("breakeven_cpk"),
        )
        return (
            pairs.join(master, "service_number").join(seats, "depot")
            .withColumn("planned_kms", F.col("planned_trips") * F.col("km_per_trip"))
        )

    def _steering(self, pairs: DataFrame) -> DataFrame:
        part = F.col("p_partkey")
        master = self.raw("part").select(
            part.cast("string").alias("service_number"),
            (F.lit(4.0) + part % 9).alias("steering_hours"),
            F.when(F.col("p_size") > 3, (F.col("p_size") % 4)).cast("int").alias("no_of_drvs"),
        )
        return pairs.join(master, "service_number")

    @cached_property
    def steering(self) -> DataFrame:
        return self._steering(self.operations.select("depot", "service_number").distinct())

    @cached_property
    def counted_steering(self) -> DataFrame:
        """Steering hours with the number of duties of each depot's service."""
        return self._steering(self.operations.groupBy("depot", "service_number").agg(F.count("*").alias("duties")))

    @cached_property
    def absences(self) -> DataFrame:
        orders = self.raw("orders").select(
            F.pmod(F.col("o_custkey"), self.driver_count.scalar()).alias("employee_id"),
            F.col("o_orderdate").cast("date").alias("date"),
            F.substring("o_orderpriority", 1, 1).alias("p"),
        )
        leave = (
            F.when(F.col("p").isin("1", "5"), "L").when(F.col("p") == "2", "S").when(F.col("p") == "3", "A")
        )
        return orders.join(self.drivers, "employee_id").select(
            "employee_id", "depot", leave.alias("leave_type"), "date"
        )

    @cached_property
    def health(self) -> DataFrame:
        grade = (
            F.when(F.col("c_mktsegment") == "AUTOMOBILE", "A").when(F.col("c_mktsegment") == "BUILDING", "B")
            .when(F.col("c_mktsegment") == "FURNITURE", "C").when(F.col("c_mktsegment") == "HOUSEHOLD", "D")
            .otherwise("E")
        )
        first = (
            self.raw("customer")
            .select(F.pmod(F.col("c_custkey"), self.driver_count.scalar()).alias("employee_id"),
                    "c_custkey", grade.alias("grade"), "c_acctbal")
            .groupBy("employee_id")
            .agg(F.min(F.struct("c_custkey", "grade", "c_acctbal")).alias("row"))
            .select("employee_id", F.col("row.grade").alias("final_grading"),
                    F.col("row.c_acctbal").alias("risk_score"))
        )
        return first.join(self.drivers, "employee_id")

    @cached_property
    def daily(self) -> DataFrame:
        """Inbound depot-day facts, unique on (depot, date)."""
        return (
            self.operations.groupBy("depot", F.col("operations_date").alias("date"))
            .agg(
                (F.count("*") * 45).alias("passengers_per_day"),
                F.sum("opd_kms").alias("actual_kms"),
                (cents("load_share") / (F.count("*") * 10.0)).alias("occupancy_ratio"),
                F.sum("daily_earnings").alias("revenue"),
            )
        )

    @cached_property
    def service_daily(self) -> DataFrame:
        """Inbound service-day facts, unique on (depot, date, service_number)."""
        seats = self.depots.select("depot", "avg_seats_per_bus")
        return (
            self.operations.groupBy("depot", F.col("operations_date").alias("date"), "service_number")
            .agg(
                F.sum("opd_kms").alias("actual_kms"),
                F.count("*").alias("actual_trips"),
                (cents("load_share") / (F.count("*") * 10.0)).alias("occupancy_ratio"),
                F.sum("daily_earnings").alias("revenue"),
            )
            .join(F.broadcast(seats), "depot")
            .withColumn("seat_kms", F.col("actual_kms") * F.col("avg_seats_per_bus"))
            .withColumn("passenger_kms", F.col("occupancy_ratio") * F.col("actual_kms") * F.col("avg_seats_per_bus"))
            .drop("avg_seats_per_bus")
        )

    # ---- calendars and weather ---------------------------------------------
    @cached_property
    def days(self) -> DataFrame:
        bounds = self.raw("lineitem").agg(
            F.min("l_shipdate").cast("date").alias("lo"), F.max("l_shipdate").cast("date").alias("hi")
        )
        return bounds.select(F.explode(F.sequence("lo", F.date_add("hi", 14))).alias("date")).withColumn(
            "n", F.datediff("date", F.lit(EPOCH).cast("date"))
        )

    @cached_property
    def holidays(self) -> DataFrame:
        code = (F.lit(1) + F.floor(F.col("n") / 29) % 7).cast("int")
        return self._written.get("days", self.days).filter((F.col("n") % 29).isin(0, 1, 2)).select(
            "date",
            code.alias("fes_hol_code"),
            F.concat(F.lit("FEST_"), code).alias("holiday_festival"),
            F.element_at(F.array(F.lit("MAJOR"), F.lit("MINOR"), F.lit("STATE")), (code % 3 + 1).cast("int"))
            .alias("fes_hol_category"),
        )

    @cached_property
    def lunar(self) -> DataFrame:
        n = F.col("n")
        return self._written.get("days", self.days).select(
            "date",
            F.concat(F.lit("T"), (n % 15).cast("string")).alias("telugu_thithi"),
            F.when(n % 30 < 15, "SHUKLA").otherwise("KRISHNA").alias("telugu_paksham"),
            F.concat(F.lit("M"), (F.floor(n / 30) % 12).cast("string")).alias("telugu_month"),
            F.when(n % 11 == 0, 1.0).otherwise(0.0).alias("marriage_day"),
            F.when(n % 90 < 5, 1.0).otherwise(0.0).alias("moudyami_day"),
        )

    @cached_property
    def lunar_raw(self) -> DataFrame:
        """Text-dated lunar rows with duplicates per date, as they arrive in a file."""
        d = F.col("o_orderdate").cast("date")
        text = (
            F.when(F.col("o_orderstatus") == "O", F.date_format(d, "dd-MM-yyyy"))
            .when(F.col("o_orderstatus") == "F", F.date_format(d, "dd/MM/yyyy"))
            .otherwise(F.date_format(d, "yyyy-MM-dd"))
        )
        return self.raw("orders").select(
            text.alias("date"),
            F.concat(F.lit("T"), (F.col("o_orderkey") % 15).cast("string")).alias("telugu_thithi"),
            F.col("o_orderstatus").alias("telugu_paksham"),
        )

    @cached_property
    def holiday_wide(self) -> DataFrame:
        """One row per festival code, one text cell of dates per year, for the years that occur."""
        listed = (
            self.holidays.withColumn("y", F.date_format("date", "yyyy"))
            .withColumn("txt", F.date_format("date", "dd-MM-yyyy"))
            .groupBy("fes_hol_code", "holiday_festival", "fes_hol_category")
            .pivot("y")
            .agg(F.concat_ws("; ", F.sort_array(F.collect_list("txt"))))
        )
        return listed.withColumnsRenamed({y: f"{y}_dates" for y in listed.columns[3:]})

    @cached_property
    def weather(self) -> DataFrame:
        """Sparse depot-day weather derived from order totals."""
        return (
            self.raw("orders")
            .join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy(F.col("n_name").alias("depot"), F.col("o_orderdate").cast("date").alias("date"))
            .agg(
                (F.floor(F.max("o_totalprice")) / 20000.0 + 15).alias("max_temp"),
                (F.floor(F.min("o_totalprice")) / 20000.0).alias("min_temp"),
                F.when(F.max("o_orderstatus") != "F", F.count_if(F.col("o_orderstatus") == "O") * 7.0)
                .alias("daily_rainfall"),
            )
        )

    # ---- gold, ledger, sheet ----------------------------------------------
    @cached_property
    def gold(self) -> DataFrame:
        from depotlens.operators.joins import build_gold

        return build_gold(self.daily, self.lunar, self.holidays, self.depots)

    @cached_property
    def ledger(self) -> DataFrame:
        """Prediction ledger, unique on (depot, prediction_date)."""
        predicted = cents("o_totalprice") / 10000.0
        return (
            self.raw("orders")
            .join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy(F.col("n_name").alias("depot"), F.col("o_orderdate").cast("date").alias("prediction_date"))
            .agg(
                predicted.alias("predicted_passenger_kms"),
                F.when(F.count_if(F.col("o_orderstatus") == "F") > 0, "completed").otherwise("pending")
                .alias("status"),
            )
            .withColumn("assumed_or", F.lit(0.85))
            .withColumn("bus_capacity", F.lit(45))
            .withColumn("estimated_kms", F.col("predicted_passenger_kms") / (F.col("assumed_or") * F.col("bus_capacity")))
        )

    @cached_property
    def sheet(self) -> DataFrame:
        """Workforce sheet, unique on (depot, data_date): the raw measures."""
        v = F.col("value")

        def kind(name: str) -> Column:
            return F.count_if(F.col("event_type") == name)

        n = F.count("*")
        sick = (v >= 10) & (v < 30)
        aggs = {
            "Schedules": 100 + kind("view"),
            "Schedules_Services": 200 + kind("click"),
            "Schedules_Kms": 20000 + 100 * n,
            "Planned_Schedules": F.when(kind("signup") == 0, F.lit(0)).otherwise(90 + kind("view")),
            "Planned_Services": 180 + kind("click"),
            "Planned_KM": 18000 + 90 * n,
            "Actual_Services": 170 + kind("purchase") + kind("click"),
            "Actual_KM": 17000 + 95 * n,
            "Total_Drivers": 400 + n,
            "Medically_Unfit": kind("error"),
            "Suspended_Drivers": F.count_if(v > 200),
            "Weekly_Off_National_Off": 20 + kind("view"),
            "Special_Off_Night_Out_IC_Online": 10 + kind("click"),
            "Training_PME_medical": kind("purchase"),
            "Others": kind("signup"),
            "Leave_Absent": 5 + F.count_if(v < 10),
            "Sick_Leave": F.count_if(sick),
            "Spot_Absent": F.count_if(v > 100),
            "Drivers_Required": 300 + 2 * kind("view"),
            "Double_Duty": 20 + kind("purchase"),
            "Off_Cancellation": 3 + kind("signup"),
            "Drivers_as_Conductors": kind("error") % 7,
        }
        for i, name in enumerate(MU_REASONS):
            aggs[name] = F.count_if((F.col("event_type") == "error") & (F.floor(v) % 6 == i))
        for i, name in enumerate(SL_REASONS):
            aggs[name] = F.count_if(sick & (F.col("user_id") % 19 == i))
        nation = self.raw("nation").select("n_nationkey", F.col("n_name").alias("depot"))
        return (
            self.raw("events")
            .withColumn("k", (F.col("user_id") % 25).cast("int"))
            .groupBy("k", F.col("ts").cast("date").alias("data_date"))
            .agg(*[c.cast("bigint").alias(a) for a, c in aggs.items()])
            .join(nation, F.col("k") == F.col("n_nationkey"))
            .select("depot", "data_date", *aggs)
        )

    # ---- untyped arrivals ---------------------------------------------------
    @cached_property
    def bronze(self) -> DataFrame:
        """All-text daily operations with the noise real drops carry."""
        line = F.col("l_linenumber")
        date = F.col("l_shipdate").cast("date")
        return (
            self.raw("lineitem")
            .join(self.drivers, F.col("l_suppkey") == F.col("employee_id"))
            .select(
                F.col("l_orderkey").cast("string").alias("Sl.No"),
                F.concat(F.lit(" "), F.lower("depot"), F.when(line == 1, " ").otherwise("")).alias("Depot "),
                F.when(line == 1, F.date_format(date, "dd/MM/yyyy"))
                .when(line == 2, F.date_format(date, "yyyy-MM-dd"))
                .when(line == 3, F.lit("31-02-2024"))
                .otherwise(F.date_format(date, "dd-MM-yyyy")).alias("Date"),
                F.when(line == 4, "").otherwise(F.col("l_suppkey").cast("string")).alias("Drv No."),
                F.col("l_partkey").cast("string").alias("Ser.No"),
                F.when(line == 5, "--").when(line == 6, "N/A")
                .otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(",000"))).alias("Opt'd KMs."),
                F.when(line == 7, "none").otherwise(F.lower("l_returnflag")).alias("Type"),
                F.when(line == 2, "NAN").otherwise(F.concat(F.lit(" "), F.col("l_linestatus"))).alias("D.No"),
                F.lit("x").alias("Remarks"),
            )
        )
