"""Joins and lookups.

No broadcast hints: dimension sides are left to Spark, which broadcasts them only
while their measured size is under ``spark.sql.autoBroadcastJoinThreshold`` and
falls back to a shuffled join (with adaptive skew splitting) beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotlens.functions.timeparts import duty_hours, plain_hours, steering_share

DEFAULT_SEATS = 45


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the smallest by ``order``.

    A minimum over a struct combines before the shuffle, so a key that holds most
    rows still sends one row per task, unlike a row_number window.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.min(F.struct(*order, *rest)).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, "_row.*").select(*df.columns)


def with_depot(fact: DataFrame, depots: DataFrame) -> DataFrame:
    """Adds region, zone and category; facts of unknown depots drop out."""
    return fact.join(depots.select("depot", "region", "zone", "category"), "depot")


def service_times(services: DataFrame, keys: list[str]) -> DataFrame:
    """Unique (keys) -> duty times."""
    cols = [*keys, "dep_sec", "arr_sec", "day_night_code"]
    return first_per_key(services.select(*cols), keys, ["dep_sec", "arr_sec"])


def with_service(fact: DataFrame, services: DataFrame, keys=("depot", "service_number")) -> DataFrame:
    return fact.join(service_times(services, list(keys)), list(keys), "left")


def with_hours(fact: DataFrame, services: DataFrame, mode: str = "overnight", keys=("depot", "service_number")) -> DataFrame:
    """Adds duty ``hours``; ``mode='abs'`` is the plain clock difference."""
    dep, arr = F.col("dep_sec"), F.col("arr_sec")
    hours = plain_hours(dep, arr) if mode == "abs" else duty_hours(dep, arr, F.col("day_night_code"))
    return with_service(fact, services, keys).withColumn("hours", hours).drop("dep_sec", "arr_sec", "day_night_code")


def with_calendars(fact: DataFrame, lunar: DataFrame, holidays: DataFrame) -> DataFrame:
    return (
        fact.join(lunar, "date", "left")
        .join(holidays, "date", "left")
        .withColumn("is_fes_hol", F.col("fes_hol_code").isNotNull().cast("int"))
        .withColumns({
            "fes_hol_code": F.coalesce("fes_hol_code", F.lit(0)),
            "holiday_festival": F.coalesce("holiday_festival", F.lit("NONE")),
            "fes_hol_category": F.coalesce("fes_hol_category", F.lit("NONE")),
        })
    )


def with_passenger_kms(fact: DataFrame, depots: DataFrame) -> DataFrame:
    seats = F.coalesce("avg_seats_per_bus", F.lit(float(DEFAULT_SEATS)))
    return (
        fact.join(depots.select("depot", "avg_seats_per_bus"), "depot", "left")
        .withColumn("passenger_kms", F.col("occupancy_ratio") * F.col("actual_kms") * seats)
        .drop("avg_seats_per_bus")
    )


def build_gold(daily: DataFrame, lunar: DataFrame, holidays: DataFrame, depots: DataFrame) -> DataFrame:
    """Curated depot-day table, unique on (depot, date)."""
    return with_passenger_kms(with_calendars(daily, lunar, holidays), depots)


def build_service_gold(service_daily: DataFrame, lunar: DataFrame, holidays: DataFrame) -> DataFrame:
    """Curated service-day table, unique on (depot, date, service_number)."""
    return with_calendars(service_daily, lunar, holidays)


def with_steering(ops: DataFrame, steering: DataFrame) -> DataFrame:
    """Adds hours per driver and whether they are actual or filled with the median.

    The fallback is the median over operations rows.  It is computed from one row
    per (depot, service) weighted by its number of duties, so the facts are only
    counted, never sorted; a column ``duties`` of ``steering`` has that number already.
    """
    hours = steering_share(F.col("steering_hours"), F.col("no_of_drvs")).alias("steering_hours")
    shares = steering.select("depot", "service_number", hours)
    if "duties" in steering.columns:
        counted = steering.filter("depot IS NOT NULL AND service_number IS NOT NULL").select(hours, F.col("duties").alias("count"))
    else:
        counted = ops.groupBy("depot", "service_number").count().join(shares, ["depot", "service_number"])
    weights = counted.groupBy("steering_hours").agg(F.sum("count").alias("w"))
    median = weights.agg(F.percentile("steering_hours", 0.5, F.col("w"))).scalar()
    return ops.join(shares, ["depot", "service_number"], "left").withColumns({
        "hours_source": F.when(F.col("steering_hours").isNull(), "Estimated (Median)").otherwise("Actual"),
        "steering_hours": F.coalesce("steering_hours", median),
    })


def with_health(ops: DataFrame, health: DataFrame) -> DataFrame:
    return ops.join(health, ["employee_id", "depot"])


def hours_by_employee(ops: DataFrame, services: DataFrame, mode: str = "abs") -> DataFrame:
    """Total hours per employee; duties are counted per service before the join.

    The service is looked up by number alone, so each number is used once.
    """
    duties = ops.groupBy("employee_id", "service_number").agg(F.count("*").alias("n"))
    timed = with_hours(duties, services, mode, keys=("service_number",))
    return timed.groupBy("employee_id").agg(F.coalesce(F.sum(F.col("hours") * F.col("n")), F.lit(0.0)).alias("hours"))


def hours_by_grade(hours: DataFrame, health: DataFrame) -> DataFrame:
    """Keeps every employee that worked, graded or not."""
    return hours.join(health.select("employee_id", "final_grading"), "employee_id", "left")


def leaves_by_grade(absences: DataFrame, health: DataFrame, how: str = "full") -> DataFrame:
    counts = absences.filter("leave_type IS NOT NULL").groupBy("employee_id").agg(F.count("*").alias("leaves"))
    return counts.join(health.select("employee_id", "final_grading"), "employee_id", how)


def not_in(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def exists_flag(left: DataFrame, right: DataFrame, keys: list[str], name: str = "found") -> DataFrame:
    marked = right.select(*keys).distinct().withColumn(name, F.lit(1))
    return left.join(marked, keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def next_unseen_date(plan: DataFrame, seen: DataFrame) -> DataFrame:
    """First planned date per depot that has no stored row yet."""
    return not_in(plan, seen, ["depot", "date"]).groupBy("depot").agg(F.min("date").alias("date"))


def latest_by_depot(depots: DataFrame, fact: DataFrame, date: str) -> DataFrame:
    latest = fact.groupBy("depot").agg(F.max(date).alias("latest"))
    return depots.select("depot", "region").join(latest, "depot", "left")


def dense_months(df: DataFrame, keys: list[str], start: str, end: str, values: list[str], month: str = "month") -> DataFrame:
    """One row per key and month of the range; missing values become 0."""
    spine = df.select(*keys).distinct().withColumn(
        month,
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("INTERVAL 1 MONTH"))),
    )
    return spine.join(df, [*keys, month], "left").na.fill(0, values)


def with_weather(df: DataFrame, weather: DataFrame) -> DataFrame:
    return df.join(weather, ["depot", "date"], "left")


def asof_weather(df: DataFrame, weather: DataFrame) -> DataFrame:
    """Latest weather on or before each depot-day.

    Both inputs are unique on (depot, date), so a window partition holds at most
    two rows per calendar day.
    """
    values = ["max_temp", "min_temp", "daily_rainfall"]
    wanted = df.select("depot", "date").withColumn("_want", F.lit(1))
    known = weather.select("depot", "date", F.struct("date", *values).alias("_seen"))
    upto = Window.partitionBy("depot").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return (
        wanted.join(known, ["depot", "date"], "full")
        .withColumn("_seen", F.last("_seen", ignorenulls=True).over(upto))
        .filter("_want = 1")
        .select("depot", "date", F.col("_seen.date").alias("weather_date"), *[F.col(f"_seen.{v}").alias(v) for v in values])
    )


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, default: str = "Unknown") -> DataFrame:
    return df.join(dim.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def with_global(df: DataFrame, stats: dict[str, Column]) -> DataFrame:
    """Attach one-row statistics, computed in one aggregate, as a scalar sub-query: no join
    and no single-task window."""
    row = df.agg(F.struct(*[stat.alias(name) for name, stat in stats.items()])).scalar()
    return df.withColumn("_g", row).select(*df.columns, *[F.col(f"_g.{name}").alias(name) for name in stats])


def actual_vs_predicted(actual: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    return actual.join(predicted, keys).withColumn("variance", F.col("actual") - F.col("predicted"))


def employee_sums(ops: DataFrame, steering: DataFrame) -> DataFrame:
    """Kilometres and steering hours per employee in one grouping."""
    duties = ops.groupBy("employee_id", "depot", "service_number").agg(
        F.sum("opd_kms").alias("kms"), F.count("*").alias("n")
    )
    shares = steering.select(
        "depot", "service_number", steering_share(F.col("steering_hours"), F.col("no_of_drvs")).alias("h")
    )
    return duties.join(shares, ["depot", "service_number"], "left").groupBy("employee_id").agg(
        F.sum("kms").alias("kms"), F.coalesce(F.sum(F.col("h") * F.col("n")), F.lit(0.0)).alias("hours")
    )


# ---- name matching ---------------------------------------------------------
def _tokens(col: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.upper(col), "[^A-Z0-9]+"), lambda t: t != ""))


def _substrings(df: DataFrame, col: str, longest: Column, name: str) -> DataFrame:
    """One row per distinct substring of ``col`` of at most ``longest`` characters."""
    at = df.withColumn("_s", F.explode(F.sequence(F.lit(1), F.length(col))))
    sized = at.withColumn("_n", F.explode(F.sequence(F.lit(1), F.least(longest, F.length(col) - F.col("_s") + 1))))
    return sized.withColumn(name, F.col(col).substr(F.col("_s"), F.col("_n"))).drop("_s", "_n").distinct()


def token_set_score(a: Column, b: Column) -> Column:
    """0..100: the best likeness among the shared tokens, and these with the rest of either side, each in sorted order.

    Likeness is 100 less the edits per letter of the longer text.  All tokens of one side in the other give 100.
    """
    x, y = F.array_sort(_tokens(a)), F.array_sort(_tokens(b))
    both = F.array_join(F.array_intersect(x, y), " ")
    left = F.trim(F.concat(both, F.lit(" "), F.array_join(F.array_except(x, y), " ")))
    right = F.trim(F.concat(both, F.lit(" "), F.array_join(F.array_except(y, x), " ")))

    def alike(p: Column, q: Column) -> Column:
        return F.lit(100.0) - F.levenshtein(p, q) * 100.0 / F.greatest(F.length(p), F.length(q), F.lit(1))

    return F.when(both == "", alike(left, right)).otherwise(F.greatest(alike(both, left), alike(both, right), alike(left, right)))


def fuzzy_depot(names: DataFrame, depots: DataFrame, threshold: int = 70) -> DataFrame:
    """Match free-text ``name`` to a depot: equal, then containment, then alike by their sets of tokens.

    Names are de-duplicated first and every class is an equi-join: containment
    joins the substrings of one side to the other, and names that may be alike meet
    through shared letter pairs, so no all-pairs comparison is made.
    """
    names = names.select("name").distinct().filter("name IS NOT NULL").withColumn("key", F.upper(F.trim("name")))
    names = names.filter("key <> ''")
    dim = depots.select("depot").distinct().withColumn("key", F.upper(F.trim("depot")))
    longest = dim.agg(F.max(F.length("key"))).scalar()
    keys = names.select("key").distinct()

    equal = keys.join(dim, "key").select("key", F.lit(0).alias("cls"), F.lit(100.0).alias("score"), "depot")
    inside = (
        _substrings(keys, "key", longest, "piece")
        .join(dim.select(F.col("key").alias("piece"), "depot"), "piece")
        .select("key", F.lit(1).alias("cls"), F.lit(100.0).alias("score"), "depot")
    )
    around = (
        _substrings(dim.withColumnRenamed("key", "dkey"), "dkey", longest, "key")
        .join(keys, "key")
        .select("key", F.lit(1).alias("cls"), F.lit(100.0).alias("score"), "depot")
    )

    def grams(df: DataFrame, col: str) -> DataFrame:
        """Padded letter pairs: names alike enough for the threshold share one."""
        padded = F.concat(F.lit(" "), F.array_join(_tokens(F.col(col)), " "), F.lit(" "))
        return df.withColumn("g", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: padded.substr(i, F.lit(2))))))

    pairs = grams(keys.filter(F.size(_tokens(F.col("key"))) > 0), "key").join(grams(dim.select("depot", F.col("key").alias("dkey")), "dkey"), "g")
    alike = (
        pairs.select("key", "depot", "dkey").distinct()
        .withColumn("score", token_set_score(F.col("key"), F.col("dkey"))).filter(F.col("score") >= threshold)
        .select("key", F.lit(2).alias("cls"), "score", "depot")
    )
    best = (
        equal.unionByName(inside).unionByName(around).unionByName(alike)
        .groupBy("key")
        .agg(F.min(F.struct("cls", (-F.col("score")).alias("neg"), "depot")).alias("b"))
    )
    return names.join(best, "key", "left").select("name", F.col("b.depot").alias("depot"), (-F.col("b.neg")).alias("score"))
