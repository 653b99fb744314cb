"""Prediction ledger, accuracy and variance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.functions.numbers import half_even
from depotlens.operators.quantiles import exact_quantiles
from depotlens.session import materialise

KM_PER_BUS = 250.0
KEYS = ["depot", "prediction_date"]
ACTUALS = {
    "actual_passenger_kms": "double", "actual_or": "double", "actual_kms": "double", "pkm_error": "double",
    "pkm_error_pct": "double", "km_error": "double", "km_error_pct": "double",
}


def with_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Back-fill columns an older table lacks with typed NULLs."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def ledger_actuals(gold: DataFrame) -> DataFrame:
    return gold.groupBy("depot", "date").agg(
        F.avg("occupancy_ratio").alias("occupancy_ratio"), F.sum("passenger_kms").alias("passenger_kms"), F.sum("actual_kms").alias("actual_kms")
    )


def errors(predicted: Column, actual: Column, strict: bool) -> tuple[Column, Column]:
    """Prediction less actual and its share of the actual, NULL where undefined.

    ``strict`` also leaves the error NULL when either side is zero.
    """
    gap = predicted - actual
    if strict:
        gap = F.when((predicted != 0) & (actual != 0), gap)
    return gap, F.when(actual > 0, F.try_divide(gap * 100.0, actual))


def close_pending(ledger: DataFrame, actuals: DataFrame) -> DataFrame:
    """Complete every pending prediction whose actuals have arrived: one join, no loop."""
    full = with_columns(ledger, ACTUALS)
    found = actuals.select(
        "depot", F.col("date").alias("prediction_date"), F.col("passenger_kms").alias("_pkm"),
        F.col("occupancy_ratio").alias("_or"), F.col("actual_kms").alias("_km"), F.lit(True).alias("_hit"))
    joined = full.join(found, KEYS, "left")
    now = (F.col("status") == "pending") & F.coalesce("_hit", F.lit(False))
    pkm_error, pkm_pct = errors(F.col("predicted_passenger_kms"), F.col("_pkm"), True)
    km_ready = (F.col("_km") > 0) & (F.col("estimated_kms") != 0)
    km_error = F.when(km_ready, F.col("estimated_kms") - F.col("_km"))
    km_pct = F.when(km_ready, F.try_divide((F.col("estimated_kms") - F.col("_km")) * 100.0, F.col("_km")))
    new = {
        "actual_passenger_kms": F.col("_pkm"), "actual_or": F.col("_or"), "actual_kms": F.col("_km"), "pkm_error": pkm_error,
        "pkm_error_pct": pkm_pct, "km_error": km_error, "km_error_pct": km_pct,
    }
    return joined.withColumns({
        **{c: F.when(now, v).otherwise(F.col(c)) for c, v in new.items()},
        "status": F.when(now, "completed").otherwise(F.col("status")),
    }).drop("_pkm", "_or", "_km", "_hit")


def accuracy_table(ledger: DataFrame, kind: str) -> DataFrame:
    """Predictions beside actuals; a depot without any passenger-km prediction falls back to its older passenger columns, where the ledger has them."""
    full = with_columns(ledger, ACTUALS)
    if kind == "demand":
        if "predicted_passengers" in full.columns:
            new = full.groupBy("depot").agg((F.count("predicted_passenger_kms") > 0).alias("_new"))
            older = {"predicted_passenger_kms": "predicted_passengers", "actual_passenger_kms": "actual_passengers",
                     "pkm_error": "passenger_error", "pkm_error_pct": "passenger_error_pct"}
            full = full.join(new, "depot")
            full = full.withColumns({c: F.when(F.col("_new"), F.col(c)).otherwise(F.col(o)) for c, o in older.items() if o in full.columns})
        return full.filter(F.col("status").isin("completed", "pending")).select(
            "depot", "prediction_date", F.col("predicted_passenger_kms").alias("predicted"), F.col("actual_passenger_kms").alias("actual"),
            F.col("pkm_error").alias("error"), F.col("pkm_error_pct").alias("error_pct"), "status")
    return full.filter("status = 'completed' AND actual_kms IS NOT NULL").select(
        "depot", "prediction_date", F.col("estimated_kms").alias("predicted"), F.col("actual_kms").alias("actual"),
        F.col("km_error").alias("error"), F.col("km_error_pct").alias("error_pct"), "status")


def accuracy_metrics(table: DataFrame, col: str = "error_pct") -> DataFrame:
    """n, mean, mean absolute, median absolute and share within 10 % / 20 %, rounded to one place."""
    rows = table.select(F.col(col).alias("e"), F.abs(col).alias("a")).filter("e IS NOT NULL")
    rows = materialise(rows, "errors")
    basic = rows.agg(
        F.count("*").alias("records"), half_even(F.avg("e"), 1).alias("mean_error"), half_even(F.avg("a"), 1).alias("mean_abs_error"),
        half_even(F.avg((F.col("a") <= 10).cast("double")) * 100, 1).alias("within_10"),
        half_even(F.avg((F.col("a") <= 20).cast("double")) * 100, 1).alias("within_20"),
    )
    median = exact_quantiles(rows, [], "a", [0.5], ["m"], stage=False)
    return basic.withColumn("median_abs_error", median.select(half_even(F.col("m"), 1)).scalar())


def prediction_rows(predictions: DataFrame, loads: DataFrame, assumed_or: float = 0.85, capacity: int = 45) -> DataFrame:
    """(depot, prediction_date, predicted_passenger_kms) -> pending ledger rows."""
    load = F.coalesce("rolling_or", F.lit(assumed_or))
    return (
        predictions.join(loads, "depot", "left").withColumn("assumed_or", load).drop("rolling_or")
        .withColumn("bus_capacity", F.lit(capacity))
        .withColumn("estimated_kms", F.col("predicted_passenger_kms") / (F.col("assumed_or") * capacity))
        .withColumn("estimated_buses", F.ceil(F.col("estimated_kms") / KM_PER_BUS))
        .withColumn("status", F.lit("pending"))
    )


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Keep what is stored; add only new keys."""
    fresh = incoming.join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def backfill(ledger: DataFrame, tested: DataFrame, loads: DataFrame) -> DataFrame:
    """Hold-out predictions as completed rows, unless that depot-day is completed already."""
    rows = prediction_rows(tested, loads)
    pkm_error, pkm_pct = errors(F.col("predicted_passenger_kms"), F.col("actual_passenger_kms"), False)
    km_error, km_pct = errors(F.col("estimated_kms"), F.when(F.col("actual_kms") > 0, F.col("actual_kms")), False)
    done = rows.withColumns({
        "pkm_error": pkm_error, "pkm_error_pct": pkm_pct, "km_error": km_error, "km_error_pct": km_pct, "status": F.lit("completed")})
    completed = ledger.filter("status = 'completed'").select(*KEYS)
    return done.join(completed, KEYS, "left_anti")


def metrics(df: DataFrame, actual: str, predicted: str, by: list[str]) -> DataFrame:
    """RMSE, MAE, MAPE (actual not zero), MAPE over actual + 1, and R2, from mergeable sums."""
    y, p = F.col(actual), F.col(predicted)
    # Variance is centred on the overall mean so that large values keep their precision.
    return df.groupBy(*by).agg(
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"), F.avg(F.abs(y - p)).alias("mae"),
        F.avg(F.when(y != 0, F.abs((y - p) / F.nullif(y, F.lit(0.0))))).alias("mape") * 100,
        F.avg(F.abs(y - p) / (F.abs(y) + 1)).alias("mape_plus1") * 100,
        F.try_subtract(F.lit(1.0), F.try_divide(F.avg((y - p) * (y - p)), F.nullif(F.var_pop(y), F.lit(0.0)))).alias("r2"),
    ).toDF(*by, "rmse", "mae", "mape", "mape_plus1", "r2")


def time_split(df: DataFrame, n_dates: int) -> DataFrame:
    """Marks the rows of the last ``n_dates`` distinct dates as test."""
    last = df.select("date").distinct().orderBy(F.desc("date")).limit(n_dates).agg(F.min("date")).scalar()
    return df.withColumn("is_test", (F.col("date") >= last).cast("int"))


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fill gaps with the median over the training rows of a depot-day table, exact for all columns in one pass of brackets."""
    from depotlens.operators.quantiles import exact_quantiles

    cells = df.filter("is_test = 0").select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "_column", "_value")
    middle = {r["_column"]: r["_m"] for r in exact_quantiles(cells, ["_column"], "_value", [0.5], ["_m"]).collect()}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(middle.get(c)).cast("double")) for c in columns})


def hash_split(df: DataFrame, key: list[str], share: float = 0.8) -> DataFrame:
    """Reproducible split by a digest of the key, which other engines can repeat; it does not depend on row order or partitioning."""
    place = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key])), 1, 8), 16, 10).cast("long") % 100
    return df.withColumn("is_test", (place >= int(share * 100)).cast("int"))


def blend(preds: DataFrame, store: DataFrame) -> DataFrame:
    """Today and tomorrow per depot; stored values win, tomorrow stays within 20 % of today."""
    both = preds.join(store, "depot", "left")
    today = F.coalesce("stored_today", F.col("today_raw") * 0.65 + F.col("recent_mean") * 0.35)
    mixed = F.col("tomorrow_raw") * 0.7 + F.col("today") * 0.3
    limited = F.least(F.greatest(mixed, F.col("today") * 0.8), F.col("today") * 1.2)
    return both.withColumn("today", today).withColumn("tomorrow", F.coalesce("stored_tomorrow", limited)).select("depot", "today", "tomorrow")


def stored_or_new(store: DataFrame, predictions: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Stored value wins; else the new one."""
    kept = store.select(*keys, F.col(value).alias("_stored"))
    return predictions.join(kept, keys, "full").withColumn(value, F.coalesce("_stored", value)).drop("_stored")


def open_next(plan: DataFrame, filled: DataFrame, stored: DataFrame) -> DataFrame:
    """Next plan row per depot after its last filled date that is not stored yet."""
    start = filled.groupBy("depot").agg(F.max("date").alias("_from"))
    open_rows = plan.join(stored.select("depot", "date"), ["depot", "date"], "left_anti").join(start, "depot")
    later = open_rows.filter(F.col("date") > F.col("_from")).drop("_from")
    rest = [c for c in later.columns if c not in ("depot", "date")]
    return later.groupBy("depot").agg(F.min(F.struct("date", *rest)).alias("r")).select("depot", "r.*")


# ---- schedule against actuals ------------------------------------------------------
def match_schedule(schedule: DataFrame, actuals: DataFrame, keys: list[str]) -> DataFrame:
    """Scheduled and actual services side by side with how they matched.

    Both sides are unique on the keys.
    """
    planned = schedule.withColumn("_s", F.lit(True))
    run = actuals.withColumn("_a", F.lit(True))
    both = planned.join(run, keys, "full")
    number = F.trim("service_number")
    category = (
        F.when(F.col("_a").isNull(), "Scheduled (No Actuals)").when(F.col("_s").isNotNull(), "Scheduled")
        .when(number.rlike(r"^[89]\d{3}$"), "Extra Service").otherwise("New Service")
    )
    delta = F.col("actual_pkm") - F.col("allocated_pkm")
    return both.withColumns({
        "category": category, "pkm_delta": delta,
        "pkm_delta_pct": F.try_divide(delta * 100.0, F.nullif("allocated_pkm", F.lit(0.0))),
    }).drop("_s", "_a")


def schedule_vs_actual(matched: DataFrame) -> DataFrame:
    """Per depot: services by match, allocated and actual passenger-km, revenue and their gaps."""
    label = F.col("category")
    zero = F.lit(0.0)
    out = matched.groupBy("depot").agg(
        F.count_if(label.startswith("Scheduled")).alias("scheduled"), F.count_if(label != "Scheduled (No Actuals)").alias("run"),
        F.count_if(label == "Extra Service").alias("extra"), F.count_if(label == "New Service").alias("new"),
        F.count_if(F.col("action") == "ADD_SLOT").alias("add_slot"), F.count_if(F.col("action") == "CUT").alias("cut"),
        F.coalesce(F.sum("allocated_pkm"), zero).alias("allocated"), F.coalesce(F.sum("actual_pkm"), zero).alias("actual"),
        F.coalesce(F.sum("revenue"), zero).alias("predicted_revenue"), F.coalesce(F.sum("actual_revenue"), zero).alias("earnings"),
    )
    pct = lambda d, b: F.coalesce(F.try_divide(d * 100.0, F.nullif(b, F.lit(0.0))), zero)
    pkm, money = F.col("actual") - F.col("allocated"), F.col("earnings") - F.col("predicted_revenue")
    return out.withColumns({
        "pkm_delta": pkm, "pkm_delta_pct": pct(pkm, F.col("allocated")),
        "revenue_delta": money, "revenue_delta_pct": pct(money, F.col("predicted_revenue")),
    })


def match_order(category: Column, action: Column) -> Column:
    """Category beats action: new, extra and unserved rows go last in that order."""
    return (
        F.when(category == "New Service", 3).when(category == "Extra Service", 4).when(category == "Scheduled (No Actuals)", 5)
        .when(action.isin("ADD_SLOT", "INCREASE"), 0).when(action == "NO_CHANGE", 1)
        .when(action.isin("CUT", "DECREASE", "STOP"), 2).otherwise(99)
    )


def absence_variance(actual: DataFrame, predicted: DataFrame, n: int = 15) -> DataFrame:
    """Total variance of the last ``n`` dates per depot, the first of them dropped."""
    from pyspark.sql import Window

    newest = Window.partitionBy("depot").orderBy(F.desc("date"))
    last = actual.withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= n)
    both = last.join(predicted, ["depot", "date"]).withColumns({
        "actual_total": F.col("leave") + F.col("sick") + F.col("spot"),
        "pred_total": F.col("pred_leave") + F.col("pred_sick") + F.col("pred_spot"),
    }).withColumn("total_variance", F.col("actual_total") - F.col("pred_total"))
    oldest = F.row_number().over(Window.partitionBy("depot").orderBy("date"))
    return both.withColumn("_n", oldest).filter("_n > 1").select("depot", "date", "actual_total", "pred_total", "total_variance")
