"""Data-quality rules.  Each returns violations as rows instead of raising.

Counting rules scan once with map-side combined aggregates and turn the single
result row into one row per rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted(df: DataFrame, checks: dict[tuple[str, str], Column], keep_zero: bool = False) -> DataFrame:
    """(rule, column) -> number of offending rows, from one aggregate."""
    names = list(checks)
    row = df.agg(*[F.count_if(checks[k]).alias(f"_{i}") for i, k in enumerate(names)])
    cells = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(col).alias("column"), F.col(f"_{i}").alias("n"))
        for i, (rule, col) in enumerate(names)
    ])
    out = row.select(F.explode(cells).alias("c")).select("c.*")
    return out if keep_zero else out.filter("n > 0")


def null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return counted(df, {("null_key", k): F.col(k).isNull() for k in keys})


def single_date(df: DataFrame, file_col: str, date_col: str) -> DataFrame:
    """Files whose rows do not all carry one date."""
    return (
        df.groupBy(file_col)
        .agg(F.min(date_col).alias("first_date"), F.max(date_col).alias("last_date"), F.count_if(F.col(date_col).isNull()).alias("undated"))
        .filter((F.col("first_date") != F.col("last_date")) | F.col("first_date").isNull())
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def unknown_members(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col(key).isNotNull()).join(dim.select(key), key, "left_anti")


def row_count_matches(df: DataFrame, dim: DataFrame, by: str) -> DataFrame:
    """Groups that do not hold one row per dimension member."""
    expected = dim.agg(F.count("*")).scalar()
    return df.groupBy(by).agg(F.count("*").alias("n")).withColumn("expected", expected).filter("n <> expected")


# Accepted range per column of the depot-day and service-day files.
DEPOT_BOUNDS = {
    "passengers_per_day": (0, None), "actual_kms": (0, None), "occupancy_ratio": (0, 2.0), "passenger_kms": (0, None),
}
SERVICE_BOUNDS = {
    "actual_kms": (0, None), "actual_trips": (0, None), "seat_kms": (0, None), "passenger_kms": (0, None),
    "occupancy_ratio": (0, 3.0), "revenue": (0, None),
}


def bounds(df: DataFrame, limits: dict[str, tuple], keep_zero: bool = False) -> DataFrame:
    checks = {}
    for col, (lo, hi) in limits.items():
        if col in df.columns and lo is not None:
            checks[("below", col)] = F.col(col) < lo
        if col in df.columns and hi is not None:
            checks[("above", col)] = F.col(col) > hi
    return counted(df, checks, keep_zero)


def missing_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = columns or df.columns
    return counted(df, {("missing", c): F.col(c).isNull() for c in names}, keep_zero=True).drop("rule")


def require_complete(df: DataFrame) -> DataFrame:
    """Hard gate: fails the job at run time on the first row with a missing value."""
    gap = [F.col(c).isNull() for c in df.columns]
    bad = gap[0]
    for g in gap[1:]:
        bad = bad | g
    checked = F.when(bad, F.raise_error(F.lit("row with a missing value"))).otherwise(F.lit(True))
    return df.filter(checked.cast("boolean"))


# Names of the two kinds of arriving files.
DEPOT_FILE = r"ops_daily_(\d{4}-\d{2}-\d{2})\.csv$"
SERVICE_FILE = r"ops_daily_service_(\d{4}-\d{2}-\d{2})\.csv$"


def classify_file(name: Column) -> dict[str, Column]:
    kind = F.when(name.rlike(DEPOT_FILE), "depot").when(name.rlike(SERVICE_FILE), "service").otherwise("unknown")
    date = F.coalesce(
        F.try_to_date(F.nullif(F.regexp_extract(name, DEPOT_FILE, 1), F.lit("")), "yyyy-MM-dd"),
        F.try_to_date(F.nullif(F.regexp_extract(name, SERVICE_FILE, 1), F.lit("")), "yyyy-MM-dd"),
    )
    return {"kind": kind, "file_date": date}


def date_rules(files: DataFrame, as_of: str) -> DataFrame:
    """Needs (file, file_date, data_date); flags mismatch and future dates."""
    rule = F.when(F.col("file_date").isNull(), "no_date_in_name").when(
        F.col("file_date") != F.col("data_date"), "date_mismatch"
    ).when(F.col("data_date") > F.lit(as_of).cast("date"), "future_date")
    return files.withColumn("rule", rule).filter("rule IS NOT NULL")


def already_loaded(df: DataFrame, master: DataFrame) -> DataFrame:
    """Dates of the arrival that the master already holds, with the master's row count."""
    return master.join(df.select("date").distinct(), "date", "left_semi").groupBy("date").agg(F.count("*").alias("n"))


def date_gaps(master: DataFrame, upto: Column, max_gap: int = 30) -> DataFrame:
    """Dates strictly between the master's last date and ``upto``, at most ``max_gap`` (the report's length)."""
    last = master.agg(F.max("date").alias("last"))
    start, stop = F.date_add("last", 1), F.least(F.date_sub(upto, 1), F.date_add("last", max_gap))
    return last.filter(start <= stop).select(F.explode(F.sequence(start, stop)).alias("date"))


def series_gaps(df: DataFrame) -> DataFrame:
    """Missing days inside each depot's own range; input unique on (depot, date)."""
    spans = df.groupBy("depot").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    spine = spans.select("depot", F.explode(F.sequence("lo", "hi")).alias("date"))
    return spine.join(df.select("depot", "date"), ["depot", "date"], "left_anti")


# Accepted range per sheet measure.
SHEET_RULES = {
    "Schedules": (1, 999), "Schedules_Services": (1, 999), "Planned_Schedules": (1, 999), "Planned_Services": (1, 999),
    "Actual_Services": (1, 999), "Total_Drivers": (1, 999), "Schedules_Kms": (1000, 99999), "Planned_KM": (1000, 99999),
    "Actual_KM": (1000, 99999), "Drivers_Required": (1, None),
}


def sheet_rules(sheet: DataFrame, rules: dict[str, tuple] = SHEET_RULES) -> DataFrame:
    """Cells outside their range."""
    checks = [
        F.when((F.col(c) < lo) | (F.col(c) > hi if hi is not None else F.lit(False)),
               F.struct(F.lit(c).alias("column"), F.col(c).cast("bigint").alias("value")))
        for c, (lo, hi) in rules.items()
    ]
    return (
        sheet.select("depot", "data_date", F.explode(F.array_compact(F.array(*checks))).alias("v"))
        .select("depot", "data_date", "v.*")
    )


def reason_totals(kpis: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Sheet rows whose reasons do not add up to their total.

    Stated as an exploded violation rather than a filter: inferring constraints
    from a predicate over a 23-column sum takes the optimizer exponential time.
    """
    off = (F.abs("mu_diff") > tol) | (F.abs("sl_diff") > tol)
    cell = F.when(off, F.struct("mu_diff", "sl_diff"))
    return kpis.select("depot", "data_date", F.explode(F.array_compact(F.array(cell))).alias("v")).select(
        "depot", "data_date", "v.*")


def non_negative_int(df: DataFrame, ids: list[str], columns: list[str], allow: list[str]) -> DataFrame:
    """Cells that are negative (unless allowed) or not whole."""
    long = df.unpivot(ids, columns, "column", "value")
    negative = (F.col("value") < 0) & ~F.col("column").isin(allow)
    return long.filter(negative | (F.col("value") != F.floor("value")))


def name_pattern(df: DataFrame, column: str, pattern: str = r"^[A-Za-z][A-Za-z0-9 .\-]*$") -> DataFrame:
    return df.filter(~F.col(column).rlike(pattern)).select(column).distinct()


# What tells the two kinds of arriving files apart: key, ranges, and whether each depot stands in a file exactly once.
FILE_KINDS = {
    "depot": {"keys": ["depot", "date"], "bounds": DEPOT_BOUNDS, "one_per_depot": True},
    "service": {"keys": ["depot", "date", "service_number"], "bounds": SERVICE_BOUNDS, "one_per_depot": False},
}
# Findings that don't keep a file from loading.
WARNINGS = ("already_loaded", "date_gap")


def preflight(files: DataFrame, master: DataFrame, depots: DataFrame, as_of: str, limits=None, kind: str = "depot") -> DataFrame:
    """All rules for all files of a kind at once: (file, rule, n); a file without rows here, or with WARNINGS only, may load.

    ``files`` holds every arriving row with its ``file`` name, depot, date and measures.
    Everything per file comes from one grouping; only the key duplicates need a second.
    """
    rules = FILE_KINDS[kind]
    d = F.col("date")
    named = files.withColumns(classify_file(F.col("file")))
    known = depots.select("depot").distinct().withColumn("_known", F.lit(1))
    loaded = master.select("date").distinct().withColumn("_loaded", F.lit(1))
    # Both are one row a depot or day; dealt by depot or day, a task would sort all rows of it.
    rows = named.join(F.broadcast(known), "depot", "left").join(F.broadcast(loaded), "date", "left")
    empty = F.lit(False)
    for key in rules["keys"]:
        empty = empty | F.col(key).isNull()
    tests = {
        "bad_name": F.col("kind") != kind,
        "null_key": empty,
        "unknown_depot": F.col("depot").isNotNull() & F.col("_known").isNull(),
        "date_mismatch": F.col("file_date") != d,
        "future_date": d > F.lit(as_of).cast("date"),
        "already_loaded": F.col("_loaded").isNotNull(),
    }
    for col, (lo, hi) in (limits or rules["bounds"]).items():
        if col in files.columns:
            tests[f"range_{col}"] = (F.col(col) < lo) | (F.col(col) > hi if hi is not None else F.lit(False))
    row = rows.groupBy("file").agg(
        *[F.count_if(t).alias(r) for r, t in tests.items()],
        (F.when(F.min("date") != F.max("date"), 1).otherwise(0)).cast("bigint").alias("several_dates"),
        F.count("*").alias("_rows"), F.min("date").alias("_first"),
    )
    # Days between the master's last date and the file's.
    last = master.agg(F.max("date")).scalar()
    found = row.withColumn("date_gap", F.greatest(F.datediff("_first", last).cast("bigint") - 1, F.lit(0)))
    names = [*tests, "several_dates", "date_gap"]
    if rules["one_per_depot"]:
        expected = depots.select(F.countDistinct("depot")).scalar()
        found = found.withColumn("row_count", F.when(F.col("_rows") != expected, F.col("_rows")).otherwise(0))
        names.append("row_count")
    long = found.unpivot("file", names, "rule", "n").filter("n > 0")
    twice = duplicate_keys(files, ["file", *rules["keys"]]).groupBy("file").agg(F.count("*").alias("n"))
    return long.unionByName(twice.select("file", F.lit("duplicate_key").alias("rule"), "n"))
