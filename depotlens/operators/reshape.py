"""Upserts, set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.functions.clean import parse_date
from depotlens.operators.joins import exists_flag, first_per_key
from depotlens.operators.ranges import running_total


def upsert(master: DataFrame, inbound: DataFrame, keys: list[str]) -> DataFrame:
    """Master with the inbound rows replacing or joining it.  Inbound is unique on the keys."""
    kept = master.join(inbound.select(*keys), keys, "left_anti")
    return kept.unionByName(inbound.select(*master.columns))


def upsert_counts(master: DataFrame, inbound: DataFrame, keys: list[str]) -> DataFrame:
    """How many inbound rows are new and how many correct an existing one."""
    marked = exists_flag(inbound.select(*keys), master, keys, "known")
    return marked.agg(F.count_if(F.col("known") == 0).alias("inserted"), F.count_if(F.col("known") == 1).alias("corrected"))


def fill_missing(df: DataFrame, values: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Set ``column`` from ``values`` only where it is NULL or empty."""
    new = values.select(*keys, F.col(column).alias("_new"))
    old = F.col(column)
    if dict(df.dtypes)[column] == "string":
        old = F.nullif(column, F.lit(""))
    return df.join(new, keys, "left").withColumn(column, F.coalesce(old, F.col("_new"))).drop("_new")


def delete_keys(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def melt_dates(wide: DataFrame, ids: list[str]) -> DataFrame:
    """``*_dates`` columns to rows (year_col, date_list)."""
    return wide.unpivot(ids, [c for c in wide.columns if c.endswith("_dates")], "year_col", "date_list")


def split_dates(df: DataFrame, column: str = "date_list") -> DataFrame:
    """One row per date text of a cell listing several (separators , ; | and line breaks)."""
    parts = F.split(F.col(column), r"[,;|\n]+")
    rows = df.withColumn("date_text", F.explode(parts)).withColumn("date_text", F.trim("date_text"))
    return rows.filter("date_text <> ''").drop(column)


def holiday_long(wide: DataFrame) -> DataFrame:
    """Wide holiday calendar -> one row per date, the lowest code where dates collide."""
    ids = ["fes_hol_code", "holiday_festival", "fes_hol_category"]
    dated = split_dates(melt_dates(wide, ids)).withColumn("date", parse_date(F.col("date_text"))).filter("date IS NOT NULL")
    return first_per_key(dated.select("date", *ids), ["date"], ids)


def lunar(raw: DataFrame) -> DataFrame:
    """Text-dated lunar calendar -> one row per valid date."""
    rest = [c for c in raw.columns if c != "date"]
    dated = raw.withColumn("date", parse_date(F.col("date"))).filter("date IS NOT NULL")
    return first_per_key(dated.select("date", *rest), ["date"], rest)


def transpose(df: DataFrame, key: str, columns: list[str], values: list[str]) -> DataFrame:
    """Measures as rows and the given key values as columns."""
    long = df.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(key, columns, "measure", "value")
    cells = [F.max(F.when(F.col(key).cast("string") == v, F.col("value"))).alias(f"v_{v.replace('-', '_')}") for v in values]
    return long.groupBy("measure").agg(*cells)


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): codes 0.. in sorted order of the distinct values of a model category, numbered by ranges of them."""
    values = df.select(column).distinct().filter(F.col(column).isNotNull())
    return running_total(values, [], [F.asc(column)], F.lit(1), "code").withColumn("code", (F.col("code") - 1).cast("int"))


def encode(df: DataFrame, column: str, codes: DataFrame, name: str, unseen: Column | None = None) -> DataFrame:
    """Attach codes; values not in the dictionary get one code past its end."""
    past_end = codes.agg(F.count("*").cast("int")).scalar() if unseen is None else unseen
    return df.join(codes.withColumnRenamed("code", name), column, "left").withColumn(name, F.coalesce(name, past_end))
