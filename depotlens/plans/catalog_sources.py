"""Source and sink (S) queries: each writes real tables and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from depotlens.functions.kpi import derive_kpis
from depotlens.operators import documents, quality, supply
from depotlens.plans.catalog_clean import arriving_files
from depotlens.plans.catalog_supply import slot_plan
from depotlens.plans.registry import query
from depotlens.session import work_dir
from depotlens.sources import files
from depotlens.sources.views import Domain


@query("S01_csv_scan", "SELECT depot, date, actual_kms, revenue FROM daily")
def s01(d: Domain):
    path = files.write_csv(d.daily.select(F.lit(0).alias("Unnamed: 0"), "depot", "date", "actual_kms", "revenue"), work_dir(d.spark, "csv"))
    return files.read_csv(d.spark, path, "`Unnamed: 0` int, depot string, date date, actual_kms double, revenue double")


@query("S02_classify_files", """
    SELECT file, CASE WHEN file LIKE 'ops_daily_%' THEN 'depot' ELSE 'unknown' END AS kind,
           try_strptime(regexp_extract(file, 'ops_daily_(\\d{4}-\\d{2}-\\d{2})\\.csv$', 1), '%Y-%m-%d')::DATE AS file_date, count(*) AS n
    FROM files GROUP BY 1""")
def s02(d: Domain):
    return arriving_files(d).groupBy("file").agg(F.count("*").alias("n")).withColumns(quality.classify_file(F.col("file")))


@query("S03_parquet_backfill", "SELECT depot, date, actual_kms, NULL::DOUBLE AS legacy FROM daily")
def s03(d: Domain):
    path = files.write_parquet(d.daily, work_dir(d.spark, "gold"))
    return files.read_parquet(d.spark, path, {"depot": "string", "date": "date", "actual_kms": "double", "legacy": "double"})


@query("S04_parquet_write", "SELECT depot, date, year(date) AS year, passenger_kms FROM gold", "passenger_kms")
def s04(d: Domain):
    gold = d.gold.select("depot", "date", F.year("date").alias("year"), "passenger_kms")
    return d.spark.read.parquet(files.write_parquet(gold, work_dir(d.spark, "gold"), ["year"]))


@query("S05_csv_write", "SELECT depot, date, passenger_kms FROM gold", "passenger_kms")
def s05(d: Domain):
    path = files.write_csv(d.gold.select("depot", "date", "passenger_kms"), work_dir(d.spark, "csv"))
    return files.read_csv(d.spark, path, "depot string, date date, passenger_kms double")


@query("S06_table_scan", """
    SELECT depot, operations_date, sum(opd_kms) AS km FROM operations
    WHERE depot IN ('NATION_3', 'NATION_8') AND operations_date BETWEEN DATE '1998-01-01' AND DATE '1999-06-30' GROUP BY 1, 2""")
def s06(d: Domain):
    rows = files.scan_table(d.operations_between("1998-01-01", "1999-07-01"), "operations_date", ["NATION_3", "NATION_8"])
    return rows.groupBy("depot", "operations_date").agg(F.sum("opd_kms").alias("km"))


@query("S07_append_complete", "SELECT depot, count(*) * 2 AS n FROM daily GROUP BY 1")
def s07(d: Domain):
    path = work_dir(d.spark, "append")
    files.append_complete(d.daily, path)
    files.append_complete(d.daily, path)
    return d.spark.read.parquet(path).groupBy("depot").agg(F.count("*").alias("n"))


_DOC = "doc_id string, depot string, data_date date, raw_fields map<string,string>, calculated_fields map<string,double>, text string"


@query("S08_json_lines", "SELECT doc_id, length(depot) AS n, pct_sick, Actual_KM::VARCHAR AS km FROM doc_parts", "pct_sick")
def s08(d: Domain):
    docs = documents.kpi_documents(derive_kpis(d.sheet), ["Actual_KM"])
    back = files.read_json(d.spark, files.write_json(docs, work_dir(d.spark, "docs")), _DOC)
    return back.select("doc_id", F.length("depot").alias("n"), F.col("calculated_fields")["% Sick Leave"].alias("pct_sick"),
                       F.col("raw_fields")["Actual_KM"].alias("km"))


@query("S09_schedule_output", "SELECT depot, DATE '2001-11-05' AS target_date, action, count(*) AS n FROM slot_plan GROUP BY 1, 3")
def s09(d: Domain):
    path = files.write_schedule(slot_plan(d), "2001-11-05", work_dir(d.spark, "schedule"))
    return d.spark.read.parquet(path).groupBy("depot", "target_date", "action").agg(F.count("*").alias("n"))


@query("S10_json_summary", """
    SELECT depot, count(*) AS total_services, count(*) FILTER (WHERE action = 'CUT') AS count_cut, avg(cpk) AS cpk FROM slot_plan GROUP BY 1""", "cpk")
def s10(d: Domain):
    plan = slot_plan(d)
    summary = supply.slot_summary(plan).join(plan.groupBy("depot").agg(F.avg("cpk").alias("cpk")), "depot")
    path = files.write_summaries(summary, work_dir(d.spark, "summary"))
    back = files.read_json(d.spark, path, "depot string, summary struct<total_services: bigint, count_cut: bigint, cpk: double>")
    return back.select("depot", "summary.*")


@query("S13_log_rows", "SELECT file, count(*) AS n FROM (SELECT DISTINCT file, date FROM files) GROUP BY 1")
def s13(d: Domain):
    path = work_dir(d.spark, "log")
    for _ in range(2):  # a replay
        files.log_rows(arriving_files(d).select("file", F.col("date").alias("day")).distinct(), path, 7)
    return d.spark.read.parquet(path).groupBy("file").agg(F.count("*").alias("n"))


@query("S15_file_hashes")
def s15(d: Domain):
    return files.file_hashes(d.spark, d.folder, "*.parquet")


@query("S16_export", """SELECT depot AS "Depot", date AS "Date", actual_kms AS "Actual KM" FROM daily""")
def s16(d: Domain):
    path = files.export(d.daily, {"depot": "Depot", "date": "Date", "actual_kms": "Actual KM"}, work_dir(d.spark, "export"))
    return files.read_csv(d.spark, path, "Depot string, Date date, `Actual KM` double")
