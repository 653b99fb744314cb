"""File sources and sinks.

Reads name their schema, so nothing scans data to guess it.  Writes rely on the
commit protocol of the file formats: a table appears complete or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.operators.ledger import with_columns
from depotlens.operators.quality import classify_file, require_complete
from depotlens.operators.reshape import upsert
from depotlens.sources import digests


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header CSV with a declared schema; index columns written by other tools are dropped."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df.drop(*[c for c in df.columns if c.startswith("Unnamed") or c.startswith("_c")])


def scan_arrivals(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every row of a drop folder with its file's name, kind and date."""
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path).withColumn("file", F.col("_metadata.file_name"))
    return rows.withColumns(classify_file(F.col("file")))


def read_parquet(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """The named columns; those an older table lacks come back as NULL."""
    df = spark.read.parquet(path)
    return with_columns(df, columns).select(*columns)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> str:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def scan_table(df: DataFrame, date: str, depots: list[str] | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Optional depot list and date range as bare-column predicates, which reach the file
    scan or the remote database."""
    out = df
    if depots:
        out = out.filter(F.col("depot").isin(depots))
    if first:
        out = out.filter(F.col(date) >= F.lit(first).cast("date"))
    if last:
        out = out.filter(F.col(date) <= F.lit(last).cast("date"))
    return out


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low, high, parts: int, **options) -> DataFrame:
    """Database table read in parallel ranges of ``column``; filters are pushed to the database."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts, **options)
    return reader.load()


def append_complete(df: DataFrame, path: str) -> str:
    """Append only if no cell is missing; otherwise the whole write fails and adds nothing."""
    require_complete(df).write.mode("append").parquet(path)
    return path


def replace_keyed(stored: DataFrame, inbound: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Write the upserted table to a new place (never over what it is read from) and read it back."""
    merged = upsert(stored, inbound, keys)
    merged.write.mode("overwrite").parquet(path)
    return stored.sparkSession.read.schema(merged.schema).parquet(path)


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_schedule(plan: DataFrame, target: str, path: str) -> str:
    """All depots of a target date in one write; the consolidated schedule is the table itself.

    Rows of a depot are spread over several files by service so that no task writes a whole depot.
    """
    dated = plan.withColumn("target_date", F.lit(target).cast("date"))
    spread = dated.repartition("target_date", "depot", F.pmod(F.xxhash64("service_number"), F.lit(16)))
    spread.write.mode("overwrite").partitionBy("target_date", "depot").parquet(path)
    return path


def write_summaries(summary: DataFrame, path: str) -> str:
    """One nested JSON object per depot."""
    rest = [c for c in summary.columns if c != "depot"]
    summary.select("depot", F.struct(*rest).alias("summary")).write.mode("overwrite").partitionBy("depot").json(path)
    return path


def log_rows(rows: DataFrame, path: str, batch: int | str = 0) -> str:
    """Log rows under their batch's key: a batch logged again replaces its rows."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch}")
    return path


def _local_paths(spark: SparkSession, paths: list[str]) -> list[str] | None:
    """Where the files lie as plain files, mount points (viewfs) followed; None if one lies in another kind of store."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for path in map(hadoop.Path, paths):
        uri = path.getFileSystem(conf).resolvePath(path).toUri()
        if uri.getScheme() != "file":
            return None
        found.append(uri.getPath())
    return found


def _hashes_by_part(spark: SparkSession, files: list[tuple[str, int, int]], part_bytes: int) -> list[str]:
    """SHA-256 of (path, modified, length), a task for each part of a file, all files side by side; only the states between parts come to the driver."""
    states = [digests.start()] * len(files)
    for first in range(0, max(length for _, _, length in files), part_bytes):
        parts = [(i, states[i], path, modified, first, min(part_bytes, length - first))
                 for i, (path, modified, length) in enumerate(files) if first < length]
        for i, state in spark.sparkContext.parallelize(parts, len(parts)).map(lambda p: (p[0], digests.add_range(*p[1:]))).collect():
            states[i] = state
    return [digests.finish(state) for state in states]


def file_hashes(spark: SparkSession, path: str, pattern: str = "*", part_bytes: int = 128 << 20) -> DataFrame:
    """SHA-256 and size of every file.

    Files over ``part_bytes`` are hashed part after part, by a task each.  Where they aren't plain files to Python (object stores, HDFS) or its
    OpenSSL gives no state out, Spark reads each as one cell, which ends at 2 GB.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    large = files.filter(F.col("length") > part_bytes).select("path", F.unix_millis("modificationTime"), "length", name).collect()
    places = _local_paths(spark, [r.path for r in large]) if large and digests.available() else None
    if not places:
        return files.select(name, "length", F.sha2("content", 256).alias("sha256"))
    hashes = _hashes_by_part(spark, [(place, r[1], r.length) for place, r in zip(places, large)], part_bytes)
    by_part = spark.createDataFrame([(r.file, r.length, h) for r, h in zip(large, hashes)], "file string, length long, sha256 string")
    return files.filter(F.col("length") <= part_bytes).select(name, "length", F.sha2("content", 256).alias("sha256")).union(by_part)


def export(df: DataFrame, labels: dict[str, str], path: str) -> str:
    """CSV with readable headers."""
    return write_csv(df.select(*labels).withColumnsRenamed(labels), path)
