"""File drops as a stream: gate, late corrections, and prediction closing.

Each micro-batch is idempotent: it ends in a keyed upsert, so a batch replayed
after a failure leaves the same table.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from depotlens.functions.timeparts import month_start
from depotlens.operators import ledger as lg
from depotlens.operators.quality import FILE_KINDS, WARNINGS, preflight
from depotlens.operators.reshape import upsert
from depotlens.session import materialise
from depotlens.sources import snapshots

SERVICE_SCHEMA = ("depot string, date date, service_number string, actual_kms double, actual_trips double, seat_kms double, "
                  "passenger_kms double, occupancy_ratio double, revenue double")
DROP_SCHEMA = "depot string, date date, passengers_per_day bigint, actual_kms double, occupancy_ratio double"


def file_stream(spark: SparkSession, path: str, schema: str = DROP_SCHEMA, archive: str | None = None, max_files: int | None = None) -> DataFrame:
    """Rows of arriving CSV files with the file's name; processed files may be archived."""
    # Headers are checked against the schema: a file with other columns fails instead of being misread.
    reader = spark.readStream.schema(schema).option("header", True).option("enforceSchema", False)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.csv(path)
    return rows if "file" in rows.columns else rows.withColumn("file", F.col("_metadata.file_name"))


def ingest(rows: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process everything that has arrived, batch by batch, then stop."""
    return (
        rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def data_files(spark: SparkSession, path: str) -> set[str]:
    """Names (folder and file) of the data files anywhere under a folder, which may be missing."""
    if not exists(spark, path):
        return set()
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(place, True)
    out = set()
    while files.hasNext():
        own = files.next().getPath()
        if own.getName()[0] not in "._":
            out.add(f"{own.getParent().getName()}/{own.getName()}")
    return out


def archive_all(spark: SparkSession, drops: str, archive: str, columns: list[str], run: Callable[[], StreamingQuery], seconds: float = 120) -> None:
    """Run the stream until every dropped file is in the archive.

    A batch's files are moved when the next batch begins, so a file without rows follows the others as the closing
    batch; it stays where it was dropped.  They are moved in the background, which is waited for.
    """
    dropped = data_files(spark, drops)
    run().awaitTermination()
    spark.createDataFrame([(",".join(columns),)], "value string").coalesce(1).write.mode("append").text(f"{drops}/file=closing")
    run().awaitTermination()
    end = time.monotonic() + seconds
    while missing := dropped - data_files(spark, archive):
        if time.monotonic() > end:
            raise TimeoutError(f"{len(missing)} of {len(dropped)} files are not archived, such as {min(missing)}")
        time.sleep(0.2)


def archived_rows(spark: SparkSession, archive: str, schema: str = DROP_SCHEMA) -> DataFrame:
    """Rows of every file the stream has moved to its archive."""
    if not exists(spark, archive):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(archive)


def newest_per_key(batch: DataFrame, keys: list[str]) -> DataFrame:
    """Several files of one batch may hold a key; the newest file name wins."""
    rest = [c for c in batch.columns if c not in (*keys, "file")]
    return batch.groupBy(*keys).agg(F.max(F.struct("file", *rest)).alias("r")).select(*keys, *[F.col(f"r.{c}") for c in rest])


def months_of(rows: DataFrame) -> list:
    """The distinct months of the rows, of which the calendar has few."""
    return [r.month for r in rows.select("month").distinct().collect()]


def correct(batch: DataFrame, master: str, keys: list[str]) -> None:
    """Upsert a batch into the month-partitioned master table, in one commit (``snapshots``).

    Only the months the batch touches are read and replaced, so a correction of one day costs one month whatever the
    table's size.  If someone else replaces one of them meanwhile, the correction is made again from the new one.
    """
    spark = batch.sparkSession
    inbound = materialise(newest_per_key(batch, keys).withColumn("month", month_start(F.col("date"))), "inbound")
    replace_months(spark, master, inbound.schema, months_of(inbound), lambda touched: upsert(touched, inbound, keys))


def replace_months(spark: SparkSession, path: str, schema, months: list, change: Callable[[DataFrame], DataFrame]) -> None:
    """Read some months, change and commit them; again from the new ones if someone else has replaced one meanwhile."""
    while True:
        number, _ = snapshots.manifest(spark, path)
        touched = snapshots.read(spark, path, schema, only=months, at=number)
        try:
            snapshots.commit(change(touched), path, base=number)
            return
        except snapshots.Conflict:
            continue


def write_batch(rows: DataFrame, path: str, epoch: int) -> None:
    """The rows of one micro-batch in its own folder: a batch that is run again replaces what it wrote before."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={epoch}")


def gate(
    batch: DataFrame, master: DataFrame, depots: DataFrame, as_of: str, error_log: str, reject: str = "batch", kind: str = "depot", epoch: int = 0,
) -> DataFrame:
    """Rows that may load.  All findings go to the error log, under the batch's number.

    ``reject='batch'`` refuses all files when one fails, ``'file'`` only the failing ones.
    Warnings (dates already loaded, which are corrections, and gaps) refuse nothing.
    """
    found = materialise(preflight(batch, master, depots, as_of, kind=kind), "violations")
    write_batch(found, error_log, epoch)
    errors = found.filter(~F.col("rule").isin(*WARNINGS))
    if reject == "batch":
        clean = errors.agg(F.count("*") == 0).scalar()
        return batch.filter(clean)
    return batch.join(errors.select("file").distinct(), "file", "left_anti")


def load_handler(master: str, depots: DataFrame, as_of: str, error_log: str, keys=None, reject: str = "batch", kind: str = "depot"):
    """Gate, then correct: the body of the daily ingest of one kind of file.  The batch is read from its files once."""

    def handle(batch: DataFrame, epoch: int) -> None:
        batch = materialise(batch, "batch")
        stored = snapshots.read(batch.sparkSession, master, batch.schema)
        correct(gate(batch, stored, depots, as_of, error_log, reject, kind, epoch), master, list(keys or FILE_KINDS[kind]["keys"]))

    return handle


def close_handler(ledger: str):
    """Complete pending predictions as actuals arrive, replacing only the months touched."""

    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        actuals = materialise(lg.ledger_actuals(batch).withColumn("month", month_start(F.col("date"))), "actuals")
        replace_months(spark, ledger, snapshots.schema(spark, ledger), months_of(actuals), lambda stored: lg.close_pending(stored, actuals.drop("month")))

    return handle


# ---- event-time roll-ups --------------------------------------------------------
def event_stream(spark: SparkSession, folder: str, schema, pattern: str) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def daily_rollup(rows: DataFrame, keys: list[str], value: str, delay: str = "2 days", ts: str = "ts") -> DataFrame:
    """Calendar days per key; rows later than the delay are dropped (corrections go through ``correct``)."""
    return _windows(rows.withWatermark(ts, delay).groupBy(F.window(ts, "1 day"), *keys), keys, value, ts, "day")


def rolling_rollup(rows: DataFrame, keys: list[str], value: str, delay: str = "2 days", ts: str = "ts") -> DataFrame:
    """Seven-day windows advancing by a day."""
    return _windows(rows.withWatermark(ts, delay).groupBy(F.window(ts, "7 days", "1 day"), *keys), keys, value, ts, "first_day")


def _windows(grouped, keys: list[str], value: str, ts: str, day: str) -> DataFrame:
    made = grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(ts).alias("_newest"))
    return made.select(*keys, F.to_date("window.start").alias(day), "n", "total", F.col("window.end").alias("_end"), "_newest")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, keys: list[str], delay: str = "2 days") -> DataFrame:
    """Run a roll-up over all that is available and read the newest state of every window, with ``closed``.

    Each batch writes the windows that it changed, under its number, so open windows are there as well: provisional until
    the watermark, the newest time less the delay, has passed their end.
    """
    def handle(batch: DataFrame, epoch: int) -> None:
        write_batch(batch, path, epoch)

    stream.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    written = spark.read.schema(StructType([*stream.schema, StructField("batch_id", LongType())])).parquet(path)
    rest = [c for c in stream.columns if c not in keys]
    newest = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("w")).select(*keys, "w.*")
    mark = written.agg(F.max("_newest")).first()[0]
    closed = F.col("_end") <= F.lit(mark) - F.expr(f"INTERVAL {delay}")
    return newest.withColumn("closed", closed).drop("_end", "_newest")
