"""Session settings and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Set through conf so a cluster's own values can override them at submit time.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "depotlens", **conf: str) -> SparkSession:
    """Create (or reuse) a session; ``master`` is only given for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is only chosen when the session itself runs on one
    machine and names none.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="depotlens-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


# Folders that this process has made in the shared folder.
_MADE: list[str] = []


def release(spark: SparkSession) -> int:
    """Remove the intermediate tables of this process, at the end of a job: what was read from them lazily can't be read after that."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    while _MADE:
        path = files.Path(_MADE.pop())
        removed += path.getFileSystem(conf).delete(path, True)
    return removed


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared folder (never reused, so never cleared)."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    if "://" not in path and _is_local(spark):
        os.makedirs(os.path.dirname(path), exist_ok=True)
    _MADE.append(path)
    return path


def materialise(df, label: str):
    """Cut the lineage of an intermediate result through a table in the shared folder.

    Used where a result feeds many branches or repeated passes.  Unlike a block
    kept on executors, it outlives the loss of any of them.
    """
    spark = df.sparkSession
    path = work_dir(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
