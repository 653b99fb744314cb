"""Tables whose partitions are replaced by one atomic commit.

A commit writes its rows to a folder of its own and then publishes a manifest: a small file that names, for every
partition, the folder that holds it.  Manifests are numbered; the highest one is the table.  Files that a manifest
names are never changed, so a reader sees the table before a commit or after it, and a commit that stops half-way
leaves nothing but a folder that no manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType


class Conflict(RuntimeError):
    """Another commit has replaced a partition that this one was made from."""


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    place, fs = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """(number, commit by partition folder such as ``month=2024-01-01``); number 0 of a table without commits."""
    numbers = [int(n[:-5]) for n in _names(spark, f"{path}/_manifests") if n.endswith(".json") and n[:-5].isdigit()]
    if not numbers:
        return 0, {}
    return max(numbers), read_manifest(spark, path, max(numbers))


def read_manifest(spark: SparkSession, path: str, number: int) -> dict[str, str]:
    return json.loads("".join(r.value for r in spark.read.text(f"{path}/_manifests/{number:08d}.json").collect()))


def read(spark: SparkSession, path: str, schema: StructType, partition: str = "month", only: list | None = None, at: int | None = None) -> DataFrame:
    """The table as of the newest manifest (or number ``at``), or just its partitions ``only``: no other folder is listed."""
    held = manifest(spark, path)[1] if at is None else read_manifest(spark, path, at) if at else {}
    if only is not None:
        wanted = {f"{partition}={v}" for v in only}
        held = {p: c for p, c in held.items() if p in wanted}
    if not held:
        return spark.createDataFrame([], schema)
    kind = schema[partition] if partition in schema.names else StructField(partition, StringType())
    stored = StructType([*(f for f in schema if f.name != partition), StructField("commit", StringType()), kind])
    folders = [f"{path}/data/commit={c}/{p}" for p, c in sorted(held.items())]
    return spark.read.schema(stored).option("basePath", f"{path}/data").parquet(*folders).select(*schema.names)


def schema(spark: SparkSession, path: str) -> StructType:
    """The columns of a table that has a commit, its partition last."""
    held = manifest(spark, path)[1]
    place, name = min(held.items())
    found = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data/commit={name}/{place}").schema
    return StructType([f for f in found if f.name != "commit"])


def commit(rows: DataFrame, path: str, partition: str = "month", base: int | None = None) -> int:
    """Replace the partitions that ``rows`` hold, all at once; the number of the new manifest.

    ``base`` is the manifest that the rows were made from: if one of their partitions has been replaced since, the
    commit is refused.  Commits of other partitions in between are kept.
    """
    spark, name = rows.sparkSession, uuid.uuid4().hex[:16]
    rows.write.partitionBy(partition).parquet(f"{path}/data/commit={name}")
    own = {p: name for p in _names(spark, f"{path}/data/commit={name}") if p.startswith(f"{partition}=")}
    first = read_manifest(spark, path, base) if base else {}
    while True:
        number, held = manifest(spark, path)
        if base is not None and any(held.get(p) != first.get(p) for p in own):
            raise Conflict(f"partitions of {path} have changed since manifest {base}")
        if _publish(spark, path, number + 1, {**held, **own}):
            return number + 1


def _publish(spark: SparkSession, path: str, number: int, held: dict[str, str]) -> bool:
    """Whether the manifest could be put in its place, which one of several writers at a time can."""
    jvm = spark.sparkContext._jvm
    draft, fs = _fs(spark, f"{path}/_manifests/draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(held).encode()))
    out.close()
    target, _ = _fs(spark, f"{path}/_manifests/{number:08d}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(draft, target, options)
    except Exception as error:  # noqa: BLE001 - the JVM's own exception class is only known by name
        if "FileAlreadyExists" not in str(error):
            raise
        fs.delete(draft, False)
        return False
    return True


def expire(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete folders that none of the last ``keep`` manifests names and that belong to an older one; how many."""
    numbers = sorted(int(n[:-5]) for n in _names(spark, f"{path}/_manifests") if n.endswith(".json") and n[:-5].isdigit())
    kept = {c for n in numbers[-keep:] for c in read_manifest(spark, path, n).values()}
    old = {c for n in numbers[:-keep] for c in read_manifest(spark, path, n).values()} - kept
    for c in old:
        place, fs = _fs(spark, f"{path}/data/commit={c}")
        fs.delete(place, True)
    for n in numbers[:-keep]:
        place, fs = _fs(spark, f"{path}/_manifests/{n:08d}.json")
        fs.delete(place, False)
    return len(old)
