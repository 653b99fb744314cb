"""Streams end where the batch does, whatever the batching."""

import datetime as dt

import pyarrow.compute as pc
import pytest
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql.types import StructType

from depotlens.sources import snapshots
from depotlens.streaming import ingest as st

HEADER = "depot,date,passengers_per_day,actual_kms,occupancy_ratio\n"


def drop(path, name, lines):
    path.mkdir(exist_ok=True)
    (path / name).write_text(HEADER + "".join(f"{line}\n" for line in lines))


def dims(spark):
    return spark.createDataFrame([("A",), ("B",)], "depot string")


def run(spark, base, drops, reject="batch", archive=None, max_files=None):
    stream = st.file_stream(spark, str(drops), archive=archive, max_files=max_files)
    handler = st.load_handler(str(base / "master"), dims(spark), "2024-02-01", str(base / "errors"), reject=reject)
    st.ingest(stream, handler, str(base / "checkpoint")).awaitTermination()
    return table(spark, base / "master", "depot string, date date, actual_kms double")


def table(spark, path, schema):
    return snapshots.read(spark, str(path), StructType.fromDDL(schema))


def test_corrections_replace_and_runs_resume(spark, tmp_path):
    drops = tmp_path / "in"
    drop(drops, "ops_daily_2024-01-01.csv", ["A,2024-01-01,10,5.0,0.5", "B,2024-01-01,10,6.0,0.5"])
    drop(drops, "ops_daily_2024-01-02.csv", ["A,2024-01-02,10,7.0,0.5", "B,2024-01-02,10,8.0,0.5"])
    first = run(spark, tmp_path, drops, max_files=1)
    assert first.count() == 4
    drop(drops, "r2_ops_daily_2024-01-01.csv", ["A,2024-01-01,10,50.0,0.5", "B,2024-01-01,10,6.0,0.5"])
    again = run(spark, tmp_path, drops)
    day, after = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    assert rows(again, "date", "depot") == [("A", day, 50.0), ("B", day, 6.0), ("A", after, 7.0), ("B", after, 8.0)]
    assert {r.rule for r in spark.read.parquet(str(tmp_path / "errors")).collect()} == {"already_loaded"}


def test_failing_file_refuses_batch_or_file(spark, tmp_path):
    for mode in ("batch", "file"):
        base, drops = tmp_path / mode, tmp_path / f"in-{mode}"
        base.mkdir()
        drop(drops, "ops_daily_2024-01-01.csv", ["A,2024-01-01,10,5.0,0.5", "B,2024-01-01,10,5.0,0.5"])
        drop(drops, "ops_daily_2024-01-02.csv", ["Z,2024-01-02,10,5.0,0.5", "A,2024-01-03,10,-5.0,9.5"])
        out = run(spark, base, drops, mode)
        assert out.count() == (0 if mode == "batch" else 2)
        found = {(r.file, r.rule) for r in spark.read.parquet(str(base / "errors")).collect()}
        assert found == {("ops_daily_2024-01-02.csv", rule) for rule in (
            "unknown_depot", "date_mismatch", "several_dates", "range_actual_kms", "range_occupancy_ratio")}


def test_processed_files_are_archived(spark, tmp_path):
    drops, archive = tmp_path / "in", tmp_path / "done"
    for day in range(1, 4):
        drop(drops, f"ops_daily_2024-01-0{day}.csv", [f"A,2024-01-0{day},10,5.0,0.5"])
        run(spark, tmp_path, drops, archive=str(archive), max_files=1)
    kept = [p.name for p in archive.rglob("*.csv")]
    assert "ops_daily_2024-01-01.csv" in kept


def test_replayed_batch_changes_nothing(spark, tmp_path):
    master = str(tmp_path / "m")
    batch = spark.createDataFrame([("A", dt.date(2024, 1, 1), 1.0, "f1"), ("A", dt.date(2024, 1, 1), 2.0, "f2")],
                                  "depot string, date date, x double, file string")
    for _ in range(2):
        st.correct(batch, master, ["depot", "date"])
    assert [r.x for r in table(spark, master, "x double").collect()] == [2.0]


def test_short_file_is_refused(spark, tmp_path):
    drops = tmp_path / "in"
    drop(drops, "ops_daily_2024-01-01.csv", ["A,2024-01-01,10,5.0,0.5"])
    assert run(spark, tmp_path, drops, "file").count() == 0
    assert {(r.rule, r.n) for r in spark.read.parquet(str(tmp_path / "errors")).collect()} == {("row_count", 1)}


def test_service_rows_have_their_own_key_and_ranges(spark):
    from depotlens.operators.quality import preflight

    name = "ops_daily_service_2024-01-05.csv"
    rows_ = [("A", dt.date(2024, 1, 5), "1", 2.5, name), ("A", dt.date(2024, 1, 5), "2", 3.5, name), ("A", dt.date(2024, 1, 5), None, 1.0, name)]
    files = spark.createDataFrame(rows_, "depot string, date date, service_number string, occupancy_ratio double, file string")
    master = spark.createDataFrame([(dt.date(2024, 1, 1),)], "date date")
    got = {(r.rule, r.n) for r in preflight(files, master, dims(spark), "2024-02-01", kind="service").collect()}
    assert got == {("null_key", 1), ("range_occupancy_ratio", 1), ("date_gap", 3)}


def test_batch_run_again_leaves_tables_and_log_unchanged(spark, tmp_path):
    handler = st.load_handler(str(tmp_path / "master"), dims(spark), "2024-02-01", str(tmp_path / "errors"), reject="file")
    columns = "depot string, date date, passengers_per_day bigint, actual_kms double, occupancy_ratio double, file string"
    batch = spark.createDataFrame([("A", dt.date(2024, 1, 1), 1, 1.0, 0.5, "ops_daily_2024-01-01.csv")], columns)
    for _ in range(2):
        handler(batch, 7)
    assert [(r.rule, r.batch_id) for r in spark.read.parquet(str(tmp_path / "errors")).collect()] == [("row_count", 7)]


def test_only_the_months_of_a_batch_are_read(spark, tmp_path):
    master = str(tmp_path / "m")
    days = [dt.date(2024, m, 3) for m in range(1, 13)]
    st.correct(spark.createDataFrame([("A", d, 1.0, "f") for d in days], "depot string, date date, x double, file string"), master, ["depot", "date"])
    schema = StructType.fromDDL("depot string, date date, x double, month date")
    stored = snapshots.read(spark, master, schema, only=[dt.date(2024, 5, 1)])
    assert all("month=2024-05-01" in f for f in stored.inputFiles()) and [r.date for r in stored.collect()] == [days[4]]
    before = snapshots.manifest(spark, master)[1]
    st.correct(spark.createDataFrame([("A", days[4], 9.0, "g")], "depot string, date date, x double, file string"), master, ["depot", "date"])
    after = snapshots.manifest(spark, master)[1]
    assert {p for p in after if after[p] != before[p]} == {"month=2024-05-01"}
    assert sorted(r.x for r in snapshots.read(spark, master, schema).collect()) == [1.0] * 11 + [9.0]


def test_a_closing_batch_archives_every_file(spark, tmp_path):
    from depotlens.plans.catalog_stream import _FILE_SCHEMA

    drops, archive = tmp_path / "in", tmp_path / "done"
    drops.mkdir()
    for day in range(1, 6):
        drop(drops / f"file=ops_daily_2024-01-0{day}.csv", "part-0.csv", [f"{depot},2024-01-0{day},10,5.0,0.5" for depot in "AB"])
    handler = st.load_handler(str(tmp_path / "master"), dims(spark), "2024-02-01", str(tmp_path / "errors"))

    def again():
        return st.ingest(st.file_stream(spark, str(drops), _FILE_SCHEMA, archive=str(archive), max_files=2), handler, str(tmp_path / "checkpoint"))

    st.archive_all(spark, str(drops), str(archive), HEADER.strip().split(","), again)
    assert len(list(archive.rglob("part-0.csv"))) == 5 and st.archived_rows(spark, str(archive)).count() == 10


def test_actuals_of_many_months_close_all_predictions(spark, tmp_path):
    days = [dt.date(1850, 1, 3) + dt.timedelta(days=31 * k) for k in range(1300)]
    ledger, actuals = str(tmp_path / "ledger"), ", ".join(f"{c} {t}" for c, t in st.lg.ACTUALS.items())
    rows_ = [("A", d, 1.0, "pending", 1.0, *[None] * len(st.lg.ACTUALS), dt.date(2020, 1 + k % 5, 1)) for k, d in enumerate(days[:5])]
    schema = f"depot string, prediction_date date, predicted_passenger_kms double, status string, estimated_kms double, {actuals}, month date"
    rows_ = [(*r[:-1], r[1].replace(day=1)) for r in rows_]
    snapshots.commit(spark.createDataFrame(rows_, schema), ledger)
    batch = spark.createDataFrame([("A", d, 10, 5.0, 0.5, 2.5, "f") for d in days], st.DROP_SCHEMA + ", passenger_kms double, file string")
    st.close_handler(ledger)(batch, 0)
    assert [r.status for r in snapshots.read(spark, ledger, snapshots.schema(spark, ledger)).collect()] == ["completed"] * 5


# ---- commits ---------------------------------------------------------------------------
MONTHS = "x long, month date"


def month_rows(spark, *rows_):
    return spark.createDataFrame([(x, dt.date(2024, m, 1)) for x, m in rows_], MONTHS)


def contents(spark, path, **more):
    return sorted((r.x, r.month.month) for r in snapshots.read(spark, path, StructType.fromDDL(MONTHS), **more).collect())


def test_a_commit_that_stops_half_way_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.commit(month_rows(spark, (1, 1), (2, 2)), path)

    def failing(batches):
        """The first month is written when the second one fails."""
        for batch in batches:
            yield batch.filter(pc.equal(batch.column("x"), 10))
            if 20 in batch.column("x").to_pylist():
                raise RuntimeError("stopped between two partitions")

    new = month_rows(spark, (10, 1), (20, 2)).coalesce(1).mapInArrow(failing, MONTHS)
    with pytest.raises(PySparkException):
        snapshots.commit(new, path)
    assert contents(spark, path) == [(1, 1), (2, 2)] and snapshots.manifest(spark, path)[0] == 1


def test_a_reader_sees_the_table_before_or_after_a_commit(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.commit(month_rows(spark, (1, 1), (2, 2)), path)
    reader = snapshots.read(spark, path, StructType.fromDDL(MONTHS))
    assert snapshots.commit(month_rows(spark, (10, 1), (20, 2), (30, 3)), path) == 2
    assert sorted(r.x for r in reader.collect()) == [1, 2]
    assert contents(spark, path) == [(10, 1), (20, 2), (30, 3)] and contents(spark, path, at=1) == [(1, 1), (2, 2)]
    assert contents(spark, path, only=[dt.date(2024, 3, 1), dt.date(2024, 9, 1)]) == [(30, 3)]
    assert snapshots.expire(spark, path, keep=1) == 1 and contents(spark, path) == [(10, 1), (20, 2), (30, 3)]


def test_commits_of_other_partitions_are_kept_and_of_the_same_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.commit(month_rows(spark, (1, 1), (2, 2)), path)
    snapshots.commit(month_rows(spark, (5, 2)), path, base=1)
    assert snapshots.commit(month_rows(spark, (4, 1)), path, base=1) == 3
    assert contents(spark, path) == [(4, 1), (5, 2)]
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(month_rows(spark, (6, 2)), path, base=1)
    assert not snapshots._publish(spark, path, 3, {}) and snapshots.manifest(spark, path)[0] == 3
    assert contents(spark, str(tmp_path / "none")) == []


def test_open_windows_are_provisional(spark, tmp_path):
    """Two runs: the second changes an open day, a closed one drops what comes too late."""
    folder = tmp_path / "in"

    def run_once(rows_):
        spark.createDataFrame([("a", dt.datetime(2024, 1, d, 5), v) for d, v in rows_], "k string, ts timestamp, v long").coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema("k string, ts timestamp, v long").parquet(str(folder))
        out = st.run_to_table(st.daily_rollup(stream, ["k"], "v"), str(tmp_path / "out"), str(tmp_path / "check"), ["k", "day"])
        return sorted((r.day.day, r.n, r.total, r.closed) for r in out.collect())

    assert run_once([(1, 1), (2, 2), (5, 3)]) == [(1, 1, 1, True), (2, 1, 2, True), (5, 1, 3, False)]
    assert run_once([(5, 4), (1, 100), (9, 1)]) == [(1, 1, 1, True), (2, 1, 2, True), (5, 2, 7, True), (9, 1, 1, False)]
