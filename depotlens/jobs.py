"""The two nightly jobs, end to end: what has arrived becomes history, and the history becomes tomorrow's plan.

Both end in keyed commits, so a job that is run again leaves the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.functions.timeparts import month_start
from depotlens.operators import features as ft
from depotlens.operators import forecast as fc
from depotlens.operators import ledger as lg
from depotlens.operators import rollups, supply
from depotlens.operators.joins import build_gold
from depotlens.operators.quality import FILE_KINDS
from depotlens.session import materialise
from depotlens.sources import files, snapshots
from depotlens.streaming import ingest as st


def load_arrivals(
    spark: SparkSession, drops: str, base: str, depots: DataFrame, lunar: DataFrame, holidays: DataFrame, as_of: str, schema: str = st.DROP_SCHEMA, reject: str = "file",
) -> None:
    """Arrived depot files through the gate into ``master``, ``gold`` and ``ledger`` under ``base``; findings go to ``errors``.

    A batch reads and replaces the months it touches, in each of the tables; predictions whose days are now known are completed.
    """
    master, gold, ledger = (f"{base}/{t}" for t in ("master", "gold", "ledger"))

    def handle(batch: DataFrame, epoch: int) -> None:
        batch = materialise(batch, "batch")
        clean = materialise(st.gate(batch, snapshots.read(spark, master, batch.schema), depots, as_of, f"{base}/errors", reject, epoch=epoch), "clean")
        months = st.months_of(clean.select(month_start(F.col("date")).alias("month")))
        if not months:
            return
        st.correct(clean, master, list(FILE_KINDS["depot"]["keys"]))
        days = snapshots.read(spark, master, snapshots.schema(spark, master), only=months)
        curated = materialise(build_gold(days.drop("month"), lunar, holidays, depots).withColumn("month", month_start(F.col("date"))), "gold")
        snapshots.commit(curated, gold)
        if snapshots.manifest(spark, ledger)[0]:
            actuals = lg.ledger_actuals(curated)
            st.replace_months(spark, ledger, snapshots.schema(spark, ledger), months, lambda stored: lg.close_pending(stored, actuals))

    st.ingest(st.file_stream(spark, drops, schema), handle, f"{base}/checkpoint").awaitTermination()


def train(gold: DataFrame, weather: DataFrame, registry: str, version: str, settings: fc.TreeSettings = fc.TreeSettings(), test_dates: int = 90) -> fc.Model:
    """The demand model, with its hold-out scores and a row of its history in ``registry``."""
    feats = materialise(ft.features(gold, weather), "features")
    model, scored = fc.train_demand(feats, test_dates, settings)
    scores = lg.metrics(scored.withColumn("scope", F.lit("all")), "passenger_kms", "predicted", ["scope"])
    fc.save_model(model, scores, registry, version, str(scored.agg(F.max("date")).first()[0]))
    return model


def plan_next(
    model: fc.Model, gold: DataFrame, lunar: DataFrame, holidays: DataFrame, weather: DataFrame, ledger: str,
    services: DataFrame, service_daily: DataFrame, shares: DataFrame, target: str, schedules: str,
) -> tuple[DataFrame, DataFrame]:
    """Forecast of each depot's next plan day into the ledger, and both engines' schedules from it: (trip plan, slot plan) as written.

    Predictions that the ledger holds already stay as they are and are the ones planned for.  Of ``service_daily``
    only the days that an engine looks back on are written, from which both read.
    """
    spark, key = gold.sparkSession, ["depot", "prediction_date"]
    rows = fc.future_rows(gold, lunar, holidays, weather)
    preds = fc.predict(model, rows, "predicted").select("depot", F.col("date").alias("prediction_date"), F.col("predicted").alias("predicted_passenger_kms"))
    fresh = materialise(lg.prediction_rows(preds, rollups.rolling_or(gold)).withColumn("month", month_start(F.col("prediction_date"))), "fresh")
    if snapshots.manifest(spark, ledger)[0]:
        schema = snapshots.schema(spark, ledger)
        st.replace_months(spark, ledger, schema, st.months_of(fresh), lambda stored: lg.insert_if_absent(stored, fresh.select(*[c for c in schema.names if c in fresh.columns]), key))
    else:
        snapshots.commit(fresh, ledger)
    held = snapshots.read(spark, ledger, snapshots.schema(spark, ledger), only=st.months_of(fresh))
    forecast = held.join(fresh.select(*key), key, "left_semi").select("depot", F.col("predicted_passenger_kms").alias("predicted_pkm"))
    forecast = materialise(forecast, "forecast")
    days = max(supply.TripPolicy.lookback_days, supply.SlotPolicy.lookback_days)
    recent = materialise(supply.lookback(service_daily, target, days), "recent-days")
    trips = supply.trip_schedule(services, recent, forecast, shares, target)
    slots = supply.slot_schedule(services, recent, forecast, target)
    files.write_schedule(trips, target, f"{schedules}/trips")
    files.write_schedule(slots, target, f"{schedules}/slots")
    return tuple(spark.read.schema(p.schema).parquet(f"{schedules}/{kind}") for kind, p in (("trips", trips), ("slots", slots)))
