"""Forecast models (F, T09) and retrieval (T07, D02, D03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from depotlens.operators import features as ft
from depotlens.operators import forecast as fc
from depotlens import jobs
from depotlens.functions.clean import share_from_percent
from depotlens.operators import boosting, joins, retrieval, rollups, supply
from depotlens.operators import ledger as lg
from depotlens.plans.registry import STEPS, query
from depotlens.session import materialise, work_dir
from depotlens.sources import snapshots
from depotlens.sources.views import Domain

# Production settings; only the demand has a hold-out that chooses the round.
DEMAND = fc.TreeSettings()
PASSENGERS = fc.TreeSettings(trees=1000, depth=6)
ABSENCE = fc.TreeSettings(700, 6, 0.05, 0.9, 1)
DUTIES = fc.TreeSettings(800, 8, 0.05)

# Where the models that this process has fitted were saved: fitted once for a session and folder, then read by every query.
_SAVED: dict[tuple, str] = {}


def saved(d: Domain, name: str, fit) -> str:
    """The folder of a model job's results, which ``fit(path)`` writes once."""
    key = (d.spark.sparkContext.applicationId, d.folder, name, DEMAND, PASSENGERS, ABSENCE, DUTIES)
    if key not in _SAVED:
        path = work_dir(d.spark, f"model-{name}")
        fit(path)
        _SAVED[key] = path
    return _SAVED[key]


def feature_table(d: Domain):
    """Written once; training, profiles and scoring read it."""
    return materialise(ft.features(d.written("gold"), d.written("weather")), "features")


def demand_model(d: Domain):
    """(model, scored hold-out) of the depot demand."""

    def fit(path):
        model, scored = fc.train_demand(feature_table(d), 90, DEMAND)
        model.save(f"{path}/model")
        scored.write.parquet(f"{path}/scored")

    path = saved(d, "demand", fit)
    return boosting.load(d.spark, f"{path}/model"), d.spark.read.parquet(f"{path}/scored")


@query("F02_select_features")
def f02(d: Domain):
    feats = ft.features(d.written("gold"), d.weather)
    cols = fc.select_features(feats)
    return feats.agg(*[F.count(c).alias(c) for c in cols]).unpivot([], cols, "feature", "present")


@query("F04_hash_split", """
    SELECT depot, CASE WHEN ('0x' || substr(md5(concat_ws('|', employee_id, operations_date, service_number)), 1, 8))::BIGINT % 100 >= 80 THEN 1 ELSE 0 END AS is_test,
           count(*) AS n FROM operations GROUP BY 1, 2""")
def f04(d: Domain):
    rows = lg.hash_split(d.operations, ["employee_id", "operations_date", "service_number"])
    return rows.groupBy("depot", "is_test").agg(F.count("*").alias("n"))


@query("F05_train_demand")
def f05(d: Domain):
    _, scored = demand_model(d)
    return lg.metrics(scored, "passenger_kms", "predicted", ["depot"])


@query("F06_demand_against_naive")
def f06_naive(d: Domain):
    """Hold-out error of the demand model beside that of the value a week ago, overall and by depot."""
    _, scored = demand_model(d)
    return fc.against_naive(scored, "passenger_kms", "predicted", "pkm_lag_7", ["depot"])


@query("T09_top_features")
def t09(d: Domain):
    model, _ = demand_model(d)
    return fc.top_features(model, 30)


@query("F16_model_registry")
def f16(d: Domain):
    path = work_dir(d.spark, "models")
    model, scored = demand_model(d)
    scores = lg.metrics(scored.withColumn("scope", F.lit("all")), "passenger_kms", "predicted", ["scope"])
    fc.save_model(model, scores, path, "v1", "2001-11-05")
    again = fc.predict(boosting.load(d.spark, f"{path}/v1/model"), scored.drop("predicted"), "predicted")
    history = d.spark.read.parquet(f"{path}/history")
    check = lg.metrics(again.withColumn("scope", F.lit("all")), "passenger_kms", "predicted", ["scope"]).select("scope", F.col("rmse").alias("reloaded_rmse"))
    return history.join(check, "scope")


STEPS["ahead"] = """
    SELECT g.depot, g.last, g.last + 2 AS date, isodow(g.last + 2) - 1 AS dow FROM (SELECT depot, max(date) AS last FROM gold GROUP BY 1) g"""


@query("F07_future_rows", """
    SELECT a.depot, a.date, a.dow, CASE WHEN h.date IS NULL THEN 0 ELSE 1 END AS is_fes_hol, lag_2 AS pkm_lag_2, roll7 AS pkm_roll7_mean,
           te AS depot_te, w.max_temp FROM ahead a
    LEFT JOIN holidays h ON h.date = a.date
    JOIN (SELECT depot, avg(passenger_kms) AS te, arg_max(passenger_kms, date) AS lag_2 FROM gold GROUP BY 1) t ON t.depot = a.depot
    JOIN (SELECT depot, avg(passenger_kms) AS roll7 FROM (SELECT *, row_number() OVER (PARTITION BY depot ORDER BY date DESC) AS age FROM gold)
          WHERE age <= 7 GROUP BY 1) r ON r.depot = a.depot
    ASOF LEFT JOIN weather w ON w.depot = a.depot AND a.date >= w.date""", "pkm_lag_2 pkm_roll7_mean depot_te max_temp")
def f07(d: Domain):
    rows = fc.future_rows(d.written("gold"), d.lunar, d.holidays, d.weather)
    return rows.select("depot", "date", "dow", "is_fes_hol", "pkm_lag_2", "pkm_roll7_mean", "depot_te", "max_temp")


@query("F09_forecast_future")
def f09(d: Domain):
    gold = d.written("gold")
    model, _ = demand_model(d)
    rows = fc.future_rows(gold, d.lunar, d.holidays, d.written("weather"))
    preds = fc.predict(model, rows, "predicted").select("depot", F.col("date").alias("prediction_date"), F.col("predicted").alias("predicted_passenger_kms"))
    return lg.prediction_rows(preds, rollups.rolling_or(gold))


@query("F09_planning_job")
def f09_job(d: Domain):
    """Forecast, ledger and both schedules in one job: what each depot's plan changes."""
    base = work_dir(d.spark, "planning")
    model, _ = demand_model(d)
    shares = d.depots.select("depot", share_from_percent(F.col("target_or"), 0.75).alias("target_share"))
    gold = d.written("gold")
    services = materialise(d.services, "services")  # read several times; of the service days only the last are, so these aren't written whole
    trips, slots = jobs.plan_next(
        model, gold, d.lunar, d.holidays, d.written("weather"), f"{base}/ledger", services, d.service_daily, shares, "2001-11-05", f"{base}/schedules")
    summary = supply.trip_summary(trips).join(supply.slot_summary(slots).select("depot", "total_services", "total_allocated_pkm"), "depot", "full")
    ledger = snapshots.read(d.spark, f"{base}/ledger", snapshots.schema(d.spark, f"{base}/ledger"))
    return ledger.select("depot", "prediction_date", "predicted_passenger_kms", "status").join(summary, "depot", "left")


@query("F11_passengers_2day")
def f11(d: Domain):
    history = materialise(d.daily.select("depot", "date", "passengers_per_day"), "history")
    path = saved(d, "passengers", lambda to: fc.train_passengers(history, PASSENGERS).save(to))
    raw = fc.passengers_2day(history, boosting.load(d.spark, path))
    store = d.depots.select("depot", F.lit(None).cast("double").alias("stored_today"), F.lit(None).cast("double").alias("stored_tomorrow"))
    return lg.blend(raw, store)


@query("F14_absence_7day")
def f14(d: Domain):
    kinds = dict(zip(fc.ABSENCE_TARGETS, "LSA", strict=True))
    sheet = materialise(d.absences.groupBy("depot", "date").agg(*[F.count_if(F.col("leave_type") == k).cast("double").alias(t) for t, k in kinds.items()]), "sheet")
    calendar = d.holidays.select("date", "fes_hol_code", "fes_hol_category")
    path = saved(d, "absence", lambda to: fc.train_absence(sheet, calendar, settings=ABSENCE).save(to))
    return fc.absence_ahead(sheet, calendar, boosting.load(d.spark, path), 7)


def duty_table(d: Domain):
    steering = d.written("counted_steering")  # before the operations, whose drivers are written with it
    duties = rollups.dedupe_duties(joins.with_steering(d.operations, steering)).drop("hours_source")  # which no model reads
    duties = duties.hint("rebalance", "employee_id")  # a driver's duties stand together: they combine before they are dealt
    return fc.duty_rows(materialise(duties, "deduped"), d.health)  # read for the averages of drivers and depots, and by the rows


def duty_model(d: Domain):
    """(rows, model of km and hours, scored rest)."""

    def fit(path):
        duty_table(d).write.parquet(f"{path}/rows")
        model, scored = fc.train_duties(d.spark.read.parquet(f"{path}/rows"), DUTIES)
        model.save(f"{path}/model")
        scored.write.parquet(f"{path}/scored")

    path = saved(d, "duties", fit)
    return d.spark.read.parquet(f"{path}/rows"), boosting.load(d.spark, f"{path}/model"), d.spark.read.parquet(f"{path}/scored")


@query("F15_km_hours_grid")
def f15(d: Domain):
    rows, model, _ = duty_model(d)
    return fc.km_hours_grid(rows, model, "2001-12-01", 6)


@query("F15_km_hours_metrics")
def f15b(d: Domain):
    scored = duty_model(d)[2]
    km = lg.metrics(scored.withColumn("target", F.lit("km")), "opd_kms", "pred_opd_kms", ["target"])
    return km.unionByName(lg.metrics(scored.withColumn("target", F.lit("hours")), "steering_hours", "pred_steering_hours", ["target"]))


# ---- retrieval ---------------------------------------------------------------------------
STEPS["centroid_parts"] = """
    SELECT label AS query_id, i, avg(x) AS x FROM (
        SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2"""
STEPS["centroid"] = "SELECT query_id, list(x ORDER BY i) AS v FROM centroid_parts GROUP BY 1"
STEPS["dots"] = """
    SELECT query_id, vec_id AS doc_id, label, list_inner_product(embedding::DOUBLE[], v) AS score,
           list_cosine_similarity(embedding::DOUBLE[], v) AS cosine FROM embeddings, centroid"""


def vectors(d: Domain):
    return d.raw("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), F.col("label").cast("bigint").alias("tag"))


def centroid_queries(d: Domain):
    """One query per label: the mean of its vectors."""
    return retrieval.centroids(vectors(d), "tag").withColumn("tag", F.col("query_id"))


def _topk(score: str, where: str = "", after: str = "") -> str:
    return (f"SELECT query_id, doc_id, score, place FROM (SELECT query_id, doc_id, label, {score} AS score, row_number() OVER "
            f"(PARTITION BY query_id ORDER BY {score} DESC, doc_id) AS place FROM dots {where}) WHERE place <= 20 {after}")


@query("T07_vector_topk", _topk("score"), "score")
def t07(d: Domain):
    return retrieval.vector_topk(vectors(d), centroid_queries(d), 20)


@query("T07_filter_after", _topk("score", after="AND label = query_id"), "score")
def t07b(d: Domain):
    return retrieval.vector_topk(vectors(d), centroid_queries(d), 20, filter_mode="post")


@query("T07_filter_before", _topk("score", where="WHERE label = query_id"), "score")
def t07c(d: Domain):
    return retrieval.vector_topk(vectors(d), centroid_queries(d), 20, filter_mode="pre")


@query("D03_cosine_topk", _topk("cosine"), "score")
def d03(d: Domain):
    return retrieval.vector_topk(vectors(d), centroid_queries(d), 20, cosine=True)


@query("D02_text_vectors", """
    SELECT doc_id, 256 AS dims, CASE WHEN regexp_matches(lower(text), '[a-z0-9_]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS squared_length FROM documents""")
def d02(d: Domain):
    vecs = retrieval.embed(d.raw("documents").select("doc_id", "text"))
    return vecs.select("doc_id", F.size("vector").alias("dims"),
                       F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 6).alias("squared_length"))


@query("D02_nearest_to_source")
def d02b(d: Domain):
    docs = d.raw("documents")
    vecs = retrieval.embed(docs.select("doc_id", "text"))
    by_lang = vecs.join(docs.select("doc_id", F.xxhash64("lang").alias("tag")), "doc_id")
    return retrieval.vector_topk(vecs, retrieval.centroids(by_lang, "tag"), 10, cosine=True)
