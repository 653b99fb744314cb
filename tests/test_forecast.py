"""Model jobs run end to end on small data, with the production sizes of their models."""

import datetime as dt
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from depotlens.operators import boosting as bt
from depotlens.operators import joins
from depotlens.operators import forecast as fc
from depotlens.plans import QUERIES, catalog_forecast
from depotlens.plans.catalog_forecast import Domain


@pytest.mark.parametrize("name", ["F05_train_demand", "F06_demand_against_naive", "F16_model_registry", "F09_planning_job", "F11_passengers_2day", "F14_absence_7day", "F15_km_hours_metrics", "F15_km_hours_grid"])
def test_model_queries(spark, folder, name):
    got = QUERIES[name].run(spark, folder).collect()
    assert got
    if name == "F06_demand_against_naive":
        assert sum(r.n * r.rmse ** 2 for r in got) < sum(r.n * r.naive_rmse ** 2 for r in got)
    if name == "F09_planning_job":
        assert all(r.status == "pending" and r.total_services > 0 and r.total_allocated_pkm == pytest.approx(r.predicted_passenger_kms) for r in got)
    if name == "F16_model_registry":
        assert got[0].rmse == pytest.approx(got[0].reloaded_rmse)
        assert got[0].rounds_grown == min(got[0].rounds + catalog_forecast.DEMAND.patience, catalog_forecast.DEMAND.trees)
    if name == "F14_absence_7day":
        per_depot = {}
        for r in got:
            if r.total is not None:
                assert min(r.Leave_Absent, r.Sick_Leave, r.Spot_Absent) >= 0 and r.total == r.Leave_Absent + r.Sick_Leave + r.Spot_Absent
            per_depot[r.depot] = per_depot.get(r.depot, 0) + 1
        assert set(per_depot.values()) == {7}
    if name == "F11_passengers_2day":
        assert all(r.today * 0.8 - 1e-6 <= r.tomorrow <= r.today * 1.2 + 1e-6 for r in got)


@pytest.mark.parametrize("kind", ["passengers", "absence"])
def test_a_model_per_depot_beats_the_value_a_week_ago(spark, folder, kind):
    """Production sizes, on days the models haven't seen."""
    d = Domain(spark, folder)
    if kind == "passengers":
        rows = fc.passenger_features(d.daily.select("depot", "date", "passengers_per_day")).withColumn("_y", F.log1p("passengers_per_day"))
        inputs, settings, label, naive = {"_y": fc.PASSENGER_INPUTS}, catalog_forecast.PASSENGERS, "_y", F.log1p("lag_7")
    else:
        kinds = zip(fc.ABSENCE_TARGETS, "LSA", strict=True)
        sheet = d.absences.groupBy("depot", "date").agg(*[F.count_if(F.col("leave_type") == k).cast("double").alias(t) for t, k in kinds])
        rows = fc.absence_features(sheet, d.holidays.select("date", "fes_hol_code", "fes_hol_category"))
        inputs, settings, label, naive = {"Leave_Absent": fc.absence_inputs("Leave_Absent")}, catalog_forecast.ABSENCE, "Leave_Absent", F.col("Leave_Absent_lag_7")
    rows = fc.materialise(fc.lg.time_split(rows.withColumn("naive", naive), 60), "rows")
    model = fc.fit_each(rows.filter("is_test = 0"), ["depot"], inputs, settings, 60)
    kept = model.table.filter("round > 0").groupBy("depot").count().collect()
    assert kept and {r["count"] for r in kept} == {settings.trees}
    full = rows.filter("is_test = 1").na.drop(subset=inputs[label])
    scored = fc.against_naive(fc.predict(model, full, "predicted"), label, "predicted", "naive", []).first()
    assert scored.n > 50 and scored.rmse < scored.naive_rmse


def test_split_does_not_depend_on_partitioning(spark):
    from depotlens.operators.ledger import hash_split

    df = spark.range(1000)
    a = {r.id for r in hash_split(df, ["id"]).filter("is_test = 1").collect()}
    b = {r.id for r in hash_split(df.repartition(7), ["id"]).filter("is_test = 1").collect()}
    assert a == b and 120 < len(a) < 280


# ---- boosting ------------------------------------------------------------------------
def plain_tree(x, y, w, depth, settings):
    """Predictions of one greedy tree, every cut of every column tried."""
    out = np.full(len(y), settings.step * (w * y).sum() / (w.sum() + settings.ridge))
    if not depth:
        return out
    score = lambda at: (w[at] * y[at]).sum() ** 2 / (w[at].sum() + settings.ridge)
    best = (1e-9, None)
    for j in range(x.shape[1]):
        for c in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= c
            if min(w[left].sum(), w[~left].sum()) >= settings.min_rows:
                gain = score(left) + score(~left) - score(np.ones(len(y), bool))
                if gain > best[0] + 1e-12:
                    best = (gain, left)
    if best[1] is not None:
        for side in (best[1], ~best[1]):
            out[side] = plain_tree(x[side], y[side], w[side], depth - 1, settings)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_trees_are_the_greedy_ones(seed):
    rng = np.random.default_rng(seed)
    x, y, w = rng.integers(0, 9, (60, 3)), rng.normal(size=60), rng.integers(1, 4, 60).astype(float)
    settings = bt.TreeSettings(trees=4, depth=3, step=0.4, subsample=1.0, min_rows=3)
    grown = bt.grow(x.astype(np.uint8), y, w, [9] * 3, settings)
    total = np.full(60, (w * y).sum() / w.sum())
    for _ in range(4):
        total = total + plain_tree(x, y - total, w, 3, settings)
    rows = bt.tree_rows("y", grown, [np.arange(8.0)] * 3)
    assert bt.scores(x.astype(float), rows) == pytest.approx(total)


def test_holdout_chooses_the_round():
    rng = np.random.default_rng(3)
    x = rng.random((400, 1))
    y, held = 10 * x[:, 0] + rng.normal(0, 0.3, 400), np.arange(400) % 4 == 0
    cuts = [np.arange(1, 20) / 20]
    settings = bt.TreeSettings(trees=300, depth=2, step=0.03, patience=4)
    grown = bt.grow(bt.binned(x, cuts), y, np.ones(400), [20], settings, held)
    best = int(np.argmin(grown.errors))
    assert 30 < len(grown.trees) == best + 1 and len(grown.errors) in (best + 1 + 4, 300)
    found = bt.scores(x, bt.tree_rows("y", grown, cuts))
    assert np.mean((found - y)[held] ** 2) == pytest.approx(grown.errors[best])


def test_pooled_fit(spark):
    """Rows combined before, gaps filled, labels with gaps; a bounded share of the distinct rows gives nearly the same."""
    rng = random.Random(4)
    rows = [(rng.randint(0, 20), rng.choice([None, 1.0, 2.0, 3.0]), rng.random(), i % 5 == 0) for i in range(600)]
    rows = [(a, b, 3.0 * a + (b or 2.0) ** 2 + c, c if i % 7 else None, h) for i, (a, b, c, h) in enumerate(rows)]
    df = spark.createDataFrame(rows, "a int, b double, y double, z double, h boolean")
    settings = bt.TreeSettings(trees=12, depth=3, step=0.3, subsample=1.0, patience=20)
    models = [bt.fit(df, ["a", "b"], ["y", "z"], s, holdout="h") for s in (settings, replace(settings, most_rows=60))]
    found = [sorted((r.a, r.b or 0, r.y, r.pred_y, r.pred_z) for r in bt.predict(m, df.select("a", "b", "y")).collect()) for m in models]
    assert [np.mean([(f[2] - f[3]) ** 2 for f in own]) < limit for own, limit in zip(found, (1.0, 20.0), strict=True)] == [True, True]
    assert dict((r[0], r[1]) for r in models[0].rounds) == {"y": 12, "z": 12}
    share = {(r.label, r.feature): r.importance for r in bt.importances(models[0]).collect()}
    assert share["y", "a"] > 0.9 and sum(v for k, v in share.items() if k[0] == "y") == pytest.approx(1)


def test_model_saved_and_loaded(spark, tmp_path):
    df = spark.createDataFrame([(k % 3, float(k), float(k * k % 17)) for k in range(90)], "g int, x double, y double")
    settings = bt.TreeSettings(trees=5, depth=2, step=0.3)
    for model in (bt.fit(df, ["x"], ["y"], settings), bt.fit_each(df, ["g"], {"y": ["x"]}, settings, 30)):
        path = str(tmp_path / f"model{len(model.keys)}")
        model.save(path)
        again = bt.load(spark, path)
        assert (again.inputs, again.medians, again.keys, again.rounds) == (model.inputs, model.medians, model.keys, model.rounds)
        a, b = (sorted(tuple(r) for r in bt.predict(m, df, "p").collect()) for m in (model, again))
        assert a == b and len(a) == 90


def test_small_groups_have_no_model(spark):
    df = spark.createDataFrame([("a", float(k), 1.0 if k % 5 else None, float(k)) for k in range(80)] + [("b", 1.0, 2.0, 3.0)] * 10, "g string, x double, v double, y double")
    model = bt.fit_each(df, ["g"], {"y": ["x", "v"]}, bt.TreeSettings(trees=3, depth=2), 60)
    assert [r.g for r in model.table.select("g").distinct().collect()] == ["a"]
    got = {r.g: r.p for r in bt.predict(model, df.filter("x = 1 AND v IS NOT NULL"), "p").collect()}
    assert got["a"] is not None and got["b"] is None


# ---- rolled states -------------------------------------------------------------------
def day_series(n, seed, gaps=0.0):
    rng = random.Random(seed)
    return [(depot, dt.date(2024, 1, 1) + dt.timedelta(days=k), None if rng.random() < gaps else float(rng.randint(5, 90))) for depot in ("A", "B") for k in range(n if depot == "A" else n // 5)]


@pytest.mark.parametrize("days, gaps", [(120, 0.0), (90, 0.2), (12, 0.0)])
def test_passenger_state_equals_the_whole_history(spark, days, gaps):
    rows = day_series(days, days, gaps)
    df = spark.createDataFrame(rows, "depot string, date date, passengers_per_day double")
    state = fc.passenger_state(df)
    longer = df
    for value in (33.0, 41.5):
        got = {r.depot: r for r in fc.next_passengers(state).collect()}
        ahead = longer.groupBy("depot").agg(F.date_add(F.max("date"), 1).alias("date"))
        full = fc.passenger_features(longer.unionByName(ahead, allowMissingColumns=True)).join(ahead, ["depot", "date"], "left_semi").collect()
        for r in full:
            for c in fc.PASSENGER_INPUTS:
                want = None if gaps and c.startswith("roll") and r[c] is None else r[c]
                assert got[r.depot][c] == (pytest.approx(want, rel=1e-9, abs=1e-9) if want is not None else None) or (gaps and c == "roll_std_7"), (r.depot, c)
        longer = longer.unionByName(ahead.withColumn("passengers_per_day", F.lit(value)))
        state = fc.advance(fc.next_passengers(state), F.lit(value))


def test_absence_state_equals_the_whole_history(spark):
    rng = random.Random(8)
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(days=k), float(rng.randint(0, 9)), float(rng.randint(0, 9)), None if k % 9 == 0 else 1.0) for k in range(60)]
    rows += [("B", dt.date(2024, 5, 1), 1.0, 2.0, 3.0)]
    sheet = spark.createDataFrame(rows, "depot string, date date, Leave_Absent double, Sick_Leave double, Spot_Absent double")
    holidays = spark.createDataFrame([(dt.date(2024, 3, 1), 7, "MAJOR"), (dt.date(2024, 5, 2), 3, "STATE")], "date date, fes_hol_code int, fes_hol_category string")
    ahead = sheet.groupBy("depot").agg(F.date_add(F.max("date"), 1).alias("date"))
    want = {r.depot: r for r in fc.absence_features(sheet.unionByName(ahead, allowMissingColumns=True), holidays).join(ahead, ["depot", "date"], "left_semi").collect()}
    got = {r.depot: r for r in fc.next_absence(fc.absence_state(sheet), holidays).collect()}
    inputs = {c for t in fc.ABSENCE_TARGETS for c in fc.absence_inputs(t)}
    assert set(got) == {"A", "B"}
    for depot, r in got.items():
        assert {c: r[c] for c in inputs} == pytest.approx({c: want[depot][c] for c in inputs})


def test_duties_are_combined_once(spark, folder):
    """Averages of drivers and of depots and the rows themselves read duties that are written, not the facts again."""
    plan = catalog_forecast.duty_table(Domain(spark, folder))._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan and "l_shipdate" not in plan


def test_trees_of_a_sample_score_as_their_rows_did():
    """Sums over nodes and bins, against loops over rows; scores against a walk down each tree."""
    rng = np.random.default_rng(5)
    widths, settings = [4, 9, 3], bt.TreeSettings(trees=6, depth=3, step=0.3, min_rows=2, subsample=1.0)
    bins = np.stack([rng.integers(0, w, 300) for w in widths], 1).astype(np.uint8)
    y, weight = bins[:, 1] + rng.normal(size=300), rng.integers(1, 5, 300).astype(float)
    grown = bt.grow(bins, y, weight, widths, settings)
    total = np.full(300, grown.base)
    for feature, cut, value, _ in grown.trees:
        ends = np.zeros(300, int)
        for i, row in enumerate(bins):
            at = 0
            while at < 7 and feature[at] >= 0:
                at = 2 * at + 1 + (row[feature[at]] > cut[at])
            ends[i] = at
        for node in set(ends.tolist()):
            own = ends == node
            assert value[node] == pytest.approx(settings.step * (weight[own] * (y - total)[own]).sum() / (weight[own].sum() + settings.ridge))
        total += value[ends]
    cuts = [np.arange(w - 1) + 0.0 for w in widths]
    assert bt.scores(bins.astype(float), bt.tree_rows("y", grown, cuts), block=70) == pytest.approx(total)


@pytest.mark.parametrize("within, processes", [([0, 1], 1), ([0, 1], 3), ([1], 2), ([], 2)])
def test_a_grid_grows_the_trees_of_its_rows(within, processes):
    """Lines against places, with empty cells, a hold-out and blocks in other processes: the same trees and errors."""
    rng = np.random.default_rng(7)
    places = np.unique(rng.integers(0, 9, (150, 3)), axis=0)
    bins = np.array([(a, b, *p) for a in range(6) for b in range(5) for p in places if rng.random() < 0.8], np.uint8)
    n, widths, settings = len(bins), [6, 5, 9, 9, 9], bt.TreeSettings(trees=30, depth=4, step=0.2, subsample=1.0, patience=30)
    y, weight, held = bins[:, 2] + np.sin(bins[:, 0]) * bins[:, 3] + rng.normal(size=n), rng.integers(1, 5, n).astype(float), rng.random(n) < 0.2
    grid = bt.lay_out(bins, within, held)
    assert len(grid.lines) == {2: 30, 1: 5, 0: 1}[len(within)]
    rows, cells = bt.grow(bins, y, weight, widths, settings, held, 3.0), bt.grow_grid(grid, weight * y, weight, widths, settings, 3.0, processes)
    assert cells.errors == pytest.approx(rows.errors, rel=1e-9) and len(cells.trees) == len(rows.trees)
    cuts = [np.arange(w - 1) + 0.0 for w in widths]
    a, b = (bt.scores(bins.astype(float), bt.tree_rows("y", grown, cuts)) for grown in (rows, cells))
    assert a == pytest.approx(b, rel=1e-9)


def test_samples_of_a_grid_do_not_depend_on_the_processes():
    rng = np.random.default_rng(9)
    bins = np.array([(a, b) for a in range(12) for b in range(40)], np.uint8)
    y, settings = rng.normal(size=480) + bins[:, 1], bt.TreeSettings(trees=20, depth=3, step=0.2)
    found = [bt.grow_grid(bt.lay_out(bins, [0]), y, np.ones(480), [12, 40], settings, processes=p) for p in (1, 4)]
    for a, b in zip(found[0].trees, found[1].trees, strict=True):
        assert all(np.array_equal(x, z) for x, z in zip(a, b, strict=True))


def test_every_distinct_row_grows_a_pooled_model(spark):
    """Beyond ``most_rows`` too: the model is that of all rows, not of a part of them."""
    rng = random.Random(5)
    rows = [(rng.randint(0, 40), rng.randint(0, 30), rng.random(), k % 6 == 0) for k in range(3000)]
    df = spark.createDataFrame([(a, b, a * (b % 4) + c, c if a % 5 else None, h) for a, b, c, h in rows], "a int, b int, y double, z double, h boolean")
    settings = bt.TreeSettings(trees=15, depth=4, step=0.3, subsample=1.0, patience=20)
    for within, holdout in (([], None), (["a"], "h")):
        models = [bt.fit(df, ["a", "b"], ["y", "z"], s, holdout, within) for s in (settings, replace(settings, most_rows=100))]
        found = [sorted(bt.predict(m, df.select("a", "b")).distinct().toPandas().itertuples(index=False, name=None)) for m in models]
        assert models[0].rounds == models[1].rounds
        assert np.array(found[1]) == pytest.approx(np.array(found[0]), rel=1e-9)


def test_duties_grow_from_all_their_rows(spark):
    """The model of more distinct rows than ``most_rows`` is that of all of them."""
    settings = bt.TreeSettings(trees=2, depth=2, subsample=1.0, most_rows=10)
    days = [(e, f"D{e % 3}", dt.date(2024, 1, 1) + dt.timedelta(days=k), str(k), float(e + k % 9), 4.0 + e % 4, e % 5, float(e), float(e % 4)) for e in range(12) for k in range(60)]
    rows = spark.createDataFrame(days, "employee_id int, depot string, operations_date date, service_number string, opd_kms double, steering_hours double, grade_code int, emp_avg_km double, emp_avg_hours double")
    rows = rows.withColumns({"month": F.month("operations_date"), "dow": F.weekday("operations_date"), "depot_avg_km": F.lit(1.0), "depot_avg_hours": F.lit(2.0)})
    want = {}
    for most in (10, 1_000_000):
        model, scored = fc.train_duties(rows, replace(settings, most_rows=most))
        want[most] = sorted((r.employee_id, r.opd_kms, round(r.pred_opd_kms, 9), round(r.pred_steering_hours, 9)) for r in scored.collect())
    assert want[10] == want[1_000_000] and len(want[10]) > 50


def test_demand_grows_from_all_its_rows(spark):
    """More distinct depot days than ``most_rows``, with a hold-out: the model is that of all of them."""
    settings = bt.TreeSettings(trees=2, depth=2, subsample=1.0, most_rows=10)
    series = [(f"D{d}", dt.date(2024, 1, 1) + dt.timedelta(days=k), 1.0, float(d * 10 + k % 7), float(k % 7), k % 7) for d in range(4) for k in range(80)]
    feats = spark.createDataFrame(series, "depot string, date date, actual_kms double, passenger_kms double, pkm_lag_7 double, weekday int")
    found = [sorted((r.depot, r.date, round(r.predicted, 9)) for r in fc.train_demand(feats, 20, replace(settings, most_rows=most))[1].collect()) for most in (10, 1_000_000)]
    assert found[0] == found[1] and len(found[0]) == 80


def test_many_rows_are_scored_as_a_grid(spark, monkeypatch):
    """The same values as row by row, whatever stands in the lines, for distinct and repeated rows."""
    rng = random.Random(6)
    drivers = [(rng.random(), rng.randint(0, 9)) for _ in range(40)]
    rows = [(k % 7, rng.randint(0, 4), *drivers[k // 50], rng.random()) for k in range(2000)]
    df = spark.createDataFrame([(*r, r[2] * 3 + r[0] * r[3] + r[4]) for r in rows], "dow int, month int, avg double, grade int, noise double, y double")
    inputs = ["dow", "avg", "month", "grade"]
    model = bt.fit(df, inputs, ["y"], bt.TreeSettings(trees=12, depth=5, step=0.3))
    x, trees = np.array([[r[0], r[2], r[1], r[3]] for r in rows], float), model.table.toPandas().sort_values("round")
    want = bt.scores(x, trees)
    assert all(np.array_equal(bt.grid_scores(x, trees, within), want) for within in ([0, 2], [1], []))
    monkeypatch.setattr(bt, "GRID_ROWS", 1200)
    one = df.coalesce(1)
    found = [sorted(tuple(r) for r in bt.predict(model, one, "p", within).collect()) for within in ([], ["dow", "month"])]
    assert found[0] == found[1] and len(found[0]) == 2000


def test_steering_that_has_its_counts_fills_the_same_hours(spark):
    """Services without a master row, in it twice, without a depot: the median weighs duties as if they were counted from the facts."""
    rng = random.Random(2)
    ops = spark.createDataFrame([(rng.choice(["A", "B", None]), str(rng.randint(0, 9))) for _ in range(200)], "depot string, service_number string")
    master = spark.createDataFrame([(str(k % 7), 4.0 + k % 5, k % 3) for k in range(9)], "service_number string, steering_hours double, no_of_drvs int")
    plain = ops.distinct().join(master, "service_number")
    counted = ops.groupBy("depot", "service_number").agg(F.count("*").alias("duties")).join(master, "service_number")
    found = [sorted(tuple(map(str, r)) for r in joins.with_steering(ops, steering).collect()) for steering in (plain, counted)]
    assert found[0] == found[1] and any("Estimated (Median)" in r for r in found[0])
