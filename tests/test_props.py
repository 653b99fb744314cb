"""Properties and brute-force comparisons on random small inputs."""

import datetime as dt
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from depotlens.operators import features as ft
from depotlens.operators import quantiles, reshape, supply

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def greedy(services, need, per_route, per_depot):
    """Step by step: skip a full route, stop when the need is met or the cap is reached."""
    taken, used = [], {}
    for number, route, gain in services:
        if need <= 0 or len(taken) >= per_depot:
            break
        if used.get(route, 0) >= per_route:
            continue
        taken.append(number)
        used[route] = used.get(route, 0) + 1
        need -= gain
    return taken


service = st.tuples(st.sampled_from("rst"), st.integers(1, 9))


@FEW
@given(st.lists(st.tuples(st.lists(service, min_size=1, max_size=12), st.integers(0, 40)), min_size=1, max_size=20))
def test_capped_allocation_equals_greedy(spark, depots):
    flat, want = [], set()
    for i, (services, need) in enumerate(depots):
        listed = sorted(((f"{n:03d}", r, float(g)) for n, (r, g) in enumerate(services)), key=lambda s: (s[2], s[0]))
        want |= {(f"d{i}", n) for n in greedy(listed, need, 2, 4)}
        flat += [(f"d{i}", n, r, g, float(need)) for n, r, g in listed]
    df = spark.createDataFrame(flat, "depot string, service_number string, route string, gain double, need double")
    got = supply.capped_allocation(df, [F.asc("gain"), F.asc("service_number")], "gain", "need", 2, 4)
    assert {(r.depot, r.service_number) for r in got.collect()} == want


@FEW
@given(st.lists(st.lists(st.booleans(), min_size=1, max_size=45), min_size=1, max_size=12))
def test_festival_features_equal_a_scan(spark, calendars):
    rows, want = [], {}
    for i, flags in enumerate(calendars):
        for j, f in enumerate(flags):
            rows.append((f"d{i}", dt.date(2024, 1, 1) + dt.timedelta(days=j), int(f), j % 3 + 1 if f else 0))
            ahead = [k for k in range(j, len(flags)) if flags[k]]
            back = [k for k in range(j + 1) if flags[k]]

            def run(k):
                lo = hi = k
                while lo > 0 and flags[lo - 1]:
                    lo -= 1
                while hi + 1 < len(flags) and flags[hi + 1]:
                    hi += 1
                return hi - lo + 1

            gap = j - back[-1] if back else None
            want[(f"d{i}", j)] = (
                min(ahead[0] - j, 30) if ahead else 30, min(gap, 30) if back else 30, ahead[0] % 3 + 1 if ahead else 0,
                run(back[-1]) if back and gap <= 4 else 0, run(ahead[0]) if ahead else 0, gap if back and gap <= 4 else -1)
    df = spark.createDataFrame(rows, "depot string, date date, is_fes_hol int, fes_hol_code int")
    out = ft.festival_calendar(df.withColumn("is_weekend", F.lit(0)))
    got = {(r.depot, (r.date - dt.date(2024, 1, 1)).days): (
        r.days_to_next_festival, r.days_since_last_festival, r.next_fes_hol_code, r.festival_cluster_len, r.next_festival_cluster_len,
        r.post_festival_days) for r in out.collect()}
    assert got == want


@FEW
@given(st.dictionaries(st.integers(0, 30), st.integers(0, 9), max_size=20), st.dictionaries(st.integers(0, 30), st.integers(0, 9), max_size=20))
def test_upsert_is_idempotent_and_counts_add_up(spark, old, new):
    schema = "k int, v int"
    master, inbound = spark.createDataFrame(list(old.items()), schema), spark.createDataFrame(list(new.items()), schema)
    once = reshape.upsert(master, inbound, ["k"])
    assert {r.k: r.v for r in once.collect()} == {**old, **new}
    assert sorted(map(tuple, reshape.upsert(once, inbound, ["k"]).collect())) == sorted(map(tuple, once.collect()))
    counts = reshape.upsert_counts(master, inbound, ["k"]).collect()[0]
    assert counts.inserted + counts.corrected == len(new) and counts.corrected == len(set(old) & set(new))


@FEW
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=400))
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = quantiles.exact_quantiles(df, [], "v", [0.25, 0.5], ["q", "m"], stage=False).collect()[0]
    ordered = sorted(values)
    pos = 0.25 * (len(ordered) - 1)
    low = int(pos)
    q = ordered[low] + (ordered[min(low + 1, len(ordered) - 1)] - ordered[low]) * (pos - low)
    assert abs(got.m - statistics.median(values)) < 1e-6 and abs(got.q - q) < 1e-6


@FEW
@given(st.lists(st.floats(0, 1000), min_size=2, max_size=40))
def test_ewm_equals_recurrence(spark, values):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)],
                               "depot string, date date, y double")
    got = [r.ewm_7 for r in ft.ewm(df, "y").orderBy("date").collect()]
    total = weight = 0.0
    want = [None]
    for v in values[:-1]:
        total, weight = total * 0.75 + v, weight * 0.75 + 1.0
        want.append(total / weight)
    assert got[0] is None and all(abs(a - b) < 1e-6 for a, b in zip(got[1:], want[1:]))


@FEW
@given(st.lists(st.tuples(st.sampled_from("ab"), st.floats(0, 100)), min_size=1, max_size=30))
def test_shares_sum_to_one(spark, rows):
    df = spark.createDataFrame([(g, float(v)) for g, v in rows], "g string, v double")
    sums = {r.g: r.s for r in ft.share(df, "g", "v").groupBy("g").agg(F.sum("share").alias("s")).collect()}
    for g, s in sums.items():
        total = sum(v for k, v in rows if k == g)
        assert abs(s - (1.0 if total else 0.0)) < 1e-9


def test_running_median_is_that_of_all_earlier_values(spark):
    import random
    import time

    rng = random.Random(12)
    rows = [(depot, dt.date(2020, 1, 1) + dt.timedelta(days=k), rng.choice([None, float(rng.randint(0, 20)), rng.random()]), rng.choice("xyz"), rng.random() < 0.7)
            for depot in ("A", "B") for k in range(300)]
    df = spark.createDataFrame(rows, "depot string, date date, v double, code string, inside boolean").repartition(5)
    got = {(r.depot, r.date): r.m for r in ft.running_medians(df, m=(F.col("v"), F.col("code"), F.col("inside"))).collect()}
    for depot, day, _, code, inside in rows:
        past = [v for d, t, v, c, i in rows if d == depot and c == code and i and t < day and v is not None]
        want = statistics.median(past) if inside and past else None
        assert got[depot, day] == (pytest.approx(want) if want is not None else None)

    def seconds(n):
        own, start = ft.RunningMedian(), time.process_time()
        for _ in range(n):
            own.add(rng.random())
            own.value()
        return time.process_time() - start

    assert seconds(200_000) < 40 * max(seconds(10_000), 0.002)  # n log n; a sorted frame for each row would be 400 times as much
