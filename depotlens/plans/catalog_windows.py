"""Window feature queries (W01-W22) and the full feature table (F01, F03, F08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from depotlens.functions.timeparts import calendar_parts, weather_parts
from depotlens.operators import features as ft
from depotlens.plans.registry import STEPS, query
from depotlens.sources.views import Domain

Y = "passenger_kms"
STEPS["series"] = """
    SELECT depot, date, passenger_kms, is_fes_hol, fes_hol_code, fes_hol_category, isodow(date) - 1 AS dow,
           CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend, month(date) AS month FROM gold"""


def series(d: Domain):
    base = d.gold.select("depot", "date", Y, "is_fes_hol", "fes_hol_code", "fes_hol_category")
    parts = calendar_parts(F.col("date"))
    return base.withColumns({c: parts[c] for c in ("dow", "is_weekend", "month")})


_S = "OVER (PARTITION BY depot ORDER BY date)"


def _frame(lo: str, hi: str, keys: str = "depot") -> str:
    return f"OVER (PARTITION BY {keys} ORDER BY date ROWS BETWEEN {lo} AND {hi})"


@query("W01_lags", "SELECT depot, date, " + ", ".join(f"lag(passenger_kms, {k}) {_S} AS pkm_lag_{k}" for k in ft.LAGS) + " FROM series",
       "pkm_lag_2 pkm_lag_7 pkm_lag_14 pkm_lag_21")
def w01(d: Domain):
    return ft.lags(d.gold.select("depot", "date", Y), Y).drop(Y)


@query("W02_proximity", "SELECT depot, date, " + ", ".join(
    [f"coalesce(lead(is_fes_hol, {k}) {_S}, 0) AS fes_hol_minus_{k}" for k in (1, 2, 3)]
    + [f"coalesce(lag(is_fes_hol, {k}) {_S}, 0) AS fes_hol_plus_{k}" for k in (1, 2)]) + " FROM series")
def w02(d: Domain):
    return ft.proximity(d.gold.select("depot", "date", "is_fes_hol")).drop("is_fes_hol")


_ROLL = ", ".join(
    f"CASE WHEN count(passenger_kms) {_frame(f'{w + 1} PRECEDING', '2 PRECEDING')} >= {m} "
    f"THEN avg(passenger_kms) {_frame(f'{w + 1} PRECEDING', '2 PRECEDING')} END AS pkm_roll{w}_mean" for w, m in ft.ROLLING)
_STD = (f"CASE WHEN count(passenger_kms) {_frame('8 PRECEDING', '2 PRECEDING')} >= 3 "
        f"THEN stddev_samp(passenger_kms) {_frame('8 PRECEDING', '2 PRECEDING')} END AS pkm_roll7_std")
STEPS["rolled"] = f"SELECT depot, date, {_ROLL}, {_STD} FROM series"
_RC = "pkm_roll7_mean pkm_roll14_mean pkm_roll21_mean pkm_roll7_std"


@query("W03_rolling", "SELECT * FROM rolled", _RC)
def w03(d: Domain):
    return ft.rolling(d.gold.select("depot", "date", Y), Y).drop(Y)


@query("W04_momentum", "SELECT depot, date, pkm_roll7_mean / nullif(pkm_roll21_mean, 0) AS pkm_momentum_7_21 FROM rolled", "pkm_momentum_7_21")
def w04(d: Domain):
    return ft.momentum(ft.rolling(d.gold.select("depot", "date", Y), Y)).select("depot", "date", "pkm_momentum_7_21")


_DOWF = _frame("3 PRECEDING", "1 PRECEDING", "depot, dow")
STEPS["dowed"] = f"""
    SELECT *, CASE WHEN count(passenger_kms) {_DOWF} >= 2 THEN median(passenger_kms) {_DOWF} END AS pkm_same_dow_3med,
           CASE WHEN count(passenger_kms) {_DOWF} >= 3 THEN median(passenger_kms) {_DOWF} END AS baseline_same_dow,
           lag(passenger_kms, 2) {_S} AS pkm_lag_2 FROM series"""


@query("W05_same_dow_median", "SELECT depot, date, pkm_same_dow_3med, baseline_same_dow FROM dowed", "pkm_same_dow_3med baseline_same_dow")
def w05(d: Domain):
    return ft.baseline(ft.same_dow_median(series(d), Y)).select("depot", "date", "pkm_same_dow_3med", "baseline_same_dow")


@query("W06_dow_deviation", "SELECT depot, date, pkm_lag_2 - pkm_same_dow_3med AS pkm_lag2_dow_dev FROM dowed", "pkm_lag2_dow_dev")
def w06(d: Domain):
    return ft.dow_deviation(ft.same_dow_median(ft.lags(series(d), Y, [2]), Y)).select("depot", "date", "pkm_lag2_dow_dev")


@query("W07_lag_festival", f"SELECT depot, date, coalesce(lag(is_fes_hol, 2) {_S}, 0) AS lag2_is_festival FROM series")
def w07(d: Domain):
    return ft.lag_flag(d.gold.select("depot", "date", "is_fes_hol")).drop("is_fes_hol")


_ALLMEAN = "(SELECT avg(passenger_kms) FROM series)"


def _past(keys: str, shift: int = 2) -> str:
    return f"avg(passenger_kms) {_frame('UNBOUNDED PRECEDING', f'{shift} PRECEDING', keys)}"


STEPS["encoded"] = f"""
    SELECT *, coalesce({_past('depot')}, {_ALLMEAN}) AS depot_te, {_past('depot, dow')} AS by_dow, {_past('depot, month')} AS by_month,
           {_past('depot, fes_hol_code', 1)} AS by_code, {_past('depot, fes_hol_category', 1)} AS by_cat,
           avg(passenger_kms) OVER (PARTITION BY depot) AS own_mean FROM series"""


@query("W08_depot_encoding", "SELECT depot, date, depot_te FROM encoded", "depot_te")
def w08(d: Domain):
    s = series(d)
    return ft.target_encode(s, ["depot"], Y, "depot_te", fallback=ft.global_mean(s, Y)).select("depot", "date", "depot_te")


@query("W09_dow_encoding", "SELECT depot, date, coalesce(by_dow, depot_te) AS depot_dow_te FROM encoded", "depot_dow_te")
def w09(d: Domain):
    s = series(d)
    s = ft.target_encode(s, ["depot"], Y, "depot_te", fallback=ft.global_mean(s, Y))
    return ft.target_encode(s, ["depot", "dow"], Y, "depot_dow_te", fallback=F.col("depot_te")).select("depot", "date", "depot_dow_te")


@query("W10_month_encoding", "SELECT depot, date, coalesce(by_month, depot_te) AS depot_month_te FROM encoded", "depot_month_te")
def w10(d: Domain):
    s = series(d)
    s = ft.target_encode(s, ["depot"], Y, "depot_te", fallback=ft.global_mean(s, Y))
    return ft.target_encode(s, ["depot", "month"], Y, "depot_month_te", fallback=F.col("depot_te")).select("depot", "date", "depot_month_te")


@query("W11_festival_encoding", """
    SELECT depot, date, coalesce(CASE WHEN is_fes_hol = 1 THEN by_code END, own_mean) AS depot_festival_te FROM encoded""", "depot_festival_te")
def w11(d: Domain):
    return ft.festival_encoding(series(d), Y).select("depot", "date", "depot_festival_te")


@query("W12_category_encoding", """
    SELECT depot, date, coalesce(CASE WHEN fes_hol_category <> 'NONE' THEN by_cat END, own_mean) AS fes_hol_category_te FROM encoded""",
       "fes_hol_category_te")
def w12(d: Domain):
    return ft.festival_encoding(series(d), Y).select("depot", "date", "fes_hol_category_te")


# ---- festival positions ---------------------------------------------------------
STEPS["placed"] = f"""
    SELECT *, row_number() {_S} AS rn, CASE WHEN is_fes_hol = 1 THEN row_number() {_S} END AS f,
           row_number() {_S} - row_number() OVER (PARTITION BY depot, is_fes_hol ORDER BY date) AS island FROM dowed"""
STEPS["sized"] = """
    SELECT *, CASE WHEN is_fes_hol = 1 THEN count(*) OVER (PARTITION BY depot, is_fes_hol, island) END AS len,
           max(f) OVER (PARTITION BY depot ORDER BY date ROWS UNBOUNDED PRECEDING) AS last_f,
           min(f) OVER (PARTITION BY depot ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_f FROM placed"""
STEPS["fest"] = f"""
    SELECT s.*, coalesce(least(next_f - rn, 30), 30) AS days_to_next_festival, coalesce(least(rn - last_f, 30), 30) AS days_since_last_festival,
           coalesce(first_value(CASE WHEN is_fes_hol = 1 THEN fes_hol_code END IGNORE NULLS) {_frame('CURRENT ROW', 'UNBOUNDED FOLLOWING')}, 0) AS next_fes_hol_code,
           CASE WHEN rn - last_f <= 4 THEN last_value(len IGNORE NULLS) {_frame('UNBOUNDED PRECEDING', 'CURRENT ROW')} ELSE 0 END AS festival_cluster_len,
           coalesce(first_value(len IGNORE NULLS) {_frame('CURRENT ROW', 'UNBOUNDED FOLLOWING')}, 0) AS next_festival_cluster_len,
           CASE WHEN rn - last_f <= 4 THEN rn - last_f ELSE -1 END AS post_festival_days FROM sized s"""


@query("W16_festival_distance", "SELECT depot, date, days_to_next_festival, days_since_last_festival, next_fes_hol_code FROM fest")
def w16(d: Domain):
    return ft.festival_distance(series(d)).select("depot", "date", "days_to_next_festival", "days_since_last_festival", "next_fes_hol_code")


@query("W17_festival_runs", "SELECT depot, date, festival_cluster_len, next_festival_cluster_len FROM fest")
def w17(d: Domain):
    return ft.festival_runs(series(d)).select("depot", "date", "festival_cluster_len", "next_festival_cluster_len")


@query("W18_post_days", "SELECT depot, date, post_festival_days FROM fest")
def w18(d: Domain):
    return ft.post_days(series(d)).select("depot", "date", "post_festival_days")


STEPS["flagged"] = """
    SELECT *, CASE WHEN post_festival_days IN (1, 2, 3) AND is_weekend = 1 THEN 1 ELSE 0 END AS post_festival_weekend,
           CASE WHEN is_weekend = 1 AND days_to_next_festival BETWEEN 1 AND 7 AND is_fes_hol = 0 THEN 1 ELSE 0 END AS pre_festival_weekend,
           CASE WHEN is_weekend = 0 AND post_festival_days BETWEEN 1 AND 4 THEN 1 ELSE 0 END AS post_festival_return_workday FROM fest"""


@query("W19_festival_flags", """
    SELECT depot, date, post_festival_weekend, pre_festival_weekend, post_festival_return_workday,
           pre_festival_weekend * next_festival_cluster_len AS pre_festival_wknd_x_cluster,
           post_festival_weekend * festival_cluster_len AS post_festival_wknd_x_cluster FROM flagged""")
def w19(d: Domain):
    return ft.festival_calendar(series(d)).select(
        "depot", "date", "post_festival_weekend", "pre_festival_weekend", "post_festival_return_workday",
        "pre_festival_wknd_x_cluster", "post_festival_wknd_x_cluster")


STEPS["rated"] = f"""
    SELECT *, CASE WHEN baseline_same_dow > 0 THEN passenger_kms / baseline_same_dow END AS ratio,
           CASE WHEN is_fes_hol = 1 AND baseline_same_dow > 0 THEN passenger_kms / baseline_same_dow END AS festival_intensity,
           CASE WHEN is_fes_hol = 0 AND (lead(is_fes_hol, 1) {_S} = 1 OR lead(is_fes_hol, 2) {_S} = 1 OR lead(is_fes_hol, 3) {_S} = 1)
                THEN 1 ELSE 0 END AS is_pre, CASE WHEN post_festival_days BETWEEN 1 AND 4 THEN 1 ELSE 0 END AS is_post FROM fest"""


@query("W13_festival_intensity", f"""
    SELECT depot, date, festival_intensity,
           coalesce(CASE WHEN is_fes_hol = 1 THEN median(festival_intensity) {_frame('UNBOUNDED PRECEDING', '1 PRECEDING', 'depot, fes_hol_code')} END,
                    m, 1.0) AS expected_intensity
    FROM rated r LEFT JOIN (SELECT fes_hol_code AS c, median(festival_intensity) AS m FROM rated WHERE is_fes_hol = 1 GROUP BY 1) x
      ON x.c = r.fes_hol_code""", "festival_intensity expected_intensity")
def w13(d: Domain):
    return ft.festival_intensity(ft.baseline(series(d), Y), Y).select("depot", "date", "festival_intensity", "expected_intensity")


@query("W14_post_intensity", f"""
    SELECT depot, date, CASE WHEN is_post = 1 THEN median(ratio) {_frame('UNBOUNDED PRECEDING', '1 PRECEDING', 'depot, is_post')} ELSE 1 END
           AS post_festival_intensity FROM rated""", "post_festival_intensity")
def w14(d: Domain):
    return ft.post_intensity(ft.post_days(ft.baseline(series(d), Y)), Y).select("depot", "date", "post_festival_intensity")


@query("W15_pre_intensity", f"""
    SELECT depot, date, CASE WHEN is_pre = 1 THEN median(ratio) {_frame('UNBOUNDED PRECEDING', '1 PRECEDING', 'depot, is_pre')} ELSE 1 END
           AS pre_festival_intensity FROM rated""", "pre_festival_intensity")
def w15(d: Domain):
    return ft.pre_intensity(ft.proximity(ft.baseline(series(d), Y)), Y).select("depot", "date", "pre_festival_intensity")


@query("W20_ewm", f"""
    SELECT depot, date, list_reduce([0] || v, lambda a, x: a * 0.75 + x) / ((1 - power(0.75::DOUBLE, len(v))) / 0.25::DOUBLE) AS ewm_7
    FROM (SELECT depot, date, list(passenger_kms) {_frame('UNBOUNDED PRECEDING', '1 PRECEDING')} AS v FROM series)""", "ewm_7", 5)
def w20(d: Domain):
    return ft.ewm(d.gold.select("depot", "date", Y), Y).drop(Y)


@query("W21_diffs", f"""
    SELECT depot, date, passengers_per_day - lag(passengers_per_day) {_S} AS diff_1,
           coalesce((passengers_per_day - lag(passengers_per_day, 7) {_S}) / lag(passengers_per_day, 7) {_S}::DOUBLE, 0) AS pct_change_7
    FROM daily""", "pct_change_7")
def w21(d: Domain):
    return ft.diffs(d.daily.select("depot", "date", "passengers_per_day"), "passengers_per_day").drop("passengers_per_day")


@query("W22_share", """
    SELECT depot, service_number, passenger_kms, coalesce(passenger_kms / nullif(sum(passenger_kms) OVER (PARTITION BY depot), 0), 0) AS weight
    FROM (SELECT depot, service_number, sum(passenger_kms) AS passenger_kms FROM service_daily GROUP BY 1, 2)""", "passenger_kms weight", 7)
def w22(d: Domain):
    per = d.service_daily.groupBy("depot", "service_number").agg(F.sum(Y).alias(Y))
    return ft.share(per, "depot", Y, "weight")


# ---- feature table ----------------------------------------------------------------
@query("F01_features", f"""
    SELECT s.depot, s.date, fest.days_to_next_festival, fest.festival_cluster_len, flagged.pre_festival_weekend,
           max_temp - min_temp AS temp_range, CASE WHEN daily_rainfall > 0 THEN 1 ELSE 0 END AS is_rainy,
           pkm_roll14_mean, fest.pkm_same_dow_3med, fest.pkm_lag_2, depot_te, coalesce(by_dow, depot_te) AS depot_dow_te,
           date_diff('day', DATE '2023-01-01', s.date) AS day_counter
    FROM encoded s JOIN fest ON fest.depot = s.depot AND fest.date = s.date JOIN flagged ON flagged.depot = s.depot AND flagged.date = s.date
    JOIN rolled ON rolled.depot = s.depot AND rolled.date = s.date LEFT JOIN weather w ON w.depot = s.depot AND w.date = s.date""",
       "temp_range pkm_roll14_mean pkm_same_dow_3med pkm_lag_2 depot_te depot_dow_te")
def f01(d: Domain):
    return ft.features(d.written("gold"), d.weather).select(
        "depot", "date", "days_to_next_festival", "festival_cluster_len", "pre_festival_weekend", "temp_range", "is_rainy",
        "pkm_roll14_mean", "pkm_same_dow_3med", "pkm_lag_2", "depot_te", "depot_dow_te", "day_counter")


@query("F08_festival_profiles", """
    SELECT own.depot, own.fes_hol_code, own, overall FROM
        (SELECT depot, fes_hol_code, median(festival_intensity) AS own FROM rated WHERE is_fes_hol = 1 GROUP BY 1, 2) own
    JOIN (SELECT fes_hol_code, median(festival_intensity) AS overall FROM rated WHERE is_fes_hol = 1 GROUP BY 1) a
      ON a.fes_hol_code = own.fes_hol_code""", "own overall")
def f08(d: Domain):
    return ft.festival_profiles(ft.festival_intensity(ft.baseline(series(d), Y), Y))


STEPS["post_rated"] = f"""
    SELECT depot, date, CASE WHEN is_post = 1 THEN median(ratio) {_frame('UNBOUNDED PRECEDING', '1 PRECEDING', 'depot, is_post')} ELSE 1 END AS post FROM rated"""
STEPS["pre_rated"] = f"""
    SELECT depot, date, CASE WHEN is_pre = 1 THEN median(ratio) {_frame('UNBOUNDED PRECEDING', '1 PRECEDING', 'depot, is_pre')} ELSE 1 END AS pre FROM rated"""


@query("F08_phase_profiles", """
    SELECT a.depot, post, pre FROM (SELECT depot, median(post) FILTER (WHERE post <> 1) AS post FROM post_rated GROUP BY 1) a
    JOIN (SELECT depot, median(pre) FILTER (WHERE pre <> 1) AS pre FROM pre_rated GROUP BY 1) b ON b.depot = a.depot""", "post pre")
def f08b(d: Domain):
    rows = ft.proximity(ft.post_days(ft.baseline(series(d), Y)))
    return ft.phase_profiles(ft.pre_intensity(ft.post_intensity(rows, Y), Y))


@query("S12_weather_table", """
    SELECT w.depot, w.date, max_temp, min_temp, daily_rainfall FROM weather w JOIN depots d ON d.depot = w.depot
    WHERE region = 'EUROPE' AND w.date >= DATE '1999-01-01' AND w.date < DATE '2000-01-01'""", "max_temp min_temp")
def s12(d: Domain):
    year = d.weather.filter((F.col("date") >= F.lit("1999-01-01").cast("date")) & (F.col("date") < F.lit("2000-01-01").cast("date")))
    return year.join(d.depots.filter("region = 'EUROPE'").select("depot"), "depot", "left_semi")


def weather_features(df):
    return df.withColumns(weather_parts())
