"""Time-series and festival features of a depot-day table.

Every function expects one row per (depot, date), so a window partition on depot
holds at most one row per calendar day however large the facts underneath are.
All windows partition by depot or by depot and more, which Spark serves from a
single shuffle on depot.  Frames count rows, so a dense day series is expected.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from depotlens.functions.timeparts import calendar_parts, weather_parts

HORIZON = 2
LAGS = [2, 7, 14, 21]
ROLLING = [(7, 3), (14, 5), (21, 7)]
CAP = 30
REBOUND = 4


def series():
    return Window.partitionBy("depot").orderBy("date")


def so_far():
    return series().rowsBetween(Window.unboundedPreceding, 0)


def ahead_of():
    """From each row to the end, read backwards so the frame only ever grows."""
    return Window.partitionBy("depot").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)


def past(keys: list[str], shift: int):
    """All rows of the keys up to ``shift`` rows ago."""
    return Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, -shift)


def median(col: Column) -> Column:
    return F.percentile(col, F.lit(0.5))


def lags(df: DataFrame, col: str, shifts: list[int] = LAGS, prefix: str = "pkm_lag") -> DataFrame:
    return df.withColumns({f"{prefix}_{k}": F.lag(col, k).over(series()) for k in shifts})


def rolling(df: DataFrame, col: str, windows=ROLLING, horizon: int = HORIZON) -> DataFrame:
    """Means (and the deviation of the shortest) over w rows ending ``horizon`` rows ago."""
    out = {}
    for i, (w, least) in enumerate(windows):
        frame = series().rowsBetween(-(horizon + w - 1), -horizon)
        enough = F.count(col).over(frame) >= least
        out[f"pkm_roll{w}_mean"] = F.when(enough, F.avg(col).over(frame))
        if i == 0:
            out[f"pkm_roll{w}_std"] = F.when(enough, F.stddev_samp(col).over(frame))
    return df.withColumns(out)


def momentum(df: DataFrame, short: int = 7, long: int = 21) -> DataFrame:
    return df.withColumn(f"pkm_momentum_{short}_{long}", F.try_divide(f"pkm_roll{short}_mean", f"pkm_roll{long}_mean"))


def same_dow_median(df: DataFrame, col: str, window: int = 3, least: int = 2, name: str = "pkm_same_dow_3med") -> DataFrame:
    """Median of the last ``window`` rows of the same weekday."""
    frame = Window.partitionBy("depot", "dow").orderBy("date").rowsBetween(-window, -1)
    return df.withColumn(name, F.when(F.count(col).over(frame) >= least, median(F.col(col)).over(frame)))


def dow_deviation(df: DataFrame) -> DataFrame:
    return df.withColumn("pkm_lag2_dow_dev", F.col("pkm_lag_2") - F.col("pkm_same_dow_3med"))


def lag_flag(df: DataFrame, horizon: int = HORIZON) -> DataFrame:
    return df.withColumn(f"lag{horizon}_is_festival", F.lag("is_fes_hol", horizon, 0).over(series()))


def target_encode(df: DataFrame, keys: list[str], col: str, name: str, shift: int = HORIZON, fallback: Column | None = None) -> DataFrame:
    """Mean of the earlier rows of the keys; ``fallback`` where there is none."""
    mean = F.avg(col).over(past(keys, shift))
    return df.withColumn(name, mean if fallback is None else F.coalesce(mean, fallback))


def global_mean(df: DataFrame, col: str) -> Column:
    return df.agg(F.avg(col)).scalar()


# ---- festival features --------------------------------------------------------
def proximity(df: DataFrame, before=(1, 2, 3), after=(1, 2)) -> DataFrame:
    return df.withColumns({
        **{f"fes_hol_minus_{n}": F.lead("is_fes_hol", n, 0).over(series()) for n in before},
        **{f"fes_hol_plus_{n}": F.lag("is_fes_hol", n, 0).over(series()) for n in after},
    })


def _positions(df: DataFrame) -> DataFrame:
    """Row number, and the row and code of the last and next festival."""
    fes = F.col("is_fes_hol") == 1
    return (
        df.withColumn("_rn", F.row_number().over(series()))
        .withColumn("_f", F.when(fes, F.col("_rn")))
        .withColumn("_last", F.last("_f", ignorenulls=True).over(so_far()))
        .withColumns({
            "_next": F.last("_f", ignorenulls=True).over(ahead_of()),
            "_next_code": F.last(F.when(fes, F.col("fes_hol_code")), ignorenulls=True).over(ahead_of()),
        })
    )


def _distance(p: DataFrame, cap: int) -> DataFrame:
    return p.withColumns({
        "days_to_next_festival": F.coalesce(F.least(F.col("_next") - F.col("_rn"), F.lit(cap)), F.lit(cap)),
        "days_since_last_festival": F.coalesce(F.least(F.col("_rn") - F.col("_last"), F.lit(cap)), F.lit(cap)),
        "next_fes_hol_code": F.coalesce("_next_code", F.lit(0)),
    })


def _runs(p: DataFrame, rebound: int) -> DataFrame:
    """Length of each festival run, carried to the rebound rows and back from the next run."""
    fes = F.col("is_fes_hol") == 1
    opens = F.when(fes & (F.lag("is_fes_hol", 1, 0).over(series()) == 0), F.col("_rn"))
    closes = F.when(fes & (F.lead("is_fes_hol", 1, 0).over(series()) == 0), F.col("_rn"))
    marked = p.withColumns({"_open": opens, "_close": closes})
    edged = marked.withColumn("_start", F.last("_open", ignorenulls=True).over(so_far())).withColumn(
        "_end", F.last("_close", ignorenulls=True).over(ahead_of()))
    sized = edged.withColumn("_len", F.when(fes, F.col("_end") - F.col("_start") + 1))
    near = F.col("_rn") - F.col("_last") <= rebound
    return (
        sized.withColumn("_past_len", F.last("_len", ignorenulls=True).over(so_far()))
        .withColumn("_next_len", F.last("_len", ignorenulls=True).over(ahead_of()))
        .withColumns({
            "festival_cluster_len": F.when(near, F.col("_past_len")).otherwise(0),
            "next_festival_cluster_len": F.coalesce("_next_len", F.lit(0)),
        })
        .withColumn("festival_cluster_len", F.coalesce("festival_cluster_len", F.lit(0)))
    )


def _post_days(p: DataFrame, rebound: int) -> DataFrame:
    gap = F.col("_rn") - F.col("_last")
    return p.withColumn("post_festival_days", F.when(gap <= rebound, gap).otherwise(-1))


def _drop_helpers(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def festival_distance(df: DataFrame, cap: int = CAP) -> DataFrame:
    """Rows to the next and since the last festival (capped) and the next festival's code."""
    return _drop_helpers(_distance(_positions(df), cap))


def festival_runs(df: DataFrame, rebound: int = REBOUND) -> DataFrame:
    return _drop_helpers(_runs(_positions(df), rebound))


def post_days(df: DataFrame, rebound: int = REBOUND) -> DataFrame:
    """0 on a festival, 1..rebound after it, else -1."""
    return _drop_helpers(_post_days(_positions(df), rebound))


def festival_flags(df: DataFrame, rebound: int = REBOUND) -> DataFrame:
    """Needs is_weekend and the distance, run and post-day columns."""
    weekend, after, to_next = F.col("is_weekend") == 1, F.col("post_festival_days"), F.col("days_to_next_festival")
    return df.withColumns({
        "post_festival_weekend": (after.isin(1, 2, 3) & weekend).cast("int"),
        "pre_festival_weekend": (weekend & (to_next > 0) & (to_next <= 7) & (F.col("is_fes_hol") == 0)).cast("int"),
        "post_festival_return_workday": (~weekend & (after > 0) & (after <= rebound)).cast("int"),
    }).withColumns({
        "pre_festival_wknd_x_cluster": F.col("pre_festival_weekend") * F.col("next_festival_cluster_len"),
        "post_festival_wknd_x_cluster": F.col("post_festival_weekend") * F.col("festival_cluster_len"),
    })


def festival_calendar(df: DataFrame, cap: int = CAP, rebound: int = REBOUND) -> DataFrame:
    """All row-distance festival features from one pass over the positions."""
    return festival_flags(_drop_helpers(_post_days(_runs(_distance(_positions(df), cap), rebound), rebound)), rebound)


def baseline(df: DataFrame, col: str = "passenger_kms") -> DataFrame:
    return same_dow_median(df, col, 3, 3, "baseline_same_dow")


def _ratio(col: str) -> Column:
    return F.when(F.col("baseline_same_dow") > 0, F.try_divide(F.col(col), F.col("baseline_same_dow")))


class RunningMedian:
    """Median of the values so far: the lower half in one heap, the upper half in another."""

    def __init__(self):
        self.low, self.high = [], []  # low holds negated values and is never the smaller one

    def add(self, x: float) -> None:
        if self.low and x > -self.low[0]:
            heapq.heappush(self.high, x)
        else:
            heapq.heappush(self.low, -x)
        if len(self.low) > len(self.high) + 1:
            heapq.heappush(self.high, -heapq.heappop(self.low))
        elif len(self.high) > len(self.low):
            heapq.heappush(self.low, -heapq.heappop(self.high))

    def value(self) -> float | None:
        if not self.low:
            return None
        return -self.low[0] if len(self.low) > len(self.high) else (self.high[0] - self.low[0]) / 2


def running_medians(df: DataFrame, **specs: tuple[Column, Column, Column]) -> DataFrame:
    """For each name a column: (value, key, inside) gives rows inside the median of the earlier rows inside with their key.

    NULL outside, and where there is none.  A depot's days are one group, in which n days take n log n steps; a frame that
    grows with every row would sort n values n times.
    """
    parts = {c: v for name, (value, key, inside) in specs.items() for c, v in (
        (f"_v_{name}", F.when(inside, value.cast("double"))), (f"_k_{name}", F.when(inside, F.coalesce(key.cast("string"), F.lit("")))))}
    marked = df.withColumns(parts)
    names = list(specs)
    schema = StructType([*df.schema, *(StructField(c, DoubleType()) for c in names)])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("date")
        for name in names:
            seen: dict[str, RunningMedian] = {}
            out = []
            for key, x in zip(rows.column(f"_k_{name}").to_pylist(), rows.column(f"_v_{name}").to_pylist(), strict=True):
                if key is None:
                    out.append(None)
                    continue
                own = seen.setdefault(key, RunningMedian())
                out.append(own.value())
                if x is not None:
                    own.add(x)
            rows = rows.append_column(name, pa.array(out, pa.float64()))
        return rows.select([f.name for f in schema])

    return marked.groupBy("depot").applyInArrow(run, schema)


def _festival_spec() -> tuple[Column, Column, Column]:
    return F.col("festival_intensity"), F.col("fes_hol_code"), F.col("is_fes_hol") == 1


def _expected(df: DataFrame, strict: bool) -> DataFrame:
    """What earlier festivals let expect, from the running medians ``_seen``."""
    if strict:
        out = df.withColumn("_code", F.lit(None).cast("double"))
    else:
        codes = df.filter(F.col("is_fes_hol") == 1).groupBy("fes_hol_code").agg(median(F.col("festival_intensity")).alias("_code"))
        out = df.join(codes, "fes_hol_code", "left")
    out = out.withColumn("expected_intensity", F.coalesce("_seen", "_code", F.lit(1.0)))
    return out.withColumn("expected_festival_demand", F.col("baseline_same_dow") * F.col("expected_intensity")).drop("_seen", "_code")


def _rated(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("festival_intensity", F.when(F.col("is_fes_hol") == 1, _ratio(col)))


def festival_intensity(df: DataFrame, col: str = "passenger_kms", strict: bool = False) -> DataFrame:
    """Demand of a festival relative to its weekday, and what earlier ones let expect.

    The first occurrence in a depot falls back to the median of the code over all
    depots (``strict``: no fallback to it), then to 1.0.
    """
    return _expected(running_medians(_rated(df, col), _seen=_festival_spec()), strict)


def _after(rebound: int) -> Column:
    return F.col("post_festival_days").between(1, rebound)


def _before(before) -> Column:
    return (sum((F.col(f"fes_hol_minus_{n}") for n in before[1:]), F.col(f"fes_hol_minus_{before[0]}")) > 0) & (F.col("is_fes_hol") == 0)


def _phase(df: DataFrame, name: str, inside: Column) -> DataFrame:
    return df.withColumn(name, F.when(inside, F.col(name)).otherwise(F.lit(1.0)))


def post_intensity(df: DataFrame, col: str = "passenger_kms", rebound: int = REBOUND) -> DataFrame:
    """Median of earlier rebound days relative to their weekday; 1.0 on other days, NULL the first time."""
    inside = _after(rebound)
    return _phase(running_medians(df, post_festival_intensity=(_ratio(col), F.lit(""), inside)), "post_festival_intensity", inside)


def pre_intensity(df: DataFrame, col: str = "passenger_kms", before=(1, 2, 3)) -> DataFrame:
    inside = _before(before)
    return _phase(running_medians(df, pre_festival_intensity=(_ratio(col), F.lit(""), inside)), "pre_festival_intensity", inside)


def intensities(df: DataFrame, col: str = "passenger_kms", rebound: int = REBOUND, before=(1, 2, 3)) -> DataFrame:
    """Festival, rebound and pre-festival intensity from one pass over each depot's days."""
    after, ahead = _after(rebound), _before(before)
    seen = running_medians(
        _rated(df, col), _seen=_festival_spec(), post_festival_intensity=(_ratio(col), F.lit(""), after), pre_festival_intensity=(_ratio(col), F.lit(""), ahead))
    return _phase(_phase(_expected(seen, False), "post_festival_intensity", after), "pre_festival_intensity", ahead)


def depot_mean(df: DataFrame, col: str) -> Column:
    return F.avg(col).over(Window.partitionBy("depot"))


def festival_encoding(df: DataFrame, col: str = "passenger_kms") -> DataFrame:
    """Mean of earlier days of the same festival code, and of the same category; else the depot's mean."""
    fes, listed = F.col("is_fes_hol") == 1, ~F.col("fes_hol_category").isin("NONE", "")
    return df.withColumns({
        "depot_festival_te": F.coalesce(F.when(fes, F.avg(col).over(past(["depot", "fes_hol_code"], 1))), depot_mean(df, col)),
        "fes_hol_category_te": F.coalesce(F.when(listed, F.avg(col).over(past(["depot", "fes_hol_category"], 1))), depot_mean(df, col)),
    })


def features(gold: DataFrame, weather: DataFrame, col: str = "passenger_kms") -> DataFrame:
    """The whole feature table as one lazy plan (training and serving share it)."""
    df = gold.withColumns(calendar_parts(F.col("date")))
    if "telugu_thithi" in df.columns:
        # Place among the sorted lunar days, of which there are thirty names at most.
        known = df.select("telugu_thithi").filter("telugu_thithi IS NOT NULL").distinct()
        codes = known.agg(F.array_sort(F.collect_set("telugu_thithi"))).scalar()
        df = df.withColumn("telugu_thithi_encoded", F.nullif(F.array_position(codes, F.col("telugu_thithi")).cast("int") - 1, F.lit(-1)))
    df = df.join(weather.select("depot", "date", "max_temp", "min_temp", "daily_rainfall"), ["depot", "date"], "left")
    df = df.withColumns(weather_parts())
    df = festival_calendar(proximity(df))
    df = festival_encoding(intensities(baseline(df, col), col), col)
    df = lag_flag(dow_deviation(same_dow_median(momentum(rolling(lags(df, col), col)), col)))
    mean = global_mean(gold, col)
    df = target_encode(df, ["depot"], col, "depot_te", fallback=mean)
    df = target_encode(df, ["depot", "dow"], col, "depot_dow_te", fallback=F.col("depot_te"))
    return target_encode(df, ["depot", "month"], col, "depot_month_te", fallback=F.col("depot_te"))


def festival_profiles(feats: DataFrame) -> DataFrame:
    """Median festival intensity per depot and code beside the code's overall median."""
    fes = feats.filter("is_fes_hol = 1")
    overall = fes.groupBy("fes_hol_code").agg(median(F.col("festival_intensity")).alias("overall"))
    own = fes.groupBy("depot", "fes_hol_code").agg(median(F.col("festival_intensity")).alias("own"))
    return own.join(overall, "fes_hol_code")


def phase_profiles(feats: DataFrame) -> DataFrame:
    """(depot, post, pre): median intensity of a depot's rebound days and of the days before its festivals.

    Days on which nothing is known (1.0) don't count; a depot without any has NULL, for which 1.0 stands.
    """
    told = lambda c: median(F.when(F.col(c) != 1.0, F.col(c)))
    return feats.groupBy("depot").agg(told("post_festival_intensity").alias("post"), told("pre_festival_intensity").alias("pre"))


# ---- other series ---------------------------------------------------------------
def ewm(df: DataFrame, col: str, span: int = 7, name: str = "ewm_7") -> DataFrame:
    """Exponentially weighted mean of all earlier rows (weights normalised), whatever the span and length.

    Rows are taken in blocks, within which running sums are scaled by powers that a double can hold; a block starts from the sums
    that the one before it ended with, as whole blocks further back weigh nothing at double precision.
    """
    keep = 1.0 - 2.0 / (span + 1.0)
    size = max(1, int(230 / -math.log(keep))) if keep > 0 else 1
    rows = df.withColumn("_at", F.row_number().over(series()) - 1).withColumns({"_block": F.floor(F.col("_at") / size), "_j": F.col("_at") % size})
    within = Window.partitionBy("depot", "_block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    past = series().rowsBetween(Window.unboundedPreceding, -1)
    power = F.pow(F.lit(max(keep, 1e-300)), F.col("_j"))

    def running(value: Column) -> Column:
        return F.sum(value / power).over(within) * power

    rows = rows.withColumns({"_s": running(F.coalesce(F.col(col).cast("double"), F.lit(0.0))), "_w": running(F.when(F.col(col).isNull(), 0.0).otherwise(1.0))})
    ended = {f"_e{c}": F.coalesce(F.last(F.when(F.col("_j") == size - 1, F.col(f"_{c}")), ignorenulls=True).over(past), F.lit(0.0)) for c in "sw"}
    rows = rows.withColumns(ended)
    whole = F.try_divide(F.col("_s") + F.col("_es") * power * keep, F.nullif(F.col("_w") + F.col("_ew") * power * keep, F.lit(0.0)))
    return rows.withColumn("_m", whole).withColumn(name, F.lag("_m", 1).over(series())).select(*df.columns, name)


def diffs(df: DataFrame, col: str, k: int = 7) -> DataFrame:
    """First difference, and relative change over k rows (missing -> 0)."""
    before = F.lag(col, k).over(series())
    return df.withColumns({
        "diff_1": F.col(col) - F.lag(col, 1).over(series()),
        f"pct_change_{k}": F.coalesce(F.try_divide(F.col(col) - before, before), F.lit(0.0)),
    })


def share(df: DataFrame, group: str, value: str, name: str = "share") -> DataFrame:
    """Share of the group's total.  The total is a combined aggregate joined back,
    so a group with most of the rows is never gathered in one task."""
    total = df.groupBy(group).agg(F.sum(value).alias("_t"))
    return df.join(total, group).withColumn(name, F.coalesce(F.try_divide(F.col(value), F.col("_t")), F.lit(0.0))).drop("_t")
