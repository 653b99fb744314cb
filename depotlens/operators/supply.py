"""Supply scheduling for all depots in one job.

Services are unique on (depot, service_number).  Caps are row_number limits, which
Spark also applies before the shuffle, so a depot with most of the services sends
at most a capped number of rows per task; totals are combined aggregates joined
back.  Nothing gathers a depot's services in one place.

What the master meets (gaps, recent days, changes, slots) is written first: of a written
table Spark knows the size, and sends a small one to the services where they lie.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotlens.functions.timeparts import in_peak
from depotlens.operators.features import share
from depotlens.operators.rollups import mean_daily
from depotlens.session import materialise


# Limits of both policies.
@dataclass(frozen=True)
class TripPolicy:
    target_or: float = 0.75
    tolerance: float = 0.03
    lookback_days: int = 7
    trips_per_change: int = 1
    add_from_or: float = 0.65
    stop_below_or: float = 0.45
    per_route: int = 2
    per_depot: int = 25
    protected: tuple[str, ...] = ()
    km_per_passenger: float = 25.0


@dataclass(frozen=True)
class SlotPolicy:
    lookback_days: int = 15
    add_or: float = 0.90
    add_premium: float = 1.05
    cut_or: float = 0.50
    cut_discount: float = 0.90
    default_cpk: float = 25.0
    quadrant_or: float = 0.70


def lookback(ops: DataFrame, target: str | Column, days: int) -> DataFrame:
    """The ``days`` days before the target, target excluded."""
    end = F.lit(target).cast("date") if isinstance(target, str) else target
    return ops.filter((F.col("date") >= F.date_sub(end, days)) & (F.col("date") < end))


def recent_or(ops: DataFrame, target, days: int) -> DataFrame:
    """Mean occupancy per service.  Rounded to nine places so that the order in which
    a cluster adds the values cannot move a service across a threshold."""
    return lookback(ops, target, days).groupBy("depot", "service_number").agg(
        F.round(F.avg("occupancy_ratio"), 9).alias("recent_or"))


def _per_pkm() -> Column:
    pkm = F.col("passenger_kms")
    return F.when(pkm > 0, F.try_divide(F.col("revenue"), pkm))


def rev_per_pkm(ops: DataFrame, target, days: int) -> DataFrame:
    """Mean of daily revenue per passenger-km."""
    rows = lookback(ops, target, days).filter("passenger_kms > 0")
    return rows.groupBy("depot", "service_number").agg(F.avg(_per_pkm()).alias("rev_per_pkm"))


def service_economics(ops: DataFrame, target, days: int) -> DataFrame:
    """Each service's share of its depot's passenger-km and its revenue per passenger-km, from one grouping."""
    per = lookback(ops, target, days).groupBy("depot", "service_number").agg(
        F.sum("passenger_kms").alias("pkm"), F.avg(_per_pkm()).alias("rev_per_pkm"))
    return share(per, "depot", "pkm", "weight").drop("pkm")


def resolve_forecast(ledger: DataFrame, ops: DataFrame, target: str | None = None, policy: TripPolicy = TripPolicy()) -> DataFrame:
    """Passenger-km forecast per depot for the target (the latest predicted date by default).

    Depots fall back to their historical mean only when the date has no prediction at all.
    """
    day = F.lit(target).cast("date") if target else ledger.agg(F.max("prediction_date")).scalar()
    riders = F.coalesce("predicted_passengers", F.lit(0)) if "predicted_passengers" in ledger.columns else F.lit(0)
    known = ledger.filter(F.col("prediction_date") == day).select("depot", F.coalesce(
        "predicted_passenger_kms", F.col("estimated_kms") * F.col("bus_capacity") * policy.target_or, riders * policy.km_per_passenger).alias("predicted_pkm"))
    past = mean_daily(ops, "passenger_kms", "predicted_pkm").withColumn("_n", known.agg(F.count("*")).scalar()).filter("_n = 0")
    return known.unionByName(past.drop("_n"))


# ---- trips engine ---------------------------------------------------------------
def depot_gap(services: DataFrame, forecast: DataFrame, shares: DataFrame, policy: TripPolicy = TripPolicy()) -> DataFrame:
    """Planned against needed kilometres per depot."""
    planned = services.groupBy("depot").agg(
        F.sum(F.col("planned_trips") * F.col("km_per_trip")).alias("planned_kms"),
        F.avg(F.nullif("avg_seats_per_bus", F.lit(0.0))).alias("seats"),
    )
    both = planned.join(forecast, "depot").join(shares.select("depot", "target_share"), "depot", "left")
    goal = F.greatest(F.coalesce("target_share", F.lit(policy.target_or)), F.lit(1e-6))
    return (
        both.withColumn("target_kms", F.col("predicted_pkm") / goal / F.coalesce("seats", F.lit(45.0)))
        .withColumn("delta_kms", F.col("target_kms") - F.col("planned_kms"))
        .withColumn("tolerance_kms", F.greatest("planned_kms", F.lit(1.0)) * policy.tolerance)
        .withColumn("act", F.abs("delta_kms") > F.col("tolerance_kms"))
        .select("depot", "planned_kms", "target_kms", "delta_kms", "tolerance_kms", "act")
    )


def capped_allocation(df: DataFrame, order: list[Column], gain: str, target: str, per_route: int, total: int) -> DataFrame:
    """Rows taken greedily in order until ``target`` is filled, within a cap per route and per depot.

    A row is taken while the gain of the rows before it is short of the target.
    Taken rows are always a leading run of the route-capped order, so the two caps
    can be applied first and the running sum sees at most ``total`` rows per depot.
    """
    by_route = Window.partitionBy("depot", "route").orderBy(*order)
    by_depot = Window.partitionBy("depot").orderBy(*order)
    routed = df.withColumn("_r", F.row_number().over(by_route)).filter(F.col("_r") <= per_route)
    capped = routed.withColumn("_d", F.row_number().over(by_depot)).filter(F.col("_d") <= total)
    before = F.coalesce(F.sum(gain).over(by_depot.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return capped.withColumn("_before", before).filter(F.col("_before") < F.col(target)).drop("_r", "_d", "_before")


def candidates(services: DataFrame, recent: DataFrame, policy: TripPolicy = TripPolicy()) -> DataFrame:
    return services.join(recent, ["depot", "service_number"], "left").withColumns({
        "recent_or": F.coalesce("recent_or", F.lit(0.0)),
        "is_peak": in_peak(F.col("dep_sec")).cast("int"),
        "is_protected": F.col("service_number").isin(list(policy.protected)).cast("int") if policy.protected else F.lit(0),
    })


def trip_changes(gap: DataFrame, cands: DataFrame, policy: TripPolicy = TripPolicy()) -> DataFrame:
    """Services to change: a depot is either short or in excess, so one pass serves both.

    Short depots add from the fullest peak services with the shortest trips; depots in
    excess cut the emptiest off-peak services with the longest trips.  The two orders
    mirror each other, hence the sign.
    """
    acting = gap.filter("act").select(
        "depot", F.abs("delta_kms").alias("need"), F.when(F.col("delta_kms") > 0, 1).otherwise(-1).alias("sign"))
    pool = cands.join(acting, "depot")
    stop = F.col("recent_or") < policy.stop_below_or
    adding = F.col("sign") > 0
    trips = F.when(adding, F.lit(policy.trips_per_change)).when(stop, F.col("planned_trips")).otherwise(
        F.least(F.lit(policy.trips_per_change), F.col("planned_trips")))
    can_add = (F.col("recent_or") >= policy.add_from_or) & (F.col("km_per_trip") > 0)
    can_cut = (F.col("is_protected") == 0) & (F.col("can_be_cancelled") == 1) & (F.col("planned_trips") > 0)
    pool = pool.filter(F.when(adding, can_add).otherwise(can_cut)).withColumn("trips", trips).withColumn(
        "gain", F.col("km_per_trip") * F.col("trips"))
    sign = F.col("sign")
    order = [-sign * F.col("is_peak"), -sign * F.col("recent_or"), sign * F.col("km_per_trip"), F.asc("service_number")]
    taken = capped_allocation(pool, order, "gain", "need", policy.per_route, policy.per_depot)
    two = F.round("recent_or", 2)
    reason = (
        # Fixed texts of the reasons.
        F.when(adding, F.format_string("Add %d trip(s), OR=%.2f", "trips", two))
        .when(stop, F.format_string("Stop service, very low OR=%.2f", two))
        .otherwise(F.format_string("Cut %d trip(s), OR=%.2f", "trips", two))
    )
    action = F.when(adding, "INCREASE").when(stop, "STOP").otherwise("DECREASE")
    return taken.select("depot", "service_number", (sign * F.col("trips")).alias("trip_change"), action.alias("action"), reason.alias("reason"))


def add_trips(gap: DataFrame, cands: DataFrame, policy: TripPolicy = TripPolicy()) -> DataFrame:
    return trip_changes(gap.filter("delta_kms > 0"), cands, policy)


def cut_trips(gap: DataFrame, cands: DataFrame, policy: TripPolicy = TripPolicy()) -> DataFrame:
    return trip_changes(gap.filter("delta_kms <= 0"), cands, policy)


def impact(cands: DataFrame, changes: DataFrame) -> DataFrame:
    """The full schedule: every service with its change and kilometres."""
    plan = cands.join(changes, ["depot", "service_number"], "left").withColumns({
        "trip_change": F.coalesce("trip_change", F.lit(0)),
        "action": F.coalesce("action", F.lit("NO_CHANGE")),
        "reason": F.coalesce("reason", F.lit("Within tolerance")),
    })
    return plan.withColumn("suggested_trips", F.col("planned_trips") + F.col("trip_change")).withColumns({
        "planned_kms_day": F.bround(F.col("planned_trips") * F.col("km_per_trip"), 2),
        "suggested_kms_day": F.bround(F.col("suggested_trips") * F.col("km_per_trip"), 2),
    }).withColumn("kms_change", F.bround(F.col("suggested_kms_day") - F.col("planned_kms_day"), 2)).select(
        "depot", "service_number", "route", "product", "dep_sec", "is_peak", "is_protected", "planned_trips", "suggested_trips",
        "trip_change", "km_per_trip", "planned_kms_day", "suggested_kms_day", "kms_change", "recent_or", "action", "reason")


def trip_schedule(services: DataFrame, ops: DataFrame, forecast: DataFrame, shares: DataFrame, target, policy: TripPolicy = TripPolicy()) -> DataFrame:
    cands = candidates(services, materialise(recent_or(ops, target, policy.lookback_days), "recent"), policy)
    gap = materialise(depot_gap(services, forecast, shares, policy), "gap")
    return impact(cands, materialise(trip_changes(gap, cands, policy), "changes"))


TRIP_ACTIONS = ["STOP", "DECREASE", "INCREASE", "NO_CHANGE"]
SLOT_ACTIONS = ["ADD_SLOT", "CUT", "NO_CHANGE"]


def position(col: Column, order: list[str], default: int | None = None) -> Column:
    rank = F.when(col == order[0], 0)
    for i, value in enumerate(order[1:], 1):
        rank = rank.when(col == value, i)
    return rank if default is None else rank.otherwise(default)


def action_order(plan: DataFrame, size: str, order: list[str]) -> DataFrame:
    """Line number of each service of a depot: by the rank of its action, then by ``size``, the largest first.

    A partition holds the services of a depot's master.
    """
    by = Window.partitionBy("depot").orderBy(position(F.col("action"), order), F.desc(size), "service_number")
    return plan.select("depot", "service_number", "action", F.col(size).alias("size"), F.row_number().over(by).alias("line"))


def trip_summary(plan: DataFrame) -> DataFrame:
    count = {a: F.count_if(F.col("action") == a) for a in TRIP_ACTIONS}
    return plan.groupBy("depot").agg(
        F.sum("kms_change").alias("total_kms_change"),
        *[c.alias(f"count_{a.lower()}") for a, c in count.items()],
        F.count_if(F.col("action") != "NO_CHANGE").alias("services_changed"),
    )


# ---- slots engine -----------------------------------------------------------------
def quadrant(epk: Column, cpk: Column, load: Column, edge: float = SlotPolicy.quadrant_or) -> Column:
    pays, full = epk >= cpk, load >= edge
    return (
        F.when(pays & full, "UNDERSUPPLY").when(pays, "OVERSUPPLY").when(full, "SOCIAL_OBLIGATION").otherwise("INEFFICIENT")
    )


def epk(services: DataFrame, ops: DataFrame, forecast: DataFrame, target, policy: SlotPolicy = SlotPolicy()) -> DataFrame:
    """Forecast spread over services, and what each earns per kilometre."""
    keys = ["depot", "service_number"]
    economics = materialise(service_economics(ops, target, policy.lookback_days), "economics")
    base = services.join(forecast, "depot").join(economics, keys, "left")
    km = F.col("planned_kms")
    return (
        base.withColumn("allocated_pkm", F.col("predicted_pkm") * F.coalesce("weight", F.lit(0.0)))
        .withColumn("revenue", F.col("allocated_pkm") * F.coalesce("rev_per_pkm", F.lit(0.0)))
        .withColumns({
            "epk": F.when(km > 0, F.try_divide(F.col("revenue"), km)).otherwise(0.0),
            "cpk": F.coalesce("breakeven_cpk", F.lit(policy.default_cpk)),
            "or": F.when(km * F.col("avg_seats_per_bus") > 0, F.try_divide(F.col("allocated_pkm"), km * F.col("avg_seats_per_bus"))).otherwise(0.0),
        })
        .withColumns({
            "quadrant": quadrant(F.col("epk"), F.col("cpk"), F.col("or"), policy.quadrant_or),
            "contribution": F.col("revenue") - F.col("cpk") * km,
        })
    )


def decide(df: DataFrame, policy: SlotPolicy = SlotPolicy()) -> DataFrame:
    load, earn, cost = F.col("or"), F.col("epk"), F.col("cpk")
    add = (load > policy.add_or) & (earn > policy.add_premium * cost)
    cut = (load < policy.cut_or) & (earn < policy.cut_discount * cost) & (F.col("can_be_cancelled") == 1)

    def why(sign: str, edge: float, factor: float) -> Column:
        return F.format_string(f"OR=%.2f{sign}{edge}, EPK=%.2f{sign}{factor}*CPK", F.round(load, 2), F.round(earn, 2))

    return df.withColumns({
        "action": F.when(add, "ADD_SLOT").when(cut, "CUT").otherwise("NO_CHANGE"),
        "reason": F.when(add, why(">", policy.add_or, policy.add_premium)).when(cut, why("<", policy.cut_or, policy.cut_discount))
        .otherwise("Within policy bounds"),
    })


def next_slot(services: DataFrame) -> DataFrame:
    """Per departure time of a route: the next departure and the minute half-way to it.

    Two services leaving together follow each other.  A partition holds at most one
    row per second of a day.
    """
    times = services.filter("dep_sec IS NOT NULL").groupBy("depot", "route", "dep_sec").agg(F.count("*").alias("n"))
    following = F.lead("dep_sec").over(Window.partitionBy("depot", "route").orderBy("dep_sec"))
    then = F.when(F.col("n") > 1, F.col("dep_sec")).otherwise(following)
    middle = F.floor((F.floor(F.col("dep_sec") / 60) + F.floor(F.col("next_sec") / 60)) / 2)
    text = F.format_string("%02d:%02d:00", F.floor(middle / 60), middle % 60)
    return times.withColumn("next_sec", then).withColumn("slot", F.when(F.col("next_sec").isNotNull(), text)).drop("n")


def suggest_slot(decided: DataFrame, services: DataFrame) -> DataFrame:
    slots = materialise(next_slot(services).drop("next_sec"), "slots")
    joined = decided.join(slots, ["depot", "route", "dep_sec"], "left")
    return joined.withColumn("suggested_new_slot", F.when(F.col("action") == "ADD_SLOT", F.col("slot"))).drop("slot")


def slot_schedule(services: DataFrame, ops: DataFrame, forecast: DataFrame, target, policy: SlotPolicy = SlotPolicy()) -> DataFrame:
    plan = suggest_slot(decide(epk(services, ops, forecast, target, policy), policy), services)
    return plan.select("depot", "service_number", "route", "product", "dep_sec", "allocated_pkm", "planned_kms", "revenue", "epk", "or",
                       "cpk", "quadrant", "contribution", "action", "suggested_new_slot", "reason")


QUADRANTS = ["UNDERSUPPLY", "OVERSUPPLY", "SOCIAL_OBLIGATION", "INEFFICIENT"]


def slot_summary(plan: DataFrame) -> DataFrame:
    """Counts, shares and money per depot, one grouping."""
    inside = {q: F.col("quadrant") == q for q in QUADRANTS}
    return plan.groupBy("depot").agg(
        F.count("*").alias("total_services"),
        *[F.count_if(F.col("action") == a).alias(f"count_{a.lower()}") for a in SLOT_ACTIONS],
        *[F.count_if(c).alias(f"n_{q.lower()}") for q, c in inside.items()],
        *[F.bround(F.count_if(c) * 100.0 / F.count("*"), 1).alias(f"pct_{q.lower()}") for q, c in inside.items()],
        *[F.sum(m).alias(f"total_{m}") for m in ("allocated_pkm", "revenue", "contribution", "planned_kms")],
        F.avg("epk").alias("avg_epk"), F.avg("or").alias("avg_or"),
        *[F.sum(F.when(c, F.col("revenue")).otherwise(0.0)).alias(f"revenue_{q.lower()}") for q, c in inside.items()],
        *[F.sum(F.when(c, F.col("contribution")).otherwise(0.0)).alias(f"contribution_{q.lower()}") for q, c in inside.items()],
    )


def overview(stored: DataFrame, edge: float = SlotPolicy.quadrant_or) -> DataFrame:
    """Summary of a stored schedule; recomputes quadrant and contribution when the table lacks them."""
    out = stored
    if "quadrant" not in out.columns:
        out = out.withColumn("quadrant", quadrant(F.col("epk"), F.col("cpk"), F.col("or"), edge))
    if "contribution" not in out.columns:
        out = out.withColumn("contribution", F.col("revenue") - F.col("cpk") * F.col("planned_kms"))
    return slot_summary(out)


def prefer_engine(schedules: DataFrame) -> DataFrame:
    """Keep the ``epk`` schedule of a depot and date where both engines wrote one."""
    best = schedules.groupBy("target_date", "depot").agg(F.max(F.col("engine") == "epk").alias("_epk"))
    return schedules.join(best, ["target_date", "depot"]).filter((F.col("engine") == "epk") == F.col("_epk")).drop("_epk")
