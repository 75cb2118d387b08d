"""Itineraries: clocks, metrics, guards, exclusions, Pareto frontier, ranking and labels.

legs: request, cand, leg_no, mode, km, travel_s, overhead_s, cost_level; candidates: request, cand and the metrics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions.pricing import emissions, fare
from wayloom.operators.fixpoint import written
from wayloom.shipping import ship

VEHICLES = ("train", "ferry", "flight")
AXIS = ["total_s", "cost", "transfers", "car_km", "emissions"]
AXES = {"fastest": 3, "cheapest": 3, "fewest_transfers": 3, "most_direct": 5, "greenest": 5, "air_priority": 5}
ORDER = {
    "fastest": ("total_s", "cost", "transfers"),
    "cheapest": ("cost", "total_s", "transfers"),
    "fewest_transfers": ("transfers", "total_s", "cost"),
    "most_direct": ("no_vehicle", "vehicles", "total_s", "cost"),
    "greenest": ("emissions", "car_km", "total_s", "transfers", "cost"),
    "air_priority": ("no_flight", "total_s", "cost", "transfers"),
}


def clock(legs: DataFrame) -> DataFrame:
    """legs with depart_s and arrive_s: running sums of overhead and travel within a candidate."""
    w = Window.partitionBy("request", "cand").orderBy("leg_no").rowsBetween(Window.unboundedPreceding, 0)
    arrive = F.sum(F.col("overhead_s") + F.col("travel_s")).over(w)
    return legs.withColumn("arrive_s", arrive).withColumn("depart_s", F.col("arrive_s") - F.col("travel_s"))


def metrics(legs: DataFrame, fares=None) -> DataFrame:
    """One row for each candidate: total_s, km, cost (fares), transfers, vehicles, car_km, emissions, cost_level, primary_mode, modes,
    gc_km (great circles of its legs; km where legs have none) and crawls (a long leg far too slow for its ends)."""
    if fares is not None:  # a fare model: a function of legs that adds fare
        legs = fares(legs)
    vehicle, mode, km = F.col("mode").isin(*VEHICLES), F.col("mode"), F.col("km")
    price = fare(mode, km) if fares is None else F.col("fare")
    gc = F.col("gc_km") if "gc_km" in legs.columns else km
    crawls = (mode != "walk") & (gc > LONG_KM) & (F.col("travel_s") > 0) & (gc / (F.col("travel_s") / 3600) < LEAST_KMH)
    return legs.groupBy("request", "cand").agg(
        F.sum(F.col("travel_s") + F.col("overhead_s")).alias("total_s"), F.sum("travel_s").alias("ride_s"), F.sum("km").alias("km"), F.round(F.sum(F.round(price, 2)), 2).alias("cost"),
        F.greatest(F.lit(0), F.count_if(vehicle) - 1).alias("transfers"), F.count_if(vehicle).alias("vehicles"), F.sum(F.when(mode == "car", km).otherwise(0.0)).alias("car_km"),
        F.sum(emissions(mode, km)).alias("emissions"), F.max("cost_level").alias("cost_level"), F.max_by("mode", F.struct("km", -F.col("leg_no"))).alias("primary_mode"), F.count("*").alias("legs"),
        F.when(F.count_if(vehicle) > 0, 0).otherwise(1).alias("no_vehicle"), F.when(F.count_if(mode == "flight") > 0, 0).otherwise(1).alias("no_flight"),
        F.bool_and(mode == "walk").alias("walk_only"), F.sum(gc).alias("gc_km"), F.bool_or(crawls).alias("crawls"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("leg_no", "mode"))), lambda x: x["mode"]), ",").alias("modes"),
    )


#: Legs and trips over LONG_KM are checked for speed and detours; rides take no longer than three hours and the trip at 15 km/h.
LONG_KM, LEAST_KMH, DETOUR, MOST_LEGS, RIDE_HOURS, RIDE_KMH, WALK_KM = 75.0, 25.0, 2.0, 10, 3.0, 15.0, 10.0


def plausible(cands: DataFrame, trip_km) -> DataFrame:
    """Without chains of over ten legs, rides far too slow for the trip, long legs that crawl, and detours of over twice a long trip."""
    slow = F.col("ride_s") / 3600 > RIDE_HOURS + trip_km / RIDE_KMH
    detour = (trip_km > LONG_KM) & (F.col("gc_km") / trip_km > DETOUR)
    return cands.where(~((F.col("legs") > MOST_LEGS) | slow | F.col("crawls") | detour))


def walkable():
    """Whether a candidate isn't a long way on foot alone."""
    return ~(F.col("walk_only") & (F.col("km") > WALK_KM))


def exclude_modes(cands: DataFrame, uses_excluded, fallback_s: int = 57_600) -> DataFrame:
    """Without candidates that use an excluded mode, unless none other is left or the best other takes over fallback_s."""
    best = F.min(F.when(~uses_excluded, F.col("total_s"))).over(Window.partitionBy("request"))
    return cands.withColumn("__best", best).where(F.col("__best").isNull() | (F.col("__best") > fallback_s) | ~uses_excluded).drop("__best")


#: Candidates of a part of a request that one task prunes, and how many parts merge into one.
PART, FEWER = 20_000, 8


def frontier(cands: DataFrame, axes: list[str]) -> DataFrame:
    """Candidates of a request that no other one dominates: at least as good on all axes and better on one.

    A sorted skyline: only better-sorted candidates can dominate, so each meets those found undominated before it. A request of over
    PART candidates is pruned in parts first, as many as it needs, whose survivors merge FEWER at a time until one part is left."""
    most = cands.groupBy("request").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-most // PART))
    rest = cands
    while parts > 1:
        part = F.pmod(F.xxhash64("request", "cand"), F.lit(parts)).cast("int")
        rest = written(_skyline(rest.withColumn("__part", part), axes, ["request", "__part"]).drop("__part"), "skyline")
        parts = -(-parts // FEWER)
    return _skyline(rest, axes, ["request"])


def skyline(values):
    """Whether each row of a matrix is undominated (less is better); rows with a gap are neither dominated nor dominate."""
    import numpy as np

    order = np.lexsort(values.T[::-1])
    keep, best = np.ones(len(values), bool), np.empty((0, values.shape[1]))
    for a in range(0, len(order), 512):
        at = order[a : a + 512]
        rows, alive = values[at], np.ones(len(at), bool)
        for others in (*np.array_split(best, max(1, len(best) // 2048)), rows):
            left = np.flatnonzero(alive)
            x, y = rows[left][:, None, :], others[None, :, :]
            alive[left] = ~((y <= x).all(2) & (y < x).any(2)).any(1)
        keep[at] = alive
        best = np.concatenate([best, rows[alive & ~np.isnan(rows).any(1)]])
    return keep


def _skyline(cands: DataFrame, axes: list[str], keys: list[str]) -> DataFrame:
    ship(cands.sparkSession)

    def prune(table):
        import numpy as np

        values = np.column_stack([table.column(a).cast("double").to_numpy(zero_copy_only=False) for a in axes])
        return table.filter(skyline(values))

    return cands.groupBy(*keys).applyInArrow(prune, cands.schema)


def rank(cands: DataFrame, objective: str, top: int = 3) -> DataFrame:
    w = Window.partitionBy("request").orderBy(*ORDER[objective], "cand")
    return cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def labels(cands: DataFrame, objectives: list[str]) -> DataFrame:
    """request, cand and the labels of the objectives it is best at, in the order of objectives."""
    best = None
    for k, o in enumerate(objectives):
        one = rank(cands, o, 1).select("request", "cand", F.lit(k).alias("k"), F.lit(o).alias("label"))
        best = one if best is None else best.unionByName(one)
    found = best.groupBy("request", "cand").agg(F.array_sort(F.collect_list(F.struct("k", "label"))).alias("l"))
    return found.select("request", "cand", F.array_join(F.col("l.label"), ",").alias("labels"))


def humanize(seconds):
    """'1d 3h 5m', '2h 9m', '0m'."""
    minutes = F.floor(seconds / 60)
    d, h, m = F.floor(minutes / 1440), F.floor(minutes / 60) % 24, minutes % 60
    part = lambda x, u: F.when(x > 0, F.concat(x.cast("string"), F.lit(u)))
    text = F.concat_ws(" ", part(d, "d"), part(h, "h"), part(m, "m"))
    return F.when(text == "", "0m").otherwise(text)


def with_signature(cands: DataFrame) -> DataFrame:
    """Candidates of metrics() with signature: what tells them apart for ranking, five rounded metrics and the modes in order."""
    parts = [F.bround("total_s").cast("long"), F.bround("cost", 2), F.col("transfers"), F.bround("car_km", 3), F.bround("emissions", 1)]
    return cands.withColumn("signature", F.concat_ws("|", *[p.cast("string") for p in parts], "modes"))


def dedupe(cands: DataFrame, order: str = "cand") -> DataFrame:
    """Of candidates (request, signature, ...) with one signature the first in order."""
    w = Window.partitionBy("request", "signature").orderBy(order)
    return cands.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
