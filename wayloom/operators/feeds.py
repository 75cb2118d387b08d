"""Whole timetables: merging, clipping to a corridor, and composing one for a trip from a catalog.

A timetable is four tables: stops (stop_id, name, lat, lon, stop_type, tz, min_transfer_s), trips (trip_id, ...), calls (trip_id, seq,
stop_id, arr_s, dep_s) and footpaths (from_stop, to_stop, dur_s); ids are strings.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.functions.geo import haversine_km
from wayloom.operators import spatial
from wayloom.operators.fixpoint import written
from wayloom.operators.timetable import most_offset  # noqa: F401 (of a whole timetable)

#: Stops of one id farther apart than SAME_KM are different stops; walks to link hubs at WALK_KMH within LINK_KM, LINKS at most.
SAME_KM, WALK_KMH, LINK_KM, LINKS = 1.0, 4.5, 2.0, 6
HUBS = ("airport", "ferry_terminal")


@dataclass
class Timetable:
    stops: DataFrame
    trips: DataFrame
    calls: DataFrame
    footpaths: DataFrame


def _merged(one: Timetable, other: Timetable, number: int) -> Timetable:
    """one and other: of stops and trips with one id one's counts; a stop of other far from its namesake gets an id of its own."""
    here = one.stops.select("stop_id", F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), F.lit(True).alias("__here"))
    met = written(other.stops.join(here, "stop_id", "left"), "met")
    far = F.col("__here") & ~F.coalesce(haversine_km(F.col("lat"), F.col("lon"), F.col("__lat"), F.col("__lon")) <= SAME_KM, F.lit(False))
    names = written(met.where(far).select("stop_id", F.concat("stop_id", F.lit(f"#{number}")).alias("new_id")), "names")
    while not (taken := names.join(one.stops.select(F.col("stop_id").alias("new_id")), "new_id", "left_semi")).isEmpty():
        names = written(names.join(taken.select("stop_id", F.lit("#").alias("more")), "stop_id", "left").select("stop_id", F.concat("new_id", F.coalesce("more", F.lit(""))).alias("new_id")), "names")

    def renamed(df: DataFrame, column: str) -> DataFrame:
        return df.join(names.select(F.col("stop_id").alias(column), F.col("new_id").alias("__new")), column, "left").withColumn(column, F.coalesce("__new", column)).select(*df.columns)

    fresh = renamed(met.where(F.col("__here").isNull() | far).select(*other.stops.columns), "stop_id")
    trips = other.trips.join(one.trips.select("trip_id"), "trip_id", "left_anti")
    calls = renamed(other.calls.join(one.trips.select("trip_id"), "trip_id", "left_anti"), "stop_id")
    walks = renamed(renamed(other.footpaths, "from_stop"), "to_stop")
    every = lambda a, b: a.unionByName(b, allowMissingColumns=True)
    return Timetable(every(one.stops, fresh), every(one.trips, trips), every(one.calls, calls), every(one.footpaths, walks))


def merge(parts: list[Timetable]) -> Timetable:
    """The parts in order, earlier ones first on equal ids."""
    if not parts:
        raise ValueError("nothing to merge")
    return reduce(lambda a, b: _merged(a, b[1], b[0]), enumerate(parts[1:], 1), parts[0])


def clip(t: Timetable, lat0: float, lon0: float, lat1: float, lon1: float) -> Timetable:
    """The trips with two calls or more in the box, whole, with their stops; and the stops in the box that walks join to those."""
    inside = t.stops.where(F.col("lat").between(lat0, lat1) & F.col("lon").between(lon0, lon1)).select("stop_id")
    kept = t.calls.join(inside, "stop_id", "left_semi").groupBy("trip_id").count().where("count >= 2").select("trip_id")
    trips, calls = t.trips.join(kept, "trip_id", "left_semi"), t.calls.join(kept, "trip_id", "left_semi")
    served = written(calls.select("stop_id").distinct().join(t.stops.select("stop_id"), "stop_id", "left_semi"), "served")
    way = t.footpaths.select("from_stop", "to_stop").unionByName(t.footpaths.select(F.col("to_stop").alias("from_stop"), F.col("from_stop").alias("to_stop")))
    way = written(way.select("from_stop", F.col("to_stop").alias("stop_id")).join(inside, "stop_id", "left_semi").distinct(), "ways")
    found = edge = served
    while not edge.isEmpty():
        edge = written(edge.withColumnRenamed("stop_id", "from_stop").join(way, "from_stop").select("stop_id").distinct().join(found, "stop_id", "left_anti"), "edge")
        found = written(found.unionByName(edge), "found")
    stops = t.stops.join(found, "stop_id", "left_semi")
    walks = t.footpaths.join(found.withColumnRenamed("stop_id", "from_stop"), "from_stop", "left_semi").join(found.withColumnRenamed("stop_id", "to_stop"), "to_stop", "left_semi")
    return Timetable(stops, trips, calls, walks.select(*t.footpaths.columns))


def link_hubs(t: Timetable, km: float = LINK_KM, links: int = LINKS) -> Timetable:
    """With walks both ways between each airport or ferry terminal and its nearest other stops."""
    hub = F.col("stop_type").isin(*HUBS)
    hubs = t.stops.where(hub).select(F.col("stop_id").alias("from_stop"), "lat", "lon")
    others = t.stops.where(~F.coalesce(hub, F.lit(False))).select(F.col("stop_id").alias("to_stop"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    near = spatial.top_near(hubs, "from_stop", others, "to_stop", km, links).select("from_stop", "to_stop", (F.col("km") / WALK_KMH * 3600).alias("dur_s"))
    both = near.unionByName(near.select(F.col("to_stop").alias("from_stop"), F.col("from_stop").alias("to_stop"), "dur_s"))
    kind = t.footpaths.schema["dur_s"].dataType
    return replace(t, footpaths=t.footpaths.unionByName(both.withColumn("dur_s", F.col("dur_s").cast(kind))))


def fill_zones(t: Timetable) -> Timetable:
    """Stops without a zone with that of the nearest stop with one; without any zone nothing changes."""
    if t.stops.where("tz is not null").isEmpty():
        return t
    return replace(t, stops=t.stops.drop("tz").join(spatial.fill_zones(t.stops.select("stop_id", "lat", "lon", "tz")), "stop_id"))


#: Fixed values of composing: degrees around the ends of a trip, feeds tried, trips merged.
MARGIN, ATTEMPTS, MOST_TRIPS = 0.6, 4, 80_000


def compose(ends: list[tuple[float, float]], air: Timetable | None, feeds: list[Timetable], curated: list[Timetable] = (), margin: float = MARGIN, attempts: int = ATTEMPTS, most_trips: int = MOST_TRIPS) -> tuple[Timetable | None, list[str]]:
    """(timetable, notes) for a trip between ends: the flight network, then the feeds in the order given (smallest area first), clipped to
    the corridor, up to a number of trips, then curated feeds beyond that number; zones filled, hubs linked."""
    lats, lons = zip(*ends, strict=True)
    box = (min(lats) - margin, min(lons) - margin, max(lats) + margin, max(lons) + margin)
    parts, notes, total = ([air] if air is not None else []), ([] if air is not None else ["no flights"]), 0
    for k, feed in enumerate(feeds[:attempts]):
        part = clip(feed, *box)
        n = part.trips.count()
        if not n:
            notes.append(f"feed {k} has no service in the corridor")
        elif total and total + n > most_trips:
            break
        else:
            parts.append(part)
            total += n
    for k, feed in enumerate(curated):
        part = clip(feed, *box)
        if part.trips.isEmpty():
            notes.append(f"curated feed {k} has no service in the corridor")
        else:
            parts.append(part)
    return (link_hubs(fill_zones(merge(parts))) if parts else None), notes
