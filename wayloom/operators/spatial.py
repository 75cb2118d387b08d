"""Joins by distance: points meet only within grid cells, so no pair outside a neighbourhood is formed."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions.geo import EARTH_KM, haversine_km, in_polygons
from wayloom.operators.fixpoint import written

#: A little less than a degree of latitude, so that cells are a little wider than a radius.
KM_PER_DEGREE = 111.19


def _columns(band, cell: float, km: float):
    """Cells of a band of latitude: as many as leave each wide enough for km at the poleward edge of the next band; near a pole one."""
    top = F.radians(F.least(F.lit(90.0), (F.greatest(F.abs(band), F.abs(band + 1)) + 1) * cell))
    ratio = F.lit(math.sin(min(km / (2 * EARTH_KM), math.pi / 2))) / F.cos(top)
    width = F.when(ratio >= 1, 360.0).otherwise(F.degrees(2 * F.asin(F.least(ratio, F.lit(1.0)))))
    return F.greatest(F.lit(1), F.floor(360 / width)).cast("int")


def _cells(df: DataFrame, lat: str, lon: str, km: float, around: bool) -> DataFrame:
    """df with ci, cj: its cell, or a row for each cell around it; longitudes wrap."""
    cell = min(180.0, km / KM_PER_DEGREE)
    band = F.floor(F.col(lat) / cell).cast("int")
    df = df.withColumn("ci", F.explode(F.sequence(band - 1, band + 1)) if around else band)
    n = _columns(F.col("ci"), cell, km)
    j = F.least(F.floor(F.pmod(F.col(lon) + 180, F.lit(360.0)) / 360 * n).cast("int"), n - 1)
    return df.withColumn("cj", F.explode(F.array_distinct(F.array(F.pmod(j - 1 + n, n), j, F.pmod(j + 1, n)))) if around else j)


def within(points: DataFrame, places: DataFrame, km: float, *of) -> DataFrame:
    """Pairs of points (lat, lon, ...) and places (p_lat, p_lon, ...) at most km apart, with km; across the 180th meridian and at the poles too.

    Distances are taken once for each pair of spots, however many points and places lie there, and so are the columns `of`, made of km,
    that pairs have instead of km."""
    spots, at = points.select("lat", "lon").distinct(), places.select("p_lat", "p_lon").distinct()
    pairs = _cells(spots, "lat", "lon", km, True).join(_cells(at, "p_lat", "p_lon", km, False), ["ci", "cj"])
    pairs = pairs.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))).where(F.col("km") <= km)
    pairs = pairs.select("lat", "lon", "p_lat", "p_lon", *(of or ["km"]))
    return points.join(pairs, ["lat", "lon"]).join(places, ["p_lat", "p_lon"])


#: The widest cells of nearest(), and how often they are halved: 25 km to 400 m.
WIDEST_KM, HALVINGS = 25.0, 6


def nearest(points: DataFrame, key: str, places: DataFrame, place: str, first_km: float = WIDEST_KM, limit_km: float | None = None) -> DataFrame:
    """(key, place, km): each point's nearest place, with limit_km of those no farther, ties by the smaller place.

    Points at one spot look once, and of places at one spot only the smallest counts. Cells follow the density: a spot looks into the
    smallest cell around it that holds any place, which gives a place that is near, and then at all places no farther than that one, in
    cells just wide enough. Spots with no place within first_km look four times as far, up to the limit or the whole globe."""
    points = written(points.select(key, "lat", "lon").where("lat is not null and lon is not null").dropDuplicates([key]), "points")
    places = places.where("p_lat is not null and p_lon is not null").groupBy("p_lat", "p_lon").agg(F.min(place).alias(place))
    found = _nearest(points.select("lat", "lon").distinct(), places, place, first_km, limit_km)
    return points.join(found, ["lat", "lon"]).select(key, place, "km")


def _nearest(spots: DataFrame, places: DataFrame, place: str, first_km: float, limit_km: float | None) -> DataFrame:
    """(lat, lon, place, km) of spots (lat, lon); no two places (place, p_lat, p_lon) at one spot."""
    spot, far = ["lat", "lon"], first_km
    most = math.pi * EARTH_KM + 1 if limit_km is None else limit_km
    spots, places = written(spots, "spots"), written(places, "places")
    levels = [(k, first_km / 2**k) for k in range(HALVINGS + 1)]
    at = lambda df, lat, lon, around: [_cells(df, lat, lon, km, around).withColumn("level", F.lit(k)) for k, km in levels]
    held = written(_every(at(places, "p_lat", "p_lon", False)), "held")
    cells = held.select("level", "ci", "cj").distinct()
    own = _every(at(spots, "lat", "lon", False)).join(cells, ["level", "ci", "cj"])
    smallest = own.groupBy(*spot).agg(F.max(F.struct("level", "ci", "cj")).alias("c")).select(*spot, "c.*")
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))
    reach = smallest.join(held, ["level", "ci", "cj"]).groupBy(*spot).agg(F.min(km).alias("reach"))
    # cells as wide as the reach or up to twice as wide, with the eight around: all that may be nearer is in them
    wide = F.greatest(F.lit(0), F.least(F.lit(HALVINGS), F.floor(F.log2(first_km / F.greatest(F.col("reach"), F.lit(1e-9)))).cast("int")))
    reach = written(reach.where(F.col("reach") <= first_km).withColumn("level", wide), "reach")
    near = _every([_cells(reach.where(F.col("level") == k), "lat", "lon", w, True) for k, w in levels])
    met = near.join(held, ["level", "ci", "cj"]).withColumn("km", km).where(F.col("km") <= F.col("reach"))
    best = lambda df: df.groupBy(*spot).agg(F.min(F.struct("km", place)).alias("m")).select(*spot, f"m.{place}", "m.km")
    out = written(best(met), "nearest")
    left = written(spots.join(out, spot, "left_anti"), "left")
    while not left.isEmpty():
        found = written(best(within(left, places, min(far, most))), "nearest")
        out = out.unionByName(found)
        left = written(left.join(found, spot, "left_anti"), "left")
        if far >= most:
            break
        far *= 4
    return out.where(F.col("km") <= most)


def _every(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def top_near(points: DataFrame, key: str, places: DataFrame, place: str, km: float, k: int, apart: bool = True) -> DataFrame:
    """The k nearest places of each point within km; with apart, places at the same spot don't count."""
    w = Window.partitionBy(key).orderBy("km", place)
    near = within(points, places, km)
    near = near.where("km > 0") if apart else near
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Degrees of the squares in which points meet boxes.
SQUARE = 5.0


def _in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points joined with the boxes (lat0, lon0, lat1, lon1) that hold them: both meet in squares, however many boxes there are."""
    square = lambda c: F.floor(F.col(c) / SQUARE).cast("int")
    b = boxes.where("lat0 <= lat1 and lon0 <= lon1").withColumn("ci", F.explode(F.sequence(square("lat0"), square("lat1")))).withColumn("cj", F.explode(F.sequence(square("lon0"), square("lon1"))))
    inside = F.col("lat").between(F.col("lat0"), F.col("lat1")) & F.col("lon").between(F.col("lon0"), F.col("lon1"))
    return points.withColumns({"ci": square("lat"), "cj": square("lon")}).join(b, ["ci", "cj"]).where(inside).drop("ci", "cj")


def covering(points: DataFrame, boxes: DataFrame, group: str, box: str) -> DataFrame:
    """(group, box, area) of the boxes (lat0, lon0, lat1, lon1) that cover every point of a group."""
    n = points.groupBy(group).agg(F.count("*").alias("n"))
    hits = _in_boxes(points, boxes).groupBy(group, box).agg(F.count("*").alias("hits"), F.first((F.col("lat1") - F.col("lat0")) * (F.col("lon1") - F.col("lon0"))).alias("area"))
    return hits.join(n, group).where("hits = n").select(group, box, "area")


def touching(points: DataFrame, boxes: DataFrame, group: str, box: str) -> DataFrame:
    """(group, box) of the boxes that hold at least one point of a group."""
    return _in_boxes(points, boxes).select(group, box).distinct()


def smallest_region(points: DataFrame, regions: DataFrame, group: str) -> DataFrame:
    """For each group the smallest region (region_id, parent, lat0.., polygons) that has a parent and holds all points."""
    n = points.groupBy(group).agg(F.count("*").alias("n"))
    hits = _in_boxes(points, regions.where("parent is not null")).where(in_polygons(F.col("lat"), F.col("lon"), F.col("polygons")))
    each = hits.groupBy(group, "region_id").agg(F.count("*").alias("hits"), F.first((F.col("lat1") - F.col("lat0")) * (F.col("lon1") - F.col("lon0"))).alias("area"))
    return each.join(n, group).where("hits = n").groupBy(group).agg(F.min(F.struct("area", "region_id")).alias("m")).select(group, "m.region_id", "m.area")


def fill_zones(stops: DataFrame) -> DataFrame:
    """(stop_id, tz) of stops (stop_id, lat, lon, tz): a stop without a zone takes that of the nearest stop with one."""
    known = stops.where("tz is not null").select(F.col("stop_id").alias("from_stop"), "tz", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    near = nearest(stops.where("tz is null").select("stop_id", "lat", "lon"), "stop_id", known, "from_stop")
    return stops.where("tz is not null").select("stop_id", "tz").unionByName(near.join(known.select("from_stop", "tz"), "from_stop").select("stop_id", "tz"))


def zone_of_doors(doors: DataFrame, key: str, stops: DataFrame, default: DataFrame) -> DataFrame:
    """(key, tz): the zone of each door's nearest stop, or the feed's (default, one row tz) where that stop has none."""
    places = stops.select("stop_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    own = nearest(doors, key, places, "stop_id").join(stops.select("stop_id", "tz"), "stop_id")
    return own.select(key, "tz").join(F.broadcast(default.select(F.col("tz").alias("__tz")).limit(1)), how="left").select(key, F.coalesce("tz", "__tz").alias("tz"))
