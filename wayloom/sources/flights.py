"""Airport and route files (headerless CSV) as a synthetic flight timetable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayloom.functions.geo import haversine_km
from wayloom.operators.feeds import Timetable
from wayloom.operators.fixpoint import numbered, written
from wayloom.operators.spatial import within
from wayloom.sources.gtfs import with_valid_zone

AIRPORTS = "id string, name string, city string, country string, iata string, icao string, lat double, lon double, alt string, tz_offset string, dst string, tz string, type string, source string"
ROUTES = "airline string, airline_id string, src string, src_id string, dst string, dst_id string, codeshare string, stops string, equipment string"


def read_airports(spark: SparkSession, path: str) -> DataFrame:
    """Airports with a code and coordinates; of rows with one code the last counts; n is its place in the file, zones that don't exist are null."""
    a = spark.read.schema(AIRPORTS).option("nullValue", "\\N").csv(path).withColumn("__row", F.monotonically_increasing_id())
    return a.where("iata is not null and lat is not null and lon is not null").groupBy("iata").agg(F.max_by(F.struct("name", "city", "country", "lat", "lon", "tz", F.col("__row").alias("n")), "__row").alias("a")).select("iata", "a.*").transform(with_valid_zone)


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROUTES).option("nullValue", "\\N").csv(path).select("src", "dst", "stops")


def route_pairs(routes: DataFrame, airports: DataFrame) -> DataFrame:
    """Distinct directed non-stop pairs of known airports."""
    known = airports.select("iata")
    return routes.where("stops = '0' and src <> dst").select("src", "dst").join(known.withColumnRenamed("iata", "src"), "src", "left_semi").join(known.withColumnRenamed("iata", "dst"), "dst", "left_semi").select("src", "dst").distinct()


def degrees(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("src", "dst")).alias("iata")).groupBy("iata").agg(F.count("*").alias("degree"))


def synthetic_flights(pairs: DataFrame, airports: DataFrame, hours: list[int], gate_s: int = 2700, kmh: float = 800.0) -> DataFrame:
    """trip_id, src, dst, dep_s, arr_s: every pair at every hour; 45 minutes and the great circle at 800 km/h."""
    a, b = (airports.select(F.col("iata").alias(k), F.col("lat").alias(f"{k}_lat"), F.col("lon").alias(f"{k}_lon")) for k in ("src", "dst"))
    km = haversine_km(F.col("src_lat"), F.col("src_lon"), F.col("dst_lat"), F.col("dst_lon"))
    f = pairs.join(a, "src").join(b, "dst").withColumn("hour", F.explode(F.array(*map(F.lit, hours))))
    dep = F.col("hour") * 3600.0
    return f.select(F.format_string("%s-%s@%02d", F.col("src").cast("string"), F.col("dst").cast("string"), "hour").alias("trip_id"), "src", "dst", dep.alias("dep_s"), (dep + gate_s + km / kmh * 3600).alias("arr_s"))


#: The hours at which each route leaves, and a stop's change time.
HOURS, CHANGE_S = (8, 14, 20), 300


def timetable(airports: DataFrame, pairs: DataFrame, keep: DataFrame | None = None, hours: tuple[int, ...] = HOURS) -> Timetable:
    """The flights of route_pairs() as a timetable: airports (iata, name, lat, lon, tz) that have flights are its stops, and every route is a trip
    at each hour of every day, in the zone of the airport that it leaves. keep (iata) restricts airports and the routes between them."""
    if keep is not None:
        pairs = pairs.join(keep.select(F.col("iata").alias("src")), "src", "left_semi").join(keep.select(F.col("iata").alias("dst")), "dst", "left_semi").select("src", "dst")
    f = synthetic_flights(pairs, airports, list(hours))
    every = {
        "start_day": F.lit("0001-01-01").cast("date"), "end_day": F.lit("9999-12-31").cast("date"), "weekdays": F.sequence(F.lit(0), F.lit(6)), "added": F.array().cast("array<date>"), "removed": F.array().cast("array<date>"),
        "open_months": F.array().cast("array<int>"), "required": F.array().cast("array<string>"), "forbidden": F.array().cast("array<string>"),
    }
    trips = f.select("trip_id", F.lit("flight").alias("mode")).withColumns(every)
    call = lambda n, stop, at: F.struct(F.lit(n).alias("seq"), F.col(stop).alias("stop_id"), F.bround(at).cast("long").alias("arr_s"), F.bround(at).cast("long").alias("dep_s"))
    calls = f.select("trip_id", F.explode(F.array(call(1, "src", "dep_s"), call(2, "dst", "arr_s"))).alias("c")).select("trip_id", "c.*")
    served = pairs.select(F.explode(F.array("src", "dst")).alias("iata")).distinct()
    stops = airports.join(served, "iata", "left_semi").select(F.col("iata").alias("stop_id"), "name", "lat", "lon", F.lit("airport").alias("stop_type"), "tz", F.lit(CHANGE_S).alias("min_transfer_s"))
    walks = calls.limit(0).select(F.col("stop_id").alias("from_stop"), F.col("stop_id").alias("to_stop"), F.lit(0.0).alias("dur_s"))
    return Timetable(stops, trips, calls, walks)


def trimmed(pairs: DataFrame, least: int) -> DataFrame:
    """Pairs whose ends both have `least` routes or more."""
    busy = degrees(pairs).where(F.col("degree") >= least)
    return pairs.join(busy.select(F.col("iata").alias("src")), "src", "left_semi").join(busy.select(F.col("iata").alias("dst")), "dst", "left_semi").select("src", "dst")


def keep_set(points: DataFrame, airports: DataFrame, degree: DataFrame, near_km: float, **hub) -> DataFrame:
    """iata of the airports near the points, and of the hubs around them."""
    near = within(points, airports.select("iata", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")), near_km).select("iata")
    return near.unionByName(hubs(points, airports, degree, **hub).select("iata")).distinct()


#: How many of the busiest airports points meet first, and how many times as many those that lack some meet next.
FIRST, FARTHER = 64, 4


def hubs(points: DataFrame, airports: DataFrame, degree: DataFrame, least: int = 80, km: float = 3000.0, k: int = 6) -> DataFrame:
    """(point, iata, degree, rank): the k busiest airports within km of each point, ties by the larger code.

    Points at one spot ask once, and of airports at one spot only the k busiest count. Spots meet the FIRST busiest airports of all; those
    that find fewer than k within km meet FARTHER times as many, and so on until all are met: what a spot meets follows how far
    down it must go, not how many airports are near."""
    order = [F.desc("degree"), F.desc("iata")]
    busy = airports.join(degree.where(F.col("degree") >= least), "iata").select("iata", "degree", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    busy = busy.withColumn("__n", F.row_number().over(Window.partitionBy("p_lat", "p_lon").orderBy(*order))).where(F.col("__n") <= k).drop("__n")
    busy = written(numbered(busy, "busy", *order), "busy")
    last, met, out = busy.agg(F.max("n")).first()[0] or 0, FIRST, None
    left = written(points.select("lat", "lon").distinct(), "spots")
    w = Window.partitionBy("lat", "lon").orderBy(*order)
    while True:
        near = within(left, busy.where(F.col("n") < met), km).select("lat", "lon", "iata", "degree")
        top = written(near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "hubs")
        full = top if met > last else top.join(top.where(F.col("rank") == k).select("lat", "lon"), ["lat", "lon"], "left_semi")
        out = full if out is None else out.unionByName(full)
        if met > last:
            break
        left = written(left.join(full.select("lat", "lon").distinct(), ["lat", "lon"], "left_anti"), "spots")
        if left.isEmpty():
            break
        met *= FARTHER
    return points.join(out, ["lat", "lon"]).select("point", "iata", "degree", "rank")

