"""Queries of readers, catalogs, whole timetables, models and result forms; files are written from the domain views first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wayloom.functions import pricing
from wayloom.journeys import _COVER, _FEET, _METRICS, _PAIRS, _airports, _arcs, _boxes, _BOXES, _cands, _network, _pairs, _query, _r, _trips_of, _WEIGHTS
from wayloom.operators import compose, feeds, planner, road, spatial
from wayloom.operators.fixpoint import shared_dir
from wayloom.plans.domain import calendars, hav, view, with_views
from wayloom.sources import catalogs, flights, gtfs, results


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _feed(spark, sf, rules: bool = False) -> str:
    """The domain's stops, trips and calls as a GTFS folder; with rules, transfers of all types, between stops too."""
    path = _folder(spark, "feed")
    put = lambda df, name: df.write.option("header", True).option("emptyValue", "").csv(f"{path}/{name}.txt")
    stops, trips = view(spark, sf, "stops"), calendars(view(spark, sf, "trips"))
    put(stops.select("stop_id", F.col("name").alias("stop_name"), F.col("lat").alias("stop_lat"), F.col("lon").alias("stop_lon"), F.when(F.col("stop_id") % 11 == 0, "Nowhere/Atlantis").otherwise(F.col("tz")).alias("stop_timezone"), F.when(F.col("stop_id") % 10 == 3, F.col("stop_id") - 1).alias("parent_station")), "stops")
    put(spark.createDataFrame([("Nowhere/Atlantis",), ("Europe/Bucharest",), ("Europe/Bucharest",), ("Europe/Paris",)], "agency_timezone string"), "agency")
    put(spark.createDataFrame([("flight", "1100"), ("ferry", "4"), ("train", "2")], "route_id string, route_type string"), "routes")
    put(trips.select(F.col("mode").alias("route_id"), F.concat(F.lit("S"), F.col("trip_id")).alias("service_id"), "trip_id"), "trips")
    stamp = lambda c: F.date_format(c, "yyyyMMdd")
    put(trips.select(F.concat(F.lit("S"), F.col("trip_id")).alias("service_id"), *[F.when(F.col("off_day") == k, "0").otherwise("1").alias(d) for k, d in enumerate(gtfs.DAYS)], stamp("start_day").alias("start_date"), stamp("end_day").alias("end_date")), "calendar")
    exceptions = trips.select(F.concat(F.lit("S"), F.col("trip_id")).alias("service_id"), F.explode(F.array(F.struct(F.date_add("start_day", 30).alias("d"), F.lit("1").alias("k")), F.struct(F.date_add("start_day", 3).alias("d"), F.lit("2").alias("k")))).alias("x"))
    put(exceptions.select("service_id", stamp("x.d").alias("date"), F.col("x.k").alias("exception_type")), "calendar_dates")
    clock = lambda s: F.format_string("%d:%02d:%02d", F.floor(F.col(s) / 3600), F.floor(F.col(s) / 60) % 60, F.col(s) % 60)
    put(view(spark, sf, "calls").select("trip_id", F.col("seq").alias("stop_sequence"), "stop_id", F.when(F.col("seq") % 3 != 0, clock("arr_s")).alias("arrival_time"), clock("dep_s").alias("departure_time")), "stop_times")
    own = stops.select(F.col("stop_id").alias("from_stop_id"), F.col("stop_id").alias("to_stop_id"), F.when(F.col("min_transfer_s").isNull(), 3).otherwise(2).alias("transfer_type"), F.col("min_transfer_s").alias("min_transfer_time"))
    if rules:
        k = F.col("stop_id")
        kind, least = F.when(k % 5 < 4, k % 5), F.when(k % 3 == 0, 0).when(k % 3 == 1, 30).when(k % 7 == 0, -5)
        own = own.where("from_stop_id % 2 = 0").unionByName(stops.select(k.alias("from_stop_id"), k.alias("to_stop_id"), kind.alias("transfer_type"), least.alias("min_transfer_time")))
        own = own.unionByName(stops.select(k.alias("from_stop_id"), (k + 1).alias("to_stop_id"), kind.alias("transfer_type"), least.alias("min_transfer_time")))
    put(own.coalesce(1), "transfers")
    return path


_GOOD = with_views("calls", "trips") + ", timed AS (SELECT trip_id, seq, stop_id, CASE WHEN seq % 3 = 0 THEN dep_s ELSE arr_s END AS arr_s, dep_s FROM calls), good AS (SELECT trip_id FROM (SELECT *, lag(dep_s) OVER (PARTITION BY trip_id ORDER BY seq) AS p FROM timed) x GROUP BY trip_id HAVING count(*) >= 2 AND NOT bool_or(arr_s > dep_s OR coalesce(arr_s < p, FALSE)))"


@_query(_GOOD + " SELECT CAST(trip_id AS VARCHAR) AS trip_id, CAST(seq AS INTEGER) AS seq, CAST(stop_id AS VARCHAR) AS stop_id, arr_s, dep_s FROM timed WHERE trip_id IN (SELECT trip_id FROM good)")
def gtfs_calls(spark, sf):
    """Calls read from a feed's files: blank arrivals take the departure, trips that go back in time or have one call are left out."""
    return gtfs.read_gtfs(spark, _feed(spark, sf)).calls.select("trip_id", "seq", "stop_id", F.col("arr_s").cast("long").alias("arr_s"), F.col("dep_s").cast("long").alias("dep_s"))


@_query(_GOOD + " SELECT CAST(trip_id AS VARCHAR) AS trip_id, mode, CAST(start_day AS VARCHAR) AS start_day, CAST(CAST(start_day + INTERVAL 27 DAY AS DATE) AS VARCHAR) AS end_day, array_to_string(list_filter(range(7), lambda x: x <> off_day), ',') AS weekdays, CAST(CAST(start_day + INTERVAL 30 DAY AS DATE) AS VARCHAR) AS added, CAST(CAST(start_day + INTERVAL 3 DAY AS DATE) AS VARCHAR) AS removed FROM trips")
def gtfs_trips(spark, sf):
    """Trips of a feed with their mode and calendar."""
    t = gtfs.read_gtfs(spark, _feed(spark, sf)).trips
    text = lambda c: c.cast("string")
    return t.select("trip_id", "mode", text(F.col("start_day")).alias("start_day"), text(F.col("end_day")).alias("end_day"), F.array_join(F.col("weekdays").cast("array<string>"), ",").alias("weekdays"), text(F.get("added", F.lit(0))).alias("added"), text(F.get("removed", F.lit(0))).alias("removed"))


@_query(with_views("stops") + " SELECT CAST(stop_id AS VARCHAR) AS stop_id, name, round(lat, 6) AS lat, round(lon, 6) AS lon, CASE WHEN stop_id % 11 = 0 OR tz IS NULL THEN 'Europe/Bucharest' ELSE tz END AS tz, CAST(min_transfer_s AS INTEGER) AS min_transfer_s FROM stops")
def gtfs_stops(spark, sf):
    """Stops of a feed: zones that don't exist, and missing ones, are the most common valid one of the agencies."""
    return gtfs.read_gtfs(spark, _feed(spark, sf)).stops.select("stop_id", "name", _r(F.col("lat")).alias("lat"), _r(F.col("lon")).alias("lon"), "tz", F.col("min_transfer_s").cast("int").alias("min_transfer_s"))


@_query(with_views("stops") + f", up AS (SELECT c.stop_id AS a, p.stop_id AS b, {hav('c.lat', 'c.lon', 'p.lat', 'p.lon')} / 4.5 * 3600 AS dur FROM stops c JOIN stops p ON p.stop_id = c.stop_id - 1 WHERE c.stop_id % 10 = 3) SELECT CAST(a AS VARCHAR) AS from_stop, CAST(b AS VARCHAR) AS to_stop, round(dur, 3) AS dur_s FROM up UNION ALL SELECT CAST(b AS VARCHAR), CAST(a AS VARCHAR), round(dur, 3) FROM up")
def gtfs_footpaths(spark, sf):
    """Walks between platforms and their stations, both ways."""
    return gtfs.read_gtfs(spark, _feed(spark, sf)).footpaths.select("from_stop", "to_stop", _r(F.col("dur_s"), 3).alias("dur_s"))


_RULE = "CASE WHEN stop_id % 5 < 4 THEN stop_id % 5 ELSE 0 END AS kind, CASE WHEN stop_id % 3 = 0 THEN 0 WHEN stop_id % 3 = 1 THEN 30 END AS least"


@_query(with_views("stops") + f""", r AS (SELECT *, {_RULE} FROM stops),
 walks AS (SELECT r.stop_id AS a, t.stop_id AS b, CASE WHEN least > 0 THEN least ELSE {hav('r.lat', 'r.lon', 't.lat', 't.lon')} / 4.5 * 3600 END AS dur FROM r JOIN stops t ON t.stop_id = r.stop_id + 1 WHERE kind <> 3),
 up AS (SELECT c.stop_id AS a, p.stop_id AS b, {hav('c.lat', 'c.lon', 'p.lat', 'p.lon')} / 4.5 * 3600 AS dur FROM stops c JOIN stops p ON p.stop_id = c.stop_id - 1 WHERE c.stop_id % 10 = 3),
 f AS (SELECT a, b, min(dur) AS dur FROM (SELECT * FROM walks UNION ALL SELECT * FROM up UNION ALL SELECT b, a, dur FROM up) x GROUP BY a, b)
 SELECT CAST(a AS VARCHAR) AS from_stop, CAST(b AS VARCHAR) AS to_stop, round(dur, 3) AS seconds FROM f
 UNION ALL SELECT CAST(stop_id AS VARCHAR), CAST(stop_id AS VARCHAR), CAST(CASE WHEN kind = 3 THEN NULL WHEN kind = 1 THEN 0 WHEN least IS NOT NULL THEN least WHEN stop_id % 2 = 0 THEN min_transfer_s ELSE 300 END AS DOUBLE) FROM r""")
def gtfs_transfers(spark, sf):
    """Changes at a stop and walks between stops, by rules of all types, with times of 0 and 30 s, blank and negative ones; several for a stop."""
    t = gtfs.read_gtfs(spark, _feed(spark, sf, rules=True))
    own = t.stops.select(F.col("stop_id").alias("from_stop"), F.col("stop_id").alias("to_stop"), F.col("min_transfer_s").cast("double").alias("seconds"))
    return t.footpaths.select("from_stop", "to_stop", _r(F.col("dur_s"), 3).alias("seconds")).unionByName(own)


def _flight_files(spark, sf):
    """Airports and routes as headerless files, with doubles, gaps and strange zones."""
    stops, path = view(spark, sf, "stops"), _folder(spark, "flights")
    null = F.lit("\\N")
    code = lambda c: F.lpad(c.cast("string"), 5, "A")
    rows = stops.select(F.col("stop_id").alias("id"), "name", F.lit("City").alias("city"), F.lit("Land").alias("country"), F.when(F.col("stop_id") % 13 == 0, null).otherwise(code(F.col("stop_id"))).alias("iata"), null.alias("icao"), F.when(F.col("stop_id") % 17 == 0, null).otherwise(F.col("lat").cast("string")).alias("lat"), F.col("lon").cast("string").alias("lon"), null.alias("alt"), null.alias("off"), null.alias("dst"), F.when(F.col("stop_id") % 7 == 0, "Mars/Olympus").otherwise(F.coalesce("tz", null)).alias("tz"), null.alias("type"), null.alias("source"))
    rows.coalesce(1).write.csv(f"{path}/airports")
    pairs = _pairs(spark, sf).withColumn("again", F.explode(F.array(F.lit("0"), F.lit("0"), F.lit("1"))))
    pairs.select(F.lit("XX").alias("a"), F.lit("1").alias("b"), code(F.col("src")).alias("src"), F.lit("1").alias("c"), code(F.col("dst")).alias("dst"), F.lit("1").alias("d"), F.lit("").alias("e"), "again", F.lit("738").alias("f")).write.csv(f"{path}/routes")
    return flights.read_airports(spark, f"{path}/airports"), flights.read_routes(spark, f"{path}/routes")


_KNOWN = _PAIRS + ", air AS (SELECT stop_id, lpad(CAST(stop_id AS VARCHAR), 5, 'A') AS iata, name, lat, lon, CASE WHEN stop_id % 7 <> 0 THEN tz END AS tz FROM stops WHERE stop_id % 13 <> 0 AND stop_id % 17 <> 0), k AS (SELECT a.iata AS src, b.iata AS dst FROM pairs JOIN air a ON a.stop_id = src JOIN air b ON b.stop_id = dst)"


@_query(_KNOWN + " SELECT iata, name, round(lat, 6) AS lat, round(lon, 6) AS lon, tz FROM air")
def airport_file(spark, sf):
    return _flight_files(spark, sf)[0].select("iata", "name", _r(F.col("lat")).alias("lat"), _r(F.col("lon")).alias("lon"), "tz")


@_query(_KNOWN + ", g AS (SELECT iata FROM (SELECT src AS iata FROM k UNION ALL SELECT dst FROM k) x GROUP BY iata HAVING count(*) >= 8) SELECT src, dst FROM k WHERE src IN (SELECT iata FROM g) AND dst IN (SELECT iata FROM g)")
def flight_network(spark, sf):
    """Non-stop routes of known airports, trimmed to those with eight routes or more."""
    airports, routes = _flight_files(spark, sf)
    return flights.trimmed(flights.route_pairs(routes, airports), 8)


@_query(_PAIRS + f", deg AS (SELECT iata, count(*) AS degree FROM (SELECT src AS iata FROM pairs UNION ALL SELECT dst FROM pairs) x GROUP BY iata HAVING count(*) >= 5), spots AS (SELECT n_nationkey AS point, CAST(45 + n_nationkey % 6 AS DOUBLE) AS lat, CAST(3 + n_nationkey % 9 AS DOUBLE) AS lon FROM nation), near AS (SELECT DISTINCT stop_id AS iata FROM spots, stops s WHERE {hav('spots.lat', 'spots.lon', 's.lat', 's.lon')} <= 60), h AS (SELECT point, iata, row_number() OVER (PARTITION BY point ORDER BY degree DESC, iata DESC) AS r FROM spots, stops s JOIN deg ON iata = stop_id WHERE {hav('spots.lat', 'spots.lon', 's.lat', 's.lon')} <= 400) SELECT iata FROM near UNION SELECT iata FROM h WHERE r <= 3")
def airport_keep(spark, sf):
    """Airports around some points, and the hubs farther around them."""
    k = F.col("n_nationkey")
    points = spark.read.parquet(f"{sf}/nation.parquet").select(k.alias("point"), (45 + k % 6).cast("double").alias("lat"), (3 + k % 9).cast("double").alias("lon"))
    return flights.keep_set(points, _airports(spark, sf), flights.degrees(_pairs(spark, sf)), 60, least=5, km=400, k=3)


_CATALOG = "SELECT c_custkey AS id, c_custkey % 900 AS feed, CASE WHEN c_custkey % 5 = 0 THEN 'gtfs-rt' ELSE 'gtfs' END AS kind, CASE c_custkey % 7 WHEN 0 THEN 'inactive' WHEN 1 THEN 'deprecated' ELSE '' END AS status, CASE WHEN c_custkey % 11 = 0 THEN '2' WHEN c_custkey % 2 = 0 THEN '0' ELSE '' END AS auth, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'http://latest/' || c_custkey ELSE '' END AS latest, CASE WHEN c_custkey % 4 < 3 THEN 'http://direct/' || c_custkey ELSE '' END AS direct, CASE WHEN c_custkey % 19 > 0 THEN '' || (c_custkey % 40) ELSE '' END AS lat0 FROM customer"


@_query(f"WITH c AS ({_CATALOG}), u AS (SELECT *, coalesce(nullif(latest, ''), nullif(direct, '')) AS url FROM c WHERE kind = 'gtfs' AND status = '' AND auth IN ('', '0') AND lat0 <> '') SELECT CAST(feed AS VARCHAR) AS feed_id, arg_max(name, id) AS name, arg_max(url, id) AS url, arg_max(CAST(lat0 AS DOUBLE), id) AS lat0 FROM u WHERE url IS NOT NULL GROUP BY feed")
def feed_catalog(spark, sf):
    """Usable feeds of a catalog file, the last of each id."""
    path = _folder(spark, "catalog")
    c = spark.sql(_CATALOG.replace("FROM customer", "FROM {t}"), t=spark.read.parquet(f"{sf}/customer.parquet"))
    box = catalogs.BOX
    c = c.orderBy("id").select(F.col("kind").alias("data_type"), "status", F.col("auth").alias("urls.authentication_type"), F.col("latest").alias("urls.latest"), F.col("direct").alias("urls.direct_download"), F.col("feed").alias("mdb_source_id"), F.lit("p").alias("provider"), "name", F.col("lat0").alias(f"{box}minimum_latitude"), F.lit("1").alias(f"{box}minimum_longitude"), F.lit("60").alias(f"{box}maximum_latitude"), F.lit("9").alias(f"{box}maximum_longitude"))
    c.coalesce(1).write.option("header", True).csv(path)
    return catalogs.read_feeds(spark, path).select("feed_id", "name", "url", "lat0")


@_query(with_views("doors") + f", {_BOXES} SELECT DISTINCT CAST(door // 2 AS BIGINT) AS pair, feed_id FROM doors JOIN boxes ON lat BETWEEN lat0 AND lat1 AND lon BETWEEN lon0 AND lon1")
def feeds_touch(spark, sf):
    """Boxes that hold one end of a trip at least."""
    return spatial.touching(_trips_of(spark, sf), _boxes(spark, sf), "pair", "feed_id")


def _timetable(spark, sf) -> feeds.Timetable:
    text = lambda df, *cols: df.withColumns({c: F.col(c).cast("string") for c in cols})
    return feeds.Timetable(text(view(spark, sf, "stops"), "stop_id"), text(view(spark, sf, "trips"), "trip_id"), text(view(spark, sf, "calls"), "trip_id", "stop_id"), text(_network(spark, sf)[2], "from_stop", "to_stop"))


def _shifted(t: feeds.Timetable) -> feeds.Timetable:
    """A second feed with the same stop ids, some of them elsewhere, and partly the same trip ids."""
    lat = F.col("lat") + F.col("stop_id").cast("long") % 3 * 0.02
    trip = lambda df: df.withColumn("trip_id", F.when(F.col("trip_id").cast("long") % 2 == 0, F.concat(F.lit("x"), "trip_id")).otherwise(F.col("trip_id")))
    return feeds.Timetable(t.stops.withColumn("lat", lat), trip(t.trips), trip(t.calls), t.footpaths)


@_query(with_views("stops", "calls") + f", far AS (SELECT stop_id FROM stops WHERE {hav('lat', 'lon', '(lat + stop_id % 3 * 0.02)', 'lon')} > 1) SELECT CAST(trip_id AS VARCHAR) AS trip_id, seq, CAST(stop_id AS VARCHAR) AS stop_id FROM calls UNION ALL SELECT 'x' || trip_id, seq, CASE WHEN stop_id IN (SELECT stop_id FROM far) THEN stop_id || '#1' ELSE CAST(stop_id AS VARCHAR) END FROM calls WHERE trip_id % 2 = 0")
def merge_feeds(spark, sf):
    """Calls of two merged timetables: equal trip ids count once, stops elsewhere under a known id are renamed."""
    t = _timetable(spark, sf)
    return feeds.merge([t, _shifted(t)]).calls.select("trip_id", "seq", "stop_id")


@_query(with_views("stops", "calls") + f", {_FEET}, box AS (SELECT stop_id FROM stops WHERE lat BETWEEN 46 AND 50 AND lon BETWEEN 4 AND 12), kept AS (SELECT trip_id FROM calls WHERE stop_id IN (SELECT stop_id FROM box) GROUP BY trip_id HAVING count(*) >= 2), way AS (SELECT from_stop AS a, to_stop AS b FROM feet UNION SELECT to_stop, from_stop FROM feet), found AS (SELECT DISTINCT stop_id FROM calls WHERE trip_id IN (SELECT trip_id FROM kept) AND stop_id IN (SELECT stop_id FROM stops) UNION SELECT b FROM found JOIN way ON a = stop_id WHERE b IN (SELECT stop_id FROM box)) SELECT CAST(stop_id AS VARCHAR) AS stop_id FROM found")
def clip_stops(spark, sf):
    """Stops of a timetable clipped to a corridor, with those that walks join to it."""
    return feeds.clip(_timetable(spark, sf), 46, 4, 50, 12).stops.select("stop_id")


@_query(with_views("calls") + " SELECT max(dep_s) AS dep_s FROM calls")
def latest_offset(spark, sf):
    return feeds.most_offset(view(spark, sf, "calls"))


@_query(with_views("stops", "calls") + f", box AS (SELECT stop_id FROM stops WHERE lat BETWEEN CAST(46.0 AS DOUBLE) - 0.6 AND CAST(50.0 AS DOUBLE) + 0.6 AND lon BETWEEN CAST(4.0 AS DOUBLE) - 0.6 AND CAST(12.0 AS DOUBLE) + 0.6), kept AS (SELECT trip_id FROM calls WHERE stop_id IN (SELECT stop_id FROM box) GROUP BY trip_id HAVING count(*) >= 2) SELECT count(*) AS trips FROM kept")
def compose_trips(spark, sf):
    """Trips of a timetable composed for a corridor from one feed and the same feed again."""
    t = _timetable(spark, sf)
    whole, _ = feeds.compose([(46.0, 4.0), (50.0, 12.0)], None, [t, t])
    return whole.trips.agg(F.count("*").alias("trips"))


_FEEDS = _COVER.replace("pair, lat, lon FROM doors)", "pair, lat, lon FROM doors WHERE door >= 2)") + """, tried AS (SELECT * FROM (SELECT pair, feed_id, row_number() OVER (PARTITION BY pair ORDER BY area, feed_id) AS place FROM c) x WHERE place <= 4),
 box AS (SELECT pair, min(lat) - CAST(0.6 AS DOUBLE) AS a0, min(lon) - CAST(0.6 AS DOUBLE) AS o0, max(lat) + CAST(0.6 AS DOUBLE) AS a1, max(lon) + CAST(0.6 AS DOUBLE) AS o1 FROM p GROUP BY pair),
 served AS (SELECT pair, feed_id, trip_id, count(*) AS k FROM tried JOIN box USING (pair) JOIN calls ON trip_id % 25 = feed_id JOIN stops USING (stop_id) WHERE lat BETWEEN a0 AND a1 AND lon BETWEEN o0 AND o1 GROUP BY ALL HAVING count(*) >= 2),
 n AS (SELECT pair, feed_id, place, count(trip_id) AS n_trips FROM tried LEFT JOIN served USING (pair, feed_id) GROUP BY ALL),
 t AS (SELECT *, sum(n_trips) OVER w AS total, coalesce(sum(n_trips) OVER (PARTITION BY pair ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n WINDOW w AS (PARTITION BY pair ORDER BY place)),
 f AS (SELECT *, max(CASE WHEN n_trips > 0 AND before > 0 AND total > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY pair ORDER BY place) AS beyond FROM t)"""


@_query(with_views("stops", "calls") + ", " + _FEEDS.split("RECURSIVE ", 1)[1].replace(", n AS (SELECT pair, count(*) AS k FROM p GROUP BY pair)", ", np AS (SELECT pair, count(*) AS k FROM p GROUP BY pair)").replace("JOIN n USING (pair, k)", "JOIN np USING (pair, k)") + " SELECT CAST(pair AS BIGINT) AS request, feed_id, CAST(place AS INTEGER) AS place, n_trips, n_trips > 0 AND beyond = 0 AS kept FROM f UNION ALL SELECT DISTINCT CAST(pair AS BIGINT), NULL, NULL, NULL, FALSE FROM p WHERE pair NOT IN (SELECT pair FROM tried)")
def auto_timetables(spark, sf):
    """For every trip between two doors the feeds tried, smallest first, their trips in its corridor, and which are kept of 300 trips."""
    d = view(spark, sf, "doors").where("door >= 2")
    a, b = (d.where(F.col("door") % 2 == k).select(F.floor(F.col("door") / 2).cast("long").alias("request"), F.col("lat").alias(f"lat{n}"), F.col("lon").alias(f"lon{n}")) for k, n in ((0, ""), (1, "2")))
    both = a.join(b, "request", "left").withColumns({"lat2": F.coalesce("lat2", "lat"), "lon2": F.coalesce("lon2", "lon")})  # the last door may be alone
    calls = view(spark, sf, "calls").withColumn("feed_id", F.col("trip_id") % 25)
    stops = calls.select("feed_id", "stop_id").distinct().join(view(spark, sf, "stops"), "stop_id")
    return compose.compose_each(both, _boxes(spark, sf), stops, calls, most_trips=300)[0].select("request", "feed_id", "place", "n_trips", "kept")


@_query(_KNOWN + f""", f AS (SELECT src || '-' || dst || '@' || printf('%02d', h) AS trip_id, src, dst, h * 3600 AS dep, h * 3600 + 2700 + {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} / 800 * 3600 AS arr FROM k JOIN air a ON a.iata = src JOIN air b ON b.iata = dst, (VALUES (8), (14), (20)) v(h)),
 c AS (SELECT trip_id, 1 AS seq, src AS stop_id, CAST(dep AS BIGINT) AS dep_s FROM f UNION ALL SELECT trip_id, 2, dst, CAST(round_even(arr, 0) AS BIGINT) FROM f)
 SELECT trip_id, CAST(seq AS INTEGER) AS seq, c.stop_id, dep_s, tz FROM c JOIN air ON iata = c.stop_id""")
def flight_timetable(spark, sf):
    """Calls of the flight network as a timetable, with the zones of their airports."""
    airports, routes = _flight_files(spark, sf)
    t = flights.timetable(airports, flights.route_pairs(routes, airports))
    return t.calls.join(t.stops.select("stop_id", "tz"), "stop_id").select("trip_id", "seq", "stop_id", "dep_s", "tz")


@_query("SELECT n, tier FROM (SELECT p_partkey AS n, p_name, CASE WHEN lower(substr(p_name, 1, 3)) = 'blu' THEN 0 WHEN starts_with(lower(p_name), 'blu') OR starts_with(lower(p_brand), 'blu') THEN 1 WHEN contains(lower(p_name), 'blu') OR contains(lower(p_brand), 'blu') THEN 2 END AS tier FROM part) x WHERE tier IS NOT NULL ORDER BY tier, CASE WHEN tier = 1 THEN lower(p_name) END, n LIMIT 8")
def airport_search(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.substring("p_name", 1, 3).alias("iata"), F.col("p_name").alias("name"), F.col("p_brand").alias("city"), F.col("p_partkey").alias("n"))
    return catalogs.search_airports(p, " BLU ").select("n", "tier")


@_query(with_views("stops") + " SELECT stop_id, name FROM stops WHERE stop_type <> 'airport' AND contains(lower(name), '00001') ORDER BY CASE WHEN starts_with(lower(name), '00001') THEN 0 ELSE 1 END, lower(name), stop_id LIMIT 5")
def stop_search(spark, sf):
    return catalogs.search_stops(view(spark, sf, "stops"), "00001", 5).select("stop_id", "name")


@_query("""SELECT event_id, round(CASE WHEN c = 'ferry' THEN 1.0 WHEN holiday THEN greatest(1.0, a * CASE WHEN h >= 22 OR h <= 5 THEN 0.95 ELSE 1.0 END) ELSE greatest(1.0, a * CASE WHEN f > 1 AND brk THEN 1 + (f - 1) * 0.5 ELSE f END) END, 6) AS factor FROM (
 SELECT *, CAST(CASE WHEN isodow(ts) <= 5 THEN CASE WHEN h IN (7, 8, 16, 17, 18) THEN CASE WHEN c = 'motorway' THEN 1.2 ELSE 1.45 END WHEN h >= 22 OR h <= 5 THEN 0.95 ELSE 1.0 END ELSE CASE WHEN h BETWEEN 11 AND 17 THEN CASE WHEN c = 'motorway' THEN 1.05 ELSE 1.15 END WHEN h >= 22 OR h <= 6 THEN 0.95 ELSE 1.0 END END AS DOUBLE) AS f, CAST(CASE c WHEN 'motorway' THEN 1.05 WHEN 'residential' THEN 1.82 ELSE 1.0 END AS DOUBLE) AS a
 FROM (SELECT event_id, ts, hour(ts) AS h, day(ts) IN (1, 15) AS holiday, day(ts) BETWEEN 20 AND 28 AS brk, CASE event_id % 3 WHEN 0 THEN 'motorway' WHEN 1 THEN 'residential' ELSE 'ferry' END AS c FROM events) x) y""")
def speed_calendar(spark, sf):
    """Slowdowns with a table of holidays and school breaks."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    days = e.select(F.col("ts").cast("date").alias("day")).distinct().select("day", F.explode(F.array(F.when(F.day("day").isin(1, 15), "holiday"), F.when(F.day("day").between(20, 28), "school_break"))).alias("kind")).where("kind is not null")
    c = F.when(F.col("event_id") % 3 == 0, "motorway").when(F.col("event_id") % 3 == 1, "residential").otherwise("ferry")
    return pricing.with_calendar(e, "ts", days).select("event_id", _r(pricing.speed_factor(c, F.col("ts"), F.col("holiday"), F.col("school_break"))).alias("factor"))


@_query(with_views("legs") + ", r AS (SELECT * FROM (VALUES ('walk', 0.0, 0.0), ('train', 3.0, 0.2), ('flight', 80.0, 0.01)) v(mode, base, rate)) SELECT request, cand, round(sum(round(greatest(0.0, CAST(coalesce(base, 0.0) + coalesce(rate, 0.2) * km AS DOUBLE)), 2)), 2) AS cost FROM legs LEFT JOIN r USING (mode) GROUP BY request, cand")
def fare_model(spark, sf):
    """Metrics with fares from a table of another operator."""
    rates = spark.createDataFrame([("walk", 0.0, 0.0), ("train", 3.0, 0.2), ("flight", 80.0, 0.01)], "mode string, base double, per_km double")
    return planner.metrics(view(spark, sf, "legs"), pricing.table_fare(rates)).select("request", "cand", "cost")


@_query(with_views("arcs") + " SELECT arc, CAST(round_even(base_seconds * CASE class WHEN 'ferry' THEN 1.0 WHEN 'motorway' THEN 2.0 ELSE 1.25 END, 0) AS BIGINT) AS seconds FROM arcs WHERE season <> 'O'")
def speed_model(spark, sf):
    """Arc weights with another model of slowdowns."""
    return road.arc_weights(_arcs(spark, sf), 1, lambda c: F.when(c == "motorway", 2.0).otherwise(1.25)).select("arc", "seconds")


@_query(_WEIGHTS + " SELECT arc, CASE WHEN arc % 5 = 1 THEN base_seconds ELSE seconds END AS seconds FROM w WHERE arc % 5 <> 0")
def road_overrides(spark, sf):
    """Arc weights with one named road closed and another opened at its base time."""
    name = F.when(F.col("arc") % 5 == 0, "pass").when(F.col("arc") % 5 == 1, "tunnel")
    arcs = road.arc_weights(_arcs(spark, sf), 1).withColumn("name", name)
    return road.with_overrides(road.with_overrides(arcs, road.close_named(arcs, ["pass"])), road.open_named(arcs, ["tunnel"])).select("arc", "seconds")


@_query(_METRICS + """, best AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY total_s, cost, transfers, cand) AS rank FROM cands)
 SELECT request, cand, CAST(rank AS INTEGER) AS rank, primary_mode, '2026-07-01T08:00:00' AS depart_at, strftime(TIMESTAMP '2026-07-01 08:00:00' + to_seconds(total_s), '%Y-%m-%dT%H:%M:%S') AS arrive_at, total_s AS total_duration_s,
  CASE WHEN m = 0 THEN '0m' ELSE concat_ws(' ', CASE WHEN m // 1440 > 0 THEN (m // 1440) || 'd' END, CASE WHEN m // 60 % 24 > 0 THEN (m // 60 % 24) || 'h' END, CASE WHEN m % 60 > 0 THEN (m % 60) || 'm' END) END AS total_duration_human, km, cost_level, cost AS fare_estimate, transfers AS num_transfers
 FROM (SELECT *, total_s // 60 AS m FROM best WHERE rank <= 3) x""")
def itinerary_rows(spark, sf):
    """Records of the three fastest candidates of each request."""
    return results.itinerary_records(planner.rank(_cands(spark, sf), "fastest", 3), F.lit(8 * 3600), "2026-07-01")


@_query(with_views("legs", "stops") + " SELECT request, cand, leg_no, CASE WHEN mode IN ('train', 'ferry', 'flight') THEN upper(mode[1]) || mode[2:] || ' from ' || a || ' to ' || b ELSE CASE mode WHEN 'car' THEN 'Drive' ELSE 'Walk' END || ' to ' || b END AS step FROM (SELECT *, 'Stop ' || leg_no AS a, 'Stop ' || (leg_no + 1) AS b FROM legs) x")
def leg_steps(spark, sf):
    legs = view(spark, sf, "legs")
    a, b = (F.concat(F.lit("Stop "), c.cast("string")) for c in (F.col("leg_no"), F.col("leg_no") + 1))
    return legs.select("request", "cand", "leg_no", results.describe(F.col("mode"), a, b).alias("step"))


@_query(_METRICS + ", best AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY emissions, car_km, total_s, transfers, cost, cand) AS rank FROM cands) SELECT request, cand, modes, total_s, legs FROM best WHERE rank <= 2")
def itinerary_json(spark, sf):
    """Itineraries as JSON and read again."""
    legs = view(spark, sf, "legs")
    ranked = planner.rank(_cands(spark, sf), "greenest", 2)
    told = results.as_json(results.itinerary_records(ranked, F.lit(0), "2026-07-01"), legs)
    back = told.select("request", "cand", F.from_json("json", "total_duration_s long, legs array<struct<leg_no:long,mode:string>>").alias("j"))
    return back.select("request", "cand", F.array_join(F.transform("j.legs", lambda x: x["mode"]), ",").alias("modes"), F.col("j.total_duration_s").alias("total_s"), F.size("j.legs").cast("long").alias("legs"))


@_query("SELECT coalesce(CASE WHEN n_nationkey % 2 = 1 THEN 'Agency ' || n_nationkey END, CASE WHEN n_nationkey % 3 > 0 THEN n_name END, 'feed ' || n_nationkey) || CASE WHEN n_regionkey > 0 THEN ' (R' || n_regionkey || ')' ELSE '' END || ' <' || CASE WHEN n_nationkey % 4 = 0 THEN 'http://terms/' ELSE 'http://feed/' END || n_nationkey || '>' AS line FROM nation UNION ALL SELECT * FROM (VALUES ('OpenFlights: Open Database License (ODbL) v1.0 <https://opendatacommons.org/licenses/odbl/1-0/>'), ('Mobility Database (MobilityData) -- GTFS feed catalog: catalog metadata under CC0 1.0; each feed under its own license <https://creativecommons.org/publicdomain/zero/1.0/>')) v(line)")
def attribution_lines(spark, sf):
    """Credits of a result that used flights and feeds but no roads."""
    k = F.col("n_nationkey")
    f = spark.read.parquet(f"{sf}/nation.parquet").select(
        k.alias("feed_id"), F.when(k % 2 == 1, F.concat(F.lit("Agency "), k.cast("string"))).alias("provider"), F.when(k % 3 > 0, F.col("n_name")).otherwise("").alias("name"), F.when(F.col("n_regionkey") > 0, F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))).alias("country"),
        F.concat(F.lit("http://feed/"), k.cast("string")).alias("url"), F.when(k % 4 == 0, F.concat(F.lit("http://terms/"), k.cast("string"))).otherwise("").alias("license_url"),
    )
    return results.credits(spark, f, road=False).select("line")
