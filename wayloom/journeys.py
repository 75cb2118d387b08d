"""The queries of the journey operators over the domain views, each beside SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions import geo, parsing, pricing, validity
from wayloom.operators import connectors, contracts, overlay, planner, restrictions, road, search, spatial, timetable, transit, ways
from wayloom.operators.fixpoint import written
from wayloom.plans.domain import ACTIVE, VIEWS, calendars, hav, view, with_views
from wayloom.shipping import ship
from wayloom.sources import catalogs, flights

_Q: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _r(c, n: int = 6):
    return F.round(c, n)


@_query(with_views("stops", "doors") + f" SELECT door, stop_id, round({hav('d.lat', 'd.lon', 's.lat', 's.lon')}, 6) AS km FROM doors d JOIN stops s ON s.stop_id = d.door % 100")
def haversine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    d, s = view(spark, sf, "doors"), view(spark, sf, "stops").toDF("stop_id", "name", "lat2", "lon2", "t", "m", "tz")
    return d.join(s, F.col("stop_id") == F.col("door") % 100).select("door", "stop_id", _r(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).alias("km"))


@_query(with_views("stops", "doors") + """, b AS (SELECT door, stop_id, (degrees(atan2(sin(radians(s.lon - d.lon)) * cos(radians(s.lat)), cos(radians(d.lat)) * sin(radians(s.lat)) - sin(radians(d.lat)) * cos(radians(s.lat)) * cos(radians(s.lon - d.lon)))) + 360) AS b FROM doors d JOIN stops s ON s.stop_id = d.door % 100),
 n AS (SELECT door, stop_id, b - 360 * floor(b / 360) AS b FROM b),
 t AS (SELECT *, (90 - b + 180) - 360 * floor((90 - b + 180) / 360) - 180 AS a FROM n)
 SELECT door, stop_id, round(b, 4) AS bearing, round(CASE WHEN a = -180 THEN 180 ELSE a END, 4) AS turn FROM t""")
def bearings_turns(spark, sf):
    d, s = view(spark, sf, "doors"), view(spark, sf, "stops").toDF("stop_id", "name", "lat2", "lon2", "t", "m", "tz")
    b = geo.bearing(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return d.join(s, F.col("stop_id") == F.col("door") % 100).select("door", "stop_id", _r(b, 4).alias("bearing"), _r(geo.turn_angle(b, F.lit(90.0)), 4).alias("turn"))


@_query("SELECT p_partkey AS part, round((least(p_size * 9, 30) / 60.0 + greatest(least(p_size * 9, 150) - 30, 0) / 80.0 + greatest(p_size * 9 - 150, 0) / 100.0) * 3600, 4) AS seconds, round(p_size * 9 * CAST(1.3 AS DOUBLE), 4) AS road_km FROM part")
def drive_bands(spark, sf):
    km = (F.col("p_size") * 9).cast("double")
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("part"), _r(geo.drive_seconds(km), 4).alias("seconds"), _r(geo.road_km(km), 4).alias("road_km"))


@_query(with_views("trips") + f" SELECT trip_id, mode, d AS day FROM (SELECT *, CAST(unnest(generate_series(DATE '1998-06-25', DATE '1998-07-05', INTERVAL 1 DAY)) AS DATE) AS d FROM trips) x WHERE {ACTIVE}")
def validity_active(spark, sf):
    return timetable.active_days(calendars(view(spark, sf, "trips")), "1998-06-25", "1998-07-05", [])


@_query(with_views("trips") + f" SELECT trip_id, mode, d AS day FROM (SELECT *, CAST(unnest(generate_series(DATE '1998-06-25', DATE '1998-07-05', INTERVAL 1 DAY)) AS DATE) AS d FROM trips) x WHERE {ACTIVE} AND season <> 'P'")
def validity_conditions(spark, sf):
    """Days on which trips run while there is a strike: those that a strike forbids don't."""
    return timetable.active_days(calendars(view(spark, sf, "trips")), "1998-06-25", "1998-07-05", ["strike"])


@_query(with_views("calls") + " SELECT trip_id FROM (SELECT trip_id, seq, arr_s, dep_s, lag(dep_s) OVER (PARTITION BY trip_id ORDER BY seq) AS p FROM calls) x GROUP BY trip_id HAVING count(*) >= 2 AND NOT bool_or(arr_s > dep_s OR coalesce(arr_s < p, FALSE))")
def monotone_trips(spark, sf):
    return timetable.valid_trips(view(spark, sf, "calls"))


_CONN = with_views("trips", "calls") + f""", good AS (SELECT trip_id FROM (SELECT trip_id, arr_s, dep_s, lag(dep_s) OVER (PARTITION BY trip_id ORDER BY seq) AS p FROM calls) x GROUP BY trip_id HAVING count(*) >= 2 AND NOT bool_or(arr_s > dep_s OR coalesce(arr_s < p, FALSE))),
 seg AS (SELECT * FROM (SELECT trip_id, seq, stop_id AS dep_stop, dep_s, lead(stop_id) OVER w AS arr_stop, lead(arr_s) OVER w AS arr_s FROM calls WHERE trip_id IN (SELECT trip_id FROM good) WINDOW w AS (PARTITION BY trip_id ORDER BY seq)) z WHERE arr_stop IS NOT NULL AND arr_s > dep_s),
 days AS (SELECT trip_id, mode, d FROM (SELECT *, CAST(unnest(generate_series(DATE '1998-06-30', DATE '1998-07-01', INTERVAL 1 DAY)) AS DATE) AS d FROM trips) x WHERE {ACTIVE}),
 c AS (SELECT trip_id || '@' || d AS run_id, trip_id, mode, seq, dep_stop, arr_stop, CAST(d AS TIMESTAMP) + to_seconds(dep_s) AS dep, CAST(d AS TIMESTAMP) + to_seconds(arr_s) AS arr FROM days JOIN seg USING (trip_id)),
 w AS (SELECT * FROM c WHERE dep >= TIMESTAMP '1998-07-01 00:00:00'),
 conns AS (SELECT * FROM w WHERE run_id IN (SELECT run_id FROM w WHERE dep <= TIMESTAMP '1998-07-01 12:00:00'))"""


@_query(_CONN + " SELECT * FROM conns")
def connections_window(spark, sf):
    return timetable.connections(calendars(view(spark, sf, "trips")), view(spark, sf, "calls"), "1998-07-01 00:00:00", "1998-07-01 12:00:00", [])


_UTC = """timezone('UTC', timezone(zone, CAST(d AS TIMESTAMP) + to_seconds({s})))"""


@_query(with_views("stops", "trips", "calls") + f""", feed AS (SELECT tz FROM stops WHERE tz IS NOT NULL GROUP BY tz ORDER BY count(*) DESC, min(stop_id) LIMIT 1),
 zones AS (SELECT trip_id, coalesce(tz, (SELECT tz FROM feed)) AS zone FROM (SELECT trip_id, arg_min(stop_id, seq) AS stop_id FROM calls GROUP BY trip_id) f JOIN stops USING (stop_id)),
 good AS (SELECT trip_id FROM (SELECT trip_id, arr_s, dep_s, lag(dep_s) OVER (PARTITION BY trip_id ORDER BY seq) AS p FROM calls) x GROUP BY trip_id HAVING count(*) >= 2 AND NOT bool_or(arr_s > dep_s OR coalesce(arr_s < p, FALSE))),
 seg AS (SELECT * FROM (SELECT trip_id, seq, stop_id AS dep_stop, dep_s, lead(stop_id) OVER w AS arr_stop, lead(arr_s) OVER w AS arr_s FROM calls WHERE trip_id IN (SELECT trip_id FROM good) WINDOW w AS (PARTITION BY trip_id ORDER BY seq)) z WHERE arr_stop IS NOT NULL),
 days AS (SELECT trip_id, mode, d FROM (SELECT *, CAST(unnest(generate_series(DATE '1998-03-28', DATE '1998-03-31', INTERVAL 1 DAY)) AS DATE) AS d FROM trips) x WHERE {ACTIVE}),
 c AS (SELECT trip_id || '@' || d AS run_id, trip_id, mode, seq, dep_stop, arr_stop, {_UTC.format(s='dep_s')} AS dep, {_UTC.format(s='arr_s')} AS arr FROM days JOIN seg USING (trip_id) JOIN zones USING (trip_id)),
 w AS (SELECT * FROM c WHERE arr > dep AND dep >= TIMESTAMP '1998-03-29 00:00:00')
 SELECT * FROM w WHERE run_id IN (SELECT run_id FROM w WHERE dep <= TIMESTAMP '1998-03-30 00:00:00')""")
def zoned_connections(spark, sf):
    """Connections in UTC of a day on which summer time begins in two of three zones; trips take the zone of their first stop."""
    return timetable.connections(calendars(view(spark, sf, "trips")), view(spark, sf, "calls"), "1998-03-29 00:00:00", "1998-03-30 00:00:00", [], view(spark, sf, "stops"))


def _network(spark, sf, end="1998-07-01 23:59:59"):
    c = timetable.connections(calendars(view(spark, sf, "trips")), view(spark, sf, "calls"), "1998-07-01 00:00:00", end, [])
    sec = lambda x: F.timestamp_diff("SECOND", F.lit("1998-07-01 00:00:00").cast("timestamp_ntz"), x)
    conns = c.select("run_id", "mode", "seq", "dep_stop", "arr_stop", sec(F.col("dep")).alias("dep"), sec(F.col("arr")).alias("arr"))
    stops = view(spark, sf, "stops")
    feet = stops.select(F.col("stop_id").alias("from_stop"), F.explode(F.array(F.col("stop_id") + 1, F.col("stop_id") - 1)).alias("to_stop"), (240 + F.col("stop_id") % 5 * 60).cast("long").alias("dur_s"))
    feet = feet.join(stops.select(F.col("stop_id").alias("to_stop")), "to_stop", "left_semi").where("from_stop % 3 = 0")
    return conns, stops, feet.select("from_stop", "to_stop", "dur_s")


_FEET = "feet AS (SELECT f.stop_id AS from_stop, t.stop_id AS to_stop, CAST(240 + f.stop_id % 5 * 60 AS BIGINT) AS dur_s FROM stops f JOIN stops t ON t.stop_id IN (f.stop_id + 1, f.stop_id - 1) WHERE f.stop_id % 3 = 0)"


def _closed(feet: str = "feet") -> str:
    return f"hop AS (SELECT from_stop, to_stop, dur_s FROM {feet} UNION SELECT h.from_stop, f.to_stop, h.dur_s + f.dur_s FROM hop h JOIN {feet} f ON h.to_stop = f.from_stop WHERE h.from_stop <> f.to_stop AND h.dur_s + f.dur_s <= 1800), closed AS (SELECT from_stop, to_stop, min(dur_s) AS dur_s FROM hop GROUP BY ALL)"


@_query(with_views("stops") + f", {_FEET}, {_closed()} SELECT * FROM closed")
def footpath_closure(spark, sf):
    return transit.close_footpaths(_network(spark, sf)[2])


def _rounds_sql(k: int, last: str) -> str:
    """k rounds unrolled, with two labels each; requests that leave one stop at one time share a batch of labels."""
    views = [n + " AS (" + with_views(n).split(f"{n} AS (", 1)[1][:-1] + "), " for n in ("stops", "requests")]
    sql = _CONN.replace("1998-07-01 12:00:00", "1998-07-01 23:59:59").replace("RECURSIVE trips", "RECURSIVE " + "".join(views) + "trips")
    sql += f", {_FEET}, {_closed()}, cs AS (SELECT run_id, seq, dep_stop, arr_stop, CAST(epoch(dep) - epoch(TIMESTAMP '1998-07-01 00:00:00') AS BIGINT) AS dep, CAST(epoch(arr) - epoch(TIMESTAMP '1998-07-01 00:00:00') AS BIGINT) AS arr FROM conns)"
    sql += ", l0 AS (SELECT DISTINCT origin * 100000 + depart AS request, origin AS stop, depart AS foot, CAST(NULL AS BIGINT) AS veh FROM requests)"
    for i in range(1, k + 1):
        p = f"l{i - 1}"
        sql += f""", r{i} AS (SELECT request, stop, least(foot, veh + CASE WHEN s.stop_id IS NULL THEN 300 ELSE s.min_transfer_s END) AS ready FROM {p} LEFT JOIN stops s ON s.stop_id = stop),
 b{i} AS (SELECT request, run_id, min(seq) AS f FROM r{i} JOIN cs ON stop = dep_stop AND ready <= dep GROUP BY ALL),
 v{i} AS (SELECT request, arr_stop AS stop, min(arr) AS veh FROM b{i} JOIN cs USING (run_id) WHERE seq >= f GROUP BY ALL),
 w{i} AS (SELECT request, to_stop AS stop, min(veh + dur_s) AS foot FROM v{i} JOIN closed ON stop = from_stop GROUP BY ALL),
 l{i} AS (SELECT request, stop, min(foot) AS foot, min(veh) AS veh FROM (SELECT * FROM {p} UNION ALL SELECT request, stop, NULL, veh FROM v{i} UNION ALL SELECT request, stop, foot, NULL FROM w{i}) u GROUP BY ALL)"""
    return sql + last


def _batches(spark, sf):
    """(requests with their batch, sources of the batches)."""
    r = view(spark, sf, "requests").withColumn("batch", F.col("origin") * 100_000 + F.col("depart"))
    return r, r.select(F.col("batch").alias("request"), F.col("origin").alias("stop"), F.col("depart").alias("at")).distinct()


def _scan(spark, sf, most):
    conns, stops, feet = _network(spark, sf)
    r, sources = _batches(spark, sf)
    return r, *transit.scan(sources, written(conns, "conns"), stops, written(transit.close_footpaths(feet), "feet"), most)


@_query(_rounds_sql(6, " SELECT r.request, CAST(min(n) AS INTEGER) AS vehicles, CAST(arg_min(least(foot, veh), n) AS BIGINT) AS arrive FROM requests r JOIN (" + " UNION ALL ".join(f"SELECT {i} AS n, * FROM l{i}" for i in range(7)) + ") l ON l.request = origin * 100000 + depart AND l.stop = dest GROUP BY r.request"))
def min_transfer_rounds(spark, sf):
    """For every request the fewest vehicles to its destination, up to six, and the arrival with them."""
    r, _, history = _scan(spark, sf, 6)
    first = history.groupBy(F.col("request").alias("batch"), F.col("stop").alias("dest")).agg(F.min(F.struct("round", F.least("foot", "veh").alias("arrive"))).alias("m"))
    return r.join(first, ["batch", "dest"]).select("request", F.col("m.round").alias("vehicles"), "m.arrive")


@_query(_rounds_sql(12, " SELECT r.request, CAST(least(foot, veh) AS BIGINT) AS arrive FROM requests r JOIN l12 l ON l.request = origin * 100000 + depart AND l.stop = dest"))
def earliest_arrival(spark, sf):
    """For every request the earliest arrival at its destination; the twin unrolls 12 rounds."""
    r, labels, _ = _scan(spark, sf, None)
    found = transit.arrivals(labels).select(F.col("request").alias("batch"), F.col("stop").alias("dest"), "arrive")
    return r.join(found, ["batch", "dest"]).select("request", "arrive")


_SECONDS = "CAST(epoch({t}) - epoch(TIMESTAMP '1998-07-01 00:00:00') AS BIGINT)"
_LANES = _CONN.replace("DATE '1998-07-01', INTERVAL", "DATE '1998-07-05', INTERVAL").replace("1998-07-01 12:00:00", "1998-07-05 12:00:00") + f""",
 cs AS (SELECT run_id, mode, seq, dep_stop, arr_stop, {_SECONDS.format(t='dep')} AS dep, {_SECONDS.format(t='arr')} AS arr FROM conns),
 f AS (SELECT *, first_value(dep) OVER (PARTITION BY run_id ORDER BY seq) AS zero, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS pos FROM cs),
 shapes AS (SELECT run_id, string_agg(concat_ws(',', dep_stop, arr_stop, dep - zero, arr - zero), ';' ORDER BY seq) AS shape FROM f GROUP BY run_id)
 SELECT run_id, mode, seq, dep, lag(dep) OVER (PARTITION BY shape, mode, pos ORDER BY dep, run_id) AS since FROM f JOIN shapes USING (run_id)"""


@_query(_LANES)
def boarding_lanes(spark, sf):
    """For every connection of five days the departure of the run before it in its lane: a label that is ready after that boards it."""
    c = timetable.connections(calendars(view(spark, sf, "trips")), view(spark, sf, "calls"), "1998-07-01 00:00:00", "1998-07-05 12:00:00", [])
    sec = lambda x: F.timestamp_diff("SECOND", F.lit("1998-07-01 00:00:00").cast("timestamp_ntz"), x)
    conns = c.select("run_id", "mode", "seq", "dep_stop", "arr_stop", sec(F.col("dep")).alias("dep"), sec(F.col("arr")).alias("arr"))
    return transit.lanes(conns).select("run_id", "mode", "seq", "dep", "since")


_METRICS = with_views("legs") + """, p AS (SELECT *, CASE mode WHEN 'walk' THEN 0.0 WHEN 'car' THEN 0.15 * km WHEN 'train' THEN 2.5 + 0.12 * km WHEN 'ferry' THEN 5.0 + 0.15 * km ELSE 45.0 + 0.07 * km END AS fare,
  km * CASE mode WHEN 'walk' THEN 0.0 WHEN 'car' THEN 170.0 WHEN 'train' THEN 35.0 WHEN 'ferry' THEN 120.0 ELSE 250.0 END AS em, mode IN ('train', 'ferry', 'flight') AS veh FROM legs),
 cands AS (SELECT request, cand, CAST(sum(travel_s + overhead_s) AS BIGINT) AS total_s, CAST(sum(travel_s) AS BIGINT) AS ride_s, sum(km) AS km, round(sum(round(CAST(fare AS DOUBLE), 2)), 2) AS cost, CAST(greatest(0, count(*) FILTER (veh) - 1) AS BIGINT) AS transfers,
  count(*) FILTER (veh) AS vehicles, sum(CASE WHEN mode = 'car' THEN km ELSE 0.0 END) AS car_km, CAST(sum(em) AS DOUBLE) AS emissions, CAST(max(cost_level) AS INTEGER) AS cost_level,
  arg_max(mode, km * 1000 - leg_no) AS primary_mode, count(*) AS legs, CASE WHEN count(*) FILTER (veh) > 0 THEN 0 ELSE 1 END AS no_vehicle, CASE WHEN count(*) FILTER (mode = 'flight') > 0 THEN 0 ELSE 1 END AS no_flight, bool_and(mode = 'walk') AS walk_only,
  sum(km) AS gc_km, bool_or(mode <> 'walk' AND km > 75 AND travel_s > 0 AND km / (travel_s / 3600) < 25) AS crawls, string_agg(mode, ',' ORDER BY leg_no) AS modes
  FROM p GROUP BY request, cand)"""


def _cands(spark, sf):
    return planner.metrics(view(spark, sf, "legs"))


@_query(_METRICS + " SELECT * FROM cands")
def itinerary_metrics(spark, sf):
    return _cands(spark, sf)


@_query(with_views("legs") + " SELECT request, cand, leg_no, CAST(a - travel_s AS BIGINT) AS depart_s, CAST(a AS BIGINT) AS arrive_s FROM (SELECT *, sum(overhead_s + travel_s) OVER (PARTITION BY request, cand ORDER BY leg_no) AS a FROM legs) x")
def running_clock(spark, sf):
    return planner.clock(view(spark, sf, "legs")).select("request", "cand", "leg_no", "depart_s", "arrive_s")


@_query(with_views("legs") + " SELECT request, cand, leg_no, round(CAST(CASE mode WHEN 'walk' THEN 0.0 WHEN 'car' THEN 0.15 * km WHEN 'train' THEN 2.5 + 0.12 * km WHEN 'ferry' THEN 5.0 + 0.15 * km ELSE 45.0 + 0.07 * km END AS DOUBLE), 4) AS fare, round(CAST(km * CASE mode WHEN 'walk' THEN 0.0 WHEN 'car' THEN 170.0 WHEN 'train' THEN 35.0 WHEN 'ferry' THEN 120.0 ELSE 250.0 END AS DOUBLE), 4) AS co2_g FROM legs")
def fare_legs(spark, sf):
    return view(spark, sf, "legs").select("request", "cand", "leg_no", _r(pricing.fare(F.col("mode"), F.col("km")), 4).alias("fare"), _r(pricing.emissions(F.col("mode"), F.col("km")), 4).alias("co2_g"))


@_query(_METRICS + " SELECT * FROM cands WHERE NOT (legs > 10 OR ride_s / 3600.0 > 3 + 180 / 15.0 OR crawls OR gc_km / 180 > 2 OR (walk_only AND km > 10))")
def implausible_guard(spark, sf):
    """Of trips of 180 km; legs' km stand for great circles."""
    return planner.plausible(_cands(spark, sf), F.lit(180.0)).where(planner.walkable())


@_query(_METRICS + " SELECT * EXCLUDE (b) FROM (SELECT *, min(CASE WHEN no_flight = 1 THEN total_s END) OVER (PARTITION BY request) AS b FROM cands) x WHERE b IS NULL OR b > 57600 OR no_flight = 1")
def exclusions(spark, sf):
    return planner.exclude_modes(_cands(spark, sf), F.col("no_flight") == 0)


def _front(axes: list[str]) -> str:
    least, some = " AND ".join(f"o.{a} <= c.{a}" for a in axes), " OR ".join(f"o.{a} < c.{a}" for a in axes)
    return f"SELECT * FROM cands c WHERE NOT EXISTS (SELECT 1 FROM cands o WHERE o.request = c.request AND {least} AND ({some}))"


_AXES = ["total_s", "cost", "transfers", "car_km", "emissions"]


@_query(_METRICS + " " + _front(_AXES[:3]))
def pareto_frontier(spark, sf):
    return planner.frontier(_cands(spark, sf), _AXES[:3])


@_query(_METRICS + " " + _front(_AXES))
def pareto_frontier_full(spark, sf):
    return planner.frontier(_cands(spark, sf), _AXES)


@_query(_METRICS + " " + " UNION ALL ".join(f"SELECT '{o}' AS objective, request, cand, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY {', '.join(k)}, cand) AS r FROM cands) x WHERE r <= 3" for o, k in planner.ORDER.items()))
def rank_objectives(spark, sf):
    c, out = _cands(spark, sf), None
    for o in planner.ORDER:
        one = planner.rank(c, o).select(F.lit(o).alias("objective"), "request", "cand", "rank")
        out = one if out is None else out.unionByName(one)
    return out


@_query(_METRICS + ", b AS (" + " UNION ALL ".join(f"SELECT {i} AS k, '{o}' AS label, request, cand FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY {', '.join(k)}, cand) AS r FROM cands) x WHERE r = 1" for i, (o, k) in enumerate(planner.ORDER.items())) + ") SELECT request, cand, string_agg(label, ',' ORDER BY k) AS labels FROM b GROUP BY request, cand")
def label_choices(spark, sf):
    return planner.labels(_cands(spark, sf), list(planner.ORDER))


@_query(_METRICS + """ SELECT request, cand, CASE WHEN m = 0 THEN '0m' ELSE concat_ws(' ', CASE WHEN m // 1440 > 0 THEN (m // 1440) || 'd' END, CASE WHEN m // 60 % 24 > 0 THEN (m // 60 % 24) || 'h' END, CASE WHEN m % 60 > 0 THEN (m % 60) || 'm' END) END AS shown FROM (SELECT request, cand, total_s // 60 AS m FROM cands) x""")
def humanized(spark, sf):
    return _cands(spark, sf).select("request", "cand", planner.humanize(F.col("total_s")).alias("shown"))


_WEIGHTS = with_views("arcs") + ", w AS (SELECT *, CAST(round_even(base_seconds * CASE class WHEN 'ferry' THEN 1.0 WHEN 'motorway' THEN 1.05 WHEN 'primary' THEN 1.33 WHEN 'residential' THEN 1.82 ELSE 2.0 END, 0) AS BIGINT) AS seconds FROM arcs WHERE season <> 'O')"


def _arcs(spark, sf):
    months = F.when(F.col("season") == "O", F.sequence(F.lit(5), F.lit(10))).otherwise(F.array().cast("array<int>"))
    return view(spark, sf, "arcs").withColumn("open_months", months)


@_query(_WEIGHTS + " SELECT arc, tail, head, seconds FROM w")
def arc_weights(spark, sf):
    return road.arc_weights(_arcs(spark, sf), 1).select("arc", "tail", "head", "seconds")


_PATHS = _WEIGHTS + ", d AS (SELECT s AS source, s AS node, CAST(0 AS BIGINT) AS seconds FROM sources UNION SELECT source, head, d.seconds + w.seconds FROM d JOIN w ON tail = node WHERE d.seconds + w.seconds <= 900), m AS (SELECT source, node, min(seconds) AS seconds FROM d GROUP BY ALL)"


@_query(_PATHS.replace(", d AS", ", sources AS (SELECT c_custkey AS s FROM customer), d AS", 1) + " SELECT source, node, seconds FROM m")
def shortest_paths(spark, sf):
    """From every door the nodes within a quarter of an hour."""
    return road.shortest(view(spark, sf, "doors").select(F.col("door").alias("source")), road.arc_weights(_arcs(spark, sf), 1), 900)


_TURNS = with_views("arcs") + """, j AS (SELECT node, count(DISTINCT n) AS k FROM (SELECT tail AS node, head AS n FROM arcs UNION ALL SELECT head, tail FROM arcs) x GROUP BY node HAVING count(DISTINCT n) >= 3),
 t AS (SELECT a.arc AS in_arc, b.arc AS out_arc, a.tail AS f, b.head AS g, a.head AS via, a.class AS ca, b.class AS cb, (b.bearing - a.bearing + 180) - 360 * floor((b.bearing - a.bearing + 180) / 360) - 180 AS x FROM arcs a JOIN arcs b ON a.head = b.tail),
 u AS (SELECT *, CASE WHEN x = -180 THEN 180 ELSE x END AS angle FROM t)
 SELECT in_arc, out_arc, CAST(angle AS DOUBLE) AS angle, CAST(CASE WHEN ca = 'ferry' OR cb = 'ferry' THEN 0 ELSE (CASE WHEN f = g THEN 40 WHEN j.node IS NOT NULL THEN (CASE WHEN abs(angle) <= 20 THEN 2 WHEN abs(angle) >= 135 THEN 22 WHEN abs(angle) <= 45 THEN 5 WHEN angle > 0 THEN 8 ELSE 15 END) ELSE 0 END) + CASE WHEN via % 4 = 0 THEN 5 ELSE 0 END END AS DOUBLE) AS cost
 FROM u LEFT JOIN j ON j.node = via"""


@_query(_TURNS)
def turn_costs(spark, sf):
    nodes = view(spark, sf, "doors").select(F.col("door").alias("node"), (F.col("door") % 4 == 0).alias("signal"))
    return road.turns(view(spark, sf, "arcs"), nodes)


@_query(_TURNS.replace(" SELECT in_arc, out_arc, CAST(angle", ", cost AS (SELECT in_arc, out_arc, CAST(angle", 1) + """), o AS (SELECT arc, tail, head, CAST(base_seconds AS DOUBLE) AS s FROM arcs),
 d AS (SELECT s_suppkey AS source, arc, s AS seconds FROM supplier JOIN o ON tail = s_suppkey WHERE s <= 500 UNION SELECT source, out_arc, seconds + cost.cost + o.s FROM d JOIN cost ON d.arc = in_arc JOIN o ON o.arc = out_arc WHERE seconds + cost.cost + o.s <= 500)
 SELECT source, node, min(seconds) AS seconds FROM (SELECT source, head AS node, seconds FROM d JOIN o USING (arc) UNION ALL SELECT s_suppkey, s_suppkey, 0.0 FROM supplier) x GROUP BY source, node""")
def turn_paths(spark, sf):
    """From the node of every stop the nodes within 500 seconds, turns counted."""
    nodes = view(spark, sf, "doors").select(F.col("door").alias("node"), (F.col("door") % 4 == 0).alias("signal"))
    arcs = view(spark, sf, "arcs")
    sources = view(spark, sf, "stops").select(F.col("stop_id").alias("source"))
    return road.shortest_by_arc(sources, arcs.withColumn("seconds", F.col("base_seconds")), road.turns(arcs, nodes), 500)


@_query("SELECT node, count(DISTINCT n) AS neighbours FROM (SELECT tail AS node, head AS n FROM arcs UNION ALL SELECT head, tail FROM arcs) x GROUP BY node HAVING count(DISTINCT n) >= 3".join([with_views("arcs") + " ", ""]))
def junction_nodes(spark, sf):
    return road.junctions(view(spark, sf, "arcs"))


_NEAR = with_views("doors", "stops") + f", n AS (SELECT door, stop_id, {hav('d.lat', 'd.lon', 's.lat', 's.lon')} AS km, stop_type FROM doors d, stops s)"


def _places(spark, sf):
    return view(spark, sf, "stops").select("stop_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), "stop_type")


@_query(_NEAR + " SELECT door, stop_id, round(km, 6) AS km FROM n WHERE km <= 50")
def access_legs(spark, sf):
    return spatial.within(view(spark, sf, "doors"), _places(spark, sf), 50, _r(F.col("km")).alias("km")).select("door", "stop_id", "km")


@_query(_NEAR + " SELECT door, stop_id, round(km, 6) AS km FROM (SELECT *, row_number() OVER (PARTITION BY door ORDER BY km, stop_id) AS r FROM n) x WHERE r = 1")
def nearest_stop(spark, sf):
    return spatial.nearest(view(spark, sf, "doors"), "door", _places(spark, sf), "stop_id").select("door", "stop_id", _r(F.col("km")).alias("km"))


@_query(with_views("stops") + f", l AS (SELECT h.stop_id AS hub, s.stop_id, {hav('h.lat', 'h.lon', 's.lat', 's.lon')} AS km FROM stops h, stops s WHERE h.stop_type <> 'rail_station' AND s.stop_type = 'rail_station'), k AS (SELECT hub, stop_id, round(km / 4.5 * 3600, 4) AS walk_s FROM (SELECT *, row_number() OVER (PARTITION BY hub ORDER BY km, stop_id) AS r FROM l WHERE km > 0 AND km <= 60) x WHERE r <= 6) SELECT hub AS from_stop, stop_id AS to_stop, walk_s FROM k UNION ALL SELECT stop_id, hub, walk_s FROM k")
def hub_links(spark, sf):
    hubs = view(spark, sf, "stops").where("stop_type <> 'rail_station'").select(F.col("stop_id").alias("hub"), "lat", "lon")
    rail = _places(spark, sf).where("stop_type = 'rail_station'")
    one = spatial.top_near(hubs, "hub", rail, "stop_id", 60, 6).select(F.col("hub").alias("from_stop"), F.col("stop_id").alias("to_stop"), _r(F.col("km") / 4.5 * 3600, 4).alias("walk_s"))
    return one.unionByName(one.select(F.col("to_stop").alias("from_stop"), F.col("from_stop").alias("to_stop"), "walk_s"))


@_query(with_views("stops") + f", l AS (SELECT h.stop_id, s.tz, {hav('h.lat', 'h.lon', 's.lat', 's.lon')} AS km, s.stop_id AS o FROM stops h, stops s WHERE h.tz IS NULL AND s.tz IS NOT NULL) SELECT stop_id, tz FROM stops WHERE tz IS NOT NULL UNION ALL SELECT stop_id, tz FROM (SELECT *, row_number() OVER (PARTITION BY stop_id ORDER BY km, o) AS r FROM l) x WHERE r = 1")
def tz_fill(spark, sf):
    return spatial.fill_zones(view(spark, sf, "stops"))


@_query(with_views("stops", "doors") + f", z AS (SELECT tz FROM stops WHERE tz IS NOT NULL GROUP BY tz ORDER BY count(*) DESC, min(stop_id) LIMIT 1), n AS (SELECT door, s.tz, {hav('d.lat', 'd.lon', 's.lat', 's.lon')} AS km, stop_id FROM doors d, stops s) SELECT door, coalesce(tz, (SELECT tz FROM z)) AS tz FROM (SELECT *, row_number() OVER (PARTITION BY door ORDER BY km, stop_id) AS r FROM n) x WHERE r = 1")
def door_zones(spark, sf):
    stops = view(spark, sf, "stops")
    return spatial.zone_of_doors(view(spark, sf, "doors"), "door", stops, timetable.zone_of_feed(stops))


@_query(with_views("stops") + " SELECT tz, count(*) AS n FROM stops WHERE tz IS NOT NULL GROUP BY tz ORDER BY n DESC, min(stop_id) LIMIT 1")
def feed_zone(spark, sf):
    return timetable.zone_of_feed(view(spark, sf, "stops"))


@_query(with_views("trips", "calls", "stops") + " SELECT trip_id, timezone('UTC', timezone(z, CAST(start_day AS TIMESTAMP) + to_seconds(dep_s))) AS dep_utc FROM trips JOIN (SELECT trip_id, dep_s, coalesce(tz, 'UTC') AS z FROM calls JOIN stops USING (stop_id) WHERE seq = 1) c USING (trip_id)")
def utc_departures(spark, sf):
    first = view(spark, sf, "calls").where("seq = 1").join(view(spark, sf, "stops"), "stop_id")
    t = view(spark, sf, "trips").join(first, "trip_id")
    return t.select("trip_id", timetable.utc(F.col("start_day"), F.col("dep_s"), F.coalesce("tz", F.lit("UTC"))).alias("dep_utc"))


@_query(with_views("stops", "calls") + " SELECT * FROM calls WHERE trip_id IN (SELECT trip_id FROM calls JOIN stops USING (stop_id) WHERE lat BETWEEN 46 AND 50 AND lon BETWEEN 4 AND 12 GROUP BY trip_id HAVING count(*) >= 2)")
def clip_corridor(spark, sf):
    return timetable.clip(view(spark, sf, "calls"), view(spark, sf, "stops"), 46, 4, 50, 12)


@_query(with_views("stops") + f", f AS (SELECT 0 AS feed, stop_id, lat, lon FROM stops UNION ALL SELECT 1, stop_id, lat + (stop_id % 3) * 0.02, lon FROM stops WHERE stop_id % 2 = 0), g AS (SELECT *, first_value(lat) OVER w AS a, first_value(lon) OVER w AS b FROM f WINDOW w AS (PARTITION BY stop_id ORDER BY feed)) SELECT feed, stop_id, CASE WHEN {hav('lat', 'lon', 'a', 'b')} > 1 THEN stop_id || '#' || feed ELSE CAST(stop_id AS VARCHAR) END AS new_id FROM g")
def merge_first_wins(spark, sf):
    s = view(spark, sf, "stops").select(F.lit(0).alias("feed"), "stop_id", "lat", "lon")
    t = s.where("stop_id % 2 = 0").select(F.lit(1).alias("feed"), "stop_id", (F.col("lat") + F.col("stop_id") % 3 * 0.02).alias("lat"), "lon")
    return timetable.merge_stops(s.unionByName(t)).select("feed", "stop_id", "new_id")


@_query(with_views("calls", "trips") + ", f AS (SELECT trip_id, unnest(range(21600, 28800, 1800)) AS tm FROM trips WHERE mode = 'ferry'), a AS (SELECT trip_id, min(dep_s) AS a FROM calls GROUP BY trip_id) SELECT c.trip_id || '#' || tm AS trip_id, seq, stop_id, CAST(arr_s + tm - a AS BIGINT) AS arr_s, CAST(dep_s + tm - a AS BIGINT) AS dep_s FROM calls c JOIN f USING (trip_id) JOIN a USING (trip_id) UNION ALL SELECT CAST(trip_id AS VARCHAR), seq, stop_id, CAST(arr_s AS BIGINT), CAST(dep_s AS BIGINT) FROM calls WHERE trip_id NOT IN (SELECT trip_id FROM f)")
def freq_expand(spark, sf):
    """Ferries run every half hour of a morning."""
    w = view(spark, sf, "trips").where("mode = 'ferry'").select("trip_id", F.lit(21600).alias("start_s"), F.lit(28800).alias("end_s"), F.lit(1800).alias("headway_s"))
    return timetable.expand_frequencies(view(spark, sf, "calls"), w)


def _pairs(spark, sf):
    s = timetable.segments(view(spark, sf, "calls"))
    return s.where("dep_stop <> arr_stop").select(F.col("dep_stop").alias("src"), F.col("arr_stop").alias("dst")).distinct()


_PAIRS = with_views("calls", "stops") + ", pairs AS (SELECT DISTINCT src, dst FROM (SELECT stop_id AS src, lead(stop_id) OVER (PARTITION BY trip_id ORDER BY seq) AS dst FROM calls) x WHERE src <> dst)"


@_query(_PAIRS + " SELECT * FROM pairs")
def route_pairs(spark, sf):
    return _pairs(spark, sf)


@_query(_PAIRS + " SELECT iata, count(*) AS degree FROM (SELECT src AS iata FROM pairs UNION ALL SELECT dst FROM pairs) x GROUP BY iata")
def route_degree(spark, sf):
    return flights.degrees(_pairs(spark, sf))


def _airports(spark, sf):
    return view(spark, sf, "stops").select(F.col("stop_id").alias("iata"), "lat", "lon")


@_query(_PAIRS + f" SELECT src || '-' || dst || '@' || printf('%02d', h) AS trip_id, src, dst, CAST(h * 3600 AS DOUBLE) AS dep_s, round(h * 3600 + 2700 + {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} / 800 * 3600, 3) AS arr_s FROM pairs JOIN stops a ON a.stop_id = src JOIN stops b ON b.stop_id = dst, (VALUES (8), (14)) v(h)")
def synthetic_flights(spark, sf):
    return flights.synthetic_flights(_pairs(spark, sf), _airports(spark, sf), [8, 14]).withColumn("arr_s", _r(F.col("arr_s"), 3))


@_query(_PAIRS.replace("RECURSIVE calls", "RECURSIVE doors AS (" + with_views("doors").split("doors AS (", 1)[1][:-1] + "), calls") + f", deg AS (SELECT iata, count(*) AS degree FROM (SELECT src AS iata FROM pairs UNION ALL SELECT dst FROM pairs) x GROUP BY iata HAVING count(*) >= 5), n AS (SELECT door AS point, iata, degree FROM doors d, stops s JOIN deg ON iata = stop_id WHERE {hav('d.lat', 'd.lon', 's.lat', 's.lon')} <= 400) SELECT point, iata, degree, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY degree DESC, iata DESC) AS r FROM n) x WHERE r <= 6")
def hub_topk(spark, sf):
    points = view(spark, sf, "doors").withColumnRenamed("door", "point")
    return flights.hubs(points, _airports(spark, sf), flights.degrees(_pairs(spark, sf)), 5, 400, 6)


_BOXES = "boxes AS (SELECT n_nationkey AS feed_id, n_name AS name, CASE WHEN n_nationkey < 3 THEN NULL ELSE n_regionkey END AS parent, CAST(44 + n_nationkey % 5 AS DOUBLE) AS lat0, CAST(2 + n_nationkey % 4 AS DOUBLE) AS lon0, CAST(46 + n_nationkey % 5 + n_nationkey % 3 AS DOUBLE) AS lat1, CAST(6 + n_nationkey % 7 AS DOUBLE) AS lon1 FROM nation)"


def _boxes(spark, sf):
    d = lambda c: F.expr(c).cast("double")
    return spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("feed_id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") >= 3, F.col("n_regionkey")).alias("parent"), d("44 + n_nationkey % 5").alias("lat0"), d("2 + n_nationkey % 4").alias("lon0"), d("46 + n_nationkey % 5 + n_nationkey % 3").alias("lat1"), d("6 + n_nationkey % 7").alias("lon1"))


def _trips_of(spark, sf):
    return view(spark, sf, "doors").withColumn("pair", F.floor(F.col("door") / 2).cast("long")).select("pair", "lat", "lon")


_COVER = with_views("doors") + f", {_BOXES}, p AS (SELECT door // 2 AS pair, lat, lon FROM doors), h AS (SELECT pair, feed_id, count(*) AS k, any_value((lat1 - lat0) * (lon1 - lon0)) AS area, any_value(parent) AS parent FROM p JOIN boxes ON lat BETWEEN lat0 AND lat1 AND lon BETWEEN lon0 AND lon1 GROUP BY ALL), n AS (SELECT pair, count(*) AS k FROM p GROUP BY pair), c AS (SELECT pair, feed_id, area FROM h JOIN n USING (pair, k))"


@_query(_COVER + " SELECT CAST(pair AS BIGINT) AS pair, feed_id, area FROM c")
def feeds_cover(spark, sf):
    return spatial.covering(_trips_of(spark, sf), _boxes(spark, sf), "pair", "feed_id")


@_query(_COVER.replace("AND lon0 AND lon1", "AND lon0 AND lon1").replace("lat BETWEEN lat0 AND lat1 AND lon BETWEEN lon0 AND lon1", "lat >= lat0 AND lat < lat1 AND lon >= lon0 AND lon < lon1 AND parent IS NOT NULL") + " SELECT CAST(pair AS BIGINT) AS pair, feed_id AS region_id, area FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY area, feed_id) AS r FROM c) x WHERE r = 1")
def region_smallest(spark, sf):
    corner = lambda a, b: F.struct(F.col(a).alias("lon"), F.col(b).alias("lat"))
    ring = F.array(corner("lon0", "lat0"), corner("lon1", "lat0"), corner("lon1", "lat1"), corner("lon0", "lat1"))
    return spatial.smallest_region(_trips_of(spark, sf), _boxes(spark, sf).withColumnRenamed("feed_id", "region_id").withColumn("polygons", F.array(F.array(ring))), "pair")


_TAGS = "tags AS (SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_size || ' mph' WHEN 2 THEN 'RO:urban' WHEN 3 THEN '0' WHEN 4 THEN ' ' || p_size || '.5 ' END AS speed, CASE p_partkey % 5 WHEN 0 THEN p_size || ':' || lpad(CAST(p_partkey % 60 AS VARCHAR), 2, '0') WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN '1:00:30' WHEN 3 THEN '-1:30' ELSE '0' END AS dur, CASE p_partkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN '-1' WHEN 2 THEN '' ELSE 'no' END AS ow, CASE WHEN p_partkey % 3 = 0 THEN 'roundabout' END AS jn, 'no @ (' || list_extract(['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'], CAST(1 + p_partkey % 12 AS BIGINT)) || '-' || list_extract(['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'], CAST(1 + p_size % 12 AS BIGINT)) || ')' AS cond, 1 + p_partkey % 12 AS m0, 1 + p_size % 12 AS m1 FROM part)"


def _tags(spark, sf):
    names = F.array(*map(F.lit, "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()))
    p, s = F.col("p_partkey"), F.col("p_size").cast("string")
    speed = F.when(p % 6 == 0, s).when(p % 6 == 1, F.concat(s, F.lit(" mph"))).when(p % 6 == 2, "RO:urban").when(p % 6 == 3, "0").when(p % 6 == 4, F.concat(F.lit(" "), s, F.lit(".5 ")))
    dur = F.when(p % 5 == 0, F.concat(s, F.lit(":"), F.lpad((p % 60).cast("string"), 2, "0"))).when(p % 5 == 1, s).when(p % 5 == 2, "1:00:30").when(p % 5 == 3, "-1:30").otherwise("0")
    ow = F.when(p % 4 == 0, "Yes").when(p % 4 == 1, "-1").when(p % 4 == 2, "").otherwise("no")
    cond = F.concat(F.lit("no @ ("), F.element_at(names, (1 + p % 12).cast("int")), F.lit("-"), F.element_at(names, (1 + F.col("p_size") % 12).cast("int")), F.lit(")"))
    return spark.read.parquet(f"{sf}/part.parquet").select(p.alias("k"), speed.alias("speed"), dur.alias("dur"), ow.alias("ow"), F.when(p % 3 == 0, "roundabout").alias("jn"), cond.alias("cond"))


@_query(f"WITH {_TAGS} SELECT k, round(CASE WHEN v > 0 THEN v ELSE 50 END, 6) AS kmh FROM (SELECT k, CASE WHEN speed LIKE '%mph%' THEN n * 1.609344 ELSE n END AS v FROM (SELECT k, speed, TRY_CAST(nullif(regexp_extract(speed, '\\d+(\\.\\d+)?'), '') AS DOUBLE) AS n FROM tags) x) y")
def maxspeed_parse(spark, sf):
    return _tags(spark, sf).select("k", _r(parsing.maxspeed(F.col("speed"), F.lit(50.0))).alias("kmh"))


@_query(f"WITH {_TAGS} SELECT k, CASE WHEN t > 0 THEN t END AS seconds FROM (SELECT k, CASE WHEN regexp_matches(dur, '^\\d+$') THEN CAST(dur AS DOUBLE) * 60 WHEN regexp_matches(dur, '^\\d+:\\d+(:\\d+)?$') THEN CAST(split_part(dur, ':', 1) AS DOUBLE) * 3600 + CAST(split_part(dur, ':', 2) AS DOUBLE) * 60 + coalesce(TRY_CAST(split_part(dur, ':', 3) AS DOUBLE), 0) END AS t FROM tags) x")
def duration_parse(spark, sf):
    return _tags(spark, sf).select("k", parsing.duration_seconds(F.col("dur")).alias("seconds"))


@_query(f"WITH {_TAGS} SELECT k, CASE WHEN ow = 'Yes' THEN 1 WHEN ow = '-1' THEN -1 WHEN jn = 'roundabout' AND ow = '' THEN 1 ELSE 0 END AS oneway FROM tags")
def oneway_parse(spark, sf):
    return _tags(spark, sf).select("k", parsing.oneway(F.col("ow"), F.col("jn")).alias("oneway"))


@_query(f"WITH {_TAGS} SELECT k, list_filter(range(1, 13), lambda m: NOT CASE WHEN m0 <= m1 THEN m BETWEEN m0 AND m1 ELSE m >= m0 OR m <= m1 END) AS months FROM tags")
def seasonal_parse(spark, sf):
    tags = F.create_map(F.lit("motorcar:conditional"), F.col("cond"))
    keys = ["motor_vehicle:conditional", "motorcar:conditional", "vehicle:conditional", "access:conditional"]
    return _tags(spark, sf).select("k", validity.open_months(tags, keys).cast("array<long>").alias("months"))


@_query("""SELECT event_id, round(CASE WHEN c = 'ferry' THEN CAST(1.0 AS DOUBLE) ELSE greatest(1.0, a * CASE WHEN isodow(ts) <= 5 THEN CASE WHEN h IN (7, 8, 16, 17, 18) THEN CASE WHEN c = 'motorway' THEN 1.2 ELSE 1.45 END WHEN h >= 22 OR h <= 5 THEN 0.95 ELSE 1.0 END ELSE CASE WHEN h BETWEEN 11 AND 17 THEN CASE WHEN c = 'motorway' THEN 1.05 ELSE 1.15 END WHEN h >= 22 OR h <= 6 THEN 0.95 ELSE 1.0 END END) END, 6) AS factor
 FROM (SELECT *, CASE c WHEN 'motorway' THEN 1.05 WHEN 'residential' THEN 1.82 ELSE 1.0 END AS a FROM (SELECT event_id, ts, hour(ts) AS h, CASE event_id % 3 WHEN 0 THEN 'motorway' WHEN 1 THEN 'residential' ELSE 'ferry' END AS c FROM events) x) y""")
def speed_factors(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    c = F.when(F.col("event_id") % 3 == 0, "motorway").when(F.col("event_id") % 3 == 1, "residential").otherwise("ferry")
    return e.select("event_id", _r(pricing.speed_factor(c, F.col("ts"), F.lit(False), F.lit(False))).alias("factor"))


@_query("SELECT p_name AS name, CAST(tier AS INTEGER) AS tier FROM (SELECT DISTINCT p_name, CASE WHEN starts_with(lower(p_name), 'bo') THEN 0 WHEN contains(lower(p_name), 'bo') THEN 1 END AS tier FROM part) x WHERE tier IS NOT NULL ORDER BY tier, lower(p_name), p_name LIMIT 8")
def search_tiers(spark, sf):
    names = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_name").alias("name")).distinct()
    return catalogs.search(names, " Bo").select("name", "tier")


@_query("WITH f AS (SELECT c_nationkey AS feed_id, c_nationkey * 1.5 AS area, count(*) * 1000 AS trips FROM customer GROUP BY ALL), t AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY area, feed_id) AS n FROM f) x WHERE n <= 4 AND trips > 0), r AS (SELECT *, sum(trips) OVER (ORDER BY n) AS total, row_number() OVER (ORDER BY n) AS k FROM t), o AS (SELECT *, max(CASE WHEN k > 1 AND total > 130000 THEN 1 ELSE 0 END) OVER (ORDER BY n) AS over FROM r) SELECT feed_id, trips, CAST(total AS BIGINT) AS total FROM o WHERE over = 0")
def budget_cut(spark, sf):
    f = spark.read.parquet(f"{sf}/customer.parquet").groupBy(F.col("c_nationkey").alias("feed_id")).agg((F.count("*") * 1000).alias("trips")).withColumn("area", F.col("feed_id") * 1.5)
    return catalogs.take_budget(f, "area", "trips", 130_000).select("feed_id", "trips", "total")


def _network_modes(spark, sf):
    conns, stops, feet = _network(spark, sf)
    return written(conns, "conns"), stops, written(transit.close_footpaths(feet), "feet")


@_query()
def journey_legs(spark, sf):
    """The legs of the earliest journey of every batch of requests to each of its destinations; no SQL twin (a walk back along predecessors)."""
    conns, stops, feet = _network_modes(spark, sf)
    r, sources = _batches(spark, sf)
    labels, history = transit.scan(sources, conns, stops, feet)
    asked = r.select(F.col("batch").alias("request"), F.col("dest").alias("target")).distinct()
    return search.legs_to(search.best_targets(labels).join(asked, ["request", "target"], "left_semi"), search.predecessors(history, conns, stops, feet))


def _door_requests(spark, sf):
    """From every door to another one, at six in the morning."""
    k = F.col("door")
    return view(spark, sf, "doors").select(k.alias("request"), "lat", "lon", (46 + k * 7 % 100 / 20).cast("double").alias("lat2"), (4 + k * 3 % 100 / 20).cast("double").alias("lon2"), F.lit(21600).cast("long").alias("depart"))


@_query()
def plan_requests(spark, sf):
    """Door-to-door plans between customers' doors, greenest first; no SQL twin (a fixpoint within), tested by brute force."""
    return search.plan(_door_requests(spark, sf), *_network_modes(spark, sf), "greenest", 3).drop("pool", "signature")


@_query()
def plan_choices(spark, sf):
    """The best of each objective, candidates of car and foot access pooled, without flights where others get there in a day."""
    return search.plan_choices(_door_requests(spark, sf), *_network_modes(spark, sf), list(planner.ORDER), ("flight",), connectors.by_mode("both"))


_REL = with_views("arcs") + """, a AS (SELECT arc, arc % 40 AS way, tail, head, bearing FROM arcs),
 rel AS (SELECT c_custkey AS rel, c_custkey AS via, c_custkey % 40 AS f, (c_custkey * 7) % 40 AS t, list_extract(['no_left_turn', 'no_right_turn', 'no_u_turn', 'no_straight_on', 'no_entry', 'only_left_turn', 'only_straight_on'], 1 + CAST(c_custkey % 7 AS BIGINT)) AS value FROM customer),
 i AS (SELECT DISTINCT rel, via, value, arc AS in_arc, bearing AS b_in FROM rel JOIN a ON head = via AND (way = f OR way = (f + 1) % 40 OR way = (f + 2) % 40)),
 o AS (SELECT DISTINCT rel, arc AS out_arc, bearing AS b_out FROM rel JOIN a ON tail = via AND (way = t OR way = (t + 1) % 40)),
 p AS (SELECT rel, via, value, in_arc, out_arc, count(*) OVER (PARTITION BY rel) AS n, (b_out - b_in + 180) - 360 * floor((b_out - b_in + 180) / 360) - 180 AS x FROM i JOIN o USING (rel)),
 q AS (SELECT *, CASE WHEN abs(x) <= 45 THEN 'straight' WHEN abs(x) >= 150 THEN 'u' WHEN x > 0 THEN 'right' ELSE 'left' END AS cls, CASE WHEN value LIKE '%u_turn%' THEN 'u' WHEN value LIKE '%left%' THEN 'left' WHEN value LIKE '%right%' THEN 'right' WHEN value LIKE '%straight%' THEN 'straight' ELSE 'any' END AS turn FROM p),
 named AS (SELECT * FROM q WHERE n = 1 OR turn = 'any' OR cls = turn),
 al AS (SELECT rel, in_arc, out_arc FROM named WHERE value LIKE 'only%' UNION ALL SELECT rel, in_arc, out_arc FROM p WHERE value LIKE 'only%' AND rel NOT IN (SELECT rel FROM named WHERE value LIKE 'only%')),
 bound AS (SELECT DISTINCT rel, in_arc FROM al UNION SELECT rel, in_arc FROM i WHERE value LIKE 'only%' AND rel NOT IN (SELECT rel FROM p)),
 rest AS (SELECT bound.rel, in_arc, arc AS out_arc FROM bound JOIN rel ON rel.rel = bound.rel JOIN a ON tail = via)
 SELECT in_arc, out_arc FROM named WHERE value LIKE 'no%' UNION SELECT in_arc, out_arc FROM rest WHERE (rel, in_arc, out_arc) NOT IN (SELECT (rel, in_arc, out_arc) FROM al)"""


@_query(_REL)
def turn_restrictions(spark, sf):
    kinds = F.array(*map(F.lit, ["no_left_turn", "no_right_turn", "no_u_turn", "no_straight_on", "no_entry", "only_left_turn", "only_straight_on"]))
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("rel"))
    f, t = F.col("rel") % 40, F.col("rel") * 7 % 40
    r = c.select("rel", F.col("rel").alias("via"), F.array(f, (f + 1) % 40, (f + 2) % 40).alias("from_ways"), F.array(t, (t + 1) % 40).alias("to_ways"), F.element_at(kinds, (1 + F.col("rel") % 7).cast("int")).alias("value"))
    return restrictions.forbidden_turns(r, view(spark, sf, "arcs").select("arc", (F.col("arc") % 40).alias("way"), "tail", "head", "bearing"))


_WAYS = with_views("doors") + f""", w AS (SELECT o_orderkey AS way, o_custkey AS n0, 1 + (o_custkey * 3) % (SELECT count(*) FROM customer) AS n1, CASE o_orderkey % 4 WHEN 0 THEN 'motorway' WHEN 1 THEN 'residential' WHEN 2 THEN 'footway' ELSE 'primary' END AS class, CASE o_orderkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' ELSE 'no' END AS ow FROM orders),
 s AS (SELECT way, n0, n1, class, ow, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km FROM w JOIN doors a ON a.door = n0 JOIN doors b ON b.door = n1 WHERE class <> 'footway'),
 t AS (SELECT *, CAST(round_even(km / CASE class WHEN 'motorway' THEN 110.0 WHEN 'residential' THEN 30.0 ELSE 80.0 END * 3600, 0) AS INTEGER) AS base_seconds FROM s)
 SELECT way, n0 AS tail, n1 AS head, base_seconds, class FROM t WHERE ow <> '-1' UNION ALL SELECT way, n1, n0, base_seconds, class FROM t WHERE ow <> 'yes'"""


@_query(_WAYS)
def way_arcs(spark, sf):
    n = spark.read.parquet(f"{sf}/customer.parquet").count()
    o = spark.read.parquet(f"{sf}/orders.parquet")
    k = F.col("o_orderkey")
    highway = F.when(k % 4 == 0, "motorway").when(k % 4 == 1, "residential").when(k % 4 == 2, "footway").otherwise("primary")
    ow = F.when(k % 3 == 0, "yes").when(k % 3 == 1, "-1").otherwise("no")
    w = o.select(k.alias("way"), F.array(F.col("o_custkey"), 1 + F.col("o_custkey") * 3 % n).alias("refs"), F.create_map(F.lit("highway"), highway, F.lit("oneway"), ow).alias("tags"))
    return ways.arcs_of(w, view(spark, sf, "doors").select(F.col("door").alias("node"), "lat", "lon")).select("way", "tail", "head", "base_seconds", "class")


@_query(with_views("calls", "stops") + f", k AS (SELECT trip_id, lag(lat) OVER w AS a, lag(lon) OVER w AS b, lat, lon FROM calls JOIN stops USING (stop_id) WINDOW w AS (PARTITION BY trip_id ORDER BY seq)) SELECT trip_id, round(coalesce(sum({hav('a', 'b', 'lat', 'lon')}), 0), 5) AS km FROM k GROUP BY trip_id")
def path_lengths(spark, sf):
    return timetable.path_km(view(spark, sf, "calls"), view(spark, sf, "stops")).select("trip_id", _r(F.col("km"), 5).alias("km"))


@_query("SELECT p_partkey AS k, lower(trim(split_part(p_name || ' , ' || p_brand, ',', 1))) AS place FROM part")
def place_keys(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select(F.col("p_partkey").alias("k"), parsing.place_key(F.concat("p_name", F.lit(" , "), "p_brand")).alias("place"))


@_query("SELECT p_partkey AS k, CAST(p_size * 3600 + p_partkey % 60 * 60 + CASE WHEN p_partkey % 2 = 0 THEN 30 ELSE 0 END AS INTEGER) AS seconds FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 3 = 0")
def gtfs_times(spark, sf):
    k = F.col("p_partkey")
    text = F.concat(F.col("p_size").cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"), F.when(k % 2 == 0, ":30").otherwise(""))
    return spark.read.parquet(f"{sf}/part.parquet").select(k.alias("k"), parsing.gtfs_seconds(F.when(k % 3 == 0, F.concat(F.lit("x"), text)).otherwise(text)).alias("seconds"))


@_query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN TIMESTAMP '2026-07-01 08:00:00' WHEN 3 THEN NULL ELSE date_trunc('minute', ts) END AS depart FROM events")
def depart_parse(spark, sf):
    k, ts = F.col("event_id") % 4, F.col("ts")
    text = F.when(k == 0, " ").when(k == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm")).when(k == 2, F.date_format(ts, "yyyy-MM-dd HH:mm")).otherwise("tomorrow")
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", parsing.depart(text, F.lit("2026-07-01 08:00:00").cast("timestamp_ntz")).alias("depart"))


_TWICE = _METRICS.replace("p AS (SELECT *,", "twice AS (SELECT * FROM legs UNION ALL SELECT request, cand + 10000000, leg_no, mode, CASE WHEN cand % 2 = 1 THEN km + 0.5 ELSE km END, travel_s, overhead_s, cost_level FROM legs), p AS (SELECT *,").replace("AS veh FROM legs)", "AS veh FROM twice)")
# half a kilometre makes half a cent: a fare is rounded as the decimal number that it reads as, half up, not by a product of doubles
_TWICE = _TWICE.replace("round(CAST(fare AS DOUBLE), 2)", "CAST(round(CAST(CAST(CAST(fare AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE)")


@_query(_TWICE + " SELECT request, min(cand) AS cand, total_s, modes FROM (SELECT *, round_even(cost, 2) AS a, round_even(car_km, 3) AS b, round_even(emissions, 1) AS c FROM cands) x GROUP BY request, total_s, a, transfers, b, c, modes")
def distinct_signatures(spark, sf):
    """Candidates pooled twice, odd ones slightly longer the second time: equals go, others stay."""
    legs = view(spark, sf, "legs")
    again = legs.withColumn("km", F.when(F.col("cand") % 2 == 1, F.col("km") + 0.5).otherwise(F.col("km"))).withColumn("cand", F.col("cand") + 10_000_000)
    return planner.dedupe(planner.with_signature(planner.metrics(legs.unionByName(again)))).select("request", "cand", "total_s", "modes")


@_query(_CONN + ", dc AS (SELECT dep_stop, CAST(epoch(dep) - epoch(TIMESTAMP '1998-07-01 00:00:00') AS BIGINT) AS dep, CAST(epoch(arr) - epoch(TIMESTAMP '1998-07-01 00:00:00') AS BIGINT) AS arr, run_id FROM conns), a AS (SELECT s_suppkey * 24 + h AS ask, s_suppkey AS stop, h * 3600 + s_suppkey % 60 * 60 AS at_s FROM supplier, range(24) v(h)) SELECT ask, dep, arr, run_id FROM (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY dep, arr, run_id) AS r FROM a JOIN dc ON dep_stop = stop AND dep >= at_s AND dep <= at_s + 43200) x WHERE r = 1")
def next_departures(spark, sf):
    conns, stops, _ = _network(spark, sf, "1998-07-01 12:00:00")
    hours = F.explode(F.sequence(F.lit(0), F.lit(23)))
    asks = stops.select(F.col("stop_id").alias("stop"), hours.alias("h")).select((F.col("stop") * 24 + F.col("h")).alias("ask"), "stop", (F.col("h") * 3600 + F.col("stop") % 60 * 60).alias("at"))
    return timetable.next_departures(asks, conns)


def _keyed(weights: str, sources: str = "SELECT s_suppkey AS s FROM supplier") -> str:
    """Shortest weights m (source, node, seconds) of w (tail, head, seconds) from sources, without a limit: a recursion that keeps the least of each key."""
    return f"""{weights}, sources AS ({sources}), m(source, node, seconds) USING KEY (source, node) AS (SELECT s, s, CAST(0 AS BIGINT) FROM sources UNION
 SELECT n.source, n.head, min(x) FROM (SELECT m.source, w.head, m.seconds + w.seconds AS x FROM m JOIN w ON tail = node) n LEFT JOIN recurring.m r ON r.source = n.source AND r.node = n.head WHERE r.seconds IS NULL OR x < r.seconds GROUP BY n.source, n.head)"""


def _overlay(spark, sf):
    a = road.arc_weights(_arcs(spark, sf), 1).select("arc", "tail", "head", F.col("seconds").alias("weight"))
    return overlay.build(a, overlay.cells_by_order(view(spark, sf, "doors").select(F.col("door").alias("node"))))


def _stop_nodes(spark, sf):
    return view(spark, sf, "stops").select(F.col("stop_id").alias("node"))


_MATRIX = " SELECT a.s AS source, b.s AS target, seconds FROM sources a, sources b LEFT JOIN m ON m.source = a.s AND m.node = b.s"


@_query(_keyed(_WEIGHTS) + _MATRIX)
def drive_matrix(spark, sf):
    """Drives between the nodes of all stops, however long; null where no road leads there."""
    return overlay.matrix(_overlay(spark, sf), _stop_nodes(spark, sf)).withColumnRenamed("weight", "seconds")


@_query(_keyed(_WEIGHTS.replace(" FROM arcs WHERE season <> 'O'", " FROM arcs WHERE season <> 'O' AND arc % 1000 > 0").replace("2.0 END, 0) AS BIGINT)", "2.0 END, 0) AS BIGINT) + CASE WHEN arc % 1000 = 1 THEN 3600 ELSE 0 END")) + _MATRIX)
def overlay_overrides(spark, sf):
    """drive_matrix with every thousandth arc closed and its neighbour jammed for an hour: only the cells of those arcs are searched again."""
    o, jam = _overlay(spark, sf), F.when(F.col("arc") % 1000 == 1, F.col("weight") + 3600)
    changed = o.arcs.where("arc % 1000 < 2").select("arc", jam.alias("weight"))
    return overlay.matrix(overlay.customise(o, changed)[0], _stop_nodes(spark, sf)).withColumnRenamed("weight", "seconds")


_LEADERS = ", ".join(f"o{i} AS (SELECT {i} AS k, '{o}' AS label, request, cand FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY {', '.join(c)}, cand) AS r FROM f{planner.AXES[o]}) x WHERE r = 1)" for i, (o, c) in enumerate(planner.ORDER.items()))


@_query(_METRICS + f", f3 AS ({_front(_AXES[:3])}), f5 AS ({_front(_AXES)}), {_LEADERS}, best AS ({' UNION ALL '.join(f'SELECT * FROM o{i}' for i in range(len(planner.ORDER)))}), s AS (SELECT b.*, total_s, round_even(cost, 2) AS a, transfers, round_even(car_km, 3) AS c, round_even(emissions, 1) AS e, modes FROM best b JOIN cands USING (request, cand)) SELECT request, arg_min(cand, k) AS cand, string_agg(label, ',' ORDER BY k) AS labels FROM s GROUP BY request, total_s, a, transfers, c, e, modes")
def labelled_signatures(spark, sf):
    """The leaders of all objectives, each from its own frontier; equals by signature once, with all labels that they won."""
    return search.choices(planner.with_signature(_cands(spark, sf)), list(planner.ORDER))


#: Ends are places, snapped to the network: they lie at nodes, and of the nodes at one place the smallest is the nearest.
_DRIVES = f"""doors AS ({VIEWS['doors']}), spots AS (SELECT lat, lon, min(door) AS node FROM doors GROUP BY lat, lon), snaps AS (SELECT door, node FROM doors JOIN spots USING (lat, lon)),
 drives AS (SELECT s_suppkey AS request, x.node AS a, y.node AS b FROM supplier JOIN snaps x ON x.door = s_suppkey JOIN snaps y ON y.door = 1 + (s_suppkey + 2) % (SELECT count(*) FROM supplier))"""


def _drives(spark, sf):
    """A drive from every stop's node to that of a stop a little way on."""
    s, d = view(spark, sf, "stops").select(F.col("stop_id").alias("request")), view(spark, sf, "doors")
    t = s.withColumn("b", 1 + (F.col("request") + 2) % s.count()).join(d.withColumnRenamed("door", "request"), "request")
    return t.join(d.select(F.col("door").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), "b").select("request", "lat", "lon", "lat2", "lon2")


def _nodes(spark, sf):
    return view(spark, sf, "doors").select(F.col("door").alias("node"), "lat", "lon", (F.col("door") % 4 == 0).alias("signal"))


@_query(_TURNS.replace(" SELECT in_arc, out_arc, CAST(angle", ", cost AS (SELECT in_arc, out_arc, CAST(angle", 1) + """), o AS (SELECT arc, tail, head, CAST(base_seconds AS DOUBLE) AS s FROM arcs),
 """ + _DRIVES + """, k(source, arc, seconds) USING KEY (source, arc) AS (SELECT a, arc, s FROM (SELECT DISTINCT a FROM drives) x JOIN o ON tail = a UNION
  SELECT n.source, n.out_arc, min(x) FROM (SELECT k.source, c.out_arc, k.seconds + c.cost + o.s AS x FROM k JOIN cost c ON k.arc = in_arc JOIN o ON o.arc = c.out_arc) n LEFT JOIN recurring.k r ON r.source = n.source AND r.arc = n.out_arc WHERE x <= 1800 AND (r.seconds IS NULL OR x < r.seconds) GROUP BY n.source, n.out_arc),
 best AS (SELECT source, head AS node, min(seconds) AS seconds FROM k JOIN o USING (arc) GROUP BY ALL)
 SELECT request, CAST(CASE WHEN a = b THEN 0 ELSE seconds END AS DOUBLE) AS seconds FROM drives LEFT JOIN best ON source = a AND node = b""")
def turn_drives(spark, sf):
    """Drives of half an hour at most by legal turns with their costs; null where it takes longer."""
    arcs, nodes = view(spark, sf, "arcs").withColumns({"seconds": F.col("base_seconds"), "km": F.col("base_seconds") / 60}), _nodes(spark, sf)
    return road.drive(_drives(spark, sf), nodes, arcs, turn_table=road.turns(arcs, nodes), limit_s=1800).select("request", "seconds")


@_query(_WEIGHTS + f""", {_DRIVES}, arc AS (SELECT tail, head, min({{'s': CAST(seconds AS DOUBLE), 'km': base_seconds / 60}}) AS x FROM w GROUP BY ALL),
 k(source, node, x) USING KEY (source, node) AS (SELECT DISTINCT a, a, {{'s': CAST(0 AS DOUBLE), 'km': CAST(0 AS DOUBLE)}} FROM drives UNION
  SELECT n.source, n.head, min(n.x) FROM (SELECT k.source, arc.head, {{'s': k.x.s + arc.x.s, 'km': k.x.km + arc.x.km}} AS x FROM k JOIN arc ON arc.tail = k.node) n LEFT JOIN recurring.k r ON r.source = n.source AND r.node = n.head WHERE n.x.s <= 1800 AND (r.x IS NULL OR n.x < r.x) GROUP BY n.source, n.head)
 SELECT request, x.s AS seconds, round(x.km, 6) AS km FROM drives LEFT JOIN k ON k.source = a AND k.node = b""")
def plain_drives(spark, sf):
    """Drives of half an hour at most between places, snapped to the network: the quickest way and its length."""
    arcs = road.arc_weights(_arcs(spark, sf), 1).withColumn("km", F.col("base_seconds") / 60)
    return road.drive(_drives(spark, sf), _nodes(spark, sf), arcs, limit_s=1800).select("request", "seconds", _r(F.col("km")).alias("km"))


@_query(_NEAR + " SELECT door, stop_id AS node, round(km, 6) AS km FROM (SELECT *, row_number() OVER (PARTITION BY door ORDER BY km, stop_id) AS r FROM n WHERE km <= 25) x WHERE r = 1")
def door_snaps(spark, sf):
    """The nearest node within 25 km of every door."""
    nodes = view(spark, sf, "stops").select(F.col("stop_id").alias("node"), "lat", "lon")
    return road.snap(view(spark, sf, "doors"), "door", nodes).select("door", "node", _r(F.col("km")).alias("km"))


_ASKED = "asked AS (SELECT door AS request, lat, lon, CAST(46 + door * 7 % 100 / 20 AS DOUBLE) AS lat2, CAST(4 + door * 3 % 100 / 20 AS DOUBLE) AS lon2 FROM doors)"


@_query(with_views("doors", "stops") + f""", {_ASKED},
 g AS (SELECT 'access' AS part, request, stop_id AS stop, {hav('a.lat', 'a.lon', 's.lat', 's.lon')} AS gc FROM asked a, stops s UNION ALL SELECT 'egress', request, stop_id, {hav('a.lat2', 'a.lon2', 's.lat', 's.lon')} FROM asked a, stops s UNION ALL SELECT 'direct', request, NULL, {hav('lat', 'lon', 'lat2', 'lon2')} FROM asked),
 k AS (SELECT *, gc * CAST(1.3 AS DOUBLE) AS d FROM g WHERE gc <= CASE part WHEN 'direct' THEN 1500 ELSE 50 END)
 SELECT part, request, stop, CASE WHEN gc <= 1.5 THEN 'walk' ELSE 'car' END AS mode, round(CASE WHEN gc <= 1.5 THEN gc ELSE d END, 6) AS km,
  CAST(round_even(CASE WHEN gc <= 1.5 THEN gc / 5.0 * 3600 ELSE (least(d, 30.0) / 60.0 + greatest(least(d, 150.0) - 30, 0.0) / 80.0 + greatest(d - 150, 0.0) / 100.0) * 3600 END, 0) AS BIGINT) AS seconds FROM k""")
def connector_legs(spark, sf):
    """First miles, last miles and direct ways by straight line of a request from every door."""
    parts = zip(("access", "egress", "direct"), connectors.geometric()(_door_requests(spark, sf), view(spark, sf, "stops")), strict=True)
    rows = [df.select(F.lit(n).alias("part"), "request", (F.col("stop") if "stop" in df.columns else F.lit(None).cast("long")).alias("stop"), "mode", _r(F.col("km")).alias("km"), "seconds") for n, df in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_HOURS = "CASE request % 3 WHEN 0 THEN 'rush' WHEN 1 THEN 'night' ELSE 'holiday' END"
_PEAK = "CASE class WHEN 'ferry' THEN 1.0 WHEN 'motorway' THEN 1.05 WHEN 'primary' THEN 1.33 WHEN 'residential' THEN 1.82 ELSE 2.0 END"


@_query(with_views("arcs") + f""", v(band) AS (VALUES ('rush'), ('night'), ('holiday')),
 w AS (SELECT band, tail, head, CAST(round_even(base_seconds * CASE WHEN class = 'ferry' THEN 1.0 ELSE greatest(CAST(1.0 AS DOUBLE), CAST({_PEAK} AS DOUBLE) * CASE band WHEN 'rush' THEN CASE WHEN class = 'motorway' THEN CAST(1.2 AS DOUBLE) ELSE 1.45 END WHEN 'night' THEN CAST(0.95 AS DOUBLE) ELSE 1.0 END) END, 0) AS BIGINT) AS seconds FROM arcs, v WHERE season <> 'O' OR band = 'night'),
 {_DRIVES}, k(band, source, node, seconds) USING KEY (band, source, node) AS (SELECT DISTINCT {_HOURS}, a, a, CAST(0 AS BIGINT) FROM drives UNION
  SELECT n.band, n.source, n.head, min(x) FROM (SELECT k.band, k.source, w.head, k.seconds + w.seconds AS x FROM k JOIN w ON w.tail = k.node AND w.band = k.band) n LEFT JOIN recurring.k r ON r.band = n.band AND r.source = n.source AND r.node = n.head WHERE x <= 1800 AND (r.seconds IS NULL OR x < r.seconds) GROUP BY n.band, n.source, n.head)
 SELECT request, CAST(seconds AS DOUBLE) AS seconds FROM drives LEFT JOIN k ON k.band = {_HOURS} AND k.source = a AND k.node = b""")
def timed_drives(spark, sf):
    """Drives of half an hour at most at eight on a workday in March, at eleven at night in June (summer roads open), and at eight on a holiday."""
    k = F.col("request") % 3
    at = F.when(k == 0, "2026-03-03 08:10:00").when(k == 1, "2026-06-03 23:30:00").otherwise("2026-01-01 08:20:00").cast("timestamp_ntz")
    arcs = _arcs(spark, sf).withColumn("km", F.col("base_seconds") / 60)
    holidays = spark.sql("SELECT DATE '2026-01-01' AS day, 'holiday' AS kind")
    return road.timed_drive(_drives(spark, sf).withColumn("depart", at), _nodes(spark, sf), arcs, holidays, limit_s=1800).select("request", "seconds")


def _contracts(spark, sf):
    """From every door, by its number: one of six objectives, a day of two, a minute, a strike, no flights, a first mile, one to three plans."""
    k = F.col("request")
    at = F.when(k % 2 == 0, "1998-06-30 00:00:00").otherwise("1998-07-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(21_600 + k % 360 * 60).cast("decimal(18,6)"))
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (1 + k % n).cast("int"))
    none = F.array().cast("array<string>")
    return _door_requests(spark, sf).withColumns({
        "depart": at, "objective": pick(6, *planner.ORDER), "conditions": F.when(k % 4 < 2, F.array(F.lit("strike"))).otherwise(none), "exclude": F.when(k % 5 == 0, F.array(F.lit("flight"))).otherwise(none),
        "access": pick(3, "car", "transit", "both"), "top": (1 + k % 3).cast("int"),
    })


@_query()
def plan_contracts(spark, sf):
    """Plans of requests with a contract of their own, over zones; no SQL twin (a fixpoint within), tested against plans made one by one."""
    _, stops, feet = _network(spark, sf)
    closed = written(transit.close_footpaths(feet), "feet")
    got = contracts.plan_each(_contracts(spark, sf), calendars(view(spark, sf, "trips")), view(spark, sf, "calls"), stops, closed)
    return got.select("request", "objective", "rank", "cand", "total_s", "cost", "transfers", "modes")


@_query(with_views("trips", "calls") + f""", good AS (SELECT trip_id FROM (SELECT trip_id, arr_s, dep_s, lag(dep_s) OVER (PARTITION BY trip_id ORDER BY seq) AS p FROM calls) x GROUP BY trip_id HAVING count(*) >= 2 AND NOT bool_or(arr_s > dep_s OR coalesce(arr_s < p, FALSE))),
 seg AS (SELECT * FROM (SELECT trip_id, seq, stop_id AS dep_stop, dep_s, lead(stop_id) OVER w AS arr_stop, lead(arr_s) OVER w AS arr_s FROM calls WHERE trip_id IN (SELECT trip_id FROM good) WINDOW w AS (PARTITION BY trip_id ORDER BY seq)) z WHERE arr_stop IS NOT NULL AND arr_s > dep_s),
 asked AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN DATE '1998-06-30' ELSE DATE '1998-07-01' END AS day, c_custkey % 4 < 2 AS strike, (CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '1998-06-30 00:00:00' ELSE TIMESTAMP '1998-07-01 00:00:00' END) + to_seconds(21600 + c_custkey % 360 * 60) AS depart FROM customer),
 sets AS (SELECT day, strike, min(depart) AS t0, max(depart) + INTERVAL 6 HOUR AS t1 FROM asked GROUP BY ALL),
 days AS (SELECT trip_id, mode, d, season FROM (SELECT *, CAST(unnest(generate_series(DATE '1998-06-28', DATE '1998-07-02', INTERVAL 1 DAY)) AS DATE) AS d FROM trips) x WHERE {ACTIVE}),
 c AS (SELECT day, strike, t1, trip_id, d, mode, seq, dep_stop, arr_stop, CAST(d AS TIMESTAMP) + to_seconds(dep_s) AS dep, CAST(d AS TIMESTAMP) + to_seconds(arr_s) AS arr FROM days JOIN seg USING (trip_id) JOIN sets ON NOT (strike AND season = 'P') AND CAST(d AS TIMESTAMP) + to_seconds(dep_s) >= t0)
 SELECT day, strike, trip_id, d AS service_day, mode, seq, dep_stop, arr_stop, dep, arr FROM (SELECT *, min(dep) OVER (PARTITION BY day, strike, trip_id, d) AS first_dep FROM c) z WHERE first_dep <= t1""")
def contract_connections(spark, sf):
    """Connections that the contracts' sets share: for each day and condition those of its window, of six hours after its last departure."""
    r = _contracts(spark, sf).select("request", "depart", "conditions")
    _, sets = contracts.with_sets(r, 21_600)
    c = timetable.connection_sets(sets, calendars(view(spark, sf, "trips")), view(spark, sf, "calls"))
    day = F.to_date(F.get_json_object("set", "$.day"))
    return c.select(day.alias("day"), F.col("set").contains("strike").alias("strike"), "trip_id", F.to_date(F.substring_index("run_id", "@", -1)).alias("service_day"), "mode", "seq", "dep_stop", "arr_stop", "dep", "arr")


_ORDERED = ", ".join(f"CASE objective {' '.join(f'WHEN {chr(39)}{o}{chr(39)} THEN {k[i]}' for o, k in planner.ORDER.items() if len(k) > i)} ELSE 0 END" for i in range(5))


@_query(_METRICS + f""", wish AS (SELECT DISTINCT request, list_extract([{', '.join(repr(o) for o in planner.ORDER)}], CAST(1 + request % 6 AS BIGINT)) AS objective, 1 + request % 4 AS top, request % 3 = 0 AS ground FROM cands),
 e AS (SELECT * FROM (SELECT *, min(CASE WHEN no_flight = 1 OR NOT ground THEN total_s END) OVER (PARTITION BY request) AS b FROM cands JOIN wish USING (request)) x WHERE b IS NULL OR b > 57600 OR no_flight = 1 OR NOT ground),
 f AS (SELECT * FROM e c WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.request = c.request AND o.total_s <= c.total_s AND o.cost <= c.cost AND o.transfers <= c.transfers AND (objective IN ('fastest', 'cheapest', 'fewest_transfers') OR (o.car_km <= c.car_km AND o.emissions <= c.emissions))
   AND (o.total_s < c.total_s OR o.cost < c.cost OR o.transfers < c.transfers OR (objective NOT IN ('fastest', 'cheapest', 'fewest_transfers') AND (o.car_km < c.car_km OR o.emissions < c.emissions)))))
 SELECT request, cand, objective, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY {_ORDERED}, cand) AS r FROM f) x WHERE r <= top""")
def ranked_contracts(spark, sf):
    """Of each request's candidates the top by its own objective and number, without flights where it says so and others get there in a day."""
    c, k = _cands(spark, sf), F.col("request")
    wish = c.select("request").distinct().select("request", F.element_at(F.array(*map(F.lit, planner.ORDER)), (1 + k % 6).cast("int")).alias("objective"), (1 + k % 4).alias("top"), F.when(k % 3 == 0, F.array(F.lit("flight"))).otherwise(F.array().cast("array<string>")).alias("exclude"))
    return contracts.ranked(c, wish).select("request", "cand", "objective", "rank")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earliest arrivals of all requests, with what they take."""
    r = view(spark, sf_dir, "requests").select("request", "origin", "dest", "depart")
    return r.join(earliest_arrival(spark, sf_dir), "request").withColumn("took", planner.humanize(F.col("arrive") - F.col("depart")))


def _shipped(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict:
    import wayloom.journeys_sources  # noqa: F401 (adds its queries)

    return {n: _shipped(f) for n, f in _Q.items()}


def oracle_sql() -> dict[str, str]:
    import wayloom.journeys_sources  # noqa: F401

    return dict(_SQL)
