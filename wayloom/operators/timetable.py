"""Timetables: calls, connections of a window, merging, clipping, links and zones."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions.geo import haversine_km
from wayloom.functions.validity import is_active, runs_on

CHANGE_S = 300


def valid_trips(calls: DataFrame) -> DataFrame:
    """trip_id of trips with two calls or more whose times never go back."""
    w = Window.partitionBy("trip_id").orderBy("seq")
    steps = calls.select("trip_id", (F.col("arr_s") > F.col("dep_s")).alias("back"), (F.col("arr_s") < F.lag("dep_s").over(w)).alias("early"))
    return steps.groupBy("trip_id").agg(F.count("*").alias("n"), F.bool_or("back").alias("b"), F.bool_or(F.coalesce("early", F.lit(False))).alias("e")).where("n >= 2 and not b and not e").select("trip_id")


def segments(calls: DataFrame) -> DataFrame:
    """Adjacent calls of each trip: trip_id, seq, dep_stop, arr_stop, dep_s, arr_s."""
    w = Window.partitionBy("trip_id").orderBy("seq")
    s = calls.select("trip_id", "seq", F.col("stop_id").alias("dep_stop"), "dep_s", F.lead("stop_id").over(w).alias("arr_stop"), F.lead("arr_s").over(w).alias("arr_s"))
    return s.where("arr_stop is not null")


def active_days(trips: DataFrame, first: str, last: str, conditions: list[str]) -> DataFrame:
    """(trip_id, mode, day) of the service days between two dates on which a trip runs."""
    days = trips.withColumn("day", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))))
    calendar = runs_on(F.col("day"), *(F.col(c) for c in ("start_day", "end_day", "weekdays", "added", "removed")))
    return days.where(is_active(F.col("day"), calendar, F.col("open_months"), F.col("required"), F.col("forbidden"), conditions)).select("trip_id", "mode", "day")


#: A service day's look-back and, with zones, its look-ahead: a day at least, and more where a trip's calls run on for longer.
DAY_S = 86_400


def most_offset(calls: DataFrame) -> DataFrame:
    """One row: the latest departure of any call, in seconds of its service day."""
    return calls.agg(F.max("dep_s").alias("dep_s"))


def trip_zones(calls: DataFrame, stops: DataFrame) -> DataFrame:
    """(trip_id, zone): one zone for all times of a trip, that of its first stop, else the feed's most common one, else UTC."""
    first = calls.groupBy("trip_id").agg(F.min_by("stop_id", "seq").alias("stop_id"))
    known = first.join(stops.select("stop_id", "tz"), "stop_id", "left").join(F.broadcast(zone_of_feed(stops).select(F.col("tz").alias("__tz"))), how="left")
    return known.select("trip_id", F.coalesce("tz", "__tz", F.lit("UTC")).alias("zone"))


def zoned(stops: DataFrame | None) -> bool:
    return stops is not None and not stops.where("tz is not null").isEmpty()


def _runs(trips: DataFrame, calls: DataFrame, days: list, stops: DataFrame | None, more: list[str]) -> DataFrame:
    """Segments of the runs of trips on days that their calendars and months allow, with dep and arr (timestamps; UTC with zones) and the
    columns of trips in more; trips that can't run on any day go before their days are listed, calls of trips that don't run before they are sorted."""
    asked = F.array(*map(F.lit, days)).cast("array<date>")
    near = F.filter(asked, lambda d: d.between(F.col("start_day"), F.col("end_day")) | F.array_contains("added", d))
    runs = trips.withColumn("day", F.explode(near))
    calendar = runs_on(F.col("day"), *(F.col(c) for c in ("start_day", "end_day", "weekdays", "added", "removed")))
    months = (F.size("open_months") == 0) | F.array_contains("open_months", F.month("day"))
    runs = runs.where(calendar & months).select("trip_id", "mode", "day", *more)
    own = calls.join(runs.select("trip_id").distinct(), "trip_id", "left_semi")
    if zoned(stops):
        runs = runs.join(trip_zones(own, stops), "trip_id")
        at = lambda s: utc(F.col("day"), F.col(s), F.col("zone"))
    else:
        at = lambda s: (F.col("day").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col(s).cast("decimal(18,6)")))
    c = runs.join(good_segments(own), "trip_id").select("trip_id", "mode", "day", *more, "seq", "dep_stop", "arr_stop", at("dep_s").alias("dep"), at("arr_s").alias("arr"))
    return c.where("arr > dep")


def _days(start: datetime, end: datetime, calls: DataFrame, aware: bool) -> list:
    """The service days whose runs may leave between two times: as far back as the latest call, and with zones a day ahead."""
    back = max(DAY_S, most_offset(calls).first()[0] or 0)
    first, last = (start - timedelta(seconds=back)).date(), (end + timedelta(days=int(aware))).date()
    return [first + timedelta(days=k) for k in range((last - first).days + 1)]


def _holds(conditions) -> Column:
    """Whether all conditions that a trip requires are given (an array column), and none that it forbids."""
    return (F.size(F.array_except("required", conditions)) == 0) & (F.size(F.array_intersect("forbidden", conditions)) == 0)


def connections(trips: DataFrame, calls: DataFrame, start: str, end: str, conditions: list[str], stops: DataFrame | None = None) -> DataFrame:
    """run_id, trip_id, mode, seq, dep_stop, arr_stop, dep, arr (timestamps) of the runs that can be boarded in [start, end].

    A run counts if one of its segments leaves within the window; its later segments come along, earlier ones don't. With stops
    of which any has a zone (tz), start, end, dep and arr are UTC: a trip's service days are local to its zone. Service days
    are looked back for as far as the latest call of any trip, a day at least."""
    days = _days(datetime.fromisoformat(start), datetime.fromisoformat(end), calls, zoned(stops))
    c = _runs(trips.where(_holds(F.array(*map(F.lit, conditions)).cast("array<string>"))), calls, days, stops, [])
    run = F.concat_ws("@", F.col("trip_id").cast("string"), F.col("day").cast("string")).alias("run_id")
    c = c.where(F.col("dep") >= F.lit(start).cast("timestamp_ntz")).select(run, "trip_id", "mode", "seq", "dep_stop", "arr_stop", "dep", "arr")
    boardable = c.where(F.col("dep") <= F.lit(end).cast("timestamp_ntz")).select("run_id").distinct()
    return c.join(boardable, "run_id", "left_semi")


def connection_sets(sets: DataFrame, trips: DataFrame, calls: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """connections() of many windows in one job: set, run_id (its own for each set), trip_id, mode, seq, dep_stop, arr_stop, dep, arr for
    sets (set, start, end, conditions). Runs of all days are made once; a set takes those of its days that its conditions allow.

    Days are listed in the driver: those of the windows, by the calendar."""
    aware = zoned(stops)
    ends = sets.agg(F.max(F.timestamp_diff("DAY", "start", "end"))).first()[0]
    starts = [r[0] for r in sets.select(F.col("start").cast("date")).distinct().collect()]
    if not starts:
        starts, ends = [date(1970, 1, 1)], 0
    back = max(DAY_S, most_offset(calls).first()[0] or 0)
    reach = range(-(-(-back // DAY_S)) - 1, ends + 3)
    days = sorted({d + timedelta(days=k) for d in starts for k in reach})
    runs = _runs(trips, calls, days, stops, ["required", "forbidden"])
    first = F.to_date(F.col("start") - F.make_dt_interval(secs=F.lit(back).cast("decimal(18,6)")))
    last = F.date_add(F.to_date("end"), int(aware))
    near = sets.select("set", F.col("start").alias("__from"), F.col("end").alias("__to"), F.col("conditions").alias("__given"), F.explode(F.sequence(first, last)).alias("day"))
    c = runs.join(near, "day").where(_holds(F.col("__given")) & (F.col("dep") >= F.col("__from")))
    run = F.concat_ws("@", "set", F.col("trip_id").cast("string"), F.col("day").cast("string"))
    c = c.select("set", run.alias("run_id"), "trip_id", "mode", "seq", "dep_stop", "arr_stop", "dep", "arr", "__to")
    boardable = c.where("dep <= __to").select("run_id").distinct()
    return c.drop("__to").join(boardable, "run_id", "left_semi")


def instants(requests: DataFrame, key: str, stops: DataFrame | None) -> DataFrame:
    """requests (key, lat, lon, depart, a local time) with depart in UTC: it is read in the zone of the stop nearest to the door; without
    any zone it stays as it is."""
    if not zoned(stops):
        return requests
    from wayloom.operators.spatial import zone_of_doors

    zone = zone_of_doors(requests.select(key, "lat", "lon"), key, stops, zone_of_feed(stops)).withColumnRenamed("tz", "__zone")
    return requests.join(zone, key, "left").withColumn("depart", F.convert_timezone(F.coalesce("__zone", F.lit("UTC")), F.lit("UTC"), F.col("depart"))).drop("__zone")


def good_segments(calls: DataFrame) -> DataFrame:
    """segments() of valid_trips(), in one pass over the calls of a trip."""
    w, whole = Window.partitionBy("trip_id").orderBy("seq"), Window.partitionBy("trip_id")
    bad = (F.col("arr_s") > F.col("dep_s")) | F.coalesce(F.col("arr_s") < F.lag("dep_s").over(w), F.lit(False))
    s = calls.select("trip_id", "seq", F.col("stop_id").alias("dep_stop"), "dep_s", F.lead("stop_id").over(w).alias("arr_stop"), F.lead("arr_s").over(w).alias("next_s"), bad.alias("bad"))
    s = s.withColumn("bad", F.max("bad").over(whole)).where("not bad and arr_stop is not null")
    return s.select("trip_id", "seq", "dep_stop", "arr_stop", "dep_s", F.col("next_s").alias("arr_s"))


def merge_stops(feeds: DataFrame, apart_km: float = 1.0) -> DataFrame:
    """Stops (feed, stop_id, lat, lon, ...) of several feeds with new_id: the first feed's stop keeps its id; another
    feed's stop of the same id that lies farther than apart_km is another stop."""
    w = Window.partitionBy("stop_id").orderBy("feed")
    first = F.first(F.struct("lat", "lon")).over(w)
    far = haversine_km(F.col("lat"), F.col("lon"), first["lat"], first["lon"]) > apart_km
    return feeds.withColumn("new_id", F.when(far, F.concat_ws("#", F.col("stop_id").cast("string"), F.col("feed").cast("string"))).otherwise(F.col("stop_id").cast("string")))


def clip(calls: DataFrame, stops: DataFrame, lat0: float, lon0: float, lat1: float, lon1: float) -> DataFrame:
    """All calls of the trips with two calls or more in the box."""
    inside = stops.where(F.col("lat").between(lat0, lat1) & F.col("lon").between(lon0, lon1)).select("stop_id")
    kept = calls.join(inside, "stop_id", "left_semi").groupBy("trip_id").count().where("count >= 2")
    return calls.join(kept, "trip_id", "left_semi")


def expand_frequencies(calls: DataFrame, windows: DataFrame, most: int = 2000, template: str | None = None) -> DataFrame:
    """Calls of every run of frequency windows (trip_id, start_s, end_s, headway_s) and of the trips without any; template names a
    column for the trip that a run comes from."""
    good = windows.where("headway_s > 0 and end_s > start_s").where(F.floor((F.col("end_s") - F.col("start_s")) / F.col("headway_s")) <= most)
    runs = good.select("trip_id", F.explode(F.sequence(F.col("start_s"), F.col("end_s") - 1, F.col("headway_s"))).alias("at")).distinct()
    anchor = calls.groupBy("trip_id").agg(F.min("dep_s").alias("anchor"))
    moved = calls.join(runs, "trip_id").join(anchor, "trip_id")
    shift = F.col("at") - F.col("anchor")
    of = [F.col("trip_id").cast("string").alias(template)] if template else []
    moved = moved.select(*of, F.concat_ws("#", F.col("trip_id").cast("string"), F.col("at").cast("string")).alias("trip_id"), "seq", "stop_id", (F.col("arr_s") + shift).alias("arr_s"), (F.col("dep_s") + shift).alias("dep_s"))
    rest = calls.join(good.select("trip_id").distinct(), "trip_id", "left_anti").withColumn("trip_id", F.col("trip_id").cast("string"))
    rest = rest.withColumn(template, F.col("trip_id")) if template else rest
    return moved.unionByName(rest.select(*moved.columns))


def utc(day, seconds, zone):
    """The instant of a wall-clock offset from a service day's midnight in a zone, as UTC without a zone."""
    local = day.cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return F.convert_timezone(zone, F.lit("UTC"), local)


def zone_of_feed(stops: DataFrame) -> DataFrame:
    """The most common zone; of equally common ones that of the smallest stop."""
    return stops.where("tz is not null").groupBy("tz").agg(F.count("*").alias("n"), F.min("stop_id").alias("first")).orderBy(F.desc("n"), "first").limit(1).select("tz", "n")


def next_departures(asks: DataFrame, conns: DataFrame, hours: int = 12) -> DataFrame:
    """For each ask (ask, stop, at in seconds) the first connection from the stop at or after it within hours, by arrival
    then run: an as-of join through hour buckets, so an ask meets only the connections of its next hours. Asks are merged, never broadcast:
    their size is judged before they are listed for each hour."""
    c = conns.select(F.col("dep_stop").alias("stop"), "dep", "arr", "run_id", F.floor(F.col("dep") / 3600).alias("bucket"))
    a = asks.select("ask", "stop", "at", F.explode(F.sequence(F.floor(F.col("at") / 3600), F.floor(F.col("at") / 3600) + hours)).alias("bucket"))
    hit = a.hint("merge").join(c, ["stop", "bucket"]).where((F.col("dep") >= F.col("at")) & (F.col("dep") <= F.col("at") + hours * 3600))
    return hit.groupBy("ask").agg(F.min(F.struct("dep", "arr", "run_id")).alias("m")).select("ask", "m.dep", "m.arr", "m.run_id")


def path_km(calls: DataFrame, stops: DataFrame) -> DataFrame:
    """trip_id and the length of its path: great circles between its consecutive stops."""
    w = Window.partitionBy("trip_id").orderBy("seq")
    p = calls.join(stops.select("stop_id", "lat", "lon"), "stop_id")
    step = haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return p.select("trip_id", step.alias("km")).groupBy("trip_id").agg(F.coalesce(F.sum("km"), F.lit(0.0)).alias("km"))
