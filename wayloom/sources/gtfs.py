"""GTFS feed folders as stops, trips, calls and footpaths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions.geo import haversine_km
from wayloom.functions.parsing import gtfs_seconds, route_mode
from wayloom.operators.feeds import Timetable
from wayloom.operators.timetable import expand_frequencies, valid_trips
from wayloom.sources import archives


def table(spark: SparkSession, feed: str | DataFrame, name: str, columns: list[str]) -> DataFrame | None:
    """A file of the feed with all named columns as strings (null where the file lacks one); None without the file. A file that isn't
    UTF-8 is Latin-1. One pass over the lines, in parts, tells the encoding and whether any quoted field goes on over a line's
    end; only then is the file read as a whole, else its parts are read by themselves. feed is a folder or an unpacked archive."""
    if isinstance(feed, DataFrame):
        df = archives.member(feed, name, columns)
        return df if df is None or name == "transfers" else df.drop("__line")  # the order of transfers counts
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{feed}/{name}.txt")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd, latin = spark.read.text(f"{feed}/{name}.txt").agg(F.bool_or(quotes % 2 == 1), F.bool_or(~F.is_valid_utf8("value"))).first()
    df = spark.read.option("header", True).option("multiLine", bool(odd)).option("encoding", "ISO-8859-1" if latin else "UTF-8").csv(f"{feed}/{name}.txt")
    df = df.toDF(*[c.removeprefix("\u00ef\u00bb\u00bf").lstrip("\ufeff").strip() for c in df.columns])
    return df.select(*[F.trim(F.col(c)).alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def zones(spark: SparkSession) -> DataFrame:
    """The names of all time zones (tz)."""
    from zoneinfo import available_timezones

    return spark.createDataFrame([(z,) for z in sorted(available_timezones())], "tz string")


def with_valid_zone(df: DataFrame, column: str = "tz") -> DataFrame:
    """df with the column null where it names no time zone."""
    known = zones(df.sparkSession).select(F.col("tz").alias("__tz"))
    return df.withColumn(column, F.trim(F.col(column))).join(F.broadcast(known), F.col(column) == F.col("__tz"), "left").withColumn(column, F.col("__tz")).drop("__tz")


def feed_zone(agency: DataFrame) -> DataFrame:
    """The most common valid zone of a feed's agencies (agency_timezone), of equally common ones the first; one row (tz) or none."""
    a = with_valid_zone(agency.select(F.col("agency_timezone").alias("tz"), F.monotonically_increasing_id().alias("n"))).where("tz is not null")
    return a.groupBy("tz").agg(F.count("*").alias("k"), F.min("n").alias("first")).orderBy(F.desc("k"), "first").limit(1).select("tz")


DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def services(calendar: DataFrame | None, exceptions: DataFrame | None) -> DataFrame | None:
    """service_id with start_day, end_day, weekdays, added, removed. A service of exceptions alone spans its added days."""
    day = lambda c: F.try_to_timestamp(F.col(c), F.lit("yyyyMMdd")).cast("date")
    if calendar is None and exceptions is None:
        return None
    base = by_day = None
    if calendar is not None:
        on = F.filter(F.array(*[F.when(F.col(d) == "1", i) for i, d in enumerate(DAYS)]), lambda x: x.isNotNull())
        base = calendar.select("service_id", day("start_date").alias("start_day"), day("end_date").alias("end_day"), on.alias("weekdays"))
    if exceptions is not None:
        kind = F.col("exception_type").try_cast("int")
        by_day = exceptions.withColumn("day", day("date")).groupBy("service_id").agg(F.collect_set(F.when(kind == 1, F.col("day"))).alias("added"), F.collect_set(F.when(kind == 2, F.col("day"))).alias("removed"))
    none = F.array().cast("array<date>")
    if base is None:
        base = by_day.limit(0).select("service_id", F.lit(None).cast("date").alias("start_day"), F.lit(None).cast("date").alias("end_day"), F.array().cast("array<int>").alias("weekdays"))
    s = base.join(by_day, "service_id", "full_outer") if by_day is not None else base.withColumns({"added": none, "removed": none})
    added = F.array_sort(F.coalesce("added", none))
    s = s.where(F.col("start_day").isNotNull() | (F.size(added) > 0))
    return s.select("service_id", F.coalesce("start_day", F.array_min(added)).alias("start_day"), F.coalesce("end_day", F.array_max(added)).alias("end_day"), F.coalesce("weekdays", F.array().cast("array<int>")).alias("weekdays"), added.alias("added"), F.array_sort(F.coalesce("removed", none)).alias("removed"))


def read_gtfs(spark: SparkSession, feed: str | DataFrame) -> Timetable:
    """A feed's folder, its zip archive, or what archives.unpack() made of one."""
    if isinstance(feed, str) and feed.endswith(".zip"):
        feed = archives.unpack(spark, feed)
    stops = table(spark, feed, "stops", ["stop_id", "stop_name", "stop_lat", "stop_lon", "stop_timezone", "parent_station"])
    number = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", 0.0).otherwise(F.col(c).try_cast("double"))
    stops = stops.select("stop_id", F.coalesce("stop_name", "stop_id").alias("name"), number("stop_lat").alias("lat"), number("stop_lon").alias("lon"), F.lit("rail_station").alias("stop_type"), F.col("stop_timezone").alias("tz"), "parent_station").where("lat is not null and lon is not null")
    stops = with_valid_zone(stops)
    if (agency := table(spark, feed, "agency", ["agency_timezone"])) is not None:
        stops = stops.join(F.broadcast(feed_zone(agency).select(F.col("tz").alias("__tz"))), how="left").withColumn("tz", F.coalesce("tz", "__tz")).drop("__tz")
    routes = table(spark, feed, "routes", ["route_id", "route_type"]).select("route_id", route_mode(F.col("route_type")).alias("mode"))
    trips = table(spark, feed, "trips", ["route_id", "service_id", "trip_id"]).join(routes, "route_id", "left").withColumn("mode", F.coalesce("mode", F.lit("train")))
    s = services(table(spark, feed, "calendar", ["service_id", *DAYS, "start_date", "end_date"]), table(spark, feed, "calendar_dates", ["service_id", "date", "exception_type"]))
    trips = trips.join(s, "service_id") if s is not None else trips
    times = table(spark, feed, "stop_times", ["trip_id", "stop_sequence", "stop_id", "arrival_time", "departure_time"])
    blank = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    a, d = blank("arrival_time"), blank("departure_time")
    calls = times.select("trip_id", F.col("stop_sequence").try_cast("double").try_cast("int").alias("seq"), "stop_id", gtfs_seconds(F.coalesce(a, d)).alias("arr_s"), gtfs_seconds(F.coalesce(d, a)).alias("dep_s"))
    calls = calls.where("seq is not null and arr_s is not null and dep_s is not null")
    calls = calls.join(trips.select("trip_id"), "trip_id", "left_semi").join(valid_trips(calls), "trip_id", "left_semi")
    freq = table(spark, feed, "frequencies", ["trip_id", "start_time", "end_time", "headway_secs"])
    if freq is not None:
        f = freq.select("trip_id", gtfs_seconds(F.col("start_time")).alias("start_s"), gtfs_seconds(F.col("end_time")).alias("end_s"), F.col("headway_secs").try_cast("int").alias("headway_s"))
        calls = expand_frequencies(calls, f, template="__of")
        trips = calls.select("trip_id", "__of").distinct().join(trips.withColumnRenamed("trip_id", "__of"), "__of").drop("__of")
        calls = calls.drop("__of")
    stops, footpaths = transfers(stops, table(spark, feed, "transfers", ["from_stop_id", "to_stop_id", "transfer_type", "min_transfer_time"]))
    return Timetable(stops, trips, calls, footpaths)


#: A stop's change time, the pace between stops, and the walk between stops at one place.
CHANGE_S, WALK_KMH, LEAST_S = 300, 4.5, 60.0


def transfers(stops: DataFrame, rules: DataFrame | None, walk_kmh: float = WALK_KMH) -> tuple[DataFrame, DataFrame]:
    """Stops with min_transfer_s (null: no change allowed) and footpaths, from transfer rules and from parent stations.

    A rule for one stop sets its change time: type 3 forbids it, type 1 makes it 0, else the rule's time counts if it names one;
    of several the last that sets it. A rule between stops is a footpath of its time, if that is positive, else of the walk
    (LEAST_S at one place); type 3 is none. Rules of unknown stops don't count."""
    here = stops.select("stop_id", "lat", "lon")
    there = here.toDF("to_stop", "to_lat", "to_lon")
    walk = haversine_km(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon")) / walk_kmh * 3600
    walk = F.when(walk > 0, walk).otherwise(LEAST_S)
    linked = stops.where("parent_station is not null and parent_station <> '' and parent_station <> stop_id").select("stop_id", "lat", "lon", F.col("parent_station").alias("to_stop"))
    up = linked.join(there, "to_stop").select(F.col("stop_id").alias("from_stop"), "to_stop", walk.alias("dur_s"))
    feet = up.unionByName(up.select(F.col("to_stop").alias("from_stop"), F.col("from_stop").alias("to_stop"), "dur_s"))
    if rules is None:
        return stops.withColumn("min_transfer_s", F.lit(CHANGE_S)), feet
    kind, least = F.coalesce(F.col("transfer_type").try_cast("int"), F.lit(0)), F.col("min_transfer_time").try_cast("int")
    r = rules.select(F.col("from_stop_id").alias("from_stop"), F.col("to_stop_id").alias("to_stop"), kind.alias("kind"), F.when(least >= 0, least).alias("least"), (F.col("__line") if "__line" in rules.columns else F.monotonically_increasing_id()).alias("n"))
    sets = F.when(F.col("kind") == 3, F.lit(-1)).when(F.col("kind") == 1, F.lit(0)).otherwise(F.col("least"))  # -1 stands for never
    same = r.where("from_stop = to_stop").withColumn("sets", sets).where("sets is not null").groupBy(F.col("from_stop").alias("stop_id")).agg(F.max_by("sets", "n").alias("sets"))
    stops = stops.join(same, "stop_id", "left").withColumn("min_transfer_s", F.when(F.col("sets") < 0, None).otherwise(F.coalesce("sets", F.lit(CHANGE_S)))).drop("sets")
    between = r.where("from_stop <> to_stop and kind <> 3").join(here.withColumnRenamed("stop_id", "from_stop"), "from_stop").join(there, "to_stop")
    timed = between.select("from_stop", "to_stop", F.when(F.col("least") > 0, F.col("least").cast("double")).otherwise(walk).alias("dur_s"))
    return stops, timed.unionByName(feet).groupBy("from_stop", "to_stop").agg(F.min("dur_s").alias("dur_s"))
