"""Results as records and JSON, texts of legs, and the credits of what a result drew on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.operators.planner import clock, humanize

#: What a mode is called in a step; modes between stops name both ends.
VERBS = {"walk": "Walk", "car": "Drive", "train": "Train", "ferry": "Ferry", "flight": "Flight"}
LINE_HAUL = ("train", "ferry", "flight")


def iso(seconds, day: str):
    """Seconds of a day as an ISO time, whole seconds."""
    return F.date_format(F.timestamp_add("SECOND", F.floor(seconds).cast("long"), F.lit(day).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss")


def describe(mode, from_name, to_name):
    """'Train from A to B', 'Walk to B'."""
    verb = F.initcap(mode)
    for m, v in VERBS.items():
        verb = F.when(mode == m, F.lit(v)).otherwise(verb)
    return F.when(mode.isin(*LINE_HAUL), F.concat(verb, F.lit(" from "), from_name, F.lit(" to "), to_name)).otherwise(F.concat(verb, F.lit(" to "), to_name))


def leg_records(legs: DataFrame) -> DataFrame:
    """A row for each leg (request, cand, leg_no, mode, km, travel_s, overhead_s) with its clock and its duration as text."""
    return clock(legs).select("request", "cand", "leg_no", "mode", "km", "travel_s", "overhead_s", "depart_s", "arrive_s", humanize(F.col("travel_s") + F.col("overhead_s")).alias("duration_human"))


def itinerary_records(ranked: DataFrame, depart_s, day: str) -> DataFrame:
    """A row for each ranked candidate: times in ISO, durations in seconds and as text."""
    return ranked.select(
        "request", "cand", "rank", "primary_mode", iso(depart_s, day).alias("depart_at"), iso(depart_s + F.col("total_s"), day).alias("arrive_at"), F.col("total_s").alias("total_duration_s"),
        humanize(F.col("total_s")).alias("total_duration_human"), "km", "cost_level", F.col("cost").alias("fare_estimate"), F.col("transfers").alias("num_transfers"),
    )


def as_json(records: DataFrame, legs: DataFrame) -> DataFrame:
    """(request, cand, json): each itinerary record with its legs in order."""
    own = [c for c in records.columns if c not in ("request", "cand")]
    parts = legs.groupBy("request", "cand").agg(F.array_sort(F.collect_list(F.struct("leg_no", "mode", "km", "travel_s", "overhead_s"))).alias("legs"))
    return records.join(parts, ["request", "cand"]).select("request", "cand", F.to_json(F.struct(*own, "legs")).alias("json"))


#: The credits that data sources ask for: name, license, source, license's address.
CREDITS = {
    "air": ("OpenFlights", "Open Database License (ODbL) v1.0", "https://openflights.org/data.html", "https://opendatacommons.org/licenses/odbl/1-0/"),
    "ground": ("Mobility Database (MobilityData) -- GTFS feed catalog", "catalog metadata under CC0 1.0; each feed under its own license", "https://mobilitydatabase.org/", "https://creativecommons.org/publicdomain/zero/1.0/"),
    "road": ("OpenStreetMap contributors (extracts via Geofabrik)", "Open Database License (ODbL) v1.0", "https://www.openstreetmap.org/copyright", "https://opendatacommons.org/licenses/odbl/1-0/"),
}
CREDIT = "n long, name string, license string, source_url string, license_url string"


def feed_credits(feeds: DataFrame) -> DataFrame:
    """(name, license, source_url, license_url) of feeds (feed_id, provider, name, country, url, license_url)."""
    text = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    name = F.coalesce(text("provider"), text("name"), F.concat(F.lit("feed "), F.col("feed_id").cast("string")))
    name = F.when(text("country").isNotNull(), F.concat(name, F.lit(" ("), F.col("country"), F.lit(")"))).otherwise(name)
    return feeds.select(name.alias("name"), F.lit("").alias("license"), F.coalesce("url", F.lit("")).alias("source_url"), F.coalesce("license_url", F.lit("")).alias("license_url"))


def credits(spark: SparkSession, feeds: DataFrame | None = None, air: bool = True, ground: bool = True, road: bool = True) -> DataFrame:
    """The credits of what a result used, with line (one line each); feeds count only with ground."""
    used = [(k, *CREDITS[name]) for k, (name, wanted) in enumerate((("air", air), ("ground", ground), ("road", road))) if wanted]
    out = spark.createDataFrame(used, CREDIT)
    if feeds is not None and ground:
        out = out.unionByName(feed_credits(feeds).withColumn("n", F.lit(1).cast("long")))
    url = F.coalesce(F.nullif("license_url", F.lit("")), F.nullif("source_url", F.lit("")))
    line = F.concat("name", F.when(F.col("license") != "", F.concat(F.lit(": "), "license")).otherwise(""), F.when(url.isNotNull(), F.concat(F.lit(" <"), url, F.lit(">"))).otherwise(""))
    return out.withColumn("line", line)
