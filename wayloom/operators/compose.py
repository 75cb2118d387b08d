"""Timetables for a whole table of trips: which feeds serve each, clipped to its corridor, up to a number of trips.

A feed is chosen by its box: those that hold both ends, the smallest first, as many as are tried; curated ones if they hold
either end. Trips with one corridor share its clip: stops meet corridors in squares, and the calls of a feed are joined once
with all corridors that ask for it, as identifiers, then counted. Nothing is looked up trip by trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.operators import spatial
from wayloom.operators.feeds import ATTEMPTS, MARGIN, MOST_TRIPS
from wayloom.operators.fixpoint import written

BOX = ("lat0", "lon0", "lat1", "lon1")


def corridors(trips: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(request, corridor, lat0, lon0, lat1, lon1): the box around both ends of trips (request, lat, lon, lat2, lon2); corridor names it."""
    low, high = (lambda a, b: F.least(a, b) - margin), (lambda a, b: F.greatest(a, b) + margin)
    box = trips.select("request", low("lat", "lat2").alias("lat0"), low("lon", "lon2").alias("lon0"), high("lat", "lat2").alias("lat1"), high("lon", "lon2").alias("lon1"))
    return box.withColumn("corridor", F.concat_ws(" ", *BOX))


def candidates(trips: DataFrame, catalog: DataFrame, curated: DataFrame | None = None, attempts: int = ATTEMPTS) -> DataFrame:
    """(request, feed_id, curated, place): the feeds (feed_id and box) tried for each trip in order of area, and the curated ones, which have no place."""
    ends = trips.select("request", F.explode(F.array(F.struct("lat", "lon"), F.struct(F.col("lat2").alias("lat"), F.col("lon2").alias("lon")))).alias("p")).select("request", "p.*")
    w = Window.partitionBy("request").orderBy("area", "feed_id")
    tried = spatial.covering(ends, catalog, "request", "feed_id").withColumn("place", F.row_number().over(w)).where(F.col("place") <= attempts)
    out = tried.select("request", "feed_id", F.lit(False).alias("curated"), "place")
    if curated is not None:
        out = out.unionByName(spatial.touching(ends, curated, "request", "feed_id").withColumns({"curated": F.lit(True), "place": F.lit(None).cast("int")}))
    return out


def clipped(pairs: DataFrame, boxes: DataFrame, stops: DataFrame, calls: DataFrame) -> DataFrame:
    """(feed_id, corridor, trip_id) of the trips with two calls or more in a corridor, for pairs (feed_id, corridor) and boxes (corridor and box);
    stops (feed_id, stop_id, lat, lon), calls (feed_id, trip_id, stop_id)."""
    asked = pairs.select("feed_id", "corridor").distinct()
    served = stops.join(asked.select("feed_id").distinct(), "feed_id", "left_semi").select("feed_id", "stop_id", "lat", "lon")
    inside = spatial._in_boxes(served, boxes.join(asked.select("corridor").distinct(), "corridor", "left_semi")).select("feed_id", "corridor", "stop_id").join(asked, ["feed_id", "corridor"], "left_semi")
    met = calls.select("feed_id", "trip_id", "stop_id").join(inside, ["feed_id", "stop_id"])
    return met.groupBy("feed_id", "corridor", "trip_id").count().where("count >= 2").drop("count")


def compose_each(trips: DataFrame, catalog: DataFrame, stops: DataFrame, calls: DataFrame, curated: DataFrame | None = None, margin: float = MARGIN, attempts: int = ATTEMPTS, most_trips: int = MOST_TRIPS) -> tuple[DataFrame, DataFrame]:
    """(chosen, service) for trips (request, lat, lon, lat2, lon2).

    chosen: request, feed_id, curated, place, n_trips (in the corridor), kept, note; a feed is kept while the running number of trips
    doesn't pass most_trips (the first with service always), curated ones beyond that number. A trip that no feed covers has one row
    without a feed. service: request, feed_id, trip_id of what is kept."""
    boxes = written(corridors(trips, margin), "corridors")
    pairs = written(candidates(trips, catalog, curated, attempts).join(boxes.select("request", "corridor"), "request"), "pairs")
    found = written(clipped(pairs, boxes.select("corridor", *BOX).distinct(), stops, calls), "clipped")
    n = found.groupBy("feed_id", "corridor").agg(F.count("*").alias("n"))
    each = pairs.join(n, ["feed_id", "corridor"], "left").withColumn("n_trips", F.coalesce("n", F.lit(0)))
    order = Window.partitionBy("request", "curated").orderBy("place", "feed_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumns({"total": F.sum("n_trips").over(so_far), "before": F.coalesce(F.sum("n_trips").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    each = each.withColumn("full", F.max((~F.col("curated") & (F.col("n_trips") > 0) & (F.col("before") > 0) & (F.col("total") > most_trips)).cast("int")).over(so_far) == 1)
    each = each.withColumn("kept", (F.col("n_trips") > 0) & ~F.col("full"))
    note = F.when(F.col("full"), "beyond the number of trips").when(F.col("n_trips") == 0, "no service in the corridor")
    chosen = written(each.select("request", "corridor", "feed_id", "curated", "place", "n_trips", "kept", note.alias("note")), "chosen")
    without = trips.select("request").join(chosen.where("not curated").select("request"), "request", "left_anti")
    none = {c: F.lit(None).cast(t) for c, t in chosen.dtypes if c not in ("request", "kept", "note")}
    bare = without.withColumns({**none, "kept": F.lit(False), "note": F.lit("no feed covers this trip")})
    service = chosen.where("kept").select("request", "feed_id", "corridor").join(found, ["feed_id", "corridor"]).select("request", "feed_id", "trip_id")
    return chosen.unionByName(bare).drop("corridor"), service
