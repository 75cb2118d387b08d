"""Road graphs from tagged ways: segments, classes, times, directions, ferries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions import parsing
from wayloom.functions.geo import bearing, haversine_km
from wayloom.functions.pricing import choose
from wayloom.functions.validity import open_months

#: Free-flow speed by road class in km/h, and of car ferries without a duration.
SPEEDS = {
    "motorway": 110.0, "motorway_link": 70.0, "trunk": 90.0, "trunk_link": 60.0, "primary": 80.0, "primary_link": 50.0,
    "secondary": 70.0, "secondary_link": 50.0, "tertiary": 60.0, "tertiary_link": 40.0, "unclassified": 50.0,
    "residential": 30.0, "living_street": 10.0, "service": 20.0, "road": 40.0, "track": 20.0,
}
FERRY_KMH = 30.0
CLOSURES = ["motor_vehicle:conditional", "motorcar:conditional", "vehicle:conditional", "access:conditional"]


def arcs_of(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """way, tail, head, base_seconds, class, km, bearing, open_months, name of every driving arc.

    ways (way, refs array, tags map), nodes (node, lat, lon). A ferry's crossing time is shared by its segments in
    proportion to their length, a second each at least; segments of unknown nodes are left out.
    """
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    ferry = F.coalesce(parsing.car_ferry(F.col("tags")), F.lit(False))
    w = ways.withColumn("class", F.when(ferry, "ferry").otherwise(tag("highway"))).where(F.col("class").isin("ferry", *SPEEDS))
    direction = parsing.oneway(tag("oneway"), tag("junction"))
    kmh = parsing.maxspeed(tag("maxspeed"), choose(F.col("class"), SPEEDS, FERRY_KMH))
    w = w.select("way", "class", direction.alias("direction"), kmh.alias("kmh"), parsing.duration_seconds(tag("duration")).alias("crossing"), tag("name").alias("name"), open_months(F.col("tags"), CLOSURES).alias("open_months"), F.posexplode("refs").alias("k", "node"))
    w = w.join(nodes.select("node", "lat", "lon"), "node", "left")
    step = Window.partitionBy("way").orderBy("k")
    nxt = {c: F.lead(c).over(step) for c in ("node", "lat", "lon")}
    s = w.select("*", nxt["node"].alias("to"), nxt["lat"].alias("lat2"), nxt["lon"].alias("lon2")).where("to is not null and lat is not null and lat2 is not null")
    s = s.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")))
    all_of = Window.partitionBy("way")
    total = F.sum("km").over(all_of)
    share = F.when(total > 0, F.col("km") / total).otherwise(F.lit(1.0) / F.count("*").over(all_of))
    driven = F.col("km") / F.when(F.col("class") == "ferry", F.lit(FERRY_KMH)).otherwise(F.col("kmh")) * 3600
    seconds = F.when((F.col("class") == "ferry") & F.col("crossing").isNotNull(), F.greatest(F.lit(1.0), F.col("crossing") * share)).otherwise(driven)
    s = s.withColumns({"base_seconds": F.bround(seconds).cast("int"), "there": bearing(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), "back": bearing(F.col("lat2"), F.col("lon2"), F.col("lat"), F.col("lon"))})
    arc = lambda a, b, c: F.struct(F.col(a).alias("tail"), F.col(b).alias("head"), F.col(c).alias("bearing"))
    ends = F.when(F.col("direction") == 1, F.array(arc("node", "to", "there"))).when(F.col("direction") == -1, F.array(arc("to", "node", "back"))).otherwise(F.array(arc("node", "to", "there"), arc("to", "node", "back")))
    return s.select("way", F.explode(ends).alias("e"), "base_seconds", "class", "km", "open_months", "name").select("way", "e.*", "base_seconds", "class", "km", "open_months", "name")


def network_of(ways: DataFrame, nodes: DataFrame, relations: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(arcs with arc, their number; nodes on them with signal; forbidden turns) of tagged ways (way, refs, tags), nodes (node, lat, lon, and tags or
    none) and restriction relations (of restrictions.relations()): all that a search by legal turns needs. Written."""
    from wayloom.operators.fixpoint import written
    from wayloom.operators.restrictions import forbidden_turns

    arcs = written(arcs_of(ways, nodes).withColumn("arc", F.monotonically_increasing_id()), "arcs")
    lit = F.coalesce(F.try_element_at("tags", F.lit("highway")) == "traffic_signals", F.lit(False)) if "tags" in nodes.columns else F.lit(False)
    used = arcs.select(F.explode(F.array("tail", "head")).alias("node")).distinct()
    own = written(nodes.select("node", "lat", "lon", lit.alias("signal")).join(used, "node", "left_semi"), "nodes")
    return arcs, own, None if relations is None else written(forbidden_turns(relations, arcs), "barred")
