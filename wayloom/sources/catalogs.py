"""Catalogs of feeds and regions, cities, and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "location.bounding_box."


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Usable GTFS feeds: not inactive or deprecated, without authentication, with an address and a full bounding box."""
    df = spark.read.option("header", True).csv(path).withColumn("__row", F.monotonically_increasing_id())
    text = lambda c: F.coalesce(F.trim(F.col(f"`{c}`")), F.lit(""))
    f = df.where((text("data_type") == "gtfs") & ~text("status").isin("inactive", "deprecated") & text("urls.authentication_type").isin("", "0"))
    url = F.coalesce(F.nullif(text("urls.latest"), F.lit("")), F.nullif(text("urls.direct_download"), F.lit("")))
    corner = {"lat0": "minimum_latitude", "lon0": "minimum_longitude", "lat1": "maximum_latitude", "lon1": "maximum_longitude"}
    f = f.select(text("mdb_source_id").alias("feed_id"), text("provider").alias("provider"), text("name").alias("name"), url.alias("url"), *[text(BOX + c).try_cast("double").alias(k) for k, c in corner.items()], "__row")
    f = f.dropna(subset=["url", *corner]).where("feed_id <> ''")
    names = [c for c in f.columns if c not in ("feed_id", "__row")]
    return f.groupBy("feed_id").agg(F.max_by(F.struct(*names), "__row").alias("f")).select("feed_id", "f.*")


REGIONS = "features array<struct<properties:struct<id:string,name:string,parent:string,urls:struct<pbf:string>>,geometry:struct<type:string,coordinates:string>>>"


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """region_id, name, parent, url, polygons array<array<array<struct<lon,lat>>>>, and the box of the outer rings."""
    f = spark.read.option("multiLine", True).schema(REGIONS).json(path).select(F.explode("features").alias("f")).select("f.properties.*", "f.geometry")
    f = f.where("id is not null and urls.pbf is not null")
    many = F.from_json("geometry.coordinates", "array<array<array<array<double>>>>")
    one = F.array(F.from_json("geometry.coordinates", "array<array<array<double>>>"))
    shape = F.when(F.col("geometry.type") == "MultiPolygon", many).otherwise(one)
    points = F.transform(shape, lambda p: F.transform(p, lambda r: F.transform(r, lambda x: F.struct(x[0].alias("lon"), x[1].alias("lat")))))
    f = f.select(F.col("id").alias("region_id"), "name", "parent", F.col("urls.pbf").alias("url"), points.alias("polygons"))
    flat = lambda k: F.flatten(F.flatten(F.transform("polygons", lambda p: F.transform(p, lambda r: F.transform(r, lambda x: x[k])))))
    return f.withColumns({"lat0": F.array_min(flat("lat")), "lat1": F.array_max(flat("lat")), "lon0": F.array_min(flat("lon")), "lon1": F.array_max(flat("lon"))})


def read_cities(spark: SparkSession, path: str) -> DataFrame:
    """place, country, lat, lon of a table of cities (name, country, lat, lon with a header); rows without coordinates are left out."""
    c = spark.read.option("header", True).csv(path)
    return c.select(F.col("name").alias("place"), "country", F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon")).dropna(subset=["place", "lat", "lon"])


def search(places: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """Places (name) that start with the text, then those that hold it, each by name."""
    name, t = F.lower("name"), text.strip().lower()
    tier = F.when(name.startswith(t), 0).when(name.contains(t), 1)
    return places.withColumn("tier", tier).where("tier is not null").orderBy("tier", F.lower("name"), "name").limit(limit)


def search_airports(airports: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """Airports (iata, name, city, n: their order in the file): the code itself, then names or cities that start with the text by name, then
    those that hold it by n. Texts of one character find nothing."""
    q = text.strip().lower()
    code, name, city = (F.lower(c) for c in ("iata", "name", "city"))
    tier = F.when(code == q, 0).when(name.startswith(q) | city.startswith(q), 1).when(name.contains(q) | city.contains(q), 2)
    found = airports.withColumn("tier", tier).where(F.col("tier").isNotNull() & F.lit(len(q) >= 2))
    return found.orderBy("tier", F.when(F.col("tier") == 1, name), "n").limit(limit)


def search_stops(stops: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """Stops (name, stop_type) but airports whose name holds the text, those that start with it first, each by name."""
    q = text.strip().lower()
    name = F.lower(F.coalesce("name", F.lit("")))
    found = stops.where((F.col("stop_type") != "airport") & name.contains(q) & F.lit(len(q) >= 2))
    return found.withColumn("tier", F.when(name.startswith(q), 0).otherwise(1)).orderBy("tier", name, "stop_id").limit(limit)


#: Fixed value: a place from an open source with a known name nearer than this is that place.
SAME_PLACE_KM = 50.0


def suggestions(found: DataFrame, limit: int = 8) -> DataFrame:
    """Merged hits (source_no, n, label, lat, lon): by source and n, each spot (three decimals) once but for source 0; hits of the last
    source, 3, also go if an earlier one has their name nearby."""
    from pyspark.sql import Window

    from wayloom.functions.geo import haversine_km

    spot = [F.bround("lat", 3).alias("a"), F.bround("lon", 3).alias("b")]
    w = Window.partitionBy("a", "b").orderBy("source_no", "n")
    once = found.select("*", *spot).withColumn("k", F.row_number().over(w)).where("k = 1 or source_no = 0").drop("a", "b", "k")
    key = F.lower(F.trim(F.split_part("label", F.lit(","), F.lit(1))))
    once = once.withColumn("key", key)
    earlier = once.select(F.col("key").alias("key2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("source_no").alias("s2"), F.col("n").alias("n2"))
    before = (F.col("s2") < F.col("source_no")) | ((F.col("s2") == F.col("source_no")) & (F.col("n2") < F.col("n")))
    near = haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= SAME_PLACE_KM
    known = once.where("source_no = 3").join(earlier, (F.col("key") == F.col("key2")) & before & near, "left_semi").select("source_no", "n")
    return once.join(known, ["source_no", "n"], "left_anti").orderBy("source_no", "n").limit(limit).select("source_no", "label", "lat", "lon")


def rail_first(feeds: DataFrame, rail: str = "rail", order: tuple[str, ...] = ("area", "feed_id")) -> DataFrame:
    """Feeds with rail before the others, each in their order."""
    return feeds.orderBy(F.when(F.col(rail), 0).otherwise(1), *order)


def geocode(names: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """(name, lat, lon) of names (name) by the first source (place, lat, lon) that knows the place before the comma; raises for others."""
    from wayloom.functions.parsing import place_key

    out = names.select("name", place_key(F.col("name")).alias("place"), F.lit(None).cast("struct<lat:double,lon:double>").alias("at"))
    for s in sources:
        once = s.groupBy(place_key(F.col("place")).alias("place")).agg(F.first(F.struct(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))).alias("__at"))
        out = out.join(once, "place", "left").withColumn("at", F.coalesce("at", "__at")).drop("__at")
    if unknown := [r["name"] for r in out.where("at is null").select("name").limit(5).collect()]:
        raise ValueError(f"unknown places: {unknown}")
    return out.select("name", "at.lat", "at.lon")


def take_budget(feeds: DataFrame, order: str, size: str, budget: int = 80_000, attempts: int = 4) -> DataFrame:
    """Of the first feeds in order, those with trips, up to (not with) the one whose running sum passes the budget; the first always."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(0)).orderBy(order, "feed_id")
    tried = feeds.withColumn("n", F.row_number().over(w)).where(F.col("n") <= attempts).where(F.col(size) > 0)
    run = tried.withColumns({"total": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)), "k": F.row_number().over(w)})
    over = F.max(F.when((F.col("k") > 1) & (F.col("total") > budget), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return run.withColumn("over", over).where("over = 0").drop("over", "k", "n")


def write_geojson(routes: DataFrame, path: str) -> None:
    """One LineString feature a line from (id, geometry array<struct<lat,lon>>)."""
    line = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("id")).alias("properties"), F.struct(F.lit("LineString").alias("type"), F.transform("geometry", lambda p: F.array(p["lon"], p["lat"])).alias("coordinates")).alias("geometry")))
    routes.select(line.alias("value")).write.mode("overwrite").text(path)


FORMAT = 1


def save_timetable(tables: dict[str, DataFrame], path: str) -> None:
    """Tables of a timetable as Parquet with a format mark."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    next(iter(tables.values())).sparkSession.createDataFrame([(FORMAT, sorted(tables))], "format int, tables array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_timetable(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    meta = spark.read.schema("format int, tables array<string>").json(f"{path}/meta").first()
    if meta is None or meta.format != FORMAT:
        raise ValueError(f"{path} isn't a timetable of format {FORMAT}")
    return {t: spark.read.parquet(f"{path}/{t}") for t in meta.tables}
