"""A deterministic travel domain over the star-schema tables, in SQL that Spark and DuckDB read alike.

Suppliers are stops, orders trips, line items calls, customers road nodes and doors, orders road arcs between
neighbouring nodes, events trip requests (users leave one of a hundred stops at one of four times a day), nations square regions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STOPS = """SELECT s_suppkey AS stop_id, s_name AS name,
  44 + (s_suppkey * 37 % 1000) / CAST(125 AS DOUBLE) AS lat, 2 + (s_suppkey * 61 % 1000) / CAST(80 AS DOUBLE) AS lon,
  CASE s_suppkey % 10 WHEN 0 THEN 'airport' WHEN 1 THEN 'ferry_terminal' ELSE 'rail_station' END AS stop_type,
  CASE WHEN s_suppkey % 7 = 6 THEN NULL ELSE 60 * (s_suppkey % 7) END AS min_transfer_s,
  CASE s_nationkey % 4 WHEN 0 THEN 'Europe/Amsterdam' WHEN 1 THEN 'Europe/London' WHEN 2 THEN 'America/New_York' END AS tz
  FROM supplier"""
TRIPS = """SELECT o_orderkey AS trip_id,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'flight' WHEN '2' THEN 'ferry' ELSE 'train' END AS mode,
  CAST(o_orderdate AS DATE) AS start_day, o_custkey % 7 AS off_day, o_orderstatus AS season FROM orders"""
CALLS = """SELECT trip_id, seq, stop_id, tm - 60 AS arr_s, tm AS dep_s FROM (
  SELECT l_orderkey AS trip_id, l_suppkey AS stop_id, seq,
    CAST(21600 + (l_orderkey % 12) * 3600 + sum(300 + CAST(l_quantity AS BIGINT) * 60) OVER (PARTITION BY l_orderkey ORDER BY seq) AS BIGINT) AS tm
  FROM (SELECT l_orderkey, l_suppkey, l_quantity, CAST(row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) AS BIGINT) AS seq FROM lineitem) x) y"""
DOORS = """SELECT c_custkey AS door, 44 + (c_custkey * 53 % 1000) / CAST(125 AS DOUBLE) AS lat, 2 + (c_custkey * 29 % 1000) / CAST(80 AS DOUBLE) AS lon FROM customer"""
ARCS = """SELECT arc, tail, head, base_seconds, class, bearing, season FROM (
  SELECT o_orderkey AS arc, o_custkey AS tail, greatest(1, o_custkey + o_orderkey % 21 - 10) AS head,
    30 + CAST(floor(o_totalprice) AS BIGINT) % 600 AS base_seconds,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'motorway' WHEN '2' THEN 'primary' WHEN '3' THEN 'residential' WHEN '4' THEN 'ferry' ELSE 'track' END AS class,
    CAST(o_orderkey * 37 % 360 AS DOUBLE) AS bearing, o_orderstatus AS season FROM orders) a WHERE head <> tail"""
LEGS = """SELECT l_orderkey % 50 AS request, l_orderkey AS cand, seq AS leg_no,
  CASE (l_partkey + l_suppkey) % 6 WHEN 0 THEN 'walk' WHEN 1 THEN 'car' WHEN 2 THEN 'flight' WHEN 3 THEN 'ferry' ELSE 'train' END AS mode,
  CAST(l_quantity AS DOUBLE) * 4 AS km, CAST(l_quantity AS BIGINT) * CASE WHEN l_partkey % 7 = 0 THEN 800 ELSE 240 END AS travel_s, CAST(l_partkey % 30 AS BIGINT) * 60 AS overhead_s,
  1 + l_linenumber % 3 AS cost_level
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) AS BIGINT) AS seq FROM lineitem) x"""
REQUESTS = """SELECT event_id AS request, 1 + user_id % 100 AS origin, 1 + (user_id * 13 + 7) % 100 AS dest,
  CAST(18000 + floor(hour(ts) / 6) * 14400 AS BIGINT) AS depart, event_type FROM events"""
VIEWS = {"stops": STOPS, "trips": TRIPS, "calls": CALLS, "doors": DOORS, "arcs": ARCS, "legs": LEGS, "requests": REQUESTS}


def with_views(*names: str) -> str:
    """The WITH clause of an oracle's SQL."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    for table in ("supplier", "orders", "lineitem", "customer", "events"):
        if f"FROM {table}" in sql:
            sql = sql.replace(f"FROM {table}", "FROM {t}")
            return spark.sql(sql, t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    raise ValueError(name)


def calendars(trips: DataFrame) -> DataFrame:
    """trips with the calendar columns: 28 days, all weekdays but one, an added and a removed day, months by season."""
    day = F.col("start_day")
    return trips.withColumns({
        "end_day": F.date_add(day, 27), "weekdays": F.array_except(F.sequence(F.lit(0), F.lit(6)), F.array(F.col("off_day").cast("int"))),
        "added": F.array(F.date_add(day, 30)), "removed": F.array(F.date_add(day, 3)),
        "open_months": F.when(F.col("season") == "O", F.sequence(F.lit(4), F.lit(10))).otherwise(F.array().cast("array<int>")),
        "required": F.array().cast("array<string>"), "forbidden": F.when(F.col("season") == "P", F.array(F.lit("strike"))).otherwise(F.array().cast("array<string>")),
    })


#: SQL twin of calendars and of is_active for a day column d and no conditions.
ACTIVE = """(CASE WHEN d = start_day + INTERVAL 3 DAY THEN FALSE WHEN d = start_day + INTERVAL 30 DAY THEN TRUE
  ELSE d BETWEEN start_day AND start_day + INTERVAL 27 DAY AND isodow(d) - 1 <> off_day END)
  AND (season <> 'O' OR month(d) BETWEEN 4 AND 10)"""
HAV = "CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)))) END"


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return HAV.format(a=lat1, b=lat2, c=lon1, d=lon2)
