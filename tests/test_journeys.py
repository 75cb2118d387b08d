"""Every query against its SQL twin on the smallest tables, and fixtures of the operators."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from wayloom import journeys
from wayloom.functions import geo, parsing, validity
from wayloom.operators import planner, road, timetable, transit
from wayloom.sources import catalogs, gtfs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return round(v, 6) if isinstance(v, float) else v if isinstance(v, (bool, int)) else str(v)


@pytest.mark.parametrize("name", sorted(journeys.oracle_sql()))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = journeys.queries()[name](spark, SF)
    r = c.execute(journeys.oracle_sql()[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(repr(tuple(map(norm, x))) for x in df.select(*cols).collect()) == sorted(repr(tuple(map(norm, x))) for x in r.fetchall())


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_scalars(spark):
    assert 330 < one(spark, geo.haversine_km(F.lit(51.5074), F.lit(-0.1278), F.lit(48.8566), F.lit(2.3522))) < 360
    assert one(spark, geo.turn_angle(F.lit(90.0), F.lit(0.0))) == -90 and one(spark, geo.turn_angle(F.lit(90.0), F.lit(180.0))) == 90
    assert one(spark, parsing.maxspeed(F.lit("60 mph"), F.lit(50.0))) == pytest.approx(96.56064)
    assert one(spark, parsing.maxspeed(F.lit("RO:urban"), F.lit(50.0))) == 50
    assert one(spark, parsing.duration_seconds(F.lit("0:35"))) == 2100 and one(spark, parsing.duration_seconds(F.lit("-1:30"))) is None
    assert one(spark, parsing.gtfs_seconds(F.lit("26:00:00"))) == 93600
    tags = F.create_map(F.lit("motor_vehicle:conditional"), F.lit("no @ (Nov-May)"))
    assert one(spark, validity.open_months(tags, ["motor_vehicle:conditional"])) == [6, 7, 8, 9, 10]
    assert [one(spark, planner.humanize(F.lit(s))) for s in (7766, 0, 30, 3600, 97500)] == ["2h 9m", "0m", "0m", "1h", "1d 3h 5m"]


def test_polygon_with_hole(spark):
    ring = lambda pts: F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in pts])
    shape = F.array(F.array(ring([(0, 0), (10, 0), (10, 10), (0, 10)]), ring([(4, 4), (6, 4), (6, 6), (4, 6)])))
    inside = lambda lat, lon: one(spark, geo.in_polygons(F.lit(lat), F.lit(lon), shape))
    assert inside(2.0, 2.0) and not inside(5.0, 5.0) and not inside(11.0, 2.0)


def network(spark, conns, stops=(), walks=()):
    c = spark.createDataFrame(conns, "run_id string, seq int, dep_stop string, arr_stop string, dep long, arr long")
    s = spark.createDataFrame(list(stops), "stop_id string, min_transfer_s int")
    f = spark.createDataFrame(list(walks), "from_stop string, to_stop string, dur_s long")
    start = spark.createDataFrame([(1, "A", 480)], "request long, stop string, at long")
    out = transit.rounds(start, c, s, transit.close_footpaths(f))
    return {r.stop: r.arrive for r in transit.arrivals(out).collect()}


def test_transit(spark):
    slow_fast = [("slow", 1, "A", "C", 540, 3600), ("fast", 1, "A", "C", 550, 2900)]
    assert network(spark, slow_fast)["C"] == 2900
    change = [("T1", 1, "A", "H", 540, 1000), ("T2", 1, "H", "C", 1200, 2000)]
    assert "C" not in network(spark, change, [("H", 300)]) and network(spark, change, [("H", 200)])["C"] == 2000
    assert "C" not in network(spark, change)  # an unknown stop takes five minutes
    walk = [("T1", 1, "A", "H", 540, 1000), ("T2", 1, "H2", "C", 1130, 2000)]
    assert network(spark, walk, [("H", None)], [("H", "H2", 120)])["C"] == 2000


def test_roads(spark):
    arcs = spark.createDataFrame([(1, 1, 2, 100, 0.0, "road"), (2, 2, 3, 100, 0.0, "road"), (3, 1, 4, 200, 0.0, "road"), (4, 4, 3, 200, 0.0, "road")], "arc long, tail long, head long, seconds long, bearing double, class string")
    src = spark.createDataFrame([(1,)], "source long")
    assert {r.node: r.seconds for r in road.shortest(src, arcs).collect()} == {1: 0, 2: 100, 3: 200, 4: 200}
    nodes = spark.createDataFrame([(i, False) for i in range(1, 5)], "node long, signal boolean")
    barred = spark.createDataFrame([(1, 2)], "in_arc long, out_arc long")
    t = road.turns(arcs, nodes, barred)
    assert {r.node: r.seconds for r in road.shortest_by_arc(src, arcs, t).collect()}[3] == 400


def test_gtfs(spark, tmp_path):
    files = {
        "stops": "stop_id,stop_name,stop_lat,stop_lon\nA,A,46.9,7.4\nB,B,46.7,7.6\nC,C,46.3,8.0\nX,X,bad,1\n",
        "routes": "route_id,route_type\nR1,2\nR2,4\n",
        "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nWD,1,1,1,1,1,0,0,20260101,20261231\n",
        "calendar_dates": "service_id,date,exception_type\nWD,20260705,1\nEX,20260801,1\nNO,20260801,2\n",
        "trips": "route_id,service_id,trip_id\nR1,WD,TR1\nR2,EX,FR1\nR1,GONE,T9\n",
        "stop_times": "trip_id,stop_sequence,stop_id,arrival_time,departure_time\nTR1,1,A,09:00:00,09:00:00\nTR1,2,B,09:30:00,09:32:00\nTR1,3,C,,10:00:00\nFR1,1,A,11:00,11:00\nFR1,2,B,11:45,11:45\nT9,1,A,1:00:00,1:00:00\nT9,2,B,2:00:00,2:00:00\n",
        "transfers": "from_stop_id,to_stop_id,transfer_type,min_transfer_time\nA,A,2,600\nB,B,3,\nA,B,2,180\n",
    }
    for n, text in files.items():
        (tmp_path / f"{n}.txt").write_text(text)
    t = gtfs.read_gtfs(spark, str(tmp_path))
    assert {r.stop_id: r.min_transfer_s for r in t.stops.collect()} == {"A": 600, "B": None, "C": 300}
    assert {r.trip_id: r.mode for r in t.trips.collect()} == {"TR1": "train", "FR1": "ferry"}
    assert [(r.trip_id, r.dep_s) for r in t.calls.orderBy("trip_id", "seq").collect()] == [("FR1", 39600), ("FR1", 42300), ("TR1", 32400), ("TR1", 34320), ("TR1", 36000)]
    assert [tuple(r) for r in t.footpaths.collect()] == [("A", "B", 180.0)]
    trips = t.trips.withColumns({"open_months": F.array().cast("array<int>"), "required": F.array().cast("array<string>"), "forbidden": F.array().cast("array<string>")})
    days = timetable.active_days(trips, "2026-07-03", "2026-07-05", []).collect()
    assert sorted(str(r.day) for r in days) == ["2026-07-03", "2026-07-05"]


def test_catalogs(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"features":[{"properties":{"id":"a","name":"A","parent":null,"urls":{"pbf":"u"}},"geometry":{"type":"Polygon","coordinates":[[[0,40],[20,40],[20,56],[0,56]]]}},{"properties":{"id":"b","name":"B","urls":{}},"geometry":null}]}')
    r = catalogs.read_regions(spark, str(tmp_path / "r.json")).collect()
    assert [(x.region_id, x.lat0, x.lat1, x.lon0, x.lon1) for x in r] == [("a", 40, 56, 0, 20)]
    catalogs.save_timetable({"stops": spark.range(3)}, str(tmp_path / "t"))
    assert catalogs.load_timetable(spark, str(tmp_path / "t"))["stops"].count() == 3


def test_restrictions(spark):
    from wayloom.operators import restrictions

    arcs = spark.createDataFrame([(10, 1, 1, 5, 0.0), (20, 2, 5, 2, 270.0), (21, 3, 5, 3, 0.0), (22, 4, 5, 4, 90.0)], "arc long, way long, tail long, head long, bearing double")
    rel = lambda value: spark.createDataFrame([(1, [1], 5, [2], value)], "rel long, from_ways array<long>, via long, to_ways array<long>, value string")
    turns = lambda value: sorted(tuple(r) for r in restrictions.forbidden_turns(rel(value), arcs).collect())
    assert turns("no_left_turn") == [(10, 20)]
    assert turns("only_left_turn") == [(10, 21), (10, 22)]


def test_ferry_way(spark):
    from wayloom.operators import ways

    w = spark.createDataFrame([(1, [1, 2, 3], {"route": "ferry", "motorcar": "yes", "duration": "1:00"}), (2, [1, 2], {"route": "ferry"})], "way long, refs array<long>, tags map<string,string>")
    n = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.1), (3, 0.0, 0.4)], "node long, lat double, lon double")
    assert sorted((r.tail, r.head, r.base_seconds) for r in ways.arcs_of(w, n).collect()) == [(1, 2, 900), (2, 1, 900), (2, 3, 2700), (3, 2, 2700)]


def test_stream(spark, tmp_path):
    from wayloom.streaming import requests

    spark.range(5).withColumn("origin", F.col("id") % 2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, origin long").parquet(str(tmp_path / "in"))
    requests.answer(stream, lambda b: b.groupBy("origin").count(), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("count")).first()[0] == 5


def test_long_chain_of_walks(spark):
    hops = 14
    walks = spark.createDataFrame([(f"S{i}", f"S{i + 1}", 60) for i in range(hops)], "from_stop string, to_stop string, dur_s long")
    got = {(r.from_stop, r.to_stop): r.dur_s for r in transit.close_footpaths(walks).collect()}
    assert got == {(f"S{i}", f"S{j}"): 60 * (j - i) for i in range(hops) for j in range(i + 1, hops + 1)}
