"""Queries against their SQL twins over copies of the small tables with shifted keys, where places, degrees and arrivals repeat."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_journeys import SF, norm
from tests.test_planner import frames
from wayloom import journeys
from wayloom.operators import connectors, road, search, spatial, timetable, transit
from wayloom.operators.fixpoint import written
from wayloom.sources import flights

KEYS = {
    "customer": {"c_custkey": 1000}, "supplier": {"s_suppkey": 1000}, "part": {"p_partkey": 1000}, "orders": {"o_orderkey": 10_000, "o_custkey": 1000},
    "lineitem": {"l_orderkey": 10_000, "l_partkey": 1000, "l_suppkey": 1000}, "events": {"event_id": 10_000, "user_id": 1000},
}


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """Three copies of the small tables; keys a thousand apart lie at one place."""
    path = tmp_path_factory.mktemp("copies")
    for t in ("region", "nation", *KEYS):
        shifted = ", ".join(f"CAST({k} + i * {n} AS BIGINT) AS {k}" for k, n in KEYS.get(t, {}).items())
        every = f"SELECT * EXCLUDE (i) REPLACE ({shifted}) FROM '{SF}/{t}.parquet', range(3) r(i)" if shifted else f"SELECT * FROM '{SF}/{t}.parquet'"
        duckdb.execute(f"COPY ({every}) TO '{path}/{t}.parquet' (FORMAT parquet)")
    return str(path)


def same(spark, name, path):
    c = duckdb.connect()
    for t in ("region", "nation", *KEYS):
        c.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    df = journeys.queries()[name](spark, path)
    r = c.execute(journeys.oracle_sql()[name])
    cols = [d[0] for d in r.description]
    rows = sorted(repr(tuple(map(norm, x))) for x in df.select(*cols).collect())
    assert rows == sorted(repr(tuple(map(norm, x))) for x in r.fetchall())
    return rows


@pytest.mark.parametrize("name", ["plain_drives", "timed_drives", "turn_drives"])
def test_drives_begin_at_the_node_that_a_place_snaps_to(spark, copies, name):
    assert len(same(spark, name, copies)) == 3 * spark.read.parquet(f"{SF}/supplier.parquet").count()


def test_half_cents_of_a_fare_round_up(spark, tmp_path):
    """Ferries of 4.5 and 20.5 km cost as much as two of 12.5 km: 8.075 is half a cent, however its product with 100 comes out."""
    calls = "SELECT CAST(o AS BIGINT) AS l_orderkey, CAST(3 AS BIGINT) AS l_partkey, CAST(0 AS BIGINT) AS l_suppkey, l AS l_linenumber, CAST(q AS DOUBLE) AS l_quantity, CAST(1 AS DOUBLE) AS l_extendedprice, CAST(0 AS DOUBLE) AS l_discount, CAST(0 AS DOUBLE) AS l_tax, TIMESTAMP '1998-01-01' AS l_shipdate FROM (VALUES (1, 1, 1), (1, 2, 5), (51, 1, 3), (51, 2, 3)) v(o, l, q)"
    c = duckdb.connect()
    c.execute(f"COPY ({calls}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet'")
    got = journeys.queries()["distinct_signatures"](spark, str(tmp_path)).select("request", "cand").collect()
    want = c.execute(f"SELECT request, cand FROM ({journeys.oracle_sql()['distinct_signatures']}) x").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) == [(1, 1), (1, 10_000_001)]


@pytest.mark.parametrize("name", ["nearest_stop", "door_zones", "door_snaps", "access_legs", "connector_legs", "hub_topk"])
def test_places_that_share_a_spot(spark, copies, name):
    assert same(spark, name, copies)


@pytest.fixture
def measured(spark, monkeypatch):
    """How often distances are taken."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def km(lat1, lon1, lat2, lon2):
        calls.add(1)
        return (abs(lat1 - lat2) + abs(lon1 - lon2)) * 100

    monkeypatch.setattr(spatial, "haversine_km", km)
    return calls


def test_distances_are_taken_once_for_a_pair_of_spots(spark, measured):
    points = spark.range(300).select(F.col("id").alias("door"), F.lit(50.0).alias("lat"), F.lit(5.0).alias("lon"))
    places = spark.range(300).select((F.col("id") + 7).alias("stop"), F.lit(50.01).alias("p_lat"), F.lit(5.0).alias("p_lon"))
    assert spatial.within(points, places, 10).count() == 90_000 and measured.value < 10
    got = spatial.nearest(points, "door", places, "stop").collect()
    assert len(got) == 300 and {r.stop for r in got} == {7} and measured.value < 100
    nodes = places.toDF("node", "lat", "lon")
    assert road.snap(points, "door", nodes).count() == 300 and road.snap(points, "door", nodes, 0.5).count() == 0 and measured.value < 500


def test_busiest_airports_are_met_first(spark, measured):
    """Where the busiest are near, those after them aren't met; a spot far from them goes down the list to the one beside it."""
    points = spark.range(41).select(F.col("id").alias("point"), F.when(F.col("id") == 40, 10.0).otherwise(50 + F.col("id") / 100).alias("lat"), F.lit(5.0).alias("lon"))
    airports = spark.range(1500).select(F.col("id").alias("iata"), F.when(F.col("id") == 3, 10.0).otherwise(50 + F.col("id") / 10_000).alias("lat"), F.lit(5.0).alias("lon"))
    degree = airports.select("iata", (F.floor(F.col("iata") / 2) + 10).alias("degree"))
    got = sorted(map(tuple, flights.hubs(points, airports, degree, 5, 400, 3).collect()))
    assert got == sorted([(p, i, i // 2 + 10, r + 1) for p in range(40) for r, i in enumerate((1499, 1498, 1497))] + [(40, 3, 11, 1)])
    assert measured.value < 41 * 300


def test_asks_of_many_hours_are_not_broadcast(spark):
    asks = spark.range(50).select(F.col("id").alias("ask"), (F.col("id") % 5).alias("stop"), (F.col("id") * 600).alias("at"))
    conns = spark.range(500).select((F.col("id") % 5).alias("dep_stop"), (F.col("id") * 100).alias("dep"), (F.col("id") * 100 + 60).alias("arr"), F.col("id").cast("string").alias("run_id"))
    got = timetable.next_departures(asks, conns)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    first = lambda k: min(x for x in range(500) if x % 5 == k % 5 and x * 100 >= k * 600)
    assert sorted((r.ask, r.dep) for r in got.collect()) == [(k, first(k) * 100) for k in range(50)]


def test_requests_that_ask_the_same_are_searched_once(spark, monkeypatch):
    """A hundred requests of two kinds: two are searched, all are answered; a connector that tells requests apart searches each."""
    c, s, none = frames(spark, [("r1", 1, "A", "H", 4000, 5000, "train"), ("r2", 1, "H", "C", 5600, 7000, "train")])
    r = spark.range(100).select(F.col("id").alias("request"), F.lit(46.0005).alias("lat"), F.lit(7.0).alias("lon"), F.when(F.col("id") % 2 == 0, 46.6005).otherwise(46.3005).alias("lat2"), F.lit(7.0).alias("lon2"), F.lit(3000).cast("long").alias("depart"))
    seen, legs = [], search.candidate_legs
    monkeypatch.setattr(search, "candidate_legs", lambda asked, *more: seen.append(asked.count()) or legs(asked, *more))
    got = {}
    for x in search.plan(r, c, s, none, "greenest", 2).collect():
        got.setdefault(x.request, []).append((x["rank"], x.cand, x.total_s, x.modes))
    assert seen == [2] and set(got) == set(range(100))
    assert all(sorted(got[k]) == sorted(got[k % 2]) for k in got) and sorted(got[0]) != sorted(got[1])
    apart = connectors.by_region(r.limit(0).select("request", F.lit("x").alias("region_id")), {}, connectors.geometric())
    assert search.plan(r.limit(3), c, s, none, "greenest", 1, connectors=[apart]).count() == 3 and seen == [2, 3]


def test_tables_of_many_rows_are_merged(spark):
    """A written table of few bytes and many rows."""
    small, large = (written(spark.range(n).select((F.col("id") * 0).alias("run_id")), "t") for n in (100, 200_000))
    plan = lambda t: spark.range(9).toDF("run_id").join(transit.merged(t), "run_id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan(large) and "SortMergeJoin" not in plan(small)
