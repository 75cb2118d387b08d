"""Zones, look-back, contracts of requests, transfers, overlays and drives: each against a plain version."""

import heapq
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wayloom.operators import connectors, contracts, overlay, planner, restrictions, road, search, timetable
from wayloom.sources import gtfs

TRIP = "trip_id string, mode string, start_day date, end_day date, weekdays array<int>, added array<date>, removed array<date>, open_months array<int>, required array<string>, forbidden array<string>"
CALL = "trip_id string, seq int, stop_id string, arr_s long, dep_s long"


def trip(name, mode="train", required=(), forbidden=(), start="2026-01-01", end="2026-12-31"):
    day = lambda x: datetime.fromisoformat(x).date()
    return (name, mode, day(start), day(end), list(range(7)), [], [], [], list(required), list(forbidden))


def test_zones_and_offsets(spark):
    """A flight west arrives in UTC order; a trip from a stop without a zone takes the feed's; a call at 60 h counts two days later."""
    stops = spark.createDataFrame([("AMS", "Europe/Amsterdam"), ("JFK", "America/New_York"), ("ZRH", "Europe/Amsterdam"), ("X", None)], "stop_id string, tz string")
    trips = spark.createDataFrame([trip("f", "flight"), trip("b"), trip("n")], TRIP)
    calls = spark.createDataFrame([("f", 1, "AMS", 36000, 36000), ("f", 2, "JFK", 36000 + 8 * 3600, 36000 + 8 * 3600), ("b", 1, "JFK", 0, 36000), ("b", 2, "X", 39600, 39600), ("n", 1, "X", 3600, 3600), ("n", 2, "ZRH", 216000, 216000), ("n", 3, "AMS", 219600, 219600)], CALL)
    got = {(r.run_id, r.seq): (str(r.dep), str(r.arr)) for r in timetable.connections(trips, calls, "2026-07-03 00:00:00", "2026-07-03 23:00:00", [], stops).collect()}
    assert got["f@2026-07-03", 1] == ("2026-07-03 08:00:00", "2026-07-03 16:00:00")
    assert got["b@2026-07-03", 1] == ("2026-07-03 14:00:00", "2026-07-03 15:00:00")
    assert got["n@2026-07-01", 2] == ("2026-07-03 10:00:00", "2026-07-03 11:00:00")
    assert got["n@2026-07-04", 1] == ("2026-07-03 23:00:00", "2026-07-06 10:00:00")  # a day ahead: local midnight comes before UTC's
    naive = {(r.run_id, r.seq): str(r.dep) for r in timetable.connections(trips, calls, "2026-07-03 00:00:00", "2026-07-03 23:00:00", [], stops.withColumn("tz", F.lit(None).cast("string"))).collect()}
    assert naive["f@2026-07-03", 1] == "2026-07-03 10:00:00" and naive["n@2026-07-01", 2] == "2026-07-03 12:00:00" and ("n@2026-07-04", 1) not in naive


def test_summer_time(spark):
    stops = spark.createDataFrame([("A", "Europe/Amsterdam"), ("B", None)], "stop_id string, tz string")
    trips, calls = spark.createDataFrame([trip("t")], TRIP), spark.createDataFrame([("t", 1, "A", 3600, 3600), ("t", 2, "B", 4 * 3600, 4 * 3600)], CALL)
    got = [(str(r.dep), str(r.arr)) for r in timetable.connections(trips, calls, "2026-03-28 00:00:00", "2026-03-29 12:00:00", [], stops).orderBy("dep").collect()]
    assert got == [("2026-03-28 00:00:00", "2026-03-28 03:00:00"), ("2026-03-29 00:00:00", "2026-03-29 02:00:00")]


def test_departures_in_the_zone_of_the_door(spark):
    stops = spark.createDataFrame([("A", 52.0, 5.0, "Europe/Amsterdam"), ("J", 40.6, -73.8, "America/New_York")], "stop_id string, lat double, lon double, tz string")
    r = spark.createDataFrame([(1, 52.1, 5.1, datetime(2026, 7, 1, 8)), (2, 40.7, -74.0, datetime(2026, 7, 1, 8))], "request long, lat double, lon double, depart timestamp_ntz")
    assert {x.request: str(x.depart) for x in timetable.instants(r, "request", stops).collect()} == {1: "2026-07-01 06:00:00", 2: "2026-07-01 12:00:00"}


def world(seed=4):
    rng = random.Random(seed)
    stops = [(f"S{i}", 46 + rng.random() * 0.5, 7 + rng.random() * 0.5, rng.choice([None, 0, 120, 300]), "Europe/Zurich") for i in range(10)]
    trips, calls = [], []
    for k in range(40):
        trips.append(trip(f"t{k}", rng.choice(["train", "ferry", "flight"]), ["snow"] if k % 9 == 0 else [], ["strike"] if k % 4 == 0 else []))
        at = rng.randint(20000, 40000)
        for seq, s in enumerate(rng.sample(range(10), 4), 1):
            calls.append((f"t{k}", seq, f"S{s}", at, at + 60))
            at += rng.randint(700, 1500)
    return rng, stops, trips, calls


def test_contracts_against_plans_one_by_one(spark):
    rng, stops, trips, calls = world()
    s = spark.createDataFrame(stops, "stop_id string, lat double, lon double, min_transfer_s int, tz string")
    t, c = spark.createDataFrame(trips, TRIP), spark.createDataFrame(calls, CALL)
    w = spark.createDataFrame([("S1", "S2", 240)], "from_stop string, to_stop string, dur_s long")
    rows = []
    for i, objective in enumerate([*planner.ORDER][2:]):
        ends = [46 + rng.random() * 0.5, 7 + rng.random() * 0.5, 46 + rng.random() * 0.5, 7 + rng.random() * 0.5]
        rows.append((i, *ends, datetime(2026, 7, 1 + i % 2, 7, 20 + i), [["strike"], [], ["snow"]][i % 3], objective, 1 + i % 3, ["flight"] if i % 2 else None, ["car", "transit", "both"][i % 3]))
    asked = spark.createDataFrame(rows, "request long, lat double, lon double, lat2 double, lon2 double, depart timestamp_ntz, conditions array<string>, objective string, top int, exclude array<string>, access string")
    car, foot = connectors.geometric(km=20.0), connectors.geometric(km=8.0, walk_km=8.0)
    got = {}
    for x in contracts.plan_each(asked, t, c, s, w, 40_000, car, foot).collect():
        got.setdefault(x.request, []).append((x["rank"], x.total_s, x.cost, x.modes))
    for i, lat, lon, lat2, lon2, at, conditions, objective, top, exclude, access in rows:
        utc = at.replace(hour=at.hour - 2)
        zero = int((utc - datetime(1970, 1, 1)).total_seconds())
        conns = timetable.connections(t, c, str(utc), str(datetime.fromtimestamp(zero + 40_000)), conditions, s)
        sec = lambda col: F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(col))
        conns = conns.select("run_id", "mode", "seq", "dep_stop", "arr_stop", sec("dep").alias("dep"), sec("arr").alias("arr"))
        one = spark.createDataFrame([(i, lat, lon, lat2, lon2, zero)], "request long, lat double, lon double, lat2 double, lon2 double, depart long")
        plans = search.plan(one, conns, s, w, objective, top, tuple(exclude or ()), {"car": [car], "transit": [foot], "both": [car, foot]}[access])
        assert sorted(got.get(i, [])) == sorted((x["rank"], x.total_s, x.cost, x.modes) for x in plans.collect()), i
    assert sum(map(len, got.values())) > 4


def test_contracts_are_checked(spark):
    row = (1, 46.0, 7.0, 46.1, 7.1, datetime(2026, 7, 1, 8))
    make = lambda rows, extra="", more=(): spark.createDataFrame([(*r, *more) for r in rows], "request long, lat double, lon double, lat2 double, lon2 double, depart timestamp_ntz" + extra)
    assert contracts.check(make([row])).first().asDict() | {"depart": None} == dict(request=1, lat=46.0, lon=7.0, lat2=46.1, lon2=7.1, depart=None, conditions=[], objective="fastest", top=3, exclude=[], access="car")
    for df, what in [(make([row, row]), "twice"), (make([(1, 99.0, *row[2:])]), "places"), (make([row], ", objective string", ("best",)), "objective"), (make([row], ", top int", (0,)), "plan"), (make([row], ", access string", ("bike",)), "access")]:
        with pytest.raises(ValueError, match=what):
            contracts.check(df)


def test_transfer_rules(spark, tmp_path):
    """Types, blanks and times of zero; trips whose ids hold '#'; quoted line breaks; the stop type that hub links need."""
    files = {
        "stops": 'stop_id,stop_name,stop_lat,stop_lon,parent_station\nA,"Two\nlines",46.90,7.40,\nB,B,46.91,7.41,\nC,C,46.90,7.40,\nD,D,46.9,7.5,A\n',
        "routes": "route_id,route_type\nR1,2\n",
        "trips": "route_id,service_id,trip_id\nR1,W,T#1\nR1,W,F#2\n",
        "stop_times": "trip_id,stop_sequence,stop_id,arrival_time,departure_time\nT#1,1,A,9:00:00,9:00:00\nT#1,2,B,9:30:00,9:30:00\nF#2,1,A,9:00:00,9:00:00\nF#2,2,B,9:30:00,9:30:00\n",
        "frequencies": "trip_id,start_time,end_time,headway_secs\nF#2,10:00:00,11:00:00,1800\n",
        "transfers": "from_stop_id,to_stop_id,transfer_type,min_transfer_time\nA,A,1,600\nB,B,2,30\nB,B,0,\nC,C,2,900\nC,C,3,\nD,D,0,0\nA,B,,\nB,A,2,30\nA,C,2,0\nC,B,3,10\nA,Q,2,10\n",
    }
    for n, text in files.items():
        (tmp_path / f"{n}.txt").write_text(text)
    t = gtfs.read_gtfs(spark, str(tmp_path))
    assert {r.stop_id: r.min_transfer_s for r in t.stops.collect()} == {"A": 0, "B": 30, "C": None, "D": 0}
    walks = {(r.from_stop, r.to_stop): r.dur_s for r in t.footpaths.collect()}
    assert 1000 < walks["A", "B"] < 1300 and walks["B", "A"] == 30 and walks["A", "C"] == 60 and set(walks) == {("A", "B"), ("B", "A"), ("A", "C"), ("A", "D"), ("D", "A")}
    assert sorted(r.trip_id for r in t.trips.collect()) == ["F#2#36000", "F#2#37800", "T#1"] == sorted({r.trip_id for r in t.calls.collect()})
    assert {r.name for r in t.stops.collect()} == {"Two\nlines", "B", "C", "D"} and {r.stop_type for r in t.stops.collect()} == {"rail_station"}


def dijkstra(arcs, source):
    out, heap = {}, [(0, source)]
    while heap:
        d, x = heapq.heappop(heap)
        if x in out:
            continue
        out[x] = d
        for w, y in arcs.get(x, ()):
            heapq.heappush(heap, (d + w, y))
    return out


def graph(seed=1, n=120):
    rng = random.Random(seed)
    arcs = [(k, a, max(0, min(n - 1, a + rng.randint(-6, 6))), rng.choice([None, *range(5, 60)])) for k, a in enumerate(x for x in range(n) for _ in range(4))]
    return [a for a in arcs if a[1] != a[2]], n


def adjacent(arcs):
    out = {}
    for _, a, b, w in arcs:
        if w is not None:
            out.setdefault(a, []).append((w, b))
    return out


def test_overlay(spark):
    arcs, n = graph()
    df = spark.createDataFrame(arcs, "arc long, tail long, head long, weight long")
    nodes = spark.createDataFrame([(k,) for k in range(n)], "node long")
    cells = overlay.cells_by_order(nodes, most=25)
    assert {c: k for c, k in cells.groupBy("cell").count().collect()} == {0: 25, 1: 25, 2: 25, 3: 25, 4: 20}
    o = overlay.build(df, cells)
    points = nodes.where("node % 10 = 3")

    def same(o, arcs):
        want = {(a, b): w for a in range(3, n, 10) for b, w in dijkstra(adjacent(arcs), a).items() if b % 10 == 3}
        rows = overlay.matrix(o, points).collect()
        assert len(rows) == 144 and {(r.source, r.target): r.weight for r in rows if r.weight is not None} == want

    same(o, arcs)
    # changes within two cells and one on a crossing arc: those two cells alone are searched again
    inner = [a for a in arcs if a[1] // 25 == a[2] // 25 and a[1] // 25 in (1, 4)][:40:7]
    cross = next(a for a in arcs if a[1] // 25 != a[2] // 25 and a[3] is not None)
    changed = {a[0]: (None if k % 2 else 1) for k, a in enumerate([*inner, cross])}
    new, searched = overlay.customise(o, spark.createDataFrame([*changed.items(), (arcs[0][0], arcs[0][3])], "arc long, weight long"))
    assert {r.cell for r in searched.collect()} == {a[1] // 25 for a in inner if changed[a[0]] != a[3]}
    same(new, [(k, a, b, changed.get(k, w)) for k, a, b, w in arcs])
    fresh = overlay.build(df.join(spark.createDataFrame([*changed.items()], "arc long, w long").withColumn("named", F.lit(True)), "arc", "left").select("arc", "tail", "head", F.when(F.col("named"), F.col("w")).otherwise(F.col("weight")).alias("weight")), cells)
    for part in ("down", "hops"):
        assert sorted(map(tuple, getattr(new, part).collect())) == sorted(map(tuple, getattr(fresh, part).collect()))


def roads(seed=2, n=40):
    rng = random.Random(seed)
    nodes = [(k, 46 + k % 7 * 0.01, 7 + k // 7 * 0.01, k % 4 == 0) for k in range(n)]
    arcs = [(k, a, b, float(rng.randrange(0, 360, 15)), rng.choice(["primary", "residential"]), rng.randint(20, 90), 1.0 + k % 5) for k, (a, b) in enumerate((a, rng.randrange(n)) for a in range(n) for _ in range(3)) if a != b]
    return nodes, arcs


def test_turn_aware_drives(spark):
    """Search on arcs by brute force; the geometry is a way by legal turns that takes as long; by overlay the same."""
    nodes, arcs = roads()
    nd = spark.createDataFrame(nodes, "node long, lat double, lon double, signal boolean")
    ad = spark.createDataFrame(arcs, "arc long, tail long, head long, bearing double, class string, seconds long, km double")
    barred = spark.createDataFrame([(a[0], b[0]) for a in arcs for b in arcs if a[2] == b[1] and (a[0] + b[0]) % 5 == 0], "in_arc long, out_arc long")
    turns = road.turns(ad, nd, barred)
    cost = {(r.in_arc, r.out_arc): r.cost for r in turns.collect()}
    onto = {}
    for (a, b), c in cost.items():
        onto.setdefault(a, []).append((b, c))
    own = {a[0]: a for a in arcs}

    def best(s):
        out, heap = {}, [(own[a][5], own[a][6], a) for a in own if own[a][1] == s]
        heapq.heapify(heap)
        while heap:
            d, k, a = heapq.heappop(heap)
            if a in out:
                continue
            out[a] = (d, k)
            for b, c in onto.get(a, ()):
                heapq.heappush(heap, (d + c + own[b][5], k + own[b][6], b))
        return out

    trips = [(i, nodes[i][1], nodes[i][2], nodes[(i * 7 + 3) % 40][1], nodes[(i * 7 + 3) % 40][2]) for i in range(0, 40, 3)]
    td = spark.createDataFrame(trips, "request long, lat double, lon double, lat2 double, lon2 double")
    got = {r.request: r for r in road.drive_routes(td, nd, ad, turn_table=turns).collect()}
    plain = {r.request: r for r in road.drive(td, nd, ad, turn_table=turns).collect()}
    place = {(n[1], n[2]): n[0] for n in nodes}
    for i, *_ in trips:
        end, at = (i * 7 + 3) % 40, best(i)
        ways = [at[a] for a in at if own[a][2] == end]
        want = (0, 0) if i == end else min(ways, default=(None, None))
        assert (got[i].seconds, got[i].km) == want == (plain[i].seconds, plain[i].km)
        if want[0]:
            line = [place[p.lat, p.lon] for p in got[i].geometry]
            assert line[0] == i and line[-1] == end
            legal = {i: {None: 0}}  # the least time along the line's nodes
            times = {a: own[a][5] for a in own if (own[a][1], own[a][2]) == (line[0], line[1])}
            for x, y in zip(line[1:], line[2:], strict=False):
                times = {b: min(times[a] + cost[a, b] + own[b][5] for a in times if (a, b) in cost) for b in own if (own[b][1], own[b][2]) == (x, y) and any((a, b) in cost for a in times)}
            assert min(times.values()) == want[0] and legal
    weights = ad.select("arc", "tail", "head", overlay.packed(F.col("seconds"), F.col("km")).alias("weight"))
    o = overlay.build(overlay.with_turns(weights, turns), overlay.cells_by_order(weights.select(F.col("arc").alias("node"), "tail"), "tail", 30))
    first = [a for a in own if own[a][1] == 0]
    d = overlay.distances(o, spark.createDataFrame([(a,) for a in first], "source long"))
    from_0 = {}
    for r in d.select("source", "node", overlay.seconds_of(F.col("weight")).alias("s"), overlay.km_of(F.col("weight")).alias("km")).collect():
        whole = (r.s + own[r.source][5], r.km + own[r.source][6])
        from_0[r.node] = min(whole, from_0.get(r.node, whole))
    assert from_0 == best(0)
    with pytest.raises(ValueError, match="turn_table"):
        connectors.by_mode("car", roads=connectors.network(nd, ad), turn_aware=True)
    asked, stops = td.limit(2), nd.where("node % 9 = 1").select(F.concat(F.lit("S"), "node").alias("stop_id"), "lat", "lon")
    access, _, direct = connectors.by_mode("car", roads=connectors.network(nd, ad, walk_km=0.1, turn_table=turns), turn_aware=True)[0](asked, stops)
    assert {r.request: r.seconds for r in direct.collect()} == {i: plain[i].seconds for i in (r.request for r in asked.collect()) if plain[i].seconds is not None}
    for r in access.collect():
        ways = [best(r.request)[a][0] for a in best(r.request) if own[a][2] == int(r.stop[1:])]
        assert r.mode == "walk" or r.seconds == min(ways)


def test_drives_by_departure(spark):
    """Each trip by the metric of its own month, day and hour, as arc_weights gives it; no departure is an average hour."""
    nodes, arcs = roads(5)
    nd = spark.createDataFrame(nodes, "node long, lat double, lon double, signal boolean")
    ad = spark.createDataFrame(arcs, "arc long, tail long, head long, bearing double, class string, base_seconds long, km double").withColumn("open_months", F.when(F.col("arc") % 6 == 0, F.array(F.lit(7))).otherwise(F.array().cast("array<int>")))
    whens = [datetime(2026, 7, 1, 8), datetime(2026, 7, 1, 23), datetime(2026, 1, 1, 8), datetime(2026, 1, 10, 12), None]
    trips = [(i, nodes[i][1], nodes[i][2], nodes[i + 9][1], nodes[i + 9][2], whens[i % 5]) for i in range(20)]
    td = spark.createDataFrame(trips, "request long, lat double, lon double, lat2 double, lon2 double, depart timestamp_ntz")
    days = spark.sql("SELECT DATE '2026-01-01' AS day, 'holiday' AS kind")
    got = {r.request: r.seconds for r in road.timed_drive(td, nd, ad, days).collect()}
    pace = {"primary": (1.33 * 1.45, 1.33 * 0.95, 1.33, 1.33 * 1.15, 1.33), "residential": (1.82 * 1.45, 1.82 * 0.95, 1.82, 1.82 * 1.15, 1.82)}
    for i in range(20):
        k = i % 5
        near = {}
        for arc, a, b, _, kind, s, _ in arcs:
            if arc % 6 or k in (0, 1, 4):
                near.setdefault(a, []).append((round(s * max(1.0, pace[kind][k])), b))
        assert got[i] == dijkstra(near, i).get(i + 9), i
    assert road.timed_drive(td.limit(0), nd, ad, days).count() == 0


def test_restrictions_still_bar(spark):
    """Turns that relations forbid aren't driven."""
    arcs = spark.createDataFrame([(1, 10, 0, 1, 90.0), (2, 11, 1, 2, 0.0), (3, 12, 1, 3, 180.0)], "arc long, way long, tail long, head long, bearing double")
    rel = spark.createDataFrame([(1, 1, [10], [11], "no_left_turn")], "rel long, via long, from_ways array<long>, to_ways array<long>, value string")
    barred = restrictions.forbidden_turns(rel, arcs)
    nodes = spark.createDataFrame([(k, 46.0 + k / 100, 7.0, False) for k in range(4)], "node long, lat double, lon double, signal boolean")
    ad = arcs.withColumns({"class": F.lit("primary"), "seconds": F.lit(10), "km": F.lit(1.0)})
    trips = spark.createDataFrame([(1, 46.0, 7.0, 46.02, 7.0), (2, 46.0, 7.0, 46.03, 7.0)], "request long, lat double, lon double, lat2 double, lon2 double")
    got = {r.request: r.seconds for r in road.drive(trips, nodes, ad, turn_table=road.turns(ad, nodes, barred)).collect()}
    assert got[1] is None and got[2] >= 20


def test_nearest_follows_density(spark):
    """A crowd around one spot, lone places far away, copies of one place, and points at a pole and beyond the date line."""
    import math

    from wayloom.operators import spatial

    rng = random.Random(9)
    places = [(k, 47.0 + rng.gauss(0, 0.01), 8.0 + rng.gauss(0, 0.01)) for k in range(300)] + [(500 + k, 47.0, 8.0) for k in range(3)] + [(600, -10.0, 179.99), (601, 89.9, 10.0), (602, 47.3, 8.3), (603, None, 1.0)]
    points = [(k, 47.0 + rng.gauss(0, 0.05), 8.0 + rng.gauss(0, 0.05)) for k in range(120)] + [(900, -10.0, -179.99), (901, 89.95, -170.0), (902, 0.0, 0.0), (903, 47.0, 8.0)]
    pd_ = spark.createDataFrame(points, "door long, lat double, lon double").repartition(3)
    ld = spark.createDataFrame(places, "stop long, p_lat double, p_lon double").repartition(3)

    def far(a, b, c, d):
        x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(1, math.sqrt(x)))

    got = {r.door: (r.stop, r.km) for r in spatial.nearest(pd_, "door", ld, "stop").collect()}
    for k, a, b in points:
        km, stop = min((far(a, b, c, d), s) for s, c, d in places if c is not None)
        assert got[k][1] == pytest.approx(km, abs=1e-6) and (got[k][0] == stop or abs(km - got[k][1]) < 1e-6), k
    assert got[903][0] == 500 and len(got) == len(points)
    assert spatial.nearest(pd_, "door", ld.limit(0), "stop").count() == 0 and spatial.nearest(pd_.limit(0), "door", ld, "stop").count() == 0


def test_network_of_ways(spark):
    """Arcs, signals and restrictions together; turn costs are a parameter."""
    from wayloom.operators import ways

    w = spark.createDataFrame([(1, [1, 2], {"highway": "primary"}), (2, [2, 3], {"highway": "primary"}), (3, [2, 4], {"highway": "primary", "oneway": "yes"})], "way long, refs array<long>, tags map<string,string>")
    n = spark.createDataFrame([(1, 46.0, 7.0, {}), (2, 46.0, 7.01, {"highway": "traffic_signals"}), (3, 46.01, 7.01, {}), (4, 46.0, 7.02, {}), (5, 1.0, 1.0, {})], "node long, lat double, lon double, tags map<string,string>")
    rel = spark.createDataFrame([(1, 2, [1], [2], "no_left_turn")], "rel long, via long, from_ways array<long>, to_ways array<long>, value string")
    arcs, nodes, barred = ways.network_of(w, n, rel)
    assert sorted((r.tail, r.head) for r in arcs.collect()) == [(1, 2), (2, 1), (2, 3), (2, 4), (3, 2)] and {r.node: r.signal for r in nodes.collect()} == {1: False, 2: True, 3: False, 4: False}
    ends = {r.arc: (r.tail, r.head) for r in arcs.collect()}
    costs = road.TurnCosts(straight=1.0, slight=1.0, near=1.0, far=1.0, sharp=1.0, u_turn=9.0, signal=100.0)
    cost = {(ends[r.in_arc], ends[r.out_arc]): r.cost for r in road.turns(arcs, nodes, barred, costs).collect()}
    assert ((1, 2), (2, 3)) not in cost and cost[(1, 2), (2, 4)] == 101.0 and cost[(1, 2), (2, 1)] == 109.0
