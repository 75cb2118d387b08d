"""Readers and writers over small files, searches, and whole timetables."""

import json

import pytest
from pyspark.sql import functions as F

from wayloom.functions import parsing
from wayloom.operators import feeds, road
from wayloom.sources import catalogs, flights, gtfs, results


def test_latin_feed(spark, tmp_path):
    (tmp_path / "stops.txt").write_bytes("stop_id,stop_name,stop_lat,stop_lon\nA,Zürich,47.4,8.5\n".encode("latin-1"))
    (tmp_path / "agency.txt").write_bytes("\ufeffagency_timezone\nEurope/Zurich\n".encode())
    assert [r.stop_name for r in gtfs.table(spark, str(tmp_path), "stops", ["stop_name", "missing"]).collect()] == ["Zürich"]
    assert [r.agency_timezone for r in gtfs.table(spark, str(tmp_path), "agency", ["agency_timezone"]).collect()] == ["Europe/Zurich"]
    assert gtfs.table(spark, str(tmp_path), "nothing", ["a"]) is None


def test_feed_zone(spark):
    zone = lambda *names: [r.tz for r in gtfs.feed_zone(spark.createDataFrame([(n,) for n in names], "agency_timezone string").coalesce(1)).collect()]
    assert zone("Europe/Paris", " Europe/Rome", "Europe/Rome", "Nowhere/Land", "Nowhere/Land", "Nowhere/Land") == ["Europe/Rome"]
    assert zone("Europe/Paris", "Europe/Rome") == ["Europe/Paris"] and zone("x", None) == []


def test_modes(spark):
    kinds = ["0", "1", "2", "4", "1100", "103", "1000", "x", None]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in kinds], "k string").coalesce(1).select(parsing.route_mode(F.col("k"))).collect()]
    assert got[2] == "train" and got[3] == "ferry" and got[4] == "flight" and len(got) == 9


def test_airports(spark, tmp_path):
    lines = ['1,"Old","C","X","AAA","AAAA",1.0,2.0,0,0,"N","Europe/Rome","airport","s"', '2,"New","C","X","AAA","AAAA",3.0,4.0,0,0,"N","Mars/Base","airport","s"', r'3,"No code","C","X",\N,"B",1,1,0,0,"N","Europe/Rome","airport","s"', r'4,"No place","C","X","CCC","B",\N,1,0,0,"N","Europe/Rome","airport","s"']
    (tmp_path / "a.csv").write_text("\n".join(lines))
    assert [(r.iata, r["name"], r.lat, r.tz) for r in flights.read_airports(spark, str(tmp_path / "a.csv")).collect()] == [("AAA", "New", 3.0, None)]


def test_regions(spark, tmp_path):
    square = [[0, 0], [2, 0], [2, 2], [0, 2]]
    far = [[x + 10, y + 10] for x, y in square]
    region = {"properties": {"id": "m", "name": "M", "parent": "p", "urls": {"pbf": "u"}}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [far]]}}
    (tmp_path / "r.json").write_text(json.dumps({"features": [region]}))
    r = catalogs.read_regions(spark, str(tmp_path / "r.json"))
    assert [(x.lat0, x.lat1, len(x.polygons)) for x in r.collect()] == [(0, 12, 2)]
    from wayloom.operators import spatial

    points = spark.createDataFrame([(1, 1.0, 1.0), (1, 11.0, 11.0), (2, 5.0, 5.0)], "g long, lat double, lon double")
    assert [(x.g, x.region_id) for x in spatial.smallest_region(points, r, "g").collect()] == [(1, "m")]


def test_geojson(spark, tmp_path):
    route = spark.createDataFrame([("a", [(1.0, 2.0), (3.0, 4.0)])], "id string, geometry array<struct<lat:double,lon:double>>")
    catalogs.write_geojson(route, str(tmp_path / "g"))
    line = json.loads(spark.read.text(str(tmp_path / "g")).first()[0])
    assert line["type"] == "Feature" and line["properties"] == {"id": "a"} and line["geometry"] == {"type": "LineString", "coordinates": [[2.0, 1.0], [4.0, 3.0]]}


def test_searches(spark):
    a = spark.createDataFrame([("ZRH", "Zurich Airport", "Zurich", 1), ("GVA", "Cointrin", "Geneva", 2), ("XZU", "Zu Field", "Town", 3), ("AAA", "Old zurich", "Q", 4)], "iata string, name string, city string, n long")
    assert [r.n for r in catalogs.search_airports(a, "zur").collect()] == [1, 4] and [r.n for r in catalogs.search_airports(a, " gva ").collect()] == [2]
    assert catalogs.search_airports(a, "z").count() == 0
    s = spark.createDataFrame([(1, "Bern", "rail_station"), (2, "Bern Airport", "airport"), (3, "Neu Bern", "rail_station"), (4, None, "rail_station")], "stop_id long, name string, stop_type string")
    assert [r.stop_id for r in catalogs.search_stops(s, "BERN").collect()] == [1, 3]


def test_suggestions(spark):
    hits = [(0, 1, "Rome, Italy", 41.9, 12.5), (0, 2, "Rome, Again", 41.9, 12.5), (1, 1, "Rome Airport (ROM)", 41.9, 12.5), (2, 1, "Termini", 41.901, 12.501), (3, 1, "Rome, Lazio, Italy", 41.95, 12.55), (3, 2, "Vatican", 41.9022, 12.4533), (3, 3, "Rome, Georgia", 34.2, -85.1)]
    df = spark.createDataFrame(hits, "source_no int, n int, label string, lat double, lon double")
    assert [r.label for r in catalogs.suggestions(df).collect()] == ["Rome, Italy", "Rome, Again", "Termini", "Vatican", "Rome, Georgia"]
    assert catalogs.suggestions(df, 2).count() == 2


def test_geocode(spark):
    first = spark.createDataFrame([("Bern", 46.9, 7.4)], "place string, lat double, lon double")
    second = spark.createDataFrame([("bern", 0.0, 0.0), ("Basel, CH", 47.5, 7.6)], "place string, lat double, lon double")
    names = spark.createDataFrame([("Bern, Switzerland",), (" basel",)], "name string")
    assert {r["name"]: r.lat for r in catalogs.geocode(names, [first, second]).collect()} == {"Bern, Switzerland": 46.9, " basel": 47.5}
    with pytest.raises(ValueError):
        catalogs.geocode(names, [first])


def test_rail_first(spark):
    df = spark.createDataFrame([(1, 5.0, False), (2, 9.0, True), (3, 2.0, None)], "feed_id long, area double, rail boolean")
    assert [r.feed_id for r in catalogs.rail_first(df).collect()] == [2, 3, 1]


def timetable(spark, stops, calls, walks=()):
    s = spark.createDataFrame(stops, "stop_id string, lat double, lon double, stop_type string, tz string")
    c = spark.createDataFrame([(t, k, x, 100 * k, 100 * k) for t, xs in calls for k, x in enumerate(xs)], "trip_id string, seq int, stop_id string, arr_s long, dep_s long")
    return feeds.Timetable(s, c.select("trip_id").distinct(), c, spark.createDataFrame(list(walks), "from_stop string, to_stop string, dur_s long"))


def test_merge(spark):
    a = timetable(spark, [("S", 50.0, 6.0, "rail_station", None), ("S#1", 10.0, 10.0, "rail_station", None)], [("t", ["S", "S#1"])])
    b = timetable(spark, [("S", 53.0, 6.0, "rail_station", None), ("U", 53.1, 6.0, "rail_station", None)], [("t", ["U", "S"]), ("v", ["S", "U"])], [("S", "U", 60)])
    m = feeds.merge([a, b])
    assert sorted(r.stop_id for r in m.stops.collect()) == ["S", "S#1", "S#1#", "U"]
    assert [(r.trip_id, r.stop_id) for r in m.calls.orderBy("trip_id", "seq").collect()] == [("t", "S"), ("t", "S#1"), ("v", "S#1#"), ("v", "U")]
    assert [tuple(r) for r in m.footpaths.collect()] == [("S#1#", "U", 60)]


def test_clip(spark):
    """A trip stays whole; walks bring in stations of the box, from one to the next, and none beyond it."""
    stops = [(x, lat, 7.0, "rail_station", None) for x, lat in (("A", 46.0), ("B", 46.5), ("C", 60.0), ("P", 46.2), ("Q", 46.3), ("Z", 70.0))]
    t = timetable(spark, stops, [("in", ["A", "B", "C"]), ("out", ["A", "C"])], [("P", "A", 60), ("P", "Q", 60), ("Z", "A", 60)])
    c = feeds.clip(t, 45, 6, 47, 8)
    assert sorted(r.stop_id for r in c.stops.collect()) == ["A", "B", "C", "P", "Q"] and [r.trip_id for r in c.trips.collect()] == ["in"]
    assert sorted((r.from_stop, r.to_stop) for r in c.footpaths.collect()) == [("P", "A"), ("P", "Q")]


def test_compose(spark):
    air = timetable(spark, [("AIR", 46.0, 7.0, "airport", "Europe/Zurich")], [])
    rail = timetable(spark, [("R1", 46.001, 7.0, "rail_station", None), ("R2", 46.4, 7.0, "rail_station", None)], [("r", ["R1", "R2"])])
    far = timetable(spark, [("F1", 10.0, 7.0, "rail_station", None), ("F2", 10.1, 7.0, "rail_station", None)], [("f", ["F1", "F2"])])
    t, notes = feeds.compose([(46.0, 7.0), (46.4, 7.0)], air, [far, rail])
    assert sorted(r.stop_id for r in t.stops.collect()) == ["AIR", "R1", "R2"] and {r.tz for r in t.stops.collect()} == {"Europe/Zurich"}
    assert sorted((r.from_stop, r.to_stop) for r in t.footpaths.collect()) == [("AIR", "R1"), ("R1", "AIR")] and len(notes) == 1


def test_line_graph(spark):
    arcs = spark.createDataFrame([(1, 1, 2, 0.0, "road", []), (2, 2, 3, 90.0, "road", [6, 7])], "arc long, tail long, head long, bearing double, class string, open_months array<int>")
    nodes = spark.createDataFrame([(1, 0.0, 0.0, False), (2, 1.0, 0.0, False), (3, 1.0, 1.0, False)], "node long, lat double, lon double, signal boolean")
    r = road.line_graph(arcs, nodes).first()
    assert (r.in_arc, r.out_arc, tuple(r.in_mid), tuple(r.out_mid), r.out_months) == (1, 2, (0.5, 0.0), (1.0, 0.5), [6, 7])


def test_texts(spark):
    step = lambda mode: spark.range(1).select(results.describe(F.lit(mode), F.lit("A"), F.lit("B"))).first()[0]
    assert [step(m) for m in ("walk", "car", "flight")] == ["Walk to B", "Drive to B", "Flight from A to B"]
    assert [r.line for r in results.credits(spark, air=False, ground=False).collect()] == ["OpenStreetMap contributors (extracts via Geofabrik): Open Database License (ODbL) v1.0 <https://opendatacommons.org/licenses/odbl/1-0/>"]


def feed_files():
    return {
        "stops": "﻿stop_id,stop_name,stop_lat,stop_lon\nA,\"Two\nlines\",46.9,7.4\nB,Bärn,46.7,7.6\n",
        "routes": "route_id,route_type\nR1,2\n",
        "agency": "agency_id,agency_timezone\n1,Europe/Zurich\n",
        "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nWD,1,1,1,1,1,0,0,20260101,20261231\n",
        "trips": "route_id,service_id,trip_id\nR1,WD,T1\nR1,WD,T2\n",
        "stop_times": "trip_id,stop_sequence,stop_id,arrival_time,departure_time\n" + "".join(f"T{t},{k},{s},{h}:00:00,{h}:05:00\n" for t in (1, 2) for k, (s, h) in enumerate([("A", 8 + t), ("B", 10 + t)])),
        "transfers": "from_stop_id,to_stop_id,transfer_type,min_transfer_time\nA,A,2,600\nA,A,1,\nA,B,2,180\n",
    }


def test_archives(spark, tmp_path):
    """A feed in an archive, in a folder within it and in Latin-1 too, reads as its folder does."""
    import zipfile

    from wayloom.sources import archives

    (tmp_path / "feed").mkdir()
    for n, text in feed_files().items():
        (tmp_path / "feed" / f"{n}.txt").write_text(text)
    with zipfile.ZipFile(tmp_path / "feed.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for n, text in feed_files().items():
            z.writestr(f"inner/{n}.txt", text.removeprefix("﻿").encode("latin-1") if n == "stops" else text.encode())
        z.writestr("inner/readme.md", "none of this")
    a, b = (gtfs.read_gtfs(spark, str(tmp_path / n)) for n in ("feed", "feed.zip"))
    for part in ("stops", "trips", "calls", "footpaths"):
        x, y = getattr(a, part), getattr(b, part)
        assert sorted(x.columns) == sorted(y.columns)
        assert sorted(map(repr, map(tuple, x.select(sorted(x.columns)).collect()))) == sorted(map(repr, map(tuple, y.select(sorted(x.columns)).collect()))), part
    assert {r.stop_id: r.min_transfer_s for r in b.stops.collect()} == {"A": 0, "B": 300} and {r.name for r in b.stops.collect()} == {"Two\nlines", "Bärn"}
    cells = archives.unpack(spark, str(tmp_path / "*.zip"))
    assert archives.member(cells, "shapes", ["shape_id"]) is None and archives.member(cells, "agency", ["agency_id", "agency_phone"]).first()[:2] == ("1", None)


def test_rail_air_rail(spark):
    """Flights as a timetable, merged with rail and linked: a train to the airport, a flight over zones, a train on."""
    from datetime import datetime

    from pyspark.sql import functions as F

    from wayloom.operators import contracts, feeds, transit

    airports = spark.createDataFrame([("ZRH", "Zurich", 47.45, 8.55, "Europe/Zurich"), ("LHR", "London", 51.47, -0.45, "Europe/London"), ("XXX", "None", 0.0, 0.0, None)], "iata string, name string, lat double, lon double, tz string")
    pairs = spark.createDataFrame([("ZRH", "LHR"), ("LHR", "ZRH")], "src string, dst string")
    air = flights.timetable(airports, pairs)
    assert sorted(r.stop_id for r in air.stops.collect()) == ["LHR", "ZRH"] and air.trips.count() == 6
    assert flights.timetable(airports, pairs, airports.where("iata = 'ZRH'").select("iata")).stops.count() == 0
    stops = spark.createDataFrame([("R1", "Rail 1", 46.95, 7.44, "rail_station", None, 300), ("R2", "Rail 2", 47.451, 8.551, "rail_station", None, 300), ("L1", "L 1", 51.471, -0.451, "rail_station", None, 300), ("L2", "L 2", 51.9, -0.45, "rail_station", None, 300)], air.stops.schema)
    calls = spark.createDataFrame([("a", 1, "R1", 20000, 20000), ("a", 2, "R2", 25000, 25000), ("b", 1, "L1", 43200, 43200), ("b", 2, "L2", 46800, 46800)], air.calls.schema)
    trips = air.trips.limit(1).drop("trip_id", "mode").join(spark.createDataFrame([("a", "train"), ("b", "train")], "trip_id string, mode string"), how="cross").select(air.trips.columns)
    t = feeds.link_hubs(feeds.fill_zones(feeds.merge([air, feeds.Timetable(stops, trips, calls, air.footpaths)])))
    ask = spark.createDataFrame([(1, 46.951, 7.441, 51.901, -0.451, datetime(2026, 7, 1, 5), 1, "transit")], "request long, lat double, lon double, lat2 double, lon2 double, depart timestamp_ntz, top int, access string")
    walks = transit.close_footpaths(t.footpaths.withColumn("dur_s", F.col("dur_s").cast("long")))
    plan = contracts.plan_each(ask, t.trips, t.calls, t.stops, walks).first()
    assert plan.modes.replace("walk,", "").removesuffix(",walk") == "train,flight,train"
    assert 46800 - 3600 + 3600 + 3600 * 1 <= plan.total_s + 18000 <= 46800 + 3600 + 600  # the last train arrives at 13:00 British time, 14:00 at the door's


def test_compose_each_against_compose(spark):
    """All trips at once choose what each alone is composed of."""
    import random

    from wayloom.operators import compose, feeds

    rng = random.Random(3)
    boxes = [(f"f{k}", 45.0, 5.0, 46.0 + k * 0.7, 7.0 + k * 0.6) for k in range(5)]
    stops, calls = [], []
    for f, a, b, c, d in boxes:
        stops += [(f, f"{f}s{i}", a + rng.random() * (c - a), b + rng.random() * (d - b)) for i in range(12)]
        calls += [(f, f"{f}t{t}", k, f"{f}s{s}") for t in range(8) for k, s in enumerate(rng.sample(range(12), 3))]
    trips = [(i, 45 + rng.random(), 5 + rng.random() * 2, 45 + rng.random() * 2.5, 5 + rng.random() * 3) for i in range(12)] + [(99, 10.0, 10.0, 11.0, 11.0)]
    bd = spark.createDataFrame(boxes, "feed_id string, lat0 double, lon0 double, lat1 double, lon1 double")
    sd, cd = spark.createDataFrame(stops, "feed_id string, stop_id string, lat double, lon double"), spark.createDataFrame(calls, "feed_id string, trip_id string, seq int, stop_id string")
    td = spark.createDataFrame(trips, "request long, lat double, lon double, lat2 double, lon2 double")
    chosen, service = compose.compose_each(td, bd.where("feed_id <> 'f4'"), sd, cd, bd.where("feed_id = 'f4'"), margin=0.3, attempts=3, most_trips=9)
    got, kept = {}, {}
    for r in chosen.collect():
        got.setdefault(r.request, []).append((r.feed_id, r.curated, r.n_trips, r.kept, r.note))
    for r in service.collect():
        kept.setdefault(r.request, set()).add(r.trip_id)
    place = {s[1]: s[2:] for s in stops}
    for i, *ends in trips:
        (a, b, c, d), want, total, stopped = ends, [], 0, False
        box = (min(a, c) - 0.3, min(b, d) - 0.3, max(a, c) + 0.3, max(b, d) + 0.3)
        holds = lambda f, lat, lon: f[1] <= lat <= f[3] and f[2] <= lon <= f[4]
        trips_in = lambda f: {t for t in {x[1] for x in calls if x[0] == f} if sum(box[0] <= place[x[3]][0] <= box[2] and box[1] <= place[x[3]][1] <= box[3] for x in calls if x[1] == t) >= 2}
        mine = set()
        for f in [f for f in boxes[:4] if holds(f, a, b) and holds(f, c, d)][:3]:
            n = trips_in(f[0])
            stopped = stopped or bool(n and total and total + len(n) > 9)
            take = bool(n) and not stopped
            want.append((f[0], False, len(n), take, "beyond the number of trips" if stopped else None if n else "no service in the corridor"))
            total, mine = total + len(n) * take, mine | (n if take else set())
        if not want:
            want.append((None, None, None, False, "no feed covers this trip"))
        if holds(boxes[4], a, b) or holds(boxes[4], c, d):
            n = trips_in("f4")
            want.append(("f4", True, len(n), bool(n), None if n else "no service in the corridor"))
            mine |= n
        assert sorted(map(repr, got[i])) == sorted(map(repr, want)), i
        assert kept.get(i, set()) == mine
    assert sum(x[3] for v in got.values() for x in v) > 5 and any("beyond" in str(x[4]) for v in got.values() for x in v)
    assert feeds.MARGIN == 0.6


def test_skyline(spark, monkeypatch):
    """Sorted skylines in parts against all pairs, with ties and gaps."""
    import random

    from wayloom.operators import planner

    rng = random.Random(8)
    rows = [(rng.randint(1, 2), i, rng.randint(0, 12), float(rng.randint(0, 12)), rng.choice([None, *range(8)])) for i in range(900)]
    df = spark.createDataFrame(rows, "request long, cand long, total_s long, cost double, transfers long").repartition(3)
    axes = ["total_s", "cost", "transfers"]
    beats = lambda y, x: None not in y[2:] and None not in x[2:] and all(a <= b for a, b in zip(y[2:], x[2:], strict=True)) and y[2:] != x[2:]
    want = sorted(x[1] for x in rows if not any(y[0] == x[0] and beats(y, x) for y in rows))
    assert sorted(r.cand for r in planner.frontier(df, axes).collect()) == want
    monkeypatch.setattr(planner, "PART", 40)
    assert sorted(r.cand for r in planner.frontier(df, axes).collect()) == want
    assert planner.frontier(df.limit(0), axes).count() == 0
