"""Door-to-door plans: fixtures, and whole candidate searches against a brute-force version."""

import random

import pytest
from pyspark.sql import functions as F

from wayloom.operators import connectors, planner, road, search, spatial, transit

CONN = "run_id string, seq int, dep_stop string, arr_stop string, dep long, arr long, mode string"
STOP = "stop_id string, lat double, lon double, min_transfer_s int"
WALK = "from_stop string, to_stop string, dur_s long"
REQUEST = "request long, lat double, lon double, lat2 double, lon2 double, depart long"
LINE = [("A", 46.0, 7.0, 300), ("H", 46.3, 7.0, 300), ("C", 46.6, 7.0, 300)]


def frames(spark, conns, stops=LINE, walks=()):
    return spark.createDataFrame(conns, CONN), spark.createDataFrame(stops, STOP), spark.createDataFrame(list(walks), WALK)


def test_legs_back(spark):
    c, s, none = frames(spark, [("r1", 1, "A", "H", 4000, 5000, "train"), ("r2", 1, "H", "C", 5600, 7000, "train"), ("r3", 1, "A", "C", 4100, 9000, "train")])
    labels, history = transit.scan(spark.createDataFrame([(1, "A", 3000)], "request long, stop string, at long"), c, s, none)
    preds = search.predecessors(history, c, s, none)
    legs = search.legs_to(search.best_targets(labels).where("target = 'C'"), preds).orderBy("back").collect()
    assert [(r.run_id, r.from_stop, r.to_stop, r.depart, r.arrive) for r in legs] == [("r2", "H", "C", 5600, 7000), ("r1", "A", "H", 4000, 5000)]
    legs = search.legs_to(search.fewest_targets(history).where("target = 'C'"), preds).collect()
    assert [(r.run_id, r.depart, r.arrive) for r in legs] == [("r3", 4100, 9000)]


def test_legs_on_foot(spark):
    c, s, w = frames(spark, [("r1", 1, "A", "H", 4000, 5000, "train"), ("r2", 1, "G", "C", 5100, 7000, "train")], [*LINE, ("G", 46.3, 7.001, None)], [("H", "G", 60)])
    labels, history = transit.scan(spark.createDataFrame([(1, "A", 3000)], "request long, stop string, at long"), c, s, w)
    legs = search.legs_to(search.best_targets(labels).where("target = 'C'"), search.predecessors(history, c, s, w)).orderBy("back").collect()
    assert [(r.run_id, r.from_stop, r.to_stop) for r in legs] == [("r2", "G", "C"), (None, "H", "G"), ("r1", "A", "H")]


def test_plan(spark):
    """The drive is dominated by car and train where both are counted; it stays where it is faster."""
    c, s, none = frames(spark, [("r1", 1, "A", "H", 4000, 5000, "train"), ("r2", 1, "H", "C", 5600, 7000, "train"), ("r3", 1, "A", "C", 4100, 6900, "train"), ("f1", 1, "A", "C", 30000, 31000, "flight")])
    r = spark.createDataFrame([(1, 46.0005, 7.0, 46.6005, 7.0, 3000), (2, 46.0, 7.0, 46.03, 7.0, 3000)], REQUEST)
    cands, legs = search.pool(r, c, s, none)
    assert legs.groupBy("request", "cand").count().count() == cands.count()
    got = {(x.request, x.cand): x for x in search.choose(cands, "greenest").collect()}
    best = next(x for (q, _), x in got.items() if q == 1 and x["rank"] == 1)
    assert best.vehicles == 1 and best.total_s == 6900 + 40 - 3000
    fast = {x.request: x for x in search.choose(cands, "fastest", 1).collect()}
    assert fast[2].cand == "ground 0" and fast[2].car_km == pytest.approx(3.336 * 1.3, rel=1e-3)
    flown = [x for x in cands.collect() if "flight" in x.modes]
    assert flown and all(x.request == 1 for x in flown)
    assert not [x for x in search.choose(cands, "air_priority", 3, ("flight",)).collect() if "flight" in x.modes]
    labels = {(x.request, x.labels) for x in search.choices(cands, ["fastest", "cheapest", "greenest", "air_priority"]).collect()}
    assert any("greenest" in text for q, text in labels if q == 1) and sum(text.count(",") + 1 for q, text in labels if q == 1) == 4


def test_only_way_there_is_flown(spark):
    c, s, none = frames(spark, [("f1", 1, "A", "Z", 4000, 20000, "flight")], [("A", 46.0, 7.0, 300), ("Z", 46.0, 60.0, 300)])
    r = spark.createDataFrame([(1, 46.001, 7.0, 46.001, 60.0, 3000)], REQUEST)
    assert [x.modes for x in search.plan(r, c, s, none, "fastest", 3, ("flight",)).collect()] == ["walk,flight,walk"]


def test_unknown_stop_is_left_out(spark):
    c, s, none = frames(spark, [("r1", 1, "A", "Q", 4000, 4500, "train"), ("r2", 1, "Q", "C", 5000, 5500, "train")])
    r = spark.createDataFrame([(1, 46.0005, 7.0, 46.6005, 7.0, 3000)], REQUEST)
    assert [x.cand for x in search.plan(r, c, s, none).collect()] == ["ground 0"]


def test_implausible(spark):
    """A second stop at the destination counts where the first one's journey makes no sense."""
    leg = lambda k, mode, km, s: (1, k, 1, mode, km, s, 0, 2)
    legs = [leg(1, "train", 80.0, 4 * 3600), leg(2, "train", 80.0, 3000), leg(3, "train", 400.0, 9000), leg(4, "walk", 80.0, 9 * 3600), leg(5, "train", 20.0, 7 * 3600)]
    df = spark.createDataFrame(legs, "request long, cand long, leg_no int, mode string, km double, travel_s long, overhead_s long, cost_level int")
    assert sorted(r.cand for r in planner.plausible(planner.metrics(df), F.lit(100.0)).collect()) == [2, 4, 5]
    assert sorted(r.cand for r in planner.plausible(planner.metrics(df), F.lit(20.0)).collect()) == [2, 3]
    many = spark.createDataFrame([(1, 1, i, "train", 5.0, 60, 0, 2) for i in range(11)], df.schema)
    assert planner.plausible(planner.metrics(many), F.lit(50.0)).count() == 0


def brute_arrivals(sources, conns, stops, walks, modes):
    """Labels by plain repetition over one request."""
    foot, veh = dict(sources), {}
    change = {s[0]: s[3] for s in stops}
    while True:
        ready = {}
        for x in set(foot) | set(veh):
            t = [foot[x]] if x in foot else []
            wait = change.get(x, 300)
            t += [veh[x] + wait] if x in veh and wait is not None else []
            if t:
                ready[x] = min(t)
        ride = {}
        for run in {c[0] for c in conns}:
            on = False
            for _, _, a, b, dep, arr, mode in sorted(c for c in conns if c[0] == run):
                on = on or (mode in modes and a in ready and ready[a] <= dep)
                if on:
                    ride[b] = min(arr, ride.get(b, arr))
        new_foot = dict(foot)
        for a, b, d in walks:
            if a in ride:
                new_foot[b] = min(ride[a] + d, new_foot.get(b, ride[a] + d))
        new_veh = {x: min(ride.get(x, 10**9), veh.get(x, 10**9)) for x in set(ride) | set(veh)}
        if (new_foot, new_veh) == (foot, veh):
            return {x: min(foot.get(x, 10**9), veh.get(x, 10**9)) for x in set(foot) | set(veh)}
        foot, veh = new_foot, new_veh


def test_plans_by_brute_force(spark):
    rng = random.Random(11)
    stops = [(f"S{i}", 46 + rng.random() * 0.5, 7 + rng.random() * 0.5, rng.choice([None, 0, 120, 300])) for i in range(14)]
    conns = []
    for run in range(60):
        path, t, mode = rng.sample(range(14), 4), rng.randint(20000, 30000), rng.choice(["train", "ferry", "flight"])
        for k, (a, b) in enumerate(zip(path, path[1:], strict=False)):
            conns.append((f"r{run}", k, f"S{a}", f"S{b}", t, t + 600, mode))
            t += rng.randint(700, 1500)
    walks = [(f"S{i}", f"S{i + 1}", 240) for i in range(0, 12, 3)]
    requests = [(i, 46 + rng.random() * 0.5, 7 + rng.random() * 0.5, 46 + rng.random() * 0.5, 7 + rng.random() * 0.5, 20500 + i) for i in range(8)]
    c, s, w = frames(spark, conns, stops, walks)
    r = spark.createDataFrame(requests, REQUEST)
    near = connectors.geometric(km=20.0)
    cands, legs = search.pool(r, c, s, w, [near])
    access, egress, direct = near(r, s)
    start, end, ground = {}, {}, {x.request: x for x in direct.collect()}
    for x in access.collect():
        start.setdefault(x.request, {})[x.stop] = x.seconds
    for x in egress.collect():
        end.setdefault(x.request, {})[x.stop] = x.seconds
    rows = cands.collect()
    found = 0
    for q in requests:
        mine = [x for x in rows if x.request == q[0]]
        sources = {x: q[5] + n for x, n in start.get(q[0], {}).items()}
        want = {ground[q[0]].seconds}
        for modes in (("train", "ferry", "flight"), ("flight",), ("train", "ferry")):
            at = brute_arrivals(sources, conns, stops, walks, modes)
            doors = [at[x] + n - q[5] for x, n in end.get(q[0], {}).items() if x in at and not (x in sources and at[x] >= sources[x])]
            if doors:
                want.add(min(doors))
                found += 1
        assert want <= {x.total_s for x in mine}, q
        assert min(x.total_s for x in mine) == min(want)
    assert found > 8
    for x in legs.groupBy("request", "cand").agg(F.sum(F.col("travel_s") + F.col("overhead_s")).alias("t"), (F.max("arrive") - F.min("depart")).alias("span")).collect():
        assert x.t == x.span


def test_modes_and_preferences():
    assert connectors.preference("train")["exclude"] == ("flight",) and connectors.preference("unheard of") == connectors.preference("transit")
    assert len(connectors.by_mode("both")) == 2 and len(connectors.by_mode("transit", "car")) == 1
    for bad in ({"access": "boat"}, {"egress": "both"}, {"turn_aware": True}, {"access": "both", "egress": "car"}, {"access": "transit", "roads": connectors.geometric()}):
        with pytest.raises(ValueError):
            connectors.by_mode(**bad)


def grid(spark, n=6):
    """A square of nodes 0.02 degrees apart with arcs both ways."""
    nodes = [(i * n + j, 46 + i * 0.02, 7 + j * 0.02) for i in range(n) for j in range(n)]
    arcs = [(a, b, 100, 2.0) for i in range(n) for j in range(n) for a in [i * n + j] for b in ([a + 1] if j < n - 1 else []) + ([a + n] if i < n - 1 else [])]
    return spark.createDataFrame(nodes, "node long, lat double, lon double"), spark.createDataFrame(arcs + [(b, a, s, k) for a, b, s, k in arcs], "tail long, head long, seconds long, km double")


def test_network_connector(spark):
    nodes, arcs = grid(spark)
    stops = spark.createDataFrame([("N", 46.001, 7.001), ("F", 46.1, 7.1), ("Z", 48.0, 7.0)], "stop_id string, lat double, lon double")
    r = spark.createDataFrame([(1, 46.0, 7.0, 46.1, 7.06, 0), (2, 50.0, 9.0, 46.0, 7.0, 0)], REQUEST)
    access, egress, direct = connectors.network(nodes, arcs)(r, stops)
    a = {(x.request, x.stop): (x.mode, x.seconds, x.km) for x in access.collect()}
    assert a[1, "N"][0] == "walk" and a[1, "F"] == ("car", 1000, 20.0) and len(a) == 2
    assert {(x.request, x.stop): x.seconds for x in egress.collect()}[1, "F"] == 200
    assert [(x.request, x.mode, x.seconds, x.km) for x in direct.collect()] == [(1, "car", 800, 16.0)]
    first, last, whole = connectors.split(connectors.on_foot(), connectors.geometric())(r, stops)
    assert [x.stop for x in first.collect()] == ["N"] and whole.count() == 0 and last.where("request = 2 and stop = 'F'").count() == 1


def test_drive(spark):
    nodes, arcs = grid(spark)
    trips = spark.createDataFrame([(1, 46.0, 7.0, 46.1, 7.1, 0), (2, 46.0, 7.0, 46.0, 7.0, 0)], REQUEST)
    assert sorted(tuple(x) for x in road.drive(trips, nodes, arcs).collect()) == [(1, 1000.0, 20.0), (2, 0.0, 0.0)]
    with pytest.raises(ValueError):
        road.drive(spark.createDataFrame([(1, 46.0, 7.0, 10.0, 7.1, 0)], REQUEST), nodes, arcs)


def test_drive_routes(spark):
    """The geometry leads from the start's node to the end's over neighbours, as long as the drive."""
    nodes, arcs = grid(spark)
    trips = spark.createDataFrame([(1, 46.0, 7.0, 46.06, 7.04, 0), (2, 46.02, 7.02, 46.02, 7.02, 0)], REQUEST)
    got = {r.request: r for r in road.drive_routes(trips, nodes, arcs).collect()}
    line = [(round(p.lat, 2), round(p.lon, 2)) for p in got[1].geometry]
    assert line[0] == (46.0, 7.0) and line[-1] == (46.06, 7.04) and len(line) == 6 and got[1].seconds == 500
    assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) < 0.0201 for a, b in zip(line, line[1:], strict=False))
    assert len(got[2].geometry) == 1 and got[2].seconds == 0


def test_overrides(spark):
    arcs = spark.createDataFrame([(1, 1, 2, 100, 90, "pass"), (2, 2, 3, 50, 40, "valley")], "arc long, tail long, head long, seconds long, base_seconds long, name string")
    closed = road.with_overrides(arcs, road.close_named(arcs, ["pass"]))
    assert [r.arc for r in closed.collect()] == [2]
    assert {r.arc: r.seconds for r in road.with_overrides(arcs, road.open_named(arcs, ["pass"])).collect()} == {1: 90, 2: 50}


def brute_near(points, places, km):
    import math

    def gc(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 6371.0088 * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    return {(p[0], q[0]): gc(p[1], p[2], q[1], q[2]) for p in points for q in places if gc(p[1], p[2], q[1], q[2]) <= km}


def test_radius_everywhere(spark):
    """Across the 180th meridian, at 82 degrees and at the poles."""
    rng = random.Random(6)
    spots = [(0, 179.99), (82, 30), (89.9, 0), (-90, 0), (-75, -180), (51, 7), (0, 0)]
    place = lambda: next((max(-90.0, min(90.0, a + rng.gauss(0, 0.5))), (b + rng.gauss(0, 3) + 180) % 360 - 180) for a, b in [rng.choice(spots)])
    points, places = [(i, *place()) for i in range(150)], [(i, *place()) for i in range(150)]
    points += [(900, 0.0, 180.0), (901, 90.0, 10.0)]
    places += [(900, 0.0, -180.0), (901, 90.0, -170.0)]
    p, q = spark.createDataFrame(points, "i long, lat double, lon double"), spark.createDataFrame(places, "j long, p_lat double, p_lon double")
    for km in (5.0, 60.0, 900.0, 12000.0):
        got = [(r.i, r.j) for r in spatial.within(p, q, km).collect()]
        assert len(got) == len(set(got)) and set(got) == set(brute_near(points, places, km))
    every = brute_near(points, places, 30000)
    near = {r.i: r.j for r in spatial.nearest(p, "i", q, "j").collect()}
    assert set(near) == {x[0] for x in points}
    assert all(every[i, j] <= min(every[i, y[0]] for y in places) + 1e-6 for i, j in near.items())


def test_requests_are_checked(spark):
    good = (1, 46.0, 7.0, 47.0, 8.0, 0)
    assert search.check_requests(spark.createDataFrame([good], REQUEST)).count() == 1
    for bad in ([(1, 91.0, 7.0, 47.0, 8.0, 0)], [(1, 46.0, 7.0, None, 8.0, 0)], [good, good], [(1, 46.0, 7.0, 47.0, 8.0, None)]):
        with pytest.raises(ValueError):
            search.check_requests(spark.createDataFrame(bad, REQUEST))
    with pytest.raises(ValueError):
        search.check_requests(spark.createDataFrame([(1,)], "request long"))


def test_trips_by_name(spark):
    c, s, none = frames(spark, [("r1", 1, "A", "C", 4100, 6900, "train"), ("f1", 1, "A", "C", 4000, 5000, "flight")])
    places = spark.createDataFrame([("Alpha", 46.0005, 7.0), ("Gamma", 46.6005, 7.0)], "place string, lat double, lon double")
    trips = spark.createDataFrame([(1, "Alpha, Land", "gamma", 3000)], "request long, origin string, dest string, depart long")
    assert [r.modes for r in search.plan_trips(trips, [places], c, s, none, "transit", top=1).collect()] == ["walk,flight,walk"]
    assert [r.modes for r in search.plan_trips(trips, [places], c, s, none, "train", top=1).collect()] == ["walk,train,walk"]
    assert search.plan_trips(trips, [places], c, s, none, "drive", objectives=["fastest", "greenest"]).count() == 2


def test_regions_connector(spark):
    nodes, arcs = grid(spark)
    stops = spark.createDataFrame([("F", 46.1, 7.1)], "stop_id string, lat double, lon double")
    r = spark.createDataFrame([(1, 46.0, 7.0, 46.1, 7.06, 0), (2, 46.0, 7.0, 46.1, 7.06, 0)], REQUEST)
    region = spark.createDataFrame([(1, "here")], "request long, region_id string")
    access, _, direct = connectors.by_region(region, {"here": connectors.network(nodes, arcs)}, connectors.geometric())(r, stops)
    seconds = {x.request: x.seconds for x in access.collect()}
    assert seconds[1] == 1000 and seconds[2] not in (None, 1000) and direct.count() == 2


def test_relations(spark):
    from wayloom.operators import restrictions

    def rel(k, tags, *members):
        return (k, tags, list(members))

    tags = {"type": "restriction", "restriction": "no_left_turn"}
    rows = [
        rel(1, tags, ("way", 1, "from"), ("node", 5, "via"), ("node", 6, "via"), ("way", 2, "to"), ("way", 3, "to")), rel(2, tags, ("way", 1, "from"), ("way", 5, "via"), ("way", 2, "to")),
        rel(3, {"type": "restriction", "restriction:conditional": "no_left_turn @ (Mo)"}, ("way", 1, "from"), ("node", 5, "via"), ("way", 2, "to")), rel(4, tags, ("node", 5, "via"), ("way", 2, "to")), rel(5, {"type": "route"}, ("way", 1, "from")),
    ]
    df = spark.createDataFrame(rows, "rel long, tags map<string,string>, members array<struct<kind:string,ref:long,role:string>>")
    assert [tuple(r) for r in restrictions.relations(df).collect()] == [(1, [1], 6, [2, 3], "no_left_turn")]


def test_conditions_on_roads(spark):
    arcs = spark.createDataFrame([(1, 100, "road", [], [], ["snow"]), (2, 100, "road", [], ["summer"], []), (3, 100, "road", [7], [], [])], "arc long, base_seconds long, class string, open_months array<int>, required array<string>, forbidden array<string>")
    is_open = lambda month, *c: sorted(r.arc for r in road.arc_weights(arcs, month, None, c).collect())
    assert is_open(1) == [1] and is_open(7, "summer") == [1, 2, 3] and is_open(7, "snow", "summer") == [2, 3]


def patterned(rng, lines=6, runs=40):
    """Runs of a few lines in lanes: fast and slow ones that overtake each other, twins at one time, modes."""
    conns = []
    for line in range(lines):
        path = rng.sample(range(12), 5)
        for k in range(runs):
            pace, mode = rng.choice([600, 600, 600, 1500]), rng.choice(["train", "train", "ferry"])
            t = 20000 + rng.randint(0, 60) * 600
            for p, (a, b) in enumerate(zip(path, path[1:], strict=False)):
                conns.append((f"l{line}r{k}", p, f"S{a}", f"S{b}", t, t + pace, mode))
                t += pace + 120
    return conns


def test_lanes_give_the_labels_of_all_departures(spark):
    rng = random.Random(5)
    stops = [(f"S{i}", 46.0, 7.0, rng.choice([None, 0, 120, 300])) for i in range(11)]  # S11 is unknown
    conns, walks = patterned(rng), [(f"S{i}", f"S{i + 1}", 240) for i in range(0, 10, 3)]
    c, s, w = frames(spark, conns, stops, walks)
    sources = [(i, f"S{rng.randrange(12)}", 19000 + rng.randint(0, 70) * 500) for i in range(12)] + [(12, "S1", 90000)]
    at = spark.createDataFrame(sources, "request long, stop string, at long")
    for modes in (["train", "ferry"], ["train"]):
        labels, _ = transit.scan(at, c, s, w, None, F.col("mode").isin(*modes))
        got = {}
        for r in transit.arrivals(labels).collect():
            got.setdefault(r.request, {})[r.stop] = r.arrive
        for k, stop, t in sources:
            assert got[k] == brute_arrivals({stop: t}, conns, stops, walks, modes), k


def test_lanes_are_of_one_shape_and_never_overtake(spark):
    conns = patterned(random.Random(9))
    c, _, _ = frames(spark, conns, [("S0", 46.0, 7.0, 0)], [("S0", "S1", 240)])
    rows = transit.lanes(c).collect()
    assert sorted(tuple(r)[: len(c.columns)] for r in rows) == sorted(conns)
    shapes = {}
    for r in rows:
        shapes.setdefault((r.lane, r.mode, r.seq), []).append(r)
    distances = lambda run: tuple((x[2], x[3], x[4] - run[0][4], x[5] - run[0][4]) for x in run)
    by_run = {n: sorted(x for x in conns if x[0] == n) for n in {x[0] for x in conns}}
    assert len({r.lane for r in rows}) == len({distances(run) for run in by_run.values()}) < len(by_run) / 4
    for group in shapes.values():
        group.sort(key=lambda r: (r.dep, r.run_id))
        assert [r.since for r in group] == [None, *[r.dep for r in group[:-1]]]
        assert [r.arr for r in group] == sorted(r.arr for r in group)


def test_a_label_boards_one_run_of_a_lane_in_slots_of_any_length(spark):
    for gap in (60, 3600, 90_000):
        conns = [(f"r{k:03d}", 0, "A", "B", 5000 + gap * k, 5600 + gap * k, "train") for k in range(50)]
        c, s, _ = frames(spark, conns, [("A", 46.0, 7.0, 0), ("B", 46.0, 7.0, 0)], [("A", "A", 0)])
        change = s.select(F.col("stop_id").alias("stop"), F.lit(True).alias("known"), F.col("min_transfer_s").alias("change"))
        ready = [(1, "A", 0, None), (2, "A", 5000 + 7 * gap, None), (3, "A", 5001 + 7 * gap, None), (4, "A", 5001 + 49 * gap, None), (5, "A", 5000 + 3 * gap, 5000 + 5 * gap), (6, "A", 4000 + 3 * gap, 5000 + 3 * gap)]
        labels = spark.createDataFrame(ready, "request long, stop string, foot long, foot_was long").withColumns({"veh": F.lit(None).cast("long"), "veh_was": F.lit(None).cast("long")})
        got = sorted((r.request, r.run_id) for r in transit.boardings(labels, transit.departures(c), change).collect())
        want = []
        for request, _, foot, was in ready:
            at = [x for x in conns if x[4] >= foot]
            want += [(request, x[0]) for x in at[:1] if was is None or x[4] < was]
        assert got == want and (5, "r003") in got and (4, "r049") not in got
        rows = transit.departures(c)[0].count()
        assert rows <= 50 + transit.SLOTS + 50
    empty = transit.departures(c.where("false"))
    assert empty[0].count() == 0 and transit.boardings(labels, empty, change).count() == 0
