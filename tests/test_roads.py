"""Facts about a crossroads, the trackers and the sources."""

import math

import pytest
from pyspark.sql import functions as F

from tarmac.operators import mapmatch as mm
from tarmac.operators import roadgraph as rg
from tarmac.sources import catalog, ingest, maps

#: The crossroads whose facts must hold.
NODES = {1: (51.5000, -2.5000), 2: (51.5010, -2.5000), 3: (51.4990, -2.5000), 4: (51.5000, -2.4986), 5: (51.5000, -2.5014)}


@pytest.fixture(scope="module")
def graph(spark):
    g = maps.RoadGraph.build(*maps.from_ways(spark, NODES, [([3, 1, 2], False), ([5, 1, 4], False)]))
    return maps.RoadGraph(*(spark.createDataFrame(t.collect(), t.schema) for t in (g.edges, g.segments, g.directed)))


@pytest.fixture(scope="module")
def roads(graph):
    return mm.Roads.of(graph.directed.toPandas())


def direction(graph, a, b):
    return graph.directed.filter((F.col("d_from") == a) & (F.col("d_to") == b)).first().d


def test_crossroads(graph):
    rows = graph.directed.collect()
    assert graph.edges.count() == 4 and len(rows) == 8 and all(r.passable for r in rows)
    assert graph.directed.filter("d_from = 3 and d_to = 1").first().length == pytest.approx(111.2, rel=0.02)


def test_turns_lead_to_the_right_arms(graph, roads):
    come = direction(graph, 3, 1)
    ends = {r.d: r.d_to for r in graph.directed.collect()}
    for turn, node in ((0, 2), (90, 4), (-90, 5)):
        assert ends[roads.branches(come, math.radians(turn), mm.Settings())[0][0]] == node
    assert all(n >> 1 != come >> 1 for n, _ in roads.branches(come, math.pi, mm.Settings()))


def test_advance_crosses_one_junction(graph, roads):
    come, east = direction(graph, 3, 1), direction(graph, 1, 4)
    [(d, offset, _)] = roads.advance(come, 0.0, roads.length[come] + 40, lambda _: math.radians(90), mm.Settings(), fork=False)
    assert d == east and offset == pytest.approx(40)
    [(d, offset, _)] = roads.advance(east, 0.0, 1e6, lambda _: 0.0, mm.Settings(hops=3), fork=False)
    assert offset >= 0


def test_one_way_is_impassable_backwards(spark):
    g = maps.RoadGraph.build(*maps.from_ways(spark, NODES, [([1, 2], True)]))
    assert {r.reverse: r.passable for r in g.directed.collect()} == {False: True, True: False}


def test_snap_takes_the_direction_of_travel(spark, graph):
    points = spark.createDataFrame([(1, 51.4995, -2.50001, 0.0), (2, 51.4995, -2.50001, math.pi), (3, 40.0, 0.0, 0.0)], "id long, lat double, lon double, heading double")
    got = {r.id: r.d for r in rg.snapped(points, graph.segments, graph.directed, 50.0).collect()}
    assert got == {1: direction(graph, 3, 1), 2: direction(graph, 1, 3)}


def test_position_and_chords_agree(spark, graph):
    come = direction(graph, 3, 1)
    pts = spark.createDataFrame([(k, come, 10.0 * k) for k in range(8)], "id long, d long, offset double")
    at = rg.position_at(pts, graph.directed, graph.segments).withColumn("o", F.lit(1))
    steps = rg.chords(at, ["o"], "id", "lat", "lon").collect()
    assert len(steps) == 7 and all(abs(r.distance - 10) < 0.05 and abs(r.heading) < 1e-6 for r in steps)


def test_likelihoods():
    s = mm.Settings()
    assert mm.emission(0.2, 0.2, s) == 0 and mm.emission(3.0, 0.0, s) == mm.FLOOR
    assert mm.transition(10, 10, 3, s) == 0 > mm.transition(16, 10, 3, s) > mm.transition(16, 10, 2, s)
    assert mm.transition(12, 10, 0.01, s) == mm.transition(12, 10, 1.5, s)
    assert mm.class_prior("service", 10, s) == 0 > mm.class_prior("service", 30, s) and mm.class_prior("", 99, s) == 0


def test_viterbi_can_change_its_mind(graph, roads):
    """A turn measured a second late still picks the right arm."""
    come = direction(graph, 3, 1)
    length = roads.length[come]
    path = mm.viterbi(roads, [(come, length - 5, 0.0)], [10.0, 10.0], [math.radians(80), 0.0], [3.0, 3.0], mm.Settings())
    assert len(path) == 3 and path[-1][0] == direction(graph, 1, 4)
    greedy = mm.greedy(roads, (come, 0.0), [10.0] * 3, [0.0] * 3, mm.Settings())
    assert greedy[-1] == (come, 30.0)
    hyps = mm.beam(roads, [(come, 0.0, 0.0)], [length + 5], [0.0], mm.Settings())
    assert hyps[-1][0] == direction(graph, 1, 2)


def test_schedule(spark):
    p = [r[0] for r in spark.range(10).orderBy("id").select(mm.teacher_forcing(F.col("id").cast("double"), 10)).collect()]
    assert p[-1] == 0 and p == sorted(p, reverse=True)
    best, loss = mm.coordinate_descent(lambda sets: [(s["a"] - 3) ** 2 + (s["b"] - 0.5) ** 2 for s in sets], {"a": 1.0, "b": 1.0})
    assert loss < 2 and abs(best["a"] - 3) < 2


def test_opl(spark, tmp_path):
    lines = [
        "n1 v1 x-2.5 y51.5", "n2 v1 T x-2.4 y51.6", "n3 v1", "w10 v1 Thighway=primary,oneway=yes Nn1,n2", "w11 v1 Thighway=footway Nn1,n2", "w12 v1 Thighway=residential,oneway=-1 Nn1,n2", "w13 v1 Thighway=residential,access=private Nn1,n2",
        "w14 v1 Tjunction=roundabout,highway=tertiary Nn2,n1,n2", "w15 v1 Thighway=primary Nn1", "r9 v1",
    ]
    (tmp_path / "map.opl").write_text("\n".join(lines))
    nodes, ways = maps.read_opl(spark, str(tmp_path / "map.opl"))
    assert {r.node: (r.lat, r.lon) for r in nodes.collect()} == {1: (51.5, -2.5), 2: (51.6, -2.4)}
    assert {r.way: (list(r.refs), r.oneway) for r in ways.collect()} == {10: ([1, 2], True), 12: ([2, 1], True), 14: ([2, 1, 2], True)}


def test_graph_is_stored_once(spark, graph, tmp_path):
    path, calls = str(tmp_path / "g"), []
    for _ in range(2):
        got = maps.RoadGraph.open(spark, path, lambda: calls.append(1) or graph)
    assert len(calls) == 1 and got.directed.count() == 8


def test_regions(spark):
    ring = lambda x: [[[[x, 0.0], [x + 1, 0.0], [x + 1, 1.0]]]]
    rows = [("w", None, ring(0.0)), ("a", "w", ring(0.0)), ("b", "w", ring(5.0)), ("c", "b", ring(5.0)), ("d", "b", ring(9.0)), ("z", None, ring(5.0))]
    df = spark.createDataFrame(rows, "id string, parent string, coordinates array<array<array<array<double>>>>")
    assert {r.id for r in maps.select_regions(df, "w", (0.2, 4.0, 0.8, 6.5)).collect()} == {"c"}


def test_csv_variants(spark, tmp_path):
    base = tmp_path / "Synchronised" / "Categorised"
    base.mkdir(parents=True)
    (base / "S-M1.csv").write_bytes("GPS LATITUDE (°), GPS LONGITUDE,GPS SPEED (Kmh),TIME SINCE START (ms),ACCELEROMETER X , ACCELEROMETER Y,ACCELEROMETER Z\n51.5,-2.5,3.5,0,1,2,3\n51.6,x,NaN,100,1,2,3\n".encode("latin-1"))
    (base / "S-M2.csv").write_bytes("LATITUDE,LONGITUDE,TIME SINCE START (ms),GYROSCOPE Yaw,\n51.5,-2.5,500,0.1,\n".encode("latin-1"))
    (base / "V-M1.csv").write_bytes("Time Since Start of Day (s),Latitude,Longitude,Velocity (km/hr),Wheel Speed FL\n7,51.5,-2.5,36,4\n".encode("latin-1"))
    found = catalog.discover(catalog.list_files(spark, str(tmp_path)))
    rows = {(r.family, r.session, r.time_s): r for r in ingest.load(spark, found).collect()}
    assert rows["S", "M1", 0.0].speed_ms == 3.5 and rows["S", "M1", 0.0].acc_x == 1.0
    assert rows["S", "M1", 0.1].lon is None and rows["S", "M1", 0.1].speed_ms is None and rows["S", "M2", 0.5].gyr_yaw == pytest.approx(0.1)
    assert rows["V", "M1", 7.0].speed_ms == pytest.approx(10.0) and rows["V", "M1", 7.0].wheel_fl == 4.0
    assert ingest.schema_hash(["b ", "A  x"]) == ingest.schema_hash(["a x", "B"])


def test_names_resolve_to_one_session(spark):
    df = spark.createDataFrame([("S", "Vw12"), ("V", "Vw12"), ("S", "M1")], "family string, session string")
    assert catalog.resolve(df, "S-vw12.csv").first().family == "S" and catalog.resolve(df, "m1").count() == 1
    for name in ("Vw12", "nope"):
        with pytest.raises(LookupError):
            catalog.resolve(df, name)


def test_a_session_without_role_is_an_error(spark):
    none = spark.createDataFrame([], "session string, reason string")
    df = spark.createDataFrame([("S", "Q1")], "family string, session string")
    with pytest.raises(Exception, match="no role"):
        catalog.with_roles(df, ["M"], none, [], [], [], [], ["M"]).collect()


def test_rematching_without_roads_in_reach_keeps_the_greedy_track(spark):
    from tarmac.operators import predictors
    from tarmac.plans import graph

    steps, starts, parts = graph.drives(spark, "/root/testdata/sf0.001")
    steps, starts = steps.filter("outage < 3 and k <= 25"), starts.filter("outage < 3")
    g = graph.crossroads(spark)
    want = {(r.outage, r.k): (r.d, round(r.offset, 6)) for r in mm.track(steps, starts, parts, "greedy").collect()}
    got = {(r.outage, r.k): (r.d, round(r.offset, 6)) for r in predictors.rematched_track(steps, starts, parts, g.segments, g.directed, 25, 1e-9).collect()}
    assert got == want


def test_rematching_snaps_to_the_one_road_in_reach(spark):
    """Far from any junction the match is not contested: the position comes back as it was."""
    from tarmac.operators import predictors
    from tarmac.plans import graph

    g = graph.crossroads(spark)
    steps = spark.createDataFrame([(1, k, 2.0, 0.0, 3.0) for k in range(1, 13)], "outage long, k long, distance double, turn double, sigma double")
    starts = spark.createDataFrame([(1, 0, 20.0, 0.0)], "outage long, d long, offset double, weight double")
    parts = mm.reachable(spark.createDataFrame([(1, 51.5, -2.5, 500.0)], "outage long, lat double, lon double, reach double"), g.directed, g.segments)
    got = [(r.k, r.d, r.offset) for r in predictors.rematched_track(steps, starts, parts, g.segments, g.directed, 12, 5.0, every=5).orderBy("k").collect()]
    assert [k for k, *_ in got] == list(range(13)) and {d for _, d, _ in got} == {0}
    assert max(abs(o - (20 + 2 * k)) for k, _, o in got) < 0.01


def test_models_are_stored_as_json(spark, tmp_path):
    from tarmac.sources import models

    model = {"knots_x": [0.5, 2.0], "knots_y": [0.0, 1.25], "name": "é"}
    models.save(spark, {"old": 1}, f"{tmp_path}/m")
    models.save(spark, model, f"{tmp_path}/m")
    assert models.load(spark, f"{tmp_path}/m") == model


def test_leaving_one_session_out():
    best = {"a": 2.0, "b": 4.0, "c": 4.0}
    objective = lambda sets, groups: [sum((p["x"] - best[g]) ** 2 for g in groups) for p in sets]
    out = mm.leave_one_out(objective, ["a", "b", "c"], {"x": 1.0}, step=2.0, rungs=2)
    assert [(g, p["x"], loss) for g, p, loss in out] == [("a", 4.0, 4.0), ("b", 2.0, 4.0), ("c", 2.0, 4.0)]


def test_losses_of_settings(spark):
    """The settings that made the truth lose nothing; a tracker that takes no turn does."""
    from tarmac.plans import graph

    steps, starts, parts = graph.drives(spark, "/root/testdata/sf0.001")
    steps, starts = steps.filter("outage < 3 and k <= 30").withColumn("turn", F.lit(1.5)), starts.filter("outage < 3")
    g = graph.crossroads(spark)
    path = mm.track(steps, starts, parts, "greedy").withColumn("id", F.struct("outage", "k"))
    true = rg.position_at(path.select("id", "d", "offset"), g.directed, g.segments).select("id.outage", "id.k", "lat", "lon")
    losses = mm.settings_losses([mm.Settings(), mm.Settings(max_turn_mismatch=1e-9)], steps, starts, parts, true, g.directed, g.segments)
    assert losses[0] < 1e-6 < 1 < losses[1]
