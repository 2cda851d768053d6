"""Facts of the operators on small inputs."""

import heapq
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridlark.functions import geo, scalar, timefn
from gridlark.operators import constraints, graph, ml, ranking, spatial, timeseries
from gridlark.sources import files
from gridlark.streaming import occupancy


def edges(spark, rows):
    return spark.createDataFrame([(u, v, float(w)) for u, v, w in rows], "u string, v string, w double")


def dijkstra(rows, start):
    out = {}
    heap = [(0.0, start)]
    near = {}
    for u, v, w in rows:
        near.setdefault(u, []).append((v, w))
    while heap:
        d, u = heapq.heappop(heap)
        if u in out:
            continue
        out[u] = d
        for v, w in near.get(u, []):
            if v not in out:
                heapq.heappush(heap, (d + w, v))
    return out


def test_shortest_paths(spark):
    e = edges(spark, [("A", "C", 1), ("A", "B", 10), ("C", "D", 1), ("B", "D", 1)])
    tree = graph.shortest(e, graph.source_rows(spark, ["A"]))
    got = {r.id: r.cost for r in tree.collect()}
    assert got["D"] == 2.0
    assert [r.node for r in graph.routes_to(tree).filter("id = 'D'").orderBy("pos").collect()] == ["A", "C", "D"]
    assert set(got) == {"A", "B", "C", "D"}
    chain = edges(spark, [("A", "B", 1), ("B", "C", 1)])
    assert [r.id for r in graph.shortest(chain, graph.source_rows(spark, ["C"])).collect()] == ["C"]


def test_hops(spark):
    e = edges(spark, [("A", "B", 5), ("A", "C", 1), ("B", "D", 1), ("C", "D", 1)])
    got = {r.id: r.hops for r in graph.hops(e, graph.source_rows(spark, ["A"])).collect()}
    assert got == {"A": 0, "B": 1, "C": 1, "D": 2}


def test_random_graph_and_hierarchy(spark):
    rnd = random.Random(5)
    rows = [(u, v, float(rnd.randint(1, 30))) for u in range(14) for v in rnd.sample(range(14), 3) if u != v]
    e = spark.createDataFrame(rows, "u long, v long, w double")
    want = dijkstra(rows, 0)
    got = {r.id: r.cost for r in graph.shortest(e, graph.source_rows(spark, [0])).collect()}
    assert got == want
    nodes = spark.range(14)
    ranks, ch = graph.contract(e, nodes)
    pairs = nodes.filter("id > 0").select(F.lit(0).cast("long").alias("start"), F.col("id").alias("goal"))
    assert {r.goal: r.cost for r in graph.hierarchy_cost(ranks, ch, pairs).collect() if r.cost is not None} == {k: v for k, v in want.items() if k}
    ways = {}
    for r in graph.hierarchy_routes(ranks, ch, pairs).orderBy("goal", "pos").collect():
        ways.setdefault(r.goal, []).append((r.u, r.v))
    least = {}
    for u, v, w in rows:
        least[u, v] = min(w, least.get((u, v), w))
    assert set(ways) == {k for k in want if k}
    for goal, way in ways.items():
        assert way[0][0] == 0 and way[-1][1] == goal and all(a[1] == b[0] for a, b in zip(way, way[1:], strict=False)) and sum(least[x] for x in way) == want[goal]


def test_unpack(spark):
    ch = spark.createDataFrame([("A", "C", "B"), ("A", "B", None), ("B", "C", None)], "u string, v string, via string")
    p = spark.createDataFrame([(1, 0, "A"), (1, 1, "C")], "k int, pos int, node string")
    assert [(r.u, r.v) for r in graph.unpack(p, ch, ["k"]).orderBy("pos").collect()] == [("A", "B"), ("B", "C")]


def test_parallel_edges(spark):
    e = spark.createDataFrame([("A", "B", 0, None, 10.0), ("A", "B", 1, 60.0, 20.0)], "u string, v string, key int, seconds double, length_m double")
    assert graph.best_parallel(e).first().key == 1
    p = spark.createDataFrame([(1, 0, "A"), (1, 1, "B"), (1, 2, "Z")], "k int, pos int, node string")
    m = graph.path_metrics(p, graph.best_parallel(e), ["k"]).first()
    assert (m.distance_km, m.drive_min) == (0.02, 1.0)


def test_ranking_facts(spark):
    rows = [(1, 8.0, 6.0, 0.9, 0.8, 8 / 30 + 0.9), (2, 12.0, 4.0, 0.1, 0.7, 12 / 30 + 0.1)]
    df = spark.createDataFrame(rows, "station_id long, drive_min double, distance_km double, occupancy double, arrival_soc double, score double")
    got = ranking.order_map(df, 5).first().ranking_orders
    assert got == {"balanced": [2, 1], "drive_time": [1, 2], "distance": [2, 1], "occupancy": [2, 1], "arrival_soc": [1, 2]}
    with pytest.raises(ValueError):
        ranking.order_of("price")


def test_post_constraints(spark):
    lim = constraints.Limits(current_soc=0.2, battery_capacity_kwh=10.0, consumption_kwh_per_km=0.1, min_arrival_soc=0.1)
    rows = [(True, 5.0, 5.0), (False, None, None), (True, None, 5.0), (True, 5.0, 31.0), (True, 21.0, 5.0), (True, 11.0, 5.0)]
    df = spark.createDataFrame(rows, "path_found boolean, distance_km double, drive_min double")
    got = [(r.reject_reason, r.arrival_soc and round(r.arrival_soc, 6)) for r in constraints.post_check(df, lim).collect()]
    assert got == [(None, 0.15), ("path_not_found", None), ("missing_route_metrics", None), ("drive_time_exceeds_limit", None), ("insufficient_energy", None), ("arrival_soc_below_safety_threshold", 0.09)]


def test_clock_and_score(spark):
    df = spark.createDataFrame([(datetime(2026, 5, 24, 14, 37, 12),)], "t timestamp_ntz")
    assert df.select(timefn.replay_clock(F.col("t"))).first()[0] == datetime(2023, 2, 12, 14, 35)
    assert df.select(timefn.add_minutes(F.col("t"), F.lit(1.5))).first()[0] == datetime(2026, 5, 24, 14, 38, 42)
    assert spark.range(1).select(scalar.balanced_score(F.lit(15.0), 30.0, F.lit(0.25))).first()[0] == 0.75
    assert timeseries.parse_horizons("5, 30") == [5, 30]
    with pytest.raises(ValueError):
        timeseries.parse_horizons("7")


def test_polygon_with_hole(spark):
    square, hole = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]
    df = spark.createDataFrame([(0.5, 0.5), (2.0, 2.0), (4.0, 2.0), (5.0, 2.0), (1.0, 2.0), (0.0, 0.0)], "x double, y double")
    got = [r[0] for r in df.select(geo.covers(F.col("x"), F.col("y"), [[square, hole]])).collect()]
    assert got == [True, False, True, False, True, True]


def test_knn_small(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 0.0, 30.0)], "station_id long, lon double, lat double")
    got = {(r.station_id, r["rank"]): r.neighbor_id for r in spatial.knn(s, 2).collect()}
    assert got == {(1, 1): 2, (1, 2): 3, (2, 1): 1, (2, 2): 3, (3, 1): 2, (3, 2): 1}


def test_sources(spark, tmp_path):
    head = "time,busy,idle,s_price,e_price,duration\n"
    (tmp_path / "7.csv").write_text(head + "2023-01-01 00:00:00,1,1,0.5,0.6,x\n")
    (tmp_path / "10.csv").write_text(head + "2023-01-01 00:00:00,0,0,0.5,0.6,3\n")
    (tmp_path / "notes.csv").write_text(head)
    h = files.station_history(spark, str(tmp_path))
    assert sorted(r.station_id for r in h.collect()) == [7, 10]
    assert [r.station_id for r in files.station_history(spark, str(tmp_path), 1).collect()] == [10]
    geo_file = tmp_path / "b.geojson"
    geo_file.write_text('{"type":"FeatureCollection","features":[{"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]]]}}]}')
    rings = files.read_geojson(spark, str(geo_file))
    assert rings.count() == 1 and "MultiPolygon" in files.to_geojson(rings).first().value
    with pytest.raises(ValueError):
        files.require_columns(rings, ["nope"])


def test_graphml(spark, tmp_path):
    p = tmp_path / "g.graphml"
    p.write_text(
        '<graphml><key id="d0" for="node" attr.name="x"/><key id="d1" for="edge" attr.name="length"/><graph>'
        '<node id="a"><data key="d0">1.5</data></node><node id="b"><data key="d0">2.5</data></node>'
        '<edge source="a" target="b" id="0"><data key="d1">10</data></edge></graph></graphml>'
    )
    nodes, e = files.read_graphml(spark, str(p))
    assert {r.id: r.data["x"] for r in nodes.collect()} == {"a": "1.5", "b": "2.5"}
    assert e.first().data["length"] == "10"
    nodes, e = files.road_graph(spark, str(p))
    assert sorted((r.id, r.x, r.y, r.station_id) for r in nodes.collect()) == [("a", 1.5, None, None), ("b", 2.5, None, None)]
    assert e.first()[:] == ("a", "b", 0, None, 10.0, None, None, False, None)
    p.write_text(
        '<graphml><key id="d0" for="edge" attr.name="geometry"/><key id="d1" for="edge" attr.name="travel_time"/><key id="d2" for="edge" attr.name="station_split"/><graph>'
        '<edge source="a" target="b" id="1"><data key="d0">LINESTRING (1 2, 3.5 4)</data><data key="d1">soon</data><data key="d2">True</data></edge></graph></graphml>'
    )
    r = files.road_graph(spark, str(p))[1].first()
    assert (r.key, r.seconds, r.station_split, [tuple(x) for x in r.line]) == (1, None, True, [(1.0, 2.0), (3.5, 4.0)])


def test_search_helpers():
    grid = {"trees": [2, 3, 4], "depth": [2, 3]}
    assert len(ml.sample_params(grid, 10)) == 6
    assert ml.near_params(grid, {"trees": 2, "depth": 3}) == {"trees": [2, 3], "depth": [2, 3]}


def test_stream_matches_batch(spark, tmp_path):
    from gridlark.sources import scenario

    obs = scenario.observation(spark, "/root/testdata/sf0.001").withColumn("time", F.col("time").cast("timestamp"))
    obs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(obs.schema).parquet(str(tmp_path / "in"))
    q = occupancy.slot_means(stream, 60, "60 days").writeStream.outputMode("complete").format("memory").queryName("slots").start()
    q.processAllAvailable()
    q.stop()
    batch = occupancy.slot_means(obs, 60)
    rows = lambda df: sorted((r.station_id, r.slot, r.n, round(r.mean_occ, 9)) for r in df.collect())
    assert rows(spark.table("slots")) == rows(batch) and batch.count() > 0


def test_stream_of_last_rows(spark, tmp_path):
    """Keyed state equals the batch form, with late and repeated rows, and after a restart from its checkpoint."""
    from gridlark.sources import scenario

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    obs = scenario.observation(spark, "/root/testdata/sf0.001").select("station_id", F.col("time").cast("timestamp").alias("time"), "obs_id", "busy", "idle", "s_price", "e_price").filter("station_id < 60")
    late = F.pmod(F.xxhash64("obs_id"), F.lit(3))  # rows come in an order of their own
    parts = [obs.filter(late == i) for i in range(3)] + [obs.filter("obs_id % 5 = 0")]
    weather = scenario.weather(spark, "/root/testdata/sf0.001").filter("hour(weather_hour) % 3 = 0")
    got = {}

    def keep(batch, _):
        got.update({r.station_id: r for r in batch.collect()})

    for part in parts:  # each run ends when its files are done; the next one starts from the checkpoint
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = occupancy.with_weather(occupancy.serving_states(stream), weather).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        q.awaitTermination()
    rows = obs.filter("busy + idle > 0").withColumns({"occ": F.col("busy") / (F.col("busy") + F.col("idle")), "time": F.col("time").cast("timestamp_ntz")})
    want = {r.station_id: r for r in timeseries.serve_state(rows, F.lit("2030-01-01").cast("timestamp_ntz")).collect()}
    full = {k: r for k, r in got.items() if r.n == 12}
    assert set(full) == set(want) and len(got) == obs.filter("busy + idle > 0").select("station_id").distinct().count()
    for k, r in want.items():
        assert [full[k][c] for c in ("s_price", "e_price", "lag_1", "lag_3", "lag_6", "lag_12", "mean_6", "mean_12", "std_12", "trend_12")] == pytest.approx([r[c] for c in ("s_price", "e_price", "lag_1", "lag_3", "lag_6", "lag_12", "mean_6", "mean_12", "std_12", "trend_12")])
    hours = sorted((w.weather_hour, w.temperature) for w in weather.collect())
    for r in got.values():
        before = [t for h, t in hours if h <= r.time]
        if before and r.time < hours[-1][0]:
            assert r.temperature == pytest.approx(before[-1])


def test_substring(spark):
    from gridlark.operators import linear

    p = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 2.0, 0.0), (1, 2, 2.0, 2.0)], "edge int, pos int, x double, y double")
    cut = lambda a, b: [(r.x, r.y) for r in linear.substring(p, a, b).orderBy("pos").collect()]
    assert cut(0.25, 0.75) == [(1.0, 0.0), (2.0, 0.0), (2.0, 1.0)]
    assert cut(0.75, 0.25) == [(2.0, 1.0), (2.0, 0.0), (1.0, 0.0)]
    assert cut(0.0, 1.0) == [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0)]


def test_hull_and_start(spark):
    from gridlark.operators import linear

    p = spark.createDataFrame([("a", float(x), float(y)) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (1, 0))], "g string, x double, y double")
    assert [(r.x, r.y) for r in linear.convex_hull(p, "g").orderBy("pos").collect()] == [(0, 0), (2, 0), (2, 2), (0, 2)]
    e = spark.createDataFrame([("B", "C", 60.0, 1000.0), ("C", "B", 60.0, 1000.0), ("C", "D", 60.0, 1000.0)], "u string, v string, seconds double, length_m double")
    s = linear.start_edges(e, "B", "C", 0.75)
    assert {r.v: r.seconds for r in s.collect()} == {"C": 15.0, "B": 45.0}
    whole = linear.overlay(e, s).withColumn("w", F.col("seconds") / 60)
    got = {r.id: r.cost for r in graph.shortest(whole, graph.source_rows(spark, ["__start_access__"])).collect()}
    assert got["D"] == 1.25
    ev = spark.createDataFrame([("s", 1, ["B"]), ("s", 2, ["B"]), ("s", 3, ["C"])], "source string, step int, nodes array<string>")
    assert linear.without_repeats(ev, "nodes", "source", "step").count() == 2
    items = spark.createDataFrame([(1,), (2,), (3,)], "id2 int")
    order = spark.createDataFrame([(0, 3), (1, 1)], "pos int, id int")
    assert [r.id2 for r in linear.in_order(items, order, "id2").orderBy("rank").collect()] == [3, 1, 2]


def test_searches_on_random_graphs(spark):
    """Goal-directed, two-sided and bounded searches and hierarchies against Dijkstra's algorithm."""
    from gridlark.operators import linear

    rnd = random.Random(9)
    rows = [(u, v, float(rnd.randint(1, 30))) for u in range(16) for v in rnd.sample(range(16), 2) if u != v]
    e = spark.createDataFrame(rows, "u long, v long, w double")
    want = dijkstra(rows, 0)
    steps = dijkstra([(u, v, 1.0) for u, v, _ in rows], 0)
    nodes = spark.range(18).withColumns({"x": F.col("id").cast("double"), "y": F.lit(0.0)})  # two of them alone
    table = graph.landmark_table(e, [0, 5])
    for goal in (3, 11, 17):
        g = spark.createDataFrame([(goal,)], "id long")
        bounds = graph.landmark_bound(table, g).select("id", "bound")
        hit = graph.goal_directed(e, spark.createDataFrame([(0,)], "id long"), g, bounds).collect()
        assert [r.cost for r in hit] == ([want[goal]] if goal in want else [])
        n, middle = linear.bidirectional_hops(e, 0, goal)
        assert n == (int(steps[goal]) if goal in steps else None) and (middle is None) == (goal not in steps)
    costs = graph.shortest(e, graph.source_rows(spark, [0]), limit=25.0)
    assert {r.id: r.cost for r in costs.collect()} == {k: v for k, v in want.items() if v <= 25}
    far = max(want, key=want.get)
    full = graph.shortest(e.withColumn("one", F.lit(1.0)), graph.source_rows(spark, [0]), sums=["one"])
    every = {}
    for r in graph.routes_to(full).orderBy("pos").collect():
        every.setdefault(r.id, []).append(r.node)
    path = every[far]
    assert set(every) == set(want)
    least = {}
    for u, v, w in rows:
        least[u, v] = min(w, least.get((u, v), w))
    for goal, p in every.items():
        assert p[0] == 0 and p[-1] == goal and sum(least[x] for x in zip(p, p[1:], strict=False)) == want[goal]
    one = graph.routes_to(full, spark.createDataFrame([(0, far)], "source long, id long")).orderBy("pos")
    assert [r.node for r in one.collect()] == path
    for width in (1.0, 7.0, 1e9):
        assert {r.id: r.cost for r in graph.shortest(e, graph.source_rows(spark, [0]), width=width, rounds_per_table=2).collect()} == want
    near = [x for x in want if want[x] < 20]
    some = {r.id: r.cost for r in graph.shortest(e, graph.source_rows(spark, [0]), goals=spark.createDataFrame([(x,) for x in near], "id long"), width=5.0, rounds_per_table=1).collect()}
    assert {x: some[x] for x in near} == {x: want[x] for x in near}
    assert {r.id: r.one for r in full.collect()}[far] == len(path) - 1
    ranks, ch = graph.contract(e, nodes.select("id"))
    pairs = nodes.filter("id > 0").select(F.lit(0).cast("long").alias("start"), F.col("id").alias("goal"))
    assert {r.goal: r.cost for r in graph.hierarchy_cost(ranks, ch, pairs).collect() if r.cost is not None} == {k: v for k, v in want.items() if k}


def test_witnesses_save_shortcuts(spark):
    """A triangle: the way past the middle node is longer than the direct one, so no shortcut is needed."""
    live = spark.createDataFrame([(0, 1, 5.0, None), (1, 2, 5.0, None), (0, 2, 3.0, None)], "u long, v long, w double, via long")
    short = spark.createDataFrame([(0, 2, 10.0, 1)], "u long, v long, w double, via long")
    gone = spark.createDataFrame([(1,)], "id long")
    assert graph.witnessed(short, live, gone).isEmpty()
    assert graph.witnessed(short, live.filter("v <> 2 OR u <> 0"), gone).count() == 1


def test_start_on_cut_street(spark):
    """A start between two stations of one street reaches both along it, in both directions."""
    from gridlark.operators import linear

    e = spark.createDataFrame([(1, 2, 100.0, 1000.0), (2, 1, 200.0, 1000.0)], "u long, v long, seconds double, length_m double")
    places = spark.createDataFrame([(7, 1, 2, 0.2), (8, 2, 1, 0.2), (9, 1, 2, 1.0), (10, 1, 2, 0.2)], "station_id long, u long, v long, t double")
    names = {r.station_id: r.node for r in linear.access_nodes(places).collect()}
    assert names == {7: "access_7", 8: "access_8", 9: "2", 10: "access_7"}
    pieces = linear.split_edges(e, places)
    base = pieces.select(F.col("from_node").alias("u"), F.col("to_node").alias("v"), "seconds", "length_m")
    for at, want in ((0.5, {"access_7": 60.0, "access_8": 30.0, "1": 100.0, "2": 50.0}), (0.0, {"1": 0.0, "access_7": 20.0, "2": 100.0}), (1.0, {"2": 0.0, "access_8": 40.0, "1": 200.0})):
        g = base.unionByName(linear.start_on_pieces(pieces, 1, 2, at)).withColumn("w", F.col("seconds"))
        got = {r.id: round(r.cost, 6) for r in graph.shortest(g, graph.source_rows(spark, ["__start_access__"])).collect()}
        assert {k: got[k] for k in want} == want


def test_service_refuses(spark):
    from gridlark.operators.recommend import service
    from gridlark.plans import roads

    with pytest.raises(ValueError, match="service area"):
        service(*[spark.range(0)] * 3, [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]]], 5.0, 5.0, roads.NOW, *[spark.range(0)] * 2, [], roads.LIMITS)


def test_files_written_and_read(spark, tmp_path):
    nodes = spark.createDataFrame([("a", {"x": "1.5", "name": "<A> & 'co'"}), ("b", {"x": "2"})], "id string, data map<string,string>")
    e = spark.createDataFrame([("a", "b", 0, {"length": "10"}), ("a", "b", 1, {"length": "11"})], "u string, v string, key int, data map<string,string>")
    files.write_graphml(nodes, e, str(tmp_path / "g"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*")))
    (tmp_path / "g.graphml").write_text(text)
    n2, e2 = files.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert {r.id: r.data for r in n2.collect()} == {"a": {"x": "1.5", "name": "<A> & 'co'"}, "b": {"x": "2"}}
    assert sorted((r.u, r.v, r.key, r.data["length"]) for r in e2.collect()) == [("a", "b", 0, "10"), ("a", "b", 1, "11")]
    files.write_metadata(spark, {"features": ["a", "ü"], "best_params": {"trees": 3.0, "rate": 1}}, str(tmp_path / "m"))
    from gridlark.operators.relational import has_columns, typed_params

    meta = files.read_metadata(spark, str(tmp_path / "m"))
    assert meta["features"] == ["a", "ü"] and typed_params(meta, ["trees"], ["rate"]) == {"trees": 3, "rate": 1.0}
    built = []
    build = lambda: built.append(1) or spark.range(3)
    assert files.built_once(spark, str(tmp_path / "f"), build).count() == 3 and files.built_once(spark, str(tmp_path / "f"), build).count() == 3 and len(built) == 1
    files.built_once(spark, str(tmp_path / "f"), build, rebuild=True)
    assert len(built) == 2 and has_columns(nodes, ["id"]) and not has_columns(nodes, ["id", "nope"])
    log = files.Progress(spark, str(tmp_path / "p"), "trial int, mae double")
    log.add([{"trial": 1, "mae": 0.5}])
    files.Progress(spark, str(tmp_path / "p"), "trial int, mae double").add([{"trial": 2, "mae": 0.25}])
    assert sorted(r["trial"] for r in log.rows()) == [1, 2]
    (tmp_path / "dim.csv").write_text("station_id,lon\n1,2.5\n")
    assert files.dimension(spark, str(tmp_path / "dim.csv"), "station_id long, lon double", ["lon"]).first().lon == 2.5
    got = {r.name: r.present for r in files.audit(spark, str(tmp_path / "f"), ["_SUCCESS", "absent"]).collect()}
    assert not got["absent"]
    files.write_csv(spark.range(4).withColumn("g", F.col("id") % 2), str(tmp_path / "csv"), "g", packed=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 4 and list((tmp_path / "csv" / "g=1").glob("*.csv.gz"))
    files.write_csv(spark.range(4), str(tmp_path / "plain"), files=1)
    files.write_csv(spark.range(3), str(tmp_path / "plain"), files=1, append=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "plain")).count() == 7 and len(list((tmp_path / "plain").glob("*.csv"))) == 2
    files.write_csv(spark.range(2), str(tmp_path / "plain"))
    assert spark.read.option("header", True).csv(str(tmp_path / "plain")).count() == 2


def test_times_that_are_none(spark):
    from gridlark.operators.relational import parse_time

    d = spark.createDataFrame([("2024-01-02 03:04:05",), (None,)], "t string")
    assert [r.t for r in d.select(parse_time(F.col("t")).alias("t")).collect()] == [datetime(2024, 1, 2, 3, 4, 5), None]
    with pytest.raises(Exception, match="not a timestamp"):
        spark.createDataFrame([("soon",)], "t string").select(parse_time(F.col("t"))).collect()


def test_horizon_cap(spark):
    rows = [(i % 7, datetime(2024, 1, 1 + i % 20, i % 24), i, float(i)) for i in range(400)]
    d = spark.createDataFrame(rows, "station_id long, time timestamp_ntz, obs_id long, target_5 double").withColumn("target_10", F.col("target_5"))
    got = timeseries.horizon_explode(d, (5, 10), rows_per_horizon=30).groupBy("horizon_min").count().collect()
    assert sorted((r.horizon_min, r["count"]) for r in got) == [(5, 30), (10, 30)]


def test_selection_loops(spark):
    rows = [(float(i % 5), float(i % 3), float(i), (i % 5) / 5) for i in range(60)]
    d = spark.createDataFrame(rows, "a double, b double, c double, y double")
    log = ml.backward_elimination(d, d, ["a", "b", "c"], "y", trees=2, depth=2)
    assert log[0]["removed"] is None and all(x["n_features"] < 3 for x in log[1:])
    got = ml.subset_search(d, d, ["a"], ["b", "c"], 1, "y", trees=2, depth=2)
    assert [x["extra"] for x in got] == ["", "b", "c"] and got[0]["r2"] > 0.5


def test_small_columns(spark):
    from gridlark.operators import relational as B

    d = spark.createDataFrame([([1, 2, 3], [3, 4], [5, 3], '{"a": {"b": "x"}}')], "l array<int>, r array<int>, back array<int>, j string")
    r = d.select(B.joined_paths(F.col("l"), F.col("r")).alias("a"), B.joined_paths(F.col("l"), F.col("back")).alias("b"), B.json_or(F.col("j"), "$.a.b", "no").alias("c"), B.json_or(F.col("j"), "$.z", "no").alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == ([1, 2, 3, 4], [1, 2, 3, 5], "x", "no")
    assert spark.range(1).select(scalar.format_fixed(F.lit(None).cast("double")), scalar.format_percent(F.lit(0.1234))).first()[:] == ("-", "12.3%")


def test_small_scalars(spark):
    d = spark.createDataFrame([(1.0, 1.0 + 1e-12), (float("nan"), 2.0), (float("inf"), 2.0), (None, 2.0)], "a double, b double")
    got = d.select(scalar.finite(F.col("a")), scalar.is_close(F.col("a"), F.col("b")), scalar.clip(F.col("a"), 0, 0.5)).collect()
    assert [r[0] for r in got] == [1.0, None, None, None] and got[0][1] and got[3][2] is None and got[0][2] == 0.5
    assert d.select(scalar.format_fixed(F.col("a"), " km"), scalar.format_runtime(F.col("a"))).collect()[3][:] == ("-", "-")
    p = spark.createDataFrame([(114.05, 22.6), (2.0, 48.0)], "x double, y double")
    there = p.select("x", "y", *[c.alias(n) for c, n in zip(geo.wgs84_to_gcj02(F.col("x"), F.col("y")), ("gx", "gy"), strict=True)])
    back = there.select("x", "y", *[c.alias(n) for c, n in zip(geo.gcj02_to_wgs84(F.col("gx"), F.col("gy")), ("bx", "by"), strict=True)]).collect()
    assert all(abs(r.x - r.bx) < 1e-4 and abs(r.y - r.by) < 1e-4 for r in back)
    e = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "u long, v long")
    assert {r.id for r in graph.largest_component(spark.range(1, 7), e).collect()} == {1, 2, 3}


def test_weather_file(spark, tmp_path):
    (tmp_path / "w.csv").write_text("time,T,U,RAIN,P0\n2023-01-01 05:35:00,10.5,80,0.1,755\n2023-01-01 06:00:00,x,81,,755\n")
    got = [tuple(r) for r in files.weather(spark, str(tmp_path / "w.csv")).orderBy("weather_hour").collect()]
    assert got == [(datetime(2023, 1, 1, 5), 10.5, 80.0, 0.1), (datetime(2023, 1, 1, 6), None, 81.0, None)]
