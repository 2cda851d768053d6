"""Searches over blocks of nodes, and joins and windows that must not send growing tables to one place."""

import heapq
import random

from pyspark.sql import functions as F

from gridlark.functions.geo import haversine_km
from gridlark.operators import dissolve, graph, spatial, timeseries


def _least(rows, start):
    cost, heap = {}, [(0.0, start)]
    while heap:
        c, u = heapq.heappop(heap)
        if u not in cost:
            cost[u] = c
            for a, b, w in rows:
                if a == u:
                    heapq.heappush(heap, (c + w, b))
    return cost


def test_blocks_give_the_same_costs(spark):
    rng = random.Random(3)
    rows = [(u, rng.randrange(60), float(rng.randrange(0, 9))) for u in range(60) for _ in range(3)]
    e = spark.createDataFrame(rows, "u long, v long, w double").selectExpr("*", "2 * w as m")
    got = graph.shortest(e, graph.source_rows(spark, [0, 7]), sums=["m"], block=30).collect()  # six blocks
    for s in (0, 7):
        mine = {r.id: r for r in got if r.source == s}
        assert {k: r.cost for k, r in mine.items()} == _least(rows, s)
        assert all(r.m == 2 * r.cost for r in mine.values())
        for r in mine.values():  # parents lead to the source
            at, n = r, 0
            while at.parent is not None:
                at, n = mine[at.parent], n + 1
                assert n < 60
            assert at.id == s


def test_fills_read_back_in_linear_frames(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(40), i, None if rng.random() < 0.8 else float(i)) for i in range(400)] + [(41 + i, 0, None) for i in range(5)]
    out = timeseries.fill_both(spark.createDataFrame(rows, "s long, t long, x double"), ["x"], ["s", "t"], F.col("s"))
    got = [r.x for r in out.orderBy("s", "t").collect()]
    want = [x for *_, x in sorted(rows, key=lambda r: r[:2])]
    first = next(x for x in want if x is not None)
    for i, x in enumerate(want):
        want[i] = x if x is not None else want[i - 1] if i else first
    assert got == want
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()


def _watched(monkeypatch):
    """The numbers of rows that radius joins are given on both sides."""
    seen, join = [], spatial.radius_join

    def watch(a, b, *args):
        seen.append((a.count(), b.count()))
        return join(a, b, *args)

    monkeypatch.setattr(spatial, "radius_join", watch)
    return seen


def test_crowded_places_are_sought_once(spark, monkeypatch):
    seen = _watched(monkeypatch)
    rng = random.Random(7)
    places = [(114 + rng.random() / 10, 22.5 + rng.random() / 10) for _ in range(12)]
    at = {i: places[i % 12] if i < 60 else places[0] for i in range(100)}
    s = spark.createDataFrame([(i, *p) for i, p in at.items()], "station_id long, lon double, lat double")
    got = {(r.station_id, r["rank"]): r.neighbor_id for r in spatial.knn(s, 7).collect()}
    km = {(r.a, r.b): r.d for r in s.selectExpr("station_id a", "lon x", "lat y").crossJoin(s.selectExpr("station_id b", "lon", "lat")).select("a", "b", haversine_km(F.col("y"), F.col("x"), F.col("lat"), F.col("lon")).alias("d")).collect()}
    want = {(i, n + 1): j for i in at for n, j in enumerate(sorted((j for j in at if j != i), key=lambda j: (km[i, j], j))[:7])}
    assert got == want
    poi = s.selectExpr("station_id poi_id", "lon", "lat", "if(station_id % 2 = 0, 'a', 'b') kind")
    counts = {r.station_id: (r.total, r.a) for r in spatial.count_within(s, poi, 3.0, ["a"]).collect()}
    assert counts == {i: (sum(km[i, j] <= 3 for j in at), sum(km[i, j] <= 3 for j in at if j % 2 == 0)) for i in at}
    assert seen and all(a <= 12 and b <= 12 for a, b in seen)


def test_points_of_one_place_snap_once(spark, monkeypatch):
    seen, write = [], spatial.saved
    monkeypatch.setattr(spatial, "saved", lambda df, name, *a: (seen.append(df.count()), write(df, name, *a))[1])
    seg = spark.createDataFrame([(0, 1, 0.0, 0.0, 1.0, 0.0), (1, 2, 1.0, 0.0, 1.0, 1.0)], "u long, v long, ax double, ay double, bx double, by double")
    s = spark.createDataFrame([(i, 0.5 if i % 2 else 0.9, 0.2 if i % 2 else 0.6) for i in range(50)], "station_id long, lon double, lat double")
    got = {r.station_id: (r.u, round(r.d, 9)) for r in spatial.nearest_segment(s, seg).collect()}
    assert got == {i: (0, 0.2) if i % 2 else (1, 0.1) for i in range(50)}
    assert max(seen) == 2


def test_crowded_squares_dissolve(spark):
    """Level borders once made bands of a millionth of a degree: 400 million rows here."""
    rng = random.Random(11)
    corners = [(rng.randrange(40) / 8, rng.randrange(24) / 8) for _ in range(150)] + [(0.0, 0.0)] * 50
    sq = spark.createDataFrame([(i, 0, [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]) for i, (x, y) in enumerate(corners)], "polygon long, ring int, points array<struct<lon double, lat double>>")
    out = dissolve.dissolve(sq).collect()
    rings = {}
    for r in out:
        rings.setdefault(r.ring, {})[r.pos] = (r.x, r.y)
    area = sum(sum(p[i][0] * p[(i + 1) % len(p)][1] - p[(i + 1) % len(p)][0] * p[i][1] for i in range(len(p))) / 2 for p in rings.values())
    cells = {(int(x * 8) + i, int(y * 8) + j) for x, y in corners for i in range(8) for j in range(8)}
    assert abs(area - len(cells) / 64) < 1e-6


def test_hierarchy_by_blocks(spark, monkeypatch):
    """A level contracts inner nodes of several blocks; one end against many is answered by one search up and down, with sums over unpacked streets."""
    rng = random.Random(13)
    n = 12
    pairs = [(i, i + 1) for i in range(n * n) if i % n < n - 1] + [(i, i + n) for i in range(n * n - n)]
    rows = [(a, b, float(rng.randrange(1, 9))) for u, v in pairs for a, b in ((u, v), (v, u))]
    e = spark.createDataFrame(rows, "u long, v long, w double").selectExpr("*", "w as street")
    nodes = spark.createDataFrame([(i,) for i in range(n * n + 1)], "id long")
    for core in (2048, 0):  # the rest of a block by least costs between all, and by searches
        monkeypatch.setattr(graph, "CORE", core)
        ranks, ch = graph.contract(e, nodes, block=150, most=30)  # four blocks at first
        assert ranks.count() == ranks.select("id").distinct().count() == n * n + 1
        want = _least(rows, 5)
        ask = nodes.selectExpr("5L as start", "id as goal")
        assert {r.goal: r.cost for r in graph.hierarchy_cost(ranks, ch, ask).collect() if r.cost is not None} == want
        back = graph.hierarchy_cost(ranks, ch, nodes.selectExpr("id as start", "5L as goal")).collect()
        turned = _least([(v, u, w) for u, v, w in rows], 5)
        assert {r.start: r.cost for r in back if r.cost is not None} == turned
    own = graph.street_sums(ch.join(e.select("u", "v", "street"), ["u", "v"], "left"), ["street"])
    assert {r.goal: r.street for r in graph.hierarchy_cost(ranks, own, ask, ["street"]).collect() if r.cost is not None} == want


def test_routes_send_nothing_through_the_driver(spark):
    """Jumps and nodes are as many as the graph's nodes; small ones once were broadcast, in each step of the doubling."""
    rows = [(i, i + 1, 1.0) for i in range(20)]
    paths = graph.routes_to(graph.shortest(spark.createDataFrame(rows, "u long, v long, w double"), graph.source_rows(spark, [0])))
    nodes = spark.createDataFrame([(i, float(i), 0.0) for i in range(21)], "id long, x double, y double")
    best = spark.createDataFrame([(u, v, 10.0, 1.0) for u, v, _ in rows], "u long, v long, length_m double, seconds double")
    shapes = spark.createDataFrame([(u, v, k, float(u + k), 0.0) for u, v, _ in rows for k in (0, 1)], "u long, v long, at int, x double, y double")
    outs = [paths, graph.path_metrics(paths, best, ["id"]), graph.path_points(paths, nodes, ["id"]), graph.route_polyline(paths, shapes, nodes, ["id"])]
    assert [o.count() for o in outs] == [21 * 22 // 2, 21, 21 * 22 // 2, 21 * 22 // 2 - 1]
    assert not any("Broadcast" in o._jdf.queryExecution().toString() for o in outs)


def test_straight_bounds_shuffle_nodes(spark):
    nodes = spark.createDataFrame([(i, 114 + i / 100, 22.5) for i in range(20)], "id long, x double, y double")
    e = spark.createDataFrame([(i, i + 1, 60.0) for i in range(19)], "u long, v long, w double")
    out = graph.straight_bound(nodes, e, spark.createDataFrame([(19,)], "id long"))
    assert out._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") >= 2
    got = {r.id: r.bound for r in out.collect()}
    assert all(0 <= got[i] <= 60.0 * (19 - i) for i in range(20))


def test_radius_pairs_are_made_from_places(spark, monkeypatch):
    seen = _watched(monkeypatch)
    rng = random.Random(11)
    places = [(114 + rng.random() / 20, 22.5 + rng.random() / 20) for _ in range(9)]
    at = {i: places[i % 9] if i < 40 else places[0] for i in range(70)}
    s = spark.createDataFrame([(i, *p) for i, p in at.items()] + [(99, None, 22.5)], "station_id long, lon double, lat double")
    got = {part: sorted((r.station_id, r["rank"], r.neighbor_id, r.distance_km) for r in spatial.radius_neighbors(s, 2.0, part=part).collect()) for part in (7, 1 << 12)}
    assert got[7] == got[1 << 12]
    km = {(r.a, r.b): r.d for r in s.selectExpr("station_id a", "lon x", "lat y").crossJoin(s.selectExpr("station_id b", "lon", "lat")).select("a", "b", haversine_km(F.col("y"), F.col("x"), F.col("lat"), F.col("lon")).alias("d")).collect()}
    want = [(i, n + 1, j, km[i, j]) for i in at for n, j in enumerate(sorted((j for j in at if j != i and km[i, j] <= 2), key=lambda j: (km[i, j], j)))]
    assert got[7] == sorted(want)
    assert seen and all(a <= 9 and b <= 9 for a, b in seen)  # stations of one place meet no others one by one


def test_dense_rest_of_a_hierarchy_stays_whole(spark):
    """Nodes that are left with many edges share the highest rank; costs, either way and along unpacked routes, are those of a plain search."""
    rng = random.Random(13)
    rows = [(u, v, float(rng.randrange(1, 30))) for u in range(80) for v in range(u - 3, u + 4) if 0 <= v < 80 and u != v and rng.random() < 0.7]
    e = graph.collapse_min(spark.createDataFrame(rows, "u long, v long, w double"))
    nodes = spark.range(80)
    ranks, ch = graph.contract(e, nodes, block=60, dense=2, core=10)
    top = ranks.groupBy("rank").count().orderBy(F.desc("rank")).first()
    assert ranks.count() == 80 and 10 < top["count"] < 80
    plain = [(r.u, r.v, r.w) for r in e.collect()]
    want = {(s, g): c for s in (0, 7, 30) for g, c in _least(plain, s).items()}
    pairs = spark.createDataFrame([(s, g) for s in (0, 7, 30) for g in range(80)], "start long, goal long")
    got = {(r.start, r.goal): r.cost for r in graph.hierarchy_cost(ranks, ch, pairs).collect() if r.cost is not None}
    assert got == want
    few = spark.createDataFrame([(s, 7) for s in range(0, 80, 3)], "start long, goal long")
    sums = graph.street_sums(ch.join(e.withColumnRenamed("w", "street"), ["u", "v"], "left"), ["street"])
    for p in (few, pairs.filter("start = 7")):
        for r in graph.hierarchy_cost(ranks, sums, p, ["street"]).collect():
            true = _least(plain, r.start).get(r.goal)
            assert r.cost == true and r.street == true
    way = [r for r in graph.hierarchy_routes(ranks, ch, few.filter("start < 20")).collect()]
    w = {(u, v): x for u, v, x in plain}
    for s in {r.start for r in way}:
        assert sum(w[r.u, r.v] for r in way if r.start == s) == _least(plain, s)[7]
