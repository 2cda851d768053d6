"""Requests, what they keep between each other, attribution, searches over settings and unions of areas, on small inputs."""

import itertools
import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from gridlark.operators import attribution, dissolve, features, graph, ml, prepared, recommend, spatial
from gridlark.operators.constraints import Limits
from gridlark.operators.profiles import profile_sums
from gridlark.functions.timefn import calendar
from gridlark.sources import artifacts, files


# the store


def test_store_reads_what_it_built(spark, tmp_path):
    store = artifacts.Store(spark, str(tmp_path))
    built = []

    def build(n):
        return lambda: built.append(n) or {"a": spark.range(n), "b": spark.range(n).withColumn("x", F.lit("t"))}

    source = spark.createDataFrame([(1, "x"), (2, None)], "id long, t string")
    first = store.tables("things", "pairs", {"s": source}, build(3), {"k": 1})
    again = store.tables("things", "pairs", {"s": source.orderBy(F.desc("id"))}, build(4), {"k": 1})
    assert built == [3] and first["a"].count() == again["a"].count() == 3 and again["b"].columns == ["id", "x"]
    store.tables("things", "pairs", {"s": source.filter("id = 1")}, build(5), {"k": 1})
    store.tables("things", "pairs", {"s": source}, build(6), {"k": 2})
    store.tables("things", "pairs", {"s": source.union(source)}, build(7), {"k": 1})
    assert built == [3, 5, 6, 7] and len(store.versions("things")) == 4
    assert store.load("things", "pairs")["a"].count() == 7


def test_store_tells_kinds(spark, tmp_path):
    store = artifacts.Store(spark, str(tmp_path))
    store.tables("x", "landmarks", {}, lambda: {"costs": spark.range(2)})
    for wrong in (lambda: store.tables("x", "hierarchy", {}, lambda: {}), lambda: store.load("x", "model"), lambda: store.model("x", {}, lambda: None)):
        with pytest.raises(TypeError):
            wrong()
    with pytest.raises(TypeError):
        store.model("y", {}, lambda: "no model")
    with pytest.raises(FileNotFoundError):
        store.load("absent", "model")
    mark = store.versions("x")[0]["mark"]
    spark.range(2).withColumnRenamed("id", "other").write.mode("overwrite").parquet(f"{tmp_path}/x/{mark}/costs")
    with pytest.raises(TypeError, match="other columns"):
        store.load("x", "landmarks")


def test_store_of_graphs_and_models(spark, tmp_path, monkeypatch):
    store = artifacts.Store(spark, str(tmp_path))
    e = spark.createDataFrame([(0, 1, 2.0), (1, 2, 2.0), (2, 0, 5.0), (1, 0, 1.0)], "u long, v long, w double")
    n = spark.createDataFrame([(i, float(i), 0.0) for i in range(3)], "id long, x double, y double")
    ranks, ch = prepared.hierarchy(store, "h", e, n)
    table = prepared.landmarks(store, "l", e, n, 2)
    monkeypatch.setattr(graph, "contract", None)
    monkeypatch.setattr(graph, "landmark_table", None)
    pairs = n.select(F.lit(0).cast("long").alias("start"), F.col("id").alias("goal"))
    ranks, ch = prepared.hierarchy(store, "h", e, n)
    assert {r.goal: r.cost for r in graph.hierarchy_cost(ranks, ch, pairs).collect()} == {0: 0.0, 1: 2.0, 2: 4.0}
    assert prepared.landmarks(store, "l", e, n, 2).count() == table.count() > 0
    rows = spark.createDataFrame([(float(i % 4), float(i % 3), float(i % 4) / 4) for i in range(40)], "a double, b double, y double")
    m = prepared.trained(store, "m", rows, ["a", "b"], "y", trees=2, depth=2)
    monkeypatch.setattr(ml, "train", None)
    again = prepared.trained(store, "m", rows, ["a", "b"], "y", trees=2, depth=2)
    told = lambda x: [round(r.prediction, 9) for r in ml.predict(x, rows, ["a", "b"]).collect()]
    assert told(m) == told(again) and isinstance(again, PipelineModel)


def test_built_once_is_never_stale(spark, tmp_path):
    built = []
    make = lambda df: lambda: built.append(1) or df
    a, b = spark.range(3), spark.range(4)
    for df in (a, a, b, b):
        assert files.built_once(spark, str(tmp_path / "t"), make(df), inputs={"s": df}).count() == df.count()
    assert len(built) == 2


# requests


def road(spark):
    """A line of nodes 0 to 5, a minute apart, with 5 reached but never left, and 6 without a way to it."""
    rows = [(i, i + 1, 60.0, 1000.0) for i in range(5)] + [(i + 1, i, 60.0, 1000.0) for i in range(4)] + [(6, 5, 60.0, 1000.0)]
    nodes = spark.createDataFrame([(i, 0.01 * i, 0.0) for i in range(7)], "id long, x double, y double")
    return nodes, spark.createDataFrame(rows, "u long, v long, seconds double, length_m double")


def test_reasons_beyond_the_limit(spark):
    """A station farther than any multiple of the limit is too far, not absent; only one without a way has no path."""
    _, e = road(spark)
    s = spark.createDataFrame([(1, 0.01, 1), (5, 0.05, 5), (6, 0.06, 6)], "station_id long, lon double, access_node long").withColumns({
        "lat": F.lit(0.0), "charge_count": F.lit(3), "road_edge_u": F.lit(0), "road_edge_v": F.lit(1), "road_edge_key": F.lit(0), "road_projection_lat": F.lit(0.0), "road_projection_lon": F.lit(0.0), "road_snap_distance_m": F.lit(0.0)})
    limits = Limits(max_drive_time_min=1.5)
    out = recommend.checked_candidates(s, e, 0, 0.0, 0.0, spark.createDataFrame([(1, 1.5)], "station_id long, occupancy double"), limits)
    got = {r.station_id: (r.reject_reason, r.drive_min, r.occupancy) for r in out.collect()}
    assert got == {1: (None, 1.0, 1.0), 5: ("drive_time_exceeds_limit", 5.0, None), 6: ("path_not_found", None, None)}


def test_edges_without_a_time(spark):
    e = spark.createDataFrame([("A", "B", 0, None, 2000.0), ("B", "C", 0, None, None), ("A", "C", 0, 500.0, 10.0), ("A", "C", 1, None, 1.0)], "u string, v string, key int, seconds double, length_m double")
    got = {(r.u, r.v): (r.key, round(r.seconds, 6), r.length_m) for r in graph.best_parallel(e).collect()}
    assert got == {("A", "B"): (0, 180.0, 2000.0), ("B", "C"): (0, 0.0, 0.0), ("A", "C"): (0, 500.0, 10.0)}
    tree = recommend.routes(e, "A", spark.createDataFrame([("C",)], "id string"))
    assert {r.id: r.cost for r in tree.collect()}["C"] == 3.0


def history(spark):
    """Station 1 with a long history, 2 with five rows before the cut-off and none after, 3 with none."""
    rows = [(1, datetime(2024, 1, 1 + i // 24, i % 24), i, (i % 7) / 7, 0.5, 0.25, 10.0) for i in range(480)]
    rows += [(2, datetime(2024, 1, 3 + i, 11), 1000 + i, 0.3, 0.5, 0.25, 20.0) for i in range(5)]
    return spark.createDataFrame(rows, "station_id long, time timestamp_ntz, obs_id long, occ double, s_price double, e_price double, duration double")


def forecast(spark):
    o = history(spark)
    model = PipelineModel([SQLTransformer(statement="SELECT *, occupancy_lag_1 + 10 * (station_same_hour_occupancy - station_same_hour_occupancy) + prediction_horizon_min / 1000 AS raw FROM __THIS__")])
    sums = profile_sums(calendar(o.filter(F.col("time") < F.lit("2024-01-18").cast("timestamp_ntz"))))
    weather = spark.createDataFrame([(datetime(2024, 1, 1), 10.0, 50.0, 0.0)], "weather_hour timestamp_ntz, temperature double, humidity double, rain double")
    near = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "station_id long, neighbor_id long, distance_km double")
    return features.Forecast(model, o, sums, weather, near)


def test_prediction_on_arrival(spark):
    f = forecast(spark)
    s = spark.createDataFrame([(i, 0.01 * i, 0.0, 4, 0) for i in (1, 2, 3)], "station_id long, lon double, lat double, charge_count int, tazid int")
    poi = s.select("station_id", *[F.lit(0).alias(c) for c in ("total", "lifestyle_services", "business_residential", "food_beverage")])
    now = "2024-01-20 10:32:00"
    for drive, horizon in ((2.0, 5.0), (31.5, 31.5), (400.0, 120.0)):
        asked = spark.createDataFrame([(1, drive), (2, drive), (3, drive)], "station_id long, drive_min double")
        got = {r.station_id: r for r in f.on_arrival(asked, now, s, poi).collect()}
        last = [r.occ for r in f.obs.filter("station_id = 1").filter(F.col("time") <= F.lit("2024-01-20 10:30:00").cast("timestamp_ntz")).orderBy("time").collect()]
        assert got[1].occupancy == pytest.approx(min(1.0, last[-2] + horizon / 1000)) and (got[1].source, got[1].horizon_min) == ("history", horizon)
        assert (got[1].prediction_time - datetime(2024, 1, 20, 10, 32)).total_seconds() == horizon * 60
        assert got[2].source == "profile" and got[2].occupancy == pytest.approx(0.3) and (got[2].prediction_time - datetime(2024, 1, 20, 10, 32)).total_seconds() == drive * 60
        assert (got[3].source, got[3].occupancy, got[3].prediction_time) == ("insufficient_history", None, None)
    none = f.on_arrival(spark.createDataFrame([(1, None)], "station_id long, drive_min double"), now, s, poi).first()
    assert (none.source, none.occupancy, none.horizon_min) == ("insufficient_history", None, None)


def test_service_tells_all(spark):
    nodes, e = road(spark)
    s = spark.createDataFrame([(i, 0.01 * i + 0.002, 0.001, 4, 0) for i in (1, 2, 3)], "station_id long, lon double, lat double, charge_count int, tazid int")
    poi = spark.createDataFrame([(1, 0.012, 0.0, "food_beverage")], "poi_id long, lon double, lat double, kind string")
    square = [[[(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)]]]
    limits = Limits(max_road_snap_distance_m=3000.0, max_start_snap_distance_m=3000.0)
    out = recommend.service(s, nodes, e, square, 0.005, 0.001, "2024-01-20 10:32:00", forecast(spark), poi, ["lifestyle_services", "business_residential", "food_beverage"], limits, with_routes=True)
    got = {r.station_id: r for r in recommend.items(out).collect()}
    assert {k: round(r.drive_time_min, 6) for k, r in got.items()} == {1: 0.7, 2: 1.7, 3: 2.7} and all(r.passed_constraints for r in got.values())
    assert [r.prediction_source for _, r in sorted(got.items())] == ["history", "profile", "insufficient_history"]
    assert got[1].poi_food_beverage_count == 1 and got[1].poi_total_count == 1 and got[1].station_display_name == "Charging Station 1"
    assert [(round(p.lat, 6), round(p.lon, 6)) for p in got[2].route_coordinates] == [(0.0, 0.005), (0.0, 0.01), (0.0, 0.012), (0.0, 0.02), (0.0, 0.022)]
    assert got[1].start_node_longitude == pytest.approx(0.005) and got[1].start_snap_distance_m > 100
    near = Limits(max_road_snap_distance_m=3000.0, max_start_snap_distance_m=10.0)
    with pytest.raises(ValueError, match="nearest street"):
        recommend.service(s, nodes, e, square, 0.005, 0.001, "2024-01-20 10:32:00", None, poi, [], near)


# hierarchies


def test_long_witnesses_save_shortcuts(spark):
    """The other way round has four edges, which a search of two does not see."""
    rows = [(0, 1, 5.0), (1, 2, 5.0), (0, 3, 1.0), (3, 4, 1.0), (4, 5, 1.0), (5, 2, 1.0)]
    live = spark.createDataFrame([(*r, None) for r in rows], "u long, v long, w double, via long")
    short = spark.createDataFrame([(0, 2, 10.0, 1)], "u long, v long, w double, via long")
    gone = spark.createDataFrame([(1,)], "id long")
    assert graph.witnessed(short, live, gone, hops=2).count() == 1 and graph.witnessed(short, live, gone, hops=4).isEmpty()
    assert graph.witnessed(short, live, gone, hops=4, settled=1).count() == 1 and graph.witnessed(short, live, gone, hops=4, settled=5).isEmpty() and graph.witnessed(short.withColumn("w", F.lit(3.5)), live, gone).count() == 1


def test_straight_bounds_are_safe(spark):
    r = random.Random(2)
    places = [(i, r.uniform(0, 0.2), r.uniform(0, 0.2)) for i in range(25)]
    rows = [(u, v, r.uniform(1, 9)) for u in range(25) for v in r.sample(range(25), 3) if u != v]
    n, e = spark.createDataFrame(places, "id long, x double, y double"), spark.createDataFrame(rows, "u long, v long, w double")
    for goal in (3, 17):
        g = spark.createDataFrame([(goal,)], "id long")
        bounds = graph.straight_bound(n, e, g).select("id", "bound")
        true = graph.shortest(graph.reverse(e), graph.source_rows(spark, [goal])).select("id", "cost")
        assert bounds.join(true, "id").filter("bound > cost").isEmpty() and bounds.filter("bound > 0").count() == 24
        hit = graph.goal_directed(e, spark.createDataFrame([(0,)], "id long"), g, bounds).collect()
        assert [x.cost for x in hit] == pytest.approx([x.cost for x in true.filter("id = 0").collect()])
    free = graph.straight_bound(n, e.union(spark.createDataFrame([(0, 1, 0.0)], e.schema)), spark.createDataFrame([(3,)], "id long"))
    assert free.filter("bound > 0").isEmpty()


# attribution


def random_tree(r, n, depth):
    cover = 1000.0

    def grow(cover, depth):
        if depth == 0 or cover < 20 or r.random() < 0.15:
            return {"value": r.uniform(-1, 1), "cover": cover}
        left = cover * r.uniform(0.1, 0.9)
        return {"feature": r.randrange(n), "threshold": r.uniform(0.2, 0.8), "cover": cover, "left": grow(left, depth - 1), "right": grow(cover - left, depth - 1)}

    return grow(cover, depth)


def value(node, x, known):
    while "left" in node:
        if node["feature"] not in known:
            return sum(node[s]["cover"] / node["cover"] * value(node[s], x, known) for s in ("left", "right"))
        node = node["left"] if x[node["feature"]] <= node["threshold"] else node["right"]
    return node["value"]


def by_all_subsets(trees, x, n):
    v = {s: sum(w * value(t, x, set(s)) for t, w in trees) for k in range(n + 1) for s in itertools.combinations(range(n), k)}
    add = lambda s, *i: tuple(sorted({*s, *i}))
    phi = [sum(math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n) * (v[add(s, i)] - v[s]) for s in v if i not in s) for i in range(n)]
    pair = np.zeros((n, n))
    for i, j in itertools.permutations(range(n), 2):
        pair[i, j] = sum(math.factorial(len(s)) * math.factorial(n - len(s) - 2) / math.factorial(n - 1) / 2 * (v[add(s, i, j)] - v[add(s, i)] - v[add(s, j)] + v[s]) for s in v if i not in s and j not in s)
    pair[np.diag_indices(n)] = np.array(phi) - pair.sum(1)
    return v[()], phi, pair


def test_attribution_by_all_subsets(spark):
    r = random.Random(6)
    n = 6
    names = [f"f{i}" for i in range(n)]
    trees = [(random_tree(r, n, 5), 1.0), (random_tree(r, n, 4), 0.3), ({"value": 0.25, "cover": 9.0}, 1.0)]
    leaves = [x for t, w in trees for x in attribution.leaves_of(t, w)]
    rows = [tuple(r.choice([r.random(), 0.5]) for _ in range(n)) for _ in range(25)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "key int, " + ", ".join(f"{f} double" for f in names))
    want = [by_all_subsets(trees, x, n) for x in rows]
    for a in attribution.attribute(leaves, df, names, ["key"]).collect():
        mean, phi, _ = want[a["key"]]
        assert a.parts == pytest.approx(phi) and a["mean"] == pytest.approx(mean) and a["mean"] + sum(a.parts) == pytest.approx(a.prediction)
    expect = np.mean([np.abs(w[2]) for w in want], axis=0)
    got = {(m.feature, m.other): m.mean_abs for m in attribution.interaction_matrix(leaves, df.repartition(3), names).collect()}
    assert got == pytest.approx({(names[i], names[j]): expect[i, j] for i in range(n) for j in range(n)})
    assert attribution.attribute(leaves, df.limit(0), names, ["key"]).isEmpty() and attribution.interaction_matrix(leaves, df.limit(0), names).isEmpty()


def test_attribution_of_a_trained_model(spark):
    r = random.Random(3)
    rows = [(i, *(x := (r.random(), r.random(), r.random())), x[0] * x[1] + 0.2 * x[2]) for i in range(300)]
    df = spark.createDataFrame(rows, "key int, a double, b double, c double, y double")
    m = ml.train(df, ["a", "b", "c"], "y", trees=4, depth=3)
    told = attribution.attribute(attribution.model_leaves(m), df, ["a", "b", "c"], ["key"])
    raw = {x["key"]: x.raw for x in m.transform(ml.align_features(df, ["a", "b", "c"])).select("key", "raw").collect()}
    for x in told.collect():
        assert x.prediction == pytest.approx(raw[x["key"]]) and x["mean"] + sum(x.parts) == pytest.approx(x.prediction)
    top = {x.feature: x.mean_abs for x in attribution.mean_abs_parts(told, ["a", "b", "c"]).collect()}
    assert set(top) == {"a", "b", "c"} and top["a"] > top["c"]
    told = ml.importances(m, ["a", "b", "c"])
    assert sum(v for _, v in told) == pytest.approx(1) and [v for _, v in told] == sorted((v for _, v in told), reverse=True) and told[-1][0] == "c"


# searches


def test_a_stopped_search_goes_on(spark, tmp_path, monkeypatch):
    calls = []

    def figures(fit, test, names, target, **params):
        calls.append((tuple(names), tuple(sorted(params.items()))))
        if len(calls) == stop:
            raise RuntimeError("lost")
        return {"n_features": len(names), "mae": 0.1, "r2": 0.5 - 0.1 * abs(len(names) - 2) + 0.01 * params.get("trees", 0)}

    monkeypatch.setattr(ml, "evaluate", figures)
    log = lambda search, data="d": files.Trials(spark, str(tmp_path / "log"), search, data)
    grid = {"trees": [2, 3, 4], "depth": [1, 2]}
    runs = {
        "subsets": lambda g: ml.subset_search(None, None, ["a"], ["b", "c"], 2, "y", log=g), "backward": lambda g: ml.backward_elimination(None, None, ["a", "b", "c", "d"], "y", log=g),
        "random": lambda g: ml.random_search(None, None, ["a"], "y", grid, 3, 2, log=g), "parzen": lambda g: ml.parzen_search(lambda p: ml.evaluate(None, None, ["a"], "y", **p), grid, 5, start=2, log=g),
    }
    for name, run in runs.items():
        calls.clear()
        stop = 0
        whole = run(None)
        n = len(calls)
        calls.clear()
        stop = 3
        with pytest.raises(RuntimeError):
            run(log(name))
        done = calls[:-1]
        calls.clear()
        stop = 0
        assert run(log(name)) == whole and len(done) + len(calls) <= n and not set(done) & set(calls)
        calls.clear()
        assert run(log(name)) == whole and not calls
        run(log(name, "other data"))
        assert calls


def test_parzen_beats_random():
    grid = {"a": list(range(12)), "b": list(range(12)), "c": list(range(6))}
    score = lambda p: {"r2": -((p["a"] - 9) ** 2) - (p["b"] - 2) ** 2 - 2 * (p["c"] - 4) ** 2, "mae": 0.0}
    best = lambda rows: max(x["r2"] for x in rows)
    ours = [best(ml.parzen_search(score, grid, 40, seed=s)) for s in range(10)]
    theirs = [best([score(p) for p in ml.sample_params(grid, 40, seed=s)]) for s in range(10)]
    assert sum(ours) > sum(theirs) and sum(a >= b for a, b in zip(ours, theirs, strict=True)) >= 8
    small = ml.parzen_search(score, {"a": [0, 9], "b": [2], "c": [4]}, 10, start=1)
    assert sorted(x["a"] for x in small) == [0, 9]


# sources and areas


def test_only_the_stations_files_are_read(spark, tmp_path):
    head = "time,busy,idle,s_price,e_price,duration\n"
    for i in (1, 2, 10, 33):
        (tmp_path / f"{i}.csv").write_text(head + f"2023-01-01 00:00:00,{i},1,0.5,0.6,3\n")
    (tmp_path / "broken.csv").write_text("nothing")
    names = lambda df: sorted(f.rsplit("/", 1)[1] for f in df.inputFiles())
    assert names(files.station_history(spark, str(tmp_path), 2)) == ["1.csv", "10.csv"]
    two = files.station_history(spark, str(tmp_path), stations=[33, 2, 99])
    assert names(two) == ["2.csv", "33.csv"] and sorted(r.busy for r in two.collect()) == [2, 33]
    none = files.station_history(spark, str(tmp_path), stations=[])
    assert none.isEmpty() and none.columns == two.columns


def polygons(spark, rows):
    return spark.createDataFrame(rows, "polygon int, ring int, points array<struct<lon:double,lat:double>>")


def area(u):
    out = {}
    for r in u.orderBy("ring", "pos").collect():
        out.setdefault((r.ring, r.hole), []).append((r.x, r.y))
    return {k: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, [*p[1:], p[0]], strict=True)) / 2 for k, p in out.items()}


def test_dissolve_squares(spark):
    box = lambda x, y, s=1.0: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    got = area(dissolve.dissolve(polygons(spark, [(1, 0, box(0.0, 0.0)), (2, 0, box(1.0, 0.0)), (3, 0, box(0.5, 0.5)), (4, 0, box(5.0, 5.0)), (5, 0, box(5.0, 5.0)), (6, 0, box(6.0, 6.0))])))
    assert sorted(round(v, 6) for v in got.values()) == [1.0, 1.0, 2.5] and not any(h for _, h in got)
    ring = [(7, 0, box(0.0, 0.0, 4.0)), (7, 1, box(1.0, 1.0, 2.0)), (8, 0, box(1.5, 1.5, 0.5))]
    got = area(dissolve.dissolve(polygons(spark, ring)))
    assert sorted((h, round(v, 6)) for (_, h), v in got.items()) == [(False, 0.25), (False, 16.0), (True, -4.0)]
    assert dissolve.dissolve(polygons(spark, [])).isEmpty()


def test_dissolve_covers_what_any_polygon_covers(spark):
    r = random.Random(11)
    rows = []
    for k in range(9):
        x, y = r.uniform(0, 4), r.uniform(0, 4)
        turn = sorted(r.uniform(0, 2 * math.pi) for _ in range(r.randint(4, 8)))
        rows.append((k, 0, [(x + r.uniform(0.4, 1.6) * math.cos(t), y + r.uniform(0.4, 1.6) * math.sin(t)) for t in turn]))
    any_of = polygons(spark, rows)
    union = dissolve.dissolve(any_of)
    points = spark.createDataFrame([(i, r.uniform(-2, 6), r.uniform(-2, 6)) for i in range(600)], "station_id long, lon double, lat double")
    want = {x.station_id for x in spatial.covered(points, any_of).collect()}
    rings = {}
    for c in union.orderBy("ring", "pos").collect():
        rings.setdefault(c.ring, []).append((c.x, c.y))

    def inside(x, y):
        hits = 0
        for p in rings.values():
            for (ax, ay), (bx, by) in zip(p, [*p[1:], p[0]], strict=True):
                hits += (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay)
        return hits % 2 == 1

    assert {p.station_id for p in points.collect() if inside(p.lon, p.lat)} == want and len(want) > 100


def test_exact_quantiles(spark):
    from gridlark.operators.metrics import quantile_grid

    r = random.Random(1)
    for values in ([1.0], [3.0, 1.0], [r.choice([0.0, 0.5, 1.0]) for _ in range(101)], [r.gauss(0, 1) for _ in range(5000)], [float(i // 100) for i in range(3000)] + [None] * 5):
        df = spark.createDataFrame([(x,) for x in values], "v double").repartition(3)
        got = [x.value for x in quantile_grid(df, "v", 0.0, 1.0, 7, accuracy=100).orderBy("bin").collect()]
        assert got == pytest.approx(np.quantile([x for x in values if x is not None], [i / 6 for i in range(7)]).tolist(), abs=1e-12)
    assert quantile_grid(spark.createDataFrame([], "v double"), "v").isEmpty()
