"""The recommendation query: snap, select, check, one shortest-path search for all candidates, check, rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.functions.geo import covers, haversine_km, haversine_m
from gridlark.functions.scalar import balanced_score, clip
from gridlark.operators.constraints import Limits, post_check, pre_reason
from gridlark.operators.features import Forecast
from gridlark.operators.graph import best_parallel, routes_to, shortest
from gridlark.operators.iterate import saved
from gridlark.operators.linear import access_nodes, split_edges, start_on_pieces
from gridlark.operators.ranking import orders, ranked
from gridlark.operators.spatial import count_within, nearest_segment

START = "__start_access__"
START_ID = -(1 << 62)  # among the places that are snapped


def candidates(stations: DataFrame, lon: float, lat: float, limits: Limits) -> DataFrame:
    """Nearest stations by straight line within the radius."""
    d = haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    near = stations.withColumn("straight_km", d).filter(F.col("straight_km") <= limits.max_search_radius_km)
    return near.orderBy("straight_km", "station_id").limit(limits.max_candidates)


def segments(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected edges with the coordinates of both ends."""
    a = nodes.select(F.col("id").alias("u"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = nodes.select(F.col("id").alias("v"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return edges.filter("u < v").select("u", "v").distinct().join(a, "u").join(b, "v")


def snap(stations: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nearest edge of each station by planar degrees, and the distance in metres."""
    s = nearest_segment(stations, segments(nodes, edges))
    m = haversine_m(F.col("lat"), F.col("lon"), F.col("py"), F.col("px"))
    return stations.join(s, "station_id").withColumn("snap_m", m)


def place_on_road(nodes: DataFrame, edges: DataFrame, lon: float, lat: float, limits: Limits | None = None):
    """The place (u, v, t, snap_m) on the street nearest to a start; an error without streets or beyond the limit."""
    one = nodes.sparkSession.createDataFrame([(0, float(lon), float(lat))], "station_id long, lon double, lat double")
    return placed(snap(one, nodes, edges).first(), limits)


def placed(row, limits: Limits | None):
    if row is None:
        raise ValueError("the road graph has no street")
    if limits and row.snap_m > limits.max_start_snap_distance_m:
        raise ValueError(f"the nearest street is {row.snap_m:.1f} m away; the limit is {limits.max_start_snap_distance_m:.1f} m")
    return row


def request_graph(edges: DataFrame, stations: DataFrame, start) -> DataFrame:
    """Edges (u, v, seconds, length_m) between road nodes, stations' places on streets and the start, by name.

    edges: (u, v, seconds, length_m), one for each direction; stations: (station_id, u, v, t).
    """
    pieces = saved(split_edges(edges, stations), "pieces")
    base = pieces.select(F.col("from_node").alias("u"), F.col("to_node").alias("v"), "seconds", "length_m")
    return base.unionByName(start_on_pieces(pieces, start.u, start.v, float(start.t), START))


def recommend(
    stations: DataFrame, edges: DataFrame, start, lon: float, lat: float, occupancy: DataFrame, limits: Limits, metric: str = "balanced", top: int = 3
) -> DataFrame:
    """Feasible stations in the metric's order.

    stations: the columns of REQUIRED, access_node a node of edges; edges: (u, v, seconds, length_m);
    occupancy: (station_id, occupancy). One search from the start serves all candidates.
    """
    return ranked(feasible(stations, edges, start, lon, lat, occupancy, limits), metric, top)


def feasible(stations: DataFrame, edges: DataFrame, start, lon: float, lat: float, occupancy: DataFrame, limits: Limits) -> DataFrame:
    checked = checked_candidates(stations, edges, start, lon, lat, occupancy, limits)
    return checked.filter("reject_reason is null")


def routes(edges: DataFrame, start, goals: DataFrame) -> DataFrame:
    """Costs in minutes, lengths and parents from the start, searched until all goals (id) are final, however far they are.

    A goal without a row cannot be reached. Edges without a time take their length at the usual speed.
    """
    kind = dict(edges.dtypes)["u"]
    best = best_parallel(edges if "key" in edges.columns else edges.withColumn("key", F.lit(0)))
    src = edges.sparkSession.createDataFrame([(start, start, 0.0)], f"source {kind}, id {kind}, cost double")
    return shortest(best.withColumn("w", F.col("seconds") / 60), src, sums=["length_m"], goals=goals)


def checked_candidates(stations: DataFrame, edges: DataFrame, start, lon: float, lat: float, occupancy: DataFrame, limits: Limits) -> DataFrame:
    """The nearest stations with reject_reason (null if feasible), drive_min, distance_km, arrival_soc, occupancy and score."""
    near = saved(candidates(stations, lon, lat, limits), "candidates")
    checked = _checked(near, routes(edges, start, near.select(F.col("access_node").alias("id")).dropna()), limits)
    return scored(checked, occupancy.select("station_id", "occupancy"), limits)


def _checked(near: DataFrame, tree: DataFrame, limits: Limits) -> DataFrame:
    near = near.withColumn("pre", pre_reason(limits, near.columns))
    cost = tree.select(F.col("id").alias("access_node"), F.col("cost").alias("drive_min"), (F.col("length_m") / 1000).alias("distance_km"))
    found = near.join(cost, "access_node", "left").withColumn("path_found", F.col("distance_km").isNotNull())
    found = found.withColumns({c: F.when(F.col("pre").isNull(), F.col(c)) for c in ("drive_min", "distance_km")})
    out = post_check(found, limits)
    return out.withColumn("reject_reason", F.coalesce("pre", "reject_reason")).withColumn("arrival_soc", F.when(F.col("pre").isNull(), F.col("arrival_soc"))).drop("pre", "path_found")


def scored(checked: DataFrame, occupancy: DataFrame, limits: Limits) -> DataFrame:
    """Checked stations with their occupancy, within 0 and 1, and the balanced score."""
    out = checked.join(occupancy.withColumn("occupancy", clip(F.col("occupancy"), 0, 1)), "station_id", "left")
    return out.withColumn("score", balanced_score(F.col("drive_min"), limits.max_drive_time_min, F.col("occupancy")))


def service(
    stations: DataFrame, nodes: DataFrame, edges: DataFrame, boundary: list, lon: float, lat: float, when: str, forecast: Forecast, poi: DataFrame, kinds: list[str], limits: Limits, poi_km: float = 2.0, with_routes: bool = False,
) -> DataFrame:
    """The checked candidates of one request, with POI counts and the occupancy predicted for the time of arrival.

    The start must lie in the boundary and near a street. stations: (station_id, lon, lat, charge_count, tazid); edges: (u, v,
    seconds, length_m) of both directions. Columns occupancy, horizon_min, prediction_time and source tell the prediction, start_lon, start_lat and
    start_snap_m the start's place on its street. with_routes adds the places of each route (array of lat, lon).
    """
    spark = stations.sparkSession
    if not spark.range(1).select(covers(F.lit(float(lon)), F.lit(float(lat)), boundary)).first()[0]:
        raise ValueError("the start lies outside the service area")
    near = saved(candidates(stations, lon, lat, limits).select("station_id", "lon", "lat", "charge_count", "straight_km"), "candidates")
    # the start and the candidates are snapped together; the start comes back as the one without an id
    one = spark.createDataFrame([(float(lon), float(lat))], "lon double, lat double").select(F.lit(START_ID).cast("long").alias("station_id"), "lon", "lat")
    snapped = saved(snap(near.select(F.col("station_id").cast("long"), "lon", "lat").unionByName(one), nodes, edges), "places")
    start = placed(snapped.filter(F.col("station_id") == START_ID).first(), limits)
    places = snapped.filter(F.col("station_id") != START_ID)
    graph = request_graph(edges, places, start)
    named = places.join(access_nodes(places), "station_id").join(near.select("station_id", "charge_count", "straight_km"), "station_id").select(
        "station_id", "lon", "lat", "charge_count", "straight_km", F.col("u").alias("road_edge_u"), F.col("v").alias("road_edge_v"), F.lit(0).alias("road_edge_key"), F.col("py").alias("road_projection_lat"),
        F.col("px").alias("road_projection_lon"), F.col("snap_m").alias("road_snap_distance_m"), F.col("node").alias("access_node"),
    )
    named = saved(named, "named")
    goals = named.select(F.col("access_node").alias("id")).dropna()
    tree = routes(graph, START, goals)
    checked = saved(_checked(named, tree, limits), "checked")
    counts = saved(count_within(named.select("station_id", "lon", "lat"), poi, poi_km, kinds), "counts")
    out = scored(checked, forecast.on_arrival(checked, when, stations, counts), limits).join(counts, "station_id", "left")
    out = out.withColumns({"start_lon": F.lit(float(start.px)), "start_lat": F.lit(float(start.py)), "start_snap_m": F.lit(float(start.snap_m))})
    return out.join(_lines(tree, named, nodes, start), "station_id", "left") if with_routes else out


def _lines(tree: DataFrame, named: DataFrame, nodes: DataFrame, start) -> DataFrame:
    """Rows (station_id, route): the places (lat, lon) from the start to each station's place on its street."""
    goals = tree.join(named.select(F.col("access_node").alias("id"), "station_id"), "id").select("source", "id", "station_id")
    at = nodes.select(F.col("id").cast("string").alias("node"), "x", "y")
    own = named.filter(F.col("access_node").startswith("access_")).select(F.col("access_node").alias("node"), F.col("road_projection_lon").alias("x"), F.col("road_projection_lat").alias("y")).dropDuplicates(["node"])
    first = tree.sparkSession.createDataFrame([(START, float(start.px), float(start.py))], "node string, x double, y double")
    path = routes_to(tree, goals.select("source", "id").distinct()).join(at.unionByName(own).unionByName(first), "node")
    path = path.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "y", "x"))), lambda p: F.struct(p["y"].alias("lat"), p["x"].alias("lon"))).alias("route"))  # one route's nodes
    return goals.join(path, "id").select("station_id", "route")


def items(checked: DataFrame, algorithm: str = "buckets") -> DataFrame:
    """The rows of a response by the names that its readers expect; what only a trace of a search would tell is left out."""
    c = F.col
    named = {
        "station_id": c("station_id"), "station_display_name": F.concat(F.lit("Charging Station "), c("station_id").cast("string")), "algorithm": F.lit(algorithm), "station_latitude": c("lat"), "station_longitude": c("lon"),
        "station_road_latitude": c("road_projection_lat"), "station_road_longitude": c("road_projection_lon"), "start_node_latitude": c("start_lat"), "start_node_longitude": c("start_lon"), "start_snap_distance_m": c("start_snap_m"),
        "distance_km": c("distance_km"), "drive_time_min": c("drive_min"), "road_snap_distance_m": c("road_snap_distance_m"), "charge_count": c("charge_count"), "poi_total_count": F.coalesce("total", F.lit(0)),
        **{f"poi_{k}_count": F.coalesce(k, F.lit(0)) for k in ("lifestyle_services", "business_residential", "food_beverage")}, "arrival_soc": c("arrival_soc"), "predicted_occupancy_rate": c("occupancy"),
        "prediction_horizon_min": c("horizon_min"), "prediction_time": F.date_format("prediction_time", "yyyy-MM-dd'T'HH:mm:ss"), "prediction_source": c("source"), "ml_rank_score": c("score"),
        "passed_constraints": c("reject_reason").isNull(), "reject_reason": F.coalesce("reject_reason", F.lit("")),
    }
    if "route" in checked.columns:
        named["route_coordinates"] = c("route")
    return checked.select(*[v.alias(k) for k, v in named.items()])


def recommendation_orders(checked: DataFrame, top: int) -> DataFrame:
    return orders(checked.filter("reject_reason is null"), top)
