"""Queries over the small relational operators, routes as lines, and ranked searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlark.functions.scalar import format_fixed, format_percent, format_runtime
from gridlark.functions.timefn import calendar
from gridlark.operators import graph as R
from gridlark.operators import linear as L
from gridlark.operators import prepared
from gridlark.operators import relational as B
from gridlark.operators import spatial as X
from gridlark.operators.iterate import saved
from gridlark.plans import series as Q
from gridlark.plans.helpers import big, r6, s6, sb, st, stamp
from gridlark.plans.roads import edges, from_node
from gridlark.plans.space import _border_sql, _ring_sql
from gridlark.sources import scenario as S

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
FROM, TO = "2024-01-10 06:20:00", "2024-01-20 18:40:00"


def query(sql: str, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        head = f"WITH RECURSIVE {S.ctes(*views)}".replace("road_edge AS (", "road_edge AS MATERIALIZED (") + ("" if sql.startswith(",") else " ") if views else ""
        ORACLE[f.__name__] = head + sql
        return f

    return add


@query(f"SELECT station_id, obs_id, {st('time', 'at')} FROM obs WHERE time BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'", "obs")
def range_closed(spark, sf):
    return B.between_closed(Q.obs(spark, sf), "time", Q.t(FROM), Q.t(TO)).select(*Q.key(), stamp("at", F.col("time")))


@query("SELECT station_id, obs_id FROM obs WHERE time BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-20 19:00:00'", "obs")
def range_hours(spark, sf):
    return B.within_hours(Q.obs(spark, sf), "time", Q.t(FROM), Q.t(TO)).select(*Q.key())


@query(f"SELECT station_id, arg_min(obs_id, (time, obs_id)) AS obs_id, {s6('arg_min(occ, (time, obs_id))', 'occ')} FROM obs GROUP BY 1", "obs")
def keep_first(spark, sf):
    return B.keep_first(Q.obs(spark, sf).select("station_id", "time", "obs_id", "occ"), ["station_id"], ["time", "obs_id"]).select(*Q.key(), r6("occ"))


DAYS = ", ".join(f"{s6(f'avg(occ) FILTER (isodow(time) = {d + 1})', f'd{d}')}" for d in range(7))


@query(f"SELECT {sb('hour(time)', 'hour')}, {DAYS} FROM obs GROUP BY hour(time)", "obs")
def pivot_mean(spark, sf):
    out = B.pivot_mean(calendar(Q.obs(spark, sf)), "hour", "weekday", range(7), "occ")
    return out.select(big("hour"), *[r6(f"d{d}", F.col(str(d))) for d in range(7)])


@query("SELECT station_id, obs_id, CASE WHEN ((obs_id % 2147483647 + 42) * 48271) % 2147483647 < 536870911 THEN 'test' ELSE 'train' END AS part FROM obs", "obs")
def random_split(spark, sf):
    return B.random_split(Q.obs(spark, sf), "obs_id", 0.25).select(*Q.key(), "part")


@query(f"SELECT o.station_id, o.obs_id, {s6('occ', 'occ')}, {s6('lon', 'lon')}, {s6('lat', 'lat')}, {sb('charge_count', 'charge_count')} FROM obs o LEFT JOIN (SELECT * FROM station WHERE charge_count <= 15) s ON s.station_id = o.station_id", "obs", "station")
def station_join(spark, sf):
    """Observations with their station; the dimension lacks the largest stations and names others twice."""
    s = S.station(spark, sf).filter("charge_count <= 15")
    return B.with_dimension(Q.obs(spark, sf), s.unionByName(s), "station_id").select(*Q.key(), r6("occ"), r6("lon"), r6("lat"), big("charge_count"))


@query(f"SELECT o_orderkey, {s6('round_even(o_totalprice / 1000, 1)', 'price')} FROM orders")
def half_even(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", r6("price", B.half_even(F.col("o_totalprice") / 1000, 1)))


@query(f"SELECT event_id, {st('date_trunc(' + chr(39) + 'second' + chr(39) + ', ts)', 'at')} FROM events")
def parse_time(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", stamp("at", B.parse_time(text)))


BEND = "sqrt(pow((bx - ax) / 2 + 0.001, 2) + pow((b_y - ay) / 2, 2)) + sqrt(pow((bx - ax) / 2 - 0.001, 2) + pow((b_y - ay) / 2, 2))"
TREE = (
    f", {from_node('0')}, p AS MATERIALIZED (SELECT e.v AS id, arg_min(e.u, struct_pack(d := r.d, u := e.u::VARCHAR)) AS parent FROM road_edge e JOIN r ON r.id = e.u JOIN r t ON t.id = e.v WHERE r.d + e.seconds = t.d AND e.v <> 0 GROUP BY 1), "
    f"g AS MATERIALIZED (SELECT p.id, p.parent, {BEND} AS len FROM p JOIN (SELECT id, x AS ax, y AS ay FROM road_node) a ON a.id = p.parent JOIN (SELECT id, x AS bx, y AS b_y FROM road_node) b ON b.id = p.id), "
    "w(id, k, len) AS (SELECT 0::BIGINT, 0::BIGINT, 0.0::DOUBLE UNION ALL SELECT g.id, w.k + 1, w.len + g.len FROM w JOIN g ON g.parent = w.id)"
)


@query(TREE + f" SELECT id, 2 * k + 1 AS n_points, {s6('len', 'degrees')} FROM w WHERE k > 0", "road_edge", "road_node")
def route_polyline(spark, sf):
    """Lines of the routes from node 0, each edge bent in its middle: their points and planar lengths."""
    e, n = saved(edges(spark, sf), "edges"), S.road_node(spark, sf)
    paths = R.routes_to(R.shortest(e, R.source_rows(spark, [0])))
    a, b = n.select(F.col("id").alias("u"), F.col("x").alias("ax"), F.col("y").alias("ay")), n.select(F.col("id").alias("v"), F.col("x").alias("bx"), F.col("y").alias("by"))
    ends = e.select("u", "v").join(a.hint("merge"), "u").join(b.hint("merge"), "v")
    mid = [((F.col("ax") + F.col("bx")) / 2 + 0.001).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y")]
    shapes = ends.select("u", "v", F.lit(0).alias("at"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    shapes = shapes.unionByName(ends.select("u", "v", F.lit(1).alias("at"), *mid)).unionByName(ends.select("u", "v", F.lit(2).alias("at"), F.col("bx").alias("x"), F.col("by").alias("y")))
    line = R.route_polyline(paths, shapes, n, ["id"])
    pts = F.array_sort(F.collect_list(F.struct("pos", "x", "y")))
    step = F.transform(F.sequence(F.lit(1), F.size("l") - 1), lambda i: F.sqrt(F.pow(F.col("l")[i]["x"] - F.col("l")[i - 1]["x"], 2) + F.pow(F.col("l")[i]["y"] - F.col("l")[i - 1]["y"], 2)))
    return line.groupBy("id").agg(pts.alias("l")).select("id", big("n_points", F.size("l")), r6("degrees", F.aggregate(step, F.lit(0.0), lambda a, x: a + x)))


@query(TREE + f", q(id, node) AS (SELECT id, id FROM w UNION ALL SELECT q.id, g.parent FROM q JOIN g ON g.id = q.node) SELECT q.id, count(*) AS n_nodes, {s6('sum(x)', 'sum_x')}, {s6('sum(y)', 'sum_y')} FROM q JOIN road_node n ON n.id = q.node GROUP BY 1", "road_edge", "road_node")
def path_coordinates(spark, sf):
    """Places of the nodes on the routes from node 0."""
    paths = R.routes_to(R.shortest(edges(spark, sf), R.source_rows(spark, [0])))
    out = R.path_points(paths, S.road_node(spark, sf), ["id"])
    return out.groupBy("id").agg(F.count("*").alias("n_nodes"), F.sum("x").alias("sx"), F.sum("y").alias("sy")).select("id", "n_nodes", r6("sum_x", "sx"), r6("sum_y", "sy"))


@query(f", {from_node('0')} SELECT id, {s6('d', 'cost')} FROM r WHERE id = (SELECT max(id) FROM r)", "road_edge")
def landmark_search(spark, sf):
    """The last node's cost by a search that landmark bounds keep near the route."""
    e = saved(edges(spark, sf), "edges")
    n = S.road_node(spark, sf)
    goal = n.agg(F.max("id").alias("id"))
    bounds = saved(R.landmark_bound(prepared.landmarks(prepared.default_store(spark), "roads-landmarks", e, n, 2), goal).select("id", F.col("bound").alias("bound")), "bounds")
    return R.goal_directed(e, R.source_rows(spark, [0]).select("id"), goal, bounds).select("id", r6("cost"))


@query(f", {from_node('0')} SELECT id, {s6('d', 'cost')} FROM r WHERE id = (SELECT max(id) FROM r)", "road_edge")
def straight_line_search(spark, sf):
    """The last node's cost by a search that the straight distances left keep near the route."""
    e = saved(edges(spark, sf), "edges")
    n = S.road_node(spark, sf)
    goal = n.agg(F.max("id").alias("id"))
    bounds = saved(R.straight_bound(n, e, goal).select("id", "bound"), "bounds")
    return R.goal_directed(e, R.source_rows(spark, [0]).select("id"), goal, bounds).select("id", r6("cost"))


@query(", m AS (SELECT o_custkey AS id, row_number() OVER (ORDER BY min(o_orderkey)) AS pos FROM orders GROUP BY 1) SELECT c_custkey AS id, row_number() OVER (ORDER BY pos NULLS LAST, c_custkey) AS rank FROM customer LEFT JOIN m ON m.id = c_custkey", "grid")
def rank_by_order(spark, sf):
    """Customers in the order of their first orders, those without any behind."""
    first = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderkey").alias("pos"))
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("id"))
    return L.in_order(c, first, "id").select("id", big("rank"))


@query("SELECT station_id, obs_id FROM obs ORDER BY ((obs_id % 2147483647 + 42) * 48271) % 2147483647, obs_id LIMIT 200", "obs")
def sample_rows(spark, sf):
    return B.sample_rows(Q.obs(spark, sf), "obs_id", 200).select(*Q.key())


@query(f"SELECT station_id, obs_id, {s6('coalesce(nullif(e_price, 0), nullif(s_price, 0), 0.25)', 'price')} FROM obs", "obs")
def fill_chain(spark, sf):
    o = Q.obs(spark, sf).withColumn("other", F.nullif("s_price", F.lit(0.0)))
    return B.fill_chain(o, "e_price", ["other"], 0.25, zero_is_missing=True).select(*Q.key(), r6("price", "e_price"))


ORDERED = "a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_totalprice > 200000), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_totalprice < 50000)"


@query(f"WITH {ORDERED} SELECT 'either' AS part, count(*) AS n, {sb('sum(id)', 'ids')} FROM (SELECT id FROM a UNION SELECT id FROM b) UNION ALL SELECT 'first only', count(*), {sb('coalesce(sum(id), 0)', 'ids')} FROM (SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL SELECT 'both', count(*), {sb('coalesce(sum(id), 0)', 'ids')} FROM (SELECT id FROM a INTERSECT SELECT id FROM b)")
def set_operations(spark, sf):
    """Customers with a large order and with a small one: union, difference and intersection."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("id"), "o_totalprice")
    a, b = o.filter("o_totalprice > 200000").select("id").distinct(), o.filter("o_totalprice < 50000").select("id").distinct()
    parts = {"either": a.union(b).distinct(), "first only": a.join(b, "id", "left_anti"), "both": a.join(b, "id", "left_semi")}
    out = None
    for name, ids in parts.items():
        one = ids.agg(F.count("*").alias("n"), F.coalesce(F.sum("id"), F.lit(0)).alias("ids")).select(F.lit(name).alias("part"), "n", big("ids"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT u, string_agg(v::VARCHAR || ':' || (seconds::BIGINT)::VARCHAR, '|' ORDER BY v) AS near, count(*) AS n FROM road_edge GROUP BY u", "road_edge")
def adjacency(spark, sf):
    """Neighbours of each node as a delimited list, and their number from the list read back."""
    near = B.adjacency(edges(spark, sf))
    text = F.array_join(F.transform("near", lambda x: F.concat_ws(":", x["v"].cast("string"), x["w"].cast("long").cast("string"))), "|")
    return near.select("u", text.alias("near")).withColumn("n", F.size(F.split("near", "\\|")).cast("long"))


@query("SELECT station_id, obs_id, coalesce(printf('%.2f km', d / 7), '-') AS fixed, coalesce(printf('%.1f%%', nullif(occ, 0) * 100), '-') AS share, CASE WHEN d IS NULL THEN '-' WHEN d / 497 < 1 THEN printf('%.0f ms', d / 497 * 1000) ELSE printf('%.2f s', d / 497) END AS runtime, strftime(time, '%Y-%m-%dT%H:%M:%S') AS iso FROM (SELECT *, CASE WHEN duration > 50 THEN duration END AS d FROM obs)", "obs")
def formats(spark, sf):
    """Numbers as texts; short durations and empty stations count as missing here."""
    o = Q.obs(spark, sf)
    d = F.when(F.col("duration") > 50, F.col("duration"))
    return o.select(*Q.key(), format_fixed(d / 7, " km").alias("fixed"), format_percent(F.nullif("occ", F.lit(0.0))).alias("share"), format_runtime(d / 497).alias("runtime"), F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query(f"SELECT station_id FROM station WHERE NOT ({_ring_sql()} AND NOT {_border_sql('lon', 'lat')})", "station")
def outside_boundary(spark, sf):
    """Stations in the inverse mask of the service area."""
    rings = spark.createDataFrame([(0, 0, S.BOUNDARY)], "polygon int, ring int, points array<struct<lon:double,lat:double>>")
    return X.covered(S.station(spark, sf), B.mask_rings(rings)).select(big("station_id"))
