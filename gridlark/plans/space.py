"""Spatial queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlark.functions import geo as G
from gridlark.operators import dissolve as D
from gridlark.operators import profiles as P
from gridlark.operators import spatial as X
from gridlark.operators.constraints import Limits
from gridlark.operators.iterate import saved
from gridlark.operators.recommend import candidates, snap
from gridlark.plans import series as Q
from gridlark.plans.helpers import big, r6, s6, sb
from gridlark.sources import scenario as S

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = (f"WITH {S.ctes(*views)}" + ("" if sql.startswith(",") else " ") if views else "") + sql
        return f

    return add


def hav(a: str, b: str, c: str, d: str) -> str:
    """Distance in SQL of (lat a, lon b) and (lat c, lon d)."""
    return f"(2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


USER = hav(f"{S.USER_LAT}::DOUBLE", f"{S.USER_LON}::DOUBLE", "lat", "lon")
PAIR = hav("a.lat", "a.lon", "b.lat", "b.lon")


@query(f"SELECT station_id, {s6('d', 'straight_km')} FROM (SELECT *, {USER} AS d FROM station) WHERE d <= 10 ORDER BY d, station_id LIMIT 20", "station")
def candidate_topk(spark, sf):
    return candidates(S.station(spark, sf), S.USER_LON, S.USER_LAT, Limits()).select(big("station_id"), r6("straight_km"))


KINDS = ["lifestyle_services", "business_residential", "food_beverage"]
_counts = f"n AS (SELECT a.station_id, count(*) AS total, {', '.join(f'count(*) FILTER (b.kind = {chr(39)}{k}{chr(39)}) AS {k}' for k in KINDS)} FROM station a JOIN poi b ON {PAIR} <= 2 GROUP BY 1)"


@query(f", {_counts} SELECT s.station_id, coalesce(total, 0) AS total, {', '.join(f'coalesce({k}, 0) AS {k}' for k in KINDS)} FROM station s LEFT JOIN n USING (station_id)", "station", "poi")
def radius_poi_counts(spark, sf):
    return X.count_within(S.station(spark, sf), S.poi(spark, sf), 2.0, KINDS).select(big("station_id"), big("total"), *[big(k) for k in KINDS])


@query(f", {_counts} SELECT s.station_id, {', '.join(s6(f'coalesce({k} / nullif(total, 0)::DOUBLE, 0)', k + '_ratio') for k in KINDS)} FROM station s LEFT JOIN n USING (station_id)", "station", "poi")
def poi_ratios(spark, sf):
    n = X.count_within(S.station(spark, sf), S.poi(spark, sf), 2.0, KINDS)
    return n.select(big("station_id"), *[r6(f"{k}_ratio", F.coalesce(F.try_divide(F.col(k).cast("double"), F.col("total")), F.lit(0.0))) for k in KINDS])


@query(f"SELECT charge_count, {', '.join(f'count(*) FILTER (kind = {chr(39)}{k}{chr(39)}) AS {k}' for k in KINDS)} FROM station a JOIN poi b ON a.station_id = b.poi_id % 1000 GROUP BY 1", "station", "poi")
def poi_pivot(spark, sf):
    j = S.station(spark, sf).select("station_id", "charge_count").join(S.poi(spark, sf).select((F.col("poi_id") % 1000).alias("station_id"), "kind"), "station_id")
    return j.groupBy("charge_count").pivot("kind", KINDS).count().na.fill(0).select(big("charge_count"), *[big(k) for k in KINDS])


@query(f"SELECT a.station_id, b.station_id AS neighbor_id, {s6(PAIR, 'distance_km')}, row_number() OVER (PARTITION BY a.station_id ORDER BY {PAIR}, b.station_id) AS rank FROM station a JOIN station b ON a.station_id <> b.station_id AND {PAIR} <= 5", "station")
def radius_neighbors(spark, sf):
    return X.radius_neighbors(S.station(spark, sf), 5.0).select(big("station_id"), big("neighbor_id"), r6("distance_km"), big("rank"))


KNN = f"k AS (SELECT * FROM (SELECT a.station_id, b.station_id AS neighbor_id, {PAIR} AS d, row_number() OVER (PARTITION BY a.station_id ORDER BY {PAIR}, b.station_id) AS rank FROM station a JOIN station b ON a.station_id <> b.station_id) WHERE rank <= 5)"


@query(f", {KNN} SELECT station_id, neighbor_id, {s6('d', 'distance_km')}, rank FROM k", "station")
def knn_neighbors(spark, sf):
    return X.knn(S.station(spark, sf), 5).select(big("station_id"), big("neighbor_id"), r6("distance_km"), big("rank"))


@query(
    f", {KNN}, p AS (SELECT station_id, avg(occ) AS v FROM obs GROUP BY 1), n AS (SELECT k.station_id, avg(v) AS m, max(v) AS x, count(v) AS c FROM k JOIN p ON p.station_id = k.neighbor_id GROUP BY 1) "
    f"SELECT p.station_id, {s6('coalesce(m, v)', 'neighbor_mean')}, {s6('coalesce(x, v)', 'neighbor_max')}, {sb('coalesce(c, 0)', 'neighbor_count')} FROM p LEFT JOIN n USING (station_id)", "station", "obs",
)
def neighbor_features(spark, sf):
    k = X.knn(S.station(spark, sf), 5).select("station_id", "neighbor_id")
    p = Q.obs(spark, sf).groupBy("station_id").agg(F.avg("occ").alias("avg_occ"))
    return P.neighbor_features(k, p).select(big("station_id"), r6("neighbor_mean"), r6("neighbor_max"), big("neighbor_count"))


def _ring_sql() -> str:
    """Crossing parity in SQL."""
    out = []
    for (ax, ay), (bx, by) in zip(S.BOUNDARY, [*S.BOUNDARY[1:], S.BOUNDARY[0]], strict=True):
        out.append(f"(CASE WHEN (({ay}::DOUBLE > lat) <> ({by}::DOUBLE > lat)) AND lon < {ax}::DOUBLE + (lat - {ay}::DOUBLE) * {bx - ax!r}::DOUBLE / {by - ay!r}::DOUBLE THEN 1 ELSE 0 END)")
    return "(" + " + ".join(out) + ") % 2 = 1"


def _border_sql(lon: str, lat: str) -> str:
    """Whether a place is on the border, by its distance from each side."""
    out = []
    for (ax, ay), (bx, by) in zip(S.BOUNDARY, [*S.BOUNDARY[1:], S.BOUNDARY[0]], strict=True):
        dx, dy = bx - ax, by - ay
        t = f"greatest(0, least(1, (({lon} - {ax}::DOUBLE) * {dx!r}::DOUBLE + ({lat} - {ay}::DOUBLE) * {dy!r}::DOUBLE) / {dx * dx + dy * dy!r}::DOUBLE))"
        out.append(f"sqrt(pow({lon} - ({ax}::DOUBLE + {t} * {dx!r}::DOUBLE), 2) + pow({lat} - ({ay}::DOUBLE + {t} * {dy!r}::DOUBLE), 2)) <= 1e-12::DOUBLE")
    return "(" + " OR ".join(out) + ")"


# Corners of the area stand beside the stations, with negative numbers: they lie on the border.
CORNERS = ", ".join(f"({-1 - i}, {x}::DOUBLE, {y}::DOUBLE)" for i, (x, y) in enumerate(S.BOUNDARY))


@query(f", p AS (SELECT station_id, lon, lat FROM station UNION ALL SELECT * FROM (VALUES {CORNERS}) v(station_id, lon, lat)) SELECT station_id FROM p WHERE {_ring_sql()} OR {_border_sql('lon', 'lat')}", "station")
def points_in_boundary(spark, sf):
    corners = spark.createDataFrame([(-1 - i, x, y) for i, (x, y) in enumerate(S.BOUNDARY)], "station_id long, lon double, lat double")
    rings = spark.createDataFrame([(0, 0, S.BOUNDARY)], "polygon int, ring int, points array<struct<lon:double,lat:double>>")
    return X.covered(S.station(spark, sf).select("station_id", "lon", "lat").unionByName(corners), rings).select(big("station_id"))


@query(f"SELECT station_id, {_ring_sql()} AS inside FROM station", "station")
def points_in_ring_halfopen(spark, sf):
    return S.station(spark, sf).select(big("station_id"), G.in_ring(F.col("lon"), F.col("lat"), S.BOUNDARY).alias("inside"))


@query(f"SELECT {s6('min(lon) - 0.01', 'west')}, {s6('min(lat) - 0.01', 'south')}, {s6('max(lon) + 0.01', 'east')}, {s6('max(lat) + 0.01', 'north')} FROM station", "station")
def bounds_padded(spark, sf):
    return S.station(spark, sf).agg(r6("west", F.min("lon") - 0.01), r6("south", F.min("lat") - 0.01), r6("east", F.max("lon") + 0.01), r6("north", F.max("lat") + 0.01))


@query(
    f", b AS (SELECT min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM station) SELECT i AS tile_x, j AS tile_y, {s6('greatest(w, w + i * (e - w) / 4 - 0.005)', 'west')}, {s6('least(e, w + (i + 1) * (e - w) / 4 + 0.005)', 'east')}, "
    f"{s6('greatest(s, s + j * (n - s) / 3 - 0.005)', 'south')}, {s6('least(n, s + (j + 1) * (n - s) / 3 + 0.005)', 'north')} FROM b, range(4) x(i), range(3) y(j)", "station",
)
def tile_grid(spark, sf):
    b = S.station(spark, sf).agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"))
    cells = spark.range(4).withColumnRenamed("id", "tile_x").crossJoin(spark.range(3).withColumnRenamed("id", "tile_y"))  # twelve tiles
    g = b.crossJoin(cells)
    cut = lambda lo, hi, i, n: F.col(lo) + i * (F.col(hi) - F.col(lo)) / n
    x, y = F.col("tile_x"), F.col("tile_y")
    return g.select(
        "tile_x", "tile_y", r6("west", F.greatest(F.col("w"), cut("w", "e", x, 4) - 0.005)), r6("east", F.least(F.col("e"), cut("w", "e", x + 1, 4) + 0.005)),
        r6("south", F.greatest(F.col("s"), cut("s", "n", y, 3) - 0.005)), r6("north", F.least(F.col("n"), cut("s", "n", y + 1, 3) + 0.005)),
    )


# Planar places, metres from a corner, taken to degrees; the same formula in SQL.
_MX, _MY = "(12660000 + station_id * 7919 % 90000)::DOUBLE", "(2560000 + station_id * 6101 % 50000)::DOUBLE"


@query(f"SELECT station_id, {s6(f'degrees({_MX} / 6378137)', 'lon')}, {s6(f'degrees(2 * atan(exp({_MY} / 6378137)) - pi() / 2)', 'lat')} FROM station", "station")
def mercator_inverse(spark, sf):
    s = F.col("station_id")
    lon, lat = G.mercator_to_wgs84((12_660_000 + s * 7919 % 90_000).cast("double"), (2_560_000 + s * 6101 % 50_000).cast("double"))
    return S.station(spark, sf).select(big("station_id"), r6("lon", lon), r6("lat", lat))


def _gcj_sql() -> tuple[str, str]:
    x, y = "(lon - 105)", "(lat - 35)"
    rip = f"(20 * sin(6 * {x} * pi()) + 20 * sin(2 * {x} * pi())) * 2 / 3"
    dlat = f"(-100 + 2 * {x} + 3 * {y} + 0.2 * {y} * {y} + 0.1 * {x} * {y} + 0.2 * sqrt(abs({x})) + {rip} + (20 * sin({y} * pi()) + 40 * sin({y} / 3 * pi())) * 2 / 3 + (160 * sin({y} / 12 * pi()) + 320 * sin({y} * pi() / 30)) * 2 / 3)"
    dlon = f"(300 + {x} + 2 * {y} + 0.1 * {x} * {x} + 0.1 * {x} * {y} + 0.1 * sqrt(abs({x})) + {rip} + (20 * sin({x} * pi()) + 40 * sin({x} / 3 * pi())) * 2 / 3 + (150 * sin({x} / 12 * pi()) + 300 * sin({x} / 30 * pi())) * 2 / 3)"
    a, ee = "6378245.0::DOUBLE", "0.00669342162296594323::DOUBLE"
    m = f"(1 - {ee} * sin(radians(lat)) * sin(radians(lat)))"
    return f"lon + {dlon} * 180 / ({a} / sqrt({m}) * cos(radians(lat)) * pi())", f"lat + {dlat} * 180 / (({a} * (1 - {ee})) / ({m} * sqrt({m})) * pi())"


@query(f"SELECT station_id, {s6(_gcj_sql()[0], 'lon')}, {s6(_gcj_sql()[1], 'lat')} FROM station", "station")
def gcj02(spark, sf):
    lon, lat = G.wgs84_to_gcj02(F.col("lon"), F.col("lat"))
    return S.station(spark, sf).select(big("station_id"), r6("lon", lon), r6("lat", lat))


SEG = (
    "seg AS (SELECT u, v, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM road_pair JOIN road_node a ON a.id = u JOIN road_node b ON b.id = v), "
    "pr AS (SELECT station_id, lon, lat, u, v, ax, ay, bx, b_y, greatest(0, least(1, ((lon - ax) * (bx - ax) + (lat - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)))) AS t FROM station, seg), "
    "sn AS (SELECT * FROM (SELECT *, ax + t * (bx - ax) AS px, ay + t * (b_y - ay) AS py, row_number() OVER (PARTITION BY station_id ORDER BY round(sqrt((lon - (ax + t * (bx - ax))) * (lon - (ax + t * (bx - ax))) + (lat - (ay + t * (b_y - ay))) * (lat - (ay + t * (b_y - ay)))), 12), u, v) AS rn FROM pr) WHERE rn = 1)"
)


@query(f", {SEG} SELECT station_id, u, v, {s6('t', 'fraction')}, {s6(hav('lat', 'lon', 'py', 'px') + ' * 1000', 'snap_m')} FROM sn", "station", "road_node", "road_pair")
def nearest_edge_snap(spark, sf):
    out = snap(S.station(spark, sf), S.road_node(spark, sf), S.road_edge(spark, sf))
    return out.select(big("station_id"), big("u"), big("v"), r6("fraction", "t"), r6("snap_m"))


# Union area by strips between neighbouring borders in x: in a strip, squares that span it are intervals of y.
SQUARES = (
    ", sq AS (SELECT round(lon - 0.012, 9) AS x1, round(lon + 0.012, 9) AS x2, round(lat - 0.012, 9) AS y1, round(lat + 0.012, 9) AS y2 FROM station), xs AS (SELECT x, lead(x) OVER (ORDER BY x) AS x_next FROM (SELECT x1 AS x FROM sq UNION SELECT x2 FROM sq)), "
    "i AS (SELECT x, x_next, y1, y2, max(y2) OVER (PARTITION BY x ORDER BY y1, y2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM xs JOIN sq ON sq.x1 <= x AND sq.x2 >= x_next WHERE x_next IS NOT NULL)"
)


@query(SQUARES + f" SELECT {s6('sum((x_next - x) * greatest(0, y2 - greatest(y1, coalesce(seen, y1)))) * 1000', 'area')} FROM i", "station")
def dissolved_area(spark, sf):
    """Area of the union of squares around all stations, in thousandths of a square degree, from the rings of the union."""
    s = S.station(spark, sf)
    corner = lambda a, b: F.struct(F.round(F.col("lon") + a, 9).alias("lon"), F.round(F.col("lat") + b, 9).alias("lat"))
    d = 0.012
    rings = s.select(F.col("station_id").alias("polygon"), F.lit(0).alias("ring"), F.array(corner(-d, -d), corner(d, -d), corner(d, d), corner(-d, d)).alias("points"))
    u = saved(D.dissolve(rings), "union")
    nxt = u.select("ring", (F.col("pos") - 1).alias("pos"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    first = u.filter("pos = 0").select("ring", F.col("x").alias("x0"), F.col("y").alias("y0"))
    side = u.join(first, "ring").join(nxt, ["ring", "pos"], "left").select((F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"), (F.coalesce("x2", "x0") - F.col("x0")).alias("x2"), (F.coalesce("y2", "y0") - F.col("y0")).alias("y2"))
    return side.agg((F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y")) / 2 * 1000).alias("area")).select(r6("area"))
