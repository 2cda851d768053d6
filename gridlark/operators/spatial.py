"""Spatial joins on grid cells: radius, nearest neighbours, nearest segment, containment.

Cells turn a distance predicate into an equi-join, so both sides are dealt by cell. Longitude
cells are as wide as a band of latitude needs, so a radius always spans two cells at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.functions.geo import degrees_of, haversine_km, projection_fraction, segment_distance
from gridlark.operators.iterate import saved

GLOBE_KM = 20_040.0  # no two places are farther apart


def _width(band: Column, size: float) -> Column:
    edge = F.least(F.lit(89.0), (F.abs(band) + 2) * size)
    return F.lit(size) / F.cos(F.radians(edge))


def with_cell(df: DataFrame, lon: str, lat: str, size: float) -> DataFrame:
    band = F.floor(F.col(lat) / size)
    return df.withColumn("_band", band).withColumn("_cell", F.floor(F.col(lon) / _width(band, size)))


def with_near_cells(df: DataFrame, lon: str, lat: str, size: float) -> DataFrame:
    """Each row once for every cell that may hold a point within `size` degrees of latitude."""
    band = F.floor(F.col(lat) / size)
    out = df.withColumn("_band", F.explode(F.array(band - 1, band, band + 1)))
    w = _width(F.col("_band"), size)
    return out.withColumn("_cell", F.explode(F.sequence(F.floor((F.col(lon) - w) / w), F.floor((F.col(lon) + w) / w))))


def radius_join(a: DataFrame, b: DataFrame, km: float, a_id: str, b_id: str) -> DataFrame:
    """Pairs (ids, distance_km) of points at most km apart; both sides have lon and lat."""
    size = degrees_of(km)
    x = with_near_cells(a.select(a_id, F.col("lon").alias("_x"), F.col("lat").alias("_y")), "_x", "_y", size)
    y = with_cell(b.select(F.col(b_id).alias(b_id if b_id != a_id else f"{b_id}_2"), "lon", "lat"), "lon", "lat", size)
    out = x.join(y, ["_band", "_cell"]).withColumn("distance_km", haversine_km(F.col("_y"), F.col("_x"), F.col("lat"), F.col("lon")))
    return out.filter(F.col("distance_km") <= km).select(a_id, b_id if b_id != a_id else f"{b_id}_2", "distance_km")


def radius_neighbors(stations: DataFrame, km: float, part: int = 1 << 12) -> DataFrame:
    """Other stations within km, ranked by distance, then id.

    Places meet places, and the stations around a place are ordered once, for all that share it: each leaves itself out, and those behind itself move up by one.
    Pairs are made last, where the places' stations meet parts of at most `part` rows of its list, so no pair of stations is ever shuffled or sorted.
    """
    stations = saved(stations.filter("lon is not null and lat is not null").select("station_id", "lon", "lat"), "around")
    places = saved(stations.groupBy("lon", "lat").agg(F.min("station_id").alias("place")), "around-places")
    ids = saved(stations.join(places, ["lon", "lat"]).select("place", "station_id"), "around-ids")
    near = radius_join(places, places, km, "place", "place").withColumnRenamed("place_2", "there")
    w = Window.partitionBy("place").orderBy("distance_km", "neighbor_id")
    lists = near.join(ids.select(F.col("place").alias("there"), F.col("station_id").alias("neighbor_id")), "there").select("place", "neighbor_id", "distance_km")
    lists = lists.withColumn("at", F.row_number().over(w)).withColumn("_part", F.floor((F.col("at") - 1) / part))
    lists = saved(lists, "around-lists")
    parts = lists.select("place", "_part").distinct()
    pairs = ids.join(parts, "place").join(lists, ["place", "_part"]).filter("station_id <> neighbor_id")
    behind = (F.col("distance_km") > 0) | (F.col("neighbor_id") > F.col("station_id"))  # a station is in its own list, at distance 0
    return pairs.select("station_id", "neighbor_id", "distance_km", (F.col("at") - behind.cast("int")).alias("rank"))


def _radius_for(stations: DataFrame, k: int) -> float:
    """A radius in km that holds about twice k stations where they are spread evenly over their bounds."""
    b = stations.agg(F.count("*").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("t")).first()
    high, wide = (b.t - b.s) * 111.2, (b.e - b.w) * 111.2 * math.cos(math.radians((b.s + b.t) / 2))
    return max(0.05, math.sqrt(2 * (k + 1) * max(high, 0.05) * max(wide, 0.05) / (math.pi * b.n)))


def knn(stations: DataFrame, k: int, start_km: float | None = None) -> DataFrame:
    """The k nearest other stations of each, by distance, then id.

    Radius joins, the first radius from the density of places, then four times as wide for places that have not
    found k yet: only those go on. The last radius spans the globe. Stations of one place have the same nearest k + 1 stations, of which each leaves itself
    out, and of a place no more than its k + 1 least ids can be among them: so places meet places, and a crowded one makes no more pairs.
    """
    n = stations.count()
    k = min(k, n - 1)
    if k <= 0:
        empty = stations.limit(0)
        return empty.select("station_id", F.col("station_id").alias("neighbor_id"), F.lit(0.0).alias("distance_km"), F.lit(0).alias("rank"))
    stations = saved(stations.select("station_id", "lon", "lat"), "knn-all")
    order = Window.partitionBy("lon", "lat").orderBy("station_id")
    some = saved(stations.withColumn("_i", F.row_number().over(order)).filter(F.col("_i") <= k + 1), "knn-some")
    places = some.filter("_i = 1").drop("_i")
    ids = some.join(places.select(F.col("station_id").alias("place"), "lon", "lat"), ["lon", "lat"]).select("place", F.col("station_id").alias("neighbor_id"))
    todo, km, out = places, start_km or _radius_for(places, k), None
    w = Window.partitionBy("station_id").orderBy("distance_km", "neighbor_id")
    while True:
        near = radius_join(todo, places, km, "station_id", "station_id").withColumnRenamed("station_id_2", "place")
        top = saved(near.join(ids, "place").drop("place").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k + 1), "knn")
        done = top.filter(F.col("rank") == k + 1).select("station_id")
        part = top.join(done, "station_id", "left_semi")
        out = part if out is None else out.unionByName(part)
        if km >= GLOBE_KM:
            break
        todo = saved(todo.join(done, "station_id", "left_anti"), "knn-left")
        if todo.isEmpty():
            break
        km = min(4 * km, GLOBE_KM)
    lists = out.join(places, "station_id").select("lon", "lat", "neighbor_id", "distance_km")
    all_ = stations.join(lists, ["lon", "lat"]).filter("station_id <> neighbor_id").select("station_id", "neighbor_id", "distance_km")
    return all_.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def count_within(stations: DataFrame, poi: DataFrame, km: float, kinds: list[str]) -> DataFrame:
    """Points within km of each station, in all and by kind; 0 where there are none.

    Places meet places, each with the counts of its points, so the pairs do not grow with the stations and points that share one.
    """
    here = stations.filter("lon is not null and lat is not null").groupBy("lon", "lat").agg(F.min("station_id").alias("station_id"))
    there = poi.groupBy("lon", "lat").agg(F.min("poi_id").alias("poi_id"), F.count("*").alias("total"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    here, there = saved(here, "places"), saved(there, "points")
    near = radius_join(here, there, km, "station_id", "poi_id").join(there.drop("lon", "lat"), "poi_id")
    agg = here.join(near.groupBy("station_id").agg(*[F.sum(c).alias(c) for c in ("total", *kinds)]), "station_id").drop("station_id")
    return stations.select("station_id", "lon", "lat").join(agg, ["lon", "lat"], "left").drop("lon", "lat").na.fill(0)


def nearest_segment(points: DataFrame, segments: DataFrame, point_id: str = "station_id") -> DataFrame:
    """The segment (u, v) nearest to each point in planar degrees, ties by (u, v); with the projection.

    Segments are cut into pieces no longer than a cell, and go into all cells of the pieces' bounding boxes; points go
    into the cells around them. A hit counts once it is no farther than the ring that was searched, others go on with
    larger cells. The first cell is twice the median segment, so a few long segments do not widen it. Points of one place are sought once.
    """
    long = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))
    span = segments.agg(F.percentile_approx(long, 0.5, 1000)).first()[0]
    size = max(2 * float(span or 0.0), 1e-4)
    todo, out = saved(points.filter("lon is not null and lat is not null").select("lon", "lat").distinct(), "places"), None
    for _ in range(40):
        s = F.lit(size)
        n = F.greatest(F.lit(1), F.ceil(long / s).cast("int"))
        cells = segments.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        ends = lambda a, b: [F.col(a) + (F.col(b) - F.col(a)) * k / F.col("_n") for k in (F.col("_i"), F.col("_i") + 1)]
        for c, (a, b) in (("_cx", ends("ax", "bx")), ("_cy", ends("ay", "by"))):
            cells = cells.withColumn(c, F.explode(F.sequence(F.floor(F.least(a, b) / s), F.floor(F.greatest(a, b) / s))))
        p = todo.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("lon") / s) - 1, F.floor(F.col("lon") / s) + 1)))
        p = p.withColumn("_cy", F.explode(F.sequence(F.floor(F.col("lat") / s) - 1, F.floor(F.col("lat") / s) + 1)))
        args = [F.col(c) for c in ("lon", "lat", "ax", "ay", "bx", "by")]
        d = F.round(segment_distance(*args), 12)
        t = projection_fraction(*args)
        best = p.join(cells.hint("merge"), ["_cx", "_cy"]).groupBy("lon", "lat").agg(F.min(F.struct(d.alias("d"), F.col("u").alias("u"), F.col("v").alias("v"), t.alias("t"), (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("px"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("py"))).alias("b"))
        part = saved(best.filter(F.col("b.d") <= size).select("lon", "lat", "b.*"), "nearest")
        out = part if out is None else out.unionByName(part)
        todo = todo.join(part, ["lon", "lat"], "left_anti")
        if todo.isEmpty():
            break
        size *= 4
    return points.select(point_id, "lon", "lat").join(out, ["lon", "lat"]).drop("lon", "lat")


def ring_segments(rings: DataFrame) -> DataFrame:
    """Segments (polygon, ring, ax, ay, bx, by) of closed rings (polygon, ring, points), points an array of (lon, lat)."""
    n = F.size("points")
    i = F.explode(F.sequence(F.lit(0), n - 1)).alias("i")
    p = rings.filter(n > 0).select("polygon", "ring", "points", i).select("polygon", "ring", F.col("points")[F.col("i")].alias("a"), F.col("points")[(F.col("i") + 1) % n].alias("b"))
    return p.select("polygon", "ring", F.col("a.lon").alias("ax"), F.col("a.lat").alias("ay"), F.col("b.lon").alias("bx"), F.col("b.lat").alias("by"))


def covered(points: DataFrame, rings: DataFrame, point_id: str = "station_id", tolerance: float = 1e-12) -> DataFrame:
    """Points (by id, lon, lat) that any polygon (ring 0, less its other rings) covers; borders count as inside.

    Points meet the border segments of their band of latitude only, of polygons that reach their strip of longitude, and count the crossings east of
    them, so the work grows with the segments around a point, not with all borders. Bands are as high as the median segment that is not level; no segment goes
    into more than 257 bands, no polygon into more than 65 strips, and cells are joined by shuffles.
    """
    seg = saved(ring_segments(rings), "rings")
    high = F.abs(F.col("by") - F.col("ay"))
    span = seg.agg(F.percentile_approx(F.when(high > 0, high), 0.5, 1000).alias("mid"), F.max(high).alias("top")).first()
    size = F.lit(max(2 * float(span.mid or 0.0), float(span.top or 0.0) / 256, 1e-6))
    reach = saved(seg.groupBy("polygon").agg((F.min("ax") - tolerance).alias("_w"), (F.max("ax") + tolerance).alias("_e")), "reach")
    wide = reach.agg(F.percentile_approx(F.col("_e") - F.col("_w"), 0.5, 1000).alias("mid"), F.max(F.col("_e") - F.col("_w")).alias("top")).first()
    strip = F.lit(max(float(wide.mid or 0.0), float(wide.top or 0.0) / 64, 1e-6))
    low, high = F.least("ay", "by") - tolerance, F.greatest("ay", "by") + tolerance
    seg = seg.join(reach.hint("merge"), "polygon").withColumn("_band", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
    seg = seg.withColumn("_strip", F.explode(F.sequence(F.floor(F.col("_w") / strip), F.floor(F.col("_e") / strip))))
    own = points.select(point_id, "lon", "lat").withColumn("_band", F.floor(F.col("lat") / size)).withColumn("_strip", F.floor(F.col("lon") / strip))
    own = own.join(seg.hint("merge"), ["_band", "_strip"]).filter("lon between _w and _e")
    x = F.col("ax") + (F.col("lat") - F.col("ay")) * (F.col("bx") - F.col("ax")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0))
    cross = ((F.col("ay") > F.col("lat")) != (F.col("by") > F.col("lat"))) & (F.col("lon") < x)
    touch = segment_distance(*[F.col(c) for c in ("lon", "lat", "ax", "ay", "bx", "by")]) <= tolerance
    ring = own.groupBy(point_id, "lon", "lat", "polygon", "ring").agg((F.count_if(cross) % 2 == 1).alias("odd"), F.max(touch).alias("on"))
    inside = F.max(F.when(F.col("ring") == 0, F.col("odd") | F.col("on")).otherwise(False))
    hole = F.max(F.when(F.col("ring") > 0, F.col("odd") & ~F.col("on")).otherwise(False))
    return ring.groupBy(point_id, "lon", "lat", "polygon").agg(inside.alias("i"), hole.alias("h")).filter("i and not h").select(point_id, "lon", "lat").distinct()
