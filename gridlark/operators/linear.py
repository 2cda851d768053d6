"""Linear referencing on road edges: splitting at access points, access edges from a start, hulls, traces."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.operators.graph import hops
from gridlark.operators.iterate import saved


def access_name(c: Column) -> Column:
    return F.concat(F.lit("access_"), c.cast("string"))


def split_edges(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Directed edges (u, v, seconds, length_m) cut at points (station_id, u, v, t), t the share from u on.

    Points of an edge also cut the edge in the other direction, at 1 - t. Points at an end cut
    nothing off; points at one place share a node, that of the least station_id. Pieces share out
    seconds and length by their part of the edge.
    """
    both = points.select("station_id", "u", "v", "t").unionByName(points.select("station_id", F.col("v").alias("u"), F.col("u").alias("v"), (1 - F.col("t")).alias("t")))
    inner = both.filter((F.col("t") > 0) & (F.col("t") < 1)).groupBy("u", "v", "t").agg(F.min("station_id").alias("station_id"))
    cuts = inner.select("u", "v", "t", access_name(F.col("station_id")).alias("node"))
    keys = edges.select("u", "v")
    ends = keys.select("u", "v", F.lit(0.0).alias("t"), F.col("u").cast("string").alias("node")).unionByName(keys.select("u", "v", F.lit(1.0).alias("t"), F.col("v").cast("string").alias("node")))
    w = Window.partitionBy("u", "v").orderBy("t")
    seq = ends.unionByName(cuts.join(keys, ["u", "v"], "left_semi")).withColumns({"t2": F.lead("t").over(w), "to": F.lead("node").over(w)}).filter("t2 is not null")
    part = F.col("t2") - F.col("t")
    return seq.join(edges, ["u", "v"]).select(
        F.col("node").alias("from_node"), F.col("to").alias("to_node"), "u", "v", (F.row_number().over(w) - 1).alias("key"), (F.col("seconds") * part).alias("seconds"), (F.col("length_m") * part).alias("length_m"),
        F.col("t").alias("from_t"), F.col("t2").alias("to_t"),
    )


def access_nodes(points: DataFrame) -> DataFrame:
    """Rows (station_id, node): the name that split_edges gives a point's place; an end of the edge is the road node itself."""
    flip = F.col("u") > F.col("v")  # a place of a street is one place in both directions
    p = points.select("station_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.when(flip, 1 - F.col("t")).otherwise(F.col("t")).alias("t"))
    first = p.groupBy("u", "v", "t").agg(F.min("station_id").alias("first"))
    name = F.when(F.col("t") <= 0, F.col("u").cast("string")).when(F.col("t") >= 1, F.col("v").cast("string")).otherwise(access_name(F.col("first")))
    return p.join(first, ["u", "v", "t"]).select("station_id", name.alias("node"))


def start_on_pieces(pieces: DataFrame, u, v, t: float, name: str = "__start_access__") -> DataFrame:
    """Edges from a place on a street that is cut into pieces: to the end of the piece it lies on, either way."""

    def part(a, b, at: float) -> DataFrame:
        on = pieces.filter((F.col("u") == a) & (F.col("v") == b) & (F.col("from_t") <= at) & ((F.col("to_t") > at) | ((F.col("to_t") == 1) & (F.lit(at) >= 1))))
        left = (F.col("to_t") - at) / (F.col("to_t") - F.col("from_t"))
        return on.select(F.lit(name).alias("u"), F.col("to_node").alias("v"), (F.col("seconds") * left).alias("seconds"), (F.col("length_m") * left).alias("length_m"))

    return part(u, v, t).unionByName(part(v, u, 1 - t))


def start_edges(edges: DataFrame, u, v, t: float, name: str = "__start_access__") -> DataFrame:
    """Edges from a point at share t of u-v: on to v, and to u where the edge also runs back; the least time for each target."""
    on = edges.filter((F.col("u") == u) & (F.col("v") == v)).select(F.col("v").cast("string").alias("v"), (F.col("seconds") * (1 - t)).alias("seconds"), (F.col("length_m") * (1 - t)).alias("length_m"))
    back = edges.filter((F.col("u") == v) & (F.col("v") == u)).select(F.col("v").cast("string").alias("v"), (F.col("seconds") * t).alias("seconds"), (F.col("length_m") * t).alias("length_m"))
    best = on.unionByName(back).groupBy("v").agg(F.min_by(F.struct("seconds", "length_m"), "seconds").alias("e"))
    return best.select(F.lit(name).alias("u"), "v", "e.*")


def overlay(edges: DataFrame, extra: DataFrame) -> DataFrame:
    """The base graph with the few edges of one request."""
    return edges.select(F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"), "seconds", "length_m").unionByName(extra)


def substring(points: DataFrame, start: float, end: float, key: str = "edge") -> DataFrame:
    """Part of polylines (key, pos, x, y) between two shares of their planar length; reversed if end < start."""
    a, b = min(start, end), max(start, end)
    w = Window.partitionBy(key).orderBy("pos")
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    p = points.withColumn("d", F.coalesce(step, F.lit(0.0)))
    p = p.withColumn("at", F.sum("d").over(w)).withColumn("whole", F.sum("d").over(Window.partitionBy(key)))
    p = p.withColumn("f", F.when(F.col("whole") > 0, F.col("at") / F.col("whole")).otherwise(0.0))
    p = p.withColumns({"nf": F.lead("f").over(w), "nx": F.lead("x").over(w), "ny": F.lead("y").over(w)})
    inside = p.filter((F.col("f") > a) & (F.col("f") < b)).select(key, "f", "x", "y")
    for s in (a, b):
        r = (F.lit(s) - F.col("f")) / F.when(F.col("nf") > F.col("f"), F.col("nf") - F.col("f"))
        hit = p.filter(F.col("nf").isNotNull() & (F.col("f") <= s) & ((F.col("nf") > s) | (F.col("nf") == 1.0)) & (F.col("nf") >= s))
        cut = hit.select(key, F.lit(s).alias("f"), (F.col("x") + F.coalesce(r, F.lit(0.0)) * (F.col("nx") - F.col("x"))).alias("x"), (F.col("y") + F.coalesce(r, F.lit(0.0)) * (F.col("ny") - F.col("y"))).alias("y"))
        inside = inside.unionByName(cut.dropDuplicates([key]))
    order = Window.partitionBy(key).orderBy(F.col("f").desc() if end < start else F.col("f"))
    return inside.withColumn("pos", F.row_number().over(order) - 1).select(key, "pos", "x", "y")


def _hull(pts: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of sorted points, counter-clockwise from the lowest left; what bends by less than a billionth of the extent's square is straight."""
    if len(pts) < 3:
        return pts
    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
    tol = 1e-9 * max(max(xs) - min(xs), max(ys) - min(ys)) ** 2

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= tol:
                out.pop()
            out.append(p)
        return out

    return half(pts)[:-1] + half(pts[::-1])[:-1]


def convex_hull(points: DataFrame, by: str, strips: int = 256) -> DataFrame:
    """Corners (by, pos, x, y) of each group's hull, counter-clockwise from the lowest left, without corners that are straight but for rounding.

    Of each strip of a group's width only the extreme places stay: its lowest and highest at either end of it and between. They are
    found by aggregates: the extremes of y for each x, then, in a strip, its hull. So a task holds one strip, then a group's strips' corners.
    """
    low = points.groupBy(by, "x").agg(F.min("y").alias("y"))
    high = points.groupBy(by, "x").agg(F.max("y").alias("y"))
    thin = low.unionByName(high).distinct()
    extent = thin.groupBy(by).agg(F.min("x").alias("_a"), F.max("x").alias("_b"))
    strip = F.coalesce(F.floor(F.try_divide((F.col("x") - F.col("_a")) * strips, F.col("_b") - F.col("_a"))), F.lit(0))
    thin = thin.join(extent, by).withColumn("_strip", strip).drop("_a", "_b")
    kind = dict(points.dtypes)[by]

    def corners(g: pd.DataFrame) -> pd.DataFrame:
        ring = _hull(sorted(zip(g.x, g.y, strict=True)))
        return pd.DataFrame({by: [g[by].iloc[0]] * len(ring), "pos": range(len(ring)), "x": [p[0] for p in ring], "y": [p[1] for p in ring]})

    schema = f"{by} {kind}, pos int, x double, y double"
    few = thin.groupBy(by, "_strip").applyInPandas(corners, schema)
    return few.groupBy(by).applyInPandas(corners, schema)


def frontiers(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Nodes first reached in each step of a breadth-first search: rows (source, step, n, first_node)."""
    h = hops(edges, sources)
    return h.filter("hops > 0").groupBy("source", F.col("hops").alias("step")).agg(F.count("*").alias("n"), F.min("id").alias("first_node"))


def bidirectional_hops(edges: DataFrame, start, goal) -> tuple[int | None, object]:
    """Fewest edges from start to goal and a node in the middle of such a route; (None, None) if there is none.

    Levels grow from both ends, always on the side with the smaller frontier, until they touch: a node that is in both
    closes a shortest route, and no level behind the touching ones is ever expanded.
    """
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["u"]
    e = saved(edges.select("u", "v").distinct(), "links")
    side = [e, e.select(F.col("v").alias("u"), F.col("u").alias("v"))]
    seen = [spark.createDataFrame([(x,)], f"id {kind}") for x in (start, goal)]
    front, size, depth = list(seen), [1, 1], [0, 0]
    while True:
        touch = front[0].join(seen[1], "id").unionByName(front[1].join(seen[0], "id")).agg(F.min("id").alias("id")).first()
        if touch.id is not None:
            return depth[0] + depth[1], touch.id
        if not all(size):
            return None, None
        k = int(size[1] < size[0])
        nxt = front[k].join(side[k], front[k]["id"] == side[k]["u"]).select(F.col("v").alias("id")).distinct().join(seen[k], "id", "left_anti")
        front[k] = saved(nxt, "front")
        seen[k] = seen[k].unionByName(front[k])
        size[k] = front[k].count()
        depth[k] += 1


def without_repeats(events: DataFrame, value: str, by: str, order: str) -> DataFrame:
    """Rows whose value differs from the row before."""
    w = Window.partitionBy(by).orderBy(order)
    return events.withColumn("_same", F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1)).filter("not _same").drop("_same")


def keyed_union(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Union in which the later part's row of a key wins."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_o", F.lit(i))
        out = p if out is None else out.unionByName(p)
    cols = [c for c in parts[0].columns if c not in key]
    return out.groupBy(*key).agg(F.max_by(F.struct(*cols), "_o").alias("r")).select(*key, "r.*")


def in_order(items: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """Items by the place of their id in an order (pos, id); others behind, by id. Only what an order names is numbered by it;
    the others are ranked in range partitions."""
    from gridlark.operators.metrics import range_rank

    o = order.select(F.col("id").alias(key), "pos")
    named = saved(items.join(o, key), "named")
    rest = items.join(o.select(key), key, "left_anti")
    n = named.count()
    head = range_rank(named, "pos", "rank")
    tail = range_rank(rest, key, "rank").withColumn("rank", F.col("rank") + n)
    return head.drop("pos").unionByName(tail)
