"""Union of polygons: borders cut where they meet, pieces with cover on both sides dropped, the rest chained to rings.

Segments meet only those of their grid cells, and those that run through cells deep inside a polygon go first. A piece stays if just one of its sides is covered, so shared and inner borders go; it is
turned so that the cover lies to its left. Rings are found by doubling along the chain of pieces, so no task ever holds a whole ring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.operators.iterate import saved
from gridlark.operators.spatial import covered, ring_segments

DIGITS = 9  # of degrees: what rounds alike is one place
ASIDE = 1e-7  # degrees from a piece's middle to the places that tell its sides


def _cells(seg: DataFrame, size: float) -> DataFrame:
    """Rows (sid, cx, cy): all cells of the boxes of a segment's parts, none of which is longer than a cell."""
    s, n = F.lit(size), F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))) / size).cast("int"))
    out = seg.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    for c, a, b in (("cx", "ax", "bx"), ("cy", "ay", "by")):
        p, q = (F.col(a) + (F.col(b) - F.col(a)) * k / F.col("_n") for k in (F.col("_i"), F.col("_i") + 1))
        out = out.withColumn(c, F.explode(F.sequence(F.floor((F.least(p, q) - 1e-9) / s), F.floor((F.greatest(p, q) + 1e-9) / s))))
    return out.select("sid", "cx", "cy").distinct()


def cut_at_meetings(seg: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """Pieces (ax, ay, bx, by) of segments (sid, ax, ay, bx, by): cut at crossings, at touching ends and at the ends of overlaps."""
    span = seg.agg(F.percentile_approx(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))), 0.5, 1000)).first()[0]
    cells = saved(_cells(seg, max(2 * float(span or 0.0), 1e-6)), "cells")
    cells = cells.hint("merge")  # no table of cells is to be broadcast
    other = cells.withColumnRenamed("sid", "oid")
    pairs = cells.join(other, ["cx", "cy"]).filter("sid <> oid").select("sid", "oid").distinct()
    o = seg.select(F.col("sid").alias("oid"), *[F.col(c).alias(f"o{c}") for c in ("ax", "ay", "bx", "by")])
    c = F.col
    dx, dy, ex, ey = c("bx") - c("ax"), c("by") - c("ay"), c("obx") - c("oax"), c("oby") - c("oay")
    gx, gy = c("oax") - c("ax"), c("oay") - c("ay")
    length, olength = F.sqrt(dx * dx + dy * dy), F.sqrt(ex * ex + ey * ey)
    cross = dx * ey - dy * ex
    straight = F.abs(cross) <= 1e-9 * length * olength
    t, u = F.try_divide(gx * ey - gy * ex, cross), F.try_divide(gx * dy - gy * dx, cross)
    slack, oslack = tolerance / length, tolerance / olength
    meets = t.between(-slack, 1 + slack) & u.between(-oslack, 1 + oslack)
    on = lambda x, y: (F.abs(dx * (y - c("ay")) - dy * (x - c("ax"))) <= 1e-9 * length)
    along = lambda x, y: (dx * (x - c("ax")) + dy * (y - c("ay"))) / (length * length)
    ends = F.filter(F.array(F.when(on(c("oax"), c("oay")), along(c("oax"), c("oay"))), F.when(on(c("obx"), c("oby")), along(c("obx"), c("oby")))), lambda x: x.isNotNull())
    cuts = F.when(straight, ends).when(meets, F.array(t)).otherwise(F.array().cast("array<double>"))
    found = pairs.join(seg, "sid").join(o, "oid").select("sid", F.explode(cuts).alias("t")).filter("t > 0 and t < 1").distinct()
    marks = seg.select("sid", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t")).unionByName(found)
    at = marks.join(seg, "sid").select("sid", "t", F.round(c("ax") + c("t") * dx, DIGITS).alias("x"), F.round(c("ay") + c("t") * dy, DIGITS).alias("y"))
    # a segment's cuts in order; they are as many as the borders that it meets
    line = at.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("t", "x", "y"))).alias("p"))
    step = line.select(F.col("p"), F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("i")).select(F.col("p")[F.col("i") - 1].alias("a"), F.col("p")[F.col("i")].alias("b"))
    return step.select(c("a.x").alias("ax"), c("a.y").alias("ay"), c("b.x").alias("bx"), c("b.y").alias("by")).filter("ax <> bx or ay <> by")


def _different(rings: DataFrame) -> DataFrame:
    """One of each group of polygons with the same rings."""
    whole = rings.groupBy("polygon").agg(F.array_sort(F.collect_list(F.struct("ring", "points"))).alias("r")).groupBy("r").agg(F.min("polygon").alias("polygon"))
    return whole.select("polygon", F.explode("r").alias("r")).select("polygon", "r.ring", "r.points")


def _grid_size(border: DataFrame) -> float:
    """An eighth of the median polygon's extent."""
    box = border.groupBy("polygon").agg(F.greatest(F.max("ax") - F.min("ax"), F.max("ay") - F.min("ay")).alias("e"))
    return max(float(box.agg(F.percentile_approx("e", 0.5, 1000)).first()[0] or 0.0) / 8, 1e-6)


def _deep(border: DataFrame, size: float, most: int = 4096) -> DataFrame:
    """Cells (cx, cy) that lie inside one polygon and touch none of its borders; border: its segments (polygon, ring, ax, ay, bx, by).

    A polygon of more than `most` cells has none told, which costs time only.
    """
    to = lambda f, c: F.floor(f(c) / size)
    box = border.groupBy("polygon").agg(to(F.min, "ax").alias("x0"), to(F.max, "ax").alias("x1"), to(F.min, "ay").alias("y0"), to(F.max, "ay").alias("y1"))
    box = box.filter((F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1) <= most)
    cells = box.select("polygon", F.explode(F.sequence("x0", "x1")).alias("cx"), "y0", "y1").select("polygon", "cx", F.explode(F.sequence("y0", "y1")).alias("cy"))
    own = saved(border.join(box.select("polygon").hint("merge"), "polygon").withColumn("sid", F.monotonically_increasing_id()), "borders").hint("merge")
    touched = _cells(own, size).join(own.select("sid", "polygon"), "sid").select("polygon", "cx", "cy")
    cells = saved(cells.join(touched.hint("merge"), ["polygon", "cx", "cy"], "left_anti"), "inner").hint("merge")
    x, y = (F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size
    at = F.col("ax") + (y - F.col("ay")) * (F.col("bx") - F.col("ax")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0))
    cross = ((F.col("ay") > y) != (F.col("by") > y)) & (x < at)
    odd = cells.join(own, "polygon").groupBy("polygon", "cx", "cy", "ring").agg((F.count_if(cross) % 2 == 1).alias("odd"))
    inside = odd.groupBy("polygon", "cx", "cy").agg(F.max(F.col("odd") & (F.col("ring") == 0)).alias("i"), F.max(F.col("odd") & (F.col("ring") > 0)).alias("h"))
    return inside.filter("i and not h").select("cx", "cy").distinct()


def outline(rings: DataFrame) -> DataFrame:
    """Pieces (id, ax, ay, bx, by) of the union's border, the cover to the left; rings: (polygon, ring, points) as ring_segments takes them."""
    rings = saved(_different(rings), "polygons")
    border = saved(ring_segments(rings).filter("ax <> bx or ay <> by"), "border")
    seg = saved(border.select("ax", "ay", "bx", "by").distinct().withColumn("sid", F.monotonically_increasing_id()), "segments")
    size = _grid_size(border)
    deep = saved(_deep(border, size), "deep").hint("merge")
    # a segment all of whose cells are deep is no part of the union's border, nor does the border begin or end on it
    edge = _cells(seg, size).join(deep, ["cx", "cy"], "left_anti").select("sid").distinct()
    seg = saved(seg.join(edge.hint("merge"), "sid", "left_semi"), "segments", instead=seg)
    back = (F.col("ax") > F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") > F.col("by")))
    turned = [F.when(back, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay"))]
    pieces = cut_at_meetings(seg).select(*turned).distinct()
    pieces = saved(pieces.withColumn("id", F.monotonically_increasing_id()), "pieces")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    scale = F.lit(ASIDE) / F.sqrt(dx * dx + dy * dy)
    mx, my = (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2
    side = lambda s: pieces.select((F.col("id") * 2 + (1 if s > 0 else 0)).alias("place"), (mx - s * dy * scale).alias("lon"), (my + s * dx * scale).alias("lat"))
    sides = side(1).unionByName(side(-1)).withColumns({"cx": F.floor(F.col("lon") / size), "cy": F.floor(F.col("lat") / size)})
    sure, open_ = sides.join(deep, ["cx", "cy"], "left_semi"), saved(sides.join(deep, ["cx", "cy"], "left_anti"), "sides")
    hit = covered(open_, rings, "place", 1e-12).select("place").unionByName(sure.select("place")).select(F.floor(F.col("place") / 2).alias("id"), (F.col("place") % 2 == 1).alias("left"))
    one = hit.groupBy("id").agg(F.count("*").alias("n"), F.max("left").alias("left")).filter("n = 1")
    kept = pieces.join(one.hint("merge"), "id")
    return kept.select("id", *[F.when(F.col("left"), F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay"))])


def dissolve(rings: DataFrame) -> DataFrame:
    """Corners (ring, pos, x, y, hole) of the union of all polygons: outer rings counter-clockwise, holes clockwise.

    At a place where rings touch, the border turns so that each ring stays by itself. An empty input has no rings.
    """
    edge = saved(outline(rings), "outline")
    nxt = edge.select(F.col("id").alias("to"), F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("bx").alias("cx"), F.col("by").alias("cy"))
    back = F.atan2(F.col("ay") - F.col("by"), F.col("ax") - F.col("bx"))
    out = F.atan2(F.col("cy") - F.col("by"), F.col("cx") - F.col("bx"))
    turn = F.pmod(back - out, F.lit(6.283185307179586))  # clockwise from the way back: the first way out keeps the cover to the left
    link = saved(edge.join(nxt, ["bx", "by"]).groupBy("id").agg(F.min_by("to", F.when(turn <= 1e-12, 7.0).otherwise(turn)).alias("to")), "links")
    # the least id of a ring, over stretches that double
    low = saved(link.select("id", "to", F.least("id", "to").alias("ring")), "rings")
    while True:
        there = low.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("ring").alias("other"))
        new = saved(low.join(there, "to").select("id", F.col("next").alias("to"), F.least("ring", "other").alias("ring"), (F.col("other") < F.col("ring")).alias("fell")), "rings", instead=low)
        done = new.filter("fell").isEmpty()
        low = new.drop("fell")
        if done:
            break
    # places: steps from each piece on to the ring's head, over jumps that double
    far = low.select("id", "ring").join(link, "id")
    far = saved(far.select("id", "ring", F.when(F.col("id") == F.col("ring"), F.col("id")).otherwise(F.col("to")).alias("to"), F.when(F.col("id") == F.col("ring"), 0).otherwise(1).alias("steps")), "steps")
    while not far.filter("to <> ring").isEmpty():
        there = far.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        far = saved(far.join(there, "to").select("id", "ring", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps")), "steps", instead=far)
    size = far.groupBy("ring").agg(F.count("*").alias("n"))
    at = far.join(size, "ring").select("id", "ring", F.when(F.col("steps") == 0, 0).otherwise(F.col("n") - F.col("steps")).alias("pos"))
    corners = saved(at.join(edge, "id"), "corners")
    area = corners.groupBy("ring").agg(F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")).alias("_area"))
    return corners.join(area, "ring").select("ring", "pos", F.col("ax").alias("x"), F.col("ay").alias("y"), (F.col("_area") < 0).alias("hole"))
