"""Road graph operators: collapse, components, breadth-first and shortest paths, landmarks, hierarchy.

Searches are fix-points over an edge table (u, v, w) that is dealt to blocks of nodes: in a round each block with offers from others settles
its own nodes and makes offers in turn, and all sources or landmarks share the rounds. Each round's table is
written out, which cuts the plan and survives lost executors. Routes are told node by node, from parents by doubling.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlark.functions.geo import haversine_km
from gridlark.operators.iterate import saved


CORE = 2048  # nodes of a block between which all least costs are made
DENSE = 12  # edges a node, on average, at which more than CORE nodes are left as they are
DEFAULT_KPH = 40.0  # fixed value: the speed on edges without a travel time


def collapse_min(edges: DataFrame, w: str = "w") -> DataFrame:
    """The least weight of parallel edges."""
    return edges.groupBy("u", "v").agg(F.min(w).alias(w))


def undirected_min(edges: DataFrame, w: str = "w") -> DataFrame:
    """The least weight of both directions, one row for each pair with a < b."""
    return edges.filter("u <> v").groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.min(w).alias(w))


def both_ways(edges: DataFrame) -> DataFrame:
    e = undirected_min(edges)
    return e.select(F.col("a").alias("u"), F.col("b").alias("v"), "w").unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v"), "w"))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *[c for c in edges.columns if c not in ("u", "v")])


def best_parallel(edges: DataFrame) -> DataFrame:
    """For each (u, v) the edge of least travel time; a missing time counts as infinite, then the key decides.

    Where the chosen edge has no time, its length at DEFAULT_KPH gives one; a missing length is 0.
    """
    order = F.struct(F.coalesce("seconds", F.lit(float("inf"))), "key")
    length = F.coalesce(F.col("length_m").cast("double"), F.lit(0.0))
    best = edges.groupBy("u", "v").agg(F.min_by(F.struct("key", F.coalesce("seconds", length / 1000 / DEFAULT_KPH * 3600).alias("seconds"), length.alias("length_m")), order).alias("e"))
    return best.select("u", "v", "e.*")


def importance(edges: DataFrame) -> DataFrame:
    """Contraction order of nodes: edge difference, product of degrees, sum of degrees."""
    ins = edges.groupBy(F.col("v").alias("id")).agg(F.count_distinct("u").alias("n_in"))
    outs = edges.groupBy(F.col("u").alias("id")).agg(F.count_distinct("v").alias("n_out"))
    d = ins.join(outs, "id", "full").na.fill(0, ["n_in", "n_out"])
    both = F.col("n_in") * F.col("n_out")
    return d.select("id", "n_in", "n_out", (both - F.col("n_in") - F.col("n_out")).alias("edge_difference"), both.alias("shortcut_bound"), (F.col("n_in") + F.col("n_out")).alias("degree"))


def isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("u").alias("id")).unionByName(edges.select(F.col("v").alias("id")))
    return nodes.join(ends, "id", "left_anti")


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    n = nodes.select("id")
    return edges.join(n.withColumnRenamed("id", "u"), "u", "left_semi").join(n.withColumnRenamed("id", "v"), "v", "left_semi")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (id, component), the smallest id that is reachable when directions are ignored."""
    e = saved(edges.select("u", "v").unionByName(reverse(edges.select("u", "v"))).distinct(), "links")
    lab = saved(nodes.select("id", F.col("id").alias("c")), "labels")
    while True:
        near = e.join(lab.select(F.col("id").alias("v"), F.col("c").alias("l")), "v").groupBy(F.col("u").alias("id")).agg(F.min("l").alias("l"))
        new = lab.join(near, "id", "left").select("id", F.col("c").alias("old"), F.least("c", "l").alias("c"))
        up = lab.select(F.col("id").alias("c"), F.col("c").alias("top"))
        new = saved(new.join(up, "c", "left").select("id", "old", F.least("c", "top").alias("c")), "labels", instead=lab)
        if new.filter("old <> c").isEmpty():
            return new.select("id", F.col("c").alias("component"))
        lab = new.select("id", "c")


def largest_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    c = saved(components(nodes, edges), "components")
    top = c.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return c.join(top, "component", "left_semi").select("id")


def _settler(sums: Sequence[str], limit: float | None):
    """What one block does in a round: takes offers, settles its nodes in the order of cost, makes offers to nodes of other blocks."""

    def better(new, old) -> bool:
        if old is None or new[0] != old[0]:
            return old is None or new[0] < old[0]
        if new[3] is not None and new[3] == old[3]:
            return new[4] != old[4]  # the same way, with sums made anew
        return new[1:3] < old[1:3] and new[1] < new[0]  # edges of weight 0 among equal costs could close a ring of parents

    def settle(edges: pa.Table, rows: pa.Table) -> pa.Table:
        ways: dict = {}
        for u, v, w, bound, there, *more in zip(*(edges[c].to_pylist() for c in ("u", "v", "w", "_bound", "_there", *(f"_e_{c}" for c in sums)))):
            ways.setdefault(u, []).append((v, w, bound, there, more))
        here, batch = rows["_block"][0].as_py(), rows["_batch"][0].as_py()
        kept: dict = {}
        offers: dict = {}
        for source, u, cost, before, parent, news, *more in zip(*(rows[c].to_pylist() for c in ("source", "id", "cost", "before", "parent", "news", *sums))):
            (offers if news else kept).setdefault(source, []).append((u, (cost, before, "" if parent is None else str(parent), parent, more)))
        out = []
        for source in kept.keys() | offers.keys():
            labels, heap, sent, n = dict(kept.get(source, ())), [], {}, 0
            for u, label in offers.get(source, ()):
                if better(label, labels.get(u)):
                    labels[u] = label
                    n += 1
                    heappush(heap, (label[0], n, u, label))
            while heap:
                cost, _, u, label = heappop(heap)
                if labels[u] is not label:
                    continue
                for v, w, bound, there, more in ways.get(u, ()):
                    c = cost + w
                    if limit is not None and not c + bound <= limit:
                        continue
                    new = (c, cost, str(u), u, [x + y for x, y in zip(label[4], more)])
                    if there != here:
                        if better(new, sent.get(v, (0, None))[1]):
                            sent[v] = (there, new)
                    elif better(new, labels.get(v)):
                        labels[v] = new
                        n += 1
                        heappush(heap, (c, n, v, new))
            out += [(here, batch, source, u, x[0], x[1], x[3], False, *x[4]) for u, x in labels.items()]
            out += [(there, batch, source, u, x[0], x[1], x[3], True, *x[4]) for u, (there, x) in sent.items()]
        kind = rows.schema
        names = ["_block", "_batch", "source", "id", "cost", "before", "parent", "news", *sums]
        return pa.table([pa.array(c, kind.field(n).type) for n, c in zip(names, zip(*out))], names=names)

    return settle


def shortest(edges: DataFrame, sources: DataFrame, limit: float | None = None, sums: Sequence[str] = (), bounds: DataFrame | None = None, goals: DataFrame | None = None, width: float | None = None, rounds_per_table: int = 1, block: int = 1 << 16) -> DataFrame:
    """Least sums of w from each source: rows (source, id, cost, parent).

    sources: rows (source, id, cost). Of equal costs the parent with the least (cost, id) stays. sums: columns of the edges that are
    added up along the paths (their best parallel edges), so that metrics of routes need no node lists. limit: costs above
    it are not followed. bounds: rows (id, bound), lower bounds of the cost from a node to the goal; with a limit, nodes whose
    cost and bound exceed it are not followed either. goals: rows (id); the search ends once all of them are final for every source, or
    nothing is left, and costs of others may be missing or too high.

    Nodes are dealt to blocks of neighbouring ids, with about `block` edges each. In a round each block that got offers settles its own nodes for
    16 sources a group at most, and offers costs to nodes of other blocks. So rounds are as many as the blocks that a route crosses, not as its edges, and
    blocks without offers only pass their rows on. With `width` a round takes up offers within it of the least one. Tables are written once
    in so many rounds and joined by shuffles: none that grows with the graph is broadcast.
    """
    e = edges.filter(F.col("w").isNotNull())
    if bounds is not None and limit is not None:
        e = e.join(bounds.select(F.col("id").alias("v"), F.col("bound").alias("_bound")).hint("merge"), "v", "left").withColumn("_bound", F.coalesce("_bound", F.lit(0.0)))
    else:
        e = e.withColumn("_bound", F.lit(0.0))
    e = saved(e.select("u", "v", F.col("w").cast("double").alias("w"), "_bound", *[F.col(c).cast("double").alias(f"_e_{c}") for c in sums]), "edges")
    kind = dict(e.dtypes)["u"]
    degree = e.select(F.col("u").alias("id"), F.lit(1).alias("n")).unionByName(e.select(F.col("v").alias("id"), F.lit(0).alias("n"))).unionByName(sources.select(F.col("id").cast(kind), F.lit(0).alias("n")))
    n_blocks = max(1, -(-e.count() // block))
    dealt = degree.groupBy("id").agg(F.sum("n").alias("n"))
    place = saved(dealt.repartitionByRange(n_blocks, "id").select("id", F.spark_partition_id().alias("_block")), "blocks").hint("merge")
    e = e.join(place.select(F.col("id").alias("u"), "_block"), "u").join(place.select(F.col("id").alias("v"), F.col("_block").alias("_there")), "v")
    e = saved(e, "edges")
    n_sources = sources.select("source").distinct().count()
    batch = F.pmod(F.xxhash64("source"), F.lit(max(1, -(-n_sources // 16)))).cast("int")
    extra = [F.col(c).cast("double") if c in sources.columns else F.lit(0.0).alias(c) for c in sums]
    first = sources.select("source", F.col("id").cast(kind).alias("id"), F.col("cost").cast("double").alias("cost"), F.lit(0.0).alias("before"), F.lit(None).cast(kind).alias("parent"), F.lit(True).alias("news"), batch.alias("_batch"), *extra)
    names = ["_block", "_batch", "source", "id", "cost", "before", "parent", "news", *sums]
    state = last = saved(first.join(place, "id").select(names), "costs")
    settle = _settler(list(sums), limit)
    want, n_goals = None, 0
    if goals is not None:
        want = goals.select("id").dropna().distinct().withColumn("_goal", F.lit(True))
        n_goals = want.count() * n_sources
    while True:
        # one job tells whether offers are left and whether the goals are final: all are there, and none costs more than the least offer
        goal = F.lit(False) if want is None else F.col("_goal") & ~F.col("news")
        told = state if want is None else state.join(F.broadcast(want), "id", "left")  # the goals of a request
        row = told.agg(F.min(F.when(F.col("news"), F.col("cost"))).alias("low"), F.count_if(goal).alias("n"), F.max(F.when(goal, F.col("cost"))).alias("far")).first()
        there = want is not None and row.n == n_goals
        if row.low is None or there and (not n_goals or row.far < row.low):
            return state.filter("not news").select("source", "id", "cost", "parent", *sums)
        for _ in range(rounds_per_table):
            news = F.col("news")
            if there:
                state = state.filter(~news | (F.col("cost") <= row.far))  # no other offer can better a goal
            taken = news if width is None else news & (F.col("cost") < row.low + width)
            active = state.filter(taken).select(F.col("_block").alias("_to"), F.col("_batch").alias("_set")).distinct().hint("merge")
            busy = [F.col("_block") == F.col("_to"), F.col("_batch") == F.col("_set")]
            wait = state.filter(news & ~taken)
            mine = state.filter(~news).join(active, busy, "left_semi").select(names).unionByName(state.filter(taken))
            rest = state.filter(~news).join(active, busy, "left_anti").select(names)
            part = e.join(active, busy[0]).groupBy("_to", "_set")
            done = mine.groupBy("_block", "_batch").cogroup(part).applyInArrow(lambda rows, ways: settle(ways, rows), state.schema)
            state = done.unionByName(rest).unionByName(wait)
        state = last = saved(state, "costs", instead=last)


def goal_directed(edges: DataFrame, start: DataFrame, goal: DataFrame, bounds: DataFrame) -> DataFrame:
    """One row (id, cost) for the goal: a search by landmark bounds, repeated with a doubled limit until the goal is reached.

    start and goal: one row (id). No node is followed whose cost and bound exceed the limit, so the search stays
    near the best routes, and it ends when the goal is final; the cost is the least one. No row if there is no route.
    """
    src = start.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("cost"))
    low = start.join(bounds, "id").select("bound").first()
    limit = max(1e-9, float(low.bound if low and low.bound is not None else 0.0) * 1.05)
    most = float(edges.agg(F.sum("w")).first()[0] or 0.0)  # no route costs more
    while True:
        hit = shortest(edges, src, limit=limit, bounds=bounds, goals=goal).join(goal.select("id"), "id").select("id", "cost")
        if limit > most or not hit.filter(F.col("cost") <= limit).isEmpty():
            return hit
        limit *= 2


def routes_to(costs: DataFrame, goals: DataFrame | None = None) -> DataFrame:
    """Nodes (source, id, pos, node) of the routes to goals (source, id), by default to all nodes; the source is at 0.

    Parents are doubled: a jump of 2^k parents is two jumps of 2^(k-1), and the nodes known of a route double with each jump from the
    longest down. So routes of n edges take log n joins, and a row holds one node, never a list. Joins shuffle: jumps are as many as nodes, so none is broadcast.
    """
    tree = saved(costs.select("source", "id", "parent"), "tree")
    goals = tree.select("source", "id") if goals is None else goals.select("source", "id").join(tree.select("source", "id").hint("merge"), ["source", "id"])
    jumps = [saved(tree.filter("parent is not null").select("source", F.col("id").alias("at"), F.col("parent").alias("to")), "jumps")]
    while True:
        last = jumps[-1]
        twice = saved(last.join(last.select("source", F.col("at").alias("to"), F.col("to").alias("next")).hint("merge"), ["source", "to"]).select("source", "at", F.col("next").alias("to")), "jumps")
        if twice.isEmpty():
            break
        jumps.append(twice)
    rows = goals.select("source", "id", F.col("id").alias("at"), F.lit(0).alias("back"))
    for k in range(len(jumps) - 1, -1, -1):
        rows = rows.unionByName(rows.join(jumps[k].hint("merge"), ["source", "at"]).select("source", "id", F.col("to").alias("at"), (F.col("back") + (1 << k)).alias("back")))
        rows = saved(rows, "routes")
    n = rows.groupBy("source", "id").agg(F.max("back").alias("_n"))
    return rows.join(n.hint("merge"), ["source", "id"]).select("source", "id", (F.col("_n") - F.col("back")).alias("pos"), F.col("at").alias("node"))


def hops(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Breadth-first levels: rows (source, id, hops)."""
    e = edges.select("u", "v").distinct().withColumn("w", F.lit(1.0))
    return shortest(e, sources).select("source", "id", F.col("cost").cast("long").alias("hops"))


def source_rows(spark: SparkSession, ids: Sequence) -> DataFrame:
    kind = "long" if all(isinstance(i, int) for i in ids) else "string"
    return spark.createDataFrame([(i, i, 0.0) for i in ids], f"source {kind}, id {kind}, cost double")


def path_edges(paths: DataFrame, key: Sequence[str]) -> DataFrame:
    """Consecutive pairs (key, pos, u, v) of the nodes (key, pos, node) of paths."""
    nxt = paths.select(*key, (F.col("pos") - 1).alias("pos"), F.col("node").alias("v"))
    return paths.select(*key, "pos", F.col("node").alias("u")).join(nxt.hint("merge"), [*key, "pos"])


def path_metrics(paths: DataFrame, best: DataFrame, key: Sequence[str]) -> DataFrame:
    """Length and time of each path (key, pos, node) over the best parallel edges; an absent edge adds nothing."""
    e = path_edges(paths, key).join(best.hint("merge"), ["u", "v"], "left")
    m = e.groupBy(*key).agg((F.sum(F.coalesce("length_m", F.lit(0.0))) / 1000).alias("distance_km"), (F.sum(F.coalesce("seconds", F.lit(0.0))) / 60).alias("drive_min"))
    return paths.select(*key).distinct().join(m.hint("merge"), list(key), "left").na.fill(0.0, ["distance_km", "drive_min"])


def path_points(paths: DataFrame, nodes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Places (key, pos, x, y) of the paths' nodes in order; nodes without a place are left out."""
    return paths.join(nodes.select(F.col("id").alias("node"), "x", "y").hint("merge"), "node").select(*key, "pos", "x", "y")


def route_polyline(paths: DataFrame, shapes: DataFrame, nodes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Lines (key, pos, x, y) of paths along the shapes (u, v, at, x, y) of their edges; an edge without a shape is straight.

    A joint of two edges counts once.
    """
    e = path_edges(paths, key)
    a, b = nodes.select(F.col("id").alias("u"), F.struct("x", "y").alias("a")), nodes.select(F.col("id").alias("v"), F.struct("x", "y").alias("b"))
    own = shapes.groupBy("u", "v").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line"))  # one edge's points
    e = e.join(own.hint("merge"), ["u", "v"], "left").join(a.hint("merge"), "u").join(b.hint("merge"), "v")
    points = e.select(*key, F.col("pos").alias("edge"), F.posexplode(F.coalesce("line", F.array("a", "b"))).alias("at", "p")).select(*key, "edge", "at", "p.x", "p.y")
    w = Window.partitionBy(*key).orderBy("edge", "at")
    same = F.lag("x").over(w).eqNullSafe(F.col("x")) & F.lag("y").over(w).eqNullSafe(F.col("y"))
    points = points.withColumn("_same", same).filter("not _same")
    return points.withColumn("pos", F.row_number().over(w) - 1).select(*key, "pos", "x", "y")


def select_landmarks(nodes: DataFrame, edges: DataFrame, count: int) -> list:
    """Farthest-point landmarks: first the node nearest to the centroid, then the one farthest from all so far."""
    spark = nodes.sparkSession
    c = nodes.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    d = nodes.crossJoin(F.broadcast(c)).withColumn("d", F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2))  # one row
    chosen = [d.agg(F.min_by("id", F.struct(F.round("d", 12), "id"))).first()[0]]
    e = both_ways(edges)
    least = None
    while len(chosen) < count:
        got = shortest(e, source_rows(spark, chosen[-1:])).select("id", "cost")
        least = got if least is None else saved(least.withColumnRenamed("cost", "a").join(got.hint("merge"), "id").select("id", F.least("a", "cost").alias("cost")), "least")
        far = least.filter("cost > 0").agg(F.max_by("id", F.struct("cost", F.negative("id")))).first()[0]
        if far is None:
            break
        chosen.append(far)
    return chosen


def landmark_table(edges: DataFrame, landmarks: Sequence) -> DataFrame:
    """Rows (landmark, id, fwd, rev, und): costs from the landmark, to it, and without directions; null if unreachable."""
    src = source_rows(edges.sparkSession, landmarks)
    one = lambda e, c: shortest(e, src).select(F.col("source").alias("landmark"), "id", F.col("cost").cast("float").alias(c))
    out = one(edges, "fwd").join(one(reverse(edges), "rev"), ["landmark", "id"], "full")
    return out.join(one(both_ways(edges), "und"), ["landmark", "id"], "full")


def landmark_bound(table: DataFrame, goals: DataFrame) -> DataFrame:
    """Lower bound of the cost from each node to each goal: rows (goal, id, bound); null if no landmark tells.

    Costs of the table are single floats, each within 2^-24 of its value; what that may add to a difference is taken off, so
    a bound never exceeds the cost.
    """
    g = goals.select(F.col("id").alias("goal")).join(table.withColumnRenamed("id", "goal"), "goal").select("landmark", "goal", *[F.col(a).cast("double").alias(b) for a, b in (("fwd", "gf"), ("rev", "gr"), ("und", "gu"))])
    own = table.select("landmark", "id", *[F.col(c).cast("double").alias(c) for c in ("fwd", "rev", "und")])
    both = own.join(F.broadcast(g), "landmark")  # the goals of one request
    less = lambda a, b: (F.col(a) - F.col(b)) - (F.col(a) + F.col(b)) * 2**-23
    directed = F.max(F.greatest(less("gf", "fwd"), less("rev", "gr")))
    out = both.groupBy("goal", "id").agg(directed.alias("d"), F.max(F.greatest(less("gu", "und"), less("und", "gu"))).alias("u"))
    return out.select("goal", "id", F.when(F.coalesce("d", "u").isNotNull(), F.greatest(F.lit(0.0), F.coalesce("d", "u"))).alias("bound"))


def straight_bound(nodes: DataFrame, edges: DataFrame, goals: DataFrame) -> DataFrame:
    """Lower bounds (goal, id, bound) from straight lines: the distance to each goal at the speed of the fastest edge, so none exceeds the cost.

    An edge's speed is the straight distance between its ends by its weight; a little is taken off for rounding. nodes: (id, x, y).
    """
    at = lambda c: nodes.select(F.col("id").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"))
    far = lambda a, b: haversine_km(F.col(f"{a}y"), F.col(f"{a}x"), F.col(f"{b}y"), F.col(f"{b}x"))
    top = edges.filter("u <> v").join(at("u").hint("merge"), "u").join(at("v").hint("merge"), "v").agg(F.max(F.when(F.col("w") > 0, F.try_divide(far("u", "v"), F.col("w"))).otherwise(float("inf"))).alias("top"))
    places = at("goal").join(goals.select(F.col("id").alias("goal")), "goal")
    both = at("id").crossJoin(F.broadcast(places)).crossJoin(F.broadcast(top))  # the goals of one request, and one row
    return both.select("goal", "id", F.coalesce(F.try_divide(far("id", "goal"), F.col("top")) * (1 - 1e-9), F.lit(0.0)).alias("bound"))


def witnessed(short: DataFrame, live: DataFrame, gone: DataFrame, hops: int = 4, settled: int = 240) -> DataFrame:
    """Shortcuts (u, v, w, via) without those that another route past the contracted nodes is not longer than.

    One search serves a whole round: its sources are the shortcuts' first nodes, each with the weight of its longest shortcut as its own limit.
    It goes `hops` edges far, and after each second one a source keeps its `settled` nearest nodes, so its cost is bounded. What lies beyond is not
    sought: a shortcut too many costs space only, never exactness.
    """
    here = live.join(gone.withColumnRenamed("id", "u"), "u", "left_anti").join(gone.withColumnRenamed("id", "v"), "v", "left_anti").select("u", "v", "w", F.lit(False).alias("_own"))
    limit = short.groupBy(F.col("u").alias("source")).agg(F.max("w").alias("_limit"))
    ids = here.select("u").union(here.select("v")).union(short.select("u")).distinct()
    rest = here.unionByName(ids.select("u", F.col("u").alias("v"), F.lit(0.0).alias("w"), F.lit(True).alias("_own")))
    cur = limit.select("source", F.col("source").alias("u"), F.lit(0.0).alias("cost"), "_limit", F.lit(True).alias("fresh"))
    near = Window.partitionBy("source").orderBy("cost", "u")
    for k in range(hops):
        step = cur.join(rest, "u").filter((F.col("_own") | F.col("fresh")) & (F.col("cost") + F.col("w") <= F.col("_limit")))
        step = step.select("source", F.col("v").alias("u"), (F.col("cost") + F.col("w")).alias("cost"), "_limit", (~F.col("_own")).alias("fresh"))
        cur = step.groupBy("source", "u").agg(F.min(F.struct("cost", "fresh")).alias("b"), F.first("_limit").alias("_limit")).select("source", "u", "b.cost", "_limit", "b.fresh")
        if k % 2 and k < hops - 1:
            cur = cur.withColumn("_place", F.row_number().over(near)).filter(F.col("_place") <= settled).drop("_place")
    known = cur.select(F.col("source").alias("u"), F.col("u").alias("v"), F.col("cost").alias("d"))
    return short.join(known, ["u", "v"], "left").filter(F.col("d").isNull() | (F.col("d") > F.col("w"))).drop("d")


def _contractor(hops: int, settled: int, most: int | None):
    """What one block does on a level: contracts its inner nodes in the order of importance; of those with more than `most` pairs of an in-edge and an out-edge none."""

    far = float("inf")

    def witnesses(out: dict, start, past, ends: dict) -> dict:
        """Costs from a node to others past one node, at most so many edges far and over four edges for each of so many nodes; it ends when no end of a shortcut can be bettered."""
        limit, open_ends = max(ends.values()), dict(ends)
        done, best, heap, seen = set(), {start: 0.0}, [(0.0, 0, start)], 0
        while heap and open_ends and seen < 4 * settled:
            c, n, u = heappop(heap)
            if u in done:
                continue
            done.add(u)
            open_ends.pop(u, None)
            if n < hops:
                seen += len(out[u])
                for v, (w, _) in out[u].items():
                    x = c + w
                    if x <= limit and v != past and x < best.get(v, far):
                        best[v] = x
                        if x <= ends.get(v, -1.0):
                            open_ends.pop(v, None)
                        heappush(heap, (x, n + 1, v))
        return best  # costs that are not final are of real routes too

    def core(out: dict) -> tuple[dict, np.ndarray]:
        """The places of few nodes that are left, and the least costs between all of them."""
        at = {i: k for k, i in enumerate(out)}
        d = np.full((len(at), len(at)), np.inf)
        np.fill_diagonal(d, 0.0)
        for u, ways in out.items():
            for v, (w, _) in ways.items():
                d[at[u], at[v]] = w
        for k in range(len(at)):
            np.minimum(d, d[:, k, None] + d[k], out=d)
        return at, d * (1 + 1e-9)  # sums of another order round otherwise; a shortcut too many does no harm

    def level(nodes: pa.Table, edges: pa.Table) -> pa.Table:
        out: dict = {i: {} for i in nodes["id"].to_pylist()}
        into: dict = {i: {} for i in out}
        inner = {i: h for i, h, x in zip(*(nodes[c].to_pylist() for c in ("id", "_hash", "_inner"))) if x}
        for u, v, w, via in zip(*(edges[c].to_pylist() for c in ("u", "v", "w", "via"))):
            out[u][v] = into[v][u] = (w, via)

        def order(i):
            n, m = len(into[i]), len(out[i])
            return (n * m - n - m, n * m, n + m, inner[i], i)

        now = {i: order(i) for i in inner}
        heap = sorted(now.values())
        rows: list[tuple] = []
        rank, at = 0, None
        while heap:
            if at is None and len(out) <= CORE:
                at, true = core(out)
            o = heappop(heap)
            x = o[-1]
            if now.get(x) != o or most is not None and o[1] > most:
                continue
            del now[x]
            rows.append((0, x, None, None, None, rank))
            rank += 1
            ins, outs = into.pop(x), out.pop(x)
            rows += [(1, a, x, w, via, None) for a, (w, via) in ins.items()] + [(1, x, b, w, via, None) for b, (w, via) in outs.items()]
            for a in ins:
                del out[a][x]
            for b in outs:
                del into[b][x]
            for a, (wa, _) in ins.items():
                ends, ways = {b: wa + wb for b, (wb, _) in outs.items() if b != a}, out[a]
                if at is None:
                    known = witnesses(out, a, x, ends) if ends else {}
                    need = [b for b, w in ends.items() if not known.get(b, far) <= w]
                else:  # what is longer than the least cost is on no best route
                    least = true[at[a]]
                    need = [b for b, w in ends.items() if w <= least[at[b]] and not (b in ways and ways[b][0] <= w)]
                for b in need:
                    ways[b] = into[b][a] = (ends[b], x)
            for i in ins.keys() | outs.keys():
                if i in now and now[i] != (o := order(i)):
                    now[i] = o
                    heappush(heap, o)
        rows += [(2, u, v, w, via, None) for u, ways in out.items() for v, (w, via) in ways.items()]
        kind = nodes.schema.field("id").type
        names, types = ["kind", "u", "v", "w", "via", "rank"], [pa.int32(), kind, kind, pa.float64(), kind, pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], names=names)

    return level


def contract(edges: DataFrame, nodes: DataFrame, hops: int = 4, settled: int = 240, block: int = 1 << 16, most: int = 256, dense: float = DENSE, core: int = CORE) -> tuple[DataFrame, DataFrame]:
    """A contraction hierarchy: (ranks (id, rank), edges (u, v, w, via)).

    On a level nodes are dealt to blocks of neighbouring ids, of about `block` edges, and each block contracts its inner nodes, those whose
    neighbours are all its own, in the order (edge difference, product, degree, hash), which it keeps up to date. So blocks meet at nodes that stay for
    the next level, where fewer edges make fewer blocks. A node of more than `most` pairs of edges waits, unless one block is left. A contracted node leaves a
    shortcut for each in-edge and out-edge that has no witness in its block; of parallel edges the least stays. Where a level contracts few, more pairs are allowed and blocks grow
    to four times at most; beyond that a round contracts an independent set, so no task ever holds more.

    Where more than `core` nodes are left after a level, with `dense` edges each on average, more shortcuts would cost more than they save: these nodes share the highest
    rank and keep the edges between them, and searches go through them from block to block. No other edge joins nodes of one rank.
    """
    least = lambda df: df.groupBy("u", "v").agg(F.min_by(F.struct("w", "via"), F.struct("w", F.coalesce("via", F.lit(-1)))).alias("e")).select("u", "v", "e.*")
    kind = dict(edges.dtypes)["u"]
    live = saved(collapse_min(edges.select("u", "v", F.col("w").cast("double").alias("w")).filter("u <> v")).withColumn("via", F.lit(None).cast(kind)), "ch")
    ends = live.select(F.col("u").alias("id")).unionByName(live.select(F.col("v").alias("id")))
    left = saved(nodes.select(F.col("id").cast(kind)).unionByName(ends).distinct(), "ch-left")
    ranks, done, base, size, few = [], [], 0, block, False
    while True:
        n_left, n_edges = left.count(), live.count()
        if not n_left or ranks and n_left > core and n_edges >= dense * n_left:
            ranks.append(left.select("id", F.lit(base).cast("long").alias("rank")))
            done.append(live)
            own = nodes.select(F.col("id").cast(kind)).distinct()
            told = reduce(DataFrame.unionByName, ranks).join(own, "id", "left_semi")
            return saved(told, "ch-ranks"), saved(reduce(DataFrame.unionByName, done), "ch-edges")
        n_blocks = max(1, -(-n_edges // size))
        if few and n_blocks > 1:
            now, gone, live = _independent(live, left, least, hops, settled)
            told = now.select("id", F.lit(base).cast("long").alias("rank"))
            few = False
        else:
            place = saved(left.repartitionByRange(n_blocks, "id").select("id", F.spark_partition_id().alias("_block")), "ch-blocks").hint("merge")
            e = live.join(place.select(F.col("id").alias("u"), "_block"), "u").join(place.select(F.col("id").alias("v"), F.col("_block").alias("_there")), "v")
            e = saved(e.select("_block", "_there", "u", "v", "w", "via"), "ch-dealt")
            cross = e.filter("_block <> _there")
            outer = cross.select(F.col("u").alias("id")).unionByName(cross.select(F.col("v").alias("id"))).distinct().withColumn("_outer", F.lit(True)).hint("merge")
            n = place.join(outer, "id", "left").select("_block", "id", F.xxhash64("id").alias("_hash"), F.col("_outer").isNull().alias("_inner"))
            run = _contractor(hops, settled, most if n_blocks > 1 else None)
            n, inside = (df.repartition(4 * n_blocks, "_block") for df in (n, e.filter("_block = _there")))  # a block is little data and much work: blocks must not share tasks by size
            out = n.groupBy("_block").cogroup(inside.groupBy("_block")).applyInArrow(run, f"kind int, u {kind}, v {kind}, w double, via {kind}, rank long")
            out = saved(out, "ch-level")
            told = out.filter("kind = 0").select(F.col("u").alias("id"), (F.col("rank") + base).alias("rank"))
            gone = out.filter("kind = 1").select("u", "v", "w", "via")
            live = saved(out.filter("kind = 2").select("u", "v", "w", "via").unionByName(cross.select("u", "v", "w", "via")), "ch", instead=live)
        row = told.agg(F.count("*").alias("n"), F.max("rank").alias("top")).first()
        left = saved(left.join(told.select("id").hint("merge"), "id", "left_anti"), "ch-left", instead=left)
        ranks.append(told)
        done.append(gone)
        base = base if row.top is None else row.top + 1
        if 8 * row.n < n_left:
            few = size >= 4 * block and most > 1 << 14
            size, most = min(2 * size, 4 * block), 4 * most


def _independent(live: DataFrame, left: DataFrame, least, hops: int, settled: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A round over the whole graph contracts the nodes that come before all their neighbours: (ids, their edges, edges that are left)."""
    imp = left.join(importance(live), "id", "left").na.fill(0)
    imp = imp.select("id", F.struct("edge_difference", "shortcut_bound", "degree", F.xxhash64("id"), "id").alias("o"))
    ends = live.select("u", "v").unionByName(reverse(live.select("u", "v")))
    near = ends.join(imp.select(F.col("id").alias("v"), "o"), "v").groupBy(F.col("u").alias("id")).agg(F.min("o").alias("m"))
    gone = saved(imp.join(near, "id", "left").filter(F.col("m").isNull() | (F.col("o") < F.col("m"))).select("id"), "ch-nodes")
    out_of, into = gone.withColumnRenamed("id", "u"), gone.withColumnRenamed("id", "v")
    touch = saved(live.join(out_of, "u", "left_semi").unionByName(live.join(into, "v", "left_semi")), "ch-done")  # no edge has both ends in an independent set
    ins = live.join(into, "v", "left_semi").select(F.col("v").alias("m"), F.col("u").alias("a"), F.col("w").alias("w1"))
    outs = live.join(out_of, "u", "left_semi").select(F.col("u").alias("m"), F.col("v").alias("b"), F.col("w").alias("w2"))
    short = ins.join(outs, "m").filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"), (F.col("w1") + F.col("w2")).alias("w"), F.col("m").alias("via"))
    short = witnessed(saved(least(short), "ch-short"), live, gone, hops, settled)
    rest = live.join(out_of, "u", "left_anti").join(into, "v", "left_anti")
    return gone, touch, saved(least(rest.unionByName(short.select("u", "v", "w", "via"))), "ch", instead=live)


def street_sums(ch: DataFrame, sums: Sequence[str]) -> DataFrame:
    """The hierarchy's edges (u, v, w, via) with sums of columns over the streets that they unpack to, halves first.

    ch has the columns of the streets, which shortcuts may lack. A round adds up all shortcuts whose halves are known, so rounds are as many as shortcuts
    lie in each other, and a row stands for an edge, never for a street of a shortcut.
    """
    known = [saved(ch.filter("via is null").select("u", "v", "w", "via", *sums), "known")]
    wait = saved(ch.filter("via is not null").select("u", "v", "w", "via"), "shortcuts")
    while not wait.isEmpty():
        every = reduce(DataFrame.unionByName, known)
        a = every.select("u", F.col("v").alias("via"), *[F.col(c).alias(f"_a_{c}") for c in sums], F.lit(True).alias("_a")).hint("merge")
        b = every.select(F.col("u").alias("via"), "v", *[F.col(c).alias(f"_b_{c}") for c in sums], F.lit(True).alias("_b")).hint("merge")
        got = saved(wait.join(a, ["u", "via"], "left").join(b, ["via", "v"], "left"), "halves", instead=wait)
        wait = got.filter("_a is null or _b is null").select("u", "v", "w", "via")
        known.append(got.filter("_a and _b").select("u", "v", "w", "via", *[(F.col(f"_a_{c}") + F.col(f"_b_{c}")).alias(c) for c in sums]))
        if known[-1].isEmpty():
            raise ValueError("shortcuts without their halves")
        wait, known[-1] = saved(wait, "shortcuts"), saved(known[-1], "known")
    return reduce(DataFrame.unionByName, known)


def _two_sides(ranks: DataFrame, ch: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees (source, id, cost, parent) of the upward searches from all starts, and of those against the edges from all goals."""
    ru, rv = ranks.select(F.col("id").alias("u"), F.col("rank").alias("ru")), ranks.select(F.col("id").alias("v"), F.col("rank").alias("rv"))
    e = ch.join(ru, "u").join(rv, "v")
    src = lambda c: pairs.select(F.col(c).alias("source")).distinct().select("source", F.col("source").alias("id"), F.lit(0.0).alias("cost"))
    # edges between nodes of one rank are those of the core
    return shortest(e.filter("rv >= ru").select("u", "v", "w"), src("start")), shortest(reverse(e.filter("ru >= rv").select("u", "v", "w")), src("goal"))


def _meetings(up: DataFrame, down: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (start, goal, cost, mid): the best place where both sides of a pair meet."""
    f = up.select(F.col("source").alias("start"), "id", F.col("cost").alias("a"))
    b = down.select(F.col("source").alias("goal"), "id", F.col("cost").alias("b"))
    both = pairs.join(f, "start").join(b, ["goal", "id"]).withColumn("cost", F.col("a") + F.col("b"))
    return both.groupBy("start", "goal").agg(F.min(F.struct("cost", F.col("id").alias("mid"))).alias("m")).select("start", "goal", "m.*")


def _sweep(ranks: DataFrame, ch: DataFrame, pairs: DataFrame, back: bool, sums: Sequence[str]) -> DataFrame:
    """Rows (start, goal, cost, sums) for few starts and many goals, or with `back` for few goals: up from the few, then down to all nodes in one search."""
    ru, rv = ranks.select(F.col("id").alias("u"), F.col("rank").alias("ru")), ranks.select(F.col("id").alias("v"), F.col("rank").alias("rv"))
    e = ch.join(ru.hint("merge"), "u").join(rv.hint("merge"), "v")
    up, down = (e.filter(c).select("u", "v", "w", *sums) for c in ("rv >= ru", "ru >= rv"))  # those of one rank are the core's
    if back:
        up, down = reverse(down), reverse(up)
    few, many = ("goal", "start") if back else ("start", "goal")
    src = pairs.select(F.col(few).alias("source")).distinct().select("source", F.col("source").alias("id"), F.lit(0.0).alias("cost"))
    first = shortest(up, src, sums=sums).select("source", "id", "cost", *sums)
    all_of = shortest(down, first, sums=sums)
    told = all_of.select(F.col("source").alias(few), F.col("id").alias(many), "cost", *sums)
    return pairs.join(told.hint("merge"), ["start", "goal"], "left")


def hierarchy_cost(ranks: DataFrame, ch: DataFrame, pairs: DataFrame, sums: Sequence[str] = ()) -> DataFrame:
    """Costs of (start, goal) pairs; null without a way. sums: columns of ch (see street_sums) that are added up along the routes.

    Upward search from starts, reverse upward from goals, met at the best node. Where one side has far more ends than the
    other, or sums are asked for, the few ends' searches go on downwards to all nodes instead, so that rows are as many as the few ends times the nodes.
    """
    n = pairs.agg(F.count_distinct("start").alias("s"), F.count_distinct("goal").alias("g")).first()
    if sums or max(n.s, n.g) > 64 * min(n.s, n.g):
        return _sweep(ranks, ch, pairs, n.g < n.s, sums)
    return pairs.join(_meetings(*_two_sides(ranks, ch, pairs), pairs).drop("mid"), ["start", "goal"], "left")


def hierarchy_routes(ranks: DataFrame, ch: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges (start, goal, pos, u, v) of the routes of pairs, shortcuts unpacked; a pair without a way, or of one node, has none."""
    up, down = _two_sides(ranks, ch, pairs)
    met = saved(_meetings(up, down, pairs), "meetings")
    first = routes_to(up, met.select(F.col("start").alias("source"), F.col("mid").alias("id")).distinct()).withColumnsRenamed({"source": "start", "id": "mid"})
    last = routes_to(down, met.select(F.col("goal").alias("source"), F.col("mid").alias("id")).distinct()).withColumnsRenamed({"source": "goal", "id": "mid"})
    head = met.join(first, ["start", "mid"]).select("start", "goal", "pos", "node")
    n = head.groupBy("start", "goal").agg(F.max("pos").alias("_n"))
    size = last.groupBy("goal", "mid").agg(F.max("pos").alias("_m"))  # the goal is at 0, the meeting at the end
    tail = met.join(last, ["goal", "mid"]).join(size, ["goal", "mid"]).filter("pos < _m").join(n, ["start", "goal"]).select("start", "goal", (F.col("_n") + F.col("_m") - F.col("pos")).alias("pos"), "node")
    return unpack(saved(head.unionByName(tail), "routes"), ch, ["start", "goal"])


def unpack(path: DataFrame, ch: DataFrame, key: Sequence[str]) -> DataFrame:
    """Edges (key, pos, u, v) of paths (key, pos, node) with shortcuts replaced by their two halves until none is left."""
    cur = path_edges(path, key).withColumn("pos", F.array("pos"))
    while True:
        j = cur.join(ch.select("u", "v", "via"), ["u", "v"], "left")
        if j.filter("via is not null").isEmpty():
            w = Window.partitionBy(*key).orderBy("pos")
            return cur.withColumn("pos", F.row_number().over(w) - 1)
        halves = F.array(F.struct(F.col("u"), F.col("via").alias("v"), F.concat("pos", F.array(F.lit(0))).alias("pos")), F.struct(F.col("via").alias("u"), F.col("v"), F.concat("pos", F.array(F.lit(1))).alias("pos")))
        split = j.filter("via is not null").select(*key, F.explode(halves).alias("h")).select(*key, "h.*")
        cur = saved(j.filter("via is null").select(*key, "u", "v", "pos").unionByName(split.select(*key, "u", "v", "pos")), "unpack")
