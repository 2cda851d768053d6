"""Station time series: ratios, lags, rolling windows, horizons, samples and splits.

All per-station operators share one partitioning by station and one order by time, so Spark sorts
once; equal times are ordered by obs_id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.functions.scalar import ratio, safe_float
from gridlark.functions.timefn import add_minutes, floor_minutes
from gridlark.operators.iterate import saved
from gridlark.operators.metrics import range_rank

ORDER = ["time", "obs_id"]


def by_station():
    return Window.partitionBy("station_id").orderBy(*ORDER)


def occupancy(obs: DataFrame) -> DataFrame:
    """Rows with a denominator only, the ratio `occ`, and duration as a number (0 where it is none)."""
    obs = obs.filter(F.col("busy") + F.col("idle") > 0)
    return obs.withColumn("occ", ratio(F.col("busy"), F.col("busy") + F.col("idle"))).withColumn("duration", safe_float(F.col("duration").cast("string")))


def lags(obs: DataFrame, steps: Sequence[int] = (1, 3, 6, 12), value: str = "occ") -> DataFrame:
    w = by_station()
    return obs.withColumns({f"lag_{k}": F.lag(value, k).over(w) for k in steps})


def rolling(obs: DataFrame, value: str = "occ") -> DataFrame:
    """Means over the 6 and 12 rows before the row and their sample deviation; null until the window is full."""
    w6, w12 = by_station().rowsBetween(-6, -1), by_station().rowsBetween(-12, -1)
    full = lambda w, n, c: F.when(F.count(value).over(w) == n, c.over(w))
    return obs.withColumns({"mean_6": full(w6, 6, F.avg(value)), "mean_12": full(w12, 12, F.avg(value)), "std_12": full(w12, 12, F.stddev_samp(value))})


def train_state(obs: DataFrame) -> DataFrame:
    """Lags, rolling windows and trend, without the warm-up rows of each station."""
    out = rolling(lags(obs)).withColumn("trend_12", F.col("lag_1") - F.col("lag_12"))
    return out.filter(F.col("lag_12").isNotNull() & F.col("mean_12").isNotNull() & F.col("std_12").isNotNull())


def serve_state(obs: DataFrame, now: Column, rows: int = 12) -> DataFrame:
    """State at a time from the last 12 rows up to it, the current row included; stations with fewer rows have none."""
    w = Window.partitionBy("station_id").orderBy(F.desc("time"), F.desc("obs_id"))
    last = obs.filter(F.col("time") <= floor_minutes(now, 5)).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= rows)
    pick = lambda k, c="occ": F.max(F.when(F.col("rn") == k, F.col(c)))
    past = F.when(F.col("rn") > 1, F.col("occ"))
    out = last.groupBy("station_id").agg(
        F.count("*").alias("n"), pick(1, "s_price").alias("s_price"), pick(1, "e_price").alias("e_price"), pick(2).alias("lag_1"), pick(4).alias("lag_3"), pick(7).alias("lag_6"),
        pick(rows).alias("lag_12"), F.avg(F.when(F.col("rn").between(2, 7), F.col("occ"))).alias("mean_6"), F.avg(past).alias("mean_12"), F.stddev_samp(past).alias("std_12"),
    )
    return out.filter(F.col("n") == rows).drop("n").withColumn("trend_12", F.col("lag_1") - F.col("lag_12"))


def horizon_targets(obs: DataFrame, horizons: Sequence[int], value: str = "occ") -> DataFrame:
    """target_h: the value h / 5 rows ahead."""
    check_horizons(horizons)
    w = by_station()
    return obs.withColumns({f"target_{h}": F.lead(value, h // 5).over(w) for h in horizons})


def check_horizons(horizons: Sequence[int]) -> None:
    if bad := [h for h in horizons if h <= 0 or h % 5]:
        raise ValueError(f"horizons must be positive multiples of 5 minutes: {bad}")


def parse_horizons(text: str) -> list[int]:
    out = [int(x) for x in text.split(",") if x.strip()]
    check_horizons(out)
    return out


def horizon_explode(df: DataFrame, horizons: Sequence[int], rows_per_horizon: int = 0, seed: int = 42) -> DataFrame:
    """One row for each horizon with a target; a cap samples by hash, evenly over the rows."""
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon_min"), F.col(f"target_{h}").alias("target")) for h in horizons])
    out = df.withColumn("h", F.explode(pairs)).select(*[c for c in df.columns if not c.startswith("target_")], "h.*").filter(F.col("target").isNotNull())
    if rows_per_horizon:
        # hashes first thin a horizon to about twice the cap, wherever it holds more; the exact cap is then taken of these
        slot = F.pmod(F.xxhash64("station_id", "time", F.lit(seed)), F.lit(1_000_000))
        many = out.groupBy("horizon_min").agg(F.count("*").alias("_n"))  # a row a horizon
        out = out.join(F.broadcast(many), "horizon_min").withColumn("_slot", slot)
        share = F.lit(2.0 * rows_per_horizon + 50) / F.col("_n") * 1_000_000
        w = Window.partitionBy("horizon_min").orderBy("_slot", "station_id", "time", "obs_id")
        out = out.filter(F.col("_slot") <= share).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= rows_per_horizon).drop("rn", "_slot", "_n")
    return out.withColumn("horizon_sqrt", F.sqrt("horizon_min")).withColumn("target_time", add_minutes(F.col("time"), F.col("horizon_min")))


def split_at(df: DataFrame, cutoff: Column, valid_from: Column | None = None, time: str = "time") -> DataFrame:
    """Column `part`: train before, test from the cutoff on; with valid_from a validation part between."""
    t = F.col(time)
    part = F.when(t >= cutoff, "test")
    if valid_from is not None:
        part = part.when(t >= valid_from, "valid")
    return df.withColumn("part", part.otherwise("train"))


def quantile_cutoff(df: DataFrame, test_share: float, time: str = "time") -> DataFrame:
    """One row `cutoff`: the distinct time at position floor(n * (1 - test_share)).

    Distinct times are ranked in range partitions, so no task sorts them all.
    """
    ranked = saved(range_rank(df.select(time).distinct(), time, "i"), "times")
    n = ranked.count()
    at = min(n - 1, int(n * (1 - test_share)))
    return ranked.filter(F.col("i") - 1 == at).select(F.col(time).alias("cutoff"))


def split_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("part").agg(F.count("*").alias("n_rows"), F.count_distinct("station_id").alias("n_stations"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))


def tail_rows(obs: DataFrame, n: int) -> DataFrame:
    """The last n rows of each station."""
    w = Window.partitionBy("station_id").orderBy(F.desc("time"), F.desc("obs_id"))
    return obs.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")


def systematic_sample(obs: DataFrame, n: int) -> DataFrame:
    """n rows of each longer station at even places, first and last included: places floor(k * (rows - 1) / (n - 1))."""
    w = by_station()
    out = obs.withColumn("i", F.row_number().over(w) - 1).withColumn("rows", F.count("*").over(Window.partitionBy("station_id")))
    if n == 1:
        return out.filter((F.col("rows") <= 1) | (F.col("i") == 0)).drop("i", "rows")
    i, m = F.col("i"), F.col("rows") - 1
    k = F.ceil(i * (n - 1) / F.when(m > 0, m)).cast("long")  # the least k whose place is not before i
    hit = F.floor(k * m / F.lit(float(n - 1))).cast("long") == i
    return out.filter((F.col("rows") <= n) | hit).drop("i", "rows")


def station_holdout(stations: DataFrame, share: float) -> DataFrame:
    """Column held_out: the first max(1, round(n * share)) stations in the order of a fixed multiplicative hash."""
    n = stations.count()
    k = max(1, round(n * share))
    key = (F.col("station_id") * 48271) % 2147483647
    held = stations.orderBy(key, "station_id").limit(k).select("station_id", F.lit(True).alias("held_out"))
    return stations.join(held, "station_id", "left").withColumn("held_out", F.coalesce("held_out", F.lit(False)))


def asof(left: DataFrame, right: DataFrame, time: str, right_time: str, values: Sequence[str], buckets: str = "day") -> DataFrame:
    """Last right row at or before each left row; before the first one, the first.

    Both sides are dealt by calendar bucket, so no task holds the whole time line: within a bucket
    the last row so far is a window over the union; a bucket's opening value is the last one of
    earlier buckets, a table with a row a bucket.
    """
    r = right.select(F.col(right_time).alias("_t"), F.struct(F.col(right_time).alias("_at"), *values).alias("_v"))
    r = r.groupBy("_t").agg(F.max("_v").alias("_v")).withColumn("_side", F.lit(0))
    row = F.struct(*left.columns)
    u = left.select(F.col(time).alias("_t"), row.alias("_row"), F.lit(1).alias("_side")).unionByName(r, allowMissingColumns=True)
    u = u.withColumn("_b", F.date_trunc(buckets, "_t"))
    w = Window.partitionBy("_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("_last", F.last("_v", ignorenulls=True).over(w))
    ends = u.groupBy("_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_t"))).alias("_v"))
    over = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    opening = ends.select("_b", F.last("_v", ignorenulls=True).over(over).alias("_open"))
    first = r.agg(F.min_by("_v", "_t").alias("_first"))
    out = u.filter("_side = 1").join(opening, "_b", "left").crossJoin(F.broadcast(first))  # one row
    v = F.coalesce("_last", "_open", "_first")
    return out.select("_row.*", *[v[c].alias(c) for c in values])


def fill_both(df: DataFrame, values: Sequence[str], order: Sequence[str], bucket: Column) -> DataFrame:
    """Forward fill, then back fill, over the whole order; dealt by a bucket that is monotone in the order.

    What comes after a row is read backwards: a frame that ends at the last row would be added up anew for each row. Buckets may be as
    many as stations, so their ends are ordered in range parts, and only a row a part meets in one task.
    """
    df = df.withColumn("_b", bucket)
    down = [F.desc(c) for c in order]
    inside, back = (Window.partitionBy("_b").orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in (order, down))
    out = df.withColumns({f"_f_{c}": F.last(c, ignorenulls=True).over(inside) for c in values} | {f"_n_{c}": F.last(c, ignorenulls=True).over(back) for c in values})
    key = F.struct(*order)
    ends = df.groupBy("_b").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), key)).alias(f"_l_{c}") for c in values], *[F.min_by(c, F.when(F.col(c).isNotNull(), key)).alias(f"_e_{c}") for c in values]
    )
    ends = saved(ends.repartitionByRange("_b").withColumn("_p", F.spark_partition_id()), "ends")
    parts = ends.groupBy("_p").agg(
        *[F.max_by(f"_l_{c}", F.when(F.col(f"_l_{c}").isNotNull(), F.struct("_b"))).alias(f"_l_{c}") for c in values], *[F.min_by(f"_e_{c}", F.when(F.col(f"_e_{c}").isNotNull(), F.struct("_b"))).alias(f"_e_{c}") for c in values]
    )
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    prior, later = past(Window.orderBy("_p")), past(Window.orderBy(F.desc("_p")))  # a row a part
    parts = parts.select("_p", *[F.last(f"_l_{c}", True).over(prior).alias(f"_q_{c}") for c in values], *[F.last(f"_e_{c}", True).over(later).alias(f"_t_{c}") for c in values])
    prior, later = past(Window.partitionBy("_p").orderBy("_b")), past(Window.partitionBy("_p").orderBy(F.desc("_b")))
    ends = ends.select("_b", "_p", *[F.last(f"_l_{c}", True).over(prior).alias(f"_p_{c}") for c in values], *[F.last(f"_e_{c}", True).over(later).alias(f"_s_{c}") for c in values]).join(parts, "_p")
    out = out.join(ends.hint("merge"), out["_b"].eqNullSafe(ends["_b"]))
    out = out.withColumns({c: F.coalesce(f"_f_{c}", f"_p_{c}", f"_q_{c}", f"_n_{c}", f"_s_{c}", f"_t_{c}") for c in values})
    return out.select(*[c for c in df.columns if c != "_b"])
