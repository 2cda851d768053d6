"""Historical profiles of stations and their fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _peak():
    return (F.col("is_morning_peak") == 1) | (F.col("is_evening_peak") == 1)


def profile_sums(obs: DataFrame) -> DataFrame:
    """Sums and counts by station, hour and weekday, from which all profiles are taken: 168 rows a station at most.

    obs has calendar columns, or is such a table already.
    """
    if "occ_sum" in obs.columns:
        return obs
    sums = [f(c).alias(f"{c}_{n}") for c in ("occ", "duration") for f, n in ((F.sum, "sum"), (F.count, "n"))]
    return obs.groupBy("station_id", "hour", "weekday", "is_morning_peak", "is_evening_peak").agg(*sums)


def mean_of(obs: DataFrame, c: str = "occ", where: Column | None = None) -> Column:
    """Aggregate over observations, or over their profile_sums: the mean of the rows that fit."""
    if f"{c}_sum" not in obs.columns:
        return F.avg(c if where is None else F.when(where, F.col(c)))
    total, n = (F.sum(F.col(f"{c}_{k}") if where is None else F.when(where, F.col(f"{c}_{k}"))) for k in ("sum", "n"))
    return F.try_divide(F.round(total, 9), n)  # sums of sums: their order is not to show


def station_profiles(obs: DataFrame) -> DataFrame:
    """Mean, peak mean (the mean where a station has no peak row) and mean duration of each station."""
    out = obs.groupBy("station_id").agg(mean_of(obs).alias("avg_occ"), mean_of(obs, "occ", _peak()).alias("peak_occ"), mean_of(obs, "duration").alias("avg_duration"))
    return out.withColumn("peak_occ", F.coalesce("peak_occ", "avg_occ"))


def grouped_means(obs: DataFrame) -> DataFrame:
    """Means by station, hour, weekday and their combinations in one pass; grouping_id tells which."""
    sets = [["station_id"], ["hour"], ["weekday", "hour"], ["station_id", "hour"], ["station_id", "weekday", "hour"], []]
    by = ["station_id", "hour", "weekday"]
    cube = obs.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in by])
    return cube.agg(F.grouping_id(*by).alias("gid"), F.avg("occ").alias("mean_occ"), F.count("*").alias("n"))


def profile_features(fit: DataFrame, rows: DataFrame) -> DataFrame:
    """Profiles fitted on one part and joined to the rows: each falls back to a coarser one, at last to the global mean."""
    whole = fit.agg(mean_of(fit).alias("g_all"))
    st = station_profiles(fit)
    by_hour = fit.groupBy("hour").agg(mean_of(fit).alias("g_hour"))
    by_wh = fit.groupBy("weekday", "hour").agg(mean_of(fit).alias("g_wh"))
    sh = fit.groupBy("station_id", "hour").agg(mean_of(fit).alias("s_hour"))
    swh = fit.groupBy("station_id", "weekday", "hour").agg(mean_of(fit).alias("s_wh"))
    out = rows.join(st.withColumnRenamed("avg_duration", "s_duration"), "station_id", "left").join(sh, ["station_id", "hour"], "left").join(swh, ["station_id", "weekday", "hour"], "left")
    out = out.join(F.broadcast(by_hour), "hour", "left").join(F.broadcast(by_wh), ["weekday", "hour"], "left").crossJoin(F.broadcast(whole))  # 24, 168 and 1 rows
    return out.select(
        *rows.columns, F.coalesce("avg_occ", "g_all").alias("p_avg"), F.coalesce("peak_occ", "g_all").alias("p_peak"), F.coalesce("s_duration", F.lit(0.0)).alias("p_duration"),
        F.coalesce("s_hour", "g_hour", "g_all").alias("p_hour"), F.coalesce("s_wh", "s_hour", "g_wh", "g_hour", "g_all").alias("p_weekday_hour"), F.coalesce("g_hour", "g_all").alias("p_global_hour"),
    )


def profile_cube(obs: DataFrame) -> DataFrame:
    """24 hours x (any weekday -1, weekdays 0..6) for every station; empty cells fall back to the hour, then the station."""
    spark = obs.sparkSession
    st = station_profiles(obs)
    cells = spark.range(24).select(F.col("id").cast("int").alias("hour")).crossJoin(spark.range(-1, 7).select(F.col("id").cast("int").alias("weekday")))
    hour = obs.groupBy("station_id", "hour").agg(mean_of(obs).alias("h"))
    wh = obs.groupBy("station_id", "weekday", "hour").agg(mean_of(obs).alias("w"))
    out = st.crossJoin(F.broadcast(cells)).join(hour, ["station_id", "hour"], "left").join(wh, ["station_id", "weekday", "hour"], "left")  # 192 cells
    same_hour = F.coalesce("h", "avg_occ")
    return out.select("station_id", "hour", "weekday", "avg_occ", "peak_occ", "avg_duration", same_hour.alias("same_hour_occ"), F.when(F.col("weekday") == -1, same_hour).otherwise(F.coalesce("w", same_hour)).alias("same_weekday_hour_occ"))


def neighbor_features(neighbors: DataFrame, profile: DataFrame) -> DataFrame:
    """Mean, largest and number of neighbours' finite values; a station without any keeps its own."""
    v = profile.select(F.col("station_id").alias("neighbor_id"), F.col("avg_occ").alias("v"))
    ok = F.when(~F.isnan("v"), F.col("v"))
    agg = neighbors.join(v, "neighbor_id").groupBy("station_id").agg(F.avg(ok).alias("n_mean"), F.max(ok).alias("n_max"), F.count(ok).alias("n_count"))
    own = profile.select("station_id", "avg_occ")
    return own.join(agg, "station_id", "left").select(
        "station_id", F.coalesce("n_mean", "avg_occ").alias("neighbor_mean"), F.coalesce("n_max", "avg_occ").alias("neighbor_max"), F.coalesce("n_count", F.lit(0)).alias("neighbor_count")
    )
