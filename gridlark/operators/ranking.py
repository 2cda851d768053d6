"""Orders of recommended stations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = {
    "balanced": ["score", "drive_min", "distance_km"],
    "drive_time": ["drive_min", "distance_km", "occupancy"],
    "distance": ["distance_km", "drive_min", "occupancy"],
    "occupancy": ["occupancy", "drive_min", "distance_km"],
    "arrival_soc": ["arrival_soc", "drive_min", "distance_km"],
}


def order_of(metric: str) -> list[Column]:
    """Sort columns, nulls last; only the charge on arrival is better when higher. Ties go to the lower id."""
    if metric not in METRICS:
        raise ValueError(f"unknown ranking metric {metric!r}")
    return [F.desc_nulls_last(c) if c == "arrival_soc" else F.asc_nulls_last(c) for c in METRICS[metric]] + [F.asc("station_id")]


def ranked(df: DataFrame, metric: str, top: int) -> DataFrame:
    """The best rows by one metric: a per-task top-k and a merge, no full sort."""
    best = df.orderBy(*order_of(metric)).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order_of(metric))))


def orders(df: DataFrame, top: int) -> DataFrame:
    """Rows (metric, rank, station_id) of all metrics."""
    out = None
    for m in METRICS:
        part = ranked(df.select("station_id", "score", "drive_min", "distance_km", "occupancy", "arrival_soc"), m, top).select(F.lit(m).alias("metric"), "rank", "station_id")
        out = part if out is None else out.unionByName(part)
    return out


def order_map(df: DataFrame, top: int) -> DataFrame:
    """One row: a map from each metric to its ordered station ids."""
    o = orders(df, top).groupBy("metric").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "station_id"))), lambda x: x["station_id"]).alias("ids"))
    return o.agg(F.map_from_entries(F.collect_list(F.struct("metric", "ids"))).alias("ranking_orders"))


def feasible_or_all(df: DataFrame) -> DataFrame:
    """Rows that passed, or all rows if none did."""
    any_ok = df.agg(F.max("passed").alias("_any"))
    return df.crossJoin(F.broadcast(any_ok)).filter(F.col("passed") | ~F.col("_any")).drop("_any")  # one row
