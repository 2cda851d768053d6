"""Feasibility of stations before and after the route search; the first failing check names the reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIRED = [
    "station_id", "lat", "lon", "charge_count", "road_edge_u", "road_edge_v", "road_edge_key", "road_projection_lat", "road_projection_lon", "road_snap_distance_m", "access_node",
]


# The limits' defaults, the reasons' names and the order of the checks.
@dataclass(frozen=True)
class Limits:
    max_candidates: int = 20
    max_search_radius_km: float = 10.0
    max_drive_time_min: float = 30.0
    current_soc: float = 0.5
    battery_capacity_kwh: float = 60.0
    min_arrival_soc: float = 0.1
    min_charge_count: int = 1
    consumption_kwh_per_km: float = 0.188
    max_road_snap_distance_m: float = 150.0
    max_start_snap_distance_m: float = 300.0

    def __post_init__(self):
        if self.max_candidates < 1 or self.battery_capacity_kwh <= 0 or not 0 <= self.current_soc <= 1 or not 0 <= self.min_arrival_soc <= 1:
            raise ValueError("limits out of range")


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that holds, null if none does."""
    out = F.lit(None).cast("string")
    for name, bad in reversed(checks):
        out = F.when(bad, name).otherwise(out)
    return out


def pre_reason(limits: Limits, columns: list[str]) -> Column:
    """Null if the station may be searched for, else why not."""
    missing = [(f"missing_{c}", F.col(c).isNull() if c in columns else F.lit(True)) for c in REQUIRED]
    return first_reason([
        *missing,
        ("outside_search_radius", F.col("straight_km") > limits.max_search_radius_km),
        ("too_few_chargers", F.col("charge_count") < limits.min_charge_count),
        ("road_snap_distance_too_far", F.col("road_snap_distance_m") > limits.max_road_snap_distance_m),
    ])


def pre_check(stations: DataFrame, limits: Limits) -> DataFrame:
    return stations.withColumn("reject_reason", pre_reason(limits, stations.columns))


def post_check(routes: DataFrame, limits: Limits) -> DataFrame:
    """reject_reason and arrival_soc of routes with path_found, distance_km and drive_min.

    arrival_soc is null for all refusals but that for too low a charge on arrival.
    """
    have = F.lit(limits.battery_capacity_kwh * limits.current_soc)
    need = F.col("distance_km") * F.lit(limits.consumption_kwh_per_km)
    soc = (have - need) / F.lit(limits.battery_capacity_kwh)
    hard = [
        ("path_not_found", ~F.col("path_found")),
        ("missing_route_metrics", F.col("distance_km").isNull() | F.col("drive_min").isNull()),
        ("drive_time_exceeds_limit", F.col("drive_min") > limits.max_drive_time_min),
        ("insufficient_energy", need > have),
    ]
    low = ("arrival_soc_below_safety_threshold", soc < F.lit(limits.min_arrival_soc))
    return routes.withColumn("reject_reason", first_reason([*hard, low])).withColumn("arrival_soc", F.when(first_reason(hard).isNull(), soc))
