"""The forecasting features of a station, a time and a horizon, for training rows and for requests alike."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.functions.scalar import clip, finite
from gridlark.functions.timefn import add_minutes, calendar
from gridlark.operators import ml
from gridlark.operators.profiles import mean_of, profile_cube, profile_features, station_profiles
from gridlark.operators.timeseries import asof, serve_state

# Names of the features and their sets.
HORIZON = ["prediction_horizon_min", "horizon_sqrt"]
CURRENT = ["current_weekday", "current_hour_sin", "current_hour_cos", "current_is_holiday", "current_is_morning_peak", "current_is_evening_peak"]
TARGET = ["target_weekday", "target_hour_sin", "target_hour_cos", "target_is_holiday", "target_is_morning_peak", "target_is_evening_peak"]
WEATHER = ["temperature", "humidity", "rain"]
STATIC = ["longitude", "latitude", "charge_count", "TAZID"]
PRICE = ["s_price", "e_price"]
POI = [
    "poi_total_count", "poi_lifestyle_services_count", "poi_business_residential_count", "poi_food_beverage_count", "poi_lifestyle_ratio", "poi_business_residential_ratio", "poi_food_beverage_ratio",
]
HISTORY = ["station_avg_occupancy", "station_peak_avg_occupancy", "station_avg_duration", "station_same_hour_occupancy", "global_same_hour_occupancy"]
NEIGHBOR = [
    "neighbor_count", "neighbor_avg_distance_m", "neighbor_avg_station_occupancy", "neighbor_max_station_occupancy", "neighbor_avg_peak_occupancy", "neighbor_avg_duration",
    "neighbor_avg_charge_count", "neighbor_avg_same_hour_occupancy", "neighbor_avg_same_weekday_hour_occupancy",
]
LAG = ["occupancy_lag_1", "occupancy_lag_3", "occupancy_lag_6", "occupancy_lag_12", "occupancy_rolling_mean_6", "occupancy_rolling_mean_12", "occupancy_rolling_std_12", "occupancy_trend_12"]
CONTEXT = [*HORIZON, *CURRENT, *TARGET, *WEATHER, *STATIC, *PRICE, *POI, *HISTORY, *NEIGHBOR]
ALL = [*CONTEXT, *LAG]
SETS = {
    "all": ALL,
    "history_core_lag": [*HORIZON, *CURRENT[:3], *HISTORY, *LAG],
    "lag_only": [*HORIZON, *TARGET, *LAG],
    "context_only": CONTEXT,
}

STATE = {"lag_1": "occupancy_lag_1", "lag_3": "occupancy_lag_3", "lag_6": "occupancy_lag_6", "lag_12": "occupancy_lag_12", "mean_6": "occupancy_rolling_mean_6", "mean_12": "occupancy_rolling_mean_12", "std_12": "occupancy_rolling_std_12", "trend_12": "occupancy_trend_12"}


def neighbor_columns(keys: DataFrame, fit: DataFrame, stations: DataFrame, neighbors: DataFrame) -> DataFrame:
    """Rows (station_id, hour, weekday) with the nine neighbour features; fit has calendar columns, or is the table of profile_sums.

    A neighbour without a profile counts with the profile of all stations, and so does a station without neighbours.
    """
    own = station_profiles(fit).join(stations.select("station_id", "charge_count"), "station_id", "left").withColumnRenamed("station_id", "neighbor_id")
    own = own.withColumnRenamed("avg_duration", "duration_mean")
    hour = fit.groupBy(F.col("station_id").alias("neighbor_id"), "hour").agg(mean_of(fit).alias("nh"))
    week = fit.groupBy(F.col("station_id").alias("neighbor_id"), "hour", "weekday").agg(mean_of(fit).alias("nw"))
    g = own.agg(F.avg("peak_occ").alias("g_peak"), F.avg("duration_mean").alias("g_duration"), F.avg("charge_count").alias("g_charge")).crossJoin(fit.agg(mean_of(fit).alias("g_occ")))  # one row each
    gh = fit.groupBy("hour").agg(mean_of(fit).alias("gh"))
    gw = fit.groupBy("hour", "weekday").agg(mean_of(fit).alias("gw"))
    fixed = neighbors.join(own, "neighbor_id", "left").crossJoin(F.broadcast(g)).groupBy("station_id").agg(  # one row
        F.count("*").cast("double").alias("neighbor_count"), (F.avg("distance_km") * 1000).alias("neighbor_avg_distance_m"),
        F.avg(F.coalesce("avg_occ", "g_occ")).alias("neighbor_avg_station_occupancy"), F.max(F.coalesce("avg_occ", "g_occ")).alias("neighbor_max_station_occupancy"),
        F.avg(F.coalesce("peak_occ", "g_peak")).alias("neighbor_avg_peak_occupancy"), F.avg(F.coalesce("duration_mean", "g_duration")).alias("neighbor_avg_duration"),
        F.avg(F.coalesce("charge_count", "g_charge")).alias("neighbor_avg_charge_count"),
    )
    timed = keys.join(neighbors.select("station_id", "neighbor_id"), "station_id").join(hour, ["neighbor_id", "hour"], "left").join(week, ["neighbor_id", "hour", "weekday"], "left")
    timed = timed.join(F.broadcast(gh), "hour", "left").join(F.broadcast(gw), ["hour", "weekday"], "left").crossJoin(F.broadcast(g.select("g_occ")))  # 24, 168 and 1 rows
    timed = timed.groupBy("station_id", "hour", "weekday").agg(
        F.avg(F.coalesce("nh", "gh", "g_occ")).alias("neighbor_avg_same_hour_occupancy"), F.avg(F.coalesce("nw", "gw", "g_occ")).alias("neighbor_avg_same_weekday_hour_occupancy"),
    )
    out = keys.join(fixed, "station_id", "left").join(timed, ["station_id", "hour", "weekday"], "left").crossJoin(F.broadcast(g))  # one row
    out = out.join(F.broadcast(gh), "hour", "left").join(F.broadcast(gw), ["hour", "weekday"], "left")
    lone = {
        "neighbor_count": F.lit(0.0), "neighbor_avg_distance_m": F.lit(0.0), "neighbor_avg_station_occupancy": F.col("g_occ"), "neighbor_max_station_occupancy": F.col("g_occ"),
        "neighbor_avg_peak_occupancy": F.col("g_peak"), "neighbor_avg_duration": F.col("g_duration"), "neighbor_avg_charge_count": F.col("g_charge"),
        "neighbor_avg_same_hour_occupancy": F.coalesce("gh", "g_occ"), "neighbor_avg_same_weekday_hour_occupancy": F.coalesce("gw", "g_occ"),
    }
    return out.select("station_id", "hour", "weekday", *[F.coalesce(F.col(c), v).alias(c) for c, v in lone.items()])


def assemble(rows: DataFrame, fit: DataFrame, stations: DataFrame, weather: DataFrame, poi: DataFrame, neighbors: DataFrame) -> DataFrame:
    """rows with all features.

    rows: (station_id, time, horizon_min, s_price, e_price, lags and rolling values, other columns); fit: observations with
    calendar columns that profiles are taken from; stations: (station_id, lon, lat, charge_count, tazid); weather: by
    weather_hour; poi: the counts of count_within; neighbors: (station_id, neighbor_id, distance_km).
    """
    own = [c for c in rows.columns if c not in STATE]
    out = calendar(rows.withColumnsRenamed(STATE))
    out = profile_features(fit, out)
    keys = out.select("station_id", "hour", "weekday").distinct()
    out = out.join(neighbor_columns(keys, fit, stations, neighbors), ["station_id", "hour", "weekday"], "left")
    out = out.withColumn("_target", add_minutes(F.col("time"), F.col("horizon_min"))).withColumn("_hour", F.date_trunc("hour", "time").cast("timestamp_ntz"))
    out = calendar(out, "_target", "target_")
    out = asof(out, weather, "_hour", "weather_hour", WEATHER)
    share = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("total").cast("double")), F.lit(0.0))
    p = poi.select(
        "station_id", F.col("total").alias("poi_total_count"), F.col("lifestyle_services").alias("poi_lifestyle_services_count"), F.col("business_residential").alias("poi_business_residential_count"),
        F.col("food_beverage").alias("poi_food_beverage_count"), share("lifestyle_services").alias("poi_lifestyle_ratio"), share("business_residential").alias("poi_business_residential_ratio"),
        share("food_beverage").alias("poi_food_beverage_ratio"),
    )
    s = stations.select("station_id", F.col("lon").alias("longitude"), F.col("lat").alias("latitude"), "charge_count", F.col("tazid").alias("TAZID"))
    out = out.join(s, "station_id", "left").join(p, "station_id", "left").withColumnsRenamed({
        "p_avg": "station_avg_occupancy", "p_peak": "station_peak_avg_occupancy", "p_duration": "station_avg_duration", "p_hour": "station_same_hour_occupancy", "p_global_hour": "global_same_hour_occupancy",
    })
    out = out.withColumns({"prediction_horizon_min": F.col("horizon_min"), "horizon_sqrt": F.sqrt("horizon_min")} | {f"current_{c}": F.col(c) for c in ("weekday", "hour_sin", "hour_cos", "is_holiday", "is_morning_peak", "is_evening_peak")})
    out = ml.align_features(out, ALL)
    return out.select(*[c for c in own if c not in ALL], *ALL)


def bounded_horizon(minutes, low: float = 5.0, high: float = 120.0):
    return clip(minutes, low, high)


def serving_features(requests: DataFrame, now: str, obs: DataFrame, fit: DataFrame, stations: DataFrame, weather: DataFrame, poi: DataFrame, neighbors: DataFrame) -> DataFrame:
    """Features of requests (station_id, horizon_min) at one time; stations with too short a history have no row."""
    at = F.lit(now).cast("timestamp_ntz")
    state = serve_state(obs, at)
    rows = requests.withColumn("horizon_min", bounded_horizon(F.col("horizon_min"))).join(state, "station_id").withColumn("time", at)
    return assemble(rows, fit, stations, weather, poi, neighbors)


def predict_requests(model: PipelineModel, requests: DataFrame, features: DataFrame, names: Sequence[str] = ALL) -> DataFrame:
    """One row a request: predicted occupancy and the time it is for; null, with its reason, where there is no history or no time of arrival."""
    got = ml.predict(model, features, names)
    got = got.select("station_id", "horizon_min", F.col("prediction").alias("predicted_occupancy"), add_minutes(F.col("time"), F.col("horizon_min")).alias("prediction_time"))
    out = requests.withColumn("horizon_min", bounded_horizon(F.col("horizon_min"))).join(got, ["station_id", "horizon_min"], "left")
    return out.withColumn("source", F.when(F.col("predicted_occupancy").isNull(), "insufficient_history").otherwise("history"))


@dataclass
class Forecast:
    """What predictions on arrival need: a model and its features' names, the history, and tables made from it once.

    sums: profile_sums of the rows that profiles may see; neighbors: (station_id, neighbor_id, distance_km).
    """

    model: PipelineModel
    obs: DataFrame
    sums: DataFrame
    weather: DataFrame
    neighbors: DataFrame
    names: Sequence[str] = tuple(ALL)

    def on_arrival(self, requests: DataFrame, now: str, stations: DataFrame, poi: DataFrame) -> DataFrame:
        """One row a request (station_id, drive_min): occupancy, horizon_min, prediction_time, source.

        The horizon is the drive time within 5 and 120 minutes. A station with too short a history has its usual occupancy at the weekday
        and hour of arrival (source `profile`); without that, or without a way there, none (`insufficient_history`). requests: the few candidates of
        one request, so history and neighbours are first cut down to them.
        """
        requests = requests.withColumn("drive_min", finite(F.col("drive_min")))
        asked = requests.filter("drive_min is not null").select("station_id", F.col("drive_min").alias("horizon_min"))
        few = F.broadcast(asked.select("station_id"))  # the candidates of one request
        near = self.neighbors.join(few, "station_id", "left_semi")
        features = serving_features(asked, now, self.obs.join(few, "station_id", "left_semi"), self.sums, stations, self.weather, poi, near)
        told = predict_requests(self.model, asked, features, self.names)
        arrival = add_minutes(F.lit(now).cast("timestamp_ntz"), F.col("drive_min"))
        usual = profile_cube(self.sums.join(few, "station_id", "left_semi")).select("station_id", "hour", "weekday", F.col("same_weekday_hour_occ").alias("_usual"))
        out = requests.select("station_id", "drive_min").withColumns({"arrival": arrival, "hour": F.hour(arrival), "weekday": F.weekday(arrival), "_h": bounded_horizon(F.col("drive_min"))})
        out = out.join(told.drop("horizon_min", "source"), "station_id", "left").join(usual, ["station_id", "hour", "weekday"], "left")
        known, usual = F.col("predicted_occupancy").isNotNull(), F.col("_usual").isNotNull()
        return out.select(
            "station_id", "arrival", F.coalesce("predicted_occupancy", clip(F.col("_usual"), 0, 1)).alias("occupancy"), F.when(known | usual, F.col("_h")).alias("horizon_min"),
            F.when(known, F.col("prediction_time")).when(usual, F.col("arrival")).alias("prediction_time"), F.when(known, "history").when(usual, "profile").otherwise("insufficient_history").alias("source"),
        )


def at_horizons(features: DataFrame, horizons: Sequence[float]) -> DataFrame:
    """Rows of features once for each horizon, whole minutes or not, with what depends on it made anew."""
    out = features.drop("horizon_min").withColumn("horizon_min", F.explode(F.array(*[F.lit(float(h)) for h in horizons])))
    out = calendar(out.withColumn("_target", add_minutes(F.col("time"), F.col("horizon_min"))), "_target", "target_")
    return out.withColumns({"prediction_horizon_min": F.col("horizon_min"), "horizon_sqrt": F.sqrt("horizon_min")}).withColumnRenamed("_target", "target_time").drop("target_hour")
