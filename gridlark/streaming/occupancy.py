"""Structured Streaming forms of the station operators (an extension: the batch forms are the standard)."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def slot_means(obs: DataFrame, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """Mean ratio of each station and slot; rows later than the watermark are left out."""
    ok = obs.filter(F.col("busy") + F.col("idle") > 0).withColumn("occ", F.col("busy") / (F.col("busy") + F.col("idle")))
    w = ok.withWatermark("time", late).groupBy(F.window("time", f"{minutes} minutes"), "station_id")
    return w.agg(F.count("*").alias("n"), F.avg("occ").alias("mean_occ")).select("station_id", F.col("window.start").alias("slot"), "n", "mean_occ")


class _LastRows(StatefulProcessor):
    """The latest rows of a station by (time, obs_id), whatever the order they come in."""

    def __init__(self, rows: int, ttl_ms: int | None):
        self.rows, self.ttl = rows, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", KEPT, self.ttl)

    def handleInputRows(self, key, parts: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        old = [tuple(r) for r in self.held.get()]
        new = pd.concat(parts)
        new = new[new.busy + new.idle > 0]
        times = new.time.astype("datetime64[us]").astype("int64")
        rows = zip(times.tolist(), new.obs_id.tolist(), (new.busy / (new.busy + new.idle)).tolist(), new.s_price.tolist(), new.e_price.tolist(), strict=True)
        held = sorted({*old, *rows})[-self.rows :]
        if not held:
            return
        self.held.put(held)
        occ = [r[2] for r in reversed(held)]
        at = lambda k: occ[k - 1] if len(occ) >= k else None
        past = pd.Series(occ[1:], dtype=float)
        lag = {"lag_1": at(2), "lag_3": at(4), "lag_6": at(7), "lag_12": at(self.rows)}
        yield pd.DataFrame([{
            "station_id": key[0], "time": pd.Timestamp(held[-1][0], unit="us"), "n": len(held), "s_price": held[-1][3], "e_price": held[-1][4], **lag, "mean_6": past[:6].mean(), "mean_12": past.mean(),
            "std_12": past.std(), "trend_12": None if lag["lag_12"] is None else lag["lag_1"] - lag["lag_12"],
        }])

    def close(self) -> None:
        pass


KEPT = "time long, obs_id long, occ double, s_price double, e_price double"
SERVED = "station_id long, time timestamp, n long, s_price double, e_price double, lag_1 double, lag_3 double, lag_6 double, lag_12 double, mean_6 double, mean_12 double, std_12 double, trend_12 double"


def serving_states(obs: DataFrame, rows: int = 12, keep: timedelta | None = None) -> DataFrame:
    """For each station with new rows its state as of them: the columns of serve_state, from keyed state of its last rows.

    Late rows take their place by time, and a row that comes twice counts once. With `keep`, a station that is silent for longer gives up its state; such a
    stream goes by the clock, so it makes batches without data unless spark.sql.streaming.noDataMicroBatches.enabled is off.
    The session must name a state store that keeps typed state, as RocksDB's does.
    """
    step = _LastRows(rows, None if keep is None else int(keep.total_seconds() * 1000))
    return obs.groupBy("station_id").transformWithStateInPandas(step, SERVED, "Update", "None" if keep is None else "ProcessingTime")


def hourly(weather: DataFrame) -> DataFrame:
    """weather with a row for each hour from its first to its last: gaps have the values of the hour before them.

    One place's hours are few, so one window orders them all.
    """
    nxt = F.lead("weather_hour").over(Window.orderBy("weather_hour"))
    w = weather.withColumn("_until", F.coalesce(nxt - F.expr("interval 1 hour"), F.col("weather_hour")))
    return w.withColumn("weather_hour", F.explode(F.sequence("weather_hour", "_until", F.expr("interval 1 hour")))).drop("_until")


def with_weather(states: DataFrame, weather: DataFrame) -> DataFrame:
    """The states of a stream with the last weather at or before their hour: an equal join with the static table of all hours. After its end there is none."""
    w = hourly(weather).withColumn("weather_hour", F.col("weather_hour").cast("timestamp"))
    return states.join(w, F.date_trunc("hour", "time") == F.col("weather_hour"), "left").drop("weather_hour")
