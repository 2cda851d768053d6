"""Queries over station time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions.scalar import clip, html_escape, list_literal, occupancy_badge, parse_coordinates
from gridlark.functions.timefn import HOLIDAYS, calendar, ceil_hour, floor_minutes, replay_clock
from gridlark.operators import profiles as P
from gridlark.operators import timeseries as T
from gridlark.operators.ranking import feasible_or_all
from gridlark.plans.helpers import big, r6, s6, sb, st, stamp
from gridlark.sources import scenario as S

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
HOL = ", ".join(f"'{d}'" for d in HOLIDAYS)
W = "PARTITION BY station_id ORDER BY time, obs_id"
CUT, VALID = "2024-01-20 00:00:00", "2024-01-15 00:00:00"
NOW = "2024-01-25 14:37:12"


def key() -> list:
    return [big("station_id"), big("obs_id")]


def query(sql: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = (f"WITH {S.ctes(*views)} " if views and not sql.startswith(",") else f"WITH {S.ctes(*views)}" if views else "") + sql
        return f

    return add


def obs(spark: SparkSession, sf: str) -> DataFrame:
    return T.occupancy(S.observation(spark, sf))


def t(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query(f"SELECT station_id, obs_id, busy, idle, {s6('occ', 'occ')}, {s6('duration', 'duration')} FROM obs", "obs")
def occupancy_ratio(spark, sf):
    return obs(spark, sf).select(*key(), big("busy"), big("idle"), r6("occ"), r6("duration"))


@query(
    f"SELECT station_id, obs_id, {sb('hour(time)', 'hour')}, {sb('isodow(time) - 1', 'weekday')}, {s6('sin(2 * pi() * hour(time) / 24)', 'hour_sin')}, {s6('cos(2 * pi() * hour(time) / 24)', 'hour_cos')}, "
    f"(strftime(time, '%Y-%m-%d') IN ({HOL}))::BIGINT AS is_holiday, (hour(time) BETWEEN 7 AND 9)::BIGINT AS is_morning_peak, (hour(time) BETWEEN 17 AND 19)::BIGINT AS is_evening_peak FROM obs", "obs",
)
def time_features(spark, sf):
    return calendar(obs(spark, sf)).select(*key(), big("hour"), big("weekday"), r6("hour_sin"), r6("hour_cos"), big("is_holiday"), big("is_morning_peak"), big("is_evening_peak"))


@query(
    f"SELECT station_id, obs_id, {st('date_trunc(' + chr(39) + 'hour' + chr(39) + ', time) + to_minutes((minute(time) // 5 * 5)::BIGINT)', 'slot')}, "
    f"strftime(CASE WHEN date_trunc('hour', time) = time THEN time ELSE date_trunc('hour', time) + INTERVAL 1 HOUR END, '%Y-%m-%d %H:%M:%S') AS next_hour, "
    f"strftime(least(TIMESTAMP '2023-02-06' + to_days((isodow(time) - 1)::INTEGER) + to_hours(hour(time)::BIGINT) + to_minutes((minute(time) // 5 * 5)::BIGINT), TIMESTAMP '2023-02-12 23:55:00'), '%Y-%m-%d %H:%M:%S') AS replay FROM obs", "obs",
)
def clock_mapping(spark, sf):
    c = F.col("time")
    return obs(spark, sf).select(*key(), stamp("slot", floor_minutes(c, 5)), stamp("next_hour", ceil_hour(c)), stamp("replay", replay_clock(c)))


LAGS = ", ".join(s6(f"lag(occ, {k}) OVER ({W})", f"lag_{k}") for k in (1, 3, 6, 12))


@query(f"SELECT station_id, obs_id, {LAGS} FROM obs", "obs")
def lag_features(spark, sf):
    return T.lags(obs(spark, sf)).select(*key(), *[r6(f"lag_{k}") for k in (1, 3, 6, 12)])


def _roll(agg: str, n: int) -> str:
    w = f"({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(occ) OVER {w} = {n} THEN {agg}(occ) OVER {w} END"


ROLL = f"{s6(_roll('avg', 6), 'mean_6')}, {s6(_roll('avg', 12), 'mean_12')}, {s6(_roll('stddev_samp', 12), 'std_12')}"


@query(f"SELECT station_id, obs_id, {ROLL} FROM obs", "obs")
def rolling_features(spark, sf):
    return T.rolling(obs(spark, sf)).select(*key(), r6("mean_6"), r6("mean_12"), r6("std_12"))


TREND = s6(f"lag(occ, 1) OVER ({W}) - lag(occ, 12) OVER ({W})", "trend_12")


@query(f"SELECT * FROM (SELECT station_id, obs_id, {LAGS}, {ROLL}, {TREND} FROM obs) WHERE lag_12 IS NOT NULL", "obs")
def trend_warmup(spark, sf):
    return T.train_state(obs(spark, sf)).select(*key(), *[r6(c) for c in ("lag_1", "lag_3", "lag_6", "lag_12", "mean_6", "mean_12", "std_12", "trend_12")])


HOR = (5, 10, 30, 60)


@query(f"SELECT station_id, obs_id, {', '.join(s6(f'lead(occ, {h // 5}) OVER ({W})', f'target_{h}') for h in HOR)} FROM obs", "obs")
def horizon_targets(spark, sf):
    return T.horizon_targets(obs(spark, sf), HOR).select(*key(), *[r6(f"target_{h}") for h in HOR])


@query(
    f", h AS (SELECT station_id, obs_id, time, occ, unnest([{', '.join(map(str, HOR))}]) AS horizon_min, unnest([{', '.join(f'lead(occ, {h // 5}) OVER ({W})' for h in HOR)}]) AS target FROM obs) "
    f"SELECT station_id, obs_id, {sb('horizon_min', 'horizon_min')}, {s6('target', 'target')}, {s6('sqrt(horizon_min)', 'horizon_sqrt')}, {st('time + to_minutes(horizon_min::BIGINT)', 'target_time')} FROM h WHERE target IS NOT NULL", "obs",
)
def horizon_explode(spark, sf):
    out = T.horizon_explode(T.horizon_targets(obs(spark, sf), HOR), HOR)
    return out.select(*key(), big("horizon_min"), r6("target"), r6("horizon_sqrt"), stamp("target_time"))


@query(
    f", r AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY time DESC, obs_id DESC) AS rn FROM obs WHERE time <= TIMESTAMP '2024-01-25 14:35:00'), "
    f"s AS (SELECT station_id, count(*) AS n, max(s_price) FILTER (rn = 1) AS p, max(e_price) FILTER (rn = 1) AS e, max(occ) FILTER (rn = 2) AS a, max(occ) FILTER (rn = 4) AS b, max(occ) FILTER (rn = 7) AS c, max(occ) FILTER (rn = 12) AS d, "
    f"avg(occ) FILTER (rn BETWEEN 2 AND 7) AS m6, avg(occ) FILTER (rn > 1) AS m12, stddev_samp(occ) FILTER (rn > 1) AS s12 FROM r WHERE rn <= 12 GROUP BY station_id) "
    f"SELECT station_id, {s6('p', 's_price')}, {s6('e', 'e_price')}, {s6('a', 'lag_1')}, {s6('b', 'lag_3')}, {s6('c', 'lag_6')}, {s6('d', 'lag_12')}, {s6('m6', 'mean_6')}, {s6('m12', 'mean_12')}, {s6('s12', 'std_12')}, {s6('a - d', 'trend_12')} FROM s WHERE n = 12", "obs",
)
def serving_state_asof(spark, sf):
    out = T.serve_state(obs(spark, sf), t(NOW))
    return out.select(big("station_id"), *[r6(c) for c in ("s_price", "e_price", "lag_1", "lag_3", "lag_6", "lag_12", "mean_6", "mean_12", "std_12", "trend_12")])


@query(f"SELECT o.station_id, o.obs_id, {s6('temperature', 'temperature')}, {s6('humidity', 'humidity')}, {s6('rain', 'rain')} FROM obs o LEFT JOIN weather ON date_trunc('hour', o.time) = weather_hour", "obs", "weather")
def weather_left_join(spark, sf):
    o = obs(spark, sf).withColumn("weather_hour", F.date_trunc("hour", "time").cast("timestamp_ntz"))
    return o.join(S.weather(spark, sf), "weather_hour", "left").select(*key(), r6("temperature"), r6("humidity"), r6("rain"))


# A reading is known from the hour's last event on, so most rows take the hour before; the first ones have none yet.
ISSUED = "SELECT max(ts) AS issued, avg(value) AS temperature, max(value) AS rain FROM events GROUP BY date_trunc('hour', ts)"


@query(
    f", i AS ({ISSUED}) SELECT o.station_id, o.obs_id, {s6('coalesce(i.temperature, f.temperature)', 'temperature')}, {s6('coalesce(i.rain, f.rain)', 'rain')} FROM obs o ASOF LEFT JOIN i ON o.time >= i.issued, (SELECT * FROM i ORDER BY issued LIMIT 1) f", "obs", "weather",
)
def weather_asof(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("ts", "value")
    issued = e.groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.max("ts").alias("issued"), F.avg("value").alias("temperature"), F.max("value").alias("rain"))
    return T.asof(obs(spark, sf), issued, "time", "issued", ["temperature", "rain"]).select(*key(), r6("temperature"), r6("rain"))


# Hours with an even number of readings count as missing: all rows are answered, many of them by filling.
GAPS = "CASE WHEN humidity::BIGINT % 2 = 1 THEN temperature END"


@query(
    f", j AS (SELECT o.station_id, o.obs_id, o.time, {GAPS} AS temperature FROM obs o LEFT JOIN weather ON date_trunc('hour', o.time) = weather_hour) "
    f"SELECT station_id, obs_id, {s6('coalesce(last_value(temperature IGNORE NULLS) OVER (ORDER BY station_id, time, obs_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(temperature IGNORE NULLS) OVER (ORDER BY station_id, time, obs_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))', 'temperature')} FROM j", "obs", "weather",
)
def weather_fill(spark, sf):
    w = S.weather(spark, sf).withColumn("temperature", F.when(F.col("humidity").cast("long") % 2 == 1, F.col("temperature")))
    o = obs(spark, sf).withColumn("weather_hour", F.date_trunc("hour", "time").cast("timestamp_ntz")).join(w, "weather_hour", "left")
    return T.fill_both(o, ["temperature"], ["station_id", "time", "obs_id"], F.col("station_id")).select(*key(), r6("temperature"))


@query(f", p AS (SELECT *, CASE WHEN time >= TIMESTAMP '{CUT}' THEN 'test' ELSE 'train' END AS part FROM obs) SELECT part, count(*) AS n_rows, count(DISTINCT station_id) AS n_stations, {st('min(time)', 'first_time')}, {st('max(time)', 'last_time')} FROM p GROUP BY part", "obs")
def time_split_fixed(spark, sf):
    return T.split_summary(T.split_at(obs(spark, sf), t(CUT))).select("part", big("n_rows"), big("n_stations"), stamp("first_time"), stamp("last_time"))


@query(f", p AS (SELECT *, CASE WHEN time >= TIMESTAMP '{CUT}' THEN 'test' WHEN time >= TIMESTAMP '{VALID}' THEN 'valid' ELSE 'train' END AS part FROM obs) SELECT part, count(*) AS n_rows, count(DISTINCT station_id) AS n_stations, {st('min(time)', 'first_time')}, {st('max(time)', 'last_time')} FROM p GROUP BY part", "obs")
def three_way_split(spark, sf):
    return T.split_summary(T.split_at(obs(spark, sf), t(CUT), t(VALID))).select("part", big("n_rows"), big("n_stations"), stamp("first_time"), stamp("last_time"))


@query(f", d AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT time FROM obs)) SELECT {st('time', 'cutoff')} FROM d WHERE i = floor(n * (1 - 0.2::DOUBLE))", "obs")
def time_split_quantile(spark, sf):
    return T.quantile_cutoff(obs(spark, sf), 0.2).select(stamp("cutoff"))


@query("SELECT station_id, (row_number() OVER (ORDER BY (station_id * 48271) % 2147483647, station_id) <= greatest(1, round(count(*) OVER () * 0.2)))::BOOLEAN AS held_out FROM station", "station")
def station_holdout(spark, sf):
    return T.station_holdout(S.station(spark, sf), 0.2).select(big("station_id"), "held_out")


@query(
    ", r AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY time, obs_id) - 1 AS i, count(*) OVER (PARTITION BY station_id) AS n FROM obs) "
    "SELECT DISTINCT r.station_id, r.obs_id FROM r WHERE n <= 20 OR i IN (SELECT floor(k * (r.n - 1) / 19::DOUBLE)::BIGINT FROM range(20) q(k))", "obs",
)
def systematic_sample(spark, sf):
    return T.systematic_sample(obs(spark, sf), 20).select(*key())


@query("SELECT station_id, obs_id FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY time DESC, obs_id DESC) AS rn FROM obs) WHERE rn <= 5", "obs")
def tail_n(spark, sf):
    return T.tail_rows(obs(spark, sf), 5).select(*key())


PK = "hour(time) BETWEEN 7 AND 9 OR hour(time) BETWEEN 17 AND 19"


@query(f"SELECT station_id, {s6('avg(occ)', 'avg_occ')}, {s6(f'coalesce(avg(occ) FILTER ({PK}), avg(occ))', 'peak_occ')}, {s6('avg(duration)', 'avg_duration')} FROM obs GROUP BY station_id", "obs")
def station_profiles(spark, sf):
    return P.station_profiles(calendar(obs(spark, sf))).select(big("station_id"), r6("avg_occ"), r6("peak_occ"), r6("avg_duration"))


@query(
    f", c AS (SELECT *, isodow(time) - 1 AS weekday, hour(time) AS hour FROM obs) SELECT {sb('station_id', 'station_id')}, {sb('weekday', 'weekday')}, {sb('hour', 'hour')}, {sb('grouping_id(station_id, hour, weekday)', 'gid')}, {s6('avg(occ)', 'mean_occ')}, count(*) AS n "
    "FROM c GROUP BY GROUPING SETS ((station_id), (hour), (weekday, hour), (station_id, hour), (station_id, weekday, hour), ())", "obs",
)
def grouped_means(spark, sf):
    return P.grouped_means(calendar(obs(spark, sf))).select(big("station_id"), big("weekday"), big("hour"), big("gid"), r6("mean_occ"), big("n"))


@query(
    f", c AS (SELECT *, isodow(time) - 1 AS weekday, hour(time) AS hour FROM obs), f AS (SELECT * FROM c WHERE time < TIMESTAMP '{CUT}'), "
    f"s AS (SELECT station_id, avg(occ) AS a, coalesce(avg(occ) FILTER ({PK}), avg(occ)) AS p, avg(duration) AS d FROM f GROUP BY 1), h AS (SELECT hour, avg(occ) AS v FROM f GROUP BY 1), "
    "wh AS (SELECT weekday, hour, avg(occ) AS v FROM f GROUP BY 1, 2), sh AS (SELECT station_id, hour, avg(occ) AS v FROM f GROUP BY 1, 2), swh AS (SELECT station_id, weekday, hour, avg(occ) AS v FROM f GROUP BY 1, 2, 3), g AS (SELECT avg(occ) AS v FROM f) "
    f"SELECT c.station_id, c.obs_id, {s6('coalesce(s.a, g.v)', 'p_avg')}, {s6('coalesce(s.p, g.v)', 'p_peak')}, {s6('coalesce(s.d, 0)', 'p_duration')}, {s6('coalesce(sh.v, h.v, g.v)', 'p_hour')}, {s6('coalesce(swh.v, sh.v, wh.v, h.v, g.v)', 'p_weekday_hour')}, {s6('coalesce(h.v, g.v)', 'p_global_hour')} "
    f"FROM (SELECT * FROM c WHERE time >= TIMESTAMP '{CUT}') c LEFT JOIN s USING (station_id) LEFT JOIN h USING (hour) LEFT JOIN wh USING (weekday, hour) LEFT JOIN sh USING (station_id, hour) LEFT JOIN swh USING (station_id, weekday, hour), g", "obs",
)
def same_hour_profiles(spark, sf):
    o = T.split_at(calendar(obs(spark, sf)), t(CUT))
    out = P.profile_features(o.filter("part = 'train'"), o.filter("part = 'test'"))
    return out.select(*key(), *[r6(c) for c in ("p_avg", "p_peak", "p_duration", "p_hour", "p_weekday_hour", "p_global_hour")])


@query(
    f", c AS (SELECT *, isodow(time) - 1 AS weekday, hour(time) AS hour FROM obs), s AS (SELECT station_id, avg(occ) AS a, coalesce(avg(occ) FILTER ({PK}), avg(occ)) AS p, avg(duration) AS d FROM c GROUP BY 1), "
    "sh AS (SELECT station_id, hour, avg(occ) AS v FROM c GROUP BY 1, 2), swh AS (SELECT station_id, weekday, hour, avg(occ) AS v FROM c GROUP BY 1, 2, 3), "
    "cells AS (SELECT station_id, a, p, d, h.hour, w.weekday FROM s, (SELECT range AS hour FROM range(24)) h, (SELECT range AS weekday FROM range(-1, 7)) w) "
    f"SELECT cells.station_id, {sb('cells.hour', 'hour')}, {sb('cells.weekday', 'weekday')}, {s6('a', 'avg_occ')}, {s6('p', 'peak_occ')}, {s6('d', 'avg_duration')}, {s6('coalesce(sh.v, a)', 'same_hour_occ')}, {s6('coalesce(swh.v, sh.v, a)', 'same_weekday_hour_occ')} "
    "FROM cells LEFT JOIN sh ON sh.station_id = cells.station_id AND sh.hour = cells.hour LEFT JOIN swh ON swh.station_id = cells.station_id AND swh.hour = cells.hour AND swh.weekday = cells.weekday", "obs",
)
def profile_cube(spark, sf):
    return P.profile_cube(calendar(obs(spark, sf))).select(big("station_id"), big("hour"), big("weekday"), *[r6(c) for c in ("avg_occ", "peak_occ", "avg_duration", "same_hour_occ", "same_weekday_hour_occ")])


@query("SELECT CASE WHEN idle + busy = 0 THEN 'Unknown' WHEN busy / (busy + idle)::DOUBLE < 0.35 THEN 'Low' WHEN busy / (busy + idle)::DOUBLE <= 0.7 THEN 'Medium' ELSE 'High' END AS badge, count(*) AS n FROM observation GROUP BY 1", "observation")
def occupancy_badges(spark, sf):
    o = S.observation(spark, sf).select(occupancy_badge(F.try_divide(F.col("busy").cast("double"), F.col("busy") + F.col("idle"))).alias("badge"))
    return o.groupBy("badge").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, {s6('event_id % 90', 'lat')}, {s6('100 + event_id % 80', 'lon')} FROM events")
def coordinate_parse(spark, sf):
    """Texts in both orders and with both commas, made of the event ids."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id")
    k = F.col("event_id")
    a, b = (k % 90).cast("string"), (100 + k % 80).cast("string")
    text = F.when(k % 3 == 0, F.concat(a, F.lit(", "), b)).when(k % 3 == 1, F.concat(b, F.lit("，"), a)).otherwise(F.concat(b, F.lit(" "), a))
    lat, lon = parse_coordinates(text)
    return e.select("event_id", r6("lat", lat), r6("lon", lon))


@query("SELECT p_partkey FROM part WHERE p_size % 5 NOT IN (0, 2)")
def access_list_filter(spark, sf):
    """Rows whose list text names neither private nor no."""
    k = F.col("p_size") % 5
    text = F.when(k == 0, "['yes', 'Private']").when(k == 1, "['yes']").when(k == 2, " NO ").otherwise("permissive")
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", text.alias("access"))
    return p.filter(~F.exists(list_literal(F.col("access")), lambda x: x.isin("private", "no"))).select("p_partkey")


@query(f"""SELECT station_id, obs_id, {s6('greatest(0.2, least(0.8, occ))', 'clipped')}, '&lt;b title=&quot;it&#39;s&quot;&gt;' || station_id || '&lt;/b&gt; &amp; co' AS label FROM obs""", "obs")
def clip_and_escape(spark, sf):
    text = F.concat(F.lit("<b title=\"it's\">"), F.col("station_id").cast("string"), F.lit("</b> & co"))
    return obs(spark, sf).select(*key(), r6("clipped", clip(F.col("occ"), 0.2, 0.8)), html_escape(text).alias("label"))


@query("SELECT station_id, charge_count FROM station WHERE charge_count > 15 OR NOT EXISTS (SELECT 1 FROM station WHERE charge_count > 15)", "station")
def feasible_fallback(spark, sf):
    s = S.station(spark, sf).withColumn("passed", F.col("charge_count") > 15)
    return feasible_or_all(s).select(big("station_id"), big("charge_count"))
