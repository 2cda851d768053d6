"""The reference relations as views over the driver's tables, with integer arithmetic for all keys.

Each view is a DataFrame here and a text in SQL, so that a query and its oracle read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A concave service area inside the stations' extent.
BOUNDARY = [(113.80, 22.42), (114.20, 22.45), (114.60, 22.41), (114.55, 22.80), (114.20, 22.60), (113.85, 22.82)]
USER_LON, USER_LAT = 114.05, 22.62

SQL = {
    "observation": "SELECT user_id AS station_id, ts AS time, event_id AS obs_id, event_id % 7 AS busy, event_id % 5 AS idle, value / 500 AS s_price, (event_id % 3) / 2.0::DOUBLE AS e_price, value AS duration FROM events",
    "obs": "SELECT *, busy / (busy + idle)::DOUBLE AS occ FROM observation WHERE busy + idle > 0",
    "station": "SELECT station_id, 113.75::DOUBLE + (station_id * 7919 % 9000)::DOUBLE / 10000::DOUBLE AS lon, 22.40::DOUBLE + (station_id * 104729 % 4500)::DOUBLE / 10000::DOUBLE AS lat, 1 + station_id % 20 AS charge_count, station_id % 10 AS tazid FROM (SELECT DISTINCT user_id AS station_id FROM events)",
    "weather": "SELECT date_trunc('hour', ts) AS weather_hour, avg(value) AS temperature, count(*)::DOUBLE AS humidity, max(value) AS rain FROM events GROUP BY 1",
    "poi": "SELECT p_partkey AS poi_id, 113.75::DOUBLE + (p_partkey * 7907 % 9000)::DOUBLE / 10000::DOUBLE AS lon, 22.40::DOUBLE + (p_partkey * 6101 % 4500)::DOUBLE / 10000::DOUBLE AS lat, CASE p_size % 4 WHEN 0 THEN 'lifestyle_services' WHEN 1 THEN 'business_residential' WHEN 2 THEN 'food_beverage' ELSE 'other' END AS kind FROM part",
    "grid": "SELECT count(*) AS n, floor(sqrt(count(*)))::BIGINT AS w FROM supplier",
    "road_node": "SELECT s_suppkey AS id, 113.75::DOUBLE + (s_suppkey % w)::DOUBLE * (0.9::DOUBLE / w::DOUBLE) AS x, 22.40::DOUBLE + (s_suppkey // w)::DOUBLE * (0.45::DOUBLE / w::DOUBLE) AS y FROM supplier, grid",
    "load": "SELECT l_suppkey AS id, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1",
    "road_pair": "SELECT s_suppkey AS u, s_suppkey + 1 AS v FROM supplier, grid WHERE s_suppkey % w < w - 1 AND s_suppkey + 1 < n UNION ALL SELECT s_suppkey, s_suppkey + w FROM supplier, grid WHERE s_suppkey + w < n",
    "road_edge": "SELECT p.u, p.v, (30 + (3 * coalesce(a.q, 0) + coalesce(b.q, 0)) % 90)::DOUBLE AS seconds FROM (SELECT u, v FROM road_pair UNION ALL SELECT v, u FROM road_pair) p LEFT JOIN load a ON a.id = p.u LEFT JOIN load b ON b.id = p.v",
}

_NEEDS = {
    "observation": [], "obs": ["observation"], "station": [], "weather": [], "poi": [], "grid": [], "road_node": ["grid"], "load": [],
    "road_pair": ["grid"], "road_edge": ["road_pair", "load"],
}


def ctes(*names: str) -> str:
    """The views as common table expressions, what they need first."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS[n]:
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return ", ".join(f"{n} AS ({SQL[n]})" for n in order)


def _read(spark: SparkSession, sf: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*cols) if cols else df


def observation(spark: SparkSession, sf: str) -> DataFrame:
    e = _read(spark, sf, "events", "event_id", "ts", "user_id", "value")
    return e.select(
        F.col("user_id").alias("station_id"), F.col("ts").alias("time"), F.col("event_id").alias("obs_id"), (F.col("event_id") % 7).alias("busy"), (F.col("event_id") % 5).alias("idle"),
        (F.col("value") / 500).alias("s_price"), ((F.col("event_id") % 3) / F.lit(2.0)).alias("e_price"), F.col("value").alias("duration"),
    )


def _place(key: str, mx: int, my: int) -> list:
    k = F.col(key)
    return [(F.lit(113.75) + (k * mx % 9000).cast("double") / F.lit(10000.0)).alias("lon"), (F.lit(22.40) + (k * my % 4500).cast("double") / F.lit(10000.0)).alias("lat")]


def station(spark: SparkSession, sf: str) -> DataFrame:
    s = _read(spark, sf, "events", "user_id").distinct().withColumnRenamed("user_id", "station_id")
    return s.select("station_id", *_place("station_id", 7919, 104729), (1 + F.col("station_id") % 20).alias("charge_count"), (F.col("station_id") % 10).alias("tazid"))


def weather(spark: SparkSession, sf: str) -> DataFrame:
    e = _read(spark, sf, "events", "ts", "value")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("weather_hour")).agg(
        F.avg("value").alias("temperature"), F.count("*").cast("double").alias("humidity"), F.max("value").alias("rain")
    )


def poi(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_size") % 4
    kind = F.when(k == 0, "lifestyle_services").when(k == 1, "business_residential").when(k == 2, "food_beverage").otherwise("other")
    return _read(spark, sf, "part", "p_partkey", "p_size").select(F.col("p_partkey").alias("poi_id"), *_place("p_partkey", 7907, 6101), kind.alias("kind"))


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    n = _read(spark, sf, "supplier", "s_suppkey").agg(F.count("*").alias("n"))
    return n.select("n", F.floor(F.sqrt("n")).cast("long").alias("w"))


def road_node(spark: SparkSession, sf: str) -> DataFrame:
    s = _read(spark, sf, "supplier", "s_suppkey").crossJoin(F.broadcast(_grid(spark, sf)))  # one row
    k, w = F.col("s_suppkey"), F.col("w")
    return s.select(
        k.alias("id"), (F.lit(113.75) + (k % w).cast("double") * (F.lit(0.9) / w.cast("double"))).alias("x"),
        (F.lit(22.40) + F.floor(k / w).cast("double") * (F.lit(0.45) / w.cast("double"))).alias("y"),
    )


def road_edge(spark: SparkSession, sf: str) -> DataFrame:
    s = _read(spark, sf, "supplier", "s_suppkey").crossJoin(F.broadcast(_grid(spark, sf)))  # one row
    k, w, n = F.col("s_suppkey"), F.col("w"), F.col("n")
    right = s.filter((k % w < w - 1) & (k + 1 < n)).select(k.alias("u"), (k + 1).alias("v"))
    down = s.filter(k + w < n).select(k.alias("u"), (k + w).alias("v"))
    pair = right.unionByName(down)
    both = pair.unionByName(pair.select(F.col("v").alias("u"), F.col("u").alias("v")))
    load = _read(spark, sf, "lineitem", "l_suppkey", "l_quantity").groupBy(F.col("l_suppkey").alias("id")).agg(F.sum("l_quantity").cast("long").alias("q"))
    a, b = load.select(F.col("id").alias("u"), F.col("q").alias("qa")), load.select(F.col("id").alias("v"), F.col("q").alias("qb"))
    out = both.join(a, "u", "left").join(b, "v", "left")
    return out.select("u", "v", (30 + (3 * F.coalesce("qa", F.lit(0)) + F.coalesce("qb", F.lit(0))) % 90).cast("double").alias("seconds"))
