"""File sources and sinks: station histories, dimensions, GeoJSON, GraphML, audits."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from html import escape

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions.scalar import html_escape

OBSERVATION = "time timestamp_ntz, busy bigint, idle bigint, s_price double, e_price double, duration string"


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    return df


def station_files(spark: SparkSession, folder: str, max_stations: int | None = None, stations: Iterable[int] | None = None) -> list[str]:
    """Paths of the {station_id}.csv and .csv.gz files of a folder, told by their names alone: no content is read.

    Of both forms of a station the plain one is taken. A cap takes file names in text order, as a sorted listing does.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv*").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    found = listed.select("path", F.regexp_extract(name, r"^(\d+)\.csv(\.gz)?$", 1).alias("stem"), name.endswith(".gz").alias("packed")).filter("stem <> ''")
    if stations is not None:
        found = found.filter(F.col("stem").cast("bigint").isin([int(x) for x in stations]))
    found = found.groupBy("stem").agg(F.min_by("path", "packed").alias("path")).orderBy("stem")
    return [r.path for r in (found if max_stations is None else found.limit(max_stations)).collect()]  # a row a file, which a scan's plan lists anyway


def station_history(spark: SparkSession, folder: str, max_stations: int | None = None, stations: Iterable[int] | None = None) -> DataFrame:
    """Rows of the stations' files: those of all stations, of the first `max_stations`, or of the given ones; no other file is opened."""
    paths = station_files(spark, folder, max_stations, stations)
    if not paths:
        return spark.createDataFrame([], f"station_id bigint, {OBSERVATION}")
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(paths)
    df = require_columns(raw, ["time", "busy", "idle", "s_price", "e_price", "duration"])
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.csv(\.gz)?$", 1)
    return df.select(
        stem.cast("bigint").alias("station_id"), F.col("time").try_cast("timestamp_ntz").alias("time"), *[F.col(c).try_cast("bigint").alias(c) for c in ("busy", "idle")],
        *[F.col(c).try_cast("double").alias(c) for c in ("s_price", "e_price")], "duration",
    )


def dimension(spark: SparkSession, path: str, schema: str, required: Iterable[str]) -> DataFrame:
    return require_columns(spark.read.option("header", True).schema(schema).csv(path), required)


def weather(spark: SparkSession, path: str) -> DataFrame:
    df = require_columns(spark.read.option("header", True).csv(path), ["time", "T", "U", "RAIN"])
    hour = F.date_trunc("hour", F.col("time").try_cast("timestamp_ntz")).cast("timestamp_ntz")
    return df.select(hour.alias("weather_hour"), *[F.col(a).try_cast("double").alias(b) for a, b in (("T", "temperature"), ("U", "humidity"), ("RAIN", "rain"))])


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Rings of the first feature: rows (polygon, ring, points), ring 0 the outer one."""
    raw = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.features[0].geometry.type").alias("kind"), F.get_json_object("value", "$.features[0].geometry.coordinates").alias("c"))
    one = F.array(F.from_json("c", "array<array<array<double>>>"))
    many = F.from_json("c", "array<array<array<array<double>>>>")
    polys = raw.select(F.posexplode(F.when(F.col("kind") == "Polygon", one).otherwise(many)).alias("polygon", "rings"))
    return polys.select("polygon", F.posexplode("rings").alias("ring", "pts")).select("polygon", "ring", F.transform("pts", lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))).alias("points"))


def to_geojson(rings: DataFrame) -> DataFrame:
    """One FeatureCollection text for rows (polygon, ring, points)."""
    pts = F.transform("points", lambda p: F.array(p["lon"], p["lat"]))
    by = rings.select("polygon", F.struct("ring", pts.alias("pts")).alias("r")).groupBy("polygon").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    geo = by.agg(F.array_sort(F.collect_list(F.struct("polygon", F.transform("rs", lambda r: r["pts"]).alias("rings")))).alias("ps"))
    coords = F.transform("ps", lambda p: p["rings"])
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("MultiPolygon").alias("type"), coords.alias("coordinates")).alias("geometry"))
    return geo.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))).alias("value"))


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, data) and edges (u, v, key, data), data a map from the file's key names to texts."""
    names = spark.read.format("xml").option("rowTag", "key").schema("_id string, `_attr.name` string, _for string").load(path)
    keys = {r["_id"]: r["_attr.name"] for r in names.collect()}  # the declarations of one file
    lookup = F.create_map(*[x for k, v in keys.items() for x in (F.lit(k), F.lit(v))]) if keys else F.create_map().cast("map<string,string>")
    data = F.map_from_entries(F.transform("data", lambda d: F.struct(F.coalesce(F.try_element_at(lookup, d["_key"]), d["_key"]), d["_VALUE"])))
    item = "data array<struct<_key: string, _VALUE: string>>"
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, {item}").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, _id string, {item}").load(path)
    return nodes.select(F.col("_id").alias("id"), data.alias("data")), edges.select(F.col("_source").alias("u"), F.col("_target").alias("v"), F.coalesce(F.col("_id").try_cast("int"), F.lit(0)).alias("key"), data.alias("data"))


def typed(graph: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A read graph's nodes or edges with columns from their texts: {"travel_time": "double", ...}; what is absent or no such value is null."""
    return graph.withColumns({c: F.try_element_at("data", F.lit(c)).try_cast(kind) for c, kind in columns.items()})


# Attributes of the road graph and their types.
NODE_TYPES = {"x": "double", "y": "double", "node_type": "string", "station_id": "bigint"}
EDGE_TYPES = {"length": "double", "travel_time": "double", "speed_kph": "double", "station_split": "boolean", "access": "string"}


def road_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Typed nodes (id, x, y, node_type, station_id) and edges (u, v, key, seconds, length_m, speed_kph, access, station_split, line) of a GraphML file.

    line: the edge's shape as points (lon, lat), from its text of a line string; null where it has none.
    """
    nodes, edges = read_graphml(spark, path)
    nodes, edges = typed(nodes, NODE_TYPES).drop("data"), typed(edges, EDGE_TYPES | {"geometry": "string"})
    pairs = F.split(F.regexp_extract("geometry", r"LINESTRING\s*\(([^)]*)\)", 1), r"\s*,\s*")
    point = F.transform(pairs, lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].try_cast("double").alias("lon"), F.try_element_at(F.split(F.trim(p), r"\s+"), F.lit(2)).try_cast("double").alias("lat")))
    line = F.when(F.col("geometry").rlike("LINESTRING"), point)
    return nodes, edges.select("u", "v", "key", F.col("travel_time").alias("seconds"), F.col("length").alias("length_m"), "speed_kph", "access", F.coalesce("station_split", F.lit(False)).alias("station_split"), line.alias("line"))


def write_csv(df: DataFrame, path: str, by: str | None = None, packed: bool = False, files: int | None = None, append: bool = False) -> None:
    """A table as CSV with a header: in a folder for each value of `by`, gzipped or not, in so many files, over what is there or beside it."""
    w = (df if files is None else df.coalesce(files)).write.mode("append" if append else "overwrite").option("header", True)
    w = w.option("compression", "gzip") if packed else w
    (w if by is None else w.partitionBy(by)).csv(path)


def audit(spark: SparkSession, folder: str, expected: Iterable[str]) -> DataFrame:
    """Expected files with their sizes; null where one is absent."""
    have = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    want = spark.createDataFrame([(x,) for x in expected], "name string")
    return want.join(have, "name", "left").withColumn("present", F.col("length").isNotNull())


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A GraphML text of nodes (id, data) and edges (u, v, key, data), data maps of texts; lines are dealt in order by Spark.

    The names of attributes are collected: they are columns of the graph, not its rows.
    """
    esc = lambda c: html_escape(c)
    names = {}
    for kind, df in (("node", nodes), ("edge", edges)):
        for r in df.select(F.explode(F.map_keys("data")).alias("k")).distinct().orderBy("k").collect():
            names[kind, r.k] = f"d{len(names)}"
    head = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    head += [f'<key id="{i}" for="{kind}" attr.name="{escape(k)}" attr.type="string"/>' for (kind, k), i in names.items()]
    head.append('<graph edgedefault="directed">')

    def data(kind: str) -> Column:
        ids = [(k, i) for (x, k), i in names.items() if x == kind]
        lookup = F.create_map(*[F.lit(v) for pair in ids for v in pair]) if ids else F.create_map().cast("map<string,string>")
        items = F.transform(F.array_sort(F.map_entries("data")), lambda e: F.concat(F.lit('<data key="'), F.try_element_at(lookup, e["key"]), F.lit('">'), esc(F.coalesce(e["value"], F.lit(""))), F.lit("</data>")))
        return F.concat_ws("", items)

    n = nodes.select(F.lit(1).alias("o"), F.col("id").alias("a"), F.lit("").alias("b"), F.concat(F.lit('<node id="'), esc(F.col("id")), F.lit('">'), data("node"), F.lit("</node>")).alias("value"))
    e = edges.select(
        F.lit(2).alias("o"), F.col("u").alias("a"), F.col("v").alias("b"),
        F.concat(F.lit('<edge source="'), esc(F.col("u")), F.lit('" target="'), esc(F.col("v")), F.lit('" id="'), F.col("key").cast("string"), F.lit('">'), data("edge"), F.lit("</edge>")).alias("value"),
    )
    spark = nodes.sparkSession
    frame = spark.createDataFrame([(0, "", f"{i:06d}", x) for i, x in enumerate(head)] + [(3, "", "", "</graph>"), (4, "", "", "</graphml>")], "o int, a string, b string, value string")
    # files are named in the order of the parts of a union, so one after another they are the document; only the order of kinds matters
    top, end = frame.filter("o = 0").coalesce(1).sortWithinPartitions("b"), frame.filter("o > 0").coalesce(1).sortWithinPartitions("o")
    top.unionByName(n).unionByName(e).unionByName(end).select("value").write.mode("overwrite").text(path)


def write_metadata(spark: SparkSession, data: dict, path: str) -> None:
    """Small JSON metadata, through Spark's writer, so that any store works."""
    spark.createDataFrame([(json.dumps(data, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))  # one small text


def built_once(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False, inputs: dict[str, DataFrame] | None = None) -> DataFrame:
    """The table at path; built and written first where it is absent, unfinished, to be rebuilt, or made from other inputs than these."""
    from gridlark.sources.artifacts import fingerprint

    mark = fingerprint(inputs) if inputs is not None else None
    try:
        told = read_metadata(spark, f"{path}.about")
    except AnalysisException:
        told = {}
    if rebuild or not told or mark is not None and told["mark"] != mark:
        build().write.mode("overwrite").parquet(path)
        write_metadata(spark, {"mark": mark}, f"{path}.about")  # last: without it the table is unfinished
    return spark.read.parquet(path)


class Progress:
    """Results of a long search as rows of a table: a new run goes on where a lost one stopped."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        spark.createDataFrame([], schema).write.mode("append").parquet(path)

    def rows(self) -> list[dict]:
        return [r.asDict() for r in self.spark.read.schema(self.schema).parquet(self.path).collect()]  # a row a trial

    def add(self, rows: list[dict]) -> None:
        if rows:
            names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
            self.spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], self.schema).coalesce(1).write.mode("append").parquet(self.path)


class Trials:
    """Trials of searches by (search, fingerprint of the data, setting): what was tried on the same data is not tried again."""

    def __init__(self, spark: SparkSession, path: str, search: str, data: str):
        self.log = Progress(spark, path, "search string, data string, setting string, result string")
        self.search, self.data = search, data
        self.known = {r["setting"]: json.loads(r["result"]) for r in self.log.rows() if (r["search"], r["data"]) == (search, data)}

    def get(self, setting: dict) -> dict | None:
        return self.known.get(json.dumps(setting, sort_keys=True))

    def add(self, setting: dict, result: dict) -> None:
        text = json.dumps(setting, sort_keys=True)
        self.log.add([{"search": self.search, "data": self.data, "setting": text, "result": json.dumps(result)}])
        self.known[text] = result
