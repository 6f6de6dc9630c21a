"""Readers for delimited, GeoJSON, OSM, GTFS and keyed JSON extracts, all through Spark's own sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = "array<double>"
GEOJSON_POLYGON = "struct<type: string, coordinates: array<array<array<double>>>>"
OSM_SCHEMA = "elements array<struct<type: string, id: long, tags: map<string, string>, geometry: array<struct<lat: double, lon: double>>>>"


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Headered CSV, every column a string unless a schema is given; quotes may span lines."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    return (reader.schema(schema) if schema else reader).csv(path)


def polygon_from_geojson(text: Column) -> Column:
    """Rings of structs (x, y) of a GeoJSON polygon, a closing point left out; null for other types or bad text."""
    g = F.from_json(text, GEOJSON_POLYGON)
    ring = lambda r: F.transform(F.when(r[0] == F.element_at(r, -1), F.slice(r, 1, F.size(r) - 1)).otherwise(r), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return F.when(g["type"] == "Polygon", F.transform(g["coordinates"], ring))


def with_geometry(df: DataFrame, col: str, out: str = "shape") -> DataFrame:
    """Rows with a readable polygon, and ``skip_reason`` null; other rows carry why they would be skipped."""
    kind = F.get_json_object(F.col(col), "$.type")
    df = df.withColumn(out, polygon_from_geojson(F.col(col)))
    return df.withColumn("skip_reason", F.when(F.col(col).isNull(), "null").when(kind.isNull(), "unparseable").when(F.col(out).isNull(), "wrong type"))


def read_features(spark: SparkSession, path: str, properties: str, lines: bool = False) -> DataFrame:
    """One row for each feature: its properties, and its geometry as JSON text.

    ``lines``: one feature on each line, perhaps with a comma behind it; such files are split among tasks."""
    feature = f"struct<properties: struct<{properties}>, geometry: string>"
    if lines:
        text = spark.read.text(path).select(F.regexp_replace(F.trim("value"), r",$", "").alias("v")).where(F.col("v").startswith('{"type":"Feature"') | F.col("v").startswith('{"type": "Feature"'))
        return text.select(F.from_json("v", feature).alias("f")).select("f.properties.*", "f.geometry")
    doc = spark.read.option("multiLine", True).schema(f"features array<{feature}>").json(path)
    return doc.select(F.explode("features").alias("f")).select("f.properties.*", "f.geometry")


def read_osm(spark: SparkSession, path: str) -> DataFrame:
    """One row for each element with its tags and its points as structs (x, y)."""
    e = spark.read.option("multiLine", True).schema(OSM_SCHEMA).json(path).select(F.explode("elements").alias("e"))
    return e.select("e.type", "e.id", "e.tags", F.transform("e.geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))).alias("points"))


def read_gtfs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four tables of an extracted feed; a byte-order mark before the first header is no part of it."""
    out = {}
    for name in ("routes", "trips", "stop_times", "stops"):
        df = spark.read.option("header", True).csv(f"{folder}/{name}.txt")
        out[name] = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return out


def keyed_json(df: DataFrame, text: str, value: str) -> DataFrame:
    """Rows (key, fields of value) of a JSON object of objects in a text column."""
    each = df.select(F.explode(F.from_json(F.col(text), f"map<string, struct<{value}>>")).alias("key", "value"))
    return each.select("key", "value.*")


def read_keyed_json(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A missing file is an empty table."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], T.StructType([T.StructField("key", T.StringType()), *T._parse_datatype_string(value).fields]))
    return keyed_json(spark.read.text(path, wholetext=True), "value", value)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, bad ones dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_records(spark: SparkSession, path: str, record: str) -> DataFrame:
    """A JSON array of records, or an envelope with result.records."""
    text = spark.read.text(path, wholetext=True)
    plain = F.from_json("value", f"array<struct<{record}>>")
    wrapped = F.from_json("value", f"result struct<records: array<struct<{record}>>>")["result"]["records"]
    rows = F.when(F.ltrim("value").startswith("["), plain).otherwise(wrapped)
    return text.select(F.explode(rows).alias("r")).select("r.*")
