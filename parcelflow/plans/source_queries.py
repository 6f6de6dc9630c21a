"""Readers and writers as round trips of the driver's tables through files of the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geo
from ..sources import sinks, sources
from . import standins as s
from .registry import query

E = F.expr


def scratch(t) -> str:
    """A new folder under the session's checkpoint folder, which all executors share; made here on one machine only (tests)."""
    sc = t.spark.sparkContext
    jsc = sc._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        import tempfile

        named = t.spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return f"{jsc.getCheckpointDir().get()}/files-{uuid.uuid4().hex}"


@query("S01_scan_licences", "SELECT c_custkey::VARCHAR AS c_custkey, concat(c_name, ', \"', c_mktsegment, '\"') AS name FROM customer")
def _(t):
    path = scratch(t)
    t.customer.select("c_custkey", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("name")).write.option("escape", '"').csv(path, header=True)
    return sources.read_csv(t.spark, path)


def _shapes(t):
    x, y = E(s.lon("s_suppkey")), E(s.lat("s_suppkey"))
    text = lambda v: F.format_string("%.6f", v)
    ring = F.concat(F.lit("[["), F.concat_ws("],[", *[F.concat_ws(",", text(x + a), text(y + b)) for a, b in ((0, 0), (0.01, 0), (0.01, 0.01), (0, 0))]), F.lit("]]"))
    kind = F.when(F.col("s_suppkey") % 5 == 0, "Point").otherwise("Polygon")
    return F.concat(F.lit('{"type": "'), kind, F.lit('", "coordinates": '), F.when(F.col("s_suppkey") % 5 == 0, F.lit("[1.0, 2.0]")).otherwise(F.concat(F.lit("["), ring, F.lit("]"))), F.lit("}"))


@query("S02_scan_csv_geom", "SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN NULL ELSE 3 END::INT AS corners, CASE WHEN s_suppkey % 7 = 0 THEN 'unparseable' WHEN s_suppkey % 5 = 0 THEN 'wrong type' END AS skip_reason FROM supplier")
def _(t):
    df = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 7 == 0, F.lit("no json")).otherwise(_shapes(t)).alias("geometry"))
    return sources.with_geometry(df, "geometry").select("s_suppkey", F.when(F.col("shape").isNotNull(), F.size(F.col("shape")[0])).alias("corners"), "skip_reason")


def _features(t, path: str) -> None:
    f = F.concat(F.lit('{"type": "Feature", "properties": {"id": '), F.col("s_suppkey").cast("string"), F.lit(', "name": "'), F.col("s_name"), F.lit('"}, "geometry": '), _shapes(t), F.lit("},"))
    t.supplier.select(f.alias("value")).write.text(path)


@query("S03_scan_geojson", "SELECT s_suppkey AS id, s_name AS name, s_suppkey % 5 <> 0 AS polygon FROM supplier")
def _(t):
    path = scratch(t)
    _features(t, path)
    return sources.read_features(t.spark, path, "id: long, name: string", lines=True).select("id", "name", sources.polygon_from_geojson(F.col("geometry")).isNotNull().alias("polygon"))


@query("S04_scan_osm_elements", "SELECT 'way' AS type, s_suppkey AS id, s_name AS name, 2 AS n_points FROM supplier")
def _(t):
    path = scratch(t)
    el = F.to_json(F.struct(F.array(F.struct(F.lit("way").alias("type"), F.col("s_suppkey").alias("id"), F.create_map(F.lit("name"), F.col("s_name")).alias("tags"), F.array(F.struct(F.lit(43.6).alias("lat"), F.lit(-79.4).alias("lon")), F.struct(F.lit(43.7).alias("lat"), F.lit(-79.3).alias("lon"))).alias("geometry"))).alias("elements")))
    t.supplier.select(el.alias("value")).write.text(path)
    e = t.spark.read.schema(sources.OSM_SCHEMA).json(path).select(F.explode("elements").alias("e"))
    return e.select("e.type", "e.id", F.col("e.tags")["name"].alias("name"), F.size("e.geometry").alias("n_points"))


@query("S05_scan_gtfs", "SELECT l_suppkey::VARCHAR AS stop_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def _(t):
    path = scratch(t)
    t.orders.select(F.col("o_orderpriority").alias("route_id"), F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(3).alias("route_type")).distinct().write.csv(f"{path}/routes.txt", header=True)
    t.orders.select(F.col("o_orderkey").alias("trip_id"), F.col("o_orderpriority").alias("route_id")).write.csv(f"{path}/trips.txt", header=True)
    t.lineitem.select(F.col("l_orderkey").alias("trip_id"), F.col("l_suppkey").alias("stop_id")).write.csv(f"{path}/stop_times.txt", header=True)
    t.supplier.select(F.col("s_suppkey").alias("stop_id")).write.csv(f"{path}/stops.txt", header=True)
    from ..operators.resolve import chain_semi

    g = sources.read_gtfs(t.spark, path)
    return chain_semi((g["routes"].where("route_type = 1"), "route_id"), (g["trips"], "trip_id"), (g["stop_times"], "stop_id"), (g["stops"], "stop_id")).select("stop_id").distinct()


@query("S06_scan_keyed_json", "SELECT p_name || '||' || p_partkey AS key, p_size AS size, p_type AS kind FROM part")
def _(t):
    doc = F.concat(F.lit('{"'), F.col("p_name"), F.lit("||"), F.col("p_partkey").cast("string"), F.lit('": '), F.to_json(F.struct(F.col("p_size").alias("size"), F.col("p_type").alias("kind"))), F.lit("}"))
    return sources.keyed_json(t.part.select(doc.alias("doc")), "doc", "size: int, kind: string")


@query("S07_scan_jsonl_tolerant", "SELECT event_id, event_type AS sku, value AS cost FROM events WHERE event_id % 10 <> 3")
def _(t):
    path = scratch(t)
    line = F.when(F.col("event_id") % 10 == 3, F.lit('{"event_id": 1, bad')).otherwise(F.to_json(F.struct("event_id", F.col("event_type").alias("sku"), F.col("value").alias("cost"))))
    t.events.select(line.alias("value")).write.text(path)
    return sources.read_jsonl(t.spark, path, "event_id long, sku string, cost double").where("event_id IS NOT NULL")


@query("S08_scan_record_array", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    path = scratch(t)
    rows = F.to_json(F.array(F.struct("n_nationkey", "n_name")))
    t.nation.where("n_nationkey % 2 = 0").select(rows.alias("value")).repartition("value").write.option("lineSep", "\n").text(path)
    t.nation.where("n_nationkey % 2 = 1").select(F.concat(F.lit('{"result": {"records": '), rows, F.lit("}}")).alias("value")).write.mode("append").text(path)
    text = t.spark.read.text(path)
    plain = F.from_json("value", "array<struct<n_nationkey: int, n_name: string>>")
    wrapped = F.from_json("value", "result struct<records: array<struct<n_nationkey: int, n_name: string>>>")["result"]["records"]
    return text.select(F.explode(F.when(F.col("value").startswith("["), plain).otherwise(wrapped)).alias("r")).select("r.*")


@query("S09_sink_feature_table", "SELECT p_partkey, p_name FROM part")
def _(t):
    from ..operators import quality

    path = scratch(t)
    sinks.publish(t.part.select("p_partkey", "p_name"), path, lambda df: quality.require_rows(quality.require_columns(df, ["p_partkey"]), least=1))
    return t.spark.read.parquet(path)


@query("S09_publish_observed", "SELECT p_partkey, p_name, n, low FROM part, (SELECT count(*)::BIGINT AS n, count(*) FILTER (p_size < 5)::BIGINT AS low FROM part)")
def _(t):
    from ..operators import quality

    path = scratch(t)
    rules = {"no_name": ("CRITICAL", F.col("p_name").isNull()), "small": ("LOW", F.col("p_size") < 5), "rows": ("LOW", F.col("p_partkey").isNotNull())}
    metrics, check = quality.observed(rules, least=1)
    found = {name: n for name, _, n in sinks.publish_observed(t.part.select("p_partkey", "p_name", "p_size"), path, metrics, check)}
    return t.spark.read.parquet(path).select("p_partkey", "p_name", F.lit(found["rows"]).cast("long").alias("n"), F.lit(found["small"]).cast("long").alias("low"))


@query("S10_sink_delimited_clean", "SELECT doc_id::VARCHAR AS doc_id, translate(text, concat(',', chr(9), chr(10), chr(13)), '    ') AS text FROM documents WHERE lang = 'en'")
def _(t):
    path = scratch(t)
    sinks.write_delimited(t.documents.select("doc_id", "text", "lang"), path, F.col("lang") == "en")
    read = t.spark.read.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').option("quote", '"')
    return read.csv(f"{path}/filtered").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


@query("S11_sink_archive_previous", "SELECT p_partkey, 'removed' AS change FROM part WHERE p_size > 45")
def _(t):
    from ..operators.feeds import snapshot_diff

    folder = scratch(t)
    old = sinks.write_version(t.part.select("p_partkey"), folder, "2024-01-01")
    new = sinks.write_version(t.part.where("p_size <= 45").select("p_partkey"), folder, "2024-01-02")
    return snapshot_diff(t.spark.read.parquet(old), t.spark.read.parquet(new))


@query("S12_sink_jsonl_append", "SELECT event_type AS sku, count(*) AS calls FROM events GROUP BY 1")
def _(t):
    path = scratch(t)
    sinks.append_jsonl(t.events.where("event_id % 2 = 0").select(F.col("event_type").alias("sku"), "value"), path)
    sinks.append_jsonl(t.events.where("event_id % 2 = 1").select(F.col("event_type").alias("sku"), "value"), path)
    return t.spark.read.schema("sku string, value double").json(path).groupBy("sku").agg(F.count(F.lit(1)).alias("calls"))


@query("S13_rows_sitemap", "SELECT 'https://x.example/' AS loc, (SELECT max(o_orderdate::DATE) FROM orders) AS lastmod, 'daily' AS changefreq, 1.0::DOUBLE AS priority UNION ALL SELECT 'https://x.example/label/' || o_orderpriority, max(o_orderdate::DATE), 'daily', 0.8::DOUBLE FROM orders GROUP BY o_orderpriority UNION ALL SELECT 'https://x.example/district/' || o_orderstatus, max(o_orderdate::DATE), 'daily', 0.7::DOUBLE FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'https://x.example/place/' || o_orderkey, o_orderdate::DATE, 'weekly', 0.5::DOUBLE FROM orders")
def _(t):
    o = t.orders.withColumn("lastmod", F.col("o_orderdate").cast("date"))
    by = lambda c: o.groupBy(F.col(c).alias("slug")).agg(F.max("lastmod").alias("lastmod"))
    return sinks.sitemap_rows("https://x.example/", by("o_orderpriority"), by("o_orderstatus"), o.select(F.col("o_orderkey").cast("string").alias("slug"), "lastmod"))


@query("S14_rows_jsonld", "SELECT p_brand, '[' || string_agg('{\"position\":' || rn || ',\"name\":\"' || p_name || '\",\"id\":' || p_partkey || '}', ',' ORDER BY rn) || ']' AS payload FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part) WHERE rn <= 5 GROUP BY 1")
def _(t):
    return sinks.item_list(t.part, "p_brand", F.col("p_partkey"), 5, name=F.col("p_name"), id=F.col("p_partkey"))


@query("S15_raw_verdict_archive", "SELECT event_id AS request_id, concat('k', user_id) AS key, props AS raw FROM events")
def _(t):
    folder = scratch(t)
    sinks.archive_raw(t.events.select(F.col("event_id").alias("request_id"), F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"), F.col("props").alias("raw")), folder, "b1")
    keys = t.spark.read.parquet(f"{folder}/keys/batch_id=b1")
    return t.spark.read.schema("request_id long, raw string").json(f"{folder}/raw/batch_id=b1").join(keys, "request_id").select("request_id", "key", "raw")
