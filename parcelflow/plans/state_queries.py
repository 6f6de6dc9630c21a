"""Streams over the driver's tables held against their batch results, and the verdict state."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..streaming import ledger, state, stateful
from .registry import query
from .source_queries import scratch

NOW = dt.datetime(2024, 2, 15)


def _rocksdb(t, run):
    """Run with the state store that keyed processors need, and put the session's own back."""
    name, provider = stateful.ROCKSDB
    before = t.spark.conf.get(name)
    t.spark.conf.set(name, provider)
    try:
        return run()
    finally:
        t.spark.conf.set(name, before)


def last_table(t, df):
    """The final table of a stream in complete mode that reads what is there and stops: every batch writes a folder of its own."""
    out = scratch(t)
    q = df.writeStream.outputMode("complete").foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}")).option("checkpointLocation", scratch(t)).trigger(availableNow=True).start()
    q.awaitTermination(600)
    return t.spark.read.schema(df.schema).parquet(f"{out}/batch={q.lastProgress['batchId']}")


def _events_stream(t):
    path = scratch(t)
    e = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    e.repartition(4).write.parquet(path)
    return t.spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double").parquet(path)


_DAILY = "SELECT ts::DATE AS day, event_type AS sku, round(sum(value), 4) AS cost, count(*) AS calls FROM events GROUP BY ALL"


@query("X01_ledger_rollup_batch", _DAILY)
def _(t):
    return ledger.daily_costs(t.events, "ts", "event_type", "value").withColumn("cost", F.round("cost", 4))


@query("X01_stream_ledger_rollup", _DAILY)
def _(t):
    daily = ledger.daily_costs(_events_stream(t), "ts", "event_type", "value", late="60 days")
    return last_table(t, daily).select("day", "sku", F.round("cost", 4).alias("cost"), "calls")


@query("X02_new_entities_batch", "SELECT user_id, min(ts::DATE) AS first_seen FROM events GROUP BY 1")
def _(t):
    e = t.events.select("user_id", F.to_date("ts").alias("first_seen"))
    old = e.where("first_seen < DATE '2024-01-10'").groupBy("user_id").agg(F.min("first_seen").alias("first_seen"))
    return ledger.merge_new(old, e.where("first_seen >= DATE '2024-01-10'"), "user_id", "first_seen")


@query("X02_stream_new_entities", "SELECT user_id, min(ts::DATE) AS first_seen FROM events GROUP BY 1")
def _(t):
    seen = stateful.first_seen(_events_stream(t), "user_id", "ts")
    told = _rocksdb(t, lambda: stateful.run_to_end(seen, scratch(t), scratch(t)))
    return told.groupBy("user_id").agg(F.min("first_seen").alias("first_seen"))


def _state(t):
    e = t.customer.where("c_mktsegment != 'MACHINERY'")  # the others have no state yet
    k = F.col("c_custkey")
    return e.select(
        k.cast("string").alias("key"), F.when(k % 3 == 0, "yes").when(k % 3 == 1, "no").otherwise("unclear").alias("operating"), F.array(F.lower("c_mktsegment")).alias("labels"),
        F.concat(F.lit("http://a/"), k.cast("string")).alias("website"), F.lit(True).alias("matched"), (k % 4 == 0).alias("validator_drop"),
        F.timestamp_seconds(F.lit(1_700_000_000) + k * 7000).alias("verified_at"), F.timestamp_seconds(F.lit(1_706_000_000) + k * 2000).alias("validated_at"), F.lit(None).cast("timestamp").alias("recheck_after"))


def _verdicts(t):
    k = F.col("c_custkey")
    return t.customer.where("c_acctbal >= 2000").select(
        k.cast("string").alias("key"), F.when(k % 5 == 0, "no").otherwise("yes").alias("operating"), F.array(F.when(k % 6 == 0, "thai").otherwise(F.lower("c_mktsegment"))).alias("labels"),
        (k % 7 != 0).alias("website_ok"), (k % 11 != 0).alias("match_ok"), (k % 8 == 0).alias("drop"), (k % 9 == 0).alias("error"))


_UPSERT = """WITH s AS (SELECT c_custkey AS k, lower(c_mktsegment) AS seg FROM customer WHERE c_mktsegment <> 'MACHINERY'), v AS (SELECT c_custkey AS k, lower(c_mktsegment) AS seg, c_custkey % 9 = 0 AS bad FROM customer WHERE c_acctbal >= 2000)
SELECT coalesce(s.k, v.k)::VARCHAR AS key, CASE WHEN v.k IS NOT NULL AND NOT bad THEN CASE WHEN v.k % 5 = 0 THEN 'no' ELSE 'yes' END WHEN s.k % 3 = 0 THEN 'yes' WHEN s.k % 3 = 1 THEN 'no' WHEN s.k IS NOT NULL THEN 'unclear' END AS operating,
CASE WHEN v.k IS NOT NULL AND NOT bad AND v.k % 6 = 0 THEN 'thai' WHEN s.k IS NULL AND NOT bad THEN v.seg WHEN s.k IS NULL THEN '' ELSE s.seg END AS labels,
CASE WHEN s.k IS NOT NULL AND NOT (v.k IS NOT NULL AND NOT bad AND v.k % 7 = 0) THEN concat('http://a/', s.k) END AS website,
CASE WHEN v.k IS NOT NULL AND NOT bad AND v.k % 11 = 0 THEN false WHEN s.k IS NOT NULL THEN true END AS matched, CASE WHEN v.k IS NOT NULL AND NOT bad THEN v.k % 8 = 0 ELSE s.k % 4 = 0 END AS validator_drop,
v.k IS NOT NULL AND (bad OR (s.k IS NOT NULL AND v.k % 6 <> 0)) AS embargoed FROM s FULL JOIN v ON s.k = v.k"""


def _shown(df):
    return df.select("key", "operating", F.coalesce(F.array_join("labels", ","), F.lit("")).alias("labels"), "website", "matched", "validator_drop", F.col("recheck_after").isNotNull().alias("embargoed"))


@query("X03_upsert_verdict_state", _UPSERT)
def _(t):
    return _shown(state.apply_verdicts(_state(t), _verdicts(t), NOW))


@query("X03_stream_upserts", "SELECT c_custkey::VARCHAR AS key, CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'no' ELSE 'yes' END AS operating FROM customer WHERE c_acctbal >= 2000")
def _(t):
    v, path, src = _verdicts(t), scratch(t), scratch(t)
    v.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions"))).write.parquet(src)
    q = state.stream_upserts(t.spark.readStream.schema(v.schema).parquet(src), path, NOW, scratch(t))
    q.awaitTermination(600)
    return state.read_state(t.spark, path).select("key", "operating")


@query("X04_due_queue", "SELECT k::VARCHAR AS key, CASE WHEN vd THEN 'verdict' ELSE 'validation' END AS why FROM (SELECT c_custkey AS k, date_diff('day', to_timestamp(1700000000 + c_custkey * 7000)::TIMESTAMP::DATE, DATE '2024-02-15') >= CASE c_custkey % 3 WHEN 0 THEN 180 WHEN 1 THEN 60 ELSE 7 END AS vd, date_diff('day', to_timestamp(1706000000 + c_custkey * 2000)::TIMESTAMP::DATE, DATE '2024-02-15') >= 14 AS ad FROM customer WHERE c_mktsegment <> 'MACHINERY') WHERE vd OR ad")
def _(t):
    return state.due_queue(_state(t), NOW)


@query("X05_rolling_quota_audit", "SELECT event_id, in_window FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS in_window FROM events) WHERE in_window > 4")
def _(t):
    return ledger.over_quota(t.events, "user_id", "ts", 86_400, 4).select("event_id", "in_window")


@query("X05_stream_quota_alerts", "SELECT event_id, in_window FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS in_window FROM events) WHERE in_window > 4")
def _(t):
    alerts = stateful.quota_alerts(_events_stream(t), "user_id", "event_id", "ts", 86_400, 4)
    return _rocksdb(t, lambda: stateful.run_to_end(alerts, scratch(t), scratch(t)))


@query("X05_month_to_date", "SELECT day, calls, total, CASE WHEN total >= 9000 THEN 'stop' WHEN total >= 5000 THEN 'warn' END AS level FROM (SELECT day, calls, sum(calls) OVER (PARTITION BY date_trunc('month', day) ORDER BY day)::BIGINT AS total FROM (SELECT ts::DATE AS day, count(*) AS calls FROM events GROUP BY 1))")
def _(t):
    return ledger.month_to_date(t.events, "ts", {"warn": 5000, "stop": 9000})
