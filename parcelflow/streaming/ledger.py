"""Ledger roll-ups, new-entity detection and quota audits, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def daily_costs(events: DataFrame, ts: str, sku: str, cost: str, late: str | None = None) -> DataFrame:
    """Cost and calls per day and sku; with ``late`` a watermark drops rows that come later than that."""
    if late:
        events = events.withWatermark(ts, late)
    g = events.groupBy(F.window(ts, "1 day").alias("w"), F.col(sku).alias("sku"))
    return g.agg(F.sum(cost).alias("cost"), F.count(F.lit(1)).alias("calls")).select(F.col("w.start").cast("date").alias("day"), "sku", "cost", "calls")


def merge_new(state: DataFrame, batch: DataFrame, key: str, date: str) -> DataFrame:
    """X02, in batch: the state with the batch's unseen keys added and the earlier date kept for seen ones."""
    both = state.select(key, date).unionByName(batch.select(key, date))
    return both.groupBy(key).agg(F.min(date).alias(date))


def over_quota(events: DataFrame, key: str, ts: str, seconds: int, cap: int) -> DataFrame:
    """Events that come when more than ``cap`` events of their key, itself included, fell in the trailing window."""
    w = W.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count(F.lit(1)).over(w)).where(F.col("in_window") > cap)


def month_to_date(events: DataFrame, ts: str, thresholds: dict[str, int]) -> DataFrame:
    """Calls of each day, their running total in the month and the highest threshold that it has passed.

    The window is over a table of days."""
    days = events.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("calls"))
    days = days.withColumn("total", F.sum("calls").over(W.partitionBy(F.date_trunc("month", "day")).orderBy("day").rowsBetween(W.unboundedPreceding, 0)))
    level: Column = F.lit(None).cast("string")
    for name, n in sorted(thresholds.items(), key=lambda x: x[1]):
        level = F.when(F.col("total") >= n, F.lit(name)).otherwise(level)
    return days.withColumn("level", level)
