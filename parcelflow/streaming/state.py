"""Verdict state: applying a batch of verdicts, and the queue of keys that are due again."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, keys

EMBARGO_DAYS = 30
STATE = "key string, operating string, labels array<string>, website string, matched boolean, validator_drop boolean, verified_at timestamp, validated_at timestamp, recheck_after timestamp"


def apply_verdicts(state: DataFrame, verdicts: DataFrame, now: dt.datetime, unchanged_embargo: int = EMBARGO_DAYS) -> DataFrame:
    """The next state from (state, verdicts), one full join by key; a pure function of its inputs.

    verdicts: key, operating, labels, website_ok, match_ok, drop, error.  An error changes nothing but the embargo.  A
    bad match clears the match, drop is set or cleared, labels change only if the set differs, a rejected URL is
    cleared, times are stamped.  Keys without a state become rows."""
    v = verdicts.select("key", *[F.col(c).alias(f"v_{c}") for c in ("operating", "labels", "website_ok", "match_ok", "drop", "error")], F.lit(True).alias("seen"))
    j = state.join(v, "key", "full")
    ok = F.coalesce(F.col("seen") & ~F.coalesce("v_error", F.lit(False)), F.lit(False))
    failed = F.coalesce(F.col("seen") & F.coalesce("v_error", F.lit(False)), F.lit(False))
    stamp = F.lit(now)
    same = lambda a, b: (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    differs = F.coalesce(~same(F.coalesce("labels", F.array().cast("array<string>")), F.col("v_labels")), F.lit(False)) & (F.size("v_labels") > 0)
    pick = lambda test, new, old: F.when(test, new).otherwise(old)
    return j.select(
        "key",
        pick(ok & F.col("v_operating").isin("yes", "no", "unclear"), F.col("v_operating"), F.col("operating")).alias("operating"),
        pick(ok & differs, F.col("v_labels"), F.col("labels")).alias("labels"),
        pick(ok & F.coalesce(~F.col("v_website_ok"), F.lit(False)), F.lit(None).cast("string"), F.col("website")).alias("website"),
        pick(ok & F.coalesce(~F.col("v_match_ok"), F.lit(False)), F.lit(False), F.col("matched")).alias("matched"),
        pick(ok & F.col("v_drop").isNotNull(), F.col("v_drop"), F.col("validator_drop")).alias("validator_drop"),
        pick(ok & F.col("v_operating").isNotNull(), stamp, F.col("verified_at")).alias("verified_at"),
        pick(ok, stamp, F.col("validated_at")).alias("validated_at"),
        pick(failed | (ok & ~differs), stamp + F.expr(f"INTERVAL {unchanged_embargo} DAYS"), F.col("recheck_after")).alias("recheck_after"),
    )


def due_queue(state: DataFrame, now: dt.datetime) -> DataFrame:
    """Keys to check again and why: by verdict and website tier, or by validation age outside the embargo."""
    by_verdict = dates.due(F.col("verified_at"), F.col("operating"), keys.website_tier(F.col("website")), now)
    age = F.datediff(F.lit(now).cast("date"), F.col("validated_at").cast("date"))
    free = F.coalesce(F.col("recheck_after") <= F.lit(now), F.lit(True))
    by_age: Column = F.coalesce(age >= 14, F.lit(True)) & free
    return state.select("key", F.when(by_verdict, "verdict").when(by_age, "validation").alias("why")).where("why IS NOT NULL")


BUCKETS = 64


def _children(spark: SparkSession, path: str, prefix: str, done: bool = False) -> list[int]:
    """Numbers of the folders ``prefix``N in a folder; ``done``: only those written to their end."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    folder = make(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix) and (not done or fs.exists(make(f"{path}/{n}/_SUCCESS"))))


def bucket_of(key: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, path: str, batch: int) -> dict[int, int]:
    """bucket -> batch that wrote it last, as of a batch; at most one entry a bucket."""
    return {r.bucket: r.batch for r in spark.read.schema("bucket int, batch long").parquet(f"{path}/manifest/batch={batch}").collect()}


def _load(spark: SparkSession, path: str, where: dict[int, int]) -> DataFrame:
    """The rows of the given buckets, each from the batch that wrote it."""
    files = [f"{path}/data/batch={batch}/bucket={bucket}" for bucket, batch in sorted(where.items())]
    return spark.read.schema(STATE).parquet(*files) if files else spark.createDataFrame([], STATE)


def last_batch(spark: SparkSession, path: str, before: int | None = None) -> int | None:
    """The last batch whose manifest is complete (of those before a batch)."""
    done = [b for b in _children(spark, f"{path}/manifest", "batch=", True) if before is None or b < before]
    return done[-1] if done else None


def upsert_batch(spark: SparkSession, verdicts: DataFrame, path: str, batch: int, now: dt.datetime, buckets: int = BUCKETS) -> list[int]:
    """Apply one batch of verdicts to the state in ``path``; the buckets that were rewritten.

    The state lies in hash buckets.  Only buckets with a key of the batch are read and written anew, beside the old ones; a
    manifest (one row a bucket) then says which batch holds each bucket.  A batch that is run again starts from the manifest
    before it and overwrites its own files, so replays change nothing; readers see a batch whole or not at all."""
    old = last_batch(spark, path, before=batch)
    where = _manifest(spark, path, old) if old is not None else {}
    keyed = verdicts.where(F.col("key").isNotNull())
    touched = sorted(r.b for r in keyed.select(bucket_of("key", buckets).alias("b")).distinct().collect())  # at most one row a bucket
    state = _load(spark, path, {b: v for b, v in where.items() if b in set(touched)})
    new = apply_verdicts(state, keyed, now).withColumn("bucket", bucket_of("key", buckets))
    new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/batch={batch}")
    rows = list({**where, **{b: batch for b in touched}}.items())
    spark.createDataFrame(rows, "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={batch}")
    return touched


def read_state(spark: SparkSession, path: str, batch: int | None = None) -> DataFrame:
    """The state after the last complete batch (or after a given one); no rows before the first."""
    batch = last_batch(spark, path) if batch is None else batch
    return _load(spark, path, _manifest(spark, path, batch)) if batch is not None else spark.createDataFrame([], STATE)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[tuple[int, int]]:
    """Delete buckets and manifests that none of the last ``keep`` batches needs; (batch, bucket) of what went."""
    done = _children(spark, f"{path}/manifest", "batch=", True)
    kept = done[-keep:] if keep else done
    needed = {(v, b) for m in kept for b, v in _manifest(spark, path, m).items()}
    make = spark._jvm.org.apache.hadoop.fs.Path
    fs = make(path).getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for batch in _children(spark, f"{path}/data", "batch="):
        if done and batch > done[-1]:
            continue  # being written
        for bucket in _children(spark, f"{path}/data/batch={batch}", "bucket="):
            if (batch, bucket) not in needed:
                fs.delete(make(f"{path}/data/batch={batch}/bucket={bucket}"), True)
                gone.append((batch, bucket))
    for batch in done:
        if batch not in kept:
            fs.delete(make(f"{path}/manifest/batch={batch}"), True)
    return gone


def stream_upserts(verdicts: DataFrame, path: str, now: dt.datetime, checkpoint: str, buckets: int = BUCKETS):
    """X03, as a stream: every micro-batch rewrites the buckets of its keys; see ``upsert_batch``."""

    def one(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            upsert_batch(batch.sparkSession, batch, path, batch_id, now, buckets)
        finally:
            batch.unpersist()

    return verdicts.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
