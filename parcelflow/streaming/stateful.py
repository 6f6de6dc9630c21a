"""Stateful stream operators with keyed state, timers and time to live."""

from __future__ import annotations

import bisect
import itertools
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class FirstSeen(StatefulProcessor):
    """Per key the earliest time seen so far, kept for ever or for ``ttl_ms`` after the last change."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "at long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = min(int(part.iloc[:, 1].min()) for part in rows)  # columns come in order, without their names
        known = self.first.get()[0] if self.first.exists() else None
        if known is None or at < known:
            self.first.update((at,))
            yield pd.DataFrame({"_key": [key[0]], "_at": [at], "is_new": [known is None]})

    def close(self) -> None:
        pass


class TrailingCount(StatefulProcessor):
    """Per key the events of the trailing window.  Events wait until the watermark has passed them, so that they are told in
    order of time however they come; then older ones than the window go.  A key has one timer, at its first waiting event,
    and tells all events up to the watermark at once: its state is read and written once a batch, not once an event."""

    def __init__(self, window_us: int, cap: int):
        self.window_us, self.cap = window_us, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long")
        self.recent = handle.getListState("recent", "at long, n long")
        self.timer = handle.getValueState("timer", "due long")

    def _wake(self, at: int) -> None:
        """One timer for the key, at the first millisecond that is not before ``at``."""
        due, known = -(-at // 1000), self.timer.get()[0] if self.timer.exists() else None
        if known is None or due < known:
            if known is not None:
                self.handle.deleteTimer(known)
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            at = part.iloc[:, 3].astype("int64").tolist()
            self.waiting.appendList(list(zip(at, part.iloc[:, 1].astype("int64").tolist())))
            first = min(at) if first is None else min(first, *at)
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        n = bisect.bisect_right(waiting, now, key=lambda x: x[0])
        ready, later = waiting[:n], waiting[n:]
        recent = deque((int(a), int(c)) for a, c in self.recent.get()) if self.recent.exists() else deque()
        total, out = sum(c for _, c in recent), []
        for at, same in itertools.groupby(ready, key=lambda x: x[0]):
            here = [i for _, i in same]
            recent.append((at, len(here)))
            total += len(here)
            while recent[0][0] < at - self.window_us:
                total -= recent.popleft()[1]
            if total > self.cap:
                out += [(i, total) for i in here]
        if ready:
            self.recent.put(list(recent))
        if later:
            self.waiting.put(later)
            self._wake(later[0][0])
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=["_id", "in_window"])

    def close(self) -> None:
        pass


def first_seen(snapshots: DataFrame, key: str, ts: str, ttl_ms: int | None = None) -> DataFrame:
    """X02, as a stream: (key, first_seen, is_new) whenever a key is met for the first time or with an earlier date than before.

    Keys stay known for ever, whatever the watermark, unless ``ttl_ms`` ends that.  Rows without a key or a time take no part."""
    kind = snapshots.schema[key].dataType.simpleString()
    rows = snapshots.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("_key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"))
    told = rows.groupBy("_key").transformWithStateInPandas(FirstSeen(ttl_ms), f"_key {kind}, _at long, is_new boolean", "append", "none")
    return told.select(F.col("_key").alias(key), F.timestamp_micros("_at").cast("date").alias("first_seen"), "is_new")


def quota_alerts(events: DataFrame, key: str, event: str, ts: str, seconds: int, cap: int, late: str = "0 seconds") -> DataFrame:
    """X05, as a stream: (event, in_window) of the events that come when more than ``cap`` events of their key, itself and those
    of the same time included, fell in the trailing window.

    An event is told when the watermark (``late`` behind the newest event) has passed it; events later than that are dropped."""
    rows = events.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(event).alias("_id"), F.col(ts).cast("timestamp").alias("_ts")).withColumn("_at", F.unix_micros("_ts"))
    told = rows.withWatermark("_ts", late).groupBy("_key").transformWithStateInPandas(TrailingCount(seconds * 1_000_000, cap), "_id long, in_window long", "append", "eventTime")
    return told.select(F.col("_id").alias(event), "in_window")


def run_to_end(stream: DataFrame, out: str, checkpoint: str, timeout: int | None = None) -> DataFrame:
    """Run an appending stream over what its source holds, into Parquet files; the rows of this and earlier runs.  A long
    source takes as long as it takes, unless ``timeout`` (seconds) ends that."""
    q = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if timeout is None:
        q.awaitTermination()
    elif not q.awaitTermination(timeout):
        q.stop()
        raise TimeoutError("the stream did not come to its end")
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


#: Keyed state of this kind lives in RocksDB on the executors, with its change log in the checkpoint folder.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
