"""Stateful streams against their batch results, restarts and replays; bucketed verdict state."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from parcelflow.streaming import ledger, state, stateful

START = dt.datetime(2024, 1, 1)
EVENTS = "id long, k long, ts timestamp"
VERDICTS = "key string, operating string, labels array<string>, website_ok boolean, match_ok boolean, drop boolean, error boolean"
NOW = dt.datetime(2024, 2, 15)


@pytest.fixture()
def rocks(spark):
    name, provider = stateful.ROCKSDB
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    yield
    spark.conf.set(name, before)


def events(spark, first, n, day, seed):
    rng = random.Random(seed)
    rows = [(first + i, rng.choice([1, 1, 1, 2, 3, None]), START + dt.timedelta(days=day, minutes=rng.randrange(24 * 60 // 5) * 5, microseconds=rng.choice([0, 0, 1]))) for i in range(n)]
    return spark.createDataFrame(rows, EVENTS)


def test_quota_alerts_equal_the_batch_and_survive_a_restart(spark, rocks, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    every = None
    for day in range(3):  # each day is a run of its own over the same checkpoint
        more = events(spark, day * 1000, 120, day, day)
        more.repartition(2).write.mode("append").parquet(src)
        every = more if every is None else every.unionByName(more)
        stream = spark.readStream.schema(EVENTS).parquet(src)
        told = stateful.run_to_end(stateful.quota_alerts(stream, "k", "id", "ts", 7200, 5), out, ckpt)
    want = ledger.over_quota(every.where("k IS NOT NULL"), "k", "ts", 7200, 5).select("id", "in_window")
    got = sorted(map(tuple, told.collect()))
    assert got == sorted(map(tuple, want.collect())) and got


def test_first_seen_knows_keys_after_a_restart(spark, rocks, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    day = lambda n: START + dt.timedelta(days=n)
    for rows in ([(1, 10, day(400)), (2, 11, day(5)), (3, None, day(1)), (4, 12, None)], [(5, 10, day(3)), (6, 11, day(9)), (7, 13, day(0))]):
        spark.createDataFrame(rows, EVENTS).write.mode("append").parquet(src)
        told = stateful.run_to_end(stateful.first_seen(spark.readStream.schema(EVENTS).parquet(src), "k", "ts"), out, ckpt)
    got = sorted((r.k, str(r.first_seen), r.is_new) for r in told.collect())
    # key 10 came again with an earlier date, more than a year before the newest row; 11 came later and is not told again
    assert got == [(10, "2024-01-04", False), (10, "2025-02-04", True), (11, "2024-01-06", True), (13, "2024-01-01", True)]


def verdicts(spark, keys, operating="yes"):
    return spark.createDataFrame([(k, operating, ["thai"], True, True, False, False) for k in keys], VERDICTS)


def test_a_batch_rewrites_only_the_buckets_of_its_keys(spark, tmp_path):
    path = str(tmp_path / "state")
    keys = [f"k{i}" for i in range(200)]
    assert state.read_state(spark, path).count() == 0
    assert len(state.upsert_batch(spark, verdicts(spark, keys), path, 0, NOW, 16)) == 16
    touched = state.upsert_batch(spark, verdicts(spark, ["k1", "k2", "new"], "no"), path, 1, NOW, 16)
    assert 1 <= len(touched) <= 3
    assert state._children(spark, f"{path}/data/batch=1", "bucket=") == touched
    got = {r.key: r.operating for r in state.read_state(spark, path).collect()}
    assert got == {**{k: "yes" for k in keys}, "k1": "no", "k2": "no", "new": "no"}
    # a replay starts from the manifest before the batch and changes nothing
    state.upsert_batch(spark, verdicts(spark, ["k1", "k2", "new"], "no"), path, 1, NOW, 16)
    assert {r.key: r.operating for r in state.read_state(spark, path).collect()} == got
    # an older batch stays readable until it is vacuumed; the last ones stay whole
    assert state.read_state(spark, path, 0).where("operating = 'no'").count() == 0
    state.upsert_batch(spark, verdicts(spark, ["k1"], "unclear"), path, 2, NOW, 16)
    gone = state.vacuum(spark, path, keep=1)
    assert gone and all(b < 2 for b, _ in gone)
    after = {r.key: r.operating for r in state.read_state(spark, path).collect()}
    assert after == {**got, "k1": "unclear"}


def test_a_batch_without_a_manifest_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "state")
    state.upsert_batch(spark, verdicts(spark, ["a", "b"]), path, 0, NOW, 4)
    (tmp_path / "state" / "data" / "batch=1" / "bucket=0").mkdir(parents=True)
    (tmp_path / "state" / "manifest" / "batch=1").mkdir(parents=True)  # no _SUCCESS: the batch broke off
    assert state.last_batch(spark, path) == 0 and state.read_state(spark, path).count() == 2
    assert state.vacuum(spark, path) == []


def test_stream_upserts_equal_one_batch(spark, tmp_path):
    src, path = str(tmp_path / "src"), str(tmp_path / "state")
    for part in range(3):
        verdicts(spark, [f"k{i}" for i in range(part * 20, part * 20 + 30)]).write.mode("append").parquet(src)
        state.stream_upserts(spark.readStream.schema(VERDICTS).parquet(src), path, NOW, str(tmp_path / "ckpt"), 8).awaitTermination(300)
    assert sorted(r.key for r in state.read_state(spark, path).collect()) == sorted(f"k{i}" for i in range(70))
    assert state.last_batch(spark, path) == 2
    empty = spark.createDataFrame([], VERDICTS)
    assert state.upsert_batch(spark, empty, path, 3, NOW, 8) == [] and state.read_state(spark, path).count() == 70


def test_quota_alerts_wake_a_key_once_for_all_its_waiting_events():
    import pandas as pd

    class Cell(list):
        exists, get, put, clear = (lambda s: len(s) > 0), (lambda s: list(s)), (lambda s, v: s.__setitem__(slice(None), v)), list.clear
        appendList = list.extend

        def update(self, v):
            self[:] = v

    class Handle:
        timers, woken = set(), 0
        getListState = lambda s, *a: Cell()
        getValueState = lambda s, *a: Cell()

        def registerTimer(self, due):
            self.timers.add(due)
            self.woken += 1

        def deleteTimer(self, due):
            self.timers.discard(due)

    class Times:
        getCurrentWatermarkInMs = lambda s: 50_000

    p, h = stateful.TrailingCount(10_000_000, 3), Handle()
    p.init(h)
    at = [i * 1_000_000 for i in range(60)]
    list(p.handleInputRows(("k",), iter([pd.DataFrame({"k": "k", "id": range(60), "ts": 0, "at": at})]), Times()))
    assert h.timers == {0}
    told = pd.concat(p.handleExpiredTimer(("k",), Times(), None))
    assert dict(zip(told["_id"], told["in_window"])) == {i: min(i + 1, 11) for i in range(3, 51)}
    assert h.timers == {0, 51_000} and h.woken == 2
