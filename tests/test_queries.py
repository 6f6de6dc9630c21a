"""Every registered query of the civic-records operators against its SQL, on the smallest data folder."""

import glob
import math
import os

import duckdb
import pytest

from parcelflow.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    return v


def rows(cols, names, data):
    at = [names.index(c) for c in cols]
    return sorted(repr(tuple(plain(r[i]) for i in at)) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, data):
    df = QUERIES[name](spark, data)
    got = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert got
        return
    r = duck.execute(SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    assert rows(cols, df.columns, got) == rows(cols, names, r.fetchall())


def test_each_query_has_sql_but_for_the_verdict_cycle():
    assert set(QUERIES) - set(SQL) <= {"C12_verdict_cycle"}


def test_stream_upserts_reads_a_source_of_many_files(spark, data, tmp_path, monkeypatch):
    from parcelflow.plans import state_queries

    made = []
    monkeypatch.setattr(state_queries, "scratch", lambda t: made.append(str(tmp_path / str(len(made)))) or made[-1])
    assert QUERIES["X03_stream_upserts"](spark, data).count() > 0
    assert len(glob.glob(f"{made[1]}/part-*.parquet")) > 1


def test_parcel_stats_work_out_the_features_once(spark, data):
    df = QUERIES["C06_parcel_stats"](spark, data)
    assert "ASIN" not in df._jdf.queryExecution().optimizedPlan().toString().upper()  # four parts read them; none measures again
