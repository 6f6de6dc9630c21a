"""Ranks, feeds, queues and set operations."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def ranked(df: DataFrame, metrics: dict[str, bool], tie: str) -> DataFrame:
    """A 1..N rank column for each metric (True: descending), ties by ``tie``.

    For per-area tables: the window has all areas in one partition."""
    out = df
    for m, down in metrics.items():
        order = F.col(m).desc_nulls_last() if down else F.col(m).asc_nulls_last()
        out = out.withColumn(f"rank_{m}", F.row_number().over(W.partitionBy().orderBy(order, tie)))
    return out


def bands(df: DataFrame, order: Sequence[Column], cuts: dict[str, tuple[int, int]]) -> DataFrame:
    """Rows of the rank slices, each with the name of its slice; only the ranks up to the last slice are taken."""
    last = max(b for _, b in cuts.values())
    top = df.orderBy(*order).limit(last)
    rn = top.withColumn("_rn", F.row_number().over(W.partitionBy().orderBy(*order)))
    name = F.coalesce(*[F.when(F.col("_rn").between(a, b), F.lit(n)) for n, (a, b) in cuts.items()])
    return rn.withColumn("band", name).where("band IS NOT NULL").drop("_rn")


def diversity_sample(df: DataFrame, band: str, group: str, per_group: int, per_band: int, seed: str) -> DataFrame:
    """Rows in a seeded order, at most ``per_group`` of a group in a band and ``per_band`` of a band."""
    order = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in df.columns]).cast("binary"))
    df = df.withColumn("_o", order)
    df = df.withColumn("_g", F.row_number().over(W.partitionBy(band, group).orderBy("_o"))).where(F.col("_g") <= per_group)
    return df.withColumn("_b", F.row_number().over(W.partitionBy(band).orderBy("_o"))).where(F.col("_b") <= per_band).drop("_o", "_g", "_b")


def first_unused(lists: list[DataFrame], key: str, order: Sequence[Column]) -> list:
    """From each ranked list the best key that no earlier list took; None where every key of a list is taken."""
    used: list = []
    for df in lists:
        free = df.where(F.col(key).isNotNull() & ~F.col(key).isin([u for u in used if u is not None]))
        row = free.orderBy(*order).select(key).first()
        used.append(row[0] if row else None)
    return used


def rotate(df: DataFrame, ordinal: str, last: int, n: int, fresh: str, least: int) -> DataFrame:
    """The next slot after ``last``, in turn, that has at least ``least`` fresh entries."""
    return df.where(F.col(fresh) >= least).orderBy(F.pmod(F.col(ordinal) - last - 1, F.lit(n))).limit(1)


def curated_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """A, then the rows of b whose key a does not have; ``part`` tells which."""
    return a.withColumn("part", F.lit("a")).unionByName(b.join(a.select(key), key, "left_anti").withColumn("part", F.lit("b")))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows only in one of two snapshots (repeated rows count)."""
    return new.exceptAll(old).withColumn("change", F.lit("added")).unionByName(old.exceptAll(new).withColumn("change", F.lit("removed")))


def prune(dimension: DataFrame, used: DataFrame, key: str, seeded: str) -> DataFrame:
    """Seeded keys, and others that are in use."""
    return dimension.where(F.col(seeded)).unionByName(dimension.where(~F.col(seeded)).join(used.select(key).distinct(), key, "left_semi"))


def newest(df: DataFrame, date: str, key: str, n: int) -> DataFrame:
    """The newest ``n`` rows, ties by key; rows without a date come last."""
    return df.orderBy(F.desc_nulls_last(date), key).limit(n)


def largest(df: DataFrame, value: Column, key: str, n: int) -> DataFrame:
    """The ``n`` rows of the largest value, a missing one counting as 0; ties by key."""
    return df.orderBy(F.coalesce(value, F.lit(0)).desc(), key).limit(n)


def sorted_either(df: DataFrame, value: Column, key: str, n: int, down: bool) -> DataFrame:
    """The first ``n`` rows in either direction, missing values last in both."""
    return df.orderBy(value.desc_nulls_last() if down else value.asc_nulls_last(), key).limit(n)


def top_with_total(df: DataFrame, order: Sequence[Column], n: int, total: str = "available") -> DataFrame:
    """The first ``n`` rows, each with the number of all rows."""
    return df.orderBy(*order).limit(n).join(F.broadcast(df.agg(F.count(F.lit(1)).alias(total))))  # one row


def lead(df: DataFrame, areas: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first row in order among those of the given areas."""
    return df.join(areas.select(key).distinct(), key, "left_semi").orderBy(*order).limit(1)


def announce_queue(df: DataFrame, done: DataFrame, key: str, date: str, tie: str, as_of: dt.date, days: int = 30, n: int = 25) -> DataFrame:
    """The newest ``n`` rows of the last ``days`` days whose key has not been announced."""
    recent = df.where(F.col(date).cast("date").between(F.date_sub(F.lit(as_of), days), F.lit(as_of)))
    return newest(recent.join(done.select(key).distinct(), key, "left_anti"), date, tie, n)


def teasers(df: DataFrame, keep: Column, key: str, text: str, n: int = 30, cap: int = 240) -> DataFrame:
    """The last ``n`` rows by key that are kept, with the start of their text."""
    return df.where(keep).orderBy(F.desc(key)).limit(n).select(key, F.substring(text, 1, cap).alias("teaser"))


def broken_links(df: DataFrame, ok: Column, key: str, n: int = 15) -> DataFrame:
    """The last ``n`` rows by key whose link is broken (or was not checked)."""
    return df.where(~F.coalesce(ok, F.lit(False))).orderBy(F.desc(key)).limit(n)


def any_filter(df: DataFrame, key: str, *tests: Column) -> DataFrame:
    """Keys of rows that pass at least one test, each once."""
    hit = F.lit(False)
    for t in tests:
        hit = hit | F.coalesce(t, F.lit(False))
    return df.where(hit).select(key).distinct()


def target_union(sources: Sequence[DataFrame], key: str, known: DataFrame) -> DataFrame:
    """The distinct keys of all sources, each with whether it is known already."""
    every = sources[0].select(key)
    for more in sources[1:]:
        every = every.unionByName(more.select(key))
    seen = known.select(key).distinct().withColumn("known", F.lit(True))
    return every.distinct().join(seen, key, "left").fillna(False, ["known"])


def url_inventory(*urls: DataFrame) -> DataFrame:
    """The distinct urls of all tables (url)."""
    every = urls[0].select("url")
    for more in urls[1:]:
        every = every.unionByName(more.select("url"))
    return every.where("url IS NOT NULL AND url != ''").distinct()
