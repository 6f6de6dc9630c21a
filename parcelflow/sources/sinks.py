"""Validated, versioned and append-only outputs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fs(df: DataFrame, path: str):
    sc = df.sparkSession.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p, sc._jvm.org.apache.hadoop.fs.Path


def publish(df: DataFrame, path: str, check: Callable[[DataFrame], object], fmt: str = "parquet") -> None:
    """Write beside the target, check what was written, then take the target's place; on a failed check the target stays.

    The old table is moved aside and deleted only when the new one is in its place, and is moved back if that fails.  After
    a crash in between, the next call or ``restore`` puts it back."""
    _publish(df, path, fmt, lambda staged: check(df.sparkSession.read.format(fmt).schema(df.schema).load(staged)))


def publish_observed(df: DataFrame, path: str, metrics: dict[str, Column], check: Callable[[dict[str, int]], object], fmt: str = "parquet") -> object:
    """As ``publish``, with the metrics observed while the rows are written, so that they are read once; returns what the
    check makes of them.  A check that raises leaves the target as it is."""
    from pyspark.sql import Observation

    seen = Observation()
    found = []
    _publish(df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), path, fmt, lambda _: found.append(check({n: seen.get[n] for n in metrics})))
    return found[0]


def _publish(df: DataFrame, path: str, fmt: str, check: Callable[[str], object]) -> None:
    restore(df, path)
    fs, target, make = _fs(df, path)
    base = path.rstrip("/")
    staged, aside = make(f"{base}.staged-{uuid.uuid4().hex}"), make(f"{base}.aside")
    df.write.format(fmt).save(staged.toString())
    try:
        check(staged.toString())
    except Exception:
        fs.delete(staged, True)
        raise
    if fs.exists(target) and not fs.rename(target, aside):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(staged, target):
        restore(df, path)
        raise OSError(f"{staged.toString()} could not take the place of {path}")
    fs.delete(aside, True)


def restore(df: DataFrame, path: str) -> None:
    """Put a table back that an interrupted ``publish`` moved aside, or drop the old one if the new one is in its place."""
    fs, target, make = _fs(df, path)
    aside = make(f"{path.rstrip('/')}.aside")
    if fs.exists(aside) and fs.exists(target):
        fs.delete(aside, True)
    elif fs.exists(aside) and not fs.rename(aside, target):
        raise OSError(f"{aside.toString()} could not be moved back")


def clean_cells(df: DataFrame, marks: str = ",\t\n\r") -> DataFrame:
    """Delimiters inside text cells become spaces."""
    text = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    return df.select(*[F.translate(c, marks, " " * len(marks)).alias(c) if c in text else F.col(c) for c in df.columns])


def write_delimited(df: DataFrame, folder: str, keep: Column) -> None:
    """CSV, TSV and filtered CSV of the cleaned rows."""
    clean = clean_cells(df)
    clean.write.mode("overwrite").csv(f"{folder}/csv", header=True)
    clean.write.mode("overwrite").csv(f"{folder}/tsv", header=True, sep="\t")
    clean.where(keep).write.mode("overwrite").csv(f"{folder}/filtered", header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_version(df: DataFrame, folder: str, run_date: str) -> str:
    """Every run has its own folder; the one before stays for comparison."""
    path = f"{folder}/run_date={run_date}"
    df.write.mode("overwrite").parquet(path)
    return path


def append_jsonl(df: DataFrame, path: str) -> None:
    """S12."""
    df.write.mode("append").json(path)


def sitemap_rows(home: str, labels: DataFrame, districts: DataFrame, listings: DataFrame) -> DataFrame:
    """(loc, lastmod, changefreq, priority); inputs have (slug, lastmod)."""
    spark = labels.sparkSession
    last = listings.agg(F.max("lastmod").alias("lastmod"))
    row = lambda df, part, freq, pr: df.select(F.concat(F.lit(f"{home}{part}"), F.col("slug")).alias("loc"), "lastmod", F.lit(freq).alias("changefreq"), F.lit(pr).alias("priority"))
    top = last.select(F.lit(home).alias("loc"), "lastmod", F.lit("daily").alias("changefreq"), F.lit(1.0).alias("priority"))
    return top.unionByName(row(labels, "label/", "daily", 0.8)).unionByName(row(districts, "district/", "daily", 0.7)).unionByName(row(listings, "place/", "weekly", 0.5))


def item_list(df: DataFrame, group: str, order: Column, cap: int, **fields: Column) -> DataFrame:
    """(group, payload): the first ``cap`` rows of each group as one JSON list with positions."""
    from ..operators.aggregates import first_n
    from pyspark.sql import Window as W

    top = first_n(df.withColumn("_o", order), [group], [F.col("_o")], cap)
    top = top.withColumn("_pos", F.row_number().over(W.partitionBy(group).orderBy("_o")))
    item = F.struct(F.col("_pos").alias("position"), *[c.alias(n) for n, c in fields.items()])
    return top.groupBy(group).agg(F.to_json(F.array_sort(F.collect_list(item))).alias("payload"))


def archive_raw(df: DataFrame, folder: str, batch_id: str) -> None:
    """Raw responses of a batch, and beside them the table of request ids and keys."""
    df.select("request_id", "raw").write.mode("overwrite").json(f"{folder}/raw/batch_id={batch_id}")
    df.select("request_id", "key").write.mode("overwrite").parquet(f"{folder}/keys/batch_id={batch_id}")
