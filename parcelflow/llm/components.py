"""Connected components of a link table as Spark joins (alternating large-star and small-star steps)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_util import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v; every node is re-linked to the least node of its star."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return moved.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, label: str, max_rounds: int = 60) -> DataFrame:
    """links (a, b) of long ids -> (node, component), component being the least id that is reachable.

    Only nodes with a link to another node are returned.  Nulls take no part.  Each round is written to the shared folder,
    so a lost executor costs one round at most; tables of earlier rounds are deleted.  The edges of a hub meet in one task,
    as ids only."""
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    edges = links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = written(edges, f"{label}-links")
    state = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = state(edges)
    for _ in range(max_rounds):
        moved = written(_star(_star(edges, True), False), f"{label}-round")
        discard(edges)
        edges, now = moved, state(moved)
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
