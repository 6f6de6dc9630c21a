"""Data-quality checks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality
from .filter_queries import LOT_CTE, lots
from .registry import query
from .source_queries import scratch


def _count(name: str, sev: str, test: str) -> str:
    return f"SELECT '{name}' AS rule, '{sev}' AS severity, count(*) FILTER ({test})::BIGINT AS n FROM lots"


@query("Q01_require_columns", "SELECT count(*)::BIGINT AS rows FROM part")
def _(t):
    return quality.require_columns(t.part, ["p_partkey", "p_name"], rejected=["p_legacy"]).agg(F.count(F.lit(1)).alias("rows"))


@query("Q02_require_row_count", "SELECT count(*)::BIGINT AS nations FROM nation")
def _(t):
    return quality.require_rows(t.nation, exact=25).agg(F.count(F.lit(1)).alias("nations"))


@query("Q03_require_enum", LOT_CTE + _count("kind", "CRITICAL", "kind NOT IN ('SMALL', 'LARGE', 'MEDIUM')"))
def _(t):
    return quality.violations(lots(t), {"kind": ("CRITICAL", ~F.col("kind").isin("SMALL", "LARGE", "MEDIUM"))})


@query("Q04_require_implication", LOT_CTE + _count("no_units", "HIGH", "units = 0 AND height_m > 10") + " UNION ALL " + _count("heritage_low", "LOW", "(heritage IS NULL) <> (lot_id % 23 > 0 AND lot_id % 19 > 0)"))
def _(t):
    return quality.violations(lots(t), {"no_units": ("HIGH", (F.col("units") == 0) & (F.col("height_m") > 10)), "heritage_low": ("LOW", F.col("heritage").isNull() != ((F.col("lot_id") % 23 > 0) & (F.col("lot_id") % 19 > 0)))})


_RANGES = {"lot_m2": ("HIGH", 50, 800), "coverage": ("CRITICAL", 0, 0.8), "height_m": ("MEDIUM", 0, 14), "transit_m": ("LOW", 10, 1600)}


@query("Q05_range_checks", LOT_CTE + " UNION ALL ".join(_count(c, sev, f"{c} < {a} OR {c} > {b}") for c, (sev, a, b) in _RANGES.items()))
def _(t):
    return quality.violations(lots(t), {c: (sev, ~F.col(c).between(a, b)) for c, (sev, a, b) in _RANGES.items()})


@query("Q06_derived_equality", LOT_CTE + _count("least", "HIGH", "abs(least(lot_m2, transit_m) - least(lot_m2, transit_m + lot_id % 2)) > 0.5"))
def _(t):
    return quality.violations(lots(t), {"least": ("HIGH", F.abs(F.least("lot_m2", "transit_m") - F.least(F.col("lot_m2"), F.col("transit_m") + F.col("lot_id") % 2)) > 0.5)})


@query("Q07_zone_coupling", LOT_CTE + _count("regulated_small", "MEDIUM", "regulated AND kind = 'SMALL'") + " UNION ALL " + _count("listed_large", "MEDIUM", "heritage = 'listed' AND kind = 'LARGE'"))
def _(t):
    return quality.violations(lots(t), {"regulated_small": ("MEDIUM", F.col("regulated") & (F.col("kind") == "SMALL")), "listed_large": ("MEDIUM", (F.col("heritage") == "listed") & (F.col("kind") == "LARGE"))})


@query("Q08_findings_report", LOT_CTE + ", f AS (" + " UNION ALL ".join(_count(c, sev, f"{c} < {a} OR {c} > {b}") for c, (sev, a, b) in _RANGES.items()) + ") SELECT rule, severity, n, CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END AS severity_rank FROM f WHERE n > 0")
def _(t):
    return quality.report(quality.violations(lots(t), {c: (sev, ~F.col(c).between(a, b)) for c, (sev, a, b) in _RANGES.items()}))


@query("Q09_fail_on_unknown", "SELECT c_nationkey AS code, count(*) AS n FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation) GROUP BY 1 UNION ALL SELECT -1, count(*) FROM customer WHERE c_mktsegment NOT IN (SELECT DISTINCT c_mktsegment FROM customer WHERE c_nationkey = 3 AND c_acctbal > 9000)")
def _(t):
    # Every nation must be known; of the market segments at most so many rows as -1 tells may be unknown.
    known = quality.fail_on_unknown(t.customer.withColumn("code", F.col("c_nationkey")), "code", t.nation, "n_nationkey").groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    segments = t.customer.where("c_nationkey = 3 AND c_acctbal > 9000").select("c_mktsegment").distinct()
    unknown = t.customer.join(segments, "c_mktsegment", "left_anti").count()
    quality.fail_on_unknown(t.customer, "c_mktsegment", segments, "c_mktsegment", most=unknown)
    return known.unionByName(t.spark.createDataFrame([(-1, unknown)], "code int, n long"))


@query("Q10_label_gap_report", "SELECT DISTINCT p_brand AS label FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 49)")
def _(t):
    return quality.label_gaps(t.part, "p_brand", t.part.where("p_size > 49").select(F.col("p_brand").alias("label")).distinct(), "label")


@query("Q11_legacy_key_reject", "SELECT count(*)::BIGINT AS rows FROM supplier")
def _(t):
    return quality.require_columns(t.supplier, [], rejected=["s_oldkey"]).agg(F.count(F.lit(1)).alias("rows"))


@query("Q12_idempotence_check", "WITH a AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), b AS (SELECT p_brand, count(*) AS n FROM part WHERE p_size < 50 GROUP BY 1) SELECT 'again' AS run, 0::BIGINT AS different UNION ALL SELECT 'changed', (SELECT count(*) FROM (FROM a EXCEPT ALL FROM b)) + (SELECT count(*) FROM (FROM b EXCEPT ALL FROM a))")
def _(t):
    # Two runs as they were written, and one over fewer rows.
    def run(parts):
        path = scratch(t)
        parts.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).withColumn("generated_at", F.current_timestamp()).write.parquet(path)
        return t.spark.read.parquet(path)

    first = run(t.part)
    rows = [(name, quality.same_rows(first, run(parts), ["generated_at"])) for name, parts in (("again", t.part), ("changed", t.part.where("p_size < 50")))]
    again, changed = [df.select(F.lit(name).alias("run"), "different") for name, df in rows]
    return again.unionByName(changed)
