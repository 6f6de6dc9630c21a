"""Roll-ups, indexes and counts over the driver's tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import mathx
from ..operators import aggregates as agg
from ..operators import quality
from . import standins as s
from .filter_queries import LOT_CTE, lots
from .function_queries import RULES, _RULES_SQL
from .registry import query
from ..functions import keys

E = F.expr


@query("A01_area_totals", "SELECT a.*, sample FROM (SELECT c_nationkey AS area, count(*) AS n, round(sum(c_acctbal), 2) AS balance, count(*) FILTER (c_acctbal < 0)::BIGINT AS n_flagged FROM customer GROUP BY 1) a JOIN (SELECT c_nationkey AS area, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer) WHERE rn <= 5 GROUP BY 1) USING (area)")
def _(t):
    c = t.customer.withColumn("area", F.col("c_nationkey")).withColumn("o", F.col("c_custkey"))
    r = agg.area_totals(c, "area", {"balance": "c_acctbal"}, F.col("c_acctbal") < 0, "c_custkey", "o")
    return r.withColumn("balance", F.round("balance", 2))


@query("A02_unused_envelope", LOT_CTE + """SELECT nb, sum(floor(lot_m2 * 0.6::DOUBLE - least(lot_m2 * coverage * greatest(round_even(height_m / 3, 0), 1), lot_m2 * 0.6::DOUBLE)))::BIGINT AS unused_gfa, sum(round_even(height_m / 3, 0))::BIGINT AS storeys FROM lots GROUP BY nb""")
def _(t):
    return agg.unused_envelope(lots(t), "nb")


@query("A03_grand_totals", "SELECT c_nationkey AS area, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY ROLLUP (c_nationkey)")
def _(t):
    return agg.with_grand_total(t.customer.withColumnRenamed("c_nationkey", "area"), "area", n=F.count(F.lit(1)), balance=F.round(F.sum("c_acctbal"), 2))


@query("A04_count_by_area_window", f"SELECT n_nationkey AS area, coalesce(n, 0)::BIGINT AS n FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate::DATE >= {s.AS_OF_SQL} - 20 AND o_orderdate::DATE < {s.AS_OF_SQL} GROUP BY 1) ON c_nationkey = n_nationkey")
def _(t):
    o = t.orders.where((F.col("o_orderdate").cast("date") >= F.date_sub(F.lit(s.AS_OF), 20)) & (F.col("o_orderdate").cast("date") < F.lit(s.AS_OF)))
    n = o.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("area")).agg(F.count(F.lit(1)).alias("n"))
    return agg.with_zero_rows(t.nation.select(F.col("n_nationkey").alias("area")), n, "area", ["n"])


_CATS = "WITH g AS (SELECT c_nationkey AS area, c_mktsegment AS seg, count(*) AS c FROM customer GROUP BY ALL)"


@query("A05_category_breakdown", _CATS + " SELECT area, sum(c)::BIGINT AS n, string_agg(seg || '=' || c, ',' ORDER BY seg) AS by_category FROM g GROUP BY area")
def _(t):
    m = agg.category_map(t.customer.withColumn("area", F.col("c_nationkey")), "area", "c_mktsegment")
    return m.select("area", "n", agg.map_text("by_category").alias("by_category"))


@query("A06_label_counts_by_area", f"SELECT b, string_agg(label || '=' || c, ',' ORDER BY label) AS labels, round(sum(c) / max(total) * 100, 4) AS tag_rate FROM (SELECT p_brand AS b, label, count(*) AS c FROM (SELECT p_brand, {_RULES_SQL} AS label FROM part) WHERE label IS NOT NULL GROUP BY ALL) JOIN (SELECT p_brand AS b, count(*)::DOUBLE AS total FROM part GROUP BY 1) USING (b) GROUP BY b")
def _(t):
    p = t.part.withColumn("b", F.col("p_brand")).withColumn("label", keys.keyword_label(F.col("p_name"), RULES))
    m = agg.category_map(p.where("label IS NOT NULL"), "b", "label", "labels")
    return m.join(p.groupBy("b").agg(F.count(F.lit(1)).alias("total")), "b").select("b", agg.map_text("labels").alias("labels"), F.round(F.col("n") / F.col("total") * 100, 4).alias("tag_rate"))


@query("A07_closure_index", f"SELECT label, count(*) FILTER (c IS NULL)::BIGINT AS active, count(*) FILTER (c > {s.AS_OF_SQL} - 90 AND c <= {s.AS_OF_SQL})::BIGINT AS closed90, count(*) FILTER (c > {s.AS_OF_SQL} - 365 AND c <= {s.AS_OF_SQL})::BIGINT AS closed365, CASE WHEN count(*) FILTER (c IS NULL) >= 20 THEN round_even(count(*) FILTER (c > {s.AS_OF_SQL} - 365 AND c <= {s.AS_OF_SQL}) * 100.0::DOUBLE / count(*) FILTER (c IS NULL), 6) END AS rate FROM (SELECT o_orderpriority AS label, {s.CANCEL} AS c FROM orders) GROUP BY label")
def _(t):
    return agg.closure_index(t.orders.select(F.col("o_orderpriority").alias("label"), E(s.CANCEL).alias("c")), "label", "c", s.AS_OF)


@query("A08_openings_index", f"SELECT label, count(*) AS n365, count(*) FILTER (d >= {s.AS_OF_SQL} - 30)::BIGINT AS n30, max(d) AS newest FROM (SELECT unnest([o_orderpriority, o_orderstatus]) AS label, o_orderdate::DATE AS d FROM orders WHERE o_orderdate::DATE BETWEEN {s.AS_OF_SQL} - 365 AND {s.AS_OF_SQL}) GROUP BY label")
def _(t):
    return agg.openings_index(t.orders, F.array("o_orderpriority", "o_orderstatus"), "o_orderdate", s.AS_OF)


@query("A09_latest_snapshot_then_sum", "WITH l AS (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events GROUP BY ALL) SELECT user_id % 10 AS area, round(sum(v), 2) AS total, count(*) AS n, count(DISTINCT event_type) AS sectors FROM l GROUP BY 1")
def _(t):
    last = agg.latest_per_key(t.events, ["user_id", "event_type"], [F.col("event_id")], ["value"])
    return last.groupBy((F.col("user_id") % 10).alias("area")).agg(F.round(F.sum("value"), 2).alias("total"), F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("sectors"))


@query("A10_ward_rollup", "WITH w AS (SELECT c_nationkey AS ward, count(*) AS n, round_even(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1) SELECT ward % 5 AS area, sum(n)::BIGINT AS n, round(avg(mean), 3) AS mean_of_means FROM w GROUP BY 1")
def _(t):
    return agg.two_level_rollup(t.customer, F.col("c_nationkey"), F.col("unit") % 5, "c_acctbal")


@query("A11_census_rollup", "WITH h AS (SELECT c_nationkey AS hood, count(*)::DOUBLE AS pop, count(*) FILTER (c_acctbal > 5000)::DOUBLE AS rich, avg(c_acctbal) AS rate FROM customer GROUP BY 1) SELECT hood % 5 AS area, round_even(sum(rich) * 100 / sum(pop), 6) AS pct, round(sum(rate * pop) / sum(pop), 4) AS weighted_rate, round(avg(rate), 4) AS plain_mean, count(*) AS present FROM h GROUP BY 1")
def _(t):
    h = t.customer.groupBy(F.col("c_nationkey").alias("hood")).agg(F.count(F.lit(1)).cast("double").alias("pop"), F.count_if(F.col("c_acctbal") > 5000).cast("double").alias("rich"), F.avg("c_acctbal").alias("rate"))
    return h.groupBy((F.col("hood") % 5).alias("area")).agg(mathx.pct(F.sum("rich"), F.sum("pop"), 6).alias("pct"), F.round(F.sum(F.col("rate") * F.col("pop")) / F.sum("pop"), 4).alias("weighted_rate"), F.round(F.avg("rate"), 4).alias("plain_mean"), F.count(F.lit(1)).alias("present"))


@query("A12_unpivot_wide", "SELECT s_suppkey, variable, v FROM (SELECT s_suppkey, s_acctbal AS balance, s_nationkey::DOUBLE AS nation FROM supplier) UNPIVOT (v FOR variable IN (balance, nation))")
def _(t):
    wide = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return agg.long_form(wide, ["s_suppkey"], ["balance", "nation"])


_BRACKET = "SELECT c_nationkey AS area, floor(c_acctbal / 1000)::BIGINT AS b, count(*) AS c FROM customer GROUP BY ALL"


@query("A13_median_bracket", f"WITH g AS ({_BRACKET}), r AS (SELECT *, sum(c) OVER (PARTITION BY area ORDER BY b) / sum(c) OVER (PARTITION BY area) AS s FROM g) SELECT area, min(b) * 1000 + 500 AS median_mid FROM r WHERE s >= 0.5 GROUP BY area")
def _(t):
    g = t.customer.groupBy(F.col("c_nationkey").alias("area"), F.floor(F.col("c_acctbal") / 1000).alias("b")).agg(F.count(F.lit(1)).alias("c")).withColumn("mid", F.col("b") * 1000 + 500)
    return agg.median_bracket(g, "area", "b", "mid", "c")


@query("A14_permit_rollup_per_key", f"SELECT c_custkey, count(o_orderkey) AS permits, round(coalesce(sum(o_totalprice), 0), 2) AS value, max(o_orderdate::DATE) AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate::DATE >= {s.AS_OF_SQL} - 365 * 2 GROUP BY 1")
def _(t):
    return agg.permit_rollup(t.customer.select("c_custkey"), t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_totalprice", "o_orderdate", s.AS_OF)


@query("A15_median_cost_per_unit", "SELECT p_brand, CASE WHEN count(*) >= 5 THEN round(median(p_retailprice / p_size), 6) END AS median, count(*) AS n FROM part WHERE p_size >= 40 GROUP BY p_brand")
def _(t):
    p = t.part.where("p_size >= 40").withColumn("cost", F.col("p_retailprice") / F.col("p_size"))
    return agg.median_if(p, "p_brand", "cost", 5).withColumn("median", F.round("median", 6))


@query("A16_latest_units_existing", "SELECT l_partkey, arg_max(l_quantity, [epoch(l_shipdate)::BIGINT, l_orderkey, l_linenumber]) AS quantity FROM lineitem GROUP BY 1")
def _(t):
    return agg.latest_per_key(t.lineitem.withColumn("d", F.unix_timestamp("l_shipdate")), ["l_partkey"], [F.col("d"), F.col("l_orderkey"), F.col("l_linenumber")], ["l_quantity"]).select("l_partkey", F.col("l_quantity").alias("quantity"))


@query("A17_most_recent_wins_union", """SELECT o_custkey, arg_max(label, [epoch(d)::BIGINT, o_orderkey]) AS label FROM (SELECT o_custkey, o_orderkey, 'a' AS label, o_orderdate AS d FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_custkey, o_orderkey, 'b', o_orderdate FROM orders WHERE o_orderpriority = '2-HIGH' UNION ALL SELECT o_custkey, o_orderkey, 'c', TIMESTAMP '1990-01-01' FROM orders WHERE o_orderpriority = '5-LOW') GROUP BY 1""")
def _(t):
    part = lambda p, label, d: t.orders.where(F.col("o_orderpriority") == p).select("o_custkey", "o_orderkey", F.lit(label).alias("label"), d.alias("d"))
    none = F.lit(None).cast("timestamp")
    u = part("1-URGENT", "a", F.col("o_orderdate")).unionByName(part("2-HIGH", "b", F.col("o_orderdate"))).unionByName(part("5-LOW", "c", none))
    u = u.withColumn("d", F.coalesce("d", F.lit("1990-01-01").cast("timestamp")))
    return agg.latest_per_key(u, ["o_custkey"], [F.col("d"), F.col("o_orderkey")], ["label"]).select("o_custkey", "label")


@query("A18_index_latest_by_key", "SELECT o_custkey, arg_max(o_orderkey, [epoch(o_orderdate)::BIGINT, o_orderkey]) AS o_orderkey FROM orders GROUP BY 1")
def _(t):
    return agg.latest_per_key(t.orders.withColumn("k", F.col("o_orderkey")), ["o_custkey"], [F.col("o_orderdate"), F.col("k")], ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("A19_builder_activity", "SELECT k, n, CASE WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' ELSE '4+' END AS bucket FROM (SELECT k, count(*) AS n FROM (SELECT o_custkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' UNION ALL SELECT user_id FROM events WHERE event_type = 'signup') GROUP BY k)")
def _(t):
    u = t.orders.where("o_orderdate >= TIMESTAMP '2000-01-01'").select(F.col("o_custkey").alias("k")).unionByName(t.events.where("event_type = 'signup'").select(F.col("user_id").alias("k")))
    return agg.builder_activity(u, "k")


@query("A20_event_payload_latest", "SELECT user_id, event_type, arg_max(event_id, [epoch_us(ts), event_id]) AS event_id, count(*) - 1 AS extra FROM events GROUP BY ALL")
def _(t):
    e = t.events.withColumn("id", F.col("event_id"))
    return agg.latest_per_key(e, ["user_id", "event_type"], [F.col("ts"), F.col("id")], ["event_id"])


@query("A21_signal_stats", "SELECT event_type, count(*) AS total, count(c_custkey) AS matched, count(*) - count(c_custkey) AS unmatched, count(DISTINCT c_custkey) AS parcels FROM events LEFT JOIN customer ON c_custkey = user_id * 20 GROUP BY 1")
def _(t):
    return agg.signal_stats(t.events.withColumn("c_custkey", F.col("user_id") * 20), t.customer, "event_type", "c_custkey")


_RANK = "(SELECT c_acctbal AS p FROM (SELECT c_acctbal, row_number() OVER (ORDER BY c_acctbal) AS rn, count(*) OVER () AS n FROM customer) WHERE rn = floor({p} * (n - 1)) + 1)"


@query("A22_share_above_percentile", f"SELECT c_nationkey AS area, round(avg((c_acctbal >= p)::INT) * 100, 6) AS share FROM customer, {_RANK.format(p=0.75)} GROUP BY 1")
def _(t):
    c = t.customer.withColumn("area", F.col("c_nationkey"))
    return agg.share_above(c, "area", "c_acctbal", agg.nearest_rank(c, "c_acctbal", 0.75)).withColumn("share", F.round("share", 6))


@query("A23_area_weighted_share", LOT_CTE + "SELECT nb, round(coalesce(sum(lot_m2) FILTER (kind = 'SMALL') * 100 / sum(lot_m2), 30), 6) AS share FROM lots GROUP BY nb")
def _(t):
    return agg.weighted_share(lots(t), "nb", "lot_m2", F.col("kind") == "SMALL")


@query("A24_density_p95_score", "WITH g AS (SELECT c_nationkey AS area, count(*) / (1 + c_nationkey)::DOUBLE AS density FROM customer GROUP BY 1), p AS (SELECT density AS p FROM (SELECT density, row_number() OVER (ORDER BY density) AS rn, count(*) OVER () AS n FROM g) WHERE rn = floor(0.95 * (n - 1)) + 1) SELECT area, least(greatest(round_even(density * 100 / p, 1), 0), 100) AS score FROM g, p")
def _(t):
    g = t.customer.groupBy(F.col("c_nationkey").alias("area")).agg(F.count(F.lit(1)).alias("c")).withColumn("density", F.col("c") / (F.lit(1.0) + F.col("area")))
    return agg.density_score(g, "area", "density")


@query("A25_nearest_rank_percentile", f"SELECT p AS p95 FROM {_RANK.format(p=0.95)}")
def _(t):
    return agg.nearest_rank(t.customer, "c_acctbal", 0.95, out="p95")


@query("A25_nearest_rank_by_key", "SELECT c_nationkey, c_acctbal AS p FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS rn, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE rn = floor(0.9 * (n - 1)) + 1")
def _(t):
    return agg.nearest_rank(t.customer, "c_acctbal", 0.9, ["c_nationkey"])


@query("A28_zone_capacity_rollup", LOT_CTE + "SELECT nb, greatest(coalesce(nullif(sum(CASE kind WHEN 'SMALL' THEN 4 WHEN 'LARGE' THEN 2 ELSE 0 END), 0), 7), sum(units))::BIGINT AS capacity FROM lots GROUP BY nb")
def _(t):
    table = t.spark.createDataFrame([("SMALL", 4), ("LARGE", 2)], "kind string, per_lot int")
    return agg.capacity(lots(t), "nb", "kind", table, "units", 7)


@query("A29_permits_per_area_rate", "SELECT c_nationkey AS area, round(coalesce(sum(n), 0) * 1000.0::DOUBLE / count(*), 6) AS per_1000 FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    o = t.orders.where("o_orderdate >= TIMESTAMP '2001-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return agg.rate_per(t.customer.withColumnRenamed("c_nationkey", "area"), o, "c_custkey", "area", 1000.0, "per_1000")


@query("A30_brand_counts", "SELECT upper(p_name) AS brand, count(*) AS n, min(p_partkey) AS first_id FROM part GROUP BY 1 HAVING count(*) >= 2")
def _(t):
    return agg.repeated_names(t.part, F.upper("p_name"), "p_partkey")


@query("A31_ledger_rollup", "SELECT user_id % 3 AS provider, event_type AS sku, ts::DATE AS day, round(sum(value), 4) AS cost, count(*) AS calls FROM events GROUP BY GROUPING SETS ((1), (1, 2), (3), ())")
def _(t):
    e = t.events.select((F.col("user_id") % 3).alias("provider"), F.col("event_type").alias("sku"), F.to_date("ts").alias("day"), "value")
    return agg.ledger_rollup(e, "provider", "sku", "day", "value")


@query("A32_fold_strictest", "SELECT l_orderkey, arg_max(l_returnflag, CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END) AS flag FROM lineitem GROUP BY 1")
def _(t):
    return agg.strictest(t.lineitem.withColumnRenamed("l_returnflag", "flag"), "l_orderkey", "flag", ["A", "R"])


@query("A33_distinct_address_count", "SELECT l_orderkey, CASE count(DISTINCT l_suppkey) WHEN 1 THEN NULL WHEN 2 THEN 'semi' ELSE 'row' END AS kind FROM lineitem GROUP BY 1")
def _(t):
    return agg.attached_kind(t.lineitem, "l_orderkey", "l_suppkey")


@query("A34_funnel_stats", LOT_CTE + "SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, count(*) FILTER (units >= 4)::BIGINT AS large FROM (SELECT *, CASE WHEN height_m > 14 THEN 'tall' WHEN lot_m2 < 100 THEN 'small' WHEN heritage IS NOT NULL THEN 'heritage' END AS reason FROM lots) GROUP BY 1")
def _(t):
    from ..operators import resolve

    why = resolve.waterfall([("tall", F.col("height_m") > 14), ("small", F.col("lot_m2") < 100), ("heritage", F.col("heritage").isNotNull())])
    return lots(t).groupBy(F.coalesce(why, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("units") >= 4).alias("large"))


@query("A35_unjoined_count", "SELECT count(*)::BIGINT AS unjoined FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(t):
    return agg.unjoined(t.customer, t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("A05_category_ages", """WITH g AS (SELECT c_nationkey AS area, o_orderpriority AS cat, count(*) AS c, count(*) FILTER (date_diff('day', o_orderdate::DATE, DATE '2020-06-01') / 365.25::DOUBLE >= 10)::BIGINT AS c10, count(*) FILTER (date_diff('day', o_orderdate::DATE, DATE '2020-06-01') / 365.25::DOUBLE >= 20)::BIGINT AS c20 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT area, sum(c)::BIGINT AS n, sum(c10)::BIGINT AS n_10y, sum(c20)::BIGINT AS n_20y, string_agg(cat || '=' || c, ',' ORDER BY cat) AS by_category, coalesce(string_agg(cat || '=' || c20, ',' ORDER BY cat) FILTER (c20 > 0), '') AS by_category_20y FROM g GROUP BY area""")
def _(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("area"), "o_orderpriority", "o_orderdate")
    m = agg.category_ages(o, "area", "o_orderpriority", "o_orderdate", dt.date(2020, 6, 1))
    return m.select("area", "n", "n_10y", "n_20y", agg.map_text("by_category").alias("by_category"), agg.map_text("by_category_20y").alias("by_category_20y"))


@query("A02_envelope_measures", LOT_CTE + """, d AS (SELECT nb, lot_m2, value, round_even(height_m / 3, 0) AS st, lot_m2 * coverage * greatest(round_even(height_m / 3, 0), 1) AS gfa FROM lots)
SELECT nb, sum(st)::BIGINT AS storeys, round(sum(gfa), 4) AS existing_gfa, round(sum(gfa) / sum(lot_m2), 6) AS existing_fsi, round(sum(greatest(lot_m2 * 0.6::DOUBLE - gfa, 0)), 4) AS unused_gfa, round(sum(greatest(lot_m2 * 0.6::DOUBLE - gfa, 0)) / sum(lot_m2), 6) AS unused_fsi,
round(sum(greatest(lot_m2 * 0.6::DOUBLE - gfa, 0)) * 4000, 0) AS value, round(sum(greatest(lot_m2 * 0.6::DOUBLE - gfa, 0)) * 25, 3) AS co2_kg, round(sum(value), 2) AS cost FROM d GROUP BY nb""")
def _(t):
    m = agg.envelope_measures(lots(t), "nb", cost="value")
    digits = {"existing_gfa": 4, "existing_fsi": 6, "unused_gfa": 4, "unused_fsi": 6, "value": 0, "co2_kg": 3, "cost": 2}
    return m.select("nb", "storeys", *[F.round(c, n).alias(c) for c, n in digits.items()])


def _profile_sql(cols, flags=()):
    one = """SELECT '{c}' AS "column", count(*)::BIGINT AS rows, count(*) FILTER ({c} IS NULL)::BIGINT AS nulls, CASE WHEN count(DISTINCT {c}) < 15 THEN count(DISTINCT {c}) END AS "distinct", {f} AS finding FROM lots"""
    near = "WHEN greatest(count(*) FILTER ({c}), count(*) FILTER (NOT {c})) >= 0.995 * count({c}) THEN 'near_constant'"
    case = "CASE WHEN count({c}) = 0 THEN 'null' WHEN count(DISTINCT {c}) = 1 THEN 'constant' {r} END"
    text = " UNION ALL ".join(one.format(c=c, f=case.format(c=c, r=near.format(c=c) if c in flags else f"WHEN count(DISTINCT {c}) < 15 THEN 'few'")) for c in cols)
    return f"SELECT *, CASE finding WHEN 'null' THEN 'HIGH' WHEN 'constant' THEN CASE WHEN nulls > 0 THEN 'MEDIUM' ELSE 'HIGH' END WHEN 'near_constant' THEN 'MEDIUM' WHEN 'few' THEN 'MEDIUM' END AS severity FROM ({text})"


# Beside the lots' own columns: one value, one value beside nulls, nothing, a flag that is nearly always set.
_EXTRA = "(SELECT *, 'a' AS same, CASE WHEN lot_id % 2 = 0 THEN 7 END AS partly, NULL::INTEGER AS nothing, lot_id % 211 <> 0 AS usual FROM lots) lots"


@query("A36_column_profile", LOT_CTE + _profile_sql(["kind", "heritage", "regulated", "units", "value", "same", "partly", "nothing", "usual"], ("regulated", "usual")).replace("FROM lots", f"FROM {_EXTRA}"))
def _(t):
    cols = ["kind", "heritage", "regulated", "units", "value", "same", "partly", "nothing", "usual"]
    d = lots(t).withColumns({"same": F.lit("a"), "partly": F.when(F.col("lot_id") % 2 == 0, 7), "nothing": F.lit(None).cast("int"), "usual": F.col("lot_id") % 211 != 0})
    return agg.profile(d, cols)


@query("A37_concentration", "SELECT round(sum(n) FILTER (rn <= 5) * 100.0::DOUBLE / sum(n), 6) AS top5_share, count(*) AS groups, count(*) FILTER (n > 1)::BIGINT AS repeated FROM (SELECT p_name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_name) AS rn FROM part GROUP BY 1)")
def _(t):
    return agg.concentration(t.part, "p_name")


@query("A38_recall_backtest", "WITH t AS (SELECT p_partkey AS k, p_brand AS grp FROM part WHERE p_size >= 30), e AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 'elite' ELSE 'broad' END AS tier FROM part WHERE p_partkey % 3 = 0) SELECT grp, count(*) AS n, count(*) FILTER (tier = 'elite')::BIGINT AS elite, count(tier)::BIGINT AS any_tier, round_even(count(tier) * 100.0::DOUBLE / count(*), 2) AS recall FROM t LEFT JOIN e USING (k) GROUP BY ROLLUP (grp)")
def _(t):
    truth = t.part.where("p_size >= 30").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("grp"))
    tiers = t.part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 5 == 0, "elite").otherwise("broad").alias("tier"))
    return agg.recall(truth, tiers, "k", "grp")


@query("A39_agreement_matrix", "SELECT CASE WHEN truth = guess THEN 'exact' WHEN guess IS NULL THEN 'abstain' WHEN substr(truth, 1, 1) = substr(guess, 1, 1) THEN 'family' ELSE 'wrong' END AS outcome, count(*) AS n FROM (SELECT lower(p_type) AS truth, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 2 = 0 THEN lower(p_type) WHEN p_size % 3 = 0 THEN 'small' ELSE split_part(p_name, ' ', 1) END AS guess FROM part) GROUP BY 1")
def _(t):
    guess = F.when(F.col("p_size") % 7 == 0, None).when(F.col("p_size") % 2 == 0, F.lower("p_type")).when(F.col("p_size") % 3 == 0, "small").otherwise(F.split_part("p_name", F.lit(" "), F.lit(1)))
    p = t.part.select(F.lower("p_type").alias("truth"), guess.alias("guess"))
    return agg.agreement(p, "truth", "guess", lambda c: F.substring(c, 1, 1))


@query("A40_drift_counts", "SELECT p_type AS code, count(*) AS n FROM part WHERE p_type NOT IN ('SMALL', 'LARGE') GROUP BY 1")
def _(t):
    known = t.spark.createDataFrame([("SMALL",), ("LARGE",)], "code string")
    return agg.drift(t.part.withColumnRenamed("p_type", "code"), "code", known)


@query("A41_per_district_floor", "SELECT n_nationkey AS area, count(s_suppkey) AS n, count(s_suppkey) >= 4 AS ok FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def _(t):
    n = t.supplier.groupBy(F.col("s_nationkey").alias("area")).agg(F.count(F.lit(1)).alias("n"))
    return agg.with_zero_rows(t.nation.select(F.col("n_nationkey").alias("area")), n, "area", ["n"]).withColumn("ok", F.col("n") >= 4)


@query("A41_required_floor", "SELECT c_nationkey AS area, count(*) AS n FROM customer GROUP BY 1")
def _(t):
    n = t.customer.groupBy(F.col("c_nationkey").alias("area")).agg(F.count("*").alias("n"))
    broken = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left_anti")
    return quality.require_floor(n, "area", "n", 1, broken)


@query("A42_per_100_normalisation", "SELECT c_nationkey AS area, round_even(count(*) FILTER (c_acctbal < 0) * 100.0::DOUBLE / greatest(count(*), 1), 6) AS per_100 FROM customer GROUP BY 1")
def _(t):
    return agg.per_hundred(t.customer.withColumnRenamed("c_nationkey", "area"), "area", F.col("c_acctbal") < 0)


@query("A43_cross_axis_counts", "SELECT c_mktsegment AS label, c_nationkey AS district, count(*) AS n FROM customer GROUP BY CUBE (1, 2)")
def _(t):
    return agg.cross_counts(t.customer.select(F.col("c_mktsegment").alias("label"), F.col("c_nationkey").alias("district")), "label", "district")


@query("A44_label_distribution", "SELECT p_type AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM part GROUP BY 1")
def _(t):
    return agg.distribution(t.part.select(F.col("p_type").alias("label")), "label")


@query("A45_quantisation_check", LOT_CTE + _profile_sql(["height_m", "transit_m"]))
def _(t):
    return agg.profile(lots(t), ["height_m", "transit_m"])


@query("A45_mixed_types", "SELECT CASE WHEN p_partkey % 5 = 0 THEN 'boolean' WHEN p_partkey % 5 = 1 THEN 'number' WHEN p_partkey % 5 = 2 THEN 'text' WHEN p_partkey % 5 = 3 THEN 'array' END AS kind, count(*) AS n FROM part WHERE p_partkey % 5 < 4 GROUP BY 1")
def _(t):
    k = F.col("p_partkey")
    texts = F.when(k % 5 == 0, "true").when(k % 5 == 1, F.col("p_retailprice").cast("string")).when(k % 5 == 2, F.concat(F.lit('"'), "p_name", F.lit('"'))).when(k % 5 == 3, F.concat(F.lit("["), "p_size", F.lit("]"))).otherwise("null")
    return agg.mixed_types(t.part.select(texts.alias("bloom")), "bloom")


@query("A46_transition_counts", "SELECT CASE WHEN new IS NULL THEN 'error' WHEN new = 'unknown' THEN 'unknown' WHEN old = new THEN 'stayed' ELSE 'split' END AS kind, count(*) AS n FROM (SELECT lower(p_type) AS old, CASE WHEN p_size % 9 = 0 THEN NULL WHEN p_size % 5 = 0 THEN 'unknown' ELSE split_part(p_name, ' ', 1) END AS new FROM part) GROUP BY 1")
def _(t):
    state = t.part.select("p_partkey", F.lower("p_type").alias("old"))
    verdict = t.part.where("p_size % 9 != 0").select("p_partkey", F.when(F.col("p_size") % 5 == 0, "unknown").otherwise(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("new"))
    return agg.transitions(state, verdict, "p_partkey", "old", "new")


@query("A47_paired_context_values", "SELECT s_nationkey AS area, round(CASE WHEN max(s_acctbal) FILTER (s_suppkey % 2 = 0) IS NOT NULL AND max(s_acctbal) FILTER (s_suppkey % 2 = 1) IS NOT NULL THEN max(s_acctbal) FILTER (s_suppkey % 2 = 0) + max(s_acctbal) FILTER (s_suppkey % 2 = 1) ELSE 0 END, 2) AS paired FROM supplier GROUP BY 1")
def _(t):
    long = t.supplier.select(F.col("s_nationkey").alias("area"), F.when(F.col("s_suppkey") % 2 == 0, "even").otherwise("odd").alias("row"), "s_acctbal")
    return agg.paired(long, "area", "row", ("even", "odd"), "s_acctbal")
