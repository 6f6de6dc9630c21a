"""Projections, filters and predicates over the driver's tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import keys
from ..operators import parcels, resolve
from . import standins as s
from .registry import query

E = F.expr


@query("P01_filter_category", "SELECT c_custkey FROM customer WHERE trim(c_mktsegment) IN ('BUILDING', 'MACHINERY')")
def _(t):
    return t.customer.where(resolve.in_category("c_mktsegment", ["BUILDING", "MACHINERY"])).select("c_custkey")


@query("P02_filter_trailing", f"SELECT o_orderkey, o_orderdate::DATE >= {s.AS_OF_SQL} - 30 AS in30, o_orderdate::DATE >= {s.AS_OF_SQL} - 90 AS in90 FROM orders WHERE o_orderdate::DATE >= {s.AS_OF_SQL} - 365")
def _(t):
    o = t.orders.where(resolve.trailing("o_orderdate", s.AS_OF, 365))
    return o.select("o_orderkey", resolve.trailing("o_orderdate", s.AS_OF, 30).alias("in30"), resolve.trailing("o_orderdate", s.AS_OF, 90).alias("in90"))


@query("P03_filter_active_with_grace", f"SELECT o_orderkey FROM (SELECT o_orderkey, {s.CANCEL} AS c FROM orders) WHERE c IS NULL OR date_diff('day', c, {s.AS_OF_SQL}) <= 10")
def _(t):
    return t.orders.where(resolve.active_with_grace(E(s.CANCEL), s.AS_OF)).select("o_orderkey")


@query("P04_filter_never_cancelled", f"SELECT o_orderkey FROM orders WHERE coalesce(trim(cast({s.CANCEL} AS VARCHAR)), '') = ''")
def _(t):
    return t.orders.where(resolve.never_cancelled(E(s.CANCEL).cast("string"))).select("o_orderkey")


@query("P05_null_if_placeholder", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN p_type END AS value FROM part")
def _(t):
    raw = E("case p_partkey % 3 when 0 then ' None ' when 1 then '  ' else concat(' ', p_type) end")
    return t.part.select("p_partkey", resolve.null_if_placeholder(raw).alias("value"))


@query("P06_null_if_nonpositive", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_size::DOUBLE END AS value FROM part")
def _(t):
    raw = E("case p_partkey % 4 when 0 then cast(p_size as string) when 1 then '-1' when 2 then '0' else 'n/a' end")
    return t.part.select("p_partkey", resolve.null_if_nonpositive(raw).alias("value"))


KINDS = {"ECONOMY": "small", "SMALL": "small", "STANDARD": "mid", "MEDIUM": "mid", "LARGE": "big"}
_KINDS_SQL = "CASE p_type WHEN 'ECONOMY' THEN 'small' WHEN 'SMALL' THEN 'small' WHEN 'STANDARD' THEN 'mid' WHEN 'MEDIUM' THEN 'mid' WHEN 'LARGE' THEN 'big'"


@query("P07_map_closed_set", f"SELECT p_partkey, {_KINDS_SQL} ELSE 'other' END AS kind FROM part")
def _(t):
    return resolve.map_closed_set(t.part.withColumn("raw", F.concat(F.lit(" "), F.lower("p_type"))), "raw", KINDS, "kind", "other").select("p_partkey", "kind")


@query("P08_map_enum", f"SELECT p_partkey, {_KINDS_SQL} END AS kind FROM part")
def _(t):
    return resolve.map_closed_set(t.part, "p_type", KINDS, "kind").select("p_partkey", "kind")


@query("P09_classify_tags", "SELECT p_partkey, CASE WHEN p_type IN ('LARGE', 'PROMO') THEN 'civic' WHEN p_size > 30 THEN 'sport' WHEN contains(p_name, 'ring') THEN 'park' END AS category FROM part")
def _(t):
    tags = F.create_map(F.lit("amenity"), F.col("p_type"), F.lit("name"), F.col("p_name"))
    rules = [("civic", tags["amenity"].isin("LARGE", "PROMO")), ("sport", F.col("p_size") > 30), ("park", F.contains(tags["name"], F.lit("ring")))]
    return t.part.select("p_partkey", resolve.rule_label(rules).alias("category"))


@query("P10_classify_amenity", "SELECT p_partkey, CASE WHEN p_type IN ('SMALL', 'LARGE') THEN lower(p_type) WHEN p_size < 10 THEN concat('shop_', split_part(p_name, ' ', 2)) END AS amenity FROM part")
def _(t):
    return t.part.select("p_partkey", resolve.amenity(F.col("p_type"), ["SMALL", "LARGE"], F.when(F.col("p_size") < 10, F.split_part("p_name", F.lit(" "), F.lit(2)))).alias("amenity"))


@query("P11_group_status", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'closed' ELSE 'unknown' END AS status FROM orders")
def _(t):
    st = F.upper(F.trim("o_orderstatus"))
    return t.orders.select("o_orderkey", F.coalesce(resolve.rule_label([("active", st.isin("O", "OPEN")), ("closed", st.isin("F", "CLOSED"))]), F.lit("unknown")).alias("status"))


@query("P12_filter_suffix", "SELECT c_custkey FROM customer WHERE c_name LIKE '%7'")
def _(t):
    return t.customer.where(resolve.has_suffix(F.col("c_name"), "7")).select("c_custkey")


@query("P13_status_not_substrings", "SELECT p_partkey, CASE p_type WHEN 'LARGE' THEN 3 ELSE 1 END AS severity FROM part WHERE p_type IN ('LARGE', 'SMALL') AND NOT regexp_matches(lower(p_name), 'ring|bolt')")
def _(t):
    p = t.part.where(F.col("p_type").isin("LARGE", "SMALL") & ~F.lower("p_name").rlike("ring|bolt"))
    return p.select("p_partkey", keys.lookup({"LARGE": "3", "SMALL": "1"}, F.col("p_type")).cast("int").alias("severity"))


@query("P14_filter_type_since", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate::DATE >= DATE '1999-06-01'")
def _(t):
    return t.orders.where(resolve.type_since(F.col("o_orderpriority"), "1-URGENT", F.col("o_orderdate"), dt.date(1999, 6, 1))).select("o_orderkey")


@query("P15_permit_relevance", """SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN 'missing' WHEN p_type = 'PROMO' THEN 'category' WHEN p_size % 5 = 0 THEN 'no units' WHEN p_retailprice > 1700 THEN 'value' END AS skip_reason FROM part""")
def _(t):
    why = resolve.waterfall([
        ("missing", F.when(F.col("p_size") % 11 == 0, F.lit(None)).otherwise(F.col("p_name")).isNull()), ("category", F.col("p_type") == "PROMO"),
        ("no units", F.col("p_size") % 5 <= 0), ("value", ~F.col("p_retailprice").between(0.01, 1700.0))])
    return t.part.select("p_partkey", why.alias("skip_reason"))


# Lots: one for each part, with a size, a coverage, a height and a distance to transit that follow from its columns.
LOT = """SELECT p_partkey AS lot_id, p_brand AS street, p_partkey % 500 AS number, p_type AS kind, cast(p_size * 17.5 as double) AS lot_m2, cast(p_partkey % 7 as double) * 2.5 AS height_m,
cast(p_partkey % 83 as double) / 100.0 AS coverage, cast(p_partkey % 1700 as double) AS transit_m, p_retailprice AS value, cast(p_partkey % 9 as int) AS units,
case when p_partkey % 23 = 0 then 'part_iv' when p_partkey % 19 = 0 then 'listed' end AS heritage, p_partkey % 31 = 0 AS regulated, cast(p_partkey % 25 as int) AS nb,
p_partkey % 37 <> 0 AS residential, p_partkey % 3 = 0 AS abuts_lane, cast(p_partkey % 29 as double) AS to_street_m, p_partkey % 41 = 0 AS suspect, cast(case when p_partkey % 6 = 1 then 1 else 0 end as int) AS recent_permits, p_partkey % 43 = 0 AS drift,
cast(p_partkey % 4 as int) AS address_points, cast(p_partkey % 13 as int) AS units_approx, case p_partkey % 5 when 0 then 'vacant' when 3 then 'semi' when 4 then 'row' else 'detached' end AS structure_type,
case p_partkey % 7 when 0 then 'permit' when 1 then 'osm' when 2 then 'address_points' else 'classifier' end AS structure_source FROM part"""
LOT_CTE = "WITH lots AS (" + LOT.replace("as double)", "AS DOUBLE)").replace("/ 100.0", "/ 100.0::DOUBLE").replace("* 2.5", "* 2.5::DOUBLE").replace("p_size * 17.5", "p_size * 17.5::DOUBLE") + ") "


def lots(t):
    text = LOT.replace("/ 100.0", "/ 100.0D").replace("* 2.5", "* 2.5D").replace("p_size * 17.5", "p_size * 17.5D")
    return t.spark.sql(text.replace("FROM part", "FROM {part}"), part=t.part)


@query("P16_eligible_gate", LOT_CTE + "SELECT lot_id, kind <> 'PROMO' AND coalesce(heritage, '') <> 'part_iv' AND transit_m < 1500 AND lot_m2 >= 100 AS eligible FROM lots")
def _(t):
    return lots(t).select("lot_id", parcels.eligible(F.col("kind") != "PROMO", F.col("heritage"), F.col("transit_m"), F.col("lot_m2")).alias("eligible"))


@query("P17_skip_reason_waterfall", LOT_CTE + """SELECT lot_id, CASE WHEN nb = 3 THEN 'no_nb' WHEN kind = 'PROMO' THEN 'institutional' WHEN transit_m < 40 THEN 'station' WHEN lot_id % 13 = 0 THEN 'landuse' WHEN lot_id % 29 = 0 THEN 'tax'
WHEN height_m > 14 THEN 'tall' WHEN height_m > 5 AND lot_m2 * coverage * greatest(round_even(height_m / 3, 0), 1) / lot_m2 > 3 * 0.6::DOUBLE THEN 'fsi' WHEN NOT (coalesce(heritage, '') <> 'part_iv' AND transit_m < 1500 AND lot_m2 >= 100) THEN 'not_eligible' WHEN units = 0 THEN 'non_buildable' END AS skip_reason FROM lots""")
def _(t):
    df = lots(t)
    gates = [
        ("no_nb", F.col("nb") == 3), ("institutional", F.col("kind") == "PROMO"), ("station", F.col("transit_m") < 40), ("landuse", F.col("lot_id") % 13 == 0), ("tax", F.col("lot_id") % 29 == 0),
        ("tall", F.col("height_m") > 14), ("fsi", parcels.implied_fsi_too_high(F.col("lot_m2") * F.col("coverage"), F.col("height_m"), F.col("lot_m2"), F.lit(0.6))),
        ("not_eligible", ~parcels.eligible(F.lit(True), F.col("heritage"), F.col("transit_m"), F.col("lot_m2"))), ("non_buildable", F.col("units") == 0)]
    return df.select("lot_id", resolve.waterfall(gates).alias("skip_reason"))


@query("P18_implied_fsi_gate", LOT_CTE + "SELECT lot_id, height_m > 5 AND lot_m2 * coverage * greatest(round_even(height_m / 3, 0), 1) / lot_m2 > 3 * 0.5::DOUBLE AS too_high FROM lots")
def _(t):
    return lots(t).select("lot_id", parcels.implied_fsi_too_high(F.col("lot_m2") * F.col("coverage"), F.col("height_m"), F.col("lot_m2"), F.lit(0.5)).alias("too_high"))


_RES = "lot_m2 <= 5000 AND CASE WHEN kind = 'SMALL' THEN lot_m2 <= 2000 ELSE (coverage > 0.05) = (height_m > 0) END"


@query("P19_positive_residential_gate", LOT_CTE + f"SELECT lot_id, {_RES} AS residential FROM lots")
def _(t):
    return lots(t).select("lot_id", parcels.positive_residential(F.col("lot_m2"), F.col("kind") == "SMALL", F.col("coverage"), F.col("height_m")).alias("residential"))


_WEALTH = "nb IN (4, 9) OR (lot_m2 > 700 AND coverage < 0.15 AND height_m > 0) OR (lot_m2 * coverage >= 400 AND nb * 100000 >= 1000000) OR coalesce(value, 0) > 1850 OR (street = 'Brand#7' AND nb < 12)"


@query("P20_wealth_gates", LOT_CTE + f"SELECT lot_id FROM lots WHERE NOT ({_WEALTH})")
def _(t):
    listed = t.spark.createDataFrame([("Brand#7", i) for i in range(12)], "street string, nb int")
    return parcels.wealth_gate(lots(t), listed, enclaves=[4, 9], estate_lot=700, mansion_floor=400, max_value=1850).select("lot_id")


_SHARED = f"heritage IS NULL AND NOT regulated AND kind NOT IN ('LARGE') AND lot_m2 * coverage < 500 AND NOT (lot_m2 * coverage > 0 AND lot_m2 * coverage < 30) AND number > 0 AND NOT ({_WEALTH})"
_ELITE = """lot_m2 >= 250 AND units >= 4 AND transit_m <= 500 AND residential AND NOT (abuts_lane AND to_street_m >= 15) AND NOT suspect AND recent_permits < 1 AND NOT drift
AND NOT (height_m >= 14 AND coverage >= 0.25 AND units_approx >= 10 AND units_approx - address_points >= 5) AND NOT (structure_type <> 'vacant' AND height_m > 0 AND greatest(round_even(height_m / 3, 0), 1) >= 4)
AND (structure_type = 'vacant' OR (structure_type = 'detached' AND (structure_source IN ('permit', 'osm', 'address_points') OR (structure_source = 'classifier' AND address_points = 1))))"""
_BROAD = "lot_m2 >= 200 AND units >= 3 AND transit_m <= 1500 AND kind IN ('SMALL', 'MEDIUM', 'STANDARD')"


def shared_lots(t):
    listed = t.spark.createDataFrame([("Brand#7", i) for i in range(12)], "street string, nb int")
    df = lots(t).withColumn("footprint", F.col("lot_m2") * F.col("coverage"))
    return parcels.wealth_gate(df.where(parcels.shared_gate()), listed, enclaves=[4, 9], estate_lot=700, mansion_floor=400, max_value=1850)


@query("P21_shared_gate", LOT_CTE + f"SELECT lot_id FROM lots WHERE {_SHARED}")
def _(t):
    return shared_lots(t).select("lot_id")


@query("P22_elite_gate", LOT_CTE + f"SELECT lot_id FROM lots WHERE {_SHARED} AND {_ELITE}")
def _(t):
    return shared_lots(t).where(parcels.elite_gate()).select("lot_id")


@query("P23_broader_gate", LOT_CTE + f"SELECT lot_id FROM lots WHERE {_SHARED} AND {_BROAD}")
def _(t):
    return shared_lots(t).where(parcels.broader_gate(["SMALL", "MEDIUM", "STANDARD"])).select("lot_id")


@query("P24_flatten_feature", LOT_CTE + "SELECT lot_id, units, coalesce(heritage, 'none') AS heritage, coverage, height_m FROM lots")
def _(t):
    nested = lots(t).select(F.struct("lot_id", "units", "heritage", F.struct("coverage", "height_m").alias("shape")).alias("properties"))
    return parcels.flatten(nested, {"lot_id": "properties.lot_id", "units": "properties.units", "heritage": "properties.heritage", "coverage": "properties.shape.coverage", "height_m": "properties.shape.height_m"}, {"heritage": "none"})


@query("P25_presets_and_search", "SELECT p_partkey FROM part WHERE p_size > 20 AND (contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring'))")
def _(t):
    return t.part.where(parcels.search(["p_name", "p_brand"], "Ring") & (F.col("p_size") > 20)).select("p_partkey")


@query("P26_weak_match_drop", "SELECT event_id FROM events WHERE NOT (event_id % 2 = 0 AND event_id % 3 = 0 AND event_id % 5 = 0 AND event_type = 'view') AND NOT (event_id % 2 = 0 AND event_id % 5 = 0)")
def _(t):
    no_match, no_link, no_site = F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0, F.col("event_id") % 5 == 0
    return t.events.where(~resolve.weak_match(no_match, no_link, no_site, F.col("event_type"), "view")).select("event_id")


@query("P27_suspect_flags", LOT_CTE + "SELECT lot_id, (height_m > 10 AND coverage < 0.2) OR (height_m >= 9 AND coverage < 0.25 AND (abs(height_m - lot_id % 11) <= 0.1 OR abs(height_m - lot_id % 13) <= 0.1)) AS suspect FROM lots")
def _(t):
    around = F.array((F.col("lot_id") % 11).cast("double"), (F.col("lot_id") % 13).cast("double"))
    return lots(t).select("lot_id", parcels.suspect(F.col("height_m"), F.col("coverage"), around, tall=10, low=0.2).alias("suspect"))


@query("P28_generic_name_and_conflict", "SELECT p_partkey, regexp_matches(p_name, '\\b(red|hot)\\b') AND p_type = 'PROMO' AS generic, lower(p_type) <> split_part(p_name, ' ', 1) AND p_size % 2 = 0 AS conflict FROM part")
def _(t):
    other = t.part.where("p_size % 2 = 0").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("other"))
    df = resolve.generic_and_conflict(t.part, other, "p_partkey", F.col("p_name"), F.lower("p_type"), ["red", "hot"], F.col("p_type") == "PROMO")
    return df.select("p_partkey", "generic", "conflict")


@query("P29_rewrite_labels", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN a = 'red' THEN 'warm' WHEN a = 'hot' THEN 'warm' WHEN a = 'small' THEN 'drop' ELSE a END, b], lambda x: x <> 'drop'), ',') AS labels FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)")
def _(t):
    labels = F.split("p_name", " ")
    first = F.element_at(labels, 1)
    return t.part.select("p_partkey", F.array_join(resolve.rewrite_labels(F.array(first, first, F.element_at(labels, 2)), {"red": "warm", "hot": "warm", "small": "drop"}), ",").alias("labels"))


@query("P30_target_selectors", "SELECT event_id FROM events WHERE event_type IN ('view', 'error') AND event_id NOT IN (SELECT event_id FROM events WHERE value > 50) AND user_id IN (SELECT user_id FROM events WHERE event_type = 'signup')")
def _(t):
    e = t.events
    return resolve.select_targets(e, e.where("value > 50"), "event_id", e.where("event_type = 'signup'"), "user_id", F.col("event_type").isin("view", "error")).select("event_id")
