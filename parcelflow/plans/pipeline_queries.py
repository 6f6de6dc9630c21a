"""The composed pipelines over the driver's tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import geo, keys
from ..operators import aggregates as agg
from ..operators import feeds
from ..sources import sources
from ..streaming import state
from . import pipelines
from . import standins as s
from .filter_queries import _BROAD, _ELITE, _SHARED, LOT_CTE, lots
from .join_queries import cust, feed
from .registry import query
from .source_queries import scratch
from .spatial_queries import CTE, STREETS, _gap_sql, _side_sql, boxes, points, segments, stops, streets
from .state_queries import NOW, _state, _verdicts, last_table

E = F.expr
RULES = [("fast", ["URGENT", "HIGH"]), ("slow", ["LOW"]), ("plain", ["MEDIUM"])]
CATEGORIES = ["BUILDING", "MACHINERY", "HOUSEHOLD"]


def licences(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return o.select(
        F.col("o_orderkey").alias("id"), F.concat_ws(" ", "c_name", "o_orderpriority").alias("name"), F.col("c_mktsegment").alias("category"), F.col("o_orderdate").cast("date").alias("issued"),
        E(s.CANCEL).alias("cancelled"), E(s.ADDRESS).alias("address"), E(s.POSTAL).alias("postal"), F.when(F.col("c_custkey") % 7 == 0, F.lit("http://own.example")).alias("website"), "c_custkey")


def once(t, df):
    """The rows written to a shared folder and read from there, for plans that use them several times."""
    path = scratch(t)
    df.write.parquet(path)
    return t.spark.read.schema(df.schema).parquet(path)


def the_feed(t):
    brands = t.customer.where("c_custkey % 50 = 0").select(F.upper(F.concat_ws(" ", "c_name", F.lit("5-LOW"))).alias("brand"))
    # What the web and the places know of every business: one row for each name and address.
    known = once(t, licences(t).select("c_custkey", keys.entity_key(F.col("name"), F.col("address")).alias("key")).distinct())
    k = F.col("c_custkey")
    site = lambda host: F.concat(F.lit(f"http://{host}/"), k.cast("string"))
    verdicts = known.where("c_custkey % 4 = 0").select("key", F.array(F.when(k % 8 == 0, "fast").otherwise("nonsense")).alias("labels"), F.lit("ok").alias("status"), F.when(k % 3 == 1, "no").otherwise("yes").alias("operating"))
    places = known.where("c_custkey % 5 IN (0, 1)").select("key", F.when(k % 5 == 0, "OPERATIONAL").otherwise("CLOSED").alias("status"), site("p").alias("site"))
    web = known.where("c_custkey % 3 = 0").select("key", site("v").alias("site"))
    bad = t.customer.where("c_custkey % 20 = 0").select(site("p").alias("site"))
    return pipelines.openings_feed(licences(t), CATEGORIES, s.AS_OF, RULES, brands, verdicts, places, web, bad)


_FEED = f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY c_custkey, name ORDER BY issued, id) AS rn FROM (
SELECT o_orderkey AS id, c_custkey, concat_ws(' ', c_name, o_orderpriority) AS name, o_orderpriority AS pr, o_orderdate::DATE AS issued, {s.CANCEL} AS c, {s.POSTAL} AS postal, c_mktsegment AS seg FROM orders JOIN customer ON o_custkey = c_custkey)
WHERE seg IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AND issued BETWEEN {s.AS_OF_SQL} - 365 AND {s.AS_OF_SQL} AND (c IS NULL OR date_diff('day', c, {s.AS_OF_SQL}) <= 10) AND NOT (c_custkey % 50 = 0 AND pr = '5-LOW')),
m AS (SELECT *, CASE WHEN c_custkey % 8 = 0 AND c_custkey % 3 <> 1 THEN 'fast' WHEN pr IN ('1-URGENT', '2-HIGH') THEN 'fast' WHEN pr = '5-LOW' THEN 'slow' WHEN pr = '3-MEDIUM' THEN 'plain' END AS label,
CASE WHEN c_custkey % 8 = 0 AND c_custkey % 3 <> 1 THEN 'web' ELSE 'name' END AS label_source, CASE WHEN c_custkey % 5 = 0 THEN 'places' WHEN c_custkey % 3 = 0 THEN 'web' END AS via,
coalesce(CASE WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 20 <> 0 THEN 'http://p/' || c_custkey END WHEN c_custkey % 3 = 0 THEN 'http://v/' || c_custkey END, CASE WHEN c_custkey % 7 = 0 THEN 'http://own.example' END) AS site FROM f WHERE rn = 1 AND c_custkey % 5 <> 1),
feed AS (SELECT id, label, label_source, via, site, issued, (MAP {{{', '.join(f"'{k}': '{v}'" for k, v in keys.DISTRICTS.items())}}})[substr(postal, 1, 2)] AS district, date_diff('day', issued, {s.AS_OF_SQL})::INT AS days_open, CASE WHEN site IS NULL THEN 4 ELSE 1 END AS tier FROM m WHERE label IS NOT NULL AND NOT (via IS NULL AND site IS NULL))
"""


@query("C01_openings_feed", _FEED + "SELECT * FROM feed")
def _(t):
    return the_feed(t).select("id", "label", "label_source", "via", "site", "issued", "district", "days_open", "tier")


_INDEX = _FEED + "SELECT label, count(*) AS n365, count(*) FILTER (days_open <= 30)::BIGINT AS n30, max(issued) AS newest, (SELECT string_agg(id::VARCHAR, ',' ORDER BY rn) FROM (SELECT id, label AS l2, row_number() OVER (PARTITION BY label ORDER BY issued DESC, id) AS rn FROM feed) WHERE rn <= 3 AND l2 = label) AS newest_ids FROM feed GROUP BY label"


@query("openings_index", _INDEX)
def _(t):
    return pipelines.openings_index(once(t, the_feed(t)), s.AS_OF)


@query("C02_openings_tables", _FEED + """SELECT 'count' AS part, label, district, count(*) AS n, count(*) FILTER (days_open <= 30)::BIGINT AS n30 FROM feed GROUP BY CUBE (label, district)
UNION ALL (SELECT 'newest', label, district, row_number() OVER (ORDER BY issued DESC, id), 0 FROM feed ORDER BY issued DESC, id LIMIT 20)
UNION ALL SELECT 'dimension', key, NULL, 0, seeded::INT FROM (VALUES ('fast', true), ('plain', false), ('other', true), ('gone', false)) AS k(key, seeded) WHERE seeded OR key IN (SELECT label FROM feed)
UNION ALL SELECT 'gap', label, NULL, count(*), 0 FROM feed WHERE label NOT IN ('fast', 'plain', 'other', 'gone') GROUP BY label""")
def _(t):
    known = t.spark.createDataFrame([("fast", True), ("plain", False), ("other", True), ("gone", False)], "key string, seeded boolean")
    return pipelines.openings_tables(the_feed(t), known)


_SCALED = "CASE WHEN {c} IS NULL OR max({c}) OVER () = min({c}) OVER () THEN 50 ELSE {i} END"


def _scaled_sql(c: str, invert: bool = False) -> str:
    x = f"round_even(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 100, 1)"
    return _SCALED.format(c=c, i=f"100 - {x}" if invert else x)


@query("C03_area_dataset", CTE + f""", g AS (SELECT box.n AS area, count(k) AS n, coalesce(sum(v), 0) AS total, count(*) FILTER (v < 0) AS low FROM box LEFT JOIN pip ON pip.n = box.n GROUP BY 1), r AS (SELECT area, n, n::DOUBLE AS m, total, round_even(low * 100.0::DOUBLE / greatest(n, 1), 4) AS low_rate, total / nullif(n, 0) AS mean FROM g),
w AS (SELECT *, ({_scaled_sql('low_rate')} * 0.5::DOUBLE + {_scaled_sql('m', True)} * 0.3::DOUBLE + {_scaled_sql('mean')} * 0.2::DOUBLE)::VARCHAR::DECIMAL(24, 16) * 10 AS tenths FROM r),
i AS (SELECT *, (CASE WHEN tenths - floor(tenths) > 0.5 OR (tenths - floor(tenths) = 0.5 AND floor(tenths)::BIGINT % 2 = 1) THEN floor(tenths) + 1 ELSE floor(tenths) END)::DOUBLE / 10 AS risk FROM w)
SELECT area, n, round(total, 2) AS total, low_rate, risk, row_number() OVER (ORDER BY risk DESC, area)::INTEGER AS rank_risk FROM i""")
def _(t):
    areas = boxes(t).withColumnRenamed("n", "area")
    return pipelines.area_dataset(areas, points(t), "shape").select("area", "n", F.round("total", 2).alias("total"), "low_rate", "risk", "rank_risk")


_LABELLED = f"SELECT o_orderkey AS id, concat_ws(' ', c_name, o_orderpriority) AS name, o_orderdate::DATE AS d, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'fast' WHEN o_orderpriority = '5-LOW' THEN 'slow' WHEN o_orderpriority = '3-MEDIUM' THEN 'plain' END AS label, {s.CANCEL} AS c FROM orders JOIN customer ON o_custkey = c_custkey"


@query("C04_closures", f"""WITH l AS (SELECT * FROM ({_LABELLED}) WHERE label IS NOT NULL) SELECT 'index' AS part, label, NULL::BIGINT AS id, count(*) FILTER (c IS NULL)::BIGINT AS active, count(*) FILTER (c > {s.AS_OF_SQL} - 90 AND c <= {s.AS_OF_SQL})::BIGINT AS closed90, count(*) FILTER (c > {s.AS_OF_SQL} - 365 AND c <= {s.AS_OF_SQL})::BIGINT AS closed365, round_even(count(*) FILTER (c > {s.AS_OF_SQL} - 365 AND c <= {s.AS_OF_SQL}) * 100.0::DOUBLE / count(*) FILTER (c IS NULL), 6) AS rate FROM l GROUP BY label
UNION ALL (SELECT 'longest', label, id, days, NULL, NULL, NULL FROM (SELECT *, date_diff('day', d, {s.AS_OF_SQL}) AS days, row_number() OVER (PARTITION BY name ORDER BY d, id) AS rn FROM l WHERE c IS NULL OR date_diff('day', c, {s.AS_OF_SQL}) <= 10) WHERE rn = 1 ORDER BY days DESC, id LIMIT 10)""")
def _(t):
    return pipelines.closures(licences(t), RULES, s.AS_OF)


def _lots_xy(t):
    return lots(t).withColumns({"x": E(s.lon("lot_id")), "y": E(s.lat("lot_id"))})


_PARCEL = LOT_CTE.rstrip() + ", " + CTE[5:].rstrip() + f""", l AS (SELECT *, {s.lon('lot_id')} AS lx, {s.lat('lot_id')} AS ly FROM lots), hav AS (SELECT lot_id, s, 2 * 6371008.8::DOUBLE * asin(sqrt(pow(sin(radians(sy - ly) / 2), 2) + cos(radians(ly)) * cos(radians(sy)) * pow(sin(radians(sx - lx) / 2), 2))) AS d FROM l, sp),
stop AS (SELECT lot_id, least(min(d), 5000) AS stop_m, count(*) FILTER (d <= 250) AS near FROM hav GROUP BY 1), hood AS (SELECT lot_id, min(n) AS area FROM l JOIN box ON lx >= x0 AND lx < x0 + 0.07::DOUBLE AND ly >= y0 AND ly < y0 + 0.05::DOUBLE GROUP BY 1),
feat AS (SELECT l.*, area, stop_m, near, CASE WHEN area IS NULL THEN 'no_area' WHEN height_m > 14 THEN 'tall' WHEN NOT (kind <> 'PROMO' AND coalesce(heritage, '') <> 'part_iv' AND stop_m < 1500 AND lot_m2 >= 100) THEN 'not_eligible' WHEN units = 0 THEN 'non_buildable' END AS skip_reason FROM l LEFT JOIN hood USING (lot_id) JOIN stop USING (lot_id)) """


def features(t):
    st = stops(t)
    return pipelines.parcel_features(_lots_xy(t), boxes(t).withColumnRenamed("n", "area"), st.withColumnRenamed("s", "stop_id"), st.select(F.col("sx").alias("px"), F.col("sy").alias("py")))


@query("C05_parcel_features", _PARCEL + "SELECT lot_id, area, round(stop_m, 2) AS stop_m, near AS near_permits, skip_reason FROM feat")
def _(t):
    return features(t).select("lot_id", "area", F.round("stop_m", 2).alias("stop_m"), "near_permits", "skip_reason")


# Lots as boxes of three widths, a building at every customer's point, streets between neighbouring suppliers.
_W = "(0.001::DOUBLE + (lot_id % 3) * 0.0004::DOUBLE)"
_AROUND = LOT_CTE.rstrip() + ", " + CTE[5:].rstrip() + f""", l AS (SELECT lot_id, {s.lon('lot_id')} AS x, {s.lat('lot_id')} AS y, {_W} AS w FROM lots),
side AS (SELECT lot_id, x AS px, y AS py, x + w AS qx, y AS qy FROM l UNION ALL SELECT lot_id, x + w, y, x + w, y + 0.0009::DOUBLE FROM l UNION ALL SELECT lot_id, x + w, y + 0.0009::DOUBLE, x, y + 0.0009::DOUBLE FROM l UNION ALL SELECT lot_id, x, y + 0.0009::DOUBLE, x, y FROM l),
eg AS (SELECT lot_id, s, min(CASE WHEN {_side_sql('px', 'py', 'qx', 'qy', 'ax', 'ay')} * {_side_sql('px', 'py', 'qx', 'qy', 'ex', 'ey')} < 0 AND {_side_sql('ax', 'ay', 'ex', 'ey', 'px', 'py')} * {_side_sql('ax', 'ay', 'ex', 'ey', 'qx', 'qy')} < 0 THEN 0
    ELSE least({_gap_sql('px', 'py', 'ax', 'ay', 'ex', 'ey')}, {_gap_sql('qx', 'qy', 'ax', 'ay', 'ex', 'ey')}, {_gap_sql('ax', 'ay', 'px', 'py', 'qx', 'qy')}, {_gap_sql('ex', 'ey', 'px', 'py', 'qx', 'qy')}) END) AS d FROM side, seg GROUP BY ALL),
touch AS (SELECT lot_id, count(DISTINCT s % 12) FILTER (d <= 0.002 AND s % 4 <> 0) >= 2 AS corner, count(*) FILTER (d <= 0.002 AND s % 4 = 0) > 0 AS lane FROM eg GROUP BY 1),
way AS (SELECT lot_id, min({_gap_sql('x', 'y', 'ax', 'ay', 'ex', 'ey')}) AS d FROM l, seg WHERE s % 4 <> 0 GROUP BY 1),
r AS (SELECT lot_id, greatest(pt.x, l.x) AS a, least(pt.x + 0.0006::DOUBLE, l.x + w) AS b, greatest(pt.y, l.y) AS c, least(pt.y + 0.0005::DOUBLE, l.y + 0.0009::DOUBLE) AS d FROM l JOIN pt ON pt.x + 0.0006::DOUBLE > l.x AND pt.x < l.x + w AND pt.y + 0.0005::DOUBLE > l.y AND pt.y < l.y + 0.0009::DOUBLE),
xs AS (SELECT lot_id, v AS xa, lead(v) OVER (PARTITION BY lot_id ORDER BY v) AS xb FROM (SELECT lot_id, a AS v FROM r UNION SELECT lot_id, b FROM r)),
ys AS (SELECT lot_id, v AS ya, lead(v) OVER (PARTITION BY lot_id ORDER BY v) AS yb FROM (SELECT lot_id, c AS v FROM r UNION SELECT lot_id, d FROM r)),
u AS (SELECT xs.lot_id, sum((xb - xa) * (yb - ya)) AS area FROM xs JOIN ys ON xs.lot_id = ys.lot_id WHERE EXISTS (SELECT 1 FROM r WHERE r.lot_id = xs.lot_id AND a <= xa AND b >= xb AND c <= ya AND d >= yb) GROUP BY 1),
inside AS (SELECT lot_id, count(*) AS points, count(DISTINCT k // 2) AS addresses FROM l JOIN (SELECT k, pt.x + 0.0003::DOUBLE AS px, pt.y + 0.0003::DOUBLE AS py FROM pt) ON px >= l.x AND px < l.x + w AND py >= l.y AND py < l.y + 0.0009::DOUBLE GROUP BY 1)
SELECT lot_id, corner, lane, round(CASE WHEN way.d <= 0.02 THEN way.d * 95000 ELSE 99999 END, 3) AS street_m, round(greatest(w, 0.0009::DOUBLE) / least(w, 0.0009::DOUBLE), 6) AS aspect, round(coalesce(area, 0) / (w * 0.0009::DOUBLE), 6) AS coverage,
round(1 - coalesce(area, 0) / (w * 0.0009::DOUBLE), 6) AS bare, coalesce(points, 0)::BIGINT AS points, coalesce(addresses, 0)::BIGINT AS addresses FROM l JOIN touch USING (lot_id) JOIN way USING (lot_id) LEFT JOIN u USING (lot_id) LEFT JOIN inside USING (lot_id)"""


@query("C05_parcel_surroundings", _AROUND)
def _(t):
    ring = lambda x, y, w, h: F.array(geo.points([(x, y), (x + w, y), (x + w, y + h), (x, y + h)]))
    l = _lots_xy(t).select("lot_id", "x", "y", ring(F.col("x"), F.col("y"), F.lit(0.001) + (F.col("lot_id") % 3) * F.lit(0.0004), F.lit(0.0009)).alias("shape"))
    p = points(t)
    ways = segments(t).select("line", (F.col("s") % 12).alias("name"), (F.col("s") % 4 == 0).alias("is_lane"))
    addresses = p.select((F.col("x") + F.lit(0.0003)).alias("x"), (F.col("y") + F.lit(0.0003)).alias("y"), F.floor(F.col("k") / 2).alias("address"))
    r = pipelines.parcel_surroundings(l, ways, p.select(ring(F.col("x"), F.col("y"), F.lit(0.0006), F.lit(0.0005)).alias("footprint")), addresses, 0.002)
    return r.select("lot_id", "corner", "lane", F.round("street_m", 3).alias("street_m"), *[F.round(c, 6).alias(c) for c in ("aspect", "coverage", "bare")], "points", "addresses")


@query("C06_parcel_stats", _PARCEL + """SELECT 'funnel' AS part, coalesce(skip_reason, 'kept') AS name, count(*) AS n, round(median(value), 4) AS value FROM feat GROUP BY 2 UNION ALL SELECT 'cost', kind, count(value / lot_m2), round(CASE WHEN count(value / lot_m2) >= 5 THEN median(value / lot_m2) END, 4) FROM feat GROUP BY 2
UNION ALL SELECT 'unjoined', 'permits', count(*), NULL FROM feat WHERE lot_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 30) UNION ALL (SELECT 'largest', lot_id::VARCHAR, 1, round(lot_m2, 4) FROM feat ORDER BY lot_m2 DESC, lot_id LIMIT 10)""")
def _(t):
    permits = t.lineitem.where("l_quantity > 30").select(F.col("l_partkey").alias("lot_id"))
    return pipelines.parcel_stats(once(t, features(t)), permits).withColumn("value", F.round("value", 4))


def _tiers(t):
    return pipelines.tiers(lots(t), t.spark.createDataFrame([("Brand#7", i) for i in range(12)], "street string, nb int"))


@query("C07_tiers", LOT_CTE + f"SELECT CASE WHEN {_ELITE} THEN 'elite' ELSE 'broader' END AS tier, count(*) AS n, min(lot_id) AS first_lot FROM lots WHERE {_SHARED} AND (({_ELITE}) OR ({_BROAD})) GROUP BY 1")
def _(t):
    return _tiers(t).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.min("lot_id").alias("first_lot"))


_SIGNAL = "WITH e AS (SELECT o_orderkey AS event_id, o_custkey AS builder, o_custkey AS ck, o_orderdate AS d, o_orderstatus AS kind FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderdate::DATE >= DATE '1999-01-01'), b AS (SELECT builder, CASE WHEN count(*) = 1 THEN '1' WHEN count(*) <= 3 THEN '2-3' ELSE '4+' END AS bucket FROM e GROUP BY 1) "


def _signals(t):
    ev = feed(t).join(t.orders.select(F.col("o_orderkey").alias("ok"), F.col("o_custkey").alias("builder")), "ok")
    ev = ev.select(F.col("ok").alias("event_id"), F.col("d").alias("at"), F.col("st").alias("kind"), "builder", "addr_norm")
    return pipelines.signals(cust(t).withColumnRenamed("k", "parcel_id"), ev, ["F", "O"], dt.date(1999, 1, 1))


@query("C08_signals", _SIGNAL + "SELECT c_custkey AS parcel_id, kind, arg_max(event_id, [epoch(d)::BIGINT, event_id]) AS event_id, arg_max(bucket, [epoch(d)::BIGINT, event_id]) AS bucket, count(*) - 1 AS extra FROM e JOIN customer ON ck = c_custkey JOIN b USING (builder) GROUP BY ALL")
def _(t):
    return _signals(t)[0].select("parcel_id", "kind", "event_id", "bucket", "extra")


@query("C08_signal_stats", _SIGNAL + "SELECT kind, count(*) AS total, count(c_custkey) AS matched, count(*) - count(c_custkey) AS unmatched, count(DISTINCT c_custkey) AS parcels FROM e LEFT JOIN customer ON ck = c_custkey GROUP BY kind")
def _(t):
    return _signals(t)[1]


@query("C08_overlay_signals", """WITH a AS (SELECT o_custkey AS k, min(o_orderkey) AS appeal_id FROM orders WHERE o_orderkey::VARCHAR LIKE '%7' GROUP BY 1),
o AS (SELECT o_custkey AS k, o_orderkey AS order_id, CASE o_orderstatus WHEN 'F' THEN 3 ELSE 1 END AS severity, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 3 ELSE 1 END DESC, o_orderkey) AS rn FROM orders WHERE o_orderstatus IN ('F', 'P') AND NOT regexp_matches(lower(o_orderpriority), 'urgent|not'))
SELECT c_custkey AS parcel_id, appeal_id, order_id, severity FROM customer LEFT JOIN a ON a.k = c_custkey LEFT JOIN o ON o.k = c_custkey AND rn = 1 WHERE appeal_id IS NOT NULL OR order_id IS NOT NULL""")
def _(t):
    ev = feed(t)
    appeals = ev.select(F.col("ok").alias("appeal_id"), F.col("ok").cast("string").alias("number"), "addr_norm")
    wanted = ev.select(F.col("ok").alias("order_id"), F.col("st").alias("status"), F.col("pr").alias("text"), "addr_norm")
    return pipelines.overlay_signals(cust(t).withColumnRenamed("k", "parcel_id"), appeals, wanted, "7", {"F": 3, "P": 1}, "urgent|not")


_P95 = "least(greatest(round_even({0} * 100 / (SELECT v FROM (SELECT {0} AS v, row_number() OVER (ORDER BY {0}) AS rn, count(*) OVER () AS n FROM {1} WHERE {0} > 0) WHERE rn = floor(0.95 * (n - 1)) + 1), 1), 0), 100)"
_SCORES = STREETS.rstrip() + ", " + LOT_CTE[5:].rstrip() + f""", area AS (SELECT n AS area, x0, y0, (n % 5 + 1)::DOUBLE AS km2 FROM box),
p75 AS (SELECT c_acctbal AS v FROM (SELECT c_acctbal, row_number() OVER (ORDER BY c_acctbal) AS rn, count(*) OVER () AS n FROM customer) WHERE rn = floor(0.75 * (n - 1)) + 1),
solar AS (SELECT c_nationkey AS area, avg((c_acctbal >= v)::INT) * 100 AS solar FROM customer, p75 GROUP BY 1),
canopy AS (SELECT nb AS area, round(coalesce(sum(lot_m2) FILTER (kind = 'SMALL') * 100 / sum(lot_m2), 30), 6) AS canopy, greatest(coalesce(nullif(sum(CASE kind WHEN 'SMALL' THEN 4 WHEN 'LARGE' THEN 2 ELSE 0 END), 0), 7), sum(units))::BIGINT AS potential, sum(units)::BIGINT AS existing FROM lots GROUP BY nb),
corners AS (SELECT area, count(cx) / max(km2) AS d FROM area LEFT JOIN corner ON (cx + 0.5) * 0.02::DOUBLE >= x0 AND (cx + 0.5) * 0.02::DOUBLE < x0 + 0.07::DOUBLE AND (cy + 0.5) * 0.02::DOUBLE >= y0 AND (cy + 0.5) * 0.02::DOUBLE < y0 + 0.05::DOUBLE GROUP BY area),
stops AS (SELECT area, count(s) / max(km2) AS d FROM area LEFT JOIN sp ON sx >= x0 AND sx < x0 + 0.07::DOUBLE AND sy >= y0 AND sy < y0 + 0.05::DOUBLE GROUP BY area),
brackets AS (SELECT c_nationkey AS area, floor(c_acctbal / 1000)::BIGINT AS b, count(*) AS c FROM customer GROUP BY ALL), run AS (SELECT *, sum(c) OVER (PARTITION BY area ORDER BY b) / sum(c) OVER (PARTITION BY area) AS s FROM brackets),
built AS (SELECT area, min(b) * 1000 + 500 AS built_year FROM run WHERE s >= 0.5 GROUP BY area),
rate AS (SELECT c_nationkey AS area, round(coalesce(sum(n), 0) * 1000.0::DOUBLE / count(*), 6) AS per FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1),
parts AS (SELECT area.area, coalesce(solar, 50) AS solar, coalesce(canopy, 30) AS canopy, coalesce({_P95.format('corners.d', 'corners')}, 0) AS walk, coalesce({_P95.format('length_m', 'ways')}, 0) AS bike, coalesce({_P95.format('stops.d', 'stops')}, 0) AS transit, coalesce(existing, 0) AS existing, coalesce(potential, 0) AS potential, built_year, coalesce(per, 0) AS per
FROM area LEFT JOIN solar USING (area) LEFT JOIN canopy USING (area) LEFT JOIN corners USING (area) LEFT JOIN ways USING (area) LEFT JOIN stops USING (area) LEFT JOIN built USING (area) LEFT JOIN rate USING (area))
SELECT area, walk, round(bike, 1) AS bike, transit, existing, potential, built_year, round(per, 4) AS permits_per_1000, round(least(greatest(solar * 0.2::DOUBLE + least(canopy * 2, 100) * 0.2::DOUBLE + walk * 0.1::DOUBLE + transit * 0.2::DOUBLE + bike * 0.1::DOUBLE + least(greatest(CASE WHEN existing > 0 THEN (potential / existing::DOUBLE - 1) * 50 ELSE 0 END, 0), 100) * 0.2::DOUBLE, 0), 100), 2) AS score FROM parts"""


@query("C09_neighbourhood_score", _SCORES)
def _(t):
    areas = boxes(t).select(F.col("n").alias("area"), "shape", ((F.col("n") % 5) + 1).cast("double").alias("km2"))
    households = t.customer.select(F.col("c_custkey").alias("household"), F.col("c_nationkey").alias("area"), F.col("c_acctbal").alias("v"))
    brackets = households.groupBy("area", F.floor(F.col("v") / 1000).alias("year")).agg(F.count(F.lit(1)).alias("c")).withColumn("mid", F.col("year") * 1000 + 500)
    per_lot = t.spark.createDataFrame([("SMALL", 4), ("LARGE", 2)], "kind string, per_lot int")
    permits = t.orders.where("o_orderdate >= TIMESTAMP '2001-01-01'").select(F.col("o_custkey").alias("household"))
    weights = {"solar": 0.2, "canopy": 0.2, "walk": 0.1, "transit": 0.2, "bike": 0.1, "headroom": 0.2}
    r = pipelines.neighbourhood_scores(
        areas, households.select("area", "v"), streets(t).withColumnRenamed("k", "line"), stops(t).select(F.col("sx").alias("x"), F.col("sy").alias("y")),
        lots(t).withColumnRenamed("nb", "area"), per_lot, brackets, households, permits, weights)
    return r.select("area", "walk", F.round("bike", 1).alias("bike"), "transit", "existing", "potential", "built_year", F.round("permits_per_1000", 4).alias("permits_per_1000"), F.round("score", 2).alias("score"))


@query("C10_usage_rollup", "SELECT user_id % 3 AS provider, event_type AS sku, ts::DATE AS day, round(sum(value * CASE event_type WHEN 'view' THEN 0.017::DOUBLE WHEN 'click' THEN 0.005::DOUBLE ELSE 0 END), 4) AS cost, count(*) AS calls FROM events WHERE event_id % 10 <> 3 GROUP BY GROUPING SETS ((1), (1, 2), (3), ())")
def _(t):
    path = scratch(t)
    line = F.to_json(F.struct("event_id", (F.col("user_id") % 3).alias("provider"), F.col("event_type").alias("sku"), F.col("ts").alias("at"), F.col("value").alias("units")))
    t.events.select(F.when(F.col("event_id") % 10 == 3, F.lit('{"event_id": 1, "sku"')).otherwise(line).alias("value")).write.text(path)
    prices = t.spark.createDataFrame([("view", 0.017), ("click", 0.005)], "sku string, price double")
    return pipelines.usage_rollup(path, t.spark, prices, sources.read_jsonl)


@query("C10_usage_stream", "SELECT ts::DATE AS day, event_type AS sku, round(sum(value * CASE event_type WHEN 'view' THEN 0.017::DOUBLE WHEN 'click' THEN 0.005::DOUBLE ELSE 0 END), 6) AS cost, count(*) AS calls FROM events WHERE event_id % 10 <> 3 GROUP BY ALL")
def _(t):
    path = scratch(t)
    line = F.to_json(F.struct("event_id", F.col("event_type").alias("sku"), F.col("ts").alias("at"), F.col("value").alias("units")))
    t.events.select(F.when(F.col("event_id") % 10 == 3, F.lit('{"event_id": 1, "sku"')).otherwise(line).alias("value")).repartition(4).write.text(path)
    prices = t.spark.createDataFrame([("view", 0.017), ("click", 0.005)], "sku string, price double")
    daily = pipelines.usage_stream(t.spark.readStream.text(path), prices, "60 days")
    return last_table(t, daily).withColumn("cost", F.round("cost", 6))


@query("C11_audits", LOT_CTE + """, found AS (SELECT 'coverage' AS rule, 'CRITICAL' AS severity, 0 AS severity_rank, count(*) FILTER (coverage > 0.8)::BIGINT AS n FROM lots UNION ALL SELECT 'units_need_height', 'HIGH', 1, count(*) FILTER (units > 6 AND height_m = 0) FROM lots
UNION ALL SELECT 'height_range', 'MEDIUM', 2, count(*) FILTER (height_m > 14) FROM lots UNION ALL SELECT 'kind_coupling', 'LOW', 3, count(*) FILTER (kind = 'PROMO' AND units > 0) FROM lots
UNION ALL SELECT 'constant_column', 'MEDIUM', 2, (count(DISTINCT kind) <= 1)::INT + (count(DISTINCT heritage) <= 1)::INT + (count(DISTINCT regulated) <= 1)::INT + (count(DISTINCT units) <= 1)::INT FROM lots
UNION ALL SELECT 'concentration', 'LOW', 3, (max(n) * 100.0 / sum(n) > 10)::INT FROM (SELECT street, count(*) AS n FROM lots GROUP BY 1)
UNION ALL SELECT 'crosscheck', 'CRITICAL', 0, count(*) FILTER (lot_id % 40 = 0 OR lot_id % 45 = 1) FROM lots
UNION ALL SELECT 'only_here', 'HIGH', 1, count(*) FILTER (lot_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)) FROM lots
UNION ALL SELECT 'only_there', 'HIGH', 1, count(DISTINCT l_partkey) FROM lineitem WHERE l_quantity > 45 AND l_partkey NOT IN (SELECT lot_id FROM lots)
UNION ALL SELECT 'regression', 'CRITICAL', 0, count(*) FILTER (lot_id % 97 = 0 OR street = 'Brand#3') FROM lots
UNION ALL SELECT 'missed_truth', 'MEDIUM', 2, count(*) FILTER (units >= 6 AND NOT (""" + f"({_SHARED}) AND (({_ELITE}) OR ({_BROAD})))" + """) FROM lots)
SELECT rule, severity, n, severity_rank FROM found WHERE n > 0""")
def _(t):
    all_lots = lots(t)
    claims = all_lots.select("lot_id", (F.col("value") + F.when(F.col("lot_id") % 40 == 0, 1).otherwise(0)).alias("claim"))
    fresh = all_lots.where("lot_id % 45 != 1").select("lot_id", "value")
    reference = t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("lot_id"))
    bad = all_lots.where("lot_id % 97 = 0").select("lot_id"), t.spark.createDataFrame([("Brand#3",)], "street string")
    truth = all_lots.where("units >= 6").select("lot_id", F.col("kind").alias("grp"))
    return pipelines.audits(all_lots, claims, fresh, reference, *bad, truth, _tiers(t).select("lot_id", "tier"))


_DUE = "date_diff('day', to_timestamp(1700000000 + k * 7000)::TIMESTAMP::DATE, DATE '2024-02-15') >= CASE k % 3 WHEN 0 THEN 180 WHEN 1 THEN 60 ELSE 7 END"


@query("C12_verdict_cycle", f"""WITH s AS (SELECT c_custkey AS k, {_DUE.replace('k ', 'c_custkey ')} AS vd, date_diff('day', to_timestamp(1706000000 + c_custkey * 2000)::TIMESTAMP::DATE, DATE '2024-02-15') >= 14 AS ad FROM customer WHERE c_mktsegment <> 'MACHINERY'),
v AS (SELECT c_custkey AS k, c_custkey % 9 = 0 AS bad, c_custkey % 5 = 0 AS gone FROM customer WHERE c_acctbal >= 2000), j AS (SELECT s.*, v.k IS NOT NULL AND (vd OR ad) AS hit, coalesce(bad, false) AS bad, gone FROM s LEFT JOIN v USING (k)),
a AS (SELECT k, CASE WHEN hit AND NOT bad THEN 1 >= CASE WHEN gone THEN 60 ELSE 180 END ELSE date_diff('day', to_timestamp(1700000000 + k * 7000)::TIMESTAMP::DATE, DATE '2024-02-16') >= CASE k % 3 WHEN 0 THEN 180 WHEN 1 THEN 60 ELSE 7 END END AS vd,
CASE WHEN hit AND NOT bad THEN false WHEN hit THEN false ELSE date_diff('day', to_timestamp(1706000000 + k * 2000)::TIMESTAMP::DATE, DATE '2024-02-16') >= 14 END AS ad FROM j)
SELECT CASE WHEN vd THEN 'verdict' ELSE 'validation' END AS why, count(*) AS n FROM a WHERE vd OR ad GROUP BY 1""")
def _(t):
    due = state.due_queue(_state(t), NOW)
    after = state.apply_verdicts(_state(t), _verdicts(t).join(due.select("key"), "key", "left_semi"), NOW)
    return state.due_queue(after, NOW + dt.timedelta(days=1)).groupBy("why").agg(F.count(F.lit(1)).alias("n"))


@query("C12_verdict_texts", f"""WITH s AS (SELECT c_custkey AS k, {_DUE.replace('k ', 'c_custkey ')} AS vd, date_diff('day', to_timestamp(1706000000 + c_custkey * 2000)::TIMESTAMP::DATE, DATE '2024-02-15') >= 14 AS ad FROM customer WHERE c_mktsegment <> 'MACHINERY'),
asked AS (SELECT *, CASE WHEN vd THEN 'verdict' ELSE 'validation' END AS why FROM s WHERE (vd OR ad) AND k % 13 <> 0 AND k % 3 < 2),
v AS (SELECT c_custkey AS k, c_custkey % 9 = 0 AS bad, c_custkey % 5 = 0 AS gone FROM customer WHERE c_acctbal >= 2000), j AS (SELECT s.*, v.k IS NOT NULL AND s.k IN (SELECT k FROM asked) AS hit, coalesce(bad, false) AS bad, gone FROM s LEFT JOIN v USING (k)),
a AS (SELECT k, hit, bad, gone, CASE WHEN hit AND NOT bad THEN 1 >= CASE WHEN gone THEN 60 ELSE 180 END ELSE date_diff('day', to_timestamp(1700000000 + k * 7000)::TIMESTAMP::DATE, DATE '2024-02-16') >= CASE k % 3 WHEN 0 THEN 180 WHEN 1 THEN 60 ELSE 7 END END AS vd,
CASE WHEN hit THEN false ELSE date_diff('day', to_timestamp(1706000000 + k * 2000)::TIMESTAMP::DATE, DATE '2024-02-16') >= 14 END AS ad FROM j)
SELECT 'asked' AS part, why AS name, count(*) AS n FROM asked GROUP BY ALL UNION ALL SELECT 'next', CASE WHEN vd THEN 'verdict' ELSE 'validation' END, count(*) FROM a WHERE vd OR ad GROUP BY ALL
UNION ALL SELECT 'state', CASE WHEN hit AND NOT bad THEN CASE WHEN gone THEN 'no' ELSE 'yes' END WHEN k % 3 = 0 THEN 'yes' WHEN k % 3 = 1 THEN 'no' ELSE 'unclear' END, count(*) FROM a GROUP BY ALL""")
def _(t):
    k = F.col("c_custkey")
    plain = F.concat(F.lit('Sure: {"operating": "'), F.when(k % 5 == 0, "no").otherwise("yes"), F.lit('", "labels": ["thai"], "website_ok": true, "match_ok": true, "drop": false, "mood": 3} done'))
    answers = t.customer.where("c_acctbal >= 2000").select(k.cast("string").alias("key"), F.when(k % 9 == 0, "no answer").otherwise(F.when(k % 2 == 0, F.concat(F.lit("```json\n"), plain, F.lit("\n```"))).otherwise(plain)).alias("text"))
    done = t.customer.where("c_custkey % 13 = 0").select(k.cast("string").alias("key"))
    groups = t.spark.createDataFrame([("yes",), ("no",)], "operating string")
    asked, after, due = pipelines.verdict_cycle(_state(t), answers, done, groups, NOW)
    count = lambda df, part, name: df.groupBy(F.lit(part).alias("part"), F.col(name).alias("name")).agg(F.count("*").alias("n"))
    return count(asked, "asked", "why").unionByName(count(due, "next", "why")).unionByName(count(after, "state", "operating"))


@query("C13_insight_rows", """WITH a AS (SELECT c_nationkey AS area, count(*) AS n, max(c_acctbal) AS top, avg(c_acctbal) AS mean FROM customer GROUP BY 1), x AS (SELECT area, n::DOUBLE AS value FROM a ORDER BY n DESC, area LIMIT 1), y AS (SELECT area, top AS value FROM a WHERE area NOT IN (SELECT area FROM x) ORDER BY top DESC, area LIMIT 1),
z AS (SELECT area, mean AS value FROM a WHERE area NOT IN (SELECT area FROM x UNION ALL SELECT area FROM y) ORDER BY mean, area LIMIT 1)
SELECT 'most' AS finding, area, round(value, 4) AS value FROM x UNION ALL SELECT 'richest', area, round(value, 4) FROM y UNION ALL SELECT 'leanest', area, round(value, 4) FROM z UNION ALL (SELECT 'lead', c_nationkey, round(c_acctbal, 4) FROM customer WHERE c_nationkey IN (SELECT area FROM a WHERE mean < 4600) ORDER BY c_acctbal DESC, c_custkey LIMIT 1) UNION ALL SELECT 'total', NULL, sum(n)::DOUBLE FROM a""")
def _(t):
    a = t.customer.groupBy(F.col("c_nationkey").alias("area")).agg(F.count(F.lit(1)).alias("n"), F.max("c_acctbal").alias("top"), F.avg("c_acctbal").alias("mean"))
    c = t.customer.select(F.col("c_nationkey").alias("area"), "c_custkey", F.col("c_acctbal").alias("value"))
    lead = feeds.lead(c, a.where("mean < 4600"), "area", [F.desc("value"), F.col("c_custkey")])
    r = pipelines.insight_rows(a, {"most": ("n", True), "richest": ("top", True), "leanest": ("mean", False)}, lead, "n")
    return r.select("finding", "area", F.round("value", 4).alias("value"))


# Under a sun in the south a wall below the lot shades a strip, under one in the south-west a strip cut off by a slanting line.
@query("G12_shadow_fraction", """WITH w AS (SELECT s_suppkey AS lot_id, CASE WHEN s_suppkey % 5 = 0 AND s_suppkey % 10 <> 5 THEN 10 + s_suppkey % 7 END AS h FROM supplier),
m AS (SELECT lot_id, h, least(greatest(h / tan(radians(40)) - 1, 0), 20) AS a, least(greatest(h / tan(radians(35)) * sqrt(0.5) - 1, 0), 20) AS b FROM w)
SELECT lot_id, CASE WHEN lot_id % 10 = 5 THEN NULL WHEN h IS NULL THEN 1.0 ELSE round((1 - a / 20 + 1 - (20 * b - b * b / 2) / 400) / 2, 6) END::DOUBLE AS share, CASE WHEN lot_id % 10 = 5 THEN 'unavailable' ELSE 'measured' END AS quality FROM m""")
def _(t):
    # Lots of 20 m squares 1 km apart; every fifth has a wall in the south, of unknown height beside every second of those.
    sup = t.supplier.select(F.col("s_suppkey").alias("lot_id"), (F.col("s_suppkey") * 1000.0).alias("x0"))
    shapes = sup.select("lot_id", geo.box_polygon(F.col("x0"), F.lit(0.0), 20.0, 20.0).alias("lot"))
    walls = sup.where("lot_id % 5 = 0").select(geo.box_polygon(F.col("x0") - 1, F.lit(-8.0), 22.0, 7.0).alias("wall"), F.when(F.col("lot_id") % 10 == 0, 10.0 + F.col("lot_id") % 7).alias("h"))
    return pipelines.unshaded_share(shapes, walls, "lot", "wall", "h", [(180.0, 40.0), (225.0, 35.0)]).withColumn("share", F.round("share", 6))
