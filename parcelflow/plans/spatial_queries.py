"""Geometry functions and grid joins over points, boxes and segments that follow from the driver's keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, keys
from ..operators import spatial
from . import standins as s
from .registry import query

E = F.expr
CLON, CLAT, SLON, SLAT = s.lon("c_custkey"), s.lat("c_custkey"), s.lon("s_suppkey"), s.lat("s_suppkey")
BOX_W, BOX_H = 0.07, 0.05

# Boxes of the 25 nations, overlapping their right and upper neighbours; points and segments of customers and suppliers.
CTE = f"""WITH box AS (SELECT n_nationkey AS n, -79.4::DOUBLE + (n_nationkey % 5) * 0.06::DOUBLE AS x0, 43.6::DOUBLE + (n_nationkey // 5) * 0.04::DOUBLE AS y0 FROM nation),
pt AS (SELECT c_custkey AS k, {CLON} AS x, {CLAT} AS y, c_acctbal AS v FROM customer), sp AS (SELECT s_suppkey AS s, {SLON} AS sx, {SLAT} AS sy, s_acctbal AS sv FROM supplier),
pip AS (SELECT k, n, v FROM pt, box WHERE x >= x0 AND x < x0 + {BOX_W}::DOUBLE AND y >= y0 AND y < y0 + {BOX_H}::DOUBLE),
near AS (SELECT k, s, x, y, sx, sy, v, sv, 2 * 6371008.8::DOUBLE * asin(sqrt(sin(radians(sy - y) / 2) * sin(radians(sy - y) / 2) + cos(radians(y)) * cos(radians(sy)) * sin(radians(sx - x) / 2) * sin(radians(sx - x) / 2))) AS d FROM pt, sp),
seg AS (SELECT a.s AS s, a.sx AS ax, a.sy AS ay, b.sx AS ex, b.sy AS ey FROM sp a JOIN sp b ON b.s = a.s + 1 AND a.s % 2 = 0),
gap AS (SELECT k, s, sqrt(pow(x - (ax + u * (ex - ax)), 2) + pow(y - (ay + u * (ey - ay)), 2)) AS d FROM (SELECT *, least(greatest(((x - ax) * (ex - ax) + (y - ay) * (ey - ay)) / ((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)), 0), 1) AS u FROM pt, seg))
"""


def points(t):
    return t.customer.select(F.col("c_custkey").alias("k"), E(CLON).alias("x"), E(CLAT).alias("y"), F.col("c_acctbal").alias("v"))


def stops(t):
    return t.supplier.select(F.col("s_suppkey").alias("s"), E(SLON).alias("sx"), E(SLAT).alias("sy"), F.col("s_acctbal").alias("sv"))


def boxes(t):
    n = F.col("n_nationkey")
    x0, y0 = F.lit(-79.4) + (n % 5) * F.lit(0.06), F.lit(43.6) + F.floor(n / 5) * F.lit(0.04)
    return t.nation.select(n.alias("n"), geo.box_polygon(x0, y0, BOX_W, BOX_H).alias("shape"))


def segments(t):
    a = stops(t)
    b = a.select((F.col("s") - 1).alias("s"), F.col("sx").alias("bx"), F.col("sy").alias("by"))
    return a.join(b, "s").where("s % 2 = 0").select("s", geo.points([(F.col("sx"), F.col("sy")), (F.col("bx"), F.col("by"))]).alias("line"))


def pairs(t):
    return spatial.points_in_polygons(points(t), boxes(t), "x", "y", "shape")


@query("J04_pip_first_match", CTE + "SELECT k, min(n) AS n FROM pip GROUP BY k")
def _(t):
    return spatial.first_polygon(points(t), boxes(t).withColumn("o", F.col("n")), "k", "x", "y", "shape", "n", "o")


@query("J05_pip_all_matches", CTE + "SELECT k, n FROM pip")
def _(t):
    return pairs(t).select("k", "n")


@query("J05_pip_padded", CTE + f"SELECT k, n FROM pt, box WHERE sqrt(pow(greatest(x0 - x, 0, x - x0 - {BOX_W}::DOUBLE), 2) + pow(greatest(y0 - y, 0, y - y0 - {BOX_H}::DOUBLE), 2)) <= 0.0018")
def _(t):
    return spatial.points_in_polygons(points(t), boxes(t), "x", "y", "shape", pad=0.0018).select("k", "n")


@query("J06_points_in_polygon_agg", CTE + "SELECT n, count(*) AS points, max(v) AS top FROM pip GROUP BY n")
def _(t):
    return pairs(t).groupBy("n").agg(F.count(F.lit(1)).alias("points"), F.max("v").alias("top"))


@query("J07_mixed_overlay_category", CTE + "SELECT n, min(o) AS category FROM (SELECT n, 'a_point' AS o FROM box JOIN sp ON sx >= x0 AND sx < x0 + 0.07::DOUBLE AND sy >= y0 AND sy < y0 + 0.05::DOUBLE WHERE s % 10 = 0 UNION ALL SELECT n, 'b_area' FROM box WHERE x0 + 0.035::DOUBLE > -79.25 AND y0 + 0.025::DOUBLE > 43.7) GROUP BY n")
def _(t):
    b = boxes(t)
    by_point = spatial.points_in_polygons(stops(t).where("s % 10 = 0"), b, "sx", "sy", "shape").select("n", F.lit("a_point").alias("category"))
    area = t.spark.range(1).select(geo.box_polygon(F.lit(-79.25), F.lit(43.7), 0.5, 0.5).alias("area"))
    inner = spatial.with_inner_points(b, "shape", "x", "y").select("n", "x", "y")
    by_area = spatial.points_in_polygons(inner, area, "x", "y", "area").select("n", F.lit("b_area").alias("category"))
    return by_point.unionByName(by_area).groupBy("n").agg(F.min("category").alias("category"))


@query("J08_inner_point_in_any", CTE + "SELECT k, k IN (SELECT k FROM pip WHERE n % 3 = 0) OR y > 43.78 AS inside FROM pt")
def _(t):
    hit = spatial.points_in_polygons(points(t), boxes(t).where("n % 3 = 0"), "x", "y", "shape").select("k").distinct().withColumn("hit", F.lit(True))
    return points(t).join(hit, "k", "left").select("k", (F.coalesce("hit", F.lit(False)) | (F.col("y") > 43.78)).alias("inside"))


@query("J09_polygon_intersects_any", CTE + "SELECT n FROM box WHERE EXISTS (SELECT 1 FROM sp WHERE s % 20 = 0 AND sx < x0 + 0.07::DOUBLE AND sx + 0.004::DOUBLE > x0 AND sy < y0 + 0.05::DOUBLE AND sy + 0.004::DOUBLE > y0)")
def _(t):
    small = stops(t).where("s % 20 = 0").select("s", geo.box_polygon(F.col("sx"), F.col("sy"), 0.004, 0.004).alias("lot"))
    met = spatial.polygon_pairs(boxes(t), small, "shape", "lot").where(geo.polygon_distance(F.col("shape"), F.col("lot")) == 0)
    return met.select("n").distinct()


_OVER = """o AS (SELECT n, s, greatest(least(sx + 0.02::DOUBLE, x0 + 0.07::DOUBLE) - greatest(sx, x0), 0) * greatest(least(sy + 0.02::DOUBLE, y0 + 0.05::DOUBLE) - greatest(sy, y0), 0) AS a FROM box, sp)"""


def overlaps(t):
    lots = stops(t).select("s", geo.box_polygon(F.col("sx"), F.col("sy"), 0.02, 0.02).alias("lot"))
    return spatial.overlap_pairs(lots, boxes(t), "lot", "shape")


@query("J10_overlap_ratio_join", CTE + ", " + _OVER + " SELECT s, round(sum(a) FILTER (n % 2 = 0) / 0.0004::DOUBLE, 4) AS share, coalesce(sum(a) FILTER (n % 2 = 0) / 0.0004::DOUBLE > 0.25, false) AS excluded FROM o WHERE a > 1e-12 GROUP BY s")
def _(t):
    even = F.sum(F.when(F.col("n") % 2 == 0, F.col("overlap"))) / 0.0004
    return overlaps(t).where("overlap > 1e-12").groupBy("s").agg(F.round(even, 4).alias("share"), F.coalesce(even > 0.25, F.lit(False)).alias("excluded"))


@query("J11_best_overlap_label", CTE + ", " + _OVER + " SELECT s, arg_max(n, [round(a, 12), -n]) AS n FROM o WHERE a / 0.0004 >= 0.5 GROUP BY s")
def _(t):
    return overlaps(t).where("overlap / 0.0004 >= 0.5").groupBy("s").agg(F.max_by("n", F.struct(F.round("overlap", 12), -F.col("n"))).alias("n"))


@query("J12_coverage_ratio", CTE + ", " + _OVER + " SELECT n, round(least(greatest(sum(a) / (0.07 * 0.05), 0), 1), 4) AS coverage FROM o WHERE a > 1e-12 GROUP BY n")
def _(t):
    return overlaps(t).where("overlap > 1e-12").groupBy("n").agg(F.round(F.least(F.greatest(F.sum("overlap") / (0.07 * 0.05), F.lit(0.0)), F.lit(1.0)), 4).alias("coverage"))


LOT_W, LOT_H = 0.002, 0.0015


def lots(t, w=LOT_W, h=LOT_H):
    """A lot for every customer, its lower left corner at the customer's point."""
    return points(t).select("k", geo.box_polygon(F.col("x"), F.col("y"), w, h).alias("lot"))


def _gap_sql(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    u = f"least(greatest((({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / (pow({bx} - {ax}, 2) + pow({by} - {ay}, 2)), 0), 1)"
    return f"sqrt(pow({px} - ({ax} + {u} * ({bx} - {ax})), 2) + pow({py} - ({ay} + {u} * ({by} - {ay})), 2))"


def _side_sql(ax: str, ay: str, bx: str, by: str, px: str, py: str) -> str:
    return f"sign(({bx} - {ax}) * ({py} - {ay}) - ({by} - {ay}) * ({px} - {ax}))"


# Distance of every lot's boundary (four sides) from every segment.
BOUNDARY = CTE.rstrip() + f""", side AS (SELECT k, x AS px, y AS py, x + {LOT_W}::DOUBLE AS qx, y AS qy FROM pt UNION ALL SELECT k, x + {LOT_W}::DOUBLE, y, x + {LOT_W}::DOUBLE, y + {LOT_H}::DOUBLE FROM pt
    UNION ALL SELECT k, x + {LOT_W}::DOUBLE, y + {LOT_H}::DOUBLE, x, y + {LOT_H}::DOUBLE FROM pt UNION ALL SELECT k, x, y + {LOT_H}::DOUBLE, x, y FROM pt),
edge_gap AS (SELECT k, s, min(CASE WHEN {_side_sql('px', 'py', 'qx', 'qy', 'ax', 'ay')} * {_side_sql('px', 'py', 'qx', 'qy', 'ex', 'ey')} < 0
        AND {_side_sql('ax', 'ay', 'ex', 'ey', 'px', 'py')} * {_side_sql('ax', 'ay', 'ex', 'ey', 'qx', 'qy')} < 0 THEN 0
    ELSE least({_gap_sql('px', 'py', 'ax', 'ay', 'ex', 'ey')}, {_gap_sql('qx', 'qy', 'ax', 'ay', 'ex', 'ey')}, {_gap_sql('ax', 'ay', 'px', 'py', 'qx', 'qy')}, {_gap_sql('ex', 'ey', 'px', 'py', 'qx', 'qy')}) END) AS d FROM side, seg GROUP BY k, s)
"""


@query("J13_line_touch_distinct", BOUNDARY + "SELECT k, count(DISTINCT s % 12) FILTER (d <= 0.003 AND s % 5 <> 0) >= 2 AS corner FROM edge_gap GROUP BY k")
def _(t):
    named = segments(t).withColumn("name", F.when(F.col("s") % 5 != 0, F.col("s") % 12))
    return spatial.lines_touched(lots(t), named, "k", "lot", "line", "name", 0.003).select("k", (F.col("n_lines") >= 2).alias("corner"))


@query("J14_line_touch_flagged", BOUNDARY + "SELECT k, count(*) FILTER (d <= 0.002 AND s % 4 = 0) > 0 AS lane FROM edge_gap GROUP BY k")
def _(t):
    lanes = segments(t).where("s % 4 = 0").withColumn("name", F.lit("lane"))
    return spatial.lines_touched(lots(t), lanes, "k", "lot", "line", "name", 0.002).select("k", (F.col("n_lines") > 0).alias("lane"))


@query("J15_nearest_point", CTE + "SELECT k, arg_min(s, [d, s]) FILTER (d <= 5000) AS stop, round(least(min(d), 5000), 3) AS metres FROM near GROUP BY k")
def _(t):
    return spatial.nearest(points(t), stops(t), "k", "x", "y", "s", "sx", "sy", 5000.0, label="stop").select("k", "stop", F.round("dist_m", 3).alias("metres"))


@query("J16_nearest_line_distance", CTE + "SELECT k, round(CASE WHEN min(d) <= 0.02 THEN min(d) * 95000 ELSE 99999 END, 3) AS metres FROM gap GROUP BY k")
def _(t):
    return spatial.nearest_line(points(t), segments(t), "k", "x", "y", "line").select("k", F.round("dist_m", 3).alias("metres"))


@query("J17_nearest_owner_assignment", CTE + ", own AS (SELECT k, arg_min(s, [d, s]) FILTER (d <= 20000) AS s, max(v) AS v FROM near GROUP BY k), first AS (SELECT s, min(n) AS n FROM sp, box WHERE sx >= x0 AND sx < x0 + 0.07::DOUBLE AND sy >= y0 AND sy < y0 + 0.05::DOUBLE GROUP BY s) SELECT n, max(v) AS top FROM own JOIN first USING (s) GROUP BY n")
def _(t):
    own = spatial.nearest(points(t), stops(t), "k", "x", "y", "s", "sx", "sy", 20_000.0, label="s").join(points(t).select("k", "v"), "k")
    at = spatial.first_polygon(stops(t), boxes(t).withColumn("o", F.col("n")), "s", "sx", "sy", "shape", "n", "o")
    return own.join(at, "s").groupBy("n").agg(F.max("v").alias("top"))


@query("J18_within_radius_nearest", CTE + "SELECT k, count(*) AS around, arg_min(sv, [d, s]) AS nearest_value FROM near WHERE d <= 1500 AND k <> s GROUP BY k")
def _(t):
    return spatial.radius_nearest(points(t), stops(t), "k", "x", "y", "s", "sx", "sy", "sv", 1500.0)


_BEAR = "(degrees(atan2(sin(radians(sx - x)) * cos(radians(sy)), cos(radians(y)) * sin(radians(sy)) - sin(radians(y)) * cos(radians(sy)) * cos(radians(sx - x)))) + 360) % 360"


@query("J19_radius_quadrant", CTE + f"SELECT k, round(avg(sv) FILTER (b >= 315 OR b < 45), 4) AS avg_n, round(avg(sv) FILTER (b >= 45 AND b < 135), 4) AS avg_e, round(avg(sv) FILTER (b >= 135 AND b < 225), 4) AS avg_s, round(avg(sv) FILTER (b >= 225 AND b < 315), 4) AS avg_w FROM (SELECT *, {_BEAR} AS b FROM near WHERE d <= 2000 AND k <> s) GROUP BY k")
def _(t):
    q = spatial.quadrants(points(t), stops(t), "k", "x", "y", "s", "sx", "sy", "sv", 2000.0)
    return q.select("k", *[F.round(f"avg_{c}", 4).alias(f"avg_{c}") for c in "nesw"])


@query("J20_proximity_keep", CTE + "SELECT k, k % 50 = 0 OR k IN (SELECT k FROM near WHERE d <= 250) AS kept FROM pt")
def _(t):
    near = spatial.within_radius(points(t), stops(t), "x", "y", "sx", "sy", 250.0).select("k").distinct().withColumn("hit", F.lit(True))
    return points(t).join(near, "k", "left").select("k", ((F.col("k") % 50 == 0) | F.coalesce("hit", F.lit(False))).alias("kept"))


@query("J21_point_buffer_exclusion", CTE + "SELECT k FROM pt WHERE k NOT IN (SELECT k FROM near WHERE d <= 400)")
def _(t):
    near = spatial.within_radius(points(t), stops(t), "x", "y", "sx", "sy", 400.0).select("k").distinct()
    return points(t).select("k").join(near, "k", "left_anti")


@query("J39_near_named_lines", BOUNDARY + "SELECT DISTINCT k FROM edge_gap WHERE d <= 0.0015 AND s % 6 = 0")
def _(t):
    named = segments(t).where("s % 6 = 0").withColumn("name", F.lit("listed"))
    return spatial.lines_touched(lots(t), named, "k", "lot", "line", "name", 0.0015).where("n_lines > 0").select("k")


# Lots of 20 x 30 m side by side, in metres; a main building on most of them, a shed on every fourth.
METRE_LOTS = """WITH lot AS (SELECT c_custkey AS k, (c_custkey % 40) * 20.0::DOUBLE AS x, (c_custkey // 40) * 30.0::DOUBLE AS y FROM customer),
b AS (SELECT 2 * k AS id, x + (k * 3) % 9 - 0.75 AS bx, y + 5 + k % 7 AS b_y, (8 + (k * 7) % 12)::DOUBLE AS w, (6 + (k * 5) % 9)::DOUBLE AS h FROM lot WHERE k % 11 <> 0
    UNION ALL SELECT 2 * k + 1, x + 2, y + 22, 5.0, 5.0 FROM lot WHERE k % 4 = 0),
hit AS (SELECT k, id, w * h AS area, bx, b_y, w, h, greatest(least(x + 20, bx + w) - greatest(x, bx), 0) * greatest(least(y + 30, b_y + h) - greatest(y, b_y), 0) AS over FROM lot JOIN b ON abs(bx - x) < 60 AND abs(b_y - y) < 80),
main AS (SELECT * FROM hit WHERE over >= 50 QUALIFY row_number() OVER (PARTITION BY k ORDER BY area DESC, id) = 1),
close AS (SELECT m.k, count(*) AS c FROM main m JOIN lot USING (k) JOIN hit f ON f.k = m.k AND f.id <> m.id WHERE f.area >= 50 AND f.over < 50 AND f.over / f.area <= 0.05
    AND sqrt(pow(greatest(f.bx - m.bx - m.w, m.bx - f.bx - f.w, 0), 2) + pow(greatest(f.b_y - m.b_y - m.h, m.b_y - f.b_y - f.h, 0), 2)) <= 1.5
    AND sqrt(pow(greatest(f.bx - x - 20, x - f.bx - f.w, 0), 2) + pow(greatest(f.b_y - y - 30, y - f.b_y - f.h, 0), 2)) <= 10 GROUP BY m.k)
"""


def metre_lots(t):
    k = F.col("c_custkey")
    lot = t.customer.select(k.alias("k"), ((k % 40) * F.lit(20.0)).alias("x"), (F.floor(k / 40) * F.lit(30.0)).alias("y"))
    k, x, y = F.col("k"), F.col("x"), F.col("y")
    main = lot.where("k % 11 <> 0").select((k * 2).alias("id"), (x + (k * 3) % 9 - 0.75).alias("bx"), (y + 5 + k % 7).alias("b_y"), (8 + (k * 7) % 12).cast("double").alias("w"), (6 + (k * 5) % 9).cast("double").alias("h"))
    shed = lot.where("k % 4 = 0").select((k * 2 + 1).alias("id"), (x + 2).alias("bx"), (y + 22).alias("b_y"), F.lit(5.0).alias("w"), F.lit(5.0).alias("h"))
    ring = geo.points([(F.col("bx"), F.col("b_y")), (F.col("bx") + F.col("w"), F.col("b_y")), (F.col("bx") + F.col("w"), F.col("b_y") + F.col("h")), (F.col("bx"), F.col("b_y") + F.col("h"))])
    return lot.select("k", geo.box_polygon(x, y, 20.0, 30.0).alias("lot")), main.unionByName(shed).select("id", F.array(ring).alias("footprint"))


@query("J23_attached_neighbour_class", METRE_LOTS + "SELECT lot.k, CASE WHEN m.k IS NULL THEN 'vacant' WHEN 1 - m.over / m.area > 0.4 THEN 'row' WHEN 1 - m.over / m.area > 0.15 THEN 'semi' WHEN c IS NULL THEN 'detached' WHEN c = 1 THEN 'semi' ELSE 'row' END AS kind FROM lot LEFT JOIN main m USING (k) LEFT JOIN close USING (k)")
def _(t):
    lot, b = metre_lots(t)
    return spatial.attached_class(lot, b, "k", "lot", "id", "footprint").select("k", "kind")


# Squares at the suppliers, cut to each nation's box; a cell between neighbouring edges is covered whole or not at all.
_UNION = """r AS (SELECT n, greatest(sx, x0) AS a, least(sx + 0.02::DOUBLE, x0 + 0.07::DOUBLE) AS b, greatest(sy, y0) AS c, least(sy + 0.02::DOUBLE, y0 + 0.05::DOUBLE) AS d FROM box, sp WHERE sx + 0.02::DOUBLE > x0 AND sx < x0 + 0.07::DOUBLE AND sy + 0.02::DOUBLE > y0 AND sy < y0 + 0.05::DOUBLE),
xs AS (SELECT n, v AS xa, lead(v) OVER (PARTITION BY n ORDER BY v) AS xb FROM (SELECT n, a AS v FROM r UNION SELECT n, b FROM r)),
ys AS (SELECT n, v AS ya, lead(v) OVER (PARTITION BY n ORDER BY v) AS yb FROM (SELECT n, c AS v FROM r UNION SELECT n, d FROM r)),
u AS (SELECT xs.n, sum((xb - xa) * (yb - ya)) AS area FROM xs JOIN ys ON xs.n = ys.n WHERE EXISTS (SELECT 1 FROM r WHERE r.n = xs.n AND a <= xa AND b >= xb AND c <= ya AND d >= yb) GROUP BY xs.n)"""


@query("J12_union_coverage", CTE + ", " + _UNION + " SELECT n, round(coalesce(area, 0) / 0.0035::DOUBLE, 6) AS covered, round(1 - coalesce(area, 0) / 0.0035::DOUBLE, 6) AS bare FROM box LEFT JOIN u USING (n)")
def _(t):
    squares = stops(t).select(geo.box_polygon(F.col("sx"), F.col("sy"), 0.02, 0.02).alias("square"))
    c = spatial.union_coverage(boxes(t), squares, "n", "shape", "square")
    return c.select("n", F.round(F.col("covered") / F.lit(0.0035), 6).alias("covered"), F.round(F.col("bare") / F.lit(0.0035), 6).alias("bare"))


_EXCLUDE = """poly AS (SELECT s, sx, sy, s % 7 = 0 AS tag FROM sp), node AS (SELECT k, x, y FROM pt WHERE k % 10 = 0),
kept AS (SELECT s, sx, sy FROM poly WHERE tag OR EXISTS (SELECT 1 FROM node WHERE 2 * 6371008.8::DOUBLE * asin(sqrt(pow(sin(radians(y - sy - 0.0015::DOUBLE) / 2), 2) + cos(radians(y)) * cos(radians(sy + 0.0015::DOUBLE)) * pow(sin(radians(x - sx - 0.002::DOUBLE) / 2), 2))) <= 900)),
circle AS (SELECT k AS id, x AS ox, y AS oy, 300 AS radius FROM node WHERE NOT EXISTS (SELECT 1 FROM kept WHERE x >= sx AND x < sx + 0.004::DOUBLE AND y >= sy AND y < sy + 0.003::DOUBLE)
    UNION ALL SELECT k, x, y, 150 FROM pt WHERE k % 10 = 5)"""


def exclusions(t):
    polygons = stops(t).select("s", geo.box_polygon(F.col("sx"), F.col("sy"), 0.004, 0.003).alias("shape"))
    nodes = points(t).where("k % 5 = 0")
    return spatial.exclusion_shapes(polygons, nodes, "s", "shape", F.col("s") % 7 == 0, "k", "x", "y", F.col("k") % 10 == 5, 900.0, 300.0, 150.0)


@query("J20_exclusion_shapes", CTE + ", " + _EXCLUDE + " SELECT 'polygon' AS shape, s AS id, NULL::BIGINT AS radius FROM kept UNION ALL SELECT 'circle', id, radius::BIGINT FROM circle")
def _(t):
    kept, circles = exclusions(t)
    return kept.select(F.lit("polygon").alias("shape"), F.col("s").alias("id"), F.lit(None).cast("long").alias("radius")).unionByName(
        circles.select(F.lit("circle").alias("shape"), F.col("k").alias("id"), F.col("radius").cast("long").alias("radius")))


@query("J20_excluded_points", CTE + ", " + _EXCLUDE + """ SELECT DISTINCT k FROM pt WHERE EXISTS (SELECT 1 FROM kept WHERE x >= sx AND x < sx + 0.004::DOUBLE AND y >= sy AND y < sy + 0.003::DOUBLE)
    OR EXISTS (SELECT 1 FROM circle WHERE 2 * 6371008.8::DOUBLE * asin(sqrt(pow(sin(radians(oy - y) / 2), 2) + cos(radians(y)) * cos(radians(oy)) * pow(sin(radians(ox - x) / 2), 2))) <= radius)""")
def _(t):
    kept, circles = exclusions(t)
    p = points(t).select(F.col("k").alias("k"), "x", "y")
    in_polygon = spatial.points_in_polygons(p, kept.select("shape"), "x", "y", "shape").select("k")
    in_circle = spatial.points_in_circles(p, circles.select(F.col("x").alias("ox"), F.col("y").alias("oy"), "radius"), "x", "y", "ox", "oy", "radius").select("k")
    return in_polygon.unionByName(in_circle).distinct()


# Wide lots with the addresses of their customers; records at the suppliers, two thirds of them with the address of a customer.
_CLAIMS = """lot AS (SELECT k, x, y FROM pt WHERE k % 4 <> 1), rec AS (SELECT s, sx - 0.003::DOUBLE AS sx, sy, s % 5 AS tier, CASE WHEN s % 3 <> 0 THEN s * 2 END AS a FROM sp),
adr AS (SELECT k, max(tier) AS tier, count(*) AS n FROM lot JOIN rec ON a = k GROUP BY k), free AS (SELECT * FROM rec WHERE a IS NULL OR a NOT IN (SELECT k FROM lot)),
own AS (SELECT s, tier, min(k) AS k FROM free JOIN lot ON sx >= x AND sx < x + 0.005::DOUBLE AND sy >= y AND sy < y + 0.004::DOUBLE WHERE k NOT IN (SELECT k FROM adr) GROUP BY s, tier)"""


def claims(t):
    c = t.customer.select(F.col("c_custkey").alias("k"), keys.normalize_address(E(s.ADDRESS)).alias("addr_norm"))
    parcels = lots(t, 0.005, 0.004).join(c, "k").where("k % 4 <> 1")
    records = stops(t).select("s", (F.col("sx") - F.lit(0.003)).alias("sx"), "sy", (F.col("s") % 5).alias("tier"), F.when(F.col("s") % 3 != 0, F.col("s") * 2).alias("of")).join(c.select(F.col("k").alias("of"), F.col("addr_norm").alias("a")), "of", "left")
    return spatial.claimed_records(parcels, records, "k", "addr_norm", "lot", "s", "a", "sx", "sy", "tier")


@query("J03_join_address_then_spatial", CTE + ", " + _CLAIMS + " SELECT k, 'address' AS via, tier AS rank, n AS n_claims FROM adr UNION ALL SELECT k, 'point', max(tier), count(*) FROM own GROUP BY k")
def _(t):
    return claims(t)[0]


@query("J03_unclaimed_records", CTE + ", " + _CLAIMS + " SELECT s FROM free WHERE s NOT IN (SELECT s FROM own)")
def _(t):
    return claims(t)[1]


@query("W12_candidate_cap", CTE + "SELECT k, s FROM (SELECT k, s, row_number() OVER (PARTITION BY k ORDER BY d, s) AS rn FROM near WHERE d <= 4000) WHERE rn <= 5")
def _(t):
    few = spatial.nearest_few(points(t), stops(t), "k", "x", "y", "s", "sx", "sy", 5, 4000.0)
    return few.select("k", F.explode("_best").alias("b")).select("k", F.col("b._rid").alias("s"))


@query("G01_point_in_polygon", CTE + "SELECT k, abs(x + 79.25) + abs(y - 43.7) < 0.08 AND NOT (x >= -79.26 AND x < -79.24 AND y >= 43.69 AND y < 43.71) AS inside FROM pt")
def _(t):
    diamond = geo.points([(-79.33, 43.7), (-79.25, 43.62), (-79.17, 43.7), (-79.25, 43.78)])
    hole = geo.points([(-79.26, 43.69), (-79.24, 43.69), (-79.24, 43.71), (-79.26, 43.71)])
    return points(t).select("k", geo.point_in_polygon(F.col("x"), F.col("y"), F.array(diamond, hole)).alias("inside"))


@query("G02_bbox", CTE + f"SELECT n, round(x0, 6) AS xmin, round(y0, 6) AS ymin, round(x0 + {BOX_W}::DOUBLE, 6) AS xmax, round(y0 + {BOX_H}::DOUBLE, 6) AS ymax FROM box")
def _(t):
    return boxes(t).select("n", *[F.round(c, 6).alias(a) for c, a in zip(geo.bbox(F.col("shape")[0]), ("xmin", "ymin", "xmax", "ymax"))])


VISITS = CTE.rstrip() + ", visit AS (SELECT DISTINCT o_custkey AS k, l_suppkey AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey) "


def visits(t):
    """Every customer and supplier that share an order, with both points."""
    pairs = t.orders.select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("k")).join(t.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s")), "o").select("k", "s").distinct()
    return pairs.join(points(t), "k").join(stops(t), "s")


@query("G03_haversine_m", VISITS + "SELECT k, s, round(d, 3) AS metres FROM near JOIN visit USING (k, s)")
def _(t):
    return visits(t).select("k", "s", F.round(geo.haversine(F.col("x"), F.col("y"), F.col("sx"), F.col("sy")), 3).alias("metres"))


@query("G04_web_mercator", CTE + "SELECT k, round(x, 8) AS lon, round(y, 8) AS lat FROM pt")
def _(t):
    mx = F.radians("x") * geo.RADIUS_84
    my = F.log(F.tan(F.radians("y") / 2 + F.lit(0.7853981633974483))) * geo.RADIUS_84
    back = points(t).select("k", geo.from_web_mercator(mx, my).alias("p"))
    return back.select("k", F.round("p.lon", 8).alias("lon"), F.round("p.lat", 8).alias("lat"))


@query("G04_transverse_mercator_round_trip", CTE + "SELECT k, true AS back FROM pt")
def _(t):
    u = points(t).select("k", "x", "y", geo.to_utm17(F.col("x"), F.col("y")).alias("u"))
    back = u.select("k", "x", "y", geo.from_transverse_mercator(F.col("u.x"), F.col("u.y"), -81.0, 0.9996, 500_000.0).alias("p"))
    return back.select("k", ((F.abs(F.col("p.lon") - F.col("x")) < 1e-8) & (F.abs(F.col("p.lat") - F.col("y")) < 1e-8)).alias("back"))


@query("G05_polygon_area_m2", CTE + "SELECT n, round(0.07 * 0.05 * pow(radians(1) * 6371008.8::DOUBLE, 2) * cos(radians(y0 + 0.025)) / 1e6, 1) AS km2 FROM box")
def _(t):
    return boxes(t).select("n", F.round(geo.polygon_area_m2(F.col("shape")) / 1e6, 1).alias("km2"))


@query("G06_centroid_inner_point", CTE + "SELECT n, round(x0 + 0.035::DOUBLE, 6) AS cx, round(y0 + 0.025::DOUBLE, 6) AS cy, true AS inner_inside FROM box")
def _(t):
    u = lambda p: geo.points([(p["x"], p["y"]), (p["x"] + 0.03, p["y"]), (p["x"] + 0.03, p["y"] + 0.03), (p["x"] + 0.025, p["y"] + 0.03), (p["x"] + 0.025, p["y"] + 0.005), (p["x"] + 0.004, p["y"] + 0.005), (p["x"] + 0.004, p["y"] + 0.03), (p["x"], p["y"] + 0.03)])
    df = boxes(t).select("n", geo.centroid(F.col("shape")[0]).alias("c"), F.array(u(F.col("shape")[0][0])).alias("bay"))
    df = df.withColumn("p", geo.inner_point(F.col("bay")))
    return df.select("n", F.round("c.x", 6).alias("cx"), F.round("c.y", 6).alias("cy"), geo.point_in_polygon(F.col("p.x"), F.col("p.y"), F.col("bay")).alias("inner_inside"))


@query("G07_min_rotated_rect", CTE + "SELECT s, 5.0::DOUBLE AS long, 2.0::DOUBLE AS short, 2.5::DOUBLE AS aspect, round((degrees(0.1 * (s % 20)) + 180) % 180, 4) AS orientation FROM sp")
def _(t):
    a = (F.col("s") % 20) * 0.1
    turn = lambda x, y: (F.col("sx") + x * F.cos(a) - y * F.sin(a), F.col("sy") + x * F.sin(a) + y * F.cos(a))
    ring = geo.points([turn(0, 0), turn(5, 0), turn(5, 2), turn(2, 1), turn(0, 2)])
    df = stops(t).select("s", geo.min_rotated_rect(ring).alias("r"))
    return df.select("s", F.round("r.long", 6).alias("long"), F.round("r.short", 6).alias("short"), F.round("r.aspect", 6).alias("aspect"), F.round("r.orientation", 4).alias("orientation"))


@query("G08_bearing_quadrant", VISITS + f"SELECT k, s, CASE WHEN b >= 315 OR b < 45 THEN 'N' WHEN b < 135 THEN 'E' WHEN b < 225 THEN 'S' ELSE 'W' END AS quarter FROM (SELECT k, s, {_BEAR} AS b FROM near JOIN visit USING (k, s))")
def _(t):
    return visits(t).select("k", "s", geo.quadrant(geo.bearing(F.col("x"), F.col("y"), F.col("sx"), F.col("sy"))).alias("quarter"))


@query("G09_point_segment_distance", VISITS + "SELECT k, s, round(d, 9) AS d FROM gap JOIN (SELECT DISTINCT k, s - s % 2 AS s FROM visit) USING (k, s)")
def _(t):
    p = visits(t).select("k", "x", "y", (F.col("s") - F.col("s") % 2).alias("s")).distinct().join(segments(t), "s")
    return p.select("k", "s", F.round(geo.path_distance(F.col("x"), F.col("y"), F.col("line")), 9).alias("d"))


@query("G10_expand_bbox", CTE + "SELECT k, round(150 / (111320.0::DOUBLE * cos(radians(y))), 9) AS pad_x, round(150 / 110540.0::DOUBLE, 9) AS pad_y FROM pt")
def _(t):
    px, py = geo.expand_bbox(F.col("y"), 150.0)
    return points(t).select("k", F.round(px, 9).alias("pad_x"), F.round(py, 9).alias("pad_y"))


@query("G11_clip_area", CTE + ", " + _OVER + " SELECT n, s, round(a, 9) AS area FROM o WHERE a > 1e-9")
def _(t):
    return overlaps(t).where("overlap > 1e-9").select("n", "s", F.round("overlap", 9).alias("area"))


@query("G13_quad_key_cells", CTE + "SELECT n, (floor((x0 + 0.07::DOUBLE) / 0.02::DOUBLE) - floor(x0 / 0.02::DOUBLE) + 1)::BIGINT * (floor((y0 + 0.05::DOUBLE) / 0.02::DOUBLE) - floor(y0 / 0.02::DOUBLE) + 1)::BIGINT AS cells FROM box")
def _(t):
    b = boxes(t)
    return spatial.with_cells(b, geo.bbox(F.col("shape")[0]), 0.02).groupBy("n").agg(F.count(F.lit(1)).alias("cells"))


@query("G14_polygon_distance", CTE + "SELECT n, s, round(sqrt(pow(greatest(sx - x0 - 0.07::DOUBLE, x0 - sx - 0.02::DOUBLE, 0), 2) + pow(greatest(sy - y0 - 0.05::DOUBLE, y0 - sy - 0.02::DOUBLE, 0), 2)), 9) AS d FROM box JOIN supplier ON s_nationkey = n JOIN sp ON s = s_suppkey")
def _(t):
    own = t.supplier.select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("n"))
    squares = stops(t).select("s", geo.box_polygon(F.col("sx"), F.col("sy"), 0.02, 0.02).alias("lot")).join(own, "s")
    return boxes(t).join(squares, "n").select("n", "s", F.round(geo.polygon_distance(F.col("shape"), F.col("lot")), 9).alias("d"))


@query("G15_area_polygon_set", CTE + "SELECT n % 5 AS area, count(DISTINCT k) AS points FROM (SELECT k, n FROM pip UNION SELECT k, n FROM pt, box WHERE n % 5 = 2 AND sqrt(pow(greatest(x0 - x, 0, x - x0 - 0.07::DOUBLE), 2) + pow(greatest(y0 - y, 0, y - y0 - 0.05::DOUBLE), 2)) <= 0.001607) GROUP BY 1")
def _(t):
    b = boxes(t).withColumn("area", F.col("n") % 5)
    plain = spatial.points_in_polygons(points(t), b.where("area != 2"), "x", "y", "shape").select("k", "area")
    padded = spatial.points_in_polygons(points(t), b.where("area = 2"), "x", "y", "shape", pad=0.001607).select("k", "area")
    return plain.unionByName(padded).groupBy("area").agg(F.countDistinct("k").alias("points"))


# Streets: a line from every customer's point to the next one's.
STREETS = CTE.rstrip() + """, street AS (SELECT a.k, a.x AS ax, a.y AS ay, b.x AS ex, b.y AS ey FROM pt a JOIN pt b ON b.k = a.k + 1),
corner AS (SELECT cx, cy, count(DISTINCT k) AS lines FROM (SELECT k, trunc(ax / 0.02::DOUBLE)::BIGINT AS cx, trunc(ay / 0.02::DOUBLE)::BIGINT AS cy FROM street UNION ALL SELECT k, trunc(ex / 0.02::DOUBLE)::BIGINT, trunc(ey / 0.02::DOUBLE)::BIGINT FROM street) GROUP BY ALL HAVING count(DISTINCT k) >= 3),
cut AS (SELECT n, ax, ay, ex - ax AS dx, ey - ay AS dy, greatest(0, least((x0 - ax) / (ex - ax), (x0 + 0.07::DOUBLE - ax) / (ex - ax)), least((y0 - ay) / (ey - ay), (y0 + 0.05::DOUBLE - ay) / (ey - ay))) AS t0, least(1, greatest((x0 - ax) / (ex - ax), (x0 + 0.07::DOUBLE - ax) / (ex - ax)), greatest((y0 - ay) / (ey - ay), (y0 + 0.05::DOUBLE - ay) / (ey - ay))) AS t1 FROM street, box),
inner_part AS (SELECT n, 2 * 6371008.8::DOUBLE * asin(sqrt(pow(sin(radians((t1 - t0) * dy) / 2), 2) + cos(radians(ay + t0 * dy)) * cos(radians(ay + t1 * dy)) * pow(sin(radians((t1 - t0) * dx) / 2), 2))) AS m FROM cut WHERE t1 > t0),
ways AS (SELECT box.n AS area, coalesce(sum(m), 0) AS length_m FROM box LEFT JOIN inner_part ON inner_part.n = box.n GROUP BY 1)
"""


def streets(t):
    a = points(t)
    b = a.select((F.col("k") - 1).alias("k"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return a.join(b, "k").select("k", F.array(geo.points([(F.col("x"), F.col("y")), (F.col("bx"), F.col("by"))])).alias("parts"))


@query("A26_intersection_clusters", STREETS + "SELECT round((cx + 0.5) * 0.02::DOUBLE, 8) AS x, round((cy + 0.5) * 0.02::DOUBLE, 8) AS y, lines FROM corner")
def _(t):
    c = spatial.intersection_clusters(streets(t), "k", "parts", 0.02)
    return c.select(F.round("x", 8).alias("x"), F.round("y", 8).alias("y"), "lines")


@query("A27_clipped_length", STREETS + "SELECT area, round(length_m, 2) AS length_m FROM ways")
def _(t):
    ways = spatial.clipped_length(streets(t), boxes(t).withColumnRenamed("n", "area"), "parts", "area", "shape")
    return ways.select("area", F.round("length_m", 2).alias("length_m"))
