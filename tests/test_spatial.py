"""Spatial and name-matching operators against brute force on points and shapes that follow from a seed."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelflow.functions import geo
from parcelflow.operators import matching, spatial

POLY = "array<array<struct<x:double,y:double>>>"
LINE = "array<struct<x:double,y:double>>"


def box(x, y, w, h):
    x, y, w, h = (float(v) for v in (x, y, w, h))
    return [[(x, y), (x + w, y), (x + w, y + h), (x, y + h)]]


def haversine(x1, y1, x2, y2):
    p, q = math.radians(y1), math.radians(y2)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * geo.EARTH_M * math.asin(math.sqrt(h))


def dict_rings(rings):
    return [[{"x": x, "y": y} for x, y in r] for r in rings]


def test_lines_are_held_against_the_boundary_of_a_lot(spark):
    lots = spark.createDataFrame([(1, box(0, 0, 100, 100)), (2, box(300, 0, 100, 100)), (3, None), (4, box(0, 300, 10, 10))], f"k int, lot {POLY}")
    lines = spark.createDataFrame(
        [
            ("near the right edge, far from the centre", [(104.0, -500.0), (104.0, 500.0)]),
            ("inside, far from the boundary", [(340.0, 50.0), (360.0, 50.0)]),
            ("through two sides", [(250.0, 50.0), (450.0, 50.0)]),
            (None, [(0.0, -1.0), (100.0, -1.0)]),
            ("one point", [(0.0, 0.0)]),
            ("through two sides", [(250.0, 60.0), (450.0, 60.0)]),
        ],
        f"name string, line {LINE}",
    )
    got = {r.k: r.n_lines for r in spatial.lines_touched(lots, lines, "k", "lot", "line", "name", 8.0).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0}
    pairs = {(r.k, r.name) for r in spatial.boundary_lines(lots, lines, "lot", "line", 8.0).select("k", "name").collect()}
    assert (2, "inside, far from the boundary") not in pairs and (1, None) in pairs


def test_segment_gap_matches_sampled_distances(spark):
    rng = random.Random(3)
    rows = [tuple(rng.uniform(0, 10) for _ in range(8)) for _ in range(200)] + [(0.0, 0.0, 4.0, 0.0, 2.0, 0.0, 6.0, 0.0), (0.0, 0.0, 0.0, 0.0, 3.0, 4.0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "ax double, ay double, bx double, by double, cx double, cy double, dx double, dy double")
    seg = lambda p, q: F.struct(F.struct(F.col(p + "x").alias("x"), F.col(p + "y").alias("y")).alias("a"), F.struct(F.col(q + "x").alias("x"), F.col(q + "y").alias("y")).alias("b"))
    got = [r.d for r in df.select(geo.segment_gap(seg("a", "b"), seg("c", "d")).alias("d")).collect()]
    t = np.linspace(0, 1, 400)
    for r, d in zip(rows, got):
        p, q, u, v = (np.array(r[i : i + 2]) for i in (0, 2, 4, 6))
        sampled = np.sqrt((((p + t[:, None] * (q - p))[:, None, :] - (u + t[:, None] * (v - u))[None]) ** 2).sum(2)).min()
        assert d <= sampled + 1e-9 and sampled - d < 0.08


def test_sweep_area_of_unions_and_holes():
    square = dict_rings(box(0, 0, 4, 4))
    with_hole = dict_rings([box(0, 0, 4, 4)[0], box(1, 1, 2, 2)[0]])
    twice = [dict_rings(box(1, 1, 2, 2)), dict_rings(box(2, 2, 2, 2)), dict_rings(box(1, 1, 2, 2))]
    assert geo.sweep_areas(square, twice) == pytest.approx((7.0, 9.0))
    assert geo.sweep_areas(with_hole, twice) == pytest.approx((3.0, 9.0))
    assert geo.sweep_areas(square, [with_hole]) == pytest.approx((12.0, 4.0))
    assert geo.sweep_areas(square, []) == pytest.approx((0.0, 16.0))
    assert geo.sweep_areas(square, twice, (0, 0, 2, 2)) == pytest.approx((1.0, 3.0))
    star = dict_rings([[(0, 3), (4, 1), (0, 1), (4, 3), (2, 0)]])  # crosses itself: odd parts are inside
    inside, outside = geo.sweep_areas(star, [square])
    assert inside > 0 and outside == pytest.approx(0.0, abs=1e-12)


def test_sweep_area_agrees_with_clipping_and_with_quarters():
    rng = random.Random(5)
    for _ in range(20):
        shape = lambda: [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(3)]  # noqa: B023
        a, b = shape(), shape()
        inside, outside = geo.sweep_areas(dict_rings([a]), [dict_rings([b])])
        assert inside == pytest.approx(geo._clip(np.array(a), np.array(b)), abs=1e-9)
        x, y = np.array(a).T
        assert inside + outside == pytest.approx(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)
    many = [dict_rings(box(rng.uniform(0, 9), rng.uniform(0, 9), rng.uniform(0.2, 1.5), rng.uniform(0.2, 1.5))) for _ in range(120)]
    inside, outside = geo.sweep_areas(dict_rings(box(1, 1, 8, 8)), many)  # is cut into quarters
    n = 2000
    at = 1 + (np.arange(n) + 0.5) * 8 / n
    hit = np.zeros((n, n), bool)
    for ring in many:
        (x0, y0), (x1, y1) = ((ring[0][i]["x"], ring[0][i]["y"]) for i in (0, 2))
        hit |= ((at >= x0) & (at < x1))[:, None] & ((at >= y0) & (at < y1))[None]
    assert inside == pytest.approx(hit.mean() * 64, rel=2e-3) and inside + outside == pytest.approx(64.0)


def test_union_coverage_counts_overlaps_once_and_cuts_large_polygons(spark):
    a = spark.createDataFrame([(1, box(0, 0, 1, 1)), (2, box(5, 5, 10, 10)), (3, box(50, 50, 1, 1)), (4, [box(0, 0, 1, 1)[0], box(0.25, 0.25, 0.5, 0.5)[0]]), (5, [box(0, 0, 1, 1)[0], [(0.8, 0.2), (0.9, 0.2), (0.8, 0.4)]])], f"k int, shape {POLY}")
    b = spark.createDataFrame([(box(0, 0, 0.5, 1),), (box(0.25, 0, 0.5, 1),), (box(0.25, 0, 0.5, 1),), (box(4, 4, 6, 6),), (box(9, 4, 3, 6),), (box(5.5, 5.5, 0.1, 0.1),)], f"other {POLY}")
    for size in (0.3, 2.0, 100.0):
        got = {r.k: (r.covered, r.bare) for r in spatial.union_coverage(a, b, "k", "shape", "other", size).collect()}
        assert {k: pytest.approx(v) for k, v in got.items()} == {1: (0.75, 0.25), 2: (35.0, 65.0), 3: (0.0, 1.0), 4: (0.75 - 0.25, 0.25), 5: (0.75, 0.24)}


def test_sweep_areas_with_slanted_sides_that_leave_the_clip_and_with_dense_squares():
    triangle, around = dict_rings([[(0, 0), (4, 0), (0, 4)]]), dict_rings(box(-1, -1, 9, 9))
    assert geo.sweep_areas(triangle, [around], (1, 1, 2.5, 9)) == pytest.approx((2.0 - 0.125, 0.0))
    rng = random.Random(6)
    many = [dict_rings(box(rng.uniform(0, 0.08), rng.uniform(0, 0.08), 0.02, 0.02)) for _ in range(2000)]
    pieces = geo.sweep_pieces(many, (0.03, 0.03, 0.05, 0.05))  # every quarter of a quarter is held by one square
    assert len(pieces) <= 64 and sum((p[1] - p[0]) * (p[4] - p[2]) for p in pieces) == pytest.approx(0.0004)


def test_union_of_slanted_polygons_in_many_cells(spark):
    rng = random.Random(8)
    shape = lambda r: [[(c[0] + r * math.cos(t), c[1] + r * math.sin(t)) for t in sorted(rng.uniform(0, 2 * math.pi) for _ in range(5))] for c in [(rng.uniform(0, 4), rng.uniform(0, 4))]]
    others, shapes = [shape(rng.uniform(0.1, 0.8)) for _ in range(60)], [shape(0.7) for _ in range(12)]
    a, b = spark.createDataFrame(list(enumerate(shapes)), f"k int, shape {POLY}"), spark.createDataFrame([(o,) for o in others], f"other {POLY}")
    got = {r.k: (r.covered, r.bare) for r in spatial.union_coverage(a, b, "k", "shape", "other", 2.0).collect()}
    n = 250
    for k, ring in enumerate(shapes):
        low, high = np.array(ring[0]).min(0), np.array(ring[0]).max(0)
        x, y = (v.ravel() for v in np.meshgrid(*(low[i] + (np.arange(n) + 0.5) * (high[i] - low[i]) / n for i in (0, 1))))

        def inside(p):
            odd = np.zeros(len(x), bool)
            for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1]):
                odd ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / ((y2 - y1) or 1.0) + x1)
            return odd

        mine, any_ = inside(ring[0]), np.zeros(len(x), bool)
        for o in others:
            any_ |= inside(o[0])
        share = (high - low).prod() / len(x)
        assert got[k] == pytest.approx(((mine & any_).sum() * share, (mine & ~any_).sum() * share), abs=8e-3)


def test_attached_classes(spark):
    lots = spark.createDataFrame([(k, box(k * 20.0, 0.0, 20.0, 30.0)) for k in range(9)] + [(20, box(500.0, 0.0, 20.0, 30.0)), (21, None)], f"k int, lot {POLY}")
    b = [
        (0, 2, 5, 10, 10), (1, 21, 5, 10, 10), (2, 44, 5, 19, 10), (3, 70, 20, 5, 5), (4, 82, 5, 17.5, 10), (5, 100, 5, 20, 10), (6, 122, 5, 10, 10),
        (60, 132.5, 5, 8.0, 10), (7, 161, 5, 45, 10), (20, 505, 5, 10, 10), (21, 505, 16.4, 6, 6), (22, 516.4, 5, 2.0, 30),
    ]
    buildings = spark.createDataFrame([(i, box(float(x), float(y), float(w), float(h))) for i, x, y, w, h in b], f"b int, f {POLY}")
    got = {r.k: (r.kind, r.n_close) for r in spatial.attached_class(lots, buildings, "k", "lot", "b", "f").collect()}
    assert got[0] == ("detached", 0)
    assert got[1] == ("detached", 0)
    assert got[2] == ("semi", 0)  # three metres of the building lie on the next lot
    assert got[3] == ("vacant", 0)  # a shed of 25 m2 and a strip of the neighbour's house
    assert got[4] == ("semi", 1)
    assert got[5] == ("semi", 1)
    assert got[6] == ("detached", 0)  # the second building on the lot is its own
    assert got[7] == ("vacant", 0)
    assert got[8] == ("row", 0)  # most of the building lies on other lots
    assert got[20] == ("detached", 0)  # close ones are too small or its own
    assert got[21] == ("vacant", 0)


@pytest.mark.parametrize("cap, first", [(5000.0, 250.0), (800.0, 250.0), (20_000.0, 100.0), (100.0, 250.0)])
def test_nearest_matches_brute_force(spark, cap, first):
    rng = random.Random(int(cap))
    left = [(i, rng.uniform(-79.5, -79.3), rng.uniform(43.6, 43.8)) for i in range(150)] + [(900 + i, rng.uniform(10, 11), rng.choice([0.01, 79.2, 84.9, 88.0])) for i in range(40)]
    left += [left[0], left[0], (700, None, 43.7), (701, -79.4, 43.7)]
    right = [(i, rng.uniform(-79.45, -79.35), rng.uniform(43.65, 43.75)) for i in range(60)] + [(500 + i, rng.uniform(10, 11), rng.choice([0.0, 79.2, 84.91, 88.01])) for i in range(60)]
    right += [(300, right[5][1], right[5][2]), (2, None, None)]
    got = sorted((r.k, r.nearest_id, round(r.dist_m, 6)) for r in spatial.nearest(spark.createDataFrame(left, "k int, x double, y double"), spark.createDataFrame(right, "r int, rx double, ry double"), "k", "x", "y", "r", "rx", "ry", cap, first).collect())
    want = []
    for k, x, y in left:
        d = sorted((haversine(x, y, rx, ry), r) for r, rx, ry in right if rx is not None) if x is not None else []
        want.append((k, d[0][1], round(d[0][0], 6)) if d and d[0][0] <= cap else (k, None, cap))
    assert [(k, r) for k, r, _ in got] == [(k, r) for k, r, _ in sorted(want, key=lambda w: (w[0], w[1] is None, w[1], w[2]))] or sorted(map(str, got)) == sorted(map(str, want))
    assert all(abs(a[2] - b[2]) < 1e-3 for a, b in zip(sorted(got, key=lambda g: (g[0], g[2])), sorted(want, key=lambda g: (g[0], g[2]))))


def test_nearest_of_nothing(spark):
    left = spark.createDataFrame([(1, -79.4, 43.7)], "k int, x double, y double")
    right = spark.createDataFrame([], "r int, rx double, ry double")
    assert [tuple(r) for r in spatial.nearest(left, right, "k", "x", "y", "r", "rx", "ry", 5000.0).collect()] == [(1, None, 5000.0)]


def test_nearest_has_two_joins(spark):
    left, right = spark.createDataFrame([(1, 0.0, 0.0)], "k int, x double, y double"), spark.createDataFrame([(1, 0.0, 0.0)], "r int, rx double, ry double")
    plan = spatial.nearest(left, right, "k", "x", "y", "r", "rx", "ry", 5000.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2


def crowd(spark, n=2000):
    """Nine points of ten within one cell of the grid."""
    rng = random.Random(7)
    near = lambda: (-79.39 + rng.random() * 0.004, 43.65 + rng.random() * 0.004)
    far = lambda: (rng.uniform(-79.6, -79.2), rng.uniform(43.5, 43.9))
    points = [(i, *(near() if i % 10 else far())) for i in range(n)] + [(n, None, None)]
    shapes = [(i, box(*(near() if i % 2 else far()), rng.uniform(0.0002, 0.002), rng.uniform(0.0002, 0.002))) for i in range(60)]
    shapes += [(100, box(-79.6, 43.5, 0.4, 0.4)), (101, box(-79.395, 43.645, 0.02, 0.02)), (102, None), (103, box(-100.0, 0.0, 60.0, 80.0))]
    return spark.createDataFrame(points, "k int, x double, y double"), spark.createDataFrame(shapes, f"s int, shape {POLY}"), points, shapes


def test_crowded_cells_are_cut_and_results_stay(spark):
    p, s, points, shapes = crowd(spark)
    want = sorted((k, i) for k, x, y in points for i, b in shapes if x is not None and b and b[0][0][0] <= x < b[0][2][0] and b[0][0][1] <= y < b[0][2][1])
    for dense in (20, 10**9):
        got = sorted((r.k, r.s) for r in spatial.points_in_polygons(p, s, "x", "y", "shape", dense=dense).select("k", "s").collect())
        assert got == want
    cells = spatial.point_cells(p.where("x IS NOT NULL"), "x", "y", 0.02)
    largest = lambda df, *by: df.groupBy("_lv", *by).count().where("_lv = 0").agg(F.max("count")).first()[0]
    leaves = spatial.points_by_leaf(cells, spatial.dense_cells(cells, "x", "y", 0.02, 20), "x", "y", 0.02)
    assert largest(cells, "_cx", "_cy") >= 1700 and largest(leaves, "_dp", "_sx", "_sy") <= 60 and leaves.count() == cells.count()


def test_crowded_cells_of_a_radius_join_are_shared_out(spark):
    p, _, points, _ = crowd(spark, 700)
    r = p.where("k % 7 = 0").select(F.col("k").alias("r"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    pairs = lambda dense: sorted((a.k, a.r) for a in spatial.within_radius(p, r, "x", "y", "rx", "ry", 150.0, dense).select("k", "r").collect())
    some = [q for q in points if q[0] % 7 == 0 and q[1] is not None]
    assert pairs(10) == pairs(10**9) == sorted((k, i) for k, x, y in points if x is not None for i, rx, ry in some if haversine(x, y, rx, ry) <= 150.0)


def test_points_in_circles_of_different_sizes(spark):
    rng = random.Random(11)
    points = [(i, rng.uniform(-79.5, -79.3), rng.uniform(43.6, 43.8)) for i in range(300)]
    circles = [(i, rng.uniform(-79.5, -79.3), rng.uniform(43.6, 43.8), rng.choice([0.0, 50.0, 500.0, 5000.0, 40_000.0])) for i in range(30)]
    got = sorted((r.k, r.c) for r in spatial.points_in_circles(spark.createDataFrame(points, "k int, x double, y double"), spark.createDataFrame(circles, "c int, cx double, cy double, m double"), "x", "y", "cx", "cy", "m").select("k", "c").collect())
    assert got == sorted((k, c) for k, x, y in points for c, cx, cy, m in circles if haversine(x, y, cx, cy) <= m)


def test_claims_by_address_come_first_and_each_record_is_claimed_once(spark):
    parcels = spark.createDataFrame([(1, "1 MAIN", box(0, 0, 2, 2)), (2, "", box(1, 1, 2, 2)), (3, None, box(1, 1, 3, 3)), (4, "9 KING", box(10, 10, 1, 1)), (5, "1 MAIN", box(20, 20, 1, 1))], f"k int, a string, lot {POLY}")
    records = spark.createDataFrame(
        [(10, "1 MAIN", 1.5, 1.5, 1), (11, "1 MAIN", 50.0, 50.0, 3), (12, "", 1.5, 1.5, 2), (13, "7 ELM", 2.5, 2.5, 5), (14, None, 3.5, 3.5, 4), (15, None, 10.5, 10.5, 9), (16, None, 99.0, 99.0, 1), (17, None, None, None, 1)],
        "r int, ra string, x double, y double, rank int")
    got, left = spatial.claimed_records(parcels, records, "k", "a", "lot", "r", "ra", "x", "y", "rank")
    # record 12 lies in parcels 1 (has its address), 2 and 3: the smaller of the open ones; 10 is never told by its point
    assert sorted(tuple(r) for r in got.collect()) == [(1, "address", 3, 2), (2, "point", 5, 2), (3, "point", 4, 1), (4, "point", 9, 1), (5, "address", 3, 2)]
    assert sorted(r.r for r in left.collect()) == [16, 17]


def test_exclusion_shapes(spark):
    polygons = spark.createDataFrame([(1, box(-79.40, 43.65, 0.002, 0.002), None), (2, box(-79.30, 43.65, 0.002, 0.002), True), (3, box(-79.20, 43.65, 0.002, 0.002), False)], f"p int, shape {POLY}, tag boolean")
    nodes = spark.createDataFrame([(10, -79.399, 43.651, None), (11, -79.3995, 43.6531, None), (12, -79.25, 43.7, False), (13, -79.399, 43.651, True)], "n int, x double, y double, door boolean")
    kept, circles = spatial.exclusion_shapes(polygons, nodes, "p", "shape", F.col("tag"), "n", "x", "y", F.col("door"))
    assert sorted(r.p for r in kept.collect()) == [1, 2]
    assert sorted((r.n, r.radius) for r in circles.collect()) == [(11, 100.0), (12, 100.0), (13, 50.0)]


def names(rng, n, first):
    words = ["SONAR", "BANGLA", "SONARBANGLA", "TEA", "TEAROOM", "PHO", "KING", "KINGS", "ABC", "ABCD", "XABCDX", "Q1", "NOODLE", "OODLE"]
    return [(first + i, [rng.choice(words) for _ in range(rng.randint(0, 6))], rng.choice(["A", "B", None]), rng.randint(1, 3), -79.4 + rng.random() * 0.01, 43.65 + rng.random() * 0.01) for i in range(n)]


def overlap(a, b):
    a, b = list(dict.fromkeys(a)), list(dict.fromkeys(b))
    same = lambda x, y: x == y or (len(x) >= 4 and x in y) or (len(y) >= 4 and y in x)
    return sum(any(same(x, y) for y in b) for x in a) / max(len(a), len(b)) if a and b else 0.0


@pytest.mark.parametrize("least", [0.05, 0.25, 0.5, 1.0])
def test_name_pairs_lose_no_match(spark, least):
    rng = random.Random(int(least * 100))
    a, b = names(rng, 80, 0), names(rng, 80, 500)
    schema = "k int, w array<string>, s string, n int, x double, y double"
    left, right = (spark.createDataFrame(v, schema).withColumn("w", F.array_distinct("w")) for v in (a, b))
    met = {tuple(r) for r in matching.name_pairs(left, right.withColumnRenamed("k", "c").withColumnRenamed("w", "cw"), ["s", "n"], "k", "w", "c", "cw", least).collect()}
    want = {(p[0], q[0]) for p in a for q in b if p[2] is not None and p[2:4] == q[2:4] and overlap(p[1], q[1]) >= least}
    block = {(p[0], q[0]) for p in a for q in b if p[2] is not None and p[2:4] == q[2:4]}
    assert want <= met < block


def test_places_by_address_then_by_name_nearby(spark):
    rng = random.Random(9)
    a, b = names(rng, 60, 0), names(rng, 60, 500)
    schema = "{} int, w array<string>, s string, n int, x double, y double"
    left, right = (spark.createDataFrame(v, schema.format(c)).withColumn("w", F.array_distinct("w")) for v, c in ((a, "k"), (b, "c")))
    got = {r.k: (r.c, r.via) for r in matching.match_places(left, right, "k", "w", "s", "n", "x", "y", "c", 250.0).collect()}
    want = {}
    for k, w, s, n, x, y in a:
        first = [(-overlap(w, q[1]), q[0]) for q in b if s is not None and (s, n) == q[2:4] and overlap(w, q[1]) >= 0.25]
        near = [(-overlap(w, q[1]), q[0]) for q in b if haversine(x, y, q[4], q[5]) <= 250.0 and overlap(w, q[1]) >= 0.2]
        if first or near:
            want[k] = (min(first or near)[1], "address" if first else "near")
    assert got == want and {v for _, v in got.values()} == {"address", "near"}


def test_shadows_have_the_areas_of_their_closed_forms(spark):
    square = box(0, 0, 10, 10)
    triangle = [[(0.0, -6.0), (10.0, -6.0), (5.0, -1.0)]]
    lots = spark.createDataFrame([(1, square), (2, box(1000, 0, 10, 10)), (3, box(2000, 0, 10, 10)), (4, box(3000, 0, 10, 10)), (5, box(4000, 0, 10, 10))], f"lot_id int, lot {POLY}")
    b = [(triangle, 8.0), (triangle, 8.0), (box(1000, -1, 10, 1), None), (box(2000, -2, 10, 1), 0.5), (box(2000, -1, 10, 1), None), ([[(3005.0, 5.0)] * 3], 2.0), (box(4000, 300, 10, 10), 50.0)]
    buildings = spark.createDataFrame(b, f"f {POLY}, h double")
    from parcelflow.plans import pipelines

    shade = lambda **k: {r.lot_id: (r.share, r.quality) for r in pipelines.unshaded_share(lots, buildings, "lot", "f", "h", [(180.0, 45.0)], **k).collect()}
    got = shade()
    # the triangle's tip passes 8 m up: below y = 2 the full width, above it the tip
    assert got[1] == (pytest.approx(1 - (2 * 10 + 25) / 100, abs=1e-9), "measured")
    assert got[2] == (None, "unavailable") and got[3] == (1.0, "measured") and got[5] == (1.0, "measured")
    corners = 64
    assert got[4] == (pytest.approx(1 - corners / 2 * 4 * math.sin(2 * math.pi / corners) / 100, abs=1e-9), "estimated")
    ends = shade(swept=False)  # only the copy at the end: a triangle from y = 2 to y = 7
    assert ends[1][0] == pytest.approx(1 - 25 / 100, abs=1e-9)
    assert shade(most=1)[3] == (None, "unavailable")  # the nearest building there has no height


def test_long_segments_pass_few_cells_and_touch_what_brute_force_finds(spark):
    import random

    rnd = random.Random(5)
    lots = [(k, rnd.random(), rnd.random()) for k in range(60)]
    segs = [(s, *(rnd.random() for _ in range(4))) for s in range(40)] + [(40, 0.5, 0.0, 0.5, 1.0), (41, 0.0, 0.5, 1.0, 0.5), (42, 0.3, 0.3, 0.3, 0.3)]
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    c = F.col
    lot = spark.createDataFrame(lots, "k long, x double, y double").select("k", "x", "y", F.array(F.array(point(c("x"), c("y")), point(c("x") + 0.02, c("y")), point(c("x") + 0.02, c("y") + 0.03), point(c("x"), c("y") + 0.03))).alias("lot"))
    line = spark.createDataFrame(segs, "s long, ax double, ay double, bx double, b_y double").select((c("s") % 7).alias("name"), F.array(point(c("ax"), c("ay")), point(c("bx"), c("b_y"))).alias("line"))
    cells = spatial.segment_cells(line.select(F.explode(spatial.geo.segments(c("line"))).alias("_s")), "_s", 0.01)
    assert cells.count() <= 43 * 203  # the boxes have 1,000 and more
    both = lot.crossJoin(line)
    for reach in (0.0, 0.004, 0.05):
        want = both.where(spatial.geo.boundary_gap(c("lot"), F.struct(c("line")[0].alias("a"), c("line")[1].alias("b"))) <= reach).groupBy("k").agg(F.countDistinct("name").alias("n"))
        want = {r.k: r.n for r in want.collect()}
        got = {r.k: r.n_lines for r in spatial.lines_touched(lot, line, "k", "lot", "line", "name", reach).collect()}
        assert got == {k: want.get(k, 0) for k, _, _ in lots}, reach
    for reach in (0.001, 0.02, 0.5):
        want = {r.k: r.d for r in both.groupBy("k").agg(F.min(spatial.geo.path_distance(c("x"), c("y"), c("line"))).alias("d")).collect()}
        got = {r.k: r.dist_m for r in spatial.nearest_line(lot, line, "k", "x", "y", "line", reach, 1.0, 9.0).collect()}
        assert got == {k: d if d <= reach else 9.0 for k, d in want.items()}, reach


def test_nearest_few_of_dense_rows_joins_few_of_them(spark):
    import random

    rnd = random.Random(9)
    left = spark.createDataFrame([(k, 10 + rnd.random() * 0.02, 50 + rnd.random() * 0.02) for k in range(40)] + [(40, None, 50.0), (41, 11.0, 50.0)], "k long, x double, y double")
    spots = [(10 + rnd.random() * 0.02, 50 + rnd.random() * 0.02) for _ in range(300)]
    right = spark.createDataFrame([(s, *spots[s % 300]) for s in range(900)], "s long, sx double, sy double")  # three in each place
    c = F.col
    d = left.crossJoin(right).withColumn("d", spatial.geo.haversine(c("x"), c("y"), c("sx"), c("sy"))).where("d <= 600")
    want = {k: [] for k in range(42)}
    for r in d.select("k", "s", "d").collect():
        want[r.k].append((r.d, r.s))
    for n in (1, 5):
        got = {r.k: [(b._d, b._rid) for b in r._best] for r in spatial.nearest_few(left, right, "k", "x", "y", "s", "sx", "sy", n, 600.0).collect()}
        assert got == {k: sorted(v)[:n] for k, v in want.items()}, n


def test_quadrants_against_every_pair_in_small_blocks(spark):
    rng = random.Random(12)
    left = [(k, -79.4 + rng.random() * 0.05, 43.6 + rng.random() * 0.05) for k in range(60)]
    right = [(100 + k, -79.4 + rng.random() * 0.05, 43.6 + rng.random() * 0.05, rng.choice([None, rng.random()])) for k in range(80)]
    right += [(7, *left[7][1:], 5.0), (8, *left[9][1:], 6.0), (9, left[3][1], left[3][2] + 0.003, 7.0)]  # itself, the same place, due north
    l, r = spark.createDataFrame(left, "k long, x double, y double"), spark.createDataFrame(right, "s long, sx double, sy double, v double")
    want = {}
    for k, x, y in left:
        for s, sx, sy, v in right:
            if s != k and haversine(x, y, sx, sy) <= 2000:
                d, a, b = math.radians(sx - x), math.radians(y), math.radians(sy)
                deg = (math.degrees(math.atan2(math.sin(d) * math.cos(b), math.cos(a) * math.sin(b) - math.sin(a) * math.cos(b) * math.cos(d))) + 360) % 360
                q = "n" if deg >= 315 or deg < 45 else "e" if deg < 135 else "s" if deg < 225 else "w"
                want.setdefault(k, {c: [] for c in "nesw"})[q] += [] if v is None else [v]
    want = {k: tuple(sum(q[c]) / len(q[c]) if q[c] else None for c in "nesw") for k, q in want.items() if any(q.values())}
    for block in (4, 1024):
        got = {t.k: (t.avg_n, t.avg_e, t.avg_s, t.avg_w) for t in spatial.quadrants(l, r, "k", "x", "y", "s", "sx", "sy", "v", 2000.0, block).collect()}
        assert got.keys() == want.keys()
        for k, v in want.items():
            assert got[k] == tuple(None if c is None else pytest.approx(c) for c in v)


def test_inside_lengths_of_many_segments_at_once():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    shape = [box(0, 0, 1, 1)[0], box(0.4, 0.4, 0.2, 0.2)[0]]
    ends = rng.uniform(-0.5, 1.5, (4, 200))
    rings = pa.array([dict_rings(shape)] * 200, pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
    got = geo.inside_lengths(*ends, geo._flat_edges(rings))
    t = (np.arange(20_000) + 0.5) / 20_000
    for (ax, ay, bx, by), m in zip(ends.T, got):
        x, y = ax + t * (bx - ax), ay + t * (by - ay)
        inside = (x > 0) & (x < 1) & (y > 0) & (y < 1) & ~((x > 0.4) & (x < 0.6) & (y > 0.4) & (y < 0.6))
        assert m == pytest.approx(inside.mean() * haversine(ax, ay, bx, by), abs=60)


def test_least_polygon_among_many_over_each_other(spark):
    rng = random.Random(14)
    shapes = [(k, box(rng.uniform(0, 3), rng.uniform(0, 3), rng.uniform(0.5, 1.5), rng.uniform(0.5, 1.5))) for k in range(80)]
    shapes = [(k, s + box(s[0][0][0] + 0.1, s[0][0][1] + 0.1, 0.3, 0.3) if k % 2 else s) for k, s in shapes] + [(99, None)]
    points = [(i, rng.uniform(-0.5, 4.5), rng.uniform(-0.5, 4.5)) for i in range(400)] + [(999, None, 1.0)]
    inside = lambda x, y, r: r[0][0] <= x < r[1][0] and r[0][1] <= y < r[2][1]
    want = {}
    for i, x, y in points[:-1]:
        held = [k for k, s in shapes[:-1] if inside(x, y, s[0]) and not any(inside(x, y, h) for h in s[1:])]
        if held:
            want[i] = min(held)
    p, s = spark.createDataFrame(points, "i int, x double, y double"), spark.createDataFrame(shapes, f"k int, shape {POLY}")
    assert {r.i: r.k for r in spatial.least_polygon(p, s, ["i"], "x", "y", "shape", "k").collect()} == want


def test_cells_of_nearest_lines_are_not_sent_through_the_driver(spark):
    points = spark.range(40).selectExpr("id AS k", "id * 0.0005 AS x", "id * 0.0003 AS y")
    lines = spark.range(9).selectExpr("array(struct(id * 0.002 AS x, 0.0D AS y), struct(0.02D AS x, id * 0.001 AS y)) AS line")
    d = spatial.nearest_line(points, lines, "k", "x", "y", "line")
    assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()
    want = points.crossJoin(lines).groupBy("k").agg(F.min(geo.path_distance(F.col("x"), F.col("y"), F.col("line"))).alias("d"))
    assert {r.k: r.dist_m for r in d.collect()} == {r.k: r.d * 95_000 for r in want.collect()}


def test_cells_of_nearest_and_radius_joins_are_not_sent_through_the_driver(spark):
    left = spark.range(40).selectExpr("id AS k", "id * 0.0005 AS x", "id * 0.0003 AS y")
    right = spark.range(9).selectExpr("id AS r", "id * 0.002 AS rx", "id * 0.001 AS ry")
    near = spatial.nearest(left, right, "k", "x", "y", "r", "rx", "ry", 5000.0)
    within = spatial.within_radius(left, right, "x", "y", "rx", "ry", 250.0)
    assert not any("Broadcast" in d._jdf.queryExecution().executedPlan().toString() for d in (near, within))
    d = left.crossJoin(right).withColumn("d", geo.haversine(F.col("x"), F.col("y"), F.col("rx"), F.col("ry")))
    want = d.groupBy("k").agg(F.min(F.struct("d", "r")).alias("m"), F.count_if(F.col("d") <= 250).alias("n")).collect()
    assert {r.k: (r.nearest_id, r.dist_m) for r in near.collect()} == {r.k: (r.m.r, r.m.d) for r in want}
    assert within.count() == sum(r.n for r in want) > 0


def test_letter_groups_of_names_are_not_sent_through_the_driver(spark):
    p = spark.range(40).selectExpr("id AS k", "array(concat('NAME', id % 5), 'SHOP') AS w", "CASE WHEN id % 3 > 0 THEN 'S' END AS st", "1 AS no", "id * 0.0001 AS x", "50.0D AS y")
    found = matching.match_places(p, p.withColumnRenamed("k", "c"), "k", "w", "st", "no", "x", "y", "c", other=True)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    first = lambda k, ids: min(ids, key=lambda c: (c % 5 != k % 5, c))
    want = {k: first(k, [c for c in range(40) if c != k and (c % 3 if k % 3 else abs(c - k) * 0.0001 * 111_195 * math.cos(math.radians(50)) <= 250)]) for k in range(40)}
    assert {r.k: r.c for r in found.collect()} == want
    assert {r.k: r.via for r in found.collect()} == {k: "address" if k % 3 else "near" for k in range(40)}


def test_cells_of_parcel_surroundings_are_not_sent_through_the_driver(spark):
    from parcelflow.plans import pipelines

    square = "array(array(struct({0} AS x, {1} AS y), struct({0} + {2} AS x, {1} AS y), struct({0} + {2} AS x, {1} + {2} AS y), struct({0} AS x, {1} + {2} AS y)))"
    x, y = "(id % 50) * 0.001D", "floor(id / 50) * 0.001D"
    lots = spark.range(2500).selectExpr("id AS lot_id", f"{x} AS x", f"{y} AS y", square.format(x, y, "0.0008D") + " AS shape")
    # every second lot has a house on half of its area, that reaches a quarter into the lot above, and a slanted one inside that adds nothing
    houses = spark.range(2500).where("id % 2 = 0").selectExpr(square.format(x, f"({y} + 0.0004D)", "0.0008D") + " AS footprint")
    slanted = spark.range(2500).where("id % 2 = 0").selectExpr(f"array(array(struct({x} AS x, {y} + 0.0005D AS y), struct({x} + 0.0008D AS x, {y} + 0.0006D AS y), struct({x} AS x, {y} + 0.0007D AS y))) AS footprint")
    streets = spark.range(3).selectExpr("array(struct(id * 0.0001D AS x, -1.0D AS y), struct(id * 0.0001D AS x, 1.0D AS y)) AS line", "id % 2 AS name", "id = 2 AS is_lane")
    addresses = spark.range(2500).selectExpr(f"{x} + 0.0004D AS x", f"{y} + 0.0004D AS y", "1 AS address")
    d = pipelines.parcel_surroundings(lots, streets, houses.unionByName(slanted), addresses, 0.0005)
    assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()
    got = d.collect()
    assert len(got) == 2500 and all(r.points == 1 and r.addresses == 1 for r in got)
    for r in got:
        assert r.coverage == pytest.approx((0.5 + 0.25 * (r.lot_id >= 50)) * (r.lot_id % 2 == 0), abs=1e-9) and r.bare == pytest.approx(1 - r.coverage, abs=1e-9)
        assert (r.corner, r.lane) == (r.lot_id % 50 == 0, r.lot_id % 50 == 0), r
        assert r.street_m == pytest.approx(95_000 * max(r.lot_id % 50 * 0.001 - 0.0001, 0) if r.lot_id % 50 <= 20 else 99_999, abs=1e-6), r


def test_count_and_nearest_within_a_radius_against_every_pair(spark):
    rng = random.Random(21)
    left = [(k, -79.4 + rng.random() * 0.05, 43.6 + rng.random() * 0.05) for k in range(60)] + [(900, None, 43.6), (901, 10.0, 10.0)]
    right = [(100 + k, -79.4 + rng.random() * 0.05, 43.6 + rng.random() * 0.05, rng.choice([None, rng.random()])) for k in range(80)]
    right += [(7, *left[7][1:], 5.0), (8, *left[9][1:], 6.0), (6, *left[9][1:], 7.0), (990, None, 43.6, 1.0)]  # itself; two in one place
    l, r = spark.createDataFrame(left, "k long, x double, y double"), spark.createDataFrame(right, "s long, sx double, sy double, v double")
    want = {}
    for k, x, y in left:
        d = sorted(((haversine(x, y, sx, sy), s, v) for s, sx, sy, v in right if None not in (x, sx) and s != k), key=lambda t: t[:2])
        if d and d[0][0] <= 1500:
            want[k] = (sum(t[0] <= 1500 for t in d), d[0][2])
    assert len(want) > 50 and want[9][1] == 7.0
    for block in (4, 1024):
        found = spatial.radius_nearest(l, r, "k", "x", "y", "s", "sx", "sy", "v", 1500.0, block)
        assert {t.k: (t.around, t.nearest_value) for t in found.collect()} == want


def test_radius_query_sorts_no_pairs(spark, data):
    from parcelflow.plans import registry

    plan = registry.queries()["J18_within_radius_nearest"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "ASIN" not in plan.upper()  # distances are told in blocks, not for a row of each pair
