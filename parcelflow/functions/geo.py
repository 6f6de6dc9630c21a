"""Geometry as column expressions on arrays of points; area of intersection and polygon distance in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
RADIUS_84, FLATTENING = 6_378_137.0, 1 / 298.257223563
RADIUS_80, FLATTENING_80 = 6_378_137.0, 1 / 298.257222101


def points(coords: list[tuple[Column | float, Column | float]]) -> Column:
    """A ring or line from coordinates."""
    c = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.array(*[F.struct(c(x).alias("x"), c(y).alias("y")) for x, y in coords])


def box_polygon(x: Column, y: Column, w: float, h: float) -> Column:
    return F.array(points([(x, y), (x + w, y), (x + w, y + h), (x, y + h)]))


def bbox(ring: Column) -> tuple[Column, Column, Column, Column]:
    """Xmin, ymin, xmax, ymax."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def in_bbox(x: Column, y: Column, ring: Column) -> Column:
    xmin, ymin, xmax, ymax = bbox(ring)
    return x.between(xmin, xmax) & y.between(ymin, ymax)


def _edges(ring: Column) -> Column:
    """Array of (a, b) for every edge of a ring."""
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _segments(line: Column) -> Column:
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, 1, n), F.slice(line, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def segments(line: Column) -> Column:
    """Array of (a, b) for every segment of a line; none for fewer than two points."""
    return _segments(line)


def crossings(segment: Column, polygon: Column) -> Column:
    """Array of the places (0 to 1 along the segment) at which it crosses an edge of the polygon; parallel edges give none."""

    def at(e: Column) -> Column:
        px, py = segment["b"]["x"] - segment["a"]["x"], segment["b"]["y"] - segment["a"]["y"]
        qx, qy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        rx, ry = e["a"]["x"] - segment["a"]["x"], e["a"]["y"] - segment["a"]["y"]
        turn = px * qy - py * qx
        t, u = F.try_divide(rx * qy - ry * qx, turn), F.try_divide(rx * py - ry * px, turn)
        return F.when((t > 0) & (t < 1) & (u >= 0) & (u <= 1), t)

    return F.filter(F.transform(F.flatten(F.transform(polygon, _edges)), at), lambda t: t.isNotNull())


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting."""
    crosses = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])
    return F.size(F.filter(_edges(ring), crosses)) % 2 == 1


def point_in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Inside the outer ring and in no hole."""
    holes = F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0)))
    return in_bbox(x, y, polygon[0]) & point_in_ring(x, y, polygon[0]) & ~F.exists(holes, lambda r: point_in_ring(x, y, r))


def _to_segment(x: Column, y: Column, a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.coalesce(F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    ex, ey = x - (a["x"] + t * dx), y - (a["y"] + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def path_distance(x: Column, y: Column, line: Column) -> Column:
    """Distance to a line, in the units of the coordinates."""
    return F.array_min(F.transform(_segments(line), lambda e: _to_segment(x, y, e["a"], e["b"])))


def boundary_distance(x: Column, y: Column, polygon: Column) -> Column:
    return F.array_min(F.transform(F.flatten(F.transform(polygon, _edges)), lambda e: _to_segment(x, y, e["a"], e["b"])))


def segment_gap(s: Column, e: Column) -> Column:
    """Least distance of two segments (a, b), 0 where they cross, in the units of the coordinates."""
    turn = lambda o, p, q: F.signum((p["x"] - o["x"]) * (q["y"] - o["y"]) - (p["y"] - o["y"]) * (q["x"] - o["x"]))
    cross = (turn(s["a"], s["b"], e["a"]) * turn(s["a"], s["b"], e["b"]) < 0) & (turn(e["a"], e["b"], s["a"]) * turn(e["a"], e["b"], s["b"]) < 0)
    ends = [_to_segment(p["x"], p["y"], o["a"], o["b"]) for p, o in ((s["a"], e), (s["b"], e), (e["a"], s), (e["b"], s))]
    return F.when(cross, 0.0).otherwise(F.least(*ends))


def boundary_gap(polygon: Column, segment: Column) -> Column:
    """Least distance of a segment from the boundary of a polygon (all rings), not from its inside."""
    return F.array_min(F.transform(F.flatten(F.transform(polygon, _edges)), lambda e: segment_gap(e, segment)))


def haversine(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Metres on a sphere."""
    dy, dx = F.radians(y2 - y1) / 2, F.radians(x2 - x1) / 2
    h = F.sin(dy) * F.sin(dy) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.sin(dx) * F.sin(dx)
    return 2 * EARTH_M * F.asin(F.sqrt(h))


def bearing(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Initial bearing in degrees, 0 north."""
    a, b, d = F.radians(y1), F.radians(y2), F.radians(x2 - x1)
    deg = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.pmod(deg + 360.0, F.lit(360.0))


def quadrant(deg: Column) -> Column:
    return F.when((deg >= 315) | (deg < 45), "N").when(deg < 135, "E").when(deg < 225, "S").otherwise("W")


def expand_bbox(y: Column, metres: float) -> tuple[Column, Column]:
    """Pads in degrees of longitude and latitude."""
    return F.lit(metres) / (F.lit(111_320.0) * F.cos(F.radians(y))), F.lit(metres / 110_540.0)


def signed_area(ring: Column) -> Column:
    """Shoelace area in square units of the coordinates."""
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2


def polygon_area_m2(polygon: Column) -> Column:
    """Outer ring minus holes, on the sinusoidal equal-area projection about the first point."""
    x0 = polygon[0][0]["x"]
    k = math.radians(1) * EARTH_M
    flat = lambda r: F.transform(r, lambda p: F.struct(((p["x"] - x0) * k * F.cos(F.radians(p["y"]))).alias("x"), (p["y"] * k).alias("y")))
    areas = F.transform(polygon, lambda r: F.abs(signed_area(flat(r))))
    return F.element_at(areas, 1) * 2 - F.aggregate(areas, F.lit(0.0), lambda s, a: s + a)


def centroid(ring: Column) -> Column:
    """Struct (x, y), taken about the ring's first point."""
    o = ring[0]
    cross = lambda e: (e["a"]["x"] - o["x"]) * (e["b"]["y"] - o["y"]) - (e["b"]["x"] - o["x"]) * (e["a"]["y"] - o["y"])
    total = F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + cross(e))
    mean = lambda c: o[c] + F.try_divide(F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e["a"][c] + e["b"][c] - 2 * o[c]) * cross(e)), 3 * total)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def inner_point(polygon: Column) -> Column:
    """The centroid where it is inside, else the middle of the longest inside chord at the ring's mid height."""
    c = centroid(polygon[0])
    _, ymin, _, ymax = bbox(polygon[0])
    mid = (ymin + ymax) / 2
    crossing = F.filter(F.flatten(F.transform(polygon, _edges)), lambda e: (e["a"]["y"] > mid) != (e["b"]["y"] > mid))
    xs = F.array_sort(F.transform(crossing, lambda e: e["a"]["x"] + (mid - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"])))
    chords = F.transform(F.sequence(F.lit(1), F.greatest(F.floor(F.size(xs) / 2), F.lit(1)).cast("int")), lambda i: F.struct((F.try_element_at(xs, i * 2) - F.try_element_at(xs, i * 2 - 1)).alias("w"), ((F.try_element_at(xs, i * 2) + F.try_element_at(xs, i * 2 - 1)) / 2).alias("x")))
    return F.when(point_in_polygon(c["x"], c["y"], polygon), c).otherwise(F.struct(F.array_max(chords)["x"].alias("x"), mid.alias("y")))


def transverse_mercator(lon: Column, lat: Column, lon0: float, scale: float, east: float, flattening: float = FLATTENING_80) -> Column:
    """Struct (x, y) in metres by Krueger's series to the third order."""
    n = flattening / (2 - flattening)
    a = RADIUS_80 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    k = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - k * F.atanh(k * s))
    d = F.radians(lon - lon0)
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    x = eta + sum((c * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(alpha, 1)), F.lit(0.0))
    y = xi + sum((c * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(alpha, 1)), F.lit(0.0))
    return F.struct((x * (scale * a) + east).alias("x"), (y * (scale * a)).alias("y"))


def to_utm17(lon: Column, lat: Column) -> Column:
    return transverse_mercator(lon, lat, -81.0, 0.9996, 500_000.0)


def from_transverse_mercator(x: Column, y: Column, lon0: float, scale: float, east: float, flattening: float = FLATTENING_80) -> Column:
    """Struct (lon, lat) in degrees."""
    n = flattening / (2 - flattening)
    a = RADIUS_80 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = y / (scale * a), (x - east) / (scale * a)
    u = xi - sum((c * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(beta, 1)), F.lit(0.0))
    v = eta - sum((c * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(beta, 1)), F.lit(0.0))
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi + sum((c * F.sin(2 * j * chi) for j, c in enumerate(delta, 1)), F.lit(0.0))
    return F.struct((F.degrees(F.atan2(F.sinh(v), F.cos(u))) + lon0).alias("lon"), F.degrees(lat).alias("lat"))


def from_mtm10(x: Column, y: Column) -> Column:
    return from_transverse_mercator(x, y, -79.5, 0.9999, 304_800.0)


def from_web_mercator(x: Column, y: Column) -> Column:
    """Struct (lon, lat)."""
    return F.struct(F.degrees(x / RADIUS_84).alias("lon"), F.degrees(2 * F.atan(F.exp(y / RADIUS_84)) - math.pi / 2).alias("lat"))


def min_rotated_rect(ring: Column) -> Column:
    """Struct (long, short, aspect, orientation in [0, 180)) of the smallest enclosing rectangle."""

    @F.arrow_udf("long double, short double, aspect double, orientation double")
    def run(rings: pa.Array) -> pa.Array:
        found = [_rect(r) for r in rings.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.float64()) for i in range(4)], names=["long", "short", "aspect", "orientation"])

    return run(ring)


def _rect(ring) -> tuple:
    p = np.array([(q["x"], q["y"]) for q in (ring if ring is not None else ())], float)
    if len(p) < 3:
        return (None, None, None, None)
    best = None
    for d in np.roll(p, -1, axis=0) - p:  # a smallest rectangle shares a direction with an edge of the hull, itself an edge or a pair of ring points
        length = math.hypot(*d)
        if not length:
            continue
        u = d / length
        a, b = p @ u, p @ np.array([-u[1], u[0]])
        w, h = np.ptp(a), np.ptp(b)
        if best is None or w * h < best[0]:
            best = (w * h, max(w, h), min(w, h), math.degrees(math.atan2(u[1], u[0])) + (90 if h > w else 0))
    if best is None:
        return (None, None, None, None)
    return best[1], best[2], best[1] / best[2] if best[2] else None, best[3] % 180


def _turns(ring: np.ndarray) -> np.ndarray:
    """Cross product of the two edges at every corner."""
    a, b = np.roll(ring, -1, axis=0) - ring, np.roll(ring, -2, axis=0) - np.roll(ring, -1, axis=0)
    return a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]


def _convex(ring: np.ndarray) -> bool:
    """Whether a ring turns one way at all corners, once around."""
    t = _turns(ring)
    if len(ring) < 3 or (t.min() < 0 < t.max()):
        return False
    d = np.roll(ring, -1, axis=0) - ring
    angle = np.arctan2(t, (d * np.roll(d, -1, axis=0)).sum(1))
    return bool(abs(abs(angle.sum()) - 2 * math.pi) < 1e-6)


def _clip(subject: np.ndarray, clip: np.ndarray) -> float:
    """Area of the subject ring inside a convex ring, cut edge by edge."""
    if _turns(clip).sum() < 0:
        clip = clip[::-1]
    out = subject
    for a, b in zip(clip, np.roll(clip, -1, axis=0)):
        if not len(out):
            return 0.0
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        kept = []
        for i in range(len(out)):
            j = (i + 1) % len(out)
            if side[i] >= 0:
                kept.append(out[i])
            if (side[i] >= 0) != (side[j] >= 0):
                kept.append(out[i] + (out[j] - out[i]) * (side[i] / (side[i] - side[j])))
        out = np.array(kept)
    if len(out) < 3:
        return 0.0
    x, y = out[:, 0], out[:, 1]
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def _triangles(ring: np.ndarray) -> list[np.ndarray]:
    """Signed fan of a ring about its first point, as triangles with their orientation."""
    return [ring[[0, i, i + 1]] for i in range(1, len(ring) - 1)]


def clip_area(a: Column, b: Column) -> Column:
    """Area of the intersection of two polygons without holes, in square units of the coordinates.

    A ring that is not convex is a signed sum of triangles of a fan, so the area is exact for any simple ring."""

    @F.arrow_udf("double")
    def run(first: pa.Array, second: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(first.to_pylist(), second.to_pylist()):
            x, y = (np.array([(v["x"], v["y"]) for v in r[0]], float) for r in (p, q))
            if _convex(y):
                out.append(_clip(x, y))
                continue
            total = 0.0
            for t in _triangles(y):
                turn = _turns(t)[0]
                for u in _triangles(x):
                    spin = _turns(u)[0]
                    if turn and spin:
                        total += np.sign(turn) * np.sign(spin) * _clip(u, t)
            out.append(abs(total))
        return pa.array(out, pa.float64())

    return run(a, b)


def polygon_distance(a: Column, b: Column) -> Column:
    """Least distance of two outer rings (0 where they cross or one is inside the other)."""

    @F.arrow_udf("double")
    def run(first: pa.Array, second: pa.Array) -> pa.Array:
        rings = zip(*([np.array([(v["x"], v["y"]) for v in p[0]], float) for p in side.to_pylist()] for side in (first, second)))
        return pa.array([_ring_distance(p, q) for p, q in rings], pa.float64())

    return run(a, b)


def _point_gap(p: np.ndarray, ring: np.ndarray) -> float:
    a, b = ring, np.roll(ring, -1, axis=0)
    d = b - a
    t = np.clip(((p[:, None, :] - a) * d).sum(2) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
    return float(np.sqrt(((p[:, None, :] - (a + t[..., None] * d)) ** 2).sum(2)).min())


def _inside(p: np.ndarray, ring: np.ndarray) -> bool:
    a, b = ring, np.roll(ring, -1, axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        hit = ((a[:, 1] > p[1]) != (b[:, 1] > p[1])) & (p[0] < (b[:, 0] - a[:, 0]) * (p[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0])
    return bool(hit.sum() % 2)


def _ring_distance(a: np.ndarray, b: np.ndarray) -> float:
    if _inside(a[0], b) or _inside(b[0], a):
        return 0.0
    turn = lambda o, p, q: np.sign((p - o)[..., 0] * (q - o)[..., 1] - (p - o)[..., 1] * (q - o)[..., 0])
    a2, b2 = np.roll(a, -1, axis=0), np.roll(b, -1, axis=0)
    p, p2, q, q2 = a[:, None, :], a2[:, None, :], b[None, :, :], b2[None, :, :]
    if ((turn(p, p2, q) * turn(p, p2, q2) < 0) & (turn(q, q2, p) * turn(q, q2, p2) < 0)).any():
        return 0.0
    return min(_point_gap(a, b), _point_gap(b, a))


def _edge_table(rings) -> np.ndarray:
    """Rows (x1, y1, x2, y2) with y1 < y2 of the edges of rings; level edges bound no area from the side."""
    out = []
    for ring in rings:
        a = np.array([(v["x"], v["y"]) for v in ring], float).reshape(-1, 2)
        out.append(np.hstack([a, np.roll(a, -1, axis=0)]))
    e = np.concatenate(out) if out else np.zeros((0, 4))
    e = e[e[:, 1] != e[:, 3]]
    return np.where((e[:, 1] > e[:, 3])[:, None], e[:, [2, 3, 0, 1]], e)


def _crossing_heights(e: np.ndarray) -> np.ndarray:
    """Heights at which edges cross one another, found edge by edge against the later ones."""
    out = []
    for i in range(len(e) - 1):
        a, rest = e[i], e[i + 1 :]
        rest = rest[(rest[:, 1] < a[3]) & (rest[:, 3] > a[1])]
        d, f = a[2:] - a[:2], rest[:, 2:] - rest[:, :2]
        turn = d[0] * f[:, 1] - d[1] * f[:, 0]
        g = rest[:, :2] - a[:2]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (g[:, 0] * f[:, 1] - g[:, 1] * f[:, 0]) / turn, (g[:, 0] * d[1] - g[:, 1] * d[0]) / turn
        t = t[(turn != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1)]
        out.append(a[1] + t * d[1])
    return np.concatenate(out) if out else np.zeros(0)


def _covers(edges: np.ndarray, box) -> bool:
    """Whether a polygon, as an edge table, holds a whole box (xmin, ymin, xmax, ymax)."""
    e = edges[(edges[:, 1] < box[3]) & (edges[:, 3] > box[1])]
    low, high = np.maximum(e[:, 1], box[1]), np.minimum(e[:, 3], box[3])
    slope = (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    x1, x2 = e[:, 0] + (low - e[:, 1]) * slope, e[:, 0] + (high - e[:, 1]) * slope
    left, right = np.maximum(x1, x2) <= box[0], np.minimum(x1, x2) >= box[2]
    if not (left | right).all():
        return False
    heights = np.unique(np.concatenate([low, high, [box[1], box[3]]]))
    mid = (heights[:-1] + heights[1:]) / 2
    over = left[:, None] & (low[:, None] < mid) & (high[:, None] > mid)
    return bool((over.sum(0) % 2 == 1).all())


def _sweep(parts: list[np.ndarray], box) -> list[tuple]:
    """Trapezoids of the union of polygons (edge tables) within a box, between neighbouring heights at which an edge ends,
    crosses another one or crosses a side of the box."""
    box = np.asarray(box, float)
    origin = box[[0, 1, 0, 1]].copy()
    box = box - origin
    edges = np.concatenate(parts) - origin
    owner = np.repeat(np.arange(len(parts)), [len(e) for e in parts])
    near = (edges[:, 1] < box[3]) & (edges[:, 3] > box[1])
    edges, owner = edges[near], owner[near]
    sides = np.array([[box[0], box[1], box[0], box[3]], [box[2], box[1], box[2], box[3]]])
    crossed = _crossing_heights(np.concatenate([edges, sides])) if (edges[:, 0] != edges[:, 2]).any() else np.zeros(0)
    heights = np.concatenate([edges[:, 1], edges[:, 3], crossed, box[[1, 3]]])
    heights = np.unique(heights[(heights >= box[1]) & (heights <= box[3])])
    slope = (edges[:, 2] - edges[:, 0]) / (edges[:, 3] - edges[:, 1])
    out = []
    for low, high in zip(heights[:-1], heights[1:]):
        here = np.flatnonzero((edges[:, 1] < (low + high) / 2) & (edges[:, 3] > (low + high) / 2))
        e, who = edges[here], owner[here]
        x1, x2 = (np.clip(e[:, 0] + (y - e[:, 1]) * slope[here], box[0], box[2]) for y in (low, high))
        order = np.argsort(x1 + x2, kind="stable")
        odd, start = set(), None
        for w, p, q in zip(who[order].tolist(), x1[order].tolist(), x2[order].tolist()):
            odd ^= {w}
            if odd and start is None:
                start = (p, q)
            elif not odd:
                if p + q > start[0] + start[1]:
                    out.append((low + origin[1], high + origin[1], start[0] + origin[0], start[1] + origin[0], p + origin[0], q + origin[0]))
                start = None
    return out


def _pieces(parts: list[np.ndarray], bounds: np.ndarray, box, few: int = 12, depth: int = 24) -> list[tuple]:
    near = np.flatnonzero((bounds[:, 0] < box[2]) & (bounds[:, 2] > box[0]) & (bounds[:, 1] < box[3]) & (bounds[:, 3] > box[1]))
    if not len(near) or box[0] >= box[2] or box[1] >= box[3]:
        return []
    b = bounds[near]
    for i in near[(b[:, 0] <= box[0]) & (b[:, 2] >= box[2]) & (b[:, 1] <= box[1]) & (b[:, 3] >= box[3])]:
        if _covers(parts[i], box):
            return [(box[1], box[3], box[0], box[0], box[2], box[2])]
    if len(near) > few and depth:  # many shapes: each quarter of the box has its own few, or is covered by one
        mx, my = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
        if min(box[2] - box[0], box[3] - box[1]) > 1e-9 * max(1.0, *np.abs(box)):
            parts, bounds = [parts[i] for i in near], bounds[near]
            quarters = [(box[0], box[1], mx, my), (mx, box[1], box[2], my), (box[0], my, mx, box[3]), (mx, my, box[2], box[3])]
            return [p for q in quarters for p in _pieces(parts, bounds, q, few, depth - 1)]
    return _sweep([parts[i] for i in near], box)


def sweep_pieces(polygons, box=None) -> list[tuple]:
    """Disjoint trapezoids (low, high, l0, l1, r0, r1) whose union is that of the polygons, within a box (xmin, ymin, xmax, ymax).

    Polygons are lists of rings, inside by odd count of edges, so holes and overlaps are exact.  A trapezoid lies between the
    heights low and high; its left and right side go from l0 and r0 at low to l1 and r1 at high."""
    return _within([e for e in (_edge_table(p) for p in polygons) if len(e)], box)


def _within(parts: list[np.ndarray], box) -> list[tuple]:
    if not parts:
        return []
    start = np.cumsum([0] + [len(e) for e in parts[:-1]])
    e = np.concatenate(parts)
    lows, highs = np.minimum.reduceat(np.minimum(e[:, :2], e[:, 2:]), start), np.maximum.reduceat(np.maximum(e[:, :2], e[:, 2:]), start)
    bounds = np.hstack([lows, highs])
    whole = (bounds[:, 0].min(), bounds[:, 1].min(), bounds[:, 2].max(), bounds[:, 3].max())
    return _pieces(parts, bounds, whole if box is None else (max(whole[0], box[0]), max(whole[1], box[1]), min(whole[2], box[2]), min(whole[3], box[3])))


def _edge_parts(x1, y1, x2, y2, low, high, l0, l1, r0, r1) -> np.ndarray:
    """For directed edges, the signed area of a trapezoid to the left of each edge, at the heights that the edge passes."""
    up = np.where(y2 >= y1, 1.0, -1.0)
    ax, ay, bx, by = np.where(up > 0, x1, x2), np.minimum(y1, y2), np.where(up > 0, x2, x1), np.maximum(y1, y2)
    ya, yb = np.clip(ay, low, high), np.clip(by, low, high)
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where(by > ay, (bx - ax) / (by - ay), 0.0)
        fa, fb = (ya - low) / (high - low), (yb - low) / (high - low)
        wa, wb = (r0 - l0) + ((r1 - l1) - (r0 - l0)) * fa, (r0 - l0) + ((r1 - l1) - (r0 - l0)) * fb
        ua, ub = ax + (ya - ay) * slope - (l0 + (l1 - l0) * fa), ax + (yb - ay) * slope - (l0 + (l1 - l0) * fb)
        s = np.where(ua * ub < 0, ua / (ua - ub), 0.0)
        va, vb = ua - wa, ub - wb
        t = np.where(va * vb < 0, va / (va - vb), 0.0)
    first, second = np.minimum(s, t), np.maximum(s, t)
    at = lambda f: np.clip(ua + (ub - ua) * f, 0.0, np.maximum(wa + (wb - wa) * f, 0.0))
    c0, c1, c2, c3 = at(0.0), at(first), at(second), at(1.0)
    mean = ((c0 + c1) * first + (c1 + c2) * (second - first) + (c2 + c3) * (1 - second)) / 2
    return np.where(yb > ya, up * mean * (yb - ya), 0.0)


def sweep_areas(first, others, clip: tuple[float, float, float, float] | None = None) -> tuple[float, float]:
    """(area of first inside any of others, area of first outside all of them), limited to a box; see ``sweep_pieces``."""
    p, q = (np.array(sweep_pieces(v, clip), float).reshape(-1, 6) for v in ([first], others))
    total = ((p[:, 1] - p[:, 0]) * (p[:, 4] - p[:, 2] + p[:, 5] - p[:, 3]) / 2).sum()
    i, j = (v.ravel() for v in np.meshgrid(np.arange(len(p)), np.arange(len(q)), indexing="ij"))
    p, q = p[i].T, q[j].T
    inside = (_edge_parts(p[4], p[0], p[5], p[1], *q) - _edge_parts(p[2], p[0], p[3], p[1], *q)).sum()
    return float(inside), float(max(total - inside, 0.0))


def _flat_edges(polygons: pa.Array) -> tuple[np.ndarray, ...]:
    """(ring of each edge, row of each ring, hole or not of each ring, x1, y1, x2, y2) of an Arrow array of polygons."""
    n_rings = pc.fill_null(pc.list_value_length(polygons), 0).to_numpy(zero_copy_only=False)
    rings = polygons.flatten()
    n_points = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False)
    points = rings.flatten()
    x, y = (pc.struct_field(points, c).to_numpy(zero_copy_only=False) for c in "xy")
    row = np.repeat(np.arange(len(n_rings)), n_rings)
    hole = np.arange(len(row)) != np.repeat(np.cumsum(n_rings) - n_rings, n_rings)
    ring, end = np.repeat(np.arange(len(row)), n_points), np.cumsum(n_points)
    after = np.arange(1, len(x) + 1)
    some = n_points > 0
    after[end[some] - 1] = (end - n_points)[some]
    return ring, row, hole, x, y, x[after], y[after]


def trapezoid_area(polygon: Column, low: Column, high: Column, l0: Column, l1: Column, r0: Column, r1: Column) -> Column:
    """Area of a polygon (simple rings, the first without the others) inside a trapezoid; see ``sweep_pieces``."""

    @F.arrow_udf("double")
    def run(p: pa.Array, *sides: pa.Array) -> pa.Array:
        ring, row, hole, *xy = _flat_edges(p)
        at = [v.to_numpy(zero_copy_only=False)[row[ring]] for v in sides]
        areas = np.abs(np.bincount(ring, _edge_parts(*xy, *at), len(row)))
        return pa.array(np.maximum(np.bincount(row, np.where(hole, -areas, areas), len(p)), 0.0))

    return run(polygon, low, high, l0, l1, r0, r1)


def union_pieces(polygons: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Array of the trapezoids of the union of polygons within a box; see ``sweep_pieces``."""
    names = ("low", "high", "l0", "l1", "r0", "r1")

    @F.arrow_udf(f"array<struct<{','.join(f'{n}:double' for n in names)}>>")
    def run(o: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        ring, row, _, *xy = _flat_edges(o.flatten())
        e, of = np.array(xy).T, row[ring]
        of, e = of[e[:, 1] != e[:, 3]], e[e[:, 1] != e[:, 3]]
        e = np.where((e[:, 1] > e[:, 3])[:, None], e[:, [2, 3, 0, 1]], e)
        n = pc.fill_null(pc.list_value_length(o), 0).to_numpy(zero_copy_only=False)
        cuts = np.searchsorted(of, np.arange(n.sum() + 1))
        found, i = [], 0
        for m, *box in zip(n.tolist(), *(v.to_pylist() for v in (a, b, c, d))):
            found.append(_within([e[cuts[j] : cuts[j + 1]] for j in range(i, i + m) if cuts[j] < cuts[j + 1]], box))
            i += m
        flat = np.array([t for f in found for t in f], float).reshape(-1, 6)
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(6)], names=list(names)))

    return run(polygons, xmin, ymin, xmax, ymax)


def covered_areas(polygon: Column, others: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Struct (inside, outside): area of the polygon inside the union of ``others`` and outside it, within the box."""

    @F.arrow_udf("inside double, outside double")
    def run(p: pa.Array, o: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        found = [sweep_areas(x, y, box) for x, y, *box in zip(*(v.to_pylist() for v in (p, o, a, b, c, d)))]
        return pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.float64()) for i in (0, 1)], names=["inside", "outside"])

    return run(polygon, others, xmin, ymin, xmax, ymax)


def _haversine(x1, y1, x2, y2) -> np.ndarray:
    dy, dx = np.radians(y2 - y1) / 2, np.radians(x2 - x1) / 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.sin(dy) ** 2 + np.cos(np.radians(y1)) * np.cos(np.radians(y2)) * np.sin(dx) ** 2))


def inside_lengths(ax, ay, bx, by, edges: tuple[np.ndarray, ...]) -> np.ndarray:
    """Metres of each segment inside its polygon: it is cut where it crosses an edge, and pieces whose middle is inside count."""
    n = len(ax)
    ring, row, hole, x1, y1, x2, y2 = edges
    of = row[ring]
    px, py, qx, qy, rx, ry = (bx - ax)[of], (by - ay)[of], x2 - x1, y2 - y1, x1 - ax[of], y1 - ay[of]
    turn = px * qy - py * qx
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (rx * qy - ry * qx) / turn, (rx * py - ry * px) / turn
    cut = (turn != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1)
    who, at = np.concatenate([np.arange(n), np.arange(n), of[cut]]), np.concatenate([np.zeros(n), np.ones(n), t[cut]])
    order = np.lexsort((at, who))
    who, at = who[order], at[order]
    piece = np.flatnonzero((who[:-1] == who[1:]) & (at[1:] > at[:-1]))
    w, t0, t1 = who[piece], at[piece], at[piece + 1]
    mx, my = ax[w] + (t0 + t1) / 2 * (bx - ax)[w], ay[w] + (t0 + t1) / 2 * (by - ay)[w]
    # every piece against every edge of its polygon; edges lie row by row
    n_edges = np.bincount(of, minlength=n)
    start = np.cumsum(n_edges) - n_edges
    m = n_edges[w]
    p = np.repeat(np.arange(len(w)), m)
    e = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + start[w][p]
    with np.errstate(divide="ignore", invalid="ignore"):
        hit = ((y1[e] > my[p]) != (y2[e] > my[p])) & (mx[p] < (x2[e] - x1[e]) * (my[p] - y1[e]) / (y2[e] - y1[e]) + x1[e])
    fresh = np.ones(len(e), bool)
    fresh[1:] = (p[1:] != p[:-1]) | (ring[e][1:] != ring[e][:-1])
    group = np.cumsum(fresh) - 1
    odd = np.bincount(group, hit, group[-1] + 1 if len(group) else 0) % 2 == 1
    side = hole[ring[e[fresh]]]
    inside = (np.bincount(p[fresh], odd & ~side, len(w)) > 0) & (np.bincount(p[fresh], odd & side, len(w)) == 0)
    w, t0, t1 = w[inside], t0[inside], t1[inside]
    dx, dy = (bx - ax)[w], (by - ay)[w]
    return np.bincount(w, _haversine(ax[w] + t0 * dx, ay[w] + t0 * dy, ax[w] + t1 * dx, ay[w] + t1 * dy), n)


def inside_length(ax: Column, ay: Column, bx: Column, by: Column, polygon: Column) -> Column:
    """Metres of a segment inside a polygon, holes taken out."""

    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array, p: pa.Array) -> pa.Array:
        return pa.array(inside_lengths(*(v.to_numpy(zero_copy_only=False) for v in (a, b, c, d)), _flat_edges(p)))

    return run(ax, ay, bx, by, polygon)


def _quadrant_sums(left: np.ndarray, right: np.ndarray, lid: np.ndarray, rid: np.ndarray, metres: float) -> np.ndarray:
    """(left rows) x (sum and count of values in N, E, S, W): right rows (x, y, value) within ``metres`` and of another id.

    Rows are points on the unit sphere about the block's middle, so that distances and the signs of east - north and east +
    north are products of small matrices; points within a millimetre of each other or of a border are told by the formulas."""
    if not len(left) or not len(right):
        return np.zeros((len(left), 8))
    sphere = lambda p: (np.radians(p[:, 0]), np.radians(p[:, 1]))
    (lo, la), (ro, ra) = sphere(left), sphere(right)
    xyz = lambda o, a: np.stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)], 1)
    middle = xyz(np.array([lo.mean()]), np.array([la.mean()]))
    u, v = xyz(lo, la) - middle, xyz(ro, ra) - middle
    east = np.stack([-np.sin(lo), np.cos(lo), np.zeros(len(lo))], 1)
    north = np.stack([-np.sin(la) * np.cos(lo), -np.sin(la) * np.sin(lo), np.cos(la)], 1)
    value = right[:, 2]
    known = ~np.isnan(value)
    values = np.stack([np.where(known, value, 0.0), known.astype(float)], 1)
    reach = 4 * np.sin(metres / (2 * EARTH_M)) ** 2
    near = 1e-3 / EARTH_M
    d2 = (u * u).sum(1)[:, None] + (v * v).sum(1) - 2 * (u @ v.T)
    a, b = east - north, east + north
    minus, plus = a @ v.T - (u * a).sum(1)[:, None], b @ v.T - (u * b).sum(1)[:, None]
    inside, e_n, en = d2 <= reach, minus >= 0, plus >= 0
    doubt = (np.abs(d2 - reach) < 2 * near * math.sqrt(reach)) | ((d2 <= reach) & ((np.abs(minus) < near) | (np.abs(plus) < near)))
    i, j = np.nonzero(doubt)
    if len(i):
        inside[i, j] = _haversine(left[i, 0], left[i, 1], right[j, 0], right[j, 1]) <= metres
        d = ro[j] - lo[i]
        deg = np.degrees(np.arctan2(np.sin(d) * np.cos(ra[j]), np.cos(la[i]) * np.sin(ra[j]) - np.sin(la[i]) * np.cos(ra[j]) * np.cos(d)))
        deg = np.mod(deg + 360.0, 360.0)
        e_n[i, j] = (deg >= 45) & (deg < 225)
        en[i, j] = (deg >= 315) | (deg < 135)
    inside &= lid[:, None] != rid
    quarters = (inside & ~e_n & en, inside & e_n & en, inside & e_n & ~en, inside & ~e_n & ~en)
    return np.hstack([q.astype(float) @ values for q in quarters])


def quadrant_sums(left: Column, right: Column, metres: float) -> Column:
    """For blocks of rows, arrays of (id, x, y) and of (id, x, y, value), an array of (id, sum and count of the values within
    ``metres`` in each quarter n, e, s, w), one item for each left row."""
    names = [f"{q}_{m}" for q in "nesw" for m in ("sum", "n")]

    @F.arrow_udf(f"array<struct<id:bigint,{','.join(f'{n}:double' for n in names)}>>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        column = lambda t, c: pc.cast(pc.struct_field(t, c), pa.float64()).to_numpy(zero_copy_only=False)
        ids, sums, sizes = [], [], []
        for one, two in zip(a, b):
            p, q = one.values, two.values
            i, j = (pc.struct_field(t, "id").to_numpy(zero_copy_only=False) for t in (p, q))
            ids.append(i)
            sizes.append(len(i))
            left_rows, right_rows = np.stack([column(p, c) for c in "xy"], 1), np.stack([column(q, c) for c in "xyv"], 1)
            sums.extend(_quadrant_sums(left_rows[k : k + 256], right_rows, i[k : k + 256], j, metres) for k in range(0, len(i), 256))
        flat = np.concatenate(sums) if sums else np.zeros((0, 8))
        key = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64), pa.int64())
        items = pa.StructArray.from_arrays([key, *(pa.array(flat[:, c]) for c in range(8))], names=["id", *names])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), items)

    return run(left, right)


def _radius_nearest(left: np.ndarray, right: np.ndarray, lid: np.ndarray, rid: np.ndarray, metres: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each left row: the number of right rows (x, y) within ``metres`` and of another id, the distance of the nearest of them
    (ties to the smallest id) and its place among the right rows.

    Distances are products of small matrices, as in ``_quadrant_sums``; those within a millimetre of the border and of the
    nearest one are told by the formula."""
    xyz = lambda p: np.stack([np.cos(p[:, 1]) * np.cos(p[:, 0]), np.cos(p[:, 1]) * np.sin(p[:, 0]), np.sin(p[:, 1])], 1)
    l, r = np.radians(left), np.radians(right)
    middle = xyz(l.mean(0)[None])
    u, v = xyz(l) - middle, xyz(r) - middle
    reach, near = 4 * np.sin(metres / (2 * EARTH_M)) ** 2, 1e-3 / EARTH_M
    d2 = np.maximum((u * u).sum(1)[:, None] + (v * v).sum(1) - 2 * (u @ v.T), 0.0)
    i, j = np.nonzero(np.abs(d2 - reach) < 2 * near * math.sqrt(reach))
    inside = d2 <= reach
    if len(i):
        inside[i, j] = _haversine(left[i, 0], left[i, 1], right[j, 0], right[j, 1]) <= metres
    inside &= lid[:, None] != rid
    d2[~inside] = np.inf
    i, j = np.nonzero(inside & (d2 <= (np.sqrt(d2.min(1)) + 2 * near)[:, None] ** 2))
    d = _haversine(left[i, 0], left[i, 1], right[j, 0], right[j, 1])
    order = np.lexsort((rid[j], d, i))
    row, first = np.unique(i[order], return_index=True)
    best, place = np.full(len(left), np.inf), np.zeros(len(left), np.int64)
    best[row], place[row] = d[order][first], j[order][first]
    return inside.sum(1), best, place


def radius_nearest(left: Column, right: Column, metres: float) -> Column:
    """For blocks of rows, arrays of (id, x, y) and of (id, x, y, value), an array of (id, n, d, rid, v) with the number of right
    rows within ``metres``, and the distance, id and value of the nearest, one item for each left row that has any."""

    @F.arrow_udf("array<struct<id:bigint,n:bigint,d:double,rid:bigint,v:double>>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        column = lambda t, c: pc.struct_field(t, c).to_numpy(zero_copy_only=False)
        parts, sizes = [], []
        for one, two in zip(a, b):
            p, q = one.values, two.values
            i, j = column(p, "id"), column(q, "id")
            at, others = np.stack([column(p, c) for c in "xy"], 1), np.stack([column(q, c) for c in "xy"], 1)
            value, found = pc.struct_field(q, "v"), 0
            for k in range(0, len(i), 256):
                n, d, place = _radius_nearest(at[k : k + 256], others, i[k : k + 256], j, metres)
                some = n > 0
                columns = [pa.array(i[k : k + 256][some]), pa.array(n[some]), pa.array(d[some]), pa.array(j[place[some]]), value.take(pa.array(place[some]))]
                parts.append(pa.StructArray.from_arrays(columns, names=["id", "n", "d", "rid", "v"]))
                found += int(some.sum())
            sizes.append(found)
        items = pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("id", pa.int64()), ("n", pa.int64()), ("d", pa.float64()), ("rid", pa.int64()), ("v", pa.float64())]))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), items)

    return run(left, right)
