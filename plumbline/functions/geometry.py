"""Geometry as column expressions: angles, arcs, bulges, ellipses, splines, lattices."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_degrees(angle: Column) -> Column:
    """An angle in [0, 360), with values within 1e-9 of a full turn snapped to 0."""
    a = F.pmod(angle, F.lit(360.0))
    return F.when((F.abs(a) <= 1e-9) | (F.abs(a - 360.0) <= 1e-9), F.lit(0.0)).otherwise(a)


def direction(x: Column, y: Column) -> Column:
    """The angle of a direction in degrees."""
    return F.degrees(F.atan2(y, x))


def line_distance(px, py, x1, y1, x2, y2) -> Column:
    """The signed distance of a point from the line through two others; 0 for a line without length."""
    length = F.hypot(x2 - x1, y2 - y1)
    return F.when(length <= 1e-12, F.lit(0.0)).otherwise(((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)) / length)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def arc_points(cx: Column, cy: Column, r: Column, start: Column, end: Column, segments: int = 64) -> Column:
    """The points of an arc in degrees, ``segments`` (at least 4) pieces; an end before the start goes once around."""
    n = max(4, segments)
    stop = F.when(end < start, end + 360.0).otherwise(end)
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: point(cx + r * F.cos(F.radians(start + (stop - start) / n * i)), cy + r * F.sin(F.radians(start + (stop - start) / n * i))))


def ellipse_points(cx, cy, mx, my, ratio, start, end, segments: int = 64) -> Column:
    """The points of an elliptical arc (parameters in radians, major axis (mx, my)), at least 16 pieces."""
    n = max(16, segments)
    stop = F.when(end < start, end + 2 * math.pi).otherwise(end)

    def at(i):
        t = start + (stop - start) / n * i
        return point(cx + mx * F.cos(t) - my * ratio * F.sin(t), cy + my * F.cos(t) + mx * ratio * F.sin(t))

    return F.transform(F.sequence(F.lit(0), F.lit(n)), at)


def _bound(body, **values) -> Column:
    """``body`` of a struct of values that are worked out once; a lambda would work them out for each of its elements."""
    return F.transform(F.array(F.struct(*[v.alias(n) for n, v in values.items()])), body)[0]


def bulge_points(x1, y1, x2, y2, bulge, per_turn: int = 64) -> Column:
    """A polyline segment with a bulge (a quarter of whose arc tangent is its angle) as points, both ends exact."""
    chord, theta = F.hypot(x2 - x1, y2 - y1), 4 * F.atan(bulge)
    off = chord * (1 - bulge * bulge) / (4 * bulge)
    cx, cy = (x1 + x2) / 2 - (y2 - y1) / chord * off, (y1 + y2) / 2 + (x2 - x1) / chord * off
    n = F.greatest(F.lit(2), F.ceil(F.abs(theta) * max(8, per_turn) / (2 * math.pi))).cast("int")
    turned = lambda c: _bound(lambda v: F.transform(F.sequence(F.lit(1), v["n"] - 1), lambda i: point(v["cx"] + v["r"] * F.cos(v["a"] + v["theta"] * i / v["n"]), v["cy"] + v["r"] * F.sin(v["a"] + v["theta"] * i / v["n"]))), cx=c["cx"], cy=c["cy"], r=F.hypot(x1 - c["cx"], y1 - c["cy"]), a=F.atan2(y1 - c["cy"], x1 - c["cx"]), theta=c["theta"], n=c["n"])
    inner = _bound(turned, cx=cx, cy=cy, theta=theta, n=n)
    ends = [F.array(point(x1, y1)), F.array(point(x2, y2))]
    return F.when((F.abs(bulge) <= 1e-12) | (chord <= 1e-12), F.concat(*ends)).otherwise(F.concat(ends[0], inner, ends[1]))


def lattice(rows: Column, columns: Column, row_step: Column, column_step: Column, rotation: Column) -> Column:
    """The offsets (row, col, dx, dy) of a block reference that is repeated in rows and columns; counts below 1 are 1."""
    c, s = F.cos(F.radians(rotation)), F.sin(F.radians(rotation))
    some = lambda n: F.sequence(F.lit(0), F.greatest(F.lit(1), n) - 1)
    cell = lambda i, j: F.struct(i.alias("row"), j.alias("col"), (j * column_step * c - i * row_step * s).alias("dx"), (j * column_step * s + i * row_step * c).alias("dy"))
    return F.flatten(F.transform(some(rows), lambda i: F.transform(some(columns), lambda j: cell(i, j))))


def placed(x: Column, y: Column, ix: Column, iy: Column, sx: Column, sy: Column, rotation: Column) -> Column:
    """A block's point where an insert puts it: scaled, turned, moved."""
    c, s = F.cos(F.radians(rotation)), F.sin(F.radians(rotation))
    return point(ix + x * sx * c - y * sy * s, iy + x * sx * s + y * sy * c)


def let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once; a plain Python variable would repeat its whole expression."""
    return F.element_at(F.transform(F.array(value), then), 1)


def catmull_rom(points: Column, segments: int = 8) -> Column:
    """The points of an open centripetal Catmull-Rom curve through an array of (x, y); fewer than two points stay as they are."""
    return let(points, lambda own: _catmull_rom(own, F.size(own), segments))


def _catmull_rom(points: Column, n: Column, segments: int) -> Column:
    get = lambda i: F.element_at(points, F.least(F.greatest(i, F.lit(1)), n))
    gap = lambda a, b: F.greatest(F.sqrt(F.hypot(b["x"] - a["x"], b["y"] - a["y"])), F.lit(1e-6))

    def span(i):
        knots = lambda q: F.struct(q["a"].alias("a"), q["b"].alias("b"), q["c"].alias("c"), q["d"].alias("d"), gap(q["a"], q["b"]).alias("g1"), gap(q["b"], q["c"]).alias("g2"), gap(q["c"], q["d"]).alias("g3"))
        return let(let(F.struct(get(i - 1).alias("a"), get(i).alias("b"), get(i + 1).alias("c"), get(i + 2).alias("d")), knots), lambda q: F.transform(F.sequence(F.when(i == 1, 0).otherwise(1), F.lit(segments)), lambda k: curve(q, k)))

    def curve(q, k):
        # u runs from knot b (0) to knot c (g2); a is g1 before, d is g3 behind
        return let(q["g2"] * k / segments, lambda u: let(F.struct(*[level(q, u, c).alias(c) for c in "xy"]), lambda v: point(*[last(q, u, v[c]) for c in "xy"])))

    def level(q, u, c):
        ab = q["a"][c] * (-u / q["g1"]) + q["b"][c] * ((u + q["g1"]) / q["g1"])
        bc = q["b"][c] * ((q["g2"] - u) / q["g2"]) + q["c"][c] * (u / q["g2"])
        cd = q["c"][c] * ((q["g2"] + q["g3"] - u) / q["g3"]) + q["d"][c] * ((u - q["g2"]) / q["g3"])
        return F.struct(ab.alias("ab"), bc.alias("bc"), cd.alias("cd"))

    def last(q, u, v):
        left = v["ab"] * ((q["g2"] - u) / (q["g1"] + q["g2"])) + v["bc"] * ((u + q["g1"]) / (q["g1"] + q["g2"]))
        right = v["bc"] * ((q["g2"] + q["g3"] - u) / (q["g2"] + q["g3"])) + v["cd"] * (u / (q["g2"] + q["g3"]))
        return left * ((q["g2"] - u) / q["g2"]) + right * (u / q["g2"])

    return F.when(n < 2, points).otherwise(F.flatten(F.transform(F.sequence(F.lit(1), n - 1), span)))


def bspline(points: Column, degree: int = 3, samples: int = 32) -> Column:
    """The points of a clamped uniform B-spline at ``samples`` + 1 even parameters, by de Boor's scheme.

    With no more control points than the degree they stay as they are.
    """
    return let(F.struct(points.alias("own"), F.size(points).alias("n")), lambda v: _bspline(v["own"], v["n"], degree, samples))


def _bspline(points: Column, n: Column, degree: int, samples: int) -> Column:

    def at(s):
        head = F.struct((s * (n - degree) / samples).alias("u"), F.least(F.floor(s * (n - degree) / samples).cast("int"), n - degree - 1).alias("k"))
        return let(head, lambda h: level(h, 0, F.array(*[F.element_at(points, h["k"] + j + 1) for j in range(degree + 1)])))

    def level(h, r, d):
        if r == degree:
            return F.element_at(d, 1)
        knot = lambda i: F.least(F.greatest(i - degree, F.lit(0)), n - degree).cast("double")

        def blend(d):
            out = []
            for j in range(r + 1, degree + 1):
                lo, hi = knot(h["k"] + j), knot(h["k"] + j + degree - r)
                w = (h["u"] - lo) / (hi - lo)
                p, q = F.element_at(d, j - r), F.element_at(d, j - r + 1)
                out.append(point(*[p[c] * (1 - w) + q[c] * w for c in "xy"]))
            return F.array(*out)

        return let(d, lambda own: level(h, r + 1, blend(own)))

    return F.when(n <= degree, points).otherwise(F.transform(F.sequence(F.lit(0), F.lit(samples)), at))


def open_knots(n: Column, degree: int) -> Column:
    """The clamped uniform knots of ``n`` control points."""
    return F.transform(F.sequence(F.lit(0), n + degree), lambda i: F.least(F.greatest(i - degree, F.lit(0)), n - degree).cast("double"))


def distinct_points(points: Column) -> Column:
    """How many places an array of points has."""
    return F.size(F.array_distinct(F.transform(points, lambda p: F.struct(p["x"], p["y"]))))


def without_closing(points: Column) -> Column:
    """The points without the last one if it repeats the first."""
    return F.when((F.size(points) > 1) & (F.element_at(points, 1) == F.element_at(points, -1)), F.slice(points, F.lit(1), F.size(points) - 1)).otherwise(points)


def padded(values: Column, n: Column, fill: float = 0.0) -> Column:
    """The values cut or filled up to ``n``."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill), n)), F.lit(1), n)


def ordinate_type(fx: Column, fy: Column, ox: Column, oy: Column) -> Column:
    """0 for an ordinate dimension that leads off along x at least as far as along y, else 1."""
    return F.when(F.abs(ox - fx) >= F.abs(oy - fy), 0).otherwise(1)


def unit(x: Column, y: Column) -> Column:
    """A direction of length 1; null for one without length."""
    n = F.hypot(x, y)
    return F.when((n >= 1e-12) & (n < float("inf")), point(x / n, y / n))


def turned(x: Column, y: Column, angle: Column) -> Column:
    """A direction turned by an angle in radians."""
    return point(x * F.cos(angle) - y * F.sin(angle), x * F.sin(angle) + y * F.cos(angle))


def crossing(ax, ay, rx, ry, bx, by, sx, sy) -> Column:
    """Where a line from (ax, ay) along (rx, ry) meets one from (bx, by) along (sx, sy); null for parallel lines."""
    den = rx * sy - ry * sx
    t = ((bx - ax) * sy - (by - ay) * sx) / F.when(F.abs(den) >= 1e-12, den)
    return F.when(t.isNotNull(), point(ax + t * rx, ay + t * ry))


def foot(px, py, lx, ly, dx, dy) -> Column:
    """The foot of the perpendicular from a point to a line through (lx, ly) along (dx, dy); null for a line without direction."""
    sq = dx * dx + dy * dy
    t = ((px - lx) * dx + (py - ly) * dy) / F.when(F.sqrt(sq) >= 1e-12, sq)
    return F.when(t.isNotNull(), point(lx + t * dx, ly + t * dy))


def sweep(start: Column, end: Column, counterclockwise: Column) -> Column:
    """The angle (radians) from start to end: not negative counterclockwise, not positive clockwise."""
    d, turn = end - start, 2 * math.pi
    return F.when(counterclockwise & (d < 0), d + turn).when(~counterclockwise & (d > 0), d - turn).otherwise(d)


def bulged_path(points: Column, closed: Column, per_turn: int = 64) -> Column:
    """The points of a polyline of (x, y, bulge), each segment by its bulge; segments share their ends."""

    def path(own):
        n = F.size(own)
        last = F.when(closed, n).otherwise(n - 1)

        def piece(i):
            pair = F.struct(F.element_at(own, i).alias("a"), F.element_at(own, i % n + 1).alias("b"))
            return let(pair, lambda v: F.slice(bulge_points(v["a"]["x"], v["a"]["y"], v["b"]["x"], v["b"]["y"], v["a"]["bulge"], per_turn), 2, 1 << 20))

        first = F.transform(F.slice(own, 1, 1), lambda p: point(p["x"], p["y"]))
        return F.when(n < 2, first).otherwise(F.concat(first, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), piece))))

    return let(points, path)


def unit_knots(n: Column, degree: int) -> Column:
    """The clamped uniform knots of ``n`` control points from 0 to 1; the degree is at most n - 1; none for fewer than two."""
    p = F.greatest(F.lit(1), F.least(F.lit(degree), n - 1))
    inner = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(2)) + p), lambda i: F.least(F.greatest((i - p) / F.greatest(n - p, F.lit(1)), F.lit(0.0)), F.lit(1.0)))
    return F.when(n >= 2, inner).otherwise(F.array().cast("array<double>"))


def curve_vertices(points: Column, flags: Column) -> Column:
    """The points of a curve: those of its frame (flag 16) if two or more, else those no fit made (flags 1, 8) if two or more, else all."""
    pairs = F.arrays_zip(points.alias("p"), F.slice(flags, F.lit(1), F.size(points)).alias("f"))
    picked = lambda test: F.transform(F.filter(pairs, lambda v: F.coalesce(test(v["f"]), F.lit(False))), lambda v: v["p"])
    frame, own = picked(lambda f: f.bitwiseAND(16) != 0), picked(lambda f: f.bitwiseAND(9) == 0)
    known = (F.size(points) >= 2) & (F.size(flags) >= 2)
    return F.when(known & (F.size(frame) >= 2), frame).when(known & (F.size(own) >= 2), own).otherwise(points)


def angle_unit(angles: Column) -> Column:
    """'deg' if a finite angle is beyond a full turn of radians, else 'rad'."""
    size = F.array_max(F.filter(F.transform(angles, F.abs), lambda a: ~F.isnan(a) & (a < float("inf"))))
    return F.when(size > 2 * math.pi + 1e-3, F.lit("deg")).otherwise(F.lit("rad"))


def block_transform(insert: Column, text_midpoint: Column, defpoint: Column, scale: Column, rotation: Column) -> Column:
    """Where a dimension's block goes: its insert, text or definition point (the first there), scale (1 by default) and rotation (0)."""
    at = F.coalesce(insert, text_midpoint, defpoint)
    some = lambda v, other: F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(other)).otherwise(F.coalesce(v, F.lit(other)))
    return F.struct(*[F.coalesce(at[c], F.lit(0.0)).alias(c) for c in "xyz"], *[some(scale[c], 1.0).alias(f"{c}scale") for c in "xyz"], some(rotation, 0.0).alias("rotation"))


def with_closing(points: Column, closed: Column) -> Column:
    """The points of a closed path with the first one again at the end, if it isn't there."""
    return F.when(closed & (F.size(points) > 1) & (F.element_at(points, 1) != F.element_at(points, -1)), F.concat(points, F.slice(points, 1, 1))).otherwise(points)


def fit_or_control(fit: Column, control: Column) -> Column:
    """Fit points if two or more, else control points."""
    return F.when(F.size(fit) >= 2, fit).otherwise(control)


def lifted(points: Column, elevation: Column) -> Column:
    """Plane points at an elevation."""
    return F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), elevation.alias("z")))


def shifted(points: Column, dx: Column, dy: Column) -> Column:
    """Points moved by an offset."""
    return F.transform(points, lambda p: point(p["x"] + dx, p["y"] + dy))


def face_points(vertices: Column, face: Column) -> Column:
    """The vertices that a face names from 1, a hidden edge by a negative number; numbers that no vertex has are left out."""
    known = F.filter(face, lambda i: (F.abs(i) >= 1) & (F.abs(i) <= F.size(vertices)))
    return F.transform(known, lambda i: F.element_at(vertices, F.abs(i).cast("int")))
