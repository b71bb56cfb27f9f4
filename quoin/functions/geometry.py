"""Plane and camera geometry as pure column expressions.

Points are array<double> of x, y; rings are arrays of points; image axes (x right, y down).
Nothing here shuffles or leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.array(x.cast("double"), y.cast("double"))


def length(a: Column, b: Column) -> Column:
    return F.hypot(b[0] - a[0], b[1] - a[1])


def heading(a: Column, b: Column) -> Column:
    """Unit direction from a to b; (1, 0) where they coincide."""
    n = length(a, b)
    return F.when(n > 1e-9, F.array((b[0] - a[0]) / n, (b[1] - a[1]) / n)).otherwise(F.array(F.lit(1.0), F.lit(0.0)))


def orientation(a: Column, b: Column) -> Column:
    """`h`, `v` or `d`: nearly level first, then nearly upright."""
    dx, dy = F.abs(b[0] - a[0]), F.abs(b[1] - a[1])
    level = (dy < 1e-6) | ((dx > 0) & (dy / F.nullif(dx, F.lit(0.0)) < 0.02))
    upright = (dx < 1e-6) | ((dy > 0) & (dx / F.nullif(dy, F.lit(0.0)) < 0.02))
    return F.when(F.coalesce(level, F.lit(False)), "h").when(F.coalesce(upright, F.lit(False)), "v").otherwise("d")


def canonical(a: Column, b: Column, way: Column) -> Column:
    """array(p0, p1) of a level or upright wall: ends ascending, the other coordinate their mean."""
    mx, my = (a[0] + b[0]) / 2, (a[1] + b[1]) / 2
    level = F.array(F.array(F.least(a[0], b[0]), my), F.array(F.greatest(a[0], b[0]), my))
    upright = F.array(F.array(mx, F.least(a[1], b[1])), F.array(mx, F.greatest(a[1], b[1])))
    return F.when(way == "h", level).when(way == "v", upright).otherwise(F.array(a, b))


def axis_params(a: Column, b: Column, way: Column) -> Column:
    """struct<lo, hi, centre> along and across the axis of a level or upright wall."""
    i, j = F.when(way == "v", 1).otherwise(0), F.when(way == "v", 0).otherwise(1)
    pick = lambda p, k: F.element_at(p, k + 1)
    return F.struct(F.least(pick(a, i), pick(b, i)).alias("lo"), F.greatest(pick(a, i), pick(b, i)).alias("hi"), ((pick(a, j) + pick(b, j)) / 2).alias("centre"))


def rectangle(a: Column, b: Column, across: Column, cap: Column) -> Column:
    """Ring of the oriented rectangle about a segment, `across` wide, longer by `cap` at both ends."""
    d = heading(a, b)
    nx, ny = -d[1] * across / 2, d[0] * across / 2
    ex, ey = d[0] * cap, d[1] * cap
    corner = lambda p, s, t: F.array(p[0] + s * ex + t * nx, p[1] + s * ey + t * ny)
    return F.array(corner(a, -1, 1), corner(b, 1, 1), corner(b, 1, -1), corner(a, -1, -1))


def wall_quad(a: Column, b: Column, thickness: Column, cap: Column | None = None) -> Column:
    """A wall's footprint; caps reach half its thickness past its ends unless given."""
    return rectangle(a, b, thickness, thickness / 2 if cap is None else cap)


def opening_footprint(a: Column, b: Column, thickness: Column, scale: Column, wall: Column) -> Column:
    """Metric footprint that cuts an opening out of its wall: twice the larger of its own and the
    typical wall's thickness across; null if it is shorter than a millimetre."""
    pa, pb = F.transform(a, lambda v: v * scale), F.transform(b, lambda v: v * scale)
    return F.when(length(pa, pb) >= 1e-3, rectangle(pa, pb, 2 * F.greatest(thickness * scale, wall), F.lit(0.0)))


def _turned(ring: Column) -> Column:
    return F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, F.lit(1), F.lit(1)))


def signed_area(ring: Column) -> Column:
    cross = F.zip_with(ring, _turned(ring), lambda p, q: p[0] * q[1] - q[0] * p[1])
    return F.aggregate(cross, F.lit(0.0), lambda s, v: s + v) / 2


def area(ring: Column) -> Column:
    """Shoelace area; null for a null ring, 0 for fewer than three points."""
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(F.abs(signed_area(ring)))


def vertex_mean(ring: Column) -> Column:
    add = lambda i: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[i]) / F.nullif(F.size(ring), F.lit(0))
    return F.array(add(0), add(1))


def centroid(ring: Column) -> Column:
    """Centre of area; the mean of the points where there is no area."""
    w = F.zip_with(ring, _turned(ring), lambda p, q: F.struct((p[0] * q[1] - q[0] * p[1]).alias("c"), (p[0] + q[0]).alias("x"), (p[1] + q[1]).alias("y")))
    total = signed_area(ring) * 6
    part = lambda f: F.aggregate(w, F.lit(0.0), lambda s, v: s + v["c"] * v[f]) / total
    return F.when(F.abs(total) > 1e-9, F.array(part("x"), part("y"))).otherwise(vertex_mean(ring))


def least_rectangle(ring: Column) -> Column:
    """struct<short, long> of the rectangle of least area about a ring. Its side lies along a hull
    edge, and hull edges are among the pairs of points, so all pairs' directions are tried."""
    extent = lambda dx, dy: F.array_max(F.transform(ring, lambda p: p[0] * dx + p[1] * dy)) - F.array_min(F.transform(ring, lambda p: p[0] * dx + p[1] * dy))

    def box(p, q):
        n = F.hypot(q[0] - p[0], q[1] - p[1])
        dx, dy = (q[0] - p[0]) / n, (q[1] - p[1]) / n
        u, v = extent(dx, dy), extent(-dy, dx)
        return F.when(n > 1e-12, F.struct((u * v).alias("area"), F.least(u, v).alias("short"), F.greatest(u, v).alias("long")))

    boxes = F.flatten(F.transform(ring, lambda p: F.transform(ring, lambda q: box(p, q))))
    best = F.array_min(F.filter(boxes, lambda b: b.isNotNull()))
    return F.struct(F.coalesce(best["short"], F.lit(0.0)).alias("short"), F.coalesce(best["long"], F.lit(0.0)).alias("long"))


def inside(p: Column, ring: Column) -> Column:
    """Whether a point lies in a ring (even-odd); points on the border may fall on either side."""
    hit = F.zip_with(ring, _turned(ring), lambda a, b: ((a[1] > p[1]) != (b[1] > p[1])) & (p[0] < (b[0] - a[0]) * (p[1] - a[1]) / F.nullif(b[1] - a[1], F.lit(0.0)) + a[0]))
    return F.coalesce(F.aggregate(hit, F.lit(False), lambda s, h: s != F.coalesce(h, F.lit(False))), F.lit(False))


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-18))))
    return F.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def ring_distance(p: Column, ring: Column) -> Column:
    """Distance of a point from a ring's border."""
    return F.array_min(F.zip_with(ring, _turned(ring), lambda a, b: segment_distance(p, a, b)))


def within(p: Column, ring: Column, buffer: float = 0.0) -> Column:
    """Whether a point lies in a ring grown by a buffer."""
    return inside(p, ring) | (ring_distance(p, ring) <= buffer)


def crossing(p: Column, r: Column, q: Column, s: Column) -> Column:
    """struct<t, u> with p + t r = q + u s; null for parallel lines."""
    det = r[0] * s[1] - r[1] * s[0]
    dx, dy = q[0] - p[0], q[1] - p[1]
    return F.when(F.abs(det) > 1e-9, F.struct(((dx * s[1] - dy * s[0]) / det).alias("t"), ((dx * r[1] - dy * r[0]) / det).alias("u")))


def ring_scaled(ring: Column, k: Column) -> Column:
    return F.transform(ring, lambda p: F.transform(p, lambda v: v * k))


def probes(a: Column, b: Column, fractions: list[float], offset: Column) -> Column:
    """Points beside a segment at fractions of its length, `offset` off on either side:
    array<struct<side, p>>."""
    d = heading(a, b)
    at = lambda f, side: F.struct(F.lit(side).alias("side"), F.array(a[0] + (b[0] - a[0]) * f - side * d[1] * offset, a[1] + (b[1] - a[1]) * f + side * d[0] * offset).alias("p"))
    return F.array(*[at(f, side) for side in (-1, 1) for f in fractions])


def srgb_to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


# --- camera geometry: rotations are array<double> of 9, row by row; x_c = R x_w + t ---


def rotate(r: Column, x: Column) -> Column:
    return F.array(*[r[3 * i] * x[0] + r[3 * i + 1] * x[1] + r[3 * i + 2] * x[2] for i in range(3)])


def rotate_back(r: Column, x: Column) -> Column:
    return F.array(*[r[i] * x[0] + r[3 + i] * x[1] + r[6 + i] * x[2] for i in range(3)])


def camera_centre(r: Column, t: Column) -> Column:
    """-R^T t."""
    return F.transform(rotate_back(r, t), lambda v: -v)


def project(k: Column, r: Column, t: Column, x: Column) -> Column:
    """struct<u, v, z> of a world point; k is array(fx, fy, cx, cy); depth is held at 1e-9 or more."""
    c = rotate(r, x)
    cx, cy, cz = c[0] + t[0], c[1] + t[1], c[2] + t[2]
    z = F.greatest(cz, F.lit(1e-9))
    return F.struct((k[0] * cx / z + k[2]).alias("u"), (k[1] * cy / z + k[3]).alias("v"), cz.alias("z"))


def backproject(k: Column, r: Column, t: Column, u: Column, v: Column, depth: Column) -> Column:
    """World point of a pixel and its depth."""
    local = F.array((u - k[2]) / k[0] * depth - t[0], (v - k[3]) / k[1] * depth - t[1], depth - t[2])
    return rotate_back(r, local)


def rotation(rvec: Column) -> Column:
    """Rotation of an axis-angle vector."""
    n = F.sqrt(rvec[0] * rvec[0] + rvec[1] * rvec[1] + rvec[2] * rvec[2])
    m = F.greatest(n, F.lit(1e-12))
    x, y, z = rvec[0] / m, rvec[1] / m, rvec[2] / m
    c, s = F.cos(n), F.sin(n)
    d = 1 - c
    return F.array(c + x * x * d, x * y * d - z * s, x * z * d + y * s, y * x * d + z * s, c + y * y * d, y * z * d - x * s, z * x * d - y * s, z * y * d + x * s, c + z * z * d)


def rotation_vector(r: Column) -> Column:
    """Axis-angle vector of a rotation of less than half a turn."""
    c = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (r[0] + r[4] + r[8] - 1) / 2))
    angle = F.acos(c)
    k = F.when(angle < 1e-9, F.lit(0.5)).otherwise(angle / (2 * F.greatest(F.sin(angle), F.lit(1e-12))))
    return F.array((r[7] - r[5]) * k, (r[2] - r[6]) * k, (r[3] - r[1]) * k)


def face_normal_area(a: Column, b: Column, c: Column) -> Column:
    """struct<nx, ny, nz, area> of a triangle; normals of no area are 0."""
    u = [b[i] - a[i] for i in range(3)]
    v = [c[i] - a[i] for i in range(3)]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    unit = [x / F.greatest(size, F.lit(1e-18)) for x in n]
    return F.struct(*[x.alias(name) for x, name in zip(unit, ("nx", "ny", "nz"), strict=True)], (size / 2).alias("area"))
