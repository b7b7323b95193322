"""Geometry as column expressions: points are struct<x,y>, lines array<struct<x,y>>, polygons array<array<struct<x,y>>> (shell first)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of EPSG:2154, a conformal conic on GRS80.
L93_N, L93_C, L93_X, L93_Y, L93_LON0 = 0.7256077650532695, 11754255.426096004, 700000.0, 12655612.049875986, 3.0
GRS80_F = 1 / 298.257222101
GRS80_E = math.sqrt(2 * GRS80_F - GRS80_F**2)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def lambert93(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 degrees to EPSG:2154 metres."""
    phi, sin = F.radians(lat), F.sin(F.radians(lat))
    iso = F.ln(F.tan(math.pi / 4 + phi / 2) * F.pow((1 - GRS80_E * sin) / (1 + GRS80_E * sin), F.lit(GRS80_E / 2)))
    rho, theta = L93_C * F.exp(-L93_N * iso), L93_N * F.radians(lon - L93_LON0)
    return L93_X + rho * F.sin(theta), L93_Y - rho * F.cos(theta)


def lambert93_inverse(x: Column, y: Column, rounds: int = 6) -> tuple[Column, Column]:
    """EPSG:2154 metres to EPSG:4326 degrees."""
    dx, dy = x - L93_X, L93_Y - y
    iso = -F.ln(F.sqrt(dx * dx + dy * dy) / L93_C) / L93_N
    phi = 2 * F.atan(F.exp(iso)) - math.pi / 2
    for _ in range(rounds):
        sin = F.sin(phi)
        phi = 2 * F.atan(F.pow((1 + GRS80_E * sin) / (1 - GRS80_E * sin), F.lit(GRS80_E / 2)) * F.exp(iso)) - math.pi / 2
    return F.degrees(F.atan2(dx, dy) / L93_N) + L93_LON0, F.degrees(phi)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """sqrt of the sum of squares: hypot's last bit differs between engines."""
    dx, dy = (ax - bx).cast("double"), (ay - by).cast("double")
    return F.sqrt(dx * dx + dy * dy)


def first_point(line: Column) -> Column:
    return F.get(line, 0)


def last_point(line: Column) -> Column:
    return F.element_at(line, -1)


def segments(line: Column) -> Column:
    """array<struct<ax,ay,bx,by>> of a line, empty for fewer than two points."""
    rest = F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), rest, lambda a, b: F.struct(a.x.alias("ax"), a.y.alias("ay"), b.x.alias("bx"), b.y.alias("by")))
    return F.when(F.size(line) > 1, pairs).otherwise(F.slice(pairs, 1, 0))


def _length(s: Column) -> Column:
    return distance(s.ax, s.ay, s.bx, s.by)


def line_length(line: Column) -> Column:
    return F.aggregate(segments(line), F.lit(0.0), lambda total, s: total + _length(s))


def line_centroid(line: Column) -> Column:
    """Mean of the segments' midpoints, weighted by length."""
    total = F.aggregate(
        segments(line), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("l")),
        lambda a, s: F.struct((a.x + (s.ax + s.bx) / 2 * _length(s)).alias("x"), (a.y + (s.ay + s.by) / 2 * _length(s)).alias("y"), (a.l + _length(s)).alias("l")),
    )
    return F.when(total.l > 0, point(total.x / total.l, total.y / total.l)).otherwise(first_point(line))


def measures(line: Column) -> Column:
    """array<struct<m,ax,ay,bx,by,l>>: segments with the length of line before them."""
    start = F.struct(F.lit(0.0).alias("m"), F.slice(F.transform(segments(line), lambda s: F.struct(F.lit(0.0).alias("m"), s.ax.alias("ax"), s.ay.alias("ay"), s.bx.alias("bx"), s.by.alias("by"), _length(s).alias("l"))), 1, 0).alias("o"))
    add = lambda a, s: F.struct((a.m + _length(s)).alias("m"), F.concat(a.o, F.array(F.struct(a.m.alias("m"), s.ax.alias("ax"), s.ay.alias("ay"), s.bx.alias("bx"), s.by.alias("by"), _length(s).alias("l")))).alias("o"))
    return F.aggregate(segments(line), start, add, lambda a: a.o)


def substring(line: Column, lo: Column, hi: Column) -> Column:
    """The part of line from length lo to length hi."""
    own = F.filter(measures(line), lambda s: (s.m < hi) & (s.m + s.l > lo))
    share = lambda s, at: F.when(s.l > 0, (at - s.m) / s.l).otherwise(0.0)
    place = lambda s, t: point(s.ax + (s.bx - s.ax) * t, s.ay + (s.by - s.ay) * t)
    starts = F.transform(own, lambda s: F.when(s.m < lo, place(s, share(s, lo))).otherwise(point(s.ax, s.ay)))
    last = F.element_at(own, -1)
    return F.concat(starts, F.array(place(last, F.least(share(last, hi), F.lit(1.0)))))


def project(px: Column, py: Column, s: Column) -> Column:
    """Where on segment s point p is nearest, from 0 to 1."""
    dx, dy = s.bx - s.ax, s.by - s.ay
    size = dx * dx + dy * dy
    return F.when(size > 0, F.least(F.greatest(((px - s.ax) * dx + (py - s.ay) * dy) / size, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def nearest_on_line(px: Column, py: Column, line: Column) -> Column:
    """struct<dist, offset> of the nearest place on line; of equally near ones the earliest."""
    def at(s: Column) -> Column:
        t = project(px, py, s)
        return F.struct(distance(px, py, s.ax + (s.bx - s.ax) * t, s.ay + (s.by - s.ay) * t).alias("dist"), (s.m + t * s.l).alias("offset"))

    return F.array_min(F.transform(measures(line), at))


def reverse_line(line: Column) -> Column:
    return F.reverse(line)


def merge_lines(lines: Column) -> Column:
    """Lines one after another as one, a joint that is the end of one and the start of the next taken once."""
    return F.aggregate(lines, F.slice(F.flatten(lines), 1, 0), lambda a, b: F.when((F.size(a) > 0) & (F.element_at(F.concat(a, b), F.greatest(F.size(a), F.lit(1))) == F.get(b, 0)), F.concat(a, F.slice(b, 2, F.greatest(F.size(b) - 1, F.lit(0))))).otherwise(F.concat(a, b)))


def on_boundary(px: Column, py: Column, polygon: Column) -> Column:
    def touches(s: Column) -> Column:
        cross = (s.bx - s.ax) * (py - s.ay) - (s.by - s.ay) * (px - s.ax)
        return (cross == 0) & px.between(F.least(s.ax, s.bx), F.greatest(s.ax, s.bx)) & py.between(F.least(s.ay, s.by), F.greatest(s.ay, s.by))

    return F.exists(polygon, lambda ring: F.exists(segments(ring), touches))


def crosses_odd(px: Column, py: Column, polygon: Column) -> Column:
    """Ray casting over all rings, so holes count as outside; rings are closed."""
    def crossing(s: Column) -> Column:
        return ((s.ay > py) != (s.by > py)) & (px < (s.bx - s.ax) * (py - s.ay) / F.when(s.by != s.ay, s.by - s.ay).otherwise(1.0) + s.ax)

    return F.aggregate(polygon, F.lit(0), lambda n, ring: n + F.size(F.filter(segments(ring), crossing))) % 2 == 1


def within(px: Column, py: Column, polygon: Column) -> Column:
    """Strictly inside."""
    return crosses_odd(px, py, polygon) & ~on_boundary(px, py, polygon)


def intersects(px: Column, py: Column, polygon: Column) -> Column:
    """Inside or on the boundary."""
    return crosses_odd(px, py, polygon) | on_boundary(px, py, polygon)


def cells(lo_x: Column, lo_y: Column, hi_x: Column, hi_y: Column, size: float) -> Column:
    """array<struct<cx,cy>> of the grid cells that a box touches."""
    cell = lambda v: F.floor(v / size).cast("long")
    return F.flatten(F.transform(F.sequence(cell(lo_x), cell(hi_x)), lambda i: F.transform(F.sequence(cell(lo_y), cell(hi_y)), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: bound as a lambda's variable, so that the optimizer doesn't copy it into each use."""
    return F.get(F.transform(F.array(value), body), 0)


def near_interval(a: Column, q: Column, radius: float) -> Column:
    """struct<lo, hi>: the part of segment a, as shares of it, within radius of segment q; null if none.

    Places within radius of a segment are a convex set, two discs and a rectangle, so the part is one interval: from
    the first of the three parts' starts to the last of their ends.
    """
    named = lambda **c: F.struct(*[v.alias(k) for k, v in c.items()])

    def frame(s: Column) -> Column:
        a, q = s.a, s.q
        vx, vy = q.bx - q.ax, q.by - q.ay
        return named(ux=a.bx - a.ax, uy=a.by - a.ay, px=a.ax - q.ax, py=a.ay - q.ay, rx=a.ax - q.bx, ry=a.ay - q.by, vx=vx, vy=vy, l=F.sqrt(vx * vx + vy * vy))

    def turned(v: Column) -> Column:
        wx, wy = F.try_divide(v.vx, v.l), F.try_divide(v.vy, v.l)
        near = lambda x, y: x * x + y * y - radius * radius
        return named(
            uu=v.ux * v.ux + v.uy * v.uy, b1=v.ux * v.px + v.uy * v.py, c1=near(v.px, v.py), b2=v.ux * v.rx + v.uy * v.ry, c2=near(v.rx, v.ry), l=v.l,
            along0=v.px * wx + v.py * wy, along1=v.ux * wx + v.uy * wy, across0=v.px * wy - v.py * wx, across1=v.ux * wy - v.uy * wx,
        )

    def parts(w: Column) -> Column:
        def disc(b: Column, c: Column, sign: int) -> Column:
            inside = b * b - w.uu * c
            return F.when(inside >= 0, F.try_divide(-b + sign * F.sqrt(inside), w.uu))

        def slab(v0: Column, v1: Column, lo: Column, hi: Column, pick, far: float) -> Column:
            return F.when(v1 == 0, F.when((v0 >= lo) & (v0 <= hi), far)).otherwise(pick(F.try_divide(lo - v0, v1), F.try_divide(hi - v0, v1)))

        zero, r = F.lit(0.0), F.lit(float(radius))
        start = (slab(w.along0, w.along1, zero, w.l, F.least, -1e18), slab(w.across0, w.across1, -r, r, F.least, -1e18))
        end = (slab(w.along0, w.along1, zero, w.l, F.greatest, 1e18), slab(w.across0, w.across1, -r, r, F.greatest, 1e18))
        both = lambda c, pick: F.when(c[0].isNotNull() & c[1].isNotNull(), pick(*c))
        return named(d1=disc(w.b1, w.c1, -1), e1=disc(w.b1, w.c1, 1), d2=disc(w.b2, w.c2, -1), e2=disc(w.b2, w.c2, 1), s=both(start, F.greatest), e=both(end, F.least))

    def hull(z: Column) -> Column:
        rect = z.s <= z.e
        return named(lo=F.greatest(F.least(z.d1, z.d2, F.when(rect, z.s)), F.lit(0.0)), hi=F.least(F.greatest(z.e1, z.e2, F.when(rect, z.e)), F.lit(1.0)), some=z.d1.isNotNull() | z.d2.isNotNull() | F.coalesce(rect, F.lit(False)))

    found = let(let(let(let(named(a=a, q=q), frame), turned), parts), hull)
    return let(found, lambda h: F.when(h.some & (h.lo < h.hi), F.struct(h.lo.alias("lo"), h.hi.alias("hi"))))
