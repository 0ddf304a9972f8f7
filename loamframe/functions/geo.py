"""Geometry as column expressions.

A ring is an array of struct<x, y>, closed or not; angles are degrees.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamframe.functions.arith import as_col

LETTERS = "CDEFGHJKLMNPQRSTUVWXX"
EARTH_KM = 6371.0088


def utm_zone(lon: Column | str, lat: Column | str) -> Column:
    """Zone number, with the exceptions of south-west Norway and Svalbard."""
    lon, lat = as_col(lon), as_col(lat)
    plain = (F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1).cast("int")
    norway = (lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12)
    svalbard = (lat >= 72) & (lat <= 84) & (lon >= 0) & (lon < 42)
    arctic = F.when(lon < 9, 31).when(lon < 21, 33).when(lon < 33, 35).otherwise(37)
    return F.when(norway, 32).when(svalbard, arctic).otherwise(plain).cast("int")


def utm_letter(lat: Column | str) -> Column:
    """Latitude band letter, null outside -80..84."""
    lat = as_col(lat)
    at = F.floor((lat + 80) / 8).cast("int") + 1
    return F.when((lat >= -80) & (lat <= 84), F.substring(F.lit(LETTERS), at, F.lit(1)))


def utm_epsg(lat: Column | str, zone: Column | str) -> Column:
    lat, zone = as_col(lat), as_col(zone)
    return (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int")


#: WGS 84: semi-major axis, third flattening and the scaled rectifying radius.
_AXIS, _FLATTENING = 6378137.0, 1 / 298.257223563
_N = _FLATTENING / (2 - _FLATTENING)
_RADIUS = 0.9996 * _AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)


def _series(factors: tuple[float, ...], a: Column, b: Column) -> tuple[Column, Column]:
    """Sums of f * cos(2ja) * sinh(2jb) and of f * sin(2ja) * cosh(2jb)."""
    along, up = F.lit(0.0), F.lit(0.0)
    for j, f in enumerate(factors, 1):
        along = along + f * F.cos(2 * j * a) * F.sinh(2 * j * b)
        up = up + f * F.sin(2 * j * a) * F.cosh(2 * j * b)
    return along, up


def utm_project(lon: Column | str, lat: Column | str, zone: Column | str) -> Column:
    """struct<x, y> in metres by the Krueger series to the third order (WGS 84)."""
    lon, lat, zone = as_col(lon), as_col(lat), as_col(zone)
    n = _N
    alphas = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    s, lam = F.sin(F.radians(lat)), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    along, up = _series(alphas, xi, eta)
    return F.struct((500000 + _RADIUS * (eta + along)).alias("x"), (F.when(lat < 0, 10000000.0).otherwise(0.0) + _RADIUS * (xi + up)).alias("y"))


def utm_unproject(x: Column | str, y: Column | str, zone: Column | str, south: Column | bool = False) -> Column:
    """struct<lon, lat> of metres in a zone; the inverse of utm_project."""
    x, y, zone = as_col(x), as_col(y), as_col(zone)
    south = F.lit(south) if isinstance(south, bool) else south
    n = _N
    betas = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    deltas = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = (y - F.when(south, 10000000.0).otherwise(0.0)) / _RADIUS, (x - 500000) / _RADIUS
    along, up = _series(betas, xi, eta)
    xi, eta = xi - up, eta - along
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, d in enumerate(deltas, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.struct((zone * 6 - 183 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))).alias("lon"), F.degrees(lat).alias("lat"))


def haversine_km(lon1: Column | str, lat1: Column | str, lon2: Column | str, lat2: Column | str) -> Column:
    lon1, lat1, lon2, lat2 = (F.radians(as_col(c)) for c in (lon1, lat1, lon2, lat2))
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return F.when(h.isNotNull(), 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0)))))


def interleave(x: Column | str, y: Column | str, bits: int = 16) -> Column:
    """Z-order index of two non-negative integers of `bits` bits."""
    x, y = as_col(x).cast("long"), as_col(y).cast("long")
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out + F.shiftleft(F.shiftright(x, k).bitwiseAND(F.lit(1)), 2 * k) + F.shiftleft(F.shiftright(y, k).bitwiseAND(F.lit(1)), 2 * k + 1)
    return out


def cell_index(lon: Column | str, lat: Column | str, bits: int = 16) -> Column:
    """Z-order index of a longitude/latitude cell: a 64-bit cell id that keeps neighbours near."""
    lon, lat = as_col(lon), as_col(lat)
    top = (1 << bits) - 1
    x = F.least(F.floor((lon + 180) / 360 * (1 << bits)), F.lit(top))
    y = F.least(F.floor((lat + 90) / 180 * (1 << bits)), F.lit(top))
    return interleave(x, y, bits)


def snap(v: Column | str, size: int = 10) -> Column:
    """Centre of the pixel that holds v; floors towards minus infinity."""
    return (F.floor(as_col(v) / size) * size + size / 2).cast("double")


def cell(v: Column | str, size: float) -> Column:
    return F.floor(as_col(v) / size).cast("long")


def in_box(x: Column | str, y: Column | str, west: float, south: float, east: float, north: float, shrink: float = 0.0) -> Column:
    return as_col(x).between(west + shrink, east - shrink) & as_col(y).between(south + shrink, north - shrink)


def boxes_overlap(minx: Column, miny: Column, maxx: Column, maxy: Column, west: float, south: float, east: float, north: float) -> Column:
    return (minx <= east) & (maxx >= west) & (miny <= north) & (maxy >= south)


def _edges(ring: Column) -> Column:
    """Array of struct<p, q>: each vertex with the next, the last with the first."""
    n = F.size(ring)
    after = F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, F.least(n, F.lit(1))))
    return F.zip_with(ring, after, lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def ring_box(ring: Column | str) -> Column:
    ring = as_col(ring)
    xs, ys = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def signed_area(ring: Column | str) -> Column:
    """Shoelace area, positive for counter-clockwise rings."""
    return F.aggregate(_edges(as_col(ring)), F.lit(0.0), lambda s, e: s + (e.p.x * e.q.y - e.q.x * e.p.y)) / 2


def area(ring: Column | str) -> Column:
    return F.abs(signed_area(ring))


def centroid(ring: Column | str) -> Column:
    """struct<x, y> of the area centroid; null for rings without area."""
    ring = as_col(ring)
    sums = F.aggregate(
        _edges(ring),
        F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("a")),
        lambda s, e: F.struct(
            (s.x + (e.p.x + e.q.x) * (e.p.x * e.q.y - e.q.x * e.p.y)).alias("x"),
            (s.y + (e.p.y + e.q.y) * (e.p.x * e.q.y - e.q.x * e.p.y)).alias("y"),
            (s.a + (e.p.x * e.q.y - e.q.x * e.p.y)).alias("a"),
        ),
    )
    return F.when(sums.a != 0, F.struct((sums.x / (3 * sums.a)).alias("x"), (sums.y / (3 * sums.a)).alias("y")))


def contains(ring: Column | str, x: Column | str, y: Column | str) -> Column:
    """Ray casting: an odd number of edges crosses the ray to the right of the point."""
    x, y = as_col(x), as_col(y)
    crossings = F.aggregate(
        _edges(as_col(ring)),
        F.lit(0),
        lambda n, e: n + F.when(((e.p.y > y) != (e.q.y > y)) & (x < (e.q.x - e.p.x) * (y - e.p.y) / F.nullif(e.q.y - e.p.y, F.lit(0.0)) + e.p.x), 1).otherwise(0),
    )
    return crossings % 2 == 1


def rings_meet(a: Column | str, b: Column | str) -> Column:
    """Whether two rings share a point: an edge of one meets one of the other, or a ring lies inside the other."""
    a, b = as_col(a), as_col(b)

    def side(p: Column, q: Column, r: Column) -> Column:
        return F.signum((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x))

    def between(p: Column, q: Column, r: Column) -> Column:
        return r.x.between(F.least(p.x, q.x), F.greatest(p.x, q.x)) & r.y.between(F.least(p.y, q.y), F.greatest(p.y, q.y))

    def touch(e: Column, f: Column) -> Column:
        d1, d2, d3, d4 = side(e.p, e.q, f.p), side(e.p, e.q, f.q), side(f.p, f.q, e.p), side(f.p, f.q, e.q)
        on = ((d1 == 0) & between(e.p, e.q, f.p)) | ((d2 == 0) & between(e.p, e.q, f.q)) | ((d3 == 0) & between(f.p, f.q, e.p)) | ((d4 == 0) & between(f.p, f.q, e.q))
        return ((d1 * d2 < 0) & (d3 * d4 < 0)) | on

    first_a, first_b = F.get(a, F.lit(0)), F.get(b, F.lit(0))
    inside = contains(a, first_b.x, first_b.y) | contains(b, first_a.x, first_a.y)
    return inside | F.exists(_edges(a), lambda e: F.exists(_edges(b), lambda f: touch(e, f)))


def clear_around(ring: Column | str, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Whether a box lies inside a ring none of whose edges has a box that touches it; boxes inside that are near slanted edges are left out."""
    edges = _edges(as_col(ring))
    near = F.exists(edges, lambda e: (F.least(e.p.x, e.q.x) <= maxx) & (F.greatest(e.p.x, e.q.x) >= minx) & (F.least(e.p.y, e.q.y) <= maxy) & (F.greatest(e.p.y, e.q.y) >= miny))
    return ~near & contains(ring, (minx + maxx) / 2, (miny + maxy) / 2)


def crossings(ring: Column | str, y: Column | str) -> Column:
    """Where the edges cross a horizontal line."""
    y = as_col(y)
    cut = F.filter(_edges(as_col(ring)), lambda e: (e.p.y > y) != (e.q.y > y))
    return F.transform(cut, lambda e: (e.q.x - e.p.x) * (y - e.p.y) / (e.q.y - e.p.y) + e.p.x)


def inner_point(ring: Column | str) -> Column:
    """struct<x, y> of a point inside: on a line between the two lowest heights of corners, in the middle of its first part inside."""
    ring = as_col(ring)
    heights = F.array_sort(F.array_distinct(F.transform(ring, lambda p: p.y)))
    y = (F.get(heights, F.lit(0)) + F.get(heights, F.lit(1))) / 2
    cut = F.array_sort(crossings(ring, y))
    return F.when(F.size(cut) > 1, F.struct(((F.get(cut, F.lit(0)) + F.get(cut, F.lit(1))) / 2).alias("x"), y.alias("y")))


def edge_distance(ring: Column | str, x: Column | str, y: Column | str) -> Column:
    """Distance from a point to the nearest edge."""
    x, y = as_col(x), as_col(y)

    def to_edge(e: Column) -> Column:
        dx, dy = e.q.x - e.p.x, e.q.y - e.p.y
        t = F.coalesce(((x - e.p.x) * dx + (y - e.p.y) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        return F.sqrt(F.pow(x - (e.p.x + t * dx), 2) + F.pow(y - (e.p.y + t * dy), 2))

    return F.array_min(F.transform(_edges(as_col(ring)), to_edge))


def square(x: Column | str, y: Column | str, half: float) -> Column:
    """Ring of the square buffer around a point."""
    x, y = as_col(x), as_col(y)
    corners = ((-1, -1), (1, -1), (1, 1), (-1, 1))
    return F.array(*[F.struct((x + i * half).alias("x"), (y + j * half).alias("y")) for i, j in corners])


def box_ring(minx: Column | str, miny: Column | str, maxx: Column | str, maxy: Column | str) -> Column:
    minx, miny, maxx, maxy = map(as_col, (minx, miny, maxx, maxy))
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy))])
