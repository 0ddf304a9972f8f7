"""Buffers of polygons, outward or inward.

Every edge is moved along its normal.  Where moved edges part, they are joined by a mitre up to a limit, beyond it by a bevel, or by
an arc; where they cross, they are led through the corner that they belong to.  What the resulting curve winds around
more often to the left than to the right is the buffer: loops that an inward move turned inside out wind the other way
and fall away, as do whole polygons that are too thin.  Each polygon is a piece of work by itself, of the square of its corners; the polygons of
a batch are worked on together, as flat arrays in which each row has the number of its polygon.

A ring crosses no edge of its own; null rings and rings without area give no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamframe.operators.overlay import PAIRS, SIDE, crossing_points, neighbours, sums


def _pairs(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) whose numbers left[i] and right[j], both sorted, are equal; about PAIRS of them at a time."""
    first = np.searchsorted(right, left, "left")
    n = np.searchsorted(right, left, "right") - first
    upto, top = np.cumsum(n), 0
    while top < len(left):
        stop = max(top + 1, int(np.searchsorted(upto, (upto[top - 1] if top else 0) + PAIRS, "right")))
        many = n[top:stop]
        yield np.repeat(np.arange(top, stop), many), np.arange(many.sum()) + np.repeat(first[top:stop] - np.cumsum(many) + many, many)
        top = stop


def _moved(xy: np.ndarray, n: np.ndarray, distance: float, mitre: float, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The raw curves of counter-clockwise rings of n corners each, moved outward by distance (inward if negative), and the corner of each point."""
    before, after = neighbours(n)
    edge = xy[after] - xy
    b = np.column_stack([edge[:, 1], -edge[:, 0]]) / np.hypot(edge[:, 0], edge[:, 1])[:, None]
    a = b[before]
    turn, along = a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0], (a * b).sum(axis=1)
    cross = turn * distance < 0  # moved edges cross here
    angle = np.arctan2(turn, along)
    steps = np.maximum(1, np.ceil(np.abs(angle) / (math.pi / 2) * segments)).astype(np.int64)
    with np.errstate(divide="ignore"):
        mitred = (along > -1) & (2 / (1 + along) <= mitre * mitre)  # the mitre's length is the root of this
    many = np.where(cross, 3, steps + 1 if segments else np.where(mitred, 1, 2))
    at = np.repeat(np.arange(len(xy)), many)
    k = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    last = k == many[at] - 1
    out = xy[at] + distance * np.where(last[:, None], b[at], a[at])  # the first and the last point of most corners
    middle = cross[at] & (k == 1)
    out[middle] = xy[at[middle]]
    if segments:
        arc = ~cross[at]
        to = at[arc]
        turned = np.arctan2(a[to, 1], a[to, 0]) + angle[to] * k[arc] / steps[to]
        out[arc] = xy[to] + distance * np.column_stack([np.cos(turned), np.sin(turned)])
    else:
        one = mitred & ~cross
        out[one[at]] = xy[one] + distance * (a + b)[one] / (1 + along[one])[:, None]
    return out, at


def _unique(number: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different points of each number, in their order, and which of them each row is."""
    order = np.lexsort((xy[:, 1], xy[:, 0], number))
    rows = np.column_stack([number, xy])[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    which = np.empty(len(rows), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return rows[new], which


def _walked(end: list[int], begins: list[int], xy: list[list[int]]) -> tuple[list[int], list[int]]:
    """Points of rings along ways between points, and the number of points of each ring; begins: where the ways of each point begin in end."""
    many = {v: end[begins[v] : begins[v + 1]] for v in range(len(xy)) if begins[v + 1] - begins[v] > 1}
    ways = np.diff(begins).tolist()
    order, sizes = [], []
    for start in range(len(xy)):
        while ways[start]:
            at, came, top = start, None, len(order)
            while came is None or at != start:
                if not ways[at]:
                    raise ValueError("a ring without an end")
                if at not in many:
                    way = end[begins[at]]
                elif came is None or len(many[at]) == 1:
                    way = many[at].pop(0)
                else:  # the sharpest turn to the left: the first way clockwise from where it came
                    x, y = xy[at]
                    back = math.atan2(xy[came][1] - y, xy[came][0] - x)
                    way = min(many[at], key=lambda w: (back - math.atan2(xy[w][1] - y, xy[w][0] - x)) % (2 * math.pi) or 2 * math.pi)  # noqa: B023
                    many[at].remove(way)
                ways[at] -= 1
                order.append(at)
                came, at = at, way
            sizes.append(len(order) - top)
    return order, sizes


def _wound(curve: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rings, with the inside on their left, around what closed curves of integers wind around to the left.

    number: the curve of each point, sorted.  Returns the corners, the number of corners of each ring and its curve.
    """
    after = neighbours(np.unique(number, return_counts=True)[1])[1]
    edges = np.column_stack([curve, curve[after]])
    if len(edges) and np.abs(edges).max() >= SIDE:  # integers without a limit
        edges = edges.astype(object)
    real = (edges[:, :2] != edges[:, 2:]).any(axis=1).astype(bool)
    edges, number = edges[real], number[real]
    low, high = np.minimum(edges[:, :2], edges[:, 2:]), np.maximum(edges[:, :2], edges[:, 2:])
    hot = [np.column_stack([number, edges[:, :2].astype(np.int64)])]
    for i, j in _pairs(number, number):
        i, j = i[i < j], j[i < j]
        meet = ((low[i, 0] <= high[j, 0]) & (low[j, 0] <= high[i, 0]) & (low[i, 1] <= high[j, 1]) & (low[j, 1] <= high[i, 1])).astype(bool)
        pair, points = crossing_points(edges, i[meet], j[meet])
        hot.append(np.column_stack([number[i[meet][pair]], points]))
    hot = np.concatenate(hot)
    points = _unique(hot[:, 0], hot[:, 1:])[0].astype(edges.dtype)
    # each edge is split at the points that it passes by half a step
    d = edges[:, 2:] - edges[:, :2]
    every = np.arange(len(edges))
    stops = [(every, 0 * every, edges[:, :2]), (every, (d * d).sum(axis=1), edges[:, 2:])]
    for i, j in _pairs(number, points[:, 0].astype(np.int64)):
        x, y = points[j, 1], points[j, 2]
        near = ((low[i, 0] <= x) & (x <= high[i, 0]) & (low[i, 1] <= y) & (y <= high[i, 1])).astype(bool)
        i, p = i[near], points[j[near], 1:]
        near = ((p != edges[i, :2]).any(axis=1) & (p != edges[i, 2:]).any(axis=1)).astype(bool)
        i, p = i[near], p[near]
        rest = p - edges[i, :2]
        near = (2 * np.abs(d[i, 0] * rest[:, 1] - d[i, 1] * rest[:, 0]) <= np.abs(d[i]).sum(axis=1)).astype(bool)
        stops.append((i[near], (rest * d[i]).sum(axis=1)[near], p[near]))
    edge, along, xy = (np.concatenate(c) for c in zip(*stops))
    order = np.lexsort((along, edge))
    edge, xy = edge[order], xy[order].astype(np.int64)
    vertices, which = _unique(number[edge], xy)
    p, q, whole = which[:-1], which[1:], (edge[1:] == edge[:-1]) & (which[1:] != which[:-1])
    p, q = p[whole], q[whole]
    # vertices are numbered in the order of their coordinates, so p < q is the order of the points
    ends, piece = _unique(np.minimum(p, q), np.column_stack([np.maximum(p, q), np.zeros_like(p)]))
    n = np.bincount(piece, np.where(p < q, 1, -1), len(ends)).astype(np.int64)
    p, q, n = ends[n != 0, 0], ends[n != 0, 1], n[n != 0]
    owner = vertices[p, 0]
    a, b = vertices[p, 1:].astype(edges.dtype), vertices[q, 1:].astype(edges.dtype)
    middle, d = a + b, b - a  # twice the middle, so that all is exact
    # crossings to the right of each piece's middle, upward ones to the left of it positive; a piece's own is left out
    winding = np.zeros(len(n), dtype=np.int64)
    for i, j in _pairs(owner, owner):
        y = middle[i, 1]
        up = (2 * a[j, 1] <= y) & (2 * b[j, 1] > y)
        some = ((up | ((2 * b[j, 1] <= y) & (2 * a[j, 1] > y))) & (i != j)).astype(bool)
        i, j, up = i[some], j[some], up[some].astype(bool)
        off = d[j, 0] * (middle[i, 1] - 2 * a[j, 1]) - d[j, 1] * (middle[i, 0] - 2 * a[j, 0])
        beyond = np.where(up, off, -off) > 0
        winding += np.bincount(i[beyond], np.where(up, n[j], -n[j])[beyond], len(n)).astype(np.int64)
    # that is the winding to the right of a piece, above a level one; pieces run to larger x, so upward ones have it on their right
    left = np.where((d[:, 1] > 0).astype(bool), winding + n, winding)
    right = left - n
    side = (left > 0) != (right > 0)
    p, q = np.where(left > 0, p, q)[side], np.where(left > 0, q, p)[side]
    order = np.argsort(p, kind="stable")
    xy = vertices[:, 1:]
    ring, sizes = _walked(q[order].tolist(), np.searchsorted(p[order], np.arange(len(xy) + 1)).tolist(), xy.tolist())
    ring, sizes = np.array(ring, dtype=np.int64), np.array(sizes, dtype=np.int64)
    before, after = neighbours(sizes)
    into, out = xy[ring] - xy[ring[before]], xy[ring[after]] - xy[ring]
    bent = into[:, 0] * out[:, 1] != into[:, 1] * out[:, 0]
    of = np.repeat(np.arange(len(sizes)), sizes)[bent]
    # a ring begins at its smallest point, which is a corner
    return xy[ring[bent]], np.bincount(of, minlength=len(sizes)), vertices[ring[np.cumsum(sizes) - sizes], 0]


def _buffered(xy: np.ndarray, n: np.ndarray, distance: float, mitre: float, segments: int, precision: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buffers of polygons of n corners each: the corners of their rings and, of each ring, the number of corners, the polygon and the signed area."""
    of = np.repeat(np.arange(len(n)), n)
    new = (xy != xy[neighbours(n)[0]]).any(axis=1)
    n = np.bincount(of[new], minlength=len(n))
    large = np.repeat(n > 2, n)
    polygon, xy, n = np.flatnonzero(n > 2), xy[new][large], n[n > 2]
    after = neighbours(n)[1]
    twice = sums(xy[:, 0] * xy[after, 1] - xy[after, 0] * xy[:, 1], n)
    real = np.isfinite(twice) & (twice != 0)
    xy, polygon, n, twice = xy[np.repeat(real, n)], polygon[real], n[real], twice[real]
    if not len(n):
        return xy, n, polygon, twice
    first = np.cumsum(n) - n
    base, of = xy[first], np.repeat(np.arange(len(n)), n)
    turned = np.where(twice[of] > 0, np.arange(len(xy)), (2 * first + n - 1)[of] - np.arange(len(xy)))
    curve, corner = _moved(xy[turned] - base[of], n, distance, mitre, segments)
    xy, n, at = _wound(np.round(curve / precision).astype(np.int64), of[corner])
    rest = (xy - np.repeat(xy[np.cumsum(n) - n], n, axis=0)) * precision
    after = neighbours(n)[1]
    area = sums(rest[:, 0] * rest[after, 1] - rest[after, 0] * rest[:, 1], n) / 2
    return xy * precision + np.repeat(base[at], n, axis=0), n, polygon[at], area


def buffered_rings(ring: np.ndarray, distance: float, mitre: float = 5.0, segments: int = 0, precision: float = 1e-6) -> list[tuple[np.ndarray, float]]:
    """(ring, signed area) of each ring of a polygon's buffer."""
    xy, n, _, area = _buffered(ring, np.array([len(ring)]), distance, mitre, segments, precision)
    return list(zip(np.split(xy, np.cumsum(n)[:-1]), area.tolist()))


def buffered(polygons: DataFrame, id_col: str, distance: float, ring_col: str = "ring", mitre: float = 5.0, segments: int = 0, precision: float = 1e-6) -> DataFrame:
    """id, ring and area (negative for holes) of each ring of the polygons' buffers; a polygon that a negative distance uses up has none.

    Corners are mitred up to `mitre` times the distance, or arcs of `segments` steps to a quarter circle.
    """
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings = batch.column("ring")
            flat, sizes = rings.flatten(), rings.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            xy = np.column_stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")])
            xy, n, at, areas = _buffered(xy, sizes, distance, mitre, segments, precision)
            corners = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], fields=list(point))
            out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), corners)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), out, pa.array(areas, pa.float64())], ["id", "ring", "area"])

    points = F.transform(ring_col, lambda p: F.struct(p.x.cast("double").alias("x"), p.y.cast("double").alias("y")))
    rows = polygons.where(F.col(ring_col).isNotNull()).select(F.col(id_col).alias("id"), points.alias("ring"))
    kind = rows.schema["id"].dataType.simpleString()
    # small files would leave most of the work to few tasks
    rows = rows.repartition(2 * polygons.sparkSession.sparkContext.defaultParallelism)
    return rows.mapInArrow(work, f"id {kind}, ring array<struct<x:double,y:double>>, area double").withColumnRenamed("id", id_col)
