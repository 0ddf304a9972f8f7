"""Buffers of single polygons."""

import math
import random

import numpy as np
import pytest

from loamframe.operators import buffers

SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]
LETTER = [(0, 0), (30, 0), (30, 10), (10, 10), (10, 40), (0, 40)]
DUMBBELL = [(0, 0), (10, 0), (10, 4), (20, 4), (20, 0), (30, 0), (30, 10), (20, 10), (20, 6), (10, 6), (10, 10), (0, 10)]


def areas(ring, distance, **options):
    return sorted(round(a, 6) for _, a in buffers.buffered_rings(np.array(ring, dtype=float), distance, **options))


@pytest.mark.parametrize(
    "ring,distance,wanted",
    [
        (SQUARE, -2, [36.0]),
        (SQUARE[::-1], -2, [36.0]),
        (SQUARE, 2, [196.0]),
        (SQUARE, -5, []),
        (SQUARE, -6, []),
        (SQUARE, 0, [100.0]),
        (LETTER, -2, [26 * 6 + 6 * 30]),
        (LETTER, 2, [34 * 14 + 14 * 30]),
        (LETTER, -6, []),
        (DUMBBELL, -2, [36.0, 36.0]),
        (DUMBBELL, -0.5, [81 + 81 + 11]),
        (DUMBBELL, 3, [2 * 16 * 16 + 4 * 8]),
        # an open ring closes around a hole
        ([(0, 0), (20, 0), (20, 20), (11, 20), (11, 15), (15, 15), (15, 5), (5, 5), (5, 15), (9, 15), (9, 20), (0, 20)], 2, [-36.0, 576.0]),
    ],
)
def test_right_angles(ring, distance, wanted):
    assert areas(ring, distance) == [round(w, 6) for w in wanted]


def test_sharp_corners_and_arcs():
    needle = [(0, 0), (100, 0), (0, 10)]
    long, short = (buffers.buffered_rings(np.array(needle, dtype=float), 1.0, mitre=m)[0] for m in (50, 2))
    assert long[0][:, 0].max() > 115 and short[0][:, 0].max() < 102 and long[1] > short[1]
    round_ = areas(SQUARE, 2, segments=64)
    assert abs(round_[0] - (100 + 4 * 20 + math.pi * 4)) < 1e-2
    # around a reflex corner an inward buffer keeps its distance
    assert abs(areas(LETTER, -2, segments=64)[0] - (26 * 6 + 6 * 30 + (1 - math.pi / 4) * 4)) < 1e-2
    # what is left of a triangle is the triangle of the same inner circle's centre
    a, b, c = 100.0, 10.0, math.hypot(100, 10)
    inner = a * b / (a + b + c)
    assert areas(needle, -inner * 1.01) == [] and abs(areas(needle, -inner / 2)[0] - a * b / 2 / 4) < 1e-4


def test_inward_points_keep_their_distance():
    draw = random.Random(6)
    for _ in range(40):
        angles = sorted(draw.uniform(0, 2 * math.pi) for _ in range(draw.randrange(3, 15)))
        if max(b - a for a, b in zip(angles, angles[1:] + [angles[0] + 2 * math.pi])) > 3:
            continue
        ring = [(f * math.cos(t), f * math.sin(t)) for t in angles for f in [draw.uniform(4, 20)]]
        d = draw.uniform(0.2, 3)
        found = buffers.buffered_rings(np.array(ring), -d, segments=16)
        edges = list(zip(ring, ring[1:] + ring[:1]))

        def near(x, y):
            best = 1e9
            for (ax, ay), (bx, by) in edges:  # noqa: B023
                t = min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
                best = min(best, math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
            return best

        def inside(r, x, y):
            out = False
            for (ax, ay), (bx, by) in zip(r, [*r[1:], r[0]]):
                if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                    out = not out
            return out

        for _ in range(150):
            x, y = draw.uniform(-20, 20), draw.uniform(-20, 20)
            gap = near(x, y)
            if abs(gap - d) > 0.02 * d:
                assert (sum(inside([tuple(p) for p in r], x, y) for r, _ in found) % 2 == 1) == (inside(ring, x, y) and gap > d)


def test_rows(spark):
    shapes = [(1, SQUARE), (2, None), (3, []), (4, [(0, 0), (1, 1)]), (5, DUMBBELL), (6, SQUARE[:2] * 3), (None, SQUARE)]
    df = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in r] if r is not None else None, "x") for i, r in shapes], "id long, ring array<struct<x:double,y:double>>, area string")
    rows = buffers.buffered(df, "id", -2.0).collect()
    assert sorted((r.id or 0, round(r.area, 6), len(r.ring)) for r in rows) == [(0, 36.0, 4), (1, 36.0, 4), (5, 36.0, 4), (5, 36.0, 4)]
    assert buffers.buffered(df.limit(0), "id", 1.0).count() == 0


def test_rings_of_a_batch_and_wide_rings():
    shapes = [np.array(r, dtype=float) for r in (SQUARE, [(0, 0), (1, 1)], DUMBBELL, LETTER[::-1], [])]
    joined = np.concatenate([s.reshape(-1, 2) for s in shapes])
    _, n, at, area = buffers._buffered(joined, np.array([len(s) for s in shapes]), -2.0, 5.0, 0, 1e-6)
    assert at.tolist() == [0, 2, 2, 3] and n.tolist() == [4, 4, 4, 6] and area.round(6).tolist() == [36.0, 36.0, 36.0, 336.0]
    # thousands of metres are too many steps for products of 64 bits
    wide = [(0.0, 0.0), (4000.0, 300.0), (5200.0, 4100.0), (2500.0, 1900.0), (300.0, 3900.0)]
    small = areas([(x / 100, y / 100) for x, y in wide], -0.5)
    large = areas(wide, -50.0)
    assert len(large) == len(small) and all(abs(a / 10000 - b) < 1e-3 for a, b in zip(large, small))


def test_rings_of_one_partition_are_spread(spark):
    """A small file is one partition, whose rings would all be one task's."""
    df = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in SQUARE]) for k in range(400)], "id long, ring array<struct<x:double,y:double>>").coalesce(1)
    found = buffers.buffered(df, "id", 2.0)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert {(r.n, round(r.area)) for r in found.groupBy("id").agg({"area": "sum", "id": "count"}).toDF("id", "area", "n").collect()} == {(1, 196)}
