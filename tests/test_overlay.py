"""Unions of polygons, held against covered unit squares and against sampled points."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loamframe.functions import geo
from loamframe.operators import overlay, spatial
from loamframe.operators.celltree import CELL, CellTree
from loamframe.plans import workflows
from loamframe.storage import Scratch

SHAPES = "id long, g string, ring array<struct<x:double,y:double>>"


def frame(spark, shapes):
    return spark.createDataFrame([(i, g, [(float(x), float(y)) for x, y in ring] if ring is not None else None) for i, (g, ring) in enumerate(shapes)], SHAPES)


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def inside(ring, x, y):
    out = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            out = not out
    return out


def shoelace(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def lattice(cells):
    """Area, corners and border length of a set of unit squares."""
    border = sum((x + i, y + j) not in cells for x, y in cells for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1)))
    corners = 0
    for x, y in {(x + i, y + j) for x, y in cells for i in (0, 1) for j in (0, 1)}:
        around = [(x - 1, y - 1) in cells, (x, y - 1) in cells, (x, y) in cells, (x - 1, y) in cells]
        corners += 1 if sum(around) in (1, 3) else 2 if around in ([True, False, True, False], [False, True, False, True]) else 0
    return len(cells), corners, border


@pytest.mark.parametrize("size,limit", [(4.0, 512), (16.0, 12)])
def test_boxes_against_unit_squares(spark, size, limit):
    draw = random.Random(4)
    shapes = []
    for k in range(150):
        x, y, w, h = draw.randrange(-20, 20), draw.randrange(-20, 20), draw.randrange(1, 9), draw.randrange(1, 9)
        ring = box(x, y, w, h)
        shapes.append((draw.choice("ab"), ring[::-1] if k % 3 else ring))
    shapes += [("a", shapes[0][1])] * 5
    rings = overlay.union_rings(frame(spark, shapes), size, by="g", limit=limit).collect()
    for g in "ab":
        cells = {(int(x), int(y)) for h, r in shapes if h == g for x in range(min(p[0] for p in r), max(p[0] for p in r)) for y in range(min(p[1] for p in r), max(p[1] for p in r))}
        mine = [[(p.x, p.y) for p in r.ring] for r in rings if r.g == g]
        length = sum(math.dist(a, b) for ring in mine for a, b in zip(ring, ring[1:] + ring[:1]))
        assert (round(sum(r.area for r in rings if r.g == g), 6), sum(map(len, mine)), round(length, 6)) == lattice(cells)
        assert all(abs(shoelace(ring) - r.area) < 1e-6 for ring, r in zip(mine, (r for r in rings if r.g == g)))


def test_random_shapes_against_points(spark):
    draw = random.Random(9)
    shapes = []
    for _ in range(60):
        cx, cy, r, n = draw.uniform(0, 30), draw.uniform(0, 30), draw.uniform(1, 5), draw.randrange(3, 12)
        angles = sorted(draw.uniform(0, 2 * math.pi) for _ in range(n))
        shapes.append(("a", [(cx + f * math.cos(t), cy + f * math.sin(t)) for t in angles for f in [r * draw.uniform(0.4, 1)]]))
    parts = overlay.dissolved(frame(spark, shapes), 3.0, precision=1e-6, limit=40).collect()
    outers = [([(p.x, p.y) for p in r.ring], [[(p.x, p.y) for p in h] for h in r.holes]) for r in parts]
    for _ in range(4000):
        x, y = draw.uniform(-6, 36), draw.uniform(-6, 36)
        covered = any(inside(ring, x, y) for _, ring in shapes)
        assert sum(inside(o, x, y) and not any(inside(h, x, y) for h in holes) for o, holes in outers) == covered
    for r, (o, holes) in zip(parts, outers):
        assert abs(r.area - shoelace(o) - sum(map(shoelace, holes))) < 1e-6 and shoelace(o) > 0 and all(shoelace(h) < 0 for h in holes)


def test_holes_touching_parts_and_nothing(spark):
    ring_of_boxes = [box(0, 0, 9, 3), box(0, 6, 9, 3), box(0, 0, 3, 9), box(6, 0, 3, 9)]
    island = box(4, 4, 1, 1)
    shapes = [("a", r) for r in [*ring_of_boxes, island]]
    parts = {r.area: r for r in overlay.dissolved(frame(spark, shapes), 5.0).collect()}
    assert set(parts) == {72.0, 1.0} and len(parts[72.0].holes) == 1 and sorted((p.x, p.y) for p in parts[72.0].holes[0]) == [(3, 3), (3, 6), (6, 3), (6, 6)]
    assert parts[1.0].holes == []
    # squares that meet in a corner stay two, those along an edge become one without the edge's ends
    corner = overlay.dissolved(frame(spark, [("a", box(0, 0, 1, 1)), ("a", box(1, 1, 1, 1))]), 1.0).collect()
    edge = overlay.dissolved(frame(spark, [("a", box(0, 0, 1, 1)), ("a", box(1, 0, 1, 1))]), 1.0).collect()
    assert [r.area for r in corner] == [1.0, 1.0] and [len(r.ring) for r in edge] == [4] and edge[0].area == 2.0
    nothing = [("a", None), ("a", []), ("a", [(0, 0), (1, 1)]), ("a", [(0, 0), (1, 1), (2, 2)]), ("a", [(0, 0)] * 4)]
    assert overlay.dissolved(frame(spark, nothing), 1.0).count() == 0 and overlay.dissolved(frame(spark, nothing).limit(0), 1.0, by="g").count() == 0
    null_group = overlay.dissolved(frame(spark, [(None, box(0, 0, 1, 1)), (None, box(0, 0, 2, 1)), ("b", box(0, 0, 1, 1))]), 1.0, by="g").collect()
    assert sorted((r.g or "", r.area) for r in null_group) == [("", 2.0), ("b", 1.0)]


def test_cells_divide_where_boxes_are_many(spark):
    points = spark.range(4000).select((F.rand(1) * 0.9).alias("x"), (F.rand(2) * 0.9).alias("y"), F.col("id")).union(spark.range(50).select(F.col("id") * 1.0, F.lit(5.0), F.col("id")))
    boxes = points.select(F.col("x").alias("_x0"), F.col("y").alias("_y0"), F.col("x").alias("_x1"), F.col("y").alias("_y1"))
    with Scratch(spark) as scratch:
        tree = CellTree(scratch, 1.0, limit=100).grow(boxes)
        placed = tree.place(points, F.col("x"), F.col("y"))
        counts = placed.groupBy(*CELL).count().collect()
        assert placed.count() == 4050 and max(r["count"] for r in counts) <= 100 and len(counts) > 80
        shape = spark.range(1).select(geo.box_ring(F.lit(0.2), F.lit(0.1), F.lit(0.7), F.lit(2.0)).alias("ring"))
        b = geo.ring_box("ring")
        met = placed.join(tree.place(shape, b.minx, b.miny, b.maxx, b.maxy), list(CELL)).where(geo.contains("ring", "x", "y")).count()
        assert met == points.where("x between 0.2 and 0.7 and y between 0.1 and 2.0").count()


def test_corners_far_out(spark):
    """Millions of metres in steps of a micrometre: their products do not fit into 64 bits."""
    east, north = 500_000.0, 5_000_000.0
    shapes = [("a", box(east, north, 10, 10)), ("a", box(east + 5, north + 5, 10, 10)), ("b", box(east, north, 6000, 4000)[::-1])]
    found = overlay.union_rings(frame(spark, shapes), 10_000.0, by="g", precision=1e-6).collect()
    assert sorted((r.g, round(r.area, 3), len(r.ring)) for r in found) == [("a", 175.0, 8), ("b", 24_000_000.0, 4)]


def test_equal_rings_are_dropped_before_they_are_snapped(spark, tmp_path):
    """A small file is one partition: its different rings go to other tasks before the work on them begins."""
    shapes = [("a", box(x, 0, 1, 1)) for x in range(3)] * 50 + [("a", box(0.2, 0.1, 1, 1)), (None, box(0, 0, 1, 1))]
    frame(spark, shapes).coalesce(1).write.parquet(f"{tmp_path}/shapes")
    snapped = overlay._snapped(spark.read.parquet(f"{tmp_path}/shapes").select(F.struct("g").alias("g"), "ring"), "ring", 1.0)
    above, below = snapped._jdf.queryExecution().executedPlan().toString().split("MapInArrow", 1)
    assert "Exchange" in above and "Exchange" in below
    assert sorted((r.g.g or "", [(p.x, p.y) for p in r.ring]) for r in snapped.collect()) == [("", box(0, 0, 1, 1)), *[("a", box(x, 0, 1, 1)) for x in range(3)]]


def test_corners_that_are_not_known(spark):
    rows = [(1, [(0.0, 0.0), (1.0, 0.0), (None, 1.0), (0.0, 1.0)]), (2, [(0.0, 0.0), None, (1.0, 0.0), (0.0, 1.0)]), (3, [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5)])]
    found = overlay.union_rings(spark.createDataFrame(rows, "id int, ring array<struct<x:double,y:double>>"), 4.0, precision=1.0).collect()
    assert [sorted((p.x, p.y) for p in r.ring) for r in found] == [[(-1, -1), (1, -1), (1, 1)]]
    with pytest.raises(Exception, match="not finite"):
        overlay.union_rings(spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0), (float("nan"), 1.0)])], "id int, ring array<struct<x:double,y:double>>"), 4.0)


def outermost(spark, shapes, size=8.0):
    rows = [((g,), i, [tuple(p) for p in ring]) for i, (g, ring) in enumerate(shapes)]
    rings = spark.createDataFrame(rows, "g struct<v:string>, poly long, ring array<struct<x:bigint,y:bigint>>")
    return {r.poly for r in overlay.outermost(rings, size).collect()}


def test_rings_inside_convex_ones_are_left_out(spark):
    big = box(0, 0, 20, 20)
    notch = [(30, 0), (50, 0), (50, 20), (45, 20), (45, 5), (35, 5), (35, 20), (30, 20)]
    star = [(100, 0), (130, 90), (50, 35), (150, 35), (70, 90)]  # turns left only, but winds twice
    far = box(0, 1000, 1 << 31, 1 << 31)  # products of its sides do not fit into 64 bits
    stays = [big, box(15, 15, 6, 2), notch, box(36, 6, 8, 8), star, box(99, 52, 2, 2), [(60, 0), (80, 0), (80, 20)], box(61, 10, 3, 3), far, box(10, 1010, 5, 5)]
    goes = [big[1:] + big[:1], box(0, 0, 5, 20), box(3, 4, 5, 6), [(0, 0), (10, 0), (20, 0), (20, 20), (0, 20)], box(76, 1, 4, 4), [(75, 1), (79, 1), (79, 9), (78, 2)], [(2, 0), (18, 0), (18, 18), (10, 3)]]
    shapes = [("a", r) for r in stays + goes] + [("b", box(3, 4, 5, 6)), (None, box(3, 4, 5, 6)), (None, box(4, 5, 1, 1))]
    kept = outermost(spark, shapes)
    assert kept == {*range(len(stays)), len(stays + goes), len(stays + goes) + 1}
    # more convex rings in a cell than are looked at: fewer go, but none that is inside no other
    stairs = [("a", box(0, 0, k, 200 - k)) for k in range(1, 200)] + [("a", box(0, 0, 1, 1))]
    assert outermost(spark, stairs, 16.0) == set(range(199))


def test_left_out_rings_lie_in_those_that_stay(spark):
    draw = random.Random(2)
    shapes = []
    for k in range(400):
        cx, cy, r, n = draw.randrange(60), draw.randrange(60), draw.randrange(2, 14), draw.randrange(3, 9)
        ring = [(round(cx + f * math.cos(t)), round(cy + f * math.sin(t))) for t in sorted(draw.uniform(0, 2 * math.pi) for _ in range(n)) for f in [r * draw.choice([1, 1, 0.5])]]
        if shoelace(ring) > 0 and len(set(ring)) == n:
            shapes.append(("a", ring))
    kept = outermost(spark, shapes)
    assert 50 < len(kept) < len(shapes) - 30
    for k, (_, ring) in enumerate(shapes):
        if k not in kept:
            edges = [list(zip(r, r[1:] + r[:1])) for i, (_, r) in enumerate(shapes) if i in kept]
            assert any(all((q[0] - p[0]) * (y - p[1]) >= (q[1] - p[1]) * (x - p[0]) for p, q in e for x, y in ring) for e in edges)


def test_cells_of_a_step_are_not_divided(spark, monkeypatch):
    """More edges than the limit meet in one grid point; no cell, however small, has fewer."""
    made = []
    monkeypatch.setattr(overlay, "CellTree", lambda *a: made.append(CellTree(*a)) or made[-1])
    shapes = [("a", box(0, 0, k, 9 - k)) for k in range(1, 9)]
    found = overlay.union_rings(frame(spark, shapes), 16.0, precision=1.0, limit=2).collect()
    assert [(r.area, len(r.ring)) for r in found] == [(36.0, 18)] and len(made[0].full) <= made[0].depth == 4
    overlay.union_rings(frame(spark, shapes), 0.5, precision=1.0)
    assert made[1].depth == 0 and made[1].full == []


def test_equal_parcels_are_looked_up_once(spark, monkeypatch):
    """One inner point per different ring, dealt out over tasks, and the attributes of the smallest id."""
    seen = []
    join = spatial.spatial_join
    monkeypatch.setattr(spatial, "spatial_join", lambda points, *a, **k: seen.append(points.count()) or join(points, *a, **k))
    shapes = [(9 - i % 10, f"n{9 - i % 10}", box(10 * (i % 2), 0, 4, 4) if i < 10 else None) for i in range(11)]
    parcels = spark.createDataFrame([(i + 10 * (r is None), n, [(float(x), float(y)) for x, y in r] if r else None) for i, n, r in shapes], "id long, name string, ring array<struct<x:double,y:double>>")
    found = workflows.dissolved_parcels(parcels, "id", 8.0, precision=1.0).collect()
    assert sorted((r.id, r.name, r.area) for r in found) == [(0, "n0", 16.0), (1, "n1", 16.0)] and seen[0] <= 3
