"""Groups of shapes that meet, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from loamframe.functions import geo
from loamframe.operators import spatial

RING = "array<struct<x:double,y:double>>"


def groups(ids, links):
    found = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            found[a] = found[b] = min(found[a], found[b])
    return found


@pytest.mark.parametrize("limit,crowd", [(4, 1), (64, 30), (2, 3)])
def test_rings(spark, limit, crowd):
    draw = random.Random(limit)
    shapes = []
    for k in range(30):
        x, y, r = draw.randrange(60), draw.randrange(60), draw.choice([1, 3, 9])
        ring = [(x, y), (x + r, y - r), (x + 2 * r, y), (x + r, y + r)] if k % 3 else [(x, y), (x + 20, y + 1), (x + 20, y + 20), (x + 19, y + 20), (x + 19, y + 2)]
        shapes += [[(float(a), float(b)) for a, b in ring]] * (crowd if k % 2 else 1)
    df = spark.createDataFrame([(k, s) for k, s in enumerate(shapes)] + [(900, None), (901, []), (902, [])], f"id long, ring {RING}")
    a, b = df.toDF("a", "ra"), df.toDF("b", "rb")
    links = [(r.a, r.b) for r in a.crossJoin(b).where((F.col("a") < F.col("b")) & geo.rings_meet("ra", "rb")).collect()]
    wanted = groups([*range(len(shapes)), 900, 901, 902], links)
    found = {r.id: r.group for r in spatial.overlapping_rings(df, "id", 8.0, limit=limit).collect()}
    assert found == wanted


def test_boxes_and_boxes_without_width(spark):
    draw = random.Random(3)
    boxes = [(k, x, y, x + draw.randrange(6), y + draw.randrange(6)) for k in range(60) for x in [draw.randrange(40)] for y in [draw.randrange(40)]]
    boxes += [(60, 8, 0, 8, 9), (61, 8, 0, 8, 9), (62, 7, 1, 12, 8), (63, 100, 0, 100, 5), (64, 100, 0, 100, 5)]
    df = spark.createDataFrame([(k, *map(float, b)) for k, *b in boxes], "id long, minx double, miny double, maxx double, maxy double")
    meet = lambda p, q: p[1] < q[3] and q[1] < p[3] and p[2] < q[4] and q[2] < p[4]
    wanted = groups([b[0] for b in boxes], [(p[0], q[0]) for p in boxes for q in boxes if p[0] < q[0] and meet(p, q)])
    for limit in (2, 64):
        assert {r.id: r.group for r in spatial.overlapping_groups(df, "id", 4.0, limit).collect()} == wanted


def test_many_equal_rings_are_not_compared_in_pairs(spark):
    """All pairs of 30 000 rings in one place would not end."""
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))])
    df = spark.range(30_000).select("id", ring.alias("ring"))
    assert spatial.overlapping_rings(df, "id", 8.0).groupBy("group").count().collect() == [(0, 30_000)]
