"""Crowded spatial joins, indexed files and alignment of grids."""

import math

from pyspark.sql import functions as F

from loamframe.functions import geo
from loamframe.operators import cube, spatial
from loamframe.sources import readers, sinks


def boxes(spark, n):
    k = F.col("id")
    return spark.range(n).select("id", geo.box_ring(k % 20 * 1.0, F.floor(k / 20) * 1.0, k % 20 + 0.5, F.floor(k / 20) + 0.5).alias("ring"))


def test_join_of_a_crowded_cell(spark):
    crowd = spark.range(9000).select(F.col("id").alias("p"), (F.rand(3) * 0.99).alias("x"), (F.rand(4) * 0.99).alias("y"))
    points = crowd.union(spark.range(1000).select(F.col("id") + 9000, F.rand(5) * 20, F.rand(6) * 20)).cache()
    polygons = boxes(spark, 400).withColumnRenamed("id", "zone")
    fields = lambda df: sorted((r.p, r.zone) for r in df.collect())
    for how in ("left", "inner"):
        whole = spatial.spatial_join(points, polygons, "p", how=how, size=1.0, limit=10**9).select("p", "zone")
        split = spatial.spatial_join(points, polygons, "p", how=how, size=1.0, limit=300).select("p", "zone")
        assert sorted(map(str, whole.collect())) == sorted(map(str, split.collect()))
    assert fields(spatial.spatial_join(points, polygons, "p", how="inner", limit=300).where("p < 9000")) == [(r.p, 0) for r in points.where("p < 9000 and x < 0.5 and y < 0.5").orderBy("p").collect()]
    semi, anti = (spatial.spatial_join(points, polygons, "p", how=h, limit=300).count() for h in ("left_semi", "left_anti"))
    assert semi + anti == 10_000 and spatial.spatial_join(points.limit(0), polygons, "p").count() == 0


def test_files_that_a_mask_leaves_closed(spark, tmp_path):
    features = boxes(spark, 400).withColumn("kind", F.lit("k"))
    sinks.write_indexed(features, f"{tmp_path}/f", 1.0, files=16)
    mask = spark.createDataFrame([([(2.6, 3.1), (4.2, 3.1), (4.2, 4.3), (2.6, 4.3)],)], "ring array<struct<x:double,y:double>>")
    opened = readers.read_indexed(spark, f"{tmp_path}/f", mask, "id", 2.0, exact=False)
    found = readers.read_indexed(spark, f"{tmp_path}/f", mask, "id", 2.0)
    assert spark.read.parquet(f"{tmp_path}/f/boxes").count() == 16 and 1 <= len(opened.inputFiles()) <= 6
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in readers.masked(features, mask, "id").collect()) == [63, 64, 83, 84]
    far = spark.createDataFrame([([(90.0, 90.0), (91.0, 90.0), (91.0, 91.0)],)], "ring array<struct<x:double,y:double>>")
    assert readers.read_indexed(spark, f"{tmp_path}/f", far, "id", 2.0).count() == 0
    assert readers.read_indexed(spark, f"{tmp_path}/f", mask.limit(0), "id", 2.0).columns == features.columns


def test_alignment(spark):
    pixels = spark.range(400).select((F.col("id") % 20 * 10 + 5).alias("x"), (F.floor(F.col("id") / 20) * 10 + 5).alias("y"))
    linear = pixels.withColumn("v", F.col("x") * 2.0 + F.col("y")).withColumn("t", F.lit("d1"))
    targets = spark.createDataFrame([(1, 33.0, 41.5), (2, 5.0, 5.0), (3, 1.0, 50.0), (4, 500.0, 5.0)], "id int, x double, y double")
    got = {r.id: (r.v, r.t) for r in cube.align(linear, targets, 10.0, ["v"], others=["t"]).collect()}
    assert got == {1: (33 * 2 + 41.5, "d1"), 2: (15.0, "d1"), 3: (5 * 2 + 50.0, "d1"), 4: (None, None)}
    got = {r.id: r.v for r in cube.align(linear, targets, 10.0, ["v"], "nearest").collect()}
    assert got == {1: 35 * 2 + 45.0, 2: 15.0, 3: 5 * 2 + 55.0, 4: None}
    holes = linear.withColumn("v", F.when(F.col("x") != 35, F.col("v")))
    assert math.isclose(cube.align(holes, targets.where("id = 1"), 10.0, ["v"]).first().v, 25 * 2 + 41.5)


def test_alignment_across_zones(spark):
    # 6 degrees east lies between zones 31 and 32
    centre = spark.range(1).select(geo.utm_project(F.lit(6.0), F.lit(50.0), F.lit(31)).alias("a"), geo.utm_project(F.lit(6.0), F.lit(50.0), F.lit(32)).alias("b")).first()
    base = [math.floor(v / 10) * 10 for v in (centre.a.x, centre.a.y)]
    pixels = spark.range(1600).select((F.col("id") % 40 * 10 + base[0] - 195.0).alias("x"), (F.floor(F.col("id") / 40) * 10 + base[1] - 195.0).alias("y"))
    at = geo.utm_unproject("x", "y", F.lit(31))
    source = pixels.withColumn("v", at.lon * 1000 + at.lat * 500)
    targets = spark.range(9).select("id", (F.col("id") % 3 * 20 + centre.b.x - 20).alias("x"), (F.floor(F.col("id") / 3) * 20 + centre.b.y - 20).alias("y"))
    found = cube.align(source, targets, 10.0, ["v"], locate=cube.between_zones(32, 31))
    there = geo.utm_unproject("x", "y", F.lit(32))
    assert found.where(F.abs(F.col("v") - (there.lon * 1000 + there.lat * 500)) < 1e-4).count() == 9
