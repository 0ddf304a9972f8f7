import numpy as np
import pytest
from pyspark.sql import functions as F

from loamframe.functions import geo
from loamframe.operators import cube, sampling, sequences, spatial, tables, temporal
from loamframe.plans import features, workflows
from loamframe.plans.specs import FeatureOptions, Intervals, Season


def test_assign_intervals_matches_definition(spark):
    for days, step, overlap in ((30, 1, 1), (40, 10, 10), (50, 12, 6), (20, 5, 0), (10, 20, 0)):
        spec = Intervals(days, step, overlap)
        df = spark.range(-5, days + 5).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("t"), "id")
        found = sorted((r.id, r.k) for r in temporal.assign_intervals(df, "2024-01-01", spec).collect())
        assert found == sorted((d, k) for d in range(-5, days + 5) for k in range(spec.count) if k * step <= d < k * step + spec.width)


def test_interpolation_leaves_edges(spark):
    series = [None, 1.0, None, None, 7.0, None, 9.0, None]
    df = spark.createDataFrame([("p", k, v) for k, v in enumerate(series)], "pixel string, k int, v double")
    out = [r.v for r in temporal.interpolate_linear(df, ["pixel"], ["v"]).orderBy("k").collect()]
    assert out == [None, 1.0, 3.0, 5.0, 7.0, 8.0, 9.0, None]


def test_edge_fill_order(spark):
    def fill(*t):
        cols = [F.lit(x).cast("double") for x in t]
        return list(spark.range(1).select(*[c.alias(f"t{i}") for i, c in enumerate(temporal.edge_filled(cols))]).first())

    assert fill(None, None, 2, 3, None, None) == [2, 2, 2, 3, 3, 3]
    assert fill(None, 1, None, None, 4, None) == [1, 1, None, None, 4, 4]
    assert fill(None, None, None, 3, 4, 5) == [None, None, None, 3, 4, 5]


def test_densify_has_every_window(spark):
    cells = spark.createDataFrame([("a", 1, 5.0), ("b", 0, None)], "pixel string, k int, v double")
    out = {(r.pixel, r.k): r.v for r in temporal.densify(cells, ["pixel"], 3, ["v"]).collect()}
    assert out == {(p, k): 5.0 if (p, k) == ("a", 1) else None for p in "ab" for k in range(3)}


def test_merge_needs_a_resolver(spark):
    a, b = (spark.createDataFrame([(k, float(k))], "x int, v double") for k in (1, 2))
    with pytest.raises(ValueError, match="resolver"):
        cube.merge(a, b, ["x"])
    assert sorted(tuple(r) for r in cube.merge(a, b, ["x"], F.coalesce).collect()) == [(1, 1.0), (2, 2.0)]


def test_masks_keep_rows(spark):
    df = spark.createDataFrame([(x, y, 1.0) for x in range(5) for y in range(5)], "x int, y int, v double")
    out = cube.mask_dilated(df, (F.col("x") == 2) & (F.col("y") == 2), cube.square_kernel(3), ["v"], ["x", "y"])
    assert {(r.x, r.y) for r in out.collect() if r.v is None} == {(x, y) for x in (1, 2, 3) for y in (1, 2, 3)} and out.count() == 25
    kernel = cube.gaussian_kernel(3, 1.0)
    assert abs(sum(w for *_, w in kernel) - 1) < 1e-12
    soft = cube.mask_convolved(df, (F.col("x") == 2) & (F.col("y") == 2), kernel, 0.1, ["v"], ["x", "y"])
    assert {(r.x, r.y) for r in soft.collect() if r.v is None} == {(x, y) for x, y in [(2, 2), (1, 2), (3, 2), (2, 1), (2, 3)]}


def test_replicate_undoes_resample(spark):
    df = spark.createDataFrame([(x, y, x * 10 + y) for x in range(3) for y in range(2)], "x long, y long, v int")
    fine = cube.replicate(df, 2)
    assert fine.count() == 24
    assert sorted(tuple(r) for r in cube.resample(fine, 2, {"v": "max"}).collect()) == sorted(tuple(r) for r in df.collect())


def test_spatial_join_is_brute_force(spark):
    rng = np.random.default_rng(1)
    pts = [(k, *map(float, rng.uniform(0, 20, 2))) for k in range(200)]
    polys = []
    for z in range(12):
        c, r = rng.uniform(2, 18, 2), rng.uniform(1, 5)
        angles = np.sort(rng.uniform(0, 2 * np.pi, 7))
        polys.append((z, [(float(c[0] + r * np.cos(a)), float(c[1] + r * np.sin(a))) for a in angles]))
    points = spark.createDataFrame(pts, "id long, x double, y double")
    shapes = spark.createDataFrame(polys, "zone int, ring array<struct<x:double,y:double>>")

    def inside(ring, x, y):
        hit = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                hit = not hit
        return hit

    expected = {(i, z) for i, x, y in pts for z, ring in polys if inside(ring, x, y)}
    for size in (0.7, 3.0, 50.0):
        assert {(r.id, r.zone) for r in spatial.spatial_join(points, shapes, "id", size=size, how="inner").collect()} == expected
    assert {r.id for r in spatial.spatial_join(points, shapes, "id", how="left_anti").collect()} == {i for i, *_ in pts} - {i for i, _ in expected}
    first = {r.id: r.zone for r in spatial.spatial_join(points, shapes, "id", keep="zone").collect()}
    assert len(first) == 200 and all(first[i] == min((z for j, z in expected if j == i), default=None) for i in first)


def test_convex_hull_of_split_groups(spark):
    rng = np.random.default_rng(2)
    xy = [(float(x), float(y)) for x, y in rng.normal(0, 1, (500, 2))] + [(-9.0, -9.0), (9.0, -9.0), (9.0, 9.0), (-9.0, 9.0)]
    df = spark.createDataFrame([(1, *p) for p in xy] + [(2, 0.0, 0.0), (2, 1.0, 1.0), (3, 5.0, 5.0)], "g int, x double, y double")
    rings = {r.g: {tuple(p) for p in r.ring} for r in spatial.convex_hulls(df, "g", parts=7).collect()}
    assert rings == {1: set(xy[-4:]), 2: {(0.0, 0.0), (1.0, 1.0)}, 3: {(5.0, 5.0)}}


def test_gap_groups_over_blocks(spark):
    rng = np.random.default_rng(3)
    pts = [(k, float(rng.uniform(-180, 180)), float(rng.uniform(-80, 80))) for k in range(300)]
    df = spark.createDataFrame(pts, "id long, lon double, lat double")
    rows = sequences.gap_groups(df, "id", break_km=1500.0).orderBy("cell", "id").collect()
    assert len(rows) == 300
    group, previous = 0, None
    for r in rows:
        if previous is not None:
            d = 2 * geo.EARTH_KM * np.arcsin(np.sqrt(np.sin(np.radians(r.lat - previous.lat) / 2) ** 2 + np.cos(np.radians(previous.lat)) * np.cos(np.radians(r.lat)) * np.sin(np.radians(r.lon - previous.lon) / 2) ** 2))
            assert abs(d - r.distance_km) < 1e-6
            group += d > 1500
        else:
            assert r.distance_km is None
        assert r.group == group
        previous = r
    assert all(r.inside == (0 < r.group < group) for r in rows)


@pytest.mark.parametrize("n", [0, 1, 149, 150, 151, 449, 450, 1000])
def test_chunks_like_near_equal_splits(spark, n):
    df = spark.range(n).withColumn("g", F.lit(1))
    sizes = [r["count"] for r in sampling.chunked(df, ["g"], ["id"]).groupBy("chunk").count().orderBy("chunk").collect()]
    assert sizes == ([len(x) for x in np.array_split(np.arange(n), n // 150 + 1)] if n else [])


def test_samples_are_deterministic_and_within_budget(spark):
    df = spark.range(500).withColumn("c", F.col("id") % 7)
    for n in (3, 1000):
        a, b = (sorted(tuple(r) for r in sampling.sample_replicated(x, ["c"], ["id"], n, 3).collect()) for x in (df, df.repartition(5)))
        counts = {}
        for _, c, _ in a:
            counts[c] = counts.get(c, 0) + 1
        assert a == b and all(v == min(n, 3 * (500 // 7 + (c < 500 % 7))) for c, v in counts.items())
    with pytest.raises(ValueError, match=r"\[9\]"):
        sampling.two_sources(df, df, "c", ["id"], 2, 2, required=[1, 9])
    share = df.where(sampling.train_part(["id"], 0.7)).count()
    assert 300 < share < 400


def test_points_lie_inside(spark):
    shapes = spark.createDataFrame([(k, [(0.0, 0.0), (10.0 + k, 0.0), (3.0, 8.0)]) for k in range(50)], "id int, ring array<struct<x:double,y:double>>")
    out = sampling.points_in_polygons(shapes, "id", margin=0.5)
    ok = out.select(geo.contains("ring", "px", "py").alias("i"), geo.edge_distance("ring", "px", "py").alias("d")).collect()
    assert len(ok) == 50 and all(r.i and r.d >= 0.5 for r in ok)


def test_points_lie_inside_thin_and_concave_rings(spark):
    u = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (9.99, 10.0), (9.99, 0.01), (0.01, 0.01), (0.01, 10.0), (0.0, 10.0)]
    thin = [(0.0, 0.0), (10.0, 10.0), (10.0, 10.001), (0.0, 0.001)]
    shapes = spark.createDataFrame([(k, u if k % 2 else thin) for k in range(20)], "id int, ring array<struct<x:double,y:double>>")
    for share in (0.0, 1.0):
        out = sampling.points_in_polygons(shapes, "id", margin=0.5, centroid_share=share)
        assert out.count() == 20 and out.where(geo.contains("ring", "px", "py")).count() == 20


def test_tables(spark):
    a = spark.createDataFrame([(1, "x")], "k int, a string")
    b = spark.createDataFrame([(2, 0.5)], "k int, b double")
    assert sorted(map(tuple, tables.union_all([a, b]).collect())) == [(1, "x", None), (2, None, 0.5)]
    assert tables.append_row(a, k=3).count() == 2 and tables.with_defaults(a, {"a": F.lit("y"), "c": F.lit(1)}).first().asDict() == {"k": 1, "a": "x", "c": 1}
    lists = spark.createDataFrame([(1, [1, 2]), (2, [])], "k int, l array<int>")
    assert tables.exploded(lists, "l", "e").count() == 2 and tables.exploded(lists, "l", "e", drop_empty=False).count() == 3
    with pytest.raises(ValueError):
        tables.union_all([])


def test_feature_cube_of_both_sensors(spark):
    options = FeatureOptions(Season.crops(2019))
    start = options.season.start.isoformat()
    optical = spark.range(2 * 46).select(
        (F.col("id") % 2).alias("x"), F.lit(0).cast("long").alias("y"), F.date_add(F.lit(start).cast("date"), (F.floor(F.col("id") / 2) * 5).cast("int")).cast("timestamp").alias("t"),
        *[(F.rand(k) * 4000 + 500).alias(b) for k, b in enumerate(("B03", "B04", "B05", "B06", "B07", "B08", "B11", "B12"))],
        F.when(F.col("id") % 5 == 0, 9).otherwise(4).alias("SCL"), F.lit(10.0).alias("cloud_cover"),
    )
    radar = spark.range(2 * 38).select(
        (F.col("id") % 2).alias("x"), F.lit(0).cast("long").alias("y"), F.date_add(F.lit(start).cast("date"), (F.floor(F.col("id") / 2) * 6).cast("int")).cast("timestamp").alias("t"),
        (F.rand(8) * 0.2 + 0.01).alias("VV"), (F.rand(9) * 0.05 + 0.001).alias("VH"),
    )
    land = spark.createDataFrame([(0, 0, 40), (1, 0, 10)], "x long, y long, MAP int")
    merged, names = features.load_features(optical, radar, options, land)
    rows = {r.x: r.asDict() for r in merged.collect()}
    assert len(names) == 120 and set(names) <= set(merged.columns) and len(rows) == 2
    assert all(0 <= rows[0][n] <= 30000 for n in names if rows[0][n] is not None and not n.endswith("_sd")) and rows[0]["NDVI_p50"] is not None
    assert all(rows[1][n] is None for n in names)
    only, few = features.load_features(None, radar, options)
    assert len(few) == 30 and set(only.columns) == {"x", "y", *few}
    with pytest.raises(ValueError):
        features.load_features(None, None, options)


def test_raw_series_on_both_dates(spark):
    a = spark.createDataFrame([(0, 0, "2019-01-01", 1.0), (0, 0, "2019-01-05", 2.0)], "x long, y long, t string, B04 double").withColumn("t", F.to_timestamp("t"))
    b = spark.createDataFrame([(0, 0, "2019-01-05", 0.1, 0.01), (0, 0, "2019-02-01", 0.1, 0.0)], "x long, y long, t string, VV double, VH double").withColumn("t", F.to_timestamp("t"))
    rows = features.raw_series(a, b, "2019-01-01", "2019-02-01").orderBy("t").collect()
    assert [(r.B04, r.VV and round(r.VV, 6)) for r in rows] == [(1.0, None), (2.0, -10.0)]
    assert features.process(a, "aggregate_dekads", ["x", "y"], ["B04"]).count() == 1


def test_sampling_workflow_end_to_end(spark):
    def rows(kind, n, codes):
        return spark.createDataFrame(
            [(f"{kind}{k}", codes[k % len(codes)], 2018 + k % 2, "2018_BE_LPIS_POLY_110" if k % 3 else "2018_FR_LPIS_POLY_110", [(3.0 + k * 0.001, 50.0), (3.001 + k * 0.001, 50.0), (3.0 + k * 0.001, 50.001)]) for k in range(n)],
            "pid string, CT int, year int, ref_id string, ring array<struct<x:double,y:double>>",
        )

    both = workflows.reference_set(rows("p", 400, [1110, 1200, 3300]), rows("q", 60, [1100, 9120]), remap={1100: 1110}, without=[9120])
    assert both.where("CT IN (1100, 9120)").count() == 0 and {r.zonenumber for r in both.select("zonenumber").distinct().collect()} == {31}
    strata = spark.createDataFrame([(1.0, 2.0, [(2.0, 49.0), (4.0, 49.0), (4.0, 51.0), (2.0, 51.0)])], "groupID double, zoneID double, ring array<struct<x:double,y:double>>")
    out = workflows.sample_polygons(both.where("source = 'parcel'"), both.where("source = 'point'"), strata, [1110, 1200], workflows.SampleBudget(50, 20, 10, 5, 3), ["pid"], [2018, 2019], [31], per_file=20)
    counts = {(r.crop, r.source): r["count"] for r in out.groupBy("crop", "source").count().collect()}
    assert counts == {(1110, "parcel"): 50, (1200, "parcel"): 50, (3300, "parcel"): 20, (1110, "point"): 10}
    assert out.where("groupID IS NULL").count() == 0
    own, others = workflows.by_country(out, "BE")
    assert own.count() + others.count() == out.count() and own.count() > 0


def test_land_use_reference_and_strata(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    area = spark.createDataFrame([(square,)], "ring array<struct<x:double,y:double>>")
    shapes = spark.createDataFrame([(1, "B11", [(1.0, 1.0), (2.0, 1.0), (1.0, 2.0)]), (2, "A11", [(20.0, 20.0), (21.0, 20.0), (20.0, 21.0)])], "id int, LC1 string, ring array<struct<x:double,y:double>>")
    from loamframe.functions.legends import LAND_COVER

    classes = {"crops": [c for c in LAND_COVER if c[0] == "B"], "rest": [c for c in LAND_COVER if c[0] != "B"]}
    rows = workflows.land_use_reference(shapes, area, 4, classes, "id").collect()
    assert len(rows) == 4 and {r.target for r in rows} == {0} and {r.id for r in rows} == {1}
    with pytest.raises(ValueError, match="area of interest"):
        workflows.land_use_reference(shapes, None, 1, classes, "id")
    with pytest.raises(ValueError, match="no reference"):
        workflows.land_use_reference(shapes.where("id = 2"), area, 1, classes, "id")
    one = spark.createDataFrame([(1,)], "k int")
    two = spark.createDataFrame([(1, "a"), (2, "b")], "k int, stratum string")
    assert workflows.checked_strata(one, one)[0].first().stratum == "stratum0"
    assert workflows.checked_strata(two, two)[1].count() == 2
    for a, b, why in ((one, two, "more strata"), (two.drop("stratum"), two, "sampled strata lack"), (two, two.drop("stratum"), "inferred strata lack"), (two, two.withColumn("stratum", F.lit("z")), "not inferred")):
        with pytest.raises(ValueError, match=why):
            workflows.checked_strata(a, b)


def test_validation_and_parcels(spark):
    points = spark.createDataFrame([(1, 3.0, 4.0), (2, 13.0, 4.0), (1, 25.0, 4.0), (1, 99.0, 99.0)], "target int, x double, y double")
    raster = spark.createDataFrame([(5.0, 5.0, 1), (15.0, 5.0, 1), (25.0, 5.0, 255)], "x double, y double, predicted int")
    out = workflows.map_validation(points, raster)
    assert out["missing"].first().missing == 2 and out["accuracy"].first().accuracy == 0.5
    parcels = spark.createDataFrame([(0, 3, 1.0), (1, 2, 1.0), (2, 3, 1e-9), (3, 1, 1.0)], "feature_index int, crop_type int, area double")
    pixels = spark.createDataFrame([(0, 3), (0, 3), (1, 9), (2, 3), (3, 1)], "feature_index int, class int")
    assert {r.feature_index for r in workflows.parcel_counts(parcels, pixels, range(1, 8), without=[1]).collect()} == {0}
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0), (2, 1.0, 1.0, 3.0, 3.0), (3, 2.5, 2.5, 4.0, 4.0), (4, 9.0, 9.0, 9.5, 9.5)], "id int, minx double, miny double, maxx double, maxy double")
    assert {r.id for r in workflows.without_overlaps(boxes, "id", 2.0).collect()} == {1, 4}


def test_training_rows_and_plans(spark):
    files = spark.createDataFrame([("/r/year2019_zone31_id8100_p0/out_12.nc", b, s, v) for b in ("B06",) for s, v in (("p25", 1.0), ("p25", 3.0), ("sd", 65535.0))], "path string, band string, stat string, value double")
    place = spark.createDataFrame([(2019, 31, 8100, 0, 12, 1.0, 2.0)], "year int, zone int, crop int, part int, position int, groupID double, zoneID double")
    row = workflows.training_rows(files, ["B06_p25", "B06_sd"], place).first()
    assert (row.B06_p25, row.B06_sd, row.groupID) == (2.0, None, 1.0)
    todo = workflows.extraction_plan(
        spark.createDataFrame([("a_year2019_zone31_id1_p0.json",), ("a_year2018_zone31_id1_p0.json",)], "path string"),
        spark.createDataFrame([("a_year2019_zone31_id1_p0.json", "u")], "path string, provider string"),
        spark.createDataFrame([(2018,), (2019,)], "year int"), spark.createDataFrame([("u",), ("v",)], "provider string"), spark.createDataFrame([(31,), (32,)], "zone int"),
    )
    assert todo.count() == 3
    tiles = spark.createDataFrame([("31UFS", 80.0), ("31UFT", 20.0), ("31UGS", 90.0)], "tile string, cropland_perc double")
    assert [r.tile for r in workflows.production_tiles(tiles, tiles.where("tile = '31UGS'").select("tile")).collect()] == ["31UFS", "31UFT"]
    messages = spark.createDataFrame([("31UFS", "error PRODUCT_31UFS"), ("31UFS", "error PRODUCT_31UFS"), ("31UFT", "nothing")], "tile string, message string")
    assert [tuple(r) for r in workflows.missing_products(messages, tiles.select("tile"), tiles.limit(0).select("tile")).collect()] == [("31UFS", ["PRODUCT_31UFS"], 1)]
