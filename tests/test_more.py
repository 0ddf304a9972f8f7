from datetime import date

from pyspark.sql import functions as F

from loamframe.functions import geo
from loamframe.operators import cube, sequences, spatial, tables
from loamframe.plans import features, workflows
from loamframe.plans.specs import FeatureOptions, Season
from loamframe.sources import readers


def test_bands_are_replaced_by_expressions(spark):
    df = spark.createDataFrame([(0, 0, 1.0, 3.0)], "x int, y int, a double, b double")
    out = features.apply_bands(df, lambda bands: {"sum": bands["a"] + bands["b"], "a": bands["a"] * 2}, ["x", "y"])
    assert out.columns == ["x", "y", "sum", "a"] and tuple(out.first())[2:] == (4.0, 2.0)
    features.register("twice", lambda c, band: c.withColumn(band, F.col(band) * 2))
    assert features.process(df, "twice", "b").first().b == 6.0
    assert cube.with_bands(df, {"c": F.col("a") + 1}, keep=["x", "c"]).columns == ["x", "c"]


def test_static_mask_takes_the_first_class(spark):
    layer = spark.createDataFrame([(0, 0, 40), (0, 0, 50), (1, 0, 10)], "x int, y int, MAP int")
    assert {r.x: r.masked for r in cube.static_mask(layer, "MAP", (30, 40)).collect()} == {0: False, 1: True}


def test_clouds_and_dilation_in_the_optical_cube(spark):
    rows = [(x, 0, "2019-04-01", *[2000.0] * 8, 9 if x == 2 else 4, 10.0 if x < 4 else 95.0) for x in range(5)]
    names = ["B03", "B04", "B05", "B06", "B07", "B08", "B11", "B12"]
    df = spark.createDataFrame(rows, "x long, y long, t string, " + ", ".join(f"{b} double" for b in names) + ", SCL int, cloud_cover double").withColumn("t", F.to_timestamp("t"))
    plain = {r.x: r.B06 for r in features.optical_bands(df, FeatureOptions(Season(date(2019, 3, 1), date(2019, 10, 1)))).collect()}
    wide = {r.x: r.B06 for r in features.optical_bands(df, FeatureOptions(Season(date(2019, 3, 1), date(2019, 10, 1)), dilation=3)).collect()}
    assert plain == {0: 7500.0, 1: 7500.0, 2: None, 3: 7500.0} and wide == {0: 7500.0, 1: None, 2: None, 3: None}


def test_lists_positions_and_sizes(spark):
    lists = spark.createDataFrame([("a", ["x", "y"]), ("b", [])], "k string, l array<string>")
    assert [tuple(r) for r in sequences.enumerated(lists, "l").orderBy("k", "position").collect()] == [("a", 0, "x"), ("a", 1, "y")]
    assert {r.k: r.n for r in tables.group_sizes(lists.union(lists), "k").collect()} == {"a": 2, "b": 2}


def test_split_points_and_season(spark):
    pts = [(k, "B11", 0.001 * k, 10.0) for k in range(4)] + [(k, "B11", 100.0 + 0.001 * k, 10.0 + 0.01 * (k % 2)) for k in range(4, 9)] + [(9, "A11", 50.0, 10.0), (10, "B11", -120.0, -60.0), (11, "B11", 170.0, 70.0)]
    df = spark.createDataFrame(pts, "POINT_ID int, LC string, lon double, lat double")
    inside, groups = workflows.split_points(df, "POINT_ID", ["B11"])
    assert inside.where("LC = 'A11'").count() == 0 and sum(r.n for r in groups.collect()) == inside.count() > 0
    rows = spark.createDataFrame([("2019-02-01",), ("2019-03-01",)], "t string").select(workflows.season_of(F.to_date("t")).alias("s")).collect()
    assert [r.s for r in rows] == [2018, 2019]


def test_resources_and_tile_counts(spark, tmp_path, monkeypatch):
    package = tmp_path / "somepackage"
    package.mkdir()
    (package / "__init__.py").write_text("")
    (package / "a.json").write_text('{"k": [1, 2]}')
    monkeypatch.syspath_prepend(str(tmp_path))
    assert readers.read_resource("somepackage", "a.json") == {"k": [1, 2]}
    products = spark.createDataFrame([("t1", "2019-01-01"), ("t1", "2020-01-01")], "tile string, t string").withColumn("t", F.to_timestamp("t"))
    tiles = spark.createDataFrame([("t1",), ("t2",)], "tile string")
    assert {r.tile: r.n for r in spatial.tile_counts(products, tiles, "2019-01-01", "2019-12-31").collect()} == {"t1": 1, "t2": 0}
    split = workflows.tile_providers(spark.createDataFrame([(200, 100), (50, 100), (None, 100)], "sentinel2count int, sentinel1count int"))
    assert [r.provider for r in split.collect()] == ["local", "cloud", "cloud"]


def test_rings_meet_at_corners_edges_and_inside(spark):
    def box(x, y, w):
        return [(float(a), float(b)) for a, b in ((x, y), (x + w, y), (x + w, y + w), (x, y + w))]

    rings = [("apart", box(0, 0, 2), box(5, 5, 1), False), ("corner", box(0, 0, 2), box(2, 2, 1), True), ("edge", box(0, 0, 2), box(2, 0.5, 1), True), ("inside", box(0, 0, 9), box(3, 3, 1), True), ("cross", box(0, 0, 2), box(1, 1, 2), True)]
    rings += [("boxes only", [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)], [(4.0, 4.0), (4.0, 2.5), (2.5, 4.0)], False)]
    df = spark.createDataFrame([(n, a, b, e) for n, a, b, e in rings], "name string, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>, expected boolean")
    for r in df.select("name", "expected", geo.rings_meet("a", "b").alias("ab"), geo.rings_meet("b", "a").alias("ba")).collect():
        assert r.ab == r.ba == r.expected, r.name


def test_reduce_bands_leaves_nulls_out(spark):
    df = spark.createDataFrame([(1, 2.0, None, 4.0), (2, None, None, None)], "k int, a double, b double, c double")
    found = {how: [r.v for r in cube.reduce_bands(df, ["a", "b", "c"], how, "v", ["k"]).orderBy("k").collect()] for how in ("mean", "sum", "min", "max")}
    assert found == {"mean": [3.0, None], "sum": [6.0, None], "min": [2.0, None], "max": [4.0, None]}
