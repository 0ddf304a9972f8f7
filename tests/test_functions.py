import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from loamframe.functions import arith, geo, legends, text
from loamframe.plans.specs import FeatureOptions, Intervals, Season, feature_names


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_intervals_end_strictly_before_the_last_day():
    for days in range(0, 60, 7):
        for step, overlap in ((1, 1), (5, 0), (10, 10), (12, 6)):
            spec = Intervals(days, step, overlap)
            count, end = 0, step + overlap
            while end < days:
                count, end = count + 1, end + step
            assert spec.count == count
            start = date(2020, 3, 1)
            assert all(b - a == timedelta(days=step + overlap) for a, b in spec.bounds(start))


def test_season_constants():
    crops, land = Season.crops(2019), Season.land_use()
    assert (crops.optical().count, crops.radar().count) == (21, 18)
    assert crops.optical().picks == (4, 7, 10, 13, 16, 19) and crops.radar().picks == (2, 5, 8, 11, 14, 17)
    assert land.optical().picks == (2, 6, 10, 14, 18, 22) and land.radar().picks == (2, 5, 8, 11, 14, 17)
    options = FeatureOptions(crops)
    names = feature_names(options.optical_features) + feature_names(options.radar_features)
    assert len(names) == 120 == len(set(names)) and "NDVI_p50" in names and "VH_t5" in names


@pytest.mark.parametrize("lat,zone,code", [(50, 32, 32632), (-50, 32, 32732), (0, 1, 32601)])
def test_epsg(spark, lat, zone, code):
    assert one(spark, geo.utm_epsg(F.lit(float(lat)), F.lit(zone))) == code


@pytest.mark.parametrize("lon,lat,zone,letter", [(3.0, 50.0, 31, "U"), (5.0, 60.0, 32, "V"), (10.0, 78.0, 33, "X"), (-180.0, -80.0, 1, "C"), (180.0, 84.0, 1, "X"), (-4.84, 40.0, 30, "T")])
def test_utm_zone(spark, lon, lat, zone, letter):
    assert one(spark, geo.utm_zone(F.lit(lon), F.lit(lat))) == zone and one(spark, geo.utm_letter(F.lit(lat))) == letter


def test_projection(spark):
    p = one(spark, geo.utm_project(F.lit(3.0), F.lit(0.0), F.lit(31)))
    assert abs(p.x - 500000) < 1e-6 and abs(p.y) < 1e-6
    p = one(spark, geo.utm_project(F.lit(3.0), F.lit(50.0), F.lit(31)))
    assert abs(p.x - 500000) < 1e-6 and abs(p.y - 5538630.70) < 0.05  # the meridian's length to 50 degrees times 0.9996
    south = one(spark, geo.utm_project(F.lit(4.5), F.lit(-20.0), F.lit(31)))
    north = one(spark, geo.utm_project(F.lit(4.5), F.lit(20.0), F.lit(31)))
    assert abs(south.y - (10000000 - north.y)) < 1e-6 and abs(south.x - north.x) < 1e-6


def test_polygons(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 2), (0, 2))])
    assert one(spark, geo.area(ring)) == 8 and tuple(one(spark, geo.centroid(ring))) == (2, 1)
    assert one(spark, geo.contains(ring, F.lit(1.0), F.lit(1.0))) and not one(spark, geo.contains(ring, F.lit(5.0), F.lit(1.0)))
    assert one(spark, geo.edge_distance(ring, F.lit(1.0), F.lit(1.5))) == 0.5
    assert one(spark, geo.area(geo.square(F.lit(3.0), F.lit(7.0), 10.0))) == 400
    flat = F.array(*[F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))] * 3)
    assert one(spark, geo.centroid(flat)) is None


def test_cells_keep_bits(spark):
    rows = spark.range(64).select("id", geo.interleave(F.col("id") % 8, F.floor(F.col("id") / 8), 3).alias("z")).collect()
    for r in rows:
        x, y = r.id % 8, r.id // 8
        assert r.z == sum((x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1 for k in range(3))


@pytest.mark.parametrize("v,expected", [(-5.0, 0.0), (0.0, 0.0), (4000.0, 15000.0), (9000.0, 30000.0), (None, None)])
def test_scaling(spark, v, expected):
    assert one(spark, arith.scale_to_int16(F.lit(v).cast("double"), "band")) == expected


def test_arithmetic_edges(spark):
    null = F.lit(None).cast("double")
    assert one(spark, arith.normalized_difference(F.lit(1.0), F.lit(-1.0))) is None
    assert one(spark, arith.decibel(F.lit(0.0))) is None and one(spark, arith.decibel(F.lit(100.0))) == 20
    assert one(spark, arith.angle_at_nir(null, F.lit(1.0), F.lit(1.0))) is None
    assert abs(one(spark, arith.angle_at_nir(F.lit(0.0), F.lit(0.0), F.lit(0.0))) - 1) < 1e-7
    assert one(spark, arith.head_or(F.array().cast("array<double>"), 0.0)) == 0
    assert one(spark, arith.map_or(F.create_map(F.lit("40.0"), F.lit(3)), "30.0")) == 0
    assert one(spark, geo.snap(F.lit(-1.0))) == -5 and one(spark, geo.snap(F.lit(19.9))) == 15
    made = arith.radar_features(F.lit(0.1), F.lit(0.01))
    assert [round(one(spark, made[b]), 6) for b in ("ratio", "VH", "VV")] == [3, 10, 20]


def test_texts(spark):
    parts = one(spark, text.sample_path_parts(F.lit("/d/sampleable_polygons_year2019_zone31_id8100_p12.json")))
    assert tuple(parts) == (2019, 31, 8100, 12) and one(spark, text.trailing_number(F.lit("x_123.nc"), "nc")) == 123
    assert one(spark, text.sample_path(F.lit(2019), F.lit(31), F.lit(8100), F.lit(0))) == "sampleable_polygons_year2019_zone31_id8100_p0.json"
    assert one(spark, text.with_unit(F.lit(12), F.lit("cpu-seconds"))) == "12 cpu-seconds" and one(spark, text.with_unit(F.lit(None), F.lit("x"))) == "x"
    assert one(spark, text.is_country(F.lit("2018_BE_LPIS_POLY_110"), "BE")) and one(spark, text.country_of(F.lit("2018_FR_x"))) == "FR"
    assert one(spark, text.title(F.lit("cropland"), F.lit(12.345))) == "cropland 12.3"
    assert one(spark, text.title(F.lit(None).cast("string"), F.lit(1.0))) is None and one(spark, text.title(F.lit("x"), F.lit(None).cast("double"))) is None


def test_titles_of_small_negative_values(spark):
    """Values that are rounded up to zero keep their sign, as in SQL."""
    shown = lambda v: one(spark, text.title(F.lit("x"), arith.rounded_to_show(F.lit(v), 1)))
    assert [shown(v) for v in (-0.05, -0.04, -0.01, -0.06, 0.0, -1e-9, 0.04, -123.45)] == ["x -0.0", "x -0.0", "x -0.0", "x -0.1", "x 0.0", "x 0.0", "x 0.0", "x -123.4"]


def test_legends(spark):
    assert len(legends.CROPS) == 173 and len(legends.LAND_COVER) == 37
    assert legends.crop_codes(["Winter rye", "Spring wheat", "Maize"]) == [1120, 1200, 1610]
    with pytest.raises(ValueError, match="Winter ryeSpring wheat"):
        legends.crop_codes(["Winter ryeSpring wheat"])
    with pytest.raises(ValueError, match="more than one"):
        legends.class_numbers({"a": ["A00"], "b": ["A00 Artificial land"]})
    with pytest.raises(ValueError, match="in no class"):
        legends.class_numbers({"a": ["A00"]})
    assert one(spark, legends.training_class(F.lit(1110))) == "Winter wheat" and one(spark, legends.training_class(F.lit(1110), joint_cereals=True)) == "Winter cereals"
    assert one(spark, legends.training_class(F.lit(9110))) == "Other" and one(spark, legends.training_class(F.lit(9110), grass=True)) == "Temporary grass crops"
    with pytest.raises(Exception, match="not in the legend"):
        one(spark, legends.lookup_or_fail(F.lit(5), legends.CROPS))
    assert math.isclose(one(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0))), math.pi * geo.EARTH_KM)
