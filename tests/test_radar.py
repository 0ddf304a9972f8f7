"""Calibration of radar counts."""

import math

from loamframe.operators import radar

COUNTS = "line double, pixel double, lon double, lat double, t double, vv double"
ORBIT = "t double, x double, y double, z double, vx double, vy double, vz double"


def test_sigma_nought(spark):
    # a satellite 700 km above the equator at 0 degrees east that stands still
    high = radar.AXIS + 700_000
    orbit = spark.createDataFrame([(k * 10.0, high, 0.0, 0.0, 0.0, 0.0, 0.0) for k in range(3)], ORBIT)
    scales = spark.createDataFrame([(float(i * 10), float(j * 4), 100.0 + 10 * i + j) for i in range(3) for j in range(3)], "line double, pixel double, vv double")
    rows = [(5.0, 2.0, 3.0, 0.0, 4.0, 50.0), (0.0, 0.0, 0.0, 0.0, 10.0, 50.0), (5.0, 2.0, 3.0, 0.0, 99.0, 50.0), (500.0, 2.0, 3.0, 0.0, 4.0, 50.0)]
    got = {(r.line, r.t): (r.vv, r.incidence) for r in radar.calibrated(spark.createDataFrame(rows, COUNTS), scales, orbit, ["vv"], 10, 4, 10.0).collect()}
    # by the sine rule in the equator's plane
    lam = math.radians(3)
    away = math.sqrt(high**2 + radar.AXIS**2 - 2 * high * radar.AXIS * math.cos(lam))
    angle = math.asin(high * math.sin(lam) / away)
    value, degrees = got[5.0, 4.0]
    assert math.isclose(degrees, math.degrees(angle), rel_tol=1e-9) and math.isclose(value, 10 * math.log10((50 / 105.5) ** 2 * math.sin(angle)), rel_tol=1e-9)
    assert got[0.0, 10.0][1] < 1e-4 and got[5.0, 99.0] == (None, None) and got[500.0, 4.0][0] is None


def test_orbit_between_state_vectors(spark):
    def state(t):
        w = 0.001
        return (t, 7e6 * math.cos(w * t), 7e6 * math.sin(w * t), 5.0, -7e3 * math.sin(w * t), 7e3 * math.cos(w * t), 0.0)

    orbit = spark.createDataFrame([state(k * 10.0) for k in range(8)], ORBIT)
    pixels = spark.createDataFrame([(t,) for t in (0.0, 3.7, 25.5, 69.9)], "t double")
    for r in radar.with_satellite(pixels, orbit, 10.0).collect():
        assert math.dist((r.sx, r.sy, r.sz), state(r.t)[1:4]) < 0.5
