"""Radiometric calibration of radar counts to the backscatter coefficient on the ellipsoid.

A pixel's brightness is the square of its count over that of the scale in a look-up table, which is given at nodes and
interpolated between them.  Times the sine of the incidence angle it is sigma nought.  The angle lies between the ellipsoid's
normal at the pixel and the direction to the satellite, whose place at the pixel's time is interpolated between the orbit's state vectors.
Pixels meet nodes and vectors in equi-joins on the numbers of their intervals, so neither table needs to be small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamframe.functions.arith import as_col, decibel
from loamframe.operators import cube as C

#: WGS 84: semi-major axis and the square of the first eccentricity; fixed values.
AXIS, ECCENTRICITY2 = 6378137.0, 0.00669437999014
_AXES = ("x", "y", "z")


def earth_centred(lon: Column | str, lat: Column | str, height: Column | float = 0.0) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates of a point on or above the ellipsoid."""
    lon, lat = F.radians(as_col(lon)), F.radians(as_col(lat))
    height = F.lit(height) if isinstance(height, float) else height
    n = AXIS / F.sqrt(1 - ECCENTRICITY2 * F.pow(F.sin(lat), 2))
    return (n + height) * F.cos(lat) * F.cos(lon), (n + height) * F.cos(lat) * F.sin(lon), (n * (1 - ECCENTRICITY2) + height) * F.sin(lat)


def incidence(lon: Column | str, lat: Column | str, satellite: Sequence[Column]) -> Column:
    """Angle in radians between the ellipsoid's normal and the direction to the satellite."""
    ground = earth_centred(lon, lat)
    lam, phi = F.radians(as_col(lon)), F.radians(as_col(lat))
    normal = (F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi))
    look = [s - g for s, g in zip(satellite, ground, strict=True)]
    along = sum((n * v for n, v in zip(normal, look, strict=True)), F.lit(0.0))
    return F.acos(along / F.sqrt(sum((v * v for v in look), F.lit(0.0))))


def with_satellite(pixels: DataFrame, orbit: DataFrame, step: float, t_col: str = "t") -> DataFrame:
    """pixels with sx, sy and sz: the satellite's place at their time, by the cubic through two state vectors and their velocities.

    orbit: t (multiples of step, in seconds), x, y, z, vx, vy, vz.  Times outside the orbit give nulls.
    """
    number = F.round(F.col("t") / step).cast("long")
    names = [*_AXES, *(f"v{a}" for a in _AXES)]
    one = orbit.select(number.alias("_i"), *[F.col(c).cast("double").alias(f"_a{c}") for c in names])
    two = orbit.select((number - 1).alias("_i"), *[F.col(c).cast("double").alias(f"_b{c}") for c in names])
    timed = pixels.withColumn("_i", F.floor(F.col(t_col) / step).cast("long")).withColumn("_s", F.col(t_col) / step - F.col("_i"))
    met = timed.join(one.join(two, "_i"), "_i", "left")
    s = F.col("_s")
    from_one, from_two = 2 * s * s * s - 3 * s * s + 1, 3 * s * s - 2 * s * s * s
    speed_one, speed_two = s * s * s - 2 * s * s + s, s * s * s - s * s
    places = [from_one * F.col(f"_a{a}") + speed_one * step * F.col(f"_av{a}") + from_two * F.col(f"_b{a}") + speed_two * step * F.col(f"_bv{a}") for a in _AXES]
    return met.select(*pixels.columns, *[p.alias(f"s{a}") for p, a in zip(places, _AXES, strict=True)])


def calibrated(counts: DataFrame, scales: DataFrame, orbit: DataFrame, bands: Sequence[str], lines: float, pixels: float, orbit_step: float, in_decibel: bool = True) -> DataFrame:
    """counts (line, pixel, lon, lat, t and bands) with sigma nought instead of the bands' counts, and their incidence angle in degrees.

    scales: line and pixel of nodes, every `lines` and `pixels`, and the bands' scales of brightness there.  A pixel that no node or
    no state vector surrounds has null.
    """
    nodes = scales.select((F.col("pixel") / pixels).alias("x"), (F.col("line") / lines).alias("y"), *bands)
    rest = [c for c in counts.columns if c not in bands]
    targets = counts.select(*rest, *[F.col(b).alias(f"_dn_{b}") for b in bands], (F.col("pixel") / pixels).alias("x"), (F.col("line") / lines).alias("y"))
    scaled = with_satellite(C.align(targets=targets, cube=nodes, size=1.0, bands=bands, origin=(-0.5, -0.5)), orbit, orbit_step)
    angle = incidence("lon", "lat", [F.col(f"s{a}") for a in _AXES])
    out = scaled.withColumn("_angle", angle)
    sigma = [F.pow(F.col(f"_dn_{b}") / F.nullif(F.col(b), F.lit(0.0)), 2) * F.sin("_angle") for b in bands]
    return out.select(*rest, *[(decibel(s) if in_decibel else s).alias(b) for s, b in zip(sigma, bands, strict=True)], F.degrees("_angle").alias("incidence"))
