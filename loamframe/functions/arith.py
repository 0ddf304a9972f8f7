"""Column arithmetic on pixel values.  Null stays null everywhere."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bands of the normalised differences (first - second) / (first + second); our pinned definitions.
NORMALIZED_DIFFERENCES: Mapping[str, tuple[str, str]] = {
    "NDVI": ("B08", "B04"),
    "NDMI": ("B08", "B11"),
    "NDGI": ("B03", "B04"),
    "NDRE1": ("B08", "B05"),
    "NDRE2": ("B08", "B06"),
    "NDRE5": ("B07", "B05"),
}
#: Input ranges that are scaled to 0..30000.
RANGES: Mapping[str, tuple[float, float]] = {"band": (0.0, 8000.0), "index": (-1.0, 1.0), "angle": (0.0, 1.0), "decibel": (0.0, 30.0)}
OUT_RANGE = (0.0, 30000.0)


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: Column | str, digits: int = 4) -> Column:
    """Rounded after a nudge of 1e-9, so that ties fall alike in different engines."""
    return F.round(as_col(c) + F.lit(1e-9), digits)


def rounded_to_show(c: Column | str, digits: int = 4) -> Column:
    """As rounded, but what is rounded up to zero stays -0.0, as it is printed in C; Spark's rounding drops the sign."""
    nudged = as_col(c) + F.lit(1e-9)
    return F.when((nudged < 0) & (rounded(c, digits) == 0), F.lit(-0.0)).otherwise(rounded(c, digits))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    return as_col(a) / F.nullif(as_col(b), F.lit(0.0))


def normalized_difference(a: Column | str, b: Column | str) -> Column:
    a, b = as_col(a), as_col(b)
    return ratio(a - b, a + b)


def angle_at_nir(red: Column | str, nir: Column | str, swir: Column | str, wavelengths: tuple[float, float, float] = (0.665, 0.842, 1.61)) -> Column:
    """Angle at the near-infrared vertex of the spectrum's polygon over pi, in 0..1.

    The sides join (wavelength in micrometres, reflectance) of red, nir and swir.
    """
    red, nir, swir = as_col(red), as_col(nir), as_col(swir)
    w_red, w_nir, w_swir = wavelengths
    a = F.sqrt((nir - red) * (nir - red) + F.lit((w_nir - w_red) ** 2))
    b = F.sqrt((swir - nir) * (swir - nir) + F.lit((w_swir - w_nir) ** 2))
    c = F.sqrt((swir - red) * (swir - red) + F.lit((w_swir - w_red) ** 2))
    cosine = ratio(a * a + b * b - c * c, 2 * a * b)
    return F.when(cosine.isNotNull(), F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))) / F.lit(3.141592653589793))


def decibel(v: Column | str) -> Column:
    """10 * log10(v), null for v <= 0."""
    v = as_col(v)
    return F.when(v > 0, 10 * F.log10(v))


def linear_scale(v: Column | str, in_min: float, in_max: float, out_min: float, out_max: float) -> Column:
    """v clipped to [in_min, in_max] and mapped to [out_min, out_max]."""
    v = as_col(v)
    clipped = F.least(F.greatest(v, F.lit(float(in_min))), F.lit(float(in_max)))
    return F.when(v.isNotNull(), (clipped - in_min) / (in_max - in_min) * (out_max - out_min) + out_min)


def scale_to_int16(v: Column | str, kind: str) -> Column:
    return linear_scale(v, *RANGES[kind], *OUT_RANGE)


def radar_features(vv: Column | str, vh: Column | str) -> dict[str, Column]:
    """ratio, VH and VV of calibrated backscatter, each in 0..30 before scaling."""
    return {"ratio": 30 * ratio(vh, vv), "VH": 30 + decibel(vh), "VV": 30 + decibel(vv)}


def sentinel_to_null(v: Column | str, sentinel: float, at_least: bool = False) -> Column:
    """v, null where it equals the sentinel, or where it is at least the sentinel."""
    v = as_col(v)
    return F.when(v < sentinel, v) if at_least else F.when(v != sentinel, v)


def first_present(*cols: Column | str) -> Column:
    """The first value that is not null."""
    return F.coalesce(*map(as_col, cols))


def head_or(values: Column | str, default: float) -> Column:
    """First element of an array, or the default if there is none."""
    return F.coalesce(F.get(as_col(values), F.lit(0)), F.lit(default))


def map_or(values: Column | str, key: str, default: int = 0) -> Column:
    """A map's value, or the default if the key is missing."""
    return F.coalesce(F.try_element_at(as_col(values), F.lit(key)), F.lit(default))


def bucketize(v: Column | str, edges: list[float]) -> Column:
    """Number of the range [edges[i], edges[i + 1]) that holds v; null outside; the last range is closed."""
    v, edges = as_col(v), sorted(edges)
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        upper = v <= edges[i + 1] if i == len(edges) - 2 else v < edges[i + 1]
        out = F.when((v >= edges[i]) & upper, F.lit(i)).otherwise(out)
    return out
