"""Feature cubes from optical and radar time series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamframe.functions import arith
from loamframe.operators import cube as C
from loamframe.operators import temporal
from loamframe.plans.specs import FeatureOptions, Intervals, feature_names

#: Cube-to-cube steps by name; `register` adds one.
PROCESSES: dict[str, Callable[..., DataFrame]] = {
    "mask_dilated": C.mask_dilated,
    "mask_dilated_square": C.mask_dilated_square,
    "mask_convolved": C.mask_convolved,
    "mask_by_layer": C.mask_by_layer,
    "interpolate_linear": temporal.interpolate_linear,
    "aggregate_temporal": temporal.aggregate_temporal,
    "aggregate_dekads": temporal.aggregate_dekads,
    "resample": C.resample,
    "statistics": temporal.statistics,
}


def register(name: str, process: Callable[..., DataFrame]) -> None:
    PROCESSES[name] = process


def process(cube: DataFrame, name: str, *args, **options) -> DataFrame:
    """Apply a step by name."""
    return PROCESSES[name](cube, *args, **options)


def apply_bands(cube: DataFrame, make: Callable[[dict[str, Column]], dict[str, Column]], keys: Sequence[str]) -> DataFrame:
    """Replace all bands by those that make returns for the present ones."""
    bands = {c: F.col(c) for c in cube.columns if c not in keys}
    made = make(bands)
    return cube.select(*keys, *[c.alias(name) for name, c in made.items()])


def optical_bands(cube: DataFrame, options: FeatureOptions, landcover: DataFrame | None = None, class_col: str = "MAP", keys: Sequence[str] = ("x", "y", "t")) -> DataFrame:
    """Clear, cropland-masked optical features scaled to 0..30000.

    cube has reflectance bands, the scene classification and, if clouds are
    limited, cloud_cover.
    """
    if options.cloud_cover is not None and "cloud_cover" in cube.columns:
        cube = C.filter_metadata(cube, options.cloud_cover)
    bands = [c for c in cube.columns if c not in (*keys, options.scene_band, "cloud_cover")]
    if options.scene_band in cube.columns:
        clouded = ~F.col(options.scene_band).isin(list(options.clear_classes))
        if options.dilation:
            cube = C.mask_dilated_square(cube, clouded, options.dilation, bands, keys)
        else:
            cube = C.mask(cube, clouded, bands)
    if landcover is not None:
        cube = C.mask_by_layer(cube, landcover, class_col, options.cropland_classes, bands, keys[:2])
    made = {b: arith.scale_to_int16(b, "band") for b in options.optical_bands}
    made |= {i: arith.scale_to_int16(arith.normalized_difference(*arith.NORMALIZED_DIFFERENCES[i]), "index") for i in options.indices}
    if options.angle:
        made["ANIR"] = arith.scale_to_int16(arith.angle_at_nir("B04", "B08", "B11"), "angle")
    return cube.select(*keys, *[c.alias(name) for name, c in made.items()])


def radar_bands(cube: DataFrame, options: FeatureOptions, landcover: DataFrame | None = None, class_col: str = "MAP", keys: Sequence[str] = ("x", "y", "t")) -> DataFrame:
    """Radar features of calibrated VV and VH, scaled to 0..30000, named, never by position."""
    cube = C.filter_metadata(cube, None, **options.radar_predicates)
    if landcover is not None:
        cube = C.mask_by_layer(cube, landcover, class_col, options.cropland_classes, ["VV", "VH"], keys[:2])
    made = arith.radar_features("VV", "VH")
    return cube.select(*keys, *[arith.scale_to_int16(made[name], "decibel").alias(name) for name in options.radar_features])


def season_features(cube: DataFrame, options: FeatureOptions, spec: Intervals, bands: Sequence[str], keys: Sequence[str] = ("x", "y")) -> DataFrame:
    return temporal.season_statistics(cube, options.season.start.isoformat(), spec, keys, bands)


def load_features(optical: DataFrame | None, radar: DataFrame | None, options: FeatureOptions, landcover: DataFrame | None = None, radar_factor: int = 1) -> tuple[DataFrame, list[str]]:
    """Feature cube of one or both sensors and the names of its features.

    radar_factor brings a finer radar grid onto the optical one by averaging.
    """
    cubes, names = [], []
    if optical is not None:
        cubes.append(season_features(optical_bands(optical, options, landcover), options, options.season.optical(), options.optical_features))
        names += feature_names(options.optical_features)
    if radar is not None:
        if radar_factor > 1:
            radar = C.resample(radar, radar_factor, {"VV": "avg", "VH": "avg"}, others=["t", *options.radar_predicates])
        cubes.append(season_features(radar_bands(radar, options, landcover), options, options.season.radar(), options.radar_features))
        names += feature_names(options.radar_features)
    if not cubes:
        raise ValueError("no sensor given")
    merged = cubes[0] if len(cubes) == 1 else C.merge(cubes[0], cubes[1], ["x", "y"])
    return merged, names


def raw_series(optical: DataFrame, radar: DataFrame, start: str, end: str, samples: DataFrame | None = None) -> DataFrame:
    """Both sensors' raw bands on x, y and t, radar in decibels; at samples (x, y, sample) the mean of each date."""
    db = C.with_bands(radar, {b: arith.decibel(b) for b in ("VV", "VH")})
    merged = C.filter_temporal(C.merge(optical, db, ["x", "y", "t"]), start, end)
    if samples is None:
        return merged
    bands = [c for c in merged.columns if c not in ("x", "y", "t")]
    return merged.join(samples, ["x", "y"]).groupBy("sample", "t").agg(*[F.avg(b).alias(b) for b in bands])
