"""Raster cubes as DataFrames: one row per pixel and time, one column per band."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamframe.functions import geo

PIXEL = ("x", "y")


def select_bands(cube: DataFrame, bands: Sequence[str], keys: Sequence[str] = (*PIXEL, "t")) -> DataFrame:
    """The keys and the named bands; what is not named is not read from the files."""
    return cube.select(*[k for k in keys if k in cube.columns], *bands)


def rename_bands(cube: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return cube.withColumnsRenamed(dict(names))


def with_bands(cube: DataFrame, bands: Mapping[str, Column], keep: Sequence[str] | None = None) -> DataFrame:
    """cube with computed bands; with keep, only these columns stay."""
    out = cube.withColumns(dict(bands))
    return out if keep is None else out.select(*keep)


def array_modify(cube: DataFrame, **constants: float) -> DataFrame:
    """cube with constant bands, put in place of bands of the same name."""
    return cube.withColumns({k: F.lit(v) for k, v in constants.items()})


def reduce_bands(cube: DataFrame, bands: Sequence[str], how: str, name: str, keys: Sequence[str] = (*PIXEL, "t")) -> DataFrame:
    """One band: the mean, sum, min or max over the named bands of each row, without the null ones."""
    values = F.array_compact(F.array(*bands))
    total, n = F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values)
    made = {"sum": F.when(n > 0, total), "mean": total / F.nullif(n, F.lit(0)), "min": F.array_min(values), "max": F.array_max(values)}
    return cube.select(*[k for k in keys if k in cube.columns], made[how].alias(name))


def to_long(cube: DataFrame, bands: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """keys, band, value: one row per band."""
    return cube.unpivot(list(keys), list(bands), "band", "value")


def to_wide(cube: DataFrame, bands: Sequence[str], keys: Sequence[str], band_col: str = "band", value_col: str = "value", reduce: Callable = F.max) -> DataFrame:
    """One column per named band, by conditional aggregation in one shuffle."""
    cells = [reduce(F.when(F.col(band_col) == b, F.col(value_col))).alias(b) for b in bands]
    return cube.groupBy(*keys).agg(*cells)


def dims_to_bands(cube: DataFrame, keys: Sequence[str], index_col: str, indices: Sequence[int], bands: Sequence[str]) -> DataFrame:
    """Time steps as bands: column {band}_t{i} holds the band's value at the i-th named index."""
    cells = [F.max(F.when(F.col(index_col) == k, F.col(b))).alias(f"{b}_t{i}") for b in bands for i, k in enumerate(indices)]
    return cube.groupBy(*keys).agg(*cells)


def filter_temporal(cube: DataFrame, start: str, end: str, t_col: str = "t") -> DataFrame:
    """Times in [start, end)."""
    return cube.where((F.col(t_col) >= F.lit(start).cast("timestamp")) & (F.col(t_col) < F.lit(end).cast("timestamp")))


def filter_bbox(cube: DataFrame, west: float, south: float, east: float, north: float, x: str = "x", y: str = "y") -> DataFrame:
    return cube.where(F.col(x).between(west, east) & F.col(y).between(south, north))


def filter_metadata(cube: DataFrame, cloud_cover: float | None = None, **equal: str) -> DataFrame:
    """Scenes of at most this cloud cover and with the given values."""
    if cloud_cover is not None:
        cube = cube.where(F.col("cloud_cover") <= cloud_cover)
    for name, value in equal.items():
        cube = cube.where(F.col(name) == value)
    return cube


def mask(cube: DataFrame, flag: Column, bands: Sequence[str]) -> DataFrame:
    """Bands are null where the flag is true; rows stay."""
    return cube.withColumns({b: F.when(~F.coalesce(flag, F.lit(False)), F.col(b)) for b in bands})


def mask_by_layer(cube: DataFrame, layer: DataFrame, value_col: str, keep_classes: Sequence[int], bands: Sequence[str], keys: Sequence[str] = PIXEL) -> DataFrame:
    """Bands are null where a static layer has another class than those kept; pixels that the layer lacks are masked too."""
    kept = layer.where(F.col(value_col).isin(list(keep_classes))).select(*keys).distinct().withColumn("_kept", F.lit(True))
    out = cube.join(kept, list(keys), "left")
    return mask(out, F.col("_kept").isNull(), bands).drop("_kept")


def static_mask(layer: DataFrame, value_col: str, keep_classes: Sequence[int], keys: Sequence[str] = PIXEL) -> DataFrame:
    """Per pixel whether it is masked: its first class in time is none of those kept."""
    return layer.groupBy(*keys).agg((~F.min(value_col).isin(list(keep_classes))).alias("masked"))


def square_kernel(size: int) -> list[tuple[int, int]]:
    r = size // 2
    return [(dx, dy) for dx in range(-r, r + 1) for dy in range(-r, r + 1)]


def gaussian_kernel(size: int = 11, sigma: float = 1.6) -> list[tuple[int, int, float]]:
    """Offsets and weights that sum to 1."""
    import math

    r = size // 2
    raw = [(dx, dy, math.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma))) for dx in range(-r, r + 1) for dy in range(-r, r + 1)]
    total = sum(w for _, _, w in raw)
    return [(dx, dy, w / total) for dx, dy, w in raw]


def dilated(cube: DataFrame, flag: Column, kernel: Sequence[tuple[int, int]], keys: Sequence[str] = (*PIXEL, "t")) -> DataFrame:
    """Distinct keys of the pixels that lie in the kernel around a flagged pixel; flagged pixels alone are exploded."""
    x, y, *others = keys
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in kernel])
    spread = cube.where(flag).select(*keys, F.explode(offsets).alias("o"))
    return spread.select((F.col(x) + F.col("o.dx")).alias(x), (F.col(y) + F.col("o.dy")).alias(y), *others).distinct()


def mask_dilated(cube: DataFrame, flag: Column, kernel: Sequence[tuple[int, int]], bands: Sequence[str], keys: Sequence[str] = (*PIXEL, "t")) -> DataFrame:
    """Bands are null at and around flagged pixels."""
    hit = dilated(cube, flag, kernel, keys).withColumn("_hit", F.lit(True))
    return mask(cube.join(hit, list(keys), "left"), F.col("_hit").isNotNull(), bands).drop("_hit")


def mask_dilated_square(cube: DataFrame, flag: Column, size: int, bands: Sequence[str], keys: Sequence[str] = (*PIXEL, "t")) -> DataFrame:
    """Bands are null within a square of `size` pixels around flagged pixels of a full raster.

    A flag spreads along its row, then along the columns, by two range windows, so
    that no row is repeated however large the square is.  Pixels that the raster
    lacks do not carry a flag on; `mask_dilated` serves sparse cubes.
    """
    x, y, *others = keys
    r = size // 2
    along = Window.partitionBy(y, *others).orderBy(x).rangeBetween(-r, r)
    across = Window.partitionBy(x, *others).orderBy(y).rangeBetween(-r, r)
    spread = cube.withColumn("_flag", F.coalesce(flag, F.lit(False))).withColumn("_flag", F.max("_flag").over(along))
    return mask(spread.withColumn("_flag", F.max("_flag").over(across)), F.col("_flag"), bands).drop("_flag")


def mask_convolved(cube: DataFrame, flag: Column, kernel: Sequence[tuple[int, int, float]], threshold: float, bands: Sequence[str], keys: Sequence[str] = (*PIXEL, "t")) -> DataFrame:
    """Bands are null where the kernel-weighted share of flagged neighbours is above the threshold."""
    x, y, *others = keys
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(w).alias("w")) for dx, dy, w in kernel])
    spread = cube.where(flag).select(*keys, F.explode(offsets).alias("o"))
    sums = spread.groupBy((F.col(x) + F.col("o.dx")).alias(x), (F.col(y) + F.col("o.dy")).alias(y), *others).agg(F.sum("o.w").alias("_share"))
    return mask(cube.join(sums, list(keys), "left"), F.coalesce(F.col("_share"), F.lit(0.0)) > threshold, bands).drop("_share")


def merge(a: DataFrame, b: DataFrame, keys: Sequence[str], resolve: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Full outer union of two cubes; bands of both need a resolver of (a's value, b's value)."""
    both = [c for c in a.columns if c in b.columns and c not in keys]
    if both and resolve is None:
        raise ValueError(f"bands of both cubes need a resolver: {both}")
    named = b.withColumnsRenamed({c: f"_b_{c}" for c in both})
    out = a.join(named, list(keys), "full_outer")
    for c in both:
        out = out.withColumn(c, resolve(F.col(c), F.col(f"_b_{c}"))).drop(f"_b_{c}")
    return out


def resample(cube: DataFrame, factor: int, bands: Mapping[str, str], keys: Sequence[str] = PIXEL, others: Sequence[str] = ()) -> DataFrame:
    """Coarser grid: pixels of floor(x / factor), floor(y / factor), bands reduced by the named aggregate."""
    x, y = keys
    return cube.groupBy(F.floor(F.col(x) / factor).alias(x), F.floor(F.col(y) / factor).alias(y), *others).agg(*[getattr(F, how)(b).alias(b) for b, how in bands.items()])


def replicate(cube: DataFrame, factor: int, keys: Sequence[str] = PIXEL) -> DataFrame:
    """Finer grid: each pixel becomes factor * factor pixels with its values."""
    x, y = keys
    every = F.sequence(F.lit(0), F.lit(factor - 1))
    rest = [c for c in cube.columns if c not in keys]
    out = cube.select(*cube.columns, F.explode(every).alias("_i")).select("*", F.explode(every).alias("_j"))
    return out.select((F.col(x) * factor + F.col("_i")).alias(x), (F.col(y) * factor + F.col("_j")).alias(y), *rest)


def align(cube: DataFrame, targets: DataFrame, size: float, bands: Sequence[str], how: str = "bilinear", locate: Callable[[Column, Column], tuple[Column, Column]] | None = None, others: Sequence[str] = (), origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """The targets (columns x, y: centres of pixels of any grid) with bands of a cube whose pixels (x, y: centres) are size wide.

    Each target is taken back to the cube's coordinates by locate, where both have different ones (see `between_zones`).
    `nearest` takes the pixel that it falls in; `bilinear` weighs the four pixels around it and shares out the
    weights of pixels that are missing or null.  A corner of a pixel lies at origin.  others are columns of the cube, such as
    the time, that make images of their own: a target is then repeated for each image that has one of its pixels, and else has nulls once.
    """
    x, y = (F.col("x"), F.col("y")) if locate is None else locate(F.col("x"), F.col("y"))
    u, v = ((c.cast("double") - o) / size for c, o in zip((x, y), origin, strict=True))
    at = targets.withColumn("_id", F.struct(*targets.columns)).withColumn("_u", u).withColumn("_v", v)
    if how == "nearest":
        corners = [(F.floor("_u"), F.floor("_v"), F.lit(1.0))]
    elif how == "bilinear":
        i, j = F.floor(F.col("_u") - 0.5), F.floor(F.col("_v") - 0.5)
        p, q = F.col("_u") - 0.5 - i, F.col("_v") - 0.5 - j
        corners = [(i + a, j + b, (p if a else 1 - p) * (q if b else 1 - q)) for a in (0, 1) for b in (0, 1)]
    else:
        raise ValueError(f"unknown kernel: {how}")
    near = at.select("_id", F.explode(F.array(*[F.struct(a.alias("i"), b.alias("j"), w.alias("w")) for a, b, w in corners])).alias("_c")).where("_c.w > 0")
    near = near.select("_id", F.col("_c.i").alias("_i"), F.col("_c.j").alias("_j"), F.col("_c.w").alias("_w"))
    place = [F.floor((F.col(c).cast("double") - o) / size).alias(n) for c, o, n in zip(("x", "y"), origin, ("_i", "_j"), strict=True)]
    pixels = cube.select(*place, *[F.col(c).alias(f"_o_{c}") for c in others], *[F.col(b).cast("double").alias(f"_b_{b}") for b in bands])
    images = [f"_o_{c}" for c in others]
    weighed = [(F.sum(F.col("_w") * F.col(f"_b_{b}")) / F.nullif(F.sum(F.when(F.col(f"_b_{b}").isNotNull(), F.col("_w"))), F.lit(0.0))).alias(b) for b in bands]
    found = near.join(pixels, ["_i", "_j"]).groupBy("_id", *images).agg(*weighed)
    out = targets.withColumn("_id", F.struct(*targets.columns)).join(found, "_id", "left")
    return out.select(*[F.col(f"_id.{c}").alias(c) for c in targets.columns], *[F.col(i).alias(c) for i, c in zip(images, others, strict=True)], *bands)


def between_zones(target: int, source: int, south: bool = False) -> Callable[[Column, Column], tuple[Column, Column]]:
    """Coordinates of a target zone's points in the source's zone, for `align`."""

    def locate(x: Column, y: Column) -> tuple[Column, Column]:
        at = geo.utm_unproject(x, y, F.lit(target), south)
        there = geo.utm_project(at.lon, at.lat, F.lit(source))
        return there.x, there.y

    return locate


def overview(raster: DataFrame, value_col: str, level: int, keys: Sequence[str] = PIXEL) -> DataFrame:
    """Most frequent value per pixel of 2 ** level; ties go to the smallest value."""
    x, y = keys
    size = 1 << level
    counts = raster.where(F.col(value_col).isNotNull()).groupBy(F.floor(F.col(x) / size).alias(x), F.floor(F.col(y) / size).alias(y), value_col).agg(F.count(F.lit(1)).alias("_n"))
    best = F.max(F.struct("_n", -F.col(value_col)))
    return counts.groupBy(x, y).agg((-best.getField("col2")).alias(value_col))


def narrow_class(v: Column, most: int = 20) -> Column:
    """A class as a byte, clipped to 0..most."""
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(0)), F.lit(most))).cast("tinyint")


def nearest_pixel(points: DataFrame, raster: DataFrame, size: int = 10, x: str = "x", y: str = "y") -> DataFrame:
    """Points with the values of the pixel they fall in; raster x and y are pixel centres."""
    on = points.withColumn("_cx", F.floor(F.col(x) / size)).withColumn("_cy", F.floor(F.col(y) / size))
    cells = raster.withColumn("_cx", F.floor(F.col("x") / size)).withColumn("_cy", F.floor(F.col("y") / size)).drop("x", "y")
    return on.join(cells, ["_cx", "_cy"], "left").drop("_cx", "_cy")
