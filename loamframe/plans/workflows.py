"""Composites of the sampling, training, validation and map workflows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamframe.functions import arith, geo, legends, text
from loamframe.operators import cube as C
from loamframe.operators import metrics, overlay, sampling, sequences, spatial, tables
from loamframe.sources import sinks
from loamframe.storage import written


@dataclass(frozen=True)
class SampleBudget:
    """Most samples of a class, by source and by whether the class is of interest."""

    parcels: int = 3000
    parcels_other: int = 1500
    points: int = 2000
    points_other: int = 1000
    repeat_parcels: int = 3


def reference_set(parcels: DataFrame, points: DataFrame, remap: Mapping[int, int] | None = None, without: Iterable[int] = ()) -> DataFrame:
    """Both sources with zone number and letter from their centroid; codes remapped and some left out.

    parcels and points have CT, ring, year and ref_id.
    """
    both = tables.union_all([parcels.withColumn("source", F.lit("parcel")), points.withColumn("source", F.lit("point"))])
    if remap:
        both = both.withColumn("CT", legends.remap("CT", remap))
    without = list(without)
    if without:
        both = both.where(~F.col("CT").isin(without))
    first = F.get("ring", F.lit(0))
    at = both.withColumn("_c", geo.centroid("ring")).withColumn("lon", F.coalesce("_c.x", first.x)).withColumn("lat", F.coalesce("_c.y", first.y)).drop("_c")
    return at.withColumn("zonenumber", geo.utm_zone("lon", "lat")).withColumn("zoneletter", geo.utm_letter("lat"))


def sample_polygons(parcels: DataFrame, points: DataFrame, strata: DataFrame, relevant: Sequence[int], budget: SampleBudget, ids: Sequence[str], years: Sequence[int], zones: Sequence[int], per_file: int = 150, cell: float = 1.0, seed: str = "", first_stratum: bool = False) -> DataFrame:
    """Sampled features with stratum, zone, crop, year and chunk, ready for `sinks.feature_collections`.

    A class's budget depends on whether it is among the relevant codes.  Strata
    are joined by the features' centroid.
    """

    def drawn(df: DataFrame, n: int, n_other: int, repeat: int) -> DataFrame:
        own = df.where(F.col("year").isin(list(years)) & F.col("zonenumber").isin(list(zones)))
        chosen, other = own.where(F.col("CT").isin(list(relevant))), own.where(~F.col("CT").isin(list(relevant)))
        return tables.union_all([sampling.sample_replicated(chosen, ["CT"], ids, n, repeat, seed), sampling.sample_replicated(other, ["CT"], ids, n_other, repeat, seed)])

    both = tables.union_all([drawn(parcels, budget.parcels, budget.parcels_other, budget.repeat_parcels), drawn(points, budget.points, budget.points_other, 1)])
    both = both.withColumn("sample_id", F.concat_ws("_", *ids, "replica"))
    placed = spatial.spatial_join(both.drop("ring"), strata.select("ring", "groupID", "zoneID"), "sample_id", "lon", "lat", size=cell, keep="zoneID" if first_stratum else None)
    placed = placed.join(both.select("sample_id", "ring"), "sample_id")
    named = placed.withColumnsRenamed({"CT": "crop", "zonenumber": "zone"})
    return sampling.chunked(named, ["year", "zone", "crop"], ["sample_id", "zoneID"], per_file)


def by_country(samples: DataFrame, country: str) -> tuple[DataFrame, DataFrame]:
    """Samples of a country and the others, by their reference id."""
    own = text.is_country("ref_id", country)
    return samples.where(own), samples.where(~F.coalesce(own, F.lit(False)))


def split_points(points: DataFrame, id_col: str, classes: Sequence[str], class_col: str = "LC", break_km: float = 200.0) -> tuple[DataFrame, DataFrame]:
    """Points of the classes with their gap group, and per group its number of points and hull."""
    grouped = sequences.gap_groups(points.where(F.col(class_col).isin(list(classes))), id_col, break_km=break_km)
    inside = grouped.where("inside")
    hulls = spatial.convex_hulls(inside, "group", "lon", "lat")
    return inside, inside.groupBy("group").agg(F.count(F.lit(1)).alias("n")).join(hulls, "group")


def extraction_plan(files: DataFrame, done: DataFrame, years: DataFrame, providers: DataFrame, zones: DataFrame) -> DataFrame:
    """Year, provider, zone and file of every extraction that is not done; files has path."""
    parts = files.withColumn("p", text.sample_path_parts("path")).select("path", "p.year", "p.zone")
    grid = tables.cross_grid(years, providers, zones)
    return tables.not_done(grid.join(parts, ["year", "zone"]), done, ["path", "provider"])


def training_rows(values: DataFrame, features: Sequence[str], collections: DataFrame) -> DataFrame:
    """Rows of features with strata and crop.

    values: (path, band, stat, value), the path naming year, zone, crop, part and,
    at its end, the feature's index; collections: (year, zone, crop, part,
    position, groupID, zoneID).
    """
    # names are taken apart once per file, after its values are summed up
    value = arith.sentinel_to_null("value", 65535).cast("double")
    files = values.groupBy("path", "band", "stat").agg(F.sum(value).alias("total"), F.count(value).alias("n"))
    # written, as the join's test for nulls in the names would go below the sums
    files = written(files, "files")
    files = files.withColumn("p", text.sample_path_parts("path")).withColumn("position", text.trailing_number("path", "nc"))
    files = files.select("p.*", "position", F.concat_ws("_", "band", "stat").alias("feature"), "total", "n")
    of = lambda f, c: F.sum(F.when(F.col("feature") == f, F.col(c)))
    rows = files.groupBy("year", "zone", "crop", "part", "position").agg(*[(of(f, "total") / F.nullif(of(f, "n"), F.lit(0))).alias(f) for f in features])
    return rows.join(collections, ["year", "zone", "crop", "part", "position"])


def land_use_reference(points: DataFrame, area: DataFrame | None, per_polygon: int, classes: Mapping[str, Iterable[str]], id_col: str, code_col: str = "LC1", seed: str = "") -> DataFrame:
    """target, px and py of `per_polygon` points in each polygon of an area; no area or no polygon in it raises."""
    if area is None:
        raise ValueError("an area of interest is needed")
    numbers = legends.class_numbers(classes)
    middle = geo.centroid("ring")
    at = points.withColumn("_x", middle.x).withColumn("_y", middle.y)
    inside = spatial.spatial_join(at, area.select("ring").withColumnRenamed("ring", "area"), id_col, "_x", "_y", "area", how="left_semi").drop("_x", "_y")
    if inside.isEmpty():
        raise ValueError("no reference polygons in the area")
    many = sampling.replicated(inside, per_polygon).withColumn("_sample", F.concat_ws("_", F.col(id_col).cast("string"), "replica"))
    found = sampling.points_in_polygons(many, "_sample", seed=seed)
    return found.select(id_col, "replica", legends.lookup_or_fail(legends.roll_up(code_col), numbers).alias("target"), "px", "py")


def checked_strata(sampled: DataFrame, inferred: DataFrame, label: str = "stratum") -> tuple[DataFrame, DataFrame]:
    """Both strata tables, labelled; raises where they do not fit each other."""
    n, m = sampled.count(), inferred.count()
    if n == 1 and m == 1:
        return sampled.withColumn(label, F.lit("stratum0")), inferred.withColumn(label, F.lit("stratum0"))
    if n < m:
        raise ValueError("more strata to infer than sampled")
    for name, df in (("sampled", sampled), ("inferred", inferred)):
        if label not in df.columns:
            raise ValueError(f"{name} strata lack the column {label}")
    if not tables.difference(sampled, inferred, [label]).isEmpty():
        raise ValueError("sampled strata that are not inferred")
    return sampled, inferred


def map_validation(points: DataFrame, raster: DataFrame, target_col: str = "target", class_col: str = "predicted", size: int = 10, nodata: int = 100) -> dict[str, DataFrame]:
    """Accuracy, scores and confusion of a class raster at test points; classes of at least nodata count as none."""
    pairs = C.nearest_pixel(points, raster, size).select(F.col(target_col).alias("target"), arith.sentinel_to_null(F.col(class_col), nodata, at_least=True).alias("predicted"))
    missing = pairs.agg(F.count_if(F.col("predicted").isNull()).alias("missing"), F.count(F.lit(1)).alias("n"))
    full = pairs.na.drop()
    return {"missing": missing, "accuracy": metrics.accuracy(full), "scores": metrics.precision_recall(full), "confusion": metrics.confusion(full)}


def grid_means(grid: DataFrame, zone_values: DataFrame, name: str = "cropland_perc") -> DataFrame:
    """grid (position, ...) with 100 times its zonal mean; zones without values have 0."""
    out = grid.join(zone_values, "position", "left")
    return out.withColumn(name, 100.0 * F.coalesce("value", F.lit(0.0))).drop("value")


def grid_histograms(grid: DataFrame, histograms: DataFrame, total_pixels: int, classes: Mapping[str, int], zone_col: str = "zone") -> DataFrame:
    """grid with pixel counts and percentages of named classes from histogram maps; a missing class has 0."""
    out = grid.join(histograms, zone_col, "left")
    counts = {n: arith.map_or("histogram", f"{float(k)}") for n, k in classes.items()}
    return out.withColumns(counts).withColumns({f"{n}_perc": 100.0 * F.col(n) / total_pixels for n in classes}).drop("histogram")


def tile_providers(tiles: DataFrame, optical_least: int = 100, radar_least: int = 80, first: str = "local", other: str = "cloud") -> DataFrame:
    """tiles (sentinel2count, sentinel1count) with the provider that has enough products; nulls count as too few."""
    enough = (F.col("sentinel2count") > optical_least) & (F.col("sentinel1count") > radar_least)
    return tables.with_defaults(tiles, {"cropland_perc": F.lit(0.0)}).withColumn("provider", F.when(F.coalesce(enough, F.lit(False)), first).otherwise(other))


def missing_products(messages: DataFrame, tiles: DataFrame, done: DataFrame) -> DataFrame:
    """Per tile that is not done, the distinct products that its messages name, and their number."""
    todo = tables.not_done(tiles, done, ["tile"])
    named = todo.join(messages, "tile").where(F.contains("message", F.col("tile"))).select("tile", text.product_of_message("message").alias("product"))
    return named.groupBy("tile").agg(F.array_sort(F.collect_set("product")).alias("products")).withColumn("n", F.size("products"))


def expected_gaps(tiles: DataFrame, first: str, last: str, catalogue: DataFrame, step_days: int = 1) -> DataFrame:
    """Dry run of a load: tiles with the dates from first to last, every step_days, that the catalogue lacks."""
    dates = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.make_dt_interval(F.lit(step_days)))
    return tables.difference(tiles.select("tile", F.explode(dates).alias("date")), catalogue, ["tile", "date"])


def production_tiles(tiles: DataFrame, results: DataFrame, least_cropland: float = 0.0) -> DataFrame:
    """Tiles of a map still to produce, those with the most cropland first."""
    return tables.not_done(tiles.where(F.col("cropland_perc") > least_cropland), results, ["tile"]).orderBy(F.col("cropland_perc").desc(), "tile")


def produce_map(features: DataFrame, predict: Callable[[DataFrame], DataFrame], box: tuple[float, float, float, float], path: str, strata: Mapping[str, float] | None = None, tile_size: int = 2000, levels: int = 0) -> None:
    """Predicted classes (column `predicted`) of a feature cube inside a box, written by tile."""
    cube = C.array_modify(features, **strata) if strata else features
    inside = C.filter_bbox(cube, *box)
    tile = F.concat_ws("_", F.floor(F.col("x") / tile_size).cast("string"), F.floor(F.col("y") / tile_size).cast("string"))
    sinks.write_raster(predict(inside).select("x", "y", F.col("predicted").cast("int").alias("predicted"), tile.alias("tile")), path, "predicted", levels=levels)


def parcel_counts(parcels: DataFrame, raster: DataFrame, classes: Sequence[int], id_col: str = "feature_index", least_area: float = 1e-7, without: Sequence[int] = ()) -> DataFrame:
    """Parcels large enough and of other classes than those left out, with their pixels' counts of each class.

    parcels: id, crop_type, area; raster: id and class of every pixel in a parcel.
    Parcels in which no named class was found are left out.
    """
    big = parcels.where(F.col("area") > least_area)
    if without:
        big = big.where(~F.col("crop_type").isin(list(without)))
    counts = spatial.one_hot_counts(raster, [id_col], "class", classes)
    return metrics.anything_detected(big.join(counts, id_col, "left"), [f"c{k}" for k in classes])


def dissolved_parcels(parcels: DataFrame, id_col: str, size: float, ring_col: str = "ring", precision: float = 1e-6) -> DataFrame:
    """The parts of the union of all parcels (ring, holes, area), each with the attributes of its parcel of smallest id."""
    parts = overlay.dissolved(parcels, size, ring_col=ring_col, precision=precision).withColumnsRenamed({"ring": "_ring", "area": "_area"})
    inner = geo.inner_point(ring_col)
    attributes = [c for c in parcels.columns if c != ring_col]
    # of equal rings the one of smallest id is enough; rows are dealt out, as a small table would be the work of one task
    tasks = 2 * parcels.sparkSession.sparkContext.defaultParallelism
    firsts = parcels.repartition(tasks).groupBy(ring_col).agg(F.min(F.struct(id_col, *[c for c in attributes if c != id_col])).alias("_f")).repartition(tasks)
    points = firsts.select(*[F.col(f"_f.{c}").alias(c) for c in attributes], inner.alias("_p")).select("*", F.col("_p.x").alias("_x"), F.col("_p.y").alias("_y")).drop("_p")
    points = written(points, "parcel_points")
    # a parcel in a hole of another part lies inside that part's ring too: the smallest ring around it is its own part's
    found = spatial.spatial_join(points, parts.select("_ring", F.struct("_area", "ring_id").alias("_part")), id_col, "_x", "_y", "_ring", size, "inner", keep="_part")
    first = found.groupBy(F.col("_part.ring_id").alias("ring_id")).agg(F.min(F.struct(id_col, *[c for c in attributes if c != id_col])).alias("_first"))
    return first.join(parts, "ring_id").select(*[F.col(f"_first.{c}").alias(c) for c in attributes], F.col("_ring").alias("ring"), "holes", F.col("_area").alias("area"))


def without_overlaps(parcels: DataFrame, id_col: str, size: float) -> DataFrame:
    """One parcel, that of the smallest id, of each group of overlapping boxes."""
    return parcels.join(spatial.overlapping_groups(parcels, id_col, size), id_col).where(F.col(id_col) == F.col("group")).drop("group")


def season_of(t: Column, start_month: int = 3) -> Column:
    """Agricultural year of a date: it begins in start_month."""
    return F.year(t) - F.when(F.month(t) < start_month, 1).otherwise(0)
