"""Sources: collections, vector files, tables and catalogues."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamframe.functions import geo

#: GeoJSON sample collections; coordinates as longitude, latitude.
FEATURE_SCHEMA = (
    "type string, ids string, year string, title string, name string, features array<struct<id:string, type:string, "
    "properties:struct<groupID:double, zoneID:double, ref_id:string, zone_num:string>, "
    "geometry:struct<type:string, coordinates:array<array<array<double>>>>>>"
)


def load_collection(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, bands: Sequence[str] | None = None, keys: Sequence[str] = ("x", "y", "t"), t_col: str = "t", cloud_cover: float | None = None, equal: Mapping[str, str] | None = None) -> DataFrame:
    """A raster collection in Parquet; time range, bands and metadata predicates reach the files."""
    cube = spark.read.parquet(path)
    if start is not None:
        cube = cube.where(F.col(t_col) >= F.lit(start).cast("timestamp"))
    if end is not None:
        cube = cube.where(F.col(t_col) < F.lit(end).cast("timestamp"))
    if cloud_cover is not None:
        cube = cube.where(F.col("cloud_cover") <= cloud_cover)
    for name, value in (equal or {}).items():
        cube = cube.where(F.col(name) == value)
    return cube if bands is None else cube.select(*keys, *bands)


def read_features(spark: SparkSession, path: str, schema: str = FEATURE_SCHEMA) -> DataFrame:
    """One row per feature of GeoJSON collections: properties, ring, position in the file and the file's path."""
    files = spark.read.schema(schema).option("multiLine", True).json(path)
    each = files.select("*", F.col("_metadata.file_path").alias("path")).select("path", F.posexplode("features").alias("position", "f"))
    points = F.transform(F.get(F.col("f.geometry.coordinates"), F.lit(0)), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    out = each.select("path", "position", F.col("f.id").alias("feature_id"), "f.properties.*", points.alias("ring"))
    return out.withColumn("zone_num", F.col("zone_num").cast("int")) if "zone_num" in out.columns else out


def features_from_dict(spark: SparkSession, collection: Mapping) -> DataFrame:
    """Rows of an in-memory FeatureCollection: properties as a map, outer ring."""
    rows = []
    for k, f in enumerate(collection["features"]):
        ring = f["geometry"]["coordinates"][0] if f["geometry"]["type"] == "Polygon" else [f["geometry"]["coordinates"]]
        rows.append((k, {str(a): None if b is None else str(b) for a, b in (f.get("properties") or {}).items()}, [(float(x), float(y)) for x, y, *_ in ring]))
    return spark.createDataFrame(rows, "position int, properties map<string,string>, ring array<struct<x:double,y:double>>")


def masked(features: DataFrame, polygons: DataFrame, id_col: str, size: float = 1.0, by: str = "intersection") -> DataFrame:
    """Features that share a point with one of the polygons (column ring) or, by `centroid`, whose centroid lies in one."""
    from loamframe.operators.spatial import meeting, spatial_join

    if by == "intersection":
        return meeting(features, polygons, id_col, size=size)
    middle, first = geo.centroid("ring"), F.get("ring", F.lit(0))
    at = features.select(id_col, F.coalesce(middle.x, first.x).alias("x"), F.coalesce(middle.y, first.y).alias("y"))
    inside = spatial_join(at, polygons.select("ring"), id_col, size=size, how="left_semi").select(id_col)
    return features.join(inside, id_col, "left_semi")


def read_indexed(spark: SparkSession, path: str, polygons: DataFrame, id_col: str, size: float, exact: bool = True) -> DataFrame:
    """Features that `sinks.write_indexed` wrote and that meet one of the polygons (column ring); other files are not opened.

    The names of the files to open, as many as a listing of the folder has, pass through the driver.  With exact False, all
    features of these files are returned.
    """
    from loamframe.operators.spatial import covering_cells

    boxes, box = spark.read.parquet(f"{path}/boxes"), geo.ring_box("ring")
    around = boxes.where("minx IS NOT NULL").withColumn("_file_ring", geo.box_ring("minx", "miny", "maxx", "maxy"))
    masks = covering_cells(polygons.select("ring"), "ring", size).select("_cx", "_cy", box.alias("_m"))
    meets = (F.col("minx") <= F.col("_m.maxx")) & (F.col("maxx") >= F.col("_m.minx")) & (F.col("miny") <= F.col("_m.maxy")) & (F.col("maxy") >= F.col("_m.miny"))
    files = [r.file for r in covering_cells(around, "_file_ring", size).join(masks, ["_cx", "_cy"]).where(meets).select("file").distinct().collect()]
    whole = spark.read.parquet(f"{path}/features")
    found = spark.read.schema(whole.schema).parquet(*[f"{path}/features/{f}" for f in sorted(files)]) if files else whole.limit(0)
    return masked(found, polygons, id_col, size=size) if exact else found


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header and a declared schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_resource(package: str, name: str) -> object:
    """A JSON file of a package, on the driver."""
    return json.loads(resources.files(package).joinpath(name).read_text(encoding="utf-8"))


def zonal_lists(spark: SparkSession, text: DataFrame, key: str, json_col: str = "value") -> DataFrame:
    """position and value (or the default 0.0) of the per-zone band lists at a JSON object's key."""
    parsed = text.select(F.try_element_at(F.from_json(json_col, "map<string, array<array<double>>>"), F.lit(key)).alias("zones"))
    each = parsed.select(F.posexplode("zones").alias("position", "bands"))
    return each.select("position", F.coalesce(F.get("bands", F.lit(0)), F.lit(0.0)).alias("value"))


def product_count(catalogue: DataFrame, start: str, end: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """Number of products whose footprint meets the box in [start, end)."""
    inside = (F.col("t") >= F.lit(start).cast("timestamp")) & (F.col("t") < F.lit(end).cast("timestamp"))
    meets = geo.boxes_overlap(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), west, south, east, north)
    return catalogue.where(inside & meets).agg(F.count(F.lit(1)).alias("n"))


def query_catalogue(catalogue: DataFrame, start: str, end: str, tiles: Sequence[str], cloud_cover: float, **equal: object) -> DataFrame:
    """Products of the tiles in [start, end) with at most this cloud cover and the given values, as online=False."""
    found = catalogue.where(F.col("tile").isin(list(tiles)) & (F.col("t") >= F.lit(start).cast("timestamp")) & (F.col("t") < F.lit(end).cast("timestamp")) & (F.col("cloud_cover") <= cloud_cover))
    for name, value in equal.items():
        found = found.where(F.col(name) == F.lit(value))
    return found
