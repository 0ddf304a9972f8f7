"""Sinks: rasters, tables, feature collections and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamframe.functions import geo

from loamframe.functions.text import sample_path
from loamframe.operators.cube import narrow_class, overview


def write_raster(raster: DataFrame, path: str, value_col: str, tile_col: str = "tile", levels: int = 0) -> None:
    """Classes as bytes in a folder per tile, with overviews of the most frequent class."""
    raster.withColumn(value_col, narrow_class(F.col(value_col))).write.mode("overwrite").partitionBy(tile_col).parquet(f"{path}/level=0")
    for level in range(1, levels + 1):
        overview(raster, value_col, level).withColumn(value_col, narrow_class(F.col(value_col))).write.mode("overwrite").parquet(f"{path}/level={level}")


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_samples(df: DataFrame, path: str, by: str = "feature_index") -> None:
    """A folder of Parquet files per feature, for time series at samples."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def feature(properties: list[str], ring_col: str = "ring", id_col: str = "feature_id") -> Column:
    """A GeoJSON feature as a struct; the ring is closed."""
    ring = F.col(ring_col)
    closed = F.when(F.get(ring, F.lit(0)) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    coordinates = F.array(F.transform(closed, lambda p: F.array(p.x, p.y)))
    return F.struct(
        F.col(id_col).cast("string").alias("id"),
        F.lit("Feature").alias("type"),
        F.struct(*properties).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"),
    )


def feature_collections(df: DataFrame, properties: list[str], ring_col: str = "ring", id_col: str = "feature_id") -> DataFrame:
    """name and json of one collection per (year, zone, crop, chunk); chunks bound a collection's size."""
    rows = df.withColumn("_f", F.struct(F.col(id_col).alias("k"), feature(properties, ring_col, id_col).alias("f")))
    packed = rows.groupBy("year", "zone", "crop", "chunk").agg(F.array_sort(F.collect_list("_f"), lambda a, b: F.when(a.k < b.k, -1).when(a.k > b.k, 1).otherwise(0)).alias("_fs"))
    whole = F.struct(
        F.lit("FeatureCollection").alias("type"),
        F.col("crop").cast("string").alias("ids"),
        F.col("year").cast("string").alias("year"),
        F.col("crop").cast("string").alias("title"),
        F.col("crop").cast("string").alias("name"),
        F.transform("_fs", lambda x: x.f).alias("features"),
    )
    return packed.select("year", "zone", "crop", "chunk", sample_path("year", "zone", "crop", "chunk").alias("name"), F.to_json(whole).alias("json"))


def write_feature_collections(df: DataFrame, path: str, properties: list[str], **columns: str) -> None:
    """Collections as text, in folders by year, zone, crop and chunk."""
    found = feature_collections(df, properties, **columns)
    found.select(F.col("json").alias("value"), "year", "zone", "crop", "chunk").write.mode("overwrite").partitionBy("year", "zone", "crop", "chunk").text(path)


def write_indexed(df: DataFrame, path: str, size: float, ring_col: str = "ring", files: int | None = None) -> None:
    """Features in files along a Z-order curve of their boxes' middles, with a table of the files' boxes beside them.

    size is the side of a cell of the curve.  `readers.read_indexed` opens only the files whose box a mask meets.
    """
    box = geo.ring_box(ring_col)
    cell = lambda low, high: F.least(F.greatest(F.floor((low + high) / 2 / size) + (1 << 29), F.lit(0)), F.lit((1 << 30) - 1))
    key = geo.interleave(cell(box.minx, box.maxx), cell(box.miny, box.maxy), 30)
    order = [F.lit(1)] if files == 1 else [key, F.xxhash64(ring_col)]
    spread = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    spread.write.mode("overwrite").parquet(f"{path}/features")
    written = df.sparkSession.read.schema(df.schema).parquet(f"{path}/features").withColumn("_box", box)
    sides = [F.min("_box.minx").alias("minx"), F.min("_box.miny").alias("miny"), F.max("_box.maxx").alias("maxx"), F.max("_box.maxy").alias("maxy")]
    boxes = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(*sides)
    boxes.coalesce(1).write.mode("overwrite").parquet(f"{path}/boxes")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
