"""Spatial joins and zonal aggregates.

Polygons are covered by grid cells and points meet them in an equi-join on the
cell, so no nested loop is planned; ray casting then decides.  Cells that hold too much
are divided first, so that no task sees more of a crowded place than a small cell of it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamframe.functions import geo
from loamframe.operators.celltree import CELL, CellTree
from loamframe.operators.graph import components
from loamframe.storage import Scratch, written


def covering_cells(polygons: DataFrame, ring_col: str, size: float) -> DataFrame:
    """polygons with _cx and _cy, one row per grid cell that the polygon's box touches."""
    box = geo.ring_box(ring_col)
    lows = {"_x0": F.floor(box.minx / size), "_x1": F.floor(box.maxx / size), "_y0": F.floor(box.miny / size), "_y1": F.floor(box.maxy / size)}
    wide = polygons.withColumns(lows)
    return wide.withColumn("_cx", F.explode(F.sequence("_x0", "_x1"))).withColumn("_cy", F.explode(F.sequence("_y0", "_y1"))).drop(*lows)


def _pairs(points: DataFrame, polygons: DataFrame, x: str, y: str, ring_col: str, size: float, limit: int) -> DataFrame:
    box = geo.ring_box(ring_col)
    sides = ("_x0", "_y0", "_x1", "_y1")
    with Scratch(points.sparkSession) as scratch:
        at = points.select(*[F.col(c).cast("double").alias(s) for c, s in zip((x, y, x, y), sides)])
        around = polygons.select(*[b.cast("double").alias(s) for b, s in zip((box.minx, box.miny, box.maxx, box.maxy), sides)])
        tree = CellTree(scratch, size, limit=limit).grow(at, around)
    on = tree.place(points, F.col(x), F.col(y))
    cells = tree.place(polygons, box.minx, box.miny, box.maxx, box.maxy)
    return on.join(cells, list(CELL)).where(geo.contains(ring_col, x, y)).drop(*CELL)


def spatial_join(points: DataFrame, polygons: DataFrame, point_id: str, x: str = "x", y: str = "y", ring_col: str = "ring", size: float = 1.0, how: str = "left", keep: str | None = None, limit: int = 20_000) -> DataFrame:
    """Points with the attributes of the polygons they lie in.

    A point in several polygons is repeated, unless keep names a polygon column:
    then the polygon with its smallest value stays.  how: left, inner, left_semi
    or left_anti.  Cells with more than limit points and polygons are divided; they are
    counted when this is called.
    """
    found = _pairs(points, polygons, x, y, ring_col, size, limit)
    if how in ("left_semi", "left_anti"):
        return points.join(found.select(point_id).distinct(), point_id, how)
    attributes = [c for c in polygons.columns if c != ring_col]
    hits = found.select(point_id, *attributes)
    if keep is not None:
        others = [c for c in attributes if c != keep]
        best = hits.groupBy(point_id).agg(F.min(F.struct(keep, *others)).alias("_b"))
        hits = best.select(point_id, *[F.col(f"_b.{c}").alias(c) for c in attributes])
    return points.join(hits, point_id, how)


def meeting(features: DataFrame, polygons: DataFrame, id_col: str, ring_col: str = "ring", size: float = 1.0) -> DataFrame:
    """Features whose ring shares a point with one of the polygons; both meet in the grid cells that their boxes touch."""
    cells = covering_cells(polygons.select(F.col(ring_col).alias("_other")), "_other", size)
    near = covering_cells(features.select(id_col, ring_col), ring_col, size).join(cells, ["_cx", "_cy"])
    return features.join(near.where(geo.rings_meet(ring_col, "_other")).select(id_col).distinct(), id_col, "left_semi")


def zonal(cube: DataFrame, zones: DataFrame, keys: Sequence[str], zone_cols: Sequence[str], bands: Sequence[str], how: str = "avg", by: Sequence[str] = ()) -> DataFrame:
    """Bands reduced over each zone (and the columns `by`); zones gives the zone of every key."""
    return cube.join(zones, list(keys)).groupBy(*zone_cols, *by).agg(*[getattr(F, how)(b).alias(b) for b in bands])


def one_hot_counts(raster: DataFrame, zone_cols: Sequence[str], class_col: str, classes: Sequence[int]) -> DataFrame:
    """Per zone the number of pixels of each class, as columns c{class}."""
    return raster.groupBy(*zone_cols).agg(*[F.count_if(F.col(class_col) == k).alias(f"c{k}") for k in classes])


def histogram_map(raster: DataFrame, zone_cols: Sequence[str], class_col: str) -> DataFrame:
    """Per zone a map of class to number of pixels; keys are texts like `40.0`."""
    counts = raster.groupBy(*zone_cols, class_col).agg(F.count(F.lit(1)).alias("n")).where(F.col(class_col).isNotNull())
    entry = F.struct(F.col(class_col).cast("double").cast("string").alias("key"), F.col("n").alias("value"))
    return counts.groupBy(*zone_cols).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("histogram"))


def tile_counts(products: DataFrame, tiles: DataFrame, start: str, end: str, tile_col: str = "tile", t_col: str = "t") -> DataFrame:
    """Number of products per tile in [start, end); tiles without any have 0."""
    inside = products.where((F.col(t_col) >= F.lit(start).cast("timestamp")) & (F.col(t_col) < F.lit(end).cast("timestamp")))
    counts = inside.groupBy(tile_col).agg(F.count(F.lit(1)).alias("n"))
    return tiles.join(counts, tile_col, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def group_boxes(points: DataFrame, group_cols: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Per group the number of points and their bounding box."""
    return points.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("minx"), F.min(y).alias("miny"), F.max(x).alias("maxx"), F.max(y).alias("maxy"))


def convex_hulls(points: DataFrame, group_col: str, x: str = "x", y: str = "y", parts: int = 64) -> DataFrame:
    """Per group the ring of its convex hull, by monotone chains.

    Hulls of a group's parts are taken first; the hull of these is the group's,
    so that no task holds more of a group than one part and the parts' hulls.
    """

    def turn(o: tuple, a: tuple, b: tuple) -> float:
        return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def chain(points: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for p in points:
            while len(out) > 1 and turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out

    def hull(rows: pd.DataFrame) -> pd.DataFrame:
        xy = sorted(set(zip(rows["x"], rows["y"], strict=True)))
        ring = xy if len(xy) < 3 else chain(xy)[:-1] + chain(xy[::-1])[:-1]
        return pd.DataFrame({"g": rows["g"].iloc[0], "x": [p[0] for p in ring], "y": [p[1] for p in ring], "at": range(len(ring))})

    kind = points.schema[group_col].dataType.simpleString()
    rows = points.select(F.col(group_col).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop()
    schema = f"g {kind}, x double, y double, at int"
    parted = rows.withColumn("_part", F.pmod(F.xxhash64("x", "y"), F.lit(parts)))
    small = parted.groupBy("g", "_part").applyInPandas(hull, schema).drop("at")
    whole = small.groupBy("g").applyInPandas(hull, schema)
    ring = F.transform(F.array_sort(F.collect_list(F.struct("at", "x", "y"))), lambda p: F.struct(p.x.alias("x"), p.y.alias("y")))
    return whole.groupBy(F.col("g").alias(group_col)).agg(ring.alias("ring"))


def _meeting_groups(
    shapes: DataFrame, id_col: str, size: float, box: Sequence[Column], meets: Callable[[Column, Column], Column], touches: Callable[..., Column], covers: Callable[..., Column], limit: int, depth: int = 8
) -> DataFrame:
    """id and group (smallest id) of shapes (columns id and shape) that meet, directly or over others.

    The first of equal shapes stands for all.  In a cell that a shape covers, all others that touch
    the cell are linked with that shape; other cells with more than limit shapes are divided, and pairs are compared in
    those that are left.  touches and covers are of a shape and the four sides of a cell.
    """
    sides = ("_x0", "_y0", "_x1", "_y1")
    with Scratch(shapes.sparkSession) as scratch:
        rows = scratch.table(shapes.select(F.col(id_col).alias("id"), "shape").where("id IS NOT NULL"), "shapes")
        classes = scratch.table(rows.groupBy("shape").agg(F.min("id").alias("first")), "classes")
        # boxes without width do not even meet themselves
        classes = scratch.table(classes.withColumn("own", F.coalesce(meets(F.col("shape"), F.col("shape")), F.lit(False))), "classes")
        alike = rows.join(classes.where("NOT own").select("shape"), "shape").select("shape", "id")
        first = scratch.table(classes.where("own").select("shape", F.col("first").alias("id")).unionByName(alike), "first")
        member = rows.join(classes, "shape").select("id", F.when(F.col("own"), F.col("first")).otherwise(F.col("id")).alias("first"))
        member = scratch.table(member, "member")
        lowest = written(member.groupBy("id").agg(F.min("first").alias("first")), "lowest")
        # ids with several shapes link these
        links = [member.join(lowest.withColumnRenamed("first", "a"), "id").where("first <> a").select("a", F.col("first").alias("b"))]
        tree, alone = CellTree(scratch, size), []
        rows = tree.top(first.withColumns(dict(zip(sides, box, strict=True))))
        for level in range(depth + 1):
            # a little larger than the cell, so that rounding leaves no gap between cells
            side = size / 2**level
            cell = [(F.col(c) + k) * side + e for k, e in ((0, -1e-6 * side), (1, 1e-6 * side)) for c in ("_cx", "_cy")]
            rows = scratch.table(rows.where(touches(F.col("shape"), *cell)).withColumn("_over", covers(F.col("shape"), *cell)), "cells")
            counts = rows.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_n"), F.min(F.when(F.col("_over"), F.col("id"))).alias("_cover"))
            rows = rows.drop("_over").join(counts, list(CELL))
            links.append(scratch.table(rows.where("_cover <> id").select(F.col("_cover").alias("a"), F.col("id").alias("b")).distinct(), "links"))
            rows = rows.where("_cover IS NULL AND _n > 1")
            alone.append(rows.where(F.col("_n") <= limit) if level < depth else rows)
            rows = scratch.table(rows.where(F.col("_n") > limit).drop("_n", "_cover"), "crowded")
            if rows.isEmpty():
                break
            rows = tree.below(rows)
        near = scratch.table(reduce(DataFrame.unionByName, [r.select(*CELL, "id", "shape") for r in alone]), "alone")
        other = near.select(*CELL, F.col("id").alias("b"), F.col("shape").alias("other"))
        pairs = near.withColumnRenamed("id", "a").join(other, list(CELL)).where((F.col("a") < F.col("b")) & meets(F.col("shape"), F.col("other")))
        links.append(scratch.table(pairs.select("a", "b").distinct(), "links"))
        groups = components(reduce(DataFrame.unionByName, links)).select(F.col("id").alias("first"), F.col("component").alias("_group"))
    found = lowest.join(groups, "first", "left").select(F.col("id").alias(id_col), F.coalesce("_group", "first").alias("_group"))
    return shapes.select(id_col).join(found, id_col, "left").select(id_col, F.coalesce("_group", id_col).alias("group"))


def overlapping_rings(polygons: DataFrame, id_col: str, size: float, ring_col: str = "ring", limit: int = 64) -> DataFrame:
    """id and group (smallest id) of polygons that share a point, directly or over others; jobs run when this is called."""
    box = geo.ring_box("shape")
    touches = lambda ring, *cell: geo.rings_meet(ring, geo.box_ring(*cell))
    return _meeting_groups(polygons.select(id_col, F.col(ring_col).alias("shape")), id_col, size, (box.minx, box.miny, box.maxx, box.maxy), geo.rings_meet, touches, geo.clear_around, limit)


def overlapping_groups(boxes: DataFrame, id_col: str, size: float, limit: int = 64) -> DataFrame:
    """id and group (smallest id) of boxes (minx, miny, maxx, maxy) that overlap, directly or over others.

    Boxes meet in shared grid cells of the given size; what overlaps is then joined to
    components, by jobs that run when this is called.
    """

    def touches(box: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
        return (box.minx < maxx) & (minx < box.maxx) & (box.miny < maxy) & (miny < box.maxy)

    def covers(box: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
        return (box.minx <= minx) & (maxx <= box.maxx) & (box.miny <= miny) & (maxy <= box.maxy)

    sides = ("minx", "miny", "maxx", "maxy")
    shapes = boxes.select(id_col, F.struct(*[F.col(c).cast("double").alias(c) for c in sides]).alias("shape"))
    return _meeting_groups(shapes, id_col, size, [F.col("shape")[c] for c in sides], lambda a, b: touches(a, b.minx, b.miny, b.maxx, b.maxy), touches, covers, limit)
