"""Ordered rows: gap groups along a cell order, ranks and numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamframe.functions import geo
from loamframe.operators.ranking import in_order, numbered

def gap_groups(points: DataFrame, id_col: str, lon: str = "lon", lat: str = "lat", break_km: float = 200.0, cell_bits: int = 16) -> DataFrame:
    """points with cell, distance to the row before in cell order, group and inside.

    A row farther than break_km from the one before begins a group.  Rows before
    the first break and from the last one on have inside = false.

    Rows are sorted in ranges of about equal size, whatever their density; only the ranges' first
    and last rows and numbers of breaks are looked at across them, in one task.  The sort runs when this is called.
    """
    rows = in_order(points.withColumn("cell", geo.cell_index(lon, lat, cell_bits)), [F.col("cell"), F.col(id_col)], "cells").withColumnRenamed("_part", "_block")
    order = Window.partitionBy("_block").orderBy("_at")
    here = F.struct(F.col(lon).alias("lon"), F.col(lat).alias("lat"))
    rows = rows.withColumn("_before", F.lag(here).over(order))
    across = Window.orderBy("_block")
    blocks = rows.groupBy("_block").agg(F.max(F.struct(F.col("_at"), here.alias("p"))).alias("_last"))
    blocks = blocks.select(F.col("_block").alias("_b"), F.lag("_last.p").over(across).alias("_previous"))
    rows = rows.join(blocks, F.col("_block") == F.col("_b")).withColumn("_before", F.coalesce("_before", "_previous"))
    rows = rows.withColumn("distance_km", geo.haversine_km("_before.lon", "_before.lat", lon, lat))
    rows = rows.withColumn("_break", F.coalesce(F.col("distance_km") > break_km, F.lit(False)).cast("int"))
    sums = rows.groupBy("_block").agg(F.sum("_break").alias("_n"))
    sums = sums.select(
        F.col("_block").alias("_s"),
        F.coalesce(F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.sum("_n").over(Window.partitionBy()).alias("_all"),
    )
    running = F.sum("_break").over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("_run", running).join(sums, F.col("_block") == F.col("_s")).withColumn("group", (F.col("_base") + F.col("_run")).cast("long"))
    inside = (F.col("group") > 0) & (F.col("group") < F.col("_all"))
    return out.withColumn("inside", inside).select(*points.columns, "cell", "distance_km", "group", "inside")


def ranked(df: DataFrame, value_col: str, ties: Sequence[str], name: str = "rank") -> DataFrame:
    """df with its rank by falling value, from 1; the sort runs when this is called."""
    out = numbered(df, [F.col(value_col).desc(), *[F.col(c) for c in ties]], name)
    return out.withColumn(name, F.col(name) + 1)


def enumerated(df: DataFrame, list_col: str, name: str = "position") -> DataFrame:
    """One row per element of a list, with its position from 0."""
    rest = [c for c in df.columns if c != list_col]
    return df.select(*rest, F.posexplode(list_col).alias(name, list_col))
