"""Ranks over whole tables and large groups, without a task that sees all of one.

Rows are sorted in ranges that Spark cuts by a sample, so a hot value of the first columns is cut by the next ones.
A row's number is its place in its range and what the ranges before it hold; only the ranges' sizes, one
number for each, are summed in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamframe.storage import written

#: Bits of a row's place in its range, in the numbers that Spark gives.
_PLACE_BITS = 33


def in_order(df: DataFrame, order: Sequence[Column], name: str = "ordered") -> DataFrame:
    """df as a table in the shared folder, with _part and _at: the range of each row and its place there, from 0.

    The job runs when this is called.  Rows that tie in all of order come in any order.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    rows = rows.withColumn("_part", F.shiftright("_m", _PLACE_BITS)).withColumn("_at", F.col("_m").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)))
    return written(rows.drop("_m"), name)


def before_parts(counted: DataFrame, count: str = "_n", name: str = "_before") -> DataFrame:
    """_part and the sum of `count` over the ranges before it; one row per range in all."""
    order = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select("_part", F.coalesce(F.sum(count).over(order), F.lit(0)).alias(name))


def numbered(df: DataFrame, order: Sequence[Column], name: str = "_rank") -> DataFrame:
    """df with the number of each row, from 0, in the given order."""
    rows = in_order(df, order)
    starts = before_parts(rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")))
    return rows.join(starts, "_part").withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).select(*df.columns, name)


def numbered_in_groups(df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str = "_rank", count: str = "_n") -> DataFrame:
    """df with the number of each row in its group, from 0, and the group's number of rows; null groups are groups."""
    rows = numbered(df, [*[F.col(g) for g in groups], *order], "_all")
    firsts = rows.groupBy(*groups).agg(F.min("_all").alias("_first"), F.count(F.lit(1)).alias(count))
    firsts = firsts.withColumnsRenamed({g: f"_g_{g}" for g in groups})
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups]
    return rows.join(firsts, same).withColumn(name, F.col("_all") - F.col("_first")).select(*df.columns, name, count)


def at_ranks(numbered_rows: DataFrame, value: str, ranks: Sequence[int], rank: str = "_rank") -> dict[int, float]:
    """The values at so many ranks."""
    return {r[rank]: r[value] for r in numbered_rows.where(F.col(rank).isin(list(ranks))).select(rank, value).collect()}
