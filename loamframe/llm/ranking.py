"""Ranks and prefix sums over large groups without a task per group.

A group is cut into ordered buckets.  Bucket totals are summed first, a bounded
number of them per group; rows are then ranked inside their bucket and moved by
what lies before it.  No task sees more of a group than one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_bucket(*cols: Column | str, n: int) -> Column:
    """A bucket 0..n-1 from a hash of the columns."""
    return F.pmod(F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols]), F.lit(n)).cast("int")


def ranked(df: DataFrame, groups: Sequence[str], bucket: str, order: Sequence[Column]) -> DataFrame:
    """df with _rank, the 0-based rank of each row in its group by (bucket, order).

    bucket is a column of df with a bounded number of values per group.  Groups
    may be null; rows that tie in every column of order are ranked in any order.
    """
    keys = [*groups, bucket]
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    totals = totals.select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys]
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(totals, same)
        .withColumn("_rank", (F.col("_before") + F.col("_inside")).cast("long"))
        .drop("_inside", "_before", *[f"_t_{k}" for k in keys])
    )
