"""Plain table operations of the sampling and training workflow."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames, columns by name; a column that a frame lacks is null there."""
    if not frames:
        raise ValueError("nothing to unite")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a whose keys are not in b."""
    return a.join(b.select(*keys).distinct(), list(keys), "left_anti")


def append_row(df: DataFrame, **values) -> DataFrame:
    row = df.sparkSession.createDataFrame([tuple(values.get(c) for c in df.columns)], df.schema)
    return df.union(row)


def with_defaults(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """df with the columns that it lacks; columns that exist stay."""
    return df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})


def cross_grid(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All combinations of small dimension tables, as years, providers and zones."""
    return reduce(lambda a, b: a.crossJoin(b), others, first)


def exploded(df: DataFrame, list_col: str, name: str, drop_empty: bool = True) -> DataFrame:
    """One row per list element; rows with an empty list are dropped or keep a null."""
    rest = [c for c in df.columns if c != list_col]
    return df.select(*rest, (F.explode if drop_empty else F.explode_outer)(list_col).alias(name))


def not_done(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is to do and neither done nor known to fail."""
    return difference(todo, done, keys)


def positional_join(rows: DataFrame, position_col: str, values: DataFrame, list_col: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """rows with the element at their position of the list that has their keys; rows past its end have null.

    values holds one list for each combination of the keys, or one list in all.
    """
    items = values.select(*keys, F.posexplode(list_col).alias(position_col, name))
    return rows.join(items, [*keys, position_col], "left").select(*rows.columns, name)


def matching(df: DataFrame, predicate: str) -> DataFrame:
    """Rows for which a predicate, written as an SQL expression on the columns, is true."""
    return df.where(F.expr(predicate))


def group_sizes(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def non_null_counts(df: DataFrame, key: str) -> DataFrame:
    """Per key the number of non-null values of every other column."""
    return df.groupBy(key).agg(*[F.count(c).alias(c) for c in df.columns if c != key])


def count_matrix(df: DataFrame, row_col: str, column_col: str, columns: Sequence[str]) -> DataFrame:
    """Per row value the counts of each named column value, and their total over all values."""
    cells = [F.count_if(F.col(column_col) == c).alias(str(c)) for c in columns]
    return df.groupBy(row_col).agg(*cells, F.count(F.lit(1)).alias("TOTAL")).orderBy(F.col("TOTAL").desc(), row_col)


def features_to_rows(values: DataFrame, keys: Sequence[str], feature_col: str, value_col: str, features: Sequence[str], how: str = "avg") -> DataFrame:
    """Training rows: one column per feature, reduced over what a key has of it."""
    cells = [getattr(F, how)(F.when(F.col(feature_col) == f, F.col(value_col))).alias(f) for f in features]
    return values.groupBy(*keys).agg(*cells)
