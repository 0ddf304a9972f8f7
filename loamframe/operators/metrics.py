"""Accuracy metrics as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(df: DataFrame, y: str = "target", p: str = "predicted") -> DataFrame:
    """n and the share of equal pairs; rows with a null are left out."""
    full = df.na.drop(subset=[y, p])
    return full.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, y: str = "target", p: str = "predicted") -> DataFrame:
    """Counts of all pairs that occur."""
    return df.na.drop(subset=[y, p]).groupBy(y, p).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, labels: Sequence, y: str = "target", p: str = "predicted") -> DataFrame:
    """One row per true label, a column p{label} per predicted one."""
    return confusion(df, y, p).groupBy(y).agg(*[F.coalesce(F.sum(F.when(F.col(p) == k, F.col("n"))), F.lit(0)).alias(f"p{k}") for k in labels])


def precision_recall(df: DataFrame, y: str = "target", p: str = "predicted") -> DataFrame:
    """label, precision, recall, fscore and support over the labels of both columns; divisions by zero give 0.

    Each pair counts once as a true and once as a predicted label, so that one aggregation does.
    """
    pairs = confusion(df, y, p)
    sides = F.explode(F.array(F.struct(F.col(y).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("q")), F.struct(F.col(p).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("q"))))
    rows = pairs.select("n", (F.col(y) == F.col(p)).alias("hit"), sides.alias("s")).select("n", "hit", "s.*")
    sums = rows.groupBy("label").agg(
        F.sum(F.col("n") * F.col("t")).alias("support"),
        F.sum(F.col("n") * F.col("q")).alias("_predicted"),
        F.sum(F.when(F.col("hit"), F.col("n") * F.col("t")).otherwise(0)).alias("_hits"),
    )
    zero = F.lit(0.0)
    out = sums.withColumn("precision", F.coalesce(F.try_divide("_hits", "_predicted"), zero)).withColumn("recall", F.coalesce(F.try_divide("_hits", "support"), zero))
    f = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), zero), zero)
    return out.withColumn("fscore", f).select("label", "precision", "recall", "fscore", "support")


def detections(df: DataFrame, class_col: str, count_cols: dict[int, str]) -> DataFrame:
    """Per class: parcels of it, those where it is not detected, and others where it is."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("class"), F.col(c).alias("found")) for k, c in count_cols.items()]))
    rows = df.select(F.col(class_col).alias("own"), each.alias("e")).select("own", "e.*")
    mine = F.col("own") == F.col("class")
    return rows.groupBy("class").agg(
        F.count_if(mine).alias("n"), F.count_if(mine & (F.col("found") == 0)).alias("missed"), F.count_if(~mine & (F.col("found") > 0)).alias("falsely_found")
    )


def anything_detected(df: DataFrame, count_cols: Sequence[str]) -> DataFrame:
    """Rows with a positive count in any of the columns."""
    return df.where(F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in count_cols], F.lit(0)) > 0)


def missing_counts(df: DataFrame) -> DataFrame:
    """Number of nulls of every column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
