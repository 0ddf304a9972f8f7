"""Ranks over ranges of sorted rows."""

import numpy as np
from pyspark.sql import functions as F

from loamframe.operators import ranking, sampling, sequences


def test_numbers_of_a_hot_value(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 100).alias("v")).repartition(6)
    rows = ranking.numbered(df, [F.col("v"), F.col("id").desc()]).collect()
    wanted = sorted(((r.v, -r.id) for r in rows))
    assert [wanted[r._rank] for r in rows] == [(r.v, -r.id) for r in rows] and {r._rank for r in rows} == set(range(5000))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = ranking.in_order(df, [F.col("v"), F.col("id")]).groupBy("_part").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and max(r["count"] for r in parts) < 2500


def test_numbers_in_groups_with_nulls(spark):
    df = spark.createDataFrame([(g, i, "x") for i, g in enumerate(["a", None, "b", "a", None, "a"])], "g string, id int, _n string").withColumnRenamed("_n", "note")
    got = {(r.g, r.id): (r._rank, r._n) for r in ranking.numbered_in_groups(df, ["g"], [F.col("id").desc()]).collect()}
    assert got == {("a", 5): (0, 3), ("a", 3): (1, 3), ("a", 0): (2, 3), (None, 4): (0, 2), (None, 1): (1, 2), ("b", 2): (0, 1)}
    assert ranking.numbered(df.limit(0), [F.col("id")]).count() == 0
    assert [tuple(r)[1:] for r in sequences.ranked(df.where("g = 'a'"), "id", ["g"]).orderBy("rank").select("g", "id", "rank").collect()] == [(5, 1), (3, 2), (0, 3)]


def test_deciles_against_numpy(spark):
    values = np.random.default_rng(8).normal(size=997).round(2)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)] + [(2000, None)], "id int, v double").repartition(4)
    edges = np.quantile(values, np.arange(1, 10) / 10)
    bins = (edges < values[:, None]).sum(axis=1)
    wanted = {}
    for b in range(10):
        own = [(abs(v - np.median(values[bins == b])), i) for i, v in enumerate(values) if bins[i] == b]
        wanted[b] = min((round(d, 9), i) for d, i in own)[1]
    got = {r.bin: r.id for r in sampling.decile_medians(df, "v", "id").collect()}
    assert {b: values[i] for b, i in got.items()} == {b: values[i] for b, i in wanted.items()}
    assert sampling.decile_medians(df.where("v IS NULL"), "v", "id").count() == 0
    assert [(r.id, r.v) for r in sampling.decile_medians(df.where("id = 3"), "v", "id").collect()] == [(3, values[3])]
