"""Time series of pixels: overlapping windows, gap interpolation and season statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamframe.plans.specs import PICKS, Intervals


def reducer(name: str, v: Column) -> Column:
    known = {"median": F.median, "mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count, "first": F.first}
    return known[name](v)


def assign_intervals(cube: DataFrame, start: str, spec: Intervals, t_col: str = "t") -> DataFrame:
    """cube with k, one row for each window that holds the row's day.

    The windows of a day are an arithmetic range, so no range join is planned.
    """
    d = F.datediff(F.col(t_col).cast("date"), F.lit(start).cast("date"))
    low = F.greatest(F.lit(0), F.floor((d - spec.width) / spec.step) + 1).cast("int")
    high = F.least(F.lit(spec.count - 1), F.floor(d / spec.step)).cast("int")
    rows = cube.withColumn("_low", low).withColumn("_high", high).where("_low <= _high")
    return rows.withColumn("k", F.explode(F.sequence("_low", "_high"))).drop("_low", "_high")


def aggregate_temporal(cube: DataFrame, start: str, spec: Intervals, keys: Sequence[str], bands: Sequence[str], t_col: str = "t") -> DataFrame:
    """keys, k and the bands reduced over each window."""
    assigned = assign_intervals(cube, start, spec, t_col)
    return assigned.groupBy(*keys, "k").agg(*[reducer(spec.reducer, F.col(b)).alias(b) for b in bands])


def dekad(t: Column) -> Column:
    """First day of the calendar dekad: the 1st, 11th or 21st."""
    part = F.least(F.floor((F.dayofmonth(t) - 1) / 10), F.lit(2)).cast("int")
    return F.date_add(F.trunc(t, "month"), part * 10)


def aggregate_dekads(cube: DataFrame, keys: Sequence[str], bands: Sequence[str], how: str = "median", t_col: str = "t") -> DataFrame:
    return cube.groupBy(*keys, dekad(F.col(t_col).cast("date")).alias("dekad")).agg(*[reducer(how, F.col(b)).alias(b) for b in bands])


def densify(cells: DataFrame, keys: Sequence[str], count: int, bands: Sequence[str]) -> DataFrame:
    """All windows 0..count-1 of every key; windows without data have null bands.

    One aggregation instead of a join: each key's cells become a map by k, from which every k is read.
    """
    value = F.struct(*bands)
    packed = cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", value.alias("v")))).alias("_m"))
    every = packed.select(*keys, "_m", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("k"))
    return every.select(*keys, "k", *[F.try_element_at("_m", F.col("k")).getField(b).alias(b) for b in bands])


def interpolate_linear(dense: DataFrame, keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """Inner gaps along k filled linearly; gaps at the edges stay null.  The input has every k."""
    order = Window.partitionBy(*keys).orderBy("k")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    out = dense
    for b in bands:
        at = F.struct(F.col("k").alias("k"), F.col(b).alias("v"))
        out = out.withColumn(f"_p_{b}", F.last(F.when(F.col(b).isNotNull(), at), ignorenulls=True).over(back))
        out = out.withColumn(f"_n_{b}", F.first(F.when(F.col(b).isNotNull(), at), ignorenulls=True).over(ahead))
    filled = {}
    for b in bands:
        p, n = F.col(f"_p_{b}"), F.col(f"_n_{b}")
        between = p.v + (n.v - p.v) * (F.col("k") - p.k) / F.nullif(n.k - p.k, F.lit(0))
        filled[b] = F.coalesce(F.col(b), between)
    return out.withColumns(filled).drop(*[f"_{x}_{b}" for b in bands for x in "pn"])


def edge_filled(picks: Sequence[Column]) -> list[Column]:
    """Six picks with empty ones filled from the neighbour towards the middle; the outer ones see filled neighbours."""
    t0, t1, t2, t3, t4, t5 = picks
    t1, t4 = F.coalesce(t1, t2), F.coalesce(t4, t3)
    return [F.coalesce(t0, t1), t1, t2, t3, t4, F.coalesce(t5, t4)]


def statistics(series: DataFrame, keys: Sequence[str], bands: Sequence[str], spec: Intervals) -> DataFrame:
    """Quartiles, sample deviation and six picks of every band, in one aggregation: {band}_{statistic}."""
    aggs = []
    for b in bands:
        aggs.append(F.percentile(b, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(f"_q_{b}"))
        aggs.append(F.stddev_samp(b).alias(f"{b}_sd"))
        aggs += [F.max(F.when(F.col("k") == k, F.col(b))).alias(f"_t{i}_{b}") for i, k in enumerate(spec.picks)]
    sums = series.groupBy(*keys).agg(*aggs)
    columns = [F.col(k) for k in keys]
    for b in bands:
        columns += [F.get(f"_q_{b}", F.lit(i)).alias(f"{b}_{name}") for i, name in enumerate(("p25", "p50", "p75"))]
        columns.append(F.col(f"{b}_sd"))
        columns += [c.alias(f"{b}_t{i}") for i, c in enumerate(edge_filled([F.col(f"_t{i}_{b}") for i in range(PICKS)]))]
    return sums.select(*columns)


def season_statistics(cube: DataFrame, start: str, spec: Intervals, keys: Sequence[str], bands: Sequence[str], t_col: str = "t") -> DataFrame:
    """Windows, interpolation and statistics.  All shuffles are by the keys."""
    cells = aggregate_temporal(cube, start, spec, keys, bands, t_col)
    return statistics(interpolate_linear(densify(cells, keys, spec.count, bands), keys, bands), keys, bands, spec)


def reduce_time(cube: DataFrame, keys: Sequence[str], bands: Sequence[str], how: str) -> DataFrame:
    return cube.groupBy(*keys).agg(*[reducer(how, F.col(b)).alias(b) for b in bands])
