"""Deterministic sampling: rows are ordered by the MD5 of a seed and their id."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamframe.functions import geo
from loamframe.operators.ranking import at_ranks, numbered, numbered_in_groups


def hash_order(*ids: Column | str, seed: str = "") -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in ids]).cast("binary"))


def hash_fraction(*ids: Column | str, seed: str = "") -> Column:
    """A uniform number in [0, 1) from the id."""
    return F.conv(F.substring(hash_order(*ids, seed=seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sample(df: DataFrame, n: int, ids: Sequence[str], seed: str = "") -> DataFrame:
    """n rows without replacement."""
    return df.orderBy(hash_order(*ids, seed=seed), *ids).limit(n)


def sample_per_class(df: DataFrame, class_cols: Sequence[str], ids: Sequence[str], n: int, seed: str = "") -> DataFrame:
    """At most n rows of each class.  The rank filter is applied before the shuffle too."""
    order = Window.partitionBy(*class_cols).orderBy(hash_order(*ids, seed=seed), *ids)
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def replicated(df: DataFrame, times: int) -> DataFrame:
    """Each row `times` times, with its replica number from 1."""
    return df.withColumn("replica", F.explode(F.sequence(F.lit(1), F.lit(times))))


def sample_replicated(df: DataFrame, class_cols: Sequence[str], ids: Sequence[str], n: int, times: int, seed: str = "") -> DataFrame:
    """At most n replicas of each class, out of `times` copies of each row."""
    return sample_per_class(replicated(df, times), class_cols, [*ids, "replica"], n, seed)


def two_sources(first: DataFrame, second: DataFrame, class_col: str, ids: Sequence[str], n_first: int, n_second: int, repeat_first: int = 1, required: Sequence | None = None, seed: str = "") -> DataFrame:
    """Budgeted sample of two sources, with `source` 1 or 2; a required class that neither has stops the job."""
    a = sample_replicated(first, [class_col], ids, n_first, repeat_first, seed).withColumn("source", F.lit(1))
    b = sample_per_class(second, [class_col], ids, n_second, seed).withColumn("replica", F.lit(1)).withColumn("source", F.lit(2))
    out = a.unionByName(b, allowMissingColumns=True)
    if required is not None:
        present = {r[0] for r in out.where(F.col(class_col).isin(list(required))).select(class_col).distinct().collect()}
        if missing := sorted(set(required) - present):
            raise ValueError(f"no samples for {missing}")
    return out


def train_part(ids: Sequence[str], share: float, seed: str = "") -> Column:
    """Whether a row is in the training part."""
    return hash_fraction(*ids, seed=seed) < share


def chunked(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], per_chunk: int = 150) -> DataFrame:
    """df with chunk: n rows of a group in n // per_chunk + 1 chunks, the first ones a row larger."""
    rows = numbered_in_groups(df, group_cols, [F.col(c) for c in order_cols], "_i").withColumn("_k", F.floor(F.col("_n") / per_chunk) + 1)
    q, r = F.floor(F.col("_n") / F.col("_k")), F.col("_n") % F.col("_k")
    big = r * (q + 1)
    chunk = F.when(F.col("_i") < big, F.floor(F.col("_i") / (q + 1))).otherwise(r + F.floor((F.col("_i") - big) / F.nullif(q, F.lit(0))))
    return rows.withColumn("chunk", chunk.cast("int")).drop("_n", "_i", "_k")


def points_in_polygons(polygons: DataFrame, id_col: str, ring_col: str = "ring", candidates: int = 32, margin: float = 0.0, centroid_share: float = 0.0, seed: str = "") -> DataFrame:
    """polygons with a point (px, py) inside, at least margin from every edge.

    Candidates are hashed into the bounding box and the first accepted one is
    taken.  Without one, a point is drawn inside on the lines at the candidates'
    heights; only if none of these keeps the margin either is the margin dropped.  For
    the given share of polygons it is the centroid, if that lies inside.
    """
    # tries are made one after another in the row itself, and those behind the first good one not at all
    draw = lambda k, axis: hash_fraction(id_col, k, seed=seed + axis)
    point = lambda k, x, y: F.struct(k.alias("_k"), x.alias("_x"), y.alias("_y"))
    named = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  # so that value is worked out once
    good = lambda p: geo.contains(ring_col, p["_x"], p["_y"]) & (geo.edge_distance(ring_col, p["_x"], p["_y"]) >= margin)
    box = F.col("_box")
    none = F.lit(None).cast("struct<_k:int,_x:double,_y:double>")

    def candidate(k: Column) -> Column:
        at = point(k, box["minx"] + draw(k, "x") * (box["maxx"] - box["minx"]), box["miny"] + draw(k, "y") * (box["maxy"] - box["miny"]))
        return named(at, lambda p: F.when(good(p), p))

    def on_line(k: Column) -> Column:
        """At a candidate's height, a point of the widest part inside."""
        y = box["miny"] + draw(k, "y") * (box["maxy"] - box["miny"])
        parts = lambda r: F.transform(F.sequence(F.lit(0), F.floor(F.size(r) / 2).cast("int") - 1), lambda i: F.struct((F.get(r, 2 * i + 1) - F.get(r, 2 * i)).alias("d"), F.get(r, 2 * i).alias("x")))
        across = lambda r: F.when(F.size(r) >= 2, F.array_max(parts(r)))
        widest = lambda y: named(F.array_sort(geo.crossings(ring_col, y)), across)
        at = named(y, lambda y: named(widest(y), lambda w: point(k, w["x"] + draw(k, "x") * w["d"], y)))
        return named(at, lambda p: F.when(geo.contains(ring_col, p["_x"], p["_y"]), p))

    numbers = F.sequence(F.lit(1), F.lit(candidates))
    first = F.aggregate(numbers, none, lambda found, k: F.when(found.isNull(), candidate(k)).otherwise(found))
    lines = F.filter(F.transform(numbers, on_line), lambda p: p.isNotNull())
    second = named(lines, lambda all_: F.coalesce(F.get(F.filter(all_, good), F.lit(0)), F.get(all_, F.lit(0))))
    out = polygons.withColumn("_box", geo.ring_box(ring_col)).withColumn("_p", F.coalesce(first, second)).drop("_box").withColumn("_c", geo.centroid(ring_col))
    central = hash_fraction(id_col, seed=seed + "c") < centroid_share
    middle = F.col("_p").isNull() | (central & geo.contains(ring_col, F.col("_c.x"), F.col("_c.y")))
    x = F.when(middle, F.col("_c.x")).otherwise(F.col("_p._x"))
    y = F.when(middle, F.col("_c.y")).otherwise(F.col("_p._y"))
    return out.withColumn("px", x).withColumn("py", y).drop("_p", "_c")


def decile_medians(df: DataFrame, value_col: str, id_col: str, bins: int = 10) -> DataFrame:
    """One row per equal-frequency bin of the values: the row nearest the bin's median, ties to the smallest id.

    Rows are numbered in the order of their values; quantiles and medians, between two values as the mean by distance, are
    those at the ranks that they fall on, so no task holds all values.  The sort runs when this is called.
    """
    rows = numbered(df.where(F.col(value_col).isNotNull()), [F.col(value_col), F.col(id_col)])
    n = rows.count()
    places = [k / bins * (n - 1) for k in range(1, bins)] if n else []
    values = at_ranks(rows, value_col, [f(p) for p in places for f in (math.floor, math.ceil)])
    edges = [values[math.floor(p)] + (p - math.floor(p)) * (values[math.ceil(p)] - values[math.floor(p)]) for p in places]
    # few edges, so literals; values equal to an edge are below it
    over = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col(value_col))) if edges else F.lit(0)
    binned = rows.withColumn("bin", over)
    spans = {r.bin: (r.low, r.n) for r in binned.groupBy("bin").agg(F.min("_rank").alias("low"), F.count(F.lit(1)).alias("n")).collect()}
    halves = {b: (low + (m - 1) // 2, low + m // 2) for b, (low, m) in spans.items()}
    values = at_ranks(rows, value_col, [r for pair in halves.values() for r in pair])
    middle = F.create_map(*[x for b, (i, j) in halves.items() for x in (F.lit(b), F.lit((values[i] + values[j]) / 2))])
    gap = F.abs(F.col(value_col) - middle[F.col("bin")]) if halves else F.lit(0.0)
    near = binned.groupBy("bin").agg(F.min(F.struct(gap.alias("d"), F.col(id_col).alias("id"), F.col(value_col).alias("v"))).alias("_b"))
    return near.select("bin", F.col("_b.id").alias(id_col), F.col("_b.v").alias(value_col))
