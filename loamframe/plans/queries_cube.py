"""Queries of the cube algebra: events are pixel time series (pixel = user, band = type of event)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamframe.functions import arith, geo
from loamframe.operators import cube as C
from loamframe.operators import temporal as T
from loamframe.plans.catalog import query, table
from loamframe.plans.specs import Intervals
from loamframe.streaming.runs import completed, table_stream
from loamframe.streaming.streams import interval_means

START = "2024-01-01"
MONTH = Intervals(days=30, step=1, overlap=1, reducer="median")
KEYS = ["pixel", "band"]
YEARS_START = "1995-01-01"
YEARS = Intervals(days=2500, step=120, overlap=60, reducer="mean")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("pixel"), F.col("event_type").alias("band"), F.col("ts").alias("t"), "value")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a raster 40 pixels wide."""
    return table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 40).alias("x"), F.floor(F.col("p_partkey") / 40).alias("y"), F.col("p_size").alias("scene"), "p_type", "p_retailprice", "p_partkey"
    )


R = "round({0} + 1e-9, 4)"
_CELLS = """cells AS (
  SELECT user_id AS pixel, event_type AS band, k::INT AS k, median(value) AS v
  FROM events JOIN range(28) r(k) ON date_diff('day', DATE '2024-01-01', ts::DATE) >= k AND date_diff('day', DATE '2024-01-01', ts::DATE) < k + 2
  GROUP BY ALL)"""
_DENSE = _CELLS + """, dense AS (
  SELECT p.pixel, p.band, r.k::INT AS k, c.v FROM (SELECT DISTINCT pixel, band FROM cells) p CROSS JOIN range(28) r(k)
  LEFT JOIN cells c ON c.pixel = p.pixel AND c.band = p.band AND c.k = r.k)"""
_FILLED = _DENSE + """, ends AS (
  SELECT *, last_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER b AS pk, last_value(v IGNORE NULLS) OVER b AS pv,
    first_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER a AS nk, first_value(v IGNORE NULLS) OVER a AS nv FROM dense
  WINDOW b AS (PARTITION BY pixel, band ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    a AS (PARTITION BY pixel, band ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT pixel, band, k, coalesce(v, pv + (nv - pv) * (k - pk) / nullif(nk - pk, 0)) AS v FROM ends)"""
_PICKS = ", ".join(f"max(CASE WHEN k = {k} THEN v END) AS t{i}" for i, k in enumerate(MONTH.picks))
_EDGES = ("coalesce(t0, t1, t2)", "coalesce(t1, t2)", "t2", "t3", "coalesce(t4, t3)", "coalesce(t5, t4, t3)")


@query(f"WITH {_CELLS} SELECT pixel, band, k, {R.format('v')} AS value FROM cells")
def cube_interval_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.aggregate_temporal(series(spark, sf_dir), START, MONTH, KEYS, ["value"])
    return out.withColumn("value", arith.rounded("value"))


@query(f"""SELECT l_suppkey AS pixel, k::INT AS k, {R.format('avg(l_quantity)')} AS value
FROM lineitem JOIN range(21) r(k) ON date_diff('day', DATE '1995-01-01', l_shipdate::DATE) >= k * 120 AND date_diff('day', DATE '1995-01-01', l_shipdate::DATE) < k * 120 + 180
WHERE k < ceil((2500 - 180) / 120.0) GROUP BY ALL""")
def cube_interval_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pixel"), F.col("l_shipdate").alias("t"), F.col("l_quantity").alias("value"))
    return T.aggregate_temporal(rows, YEARS_START, YEARS, ["pixel"], ["value"]).withColumn("value", arith.rounded("value"))


@query(f"WITH {_DENSE} SELECT pixel, band, k, {R.format('v')} AS value FROM dense")
def cube_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = T.aggregate_temporal(series(spark, sf_dir), START, MONTH, KEYS, ["value"])
    return T.densify(cells, KEYS, MONTH.count, ["value"]).withColumn("value", arith.rounded("value"))


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = T.aggregate_temporal(series(spark, sf_dir), START, MONTH, KEYS, ["value"])
    return T.interpolate_linear(T.densify(cells, KEYS, MONTH.count, ["value"]), KEYS, ["value"])


@query(f"WITH {_FILLED} SELECT pixel, band, k, {R.format('v')} AS value FROM filled")
def cube_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled(spark, sf_dir).withColumn("value", arith.rounded("value"))


@query(f"WITH {_FILLED}, p AS (SELECT pixel, band, {_PICKS} FROM filled GROUP BY ALL) SELECT pixel, band, " + ", ".join(f"{R.format(f't{i}')} AS value_t{i}" for i in range(6)) + " FROM p")
def cube_tstep_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.dims_to_bands(filled(spark, sf_dir), KEYS, "k", MONTH.picks, ["value"])
    return out.select(*KEYS, *[arith.rounded(f"value_t{i}").alias(f"value_t{i}") for i in range(6)])


@query(f"""WITH {_FILLED}, p AS (
  SELECT pixel, band, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, stddev_samp(v) AS sd, {_PICKS} FROM filled GROUP BY ALL)
SELECT pixel, band, """ + ", ".join(f"{R.format(c)} AS value_{c}" for c in ("p25", "p50", "p75", "sd")) + ", " + ", ".join(f"{R.format(e)} AS value_t{i}" for i, e in enumerate(_EDGES)) + " FROM p")
def cube_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: windows, medians, interpolation, quartiles, deviation and edge-filled picks."""
    out = T.season_statistics(series(spark, sf_dir), START, MONTH, KEYS, ["value"])
    return out.select(*KEYS, *[arith.rounded(c).alias(c) for c in out.columns if c not in KEYS])


@query("""WITH d AS (SELECT user_id AS pixel, event_type AS band, date_trunc('month', ts)::DATE + CAST(least((day(ts) - 1) // 10, 2) * 10 AS INT) AS dekad, value FROM events)
SELECT pixel, band, dekad::VARCHAR AS dekad, round(median(value) + 1e-9, 4) AS value FROM d GROUP BY ALL""")
def dekad_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.aggregate_dekads(series(spark, sf_dir), KEYS, ["value"]).withColumns({"value": arith.rounded("value"), "dekad": F.col("dekad").cast("string")})


@query("SELECT user_id AS pixel, event_type AS band, min(value) AS value FROM events GROUP BY ALL")
def reduce_time_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.reduce_time(series(spark, sf_dir), KEYS, ["value"], "min")


@query("SELECT user_id AS pixel, event_type AS band, max(value) AS value FROM events GROUP BY ALL")
def reduce_time_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.reduce_time(series(spark, sf_dir), KEYS, ["value"], "max")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as pixels with four bands."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 1000).alias("nir"), F.col("l_quantity").alias("red"), (F.col("l_discount") * 100).alias("swir"), (F.col("l_tax") * 100).alias("green"))


@query("""SELECT l_orderkey, l_linenumber, round((l_extendedprice / 1000 - l_quantity) / nullif(l_extendedprice / 1000 + l_quantity, 0) + 1e-9, 4) + 0.0 AS nd,
  round((l_discount * 100 - l_tax * 100) / nullif(l_discount * 100 + l_tax * 100, 0) + 1e-9, 4) + 0.0 AS nd2 FROM lineitem""")
def idx_normalized_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("l_orderkey", "l_linenumber", (arith.rounded(arith.normalized_difference("nir", "red")) + 0.0).alias("nd"), (arith.rounded(arith.normalized_difference("swir", "green")) + 0.0).alias("nd2"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity AS red, l_extendedprice / 1000 AS nir, l_discount * 100 AS swir FROM lineitem),
d AS (SELECT *, sqrt((nir - red) * (nir - red) + (0.842 - 0.665) ** 2) AS a, sqrt((swir - nir) * (swir - nir) + (1.61 - 0.842) ** 2) AS b, sqrt((swir - red) * (swir - red) + (1.61 - 0.665) ** 2) AS c FROM s)
SELECT l_orderkey, l_linenumber, round(acos(least(greatest((a * a + b * b - c * c) / nullif(2 * a * b, 0), -1), 1)) / pi() + 1e-9, 4) AS angle FROM d""")
def idx_anir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("l_orderkey", "l_linenumber", arith.rounded(arith.angle_at_nir("red", "nir", "swir")).alias("angle"))


@query("""SELECT l_orderkey, l_linenumber, round(30 * (l_discount * 100) / nullif(l_tax * 100, 0) + 1e-9, 4) AS ratio,
  round(30 + CASE WHEN l_discount > 0 THEN 10 * log10(l_discount * 100) END + 1e-9, 4) AS "VH", round(30 + CASE WHEN l_tax > 0 THEN 10 * log10(l_tax * 100) END + 1e-9, 4) AS "VV" FROM lineitem""")
def idx_ratio_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = arith.radar_features("green", "swir")
    return lines(spark, sf_dir).select("l_orderkey", "l_linenumber", *[arith.rounded(c).alias(n) for n, c in made.items()])


@query("SELECT p_partkey, round((least(greatest(p_retailprice, 900), 1500) - 900) / 600 * 30000 + 1e-9, 4) AS scaled FROM part")
def scale_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", arith.rounded(arith.linear_scale("p_retailprice", 900, 1500, 0, 30000)).alias("scaled"))


@query("SELECT p_partkey, CASE WHEN p_size <> 50 THEN p_size END AS equal_null, CASE WHEN p_size < 40 THEN p_size END AS least_null FROM part")
def sentinel_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", arith.sentinel_to_null("p_size", 50).alias("equal_null"), arith.sentinel_to_null("p_size", 40, at_least=True).alias("least_null"))


@query("SELECT p_partkey % 40 AS x, p_partkey // 40 AS y, CASE WHEN p_size IN (4, 5) THEN p_retailprice END AS p_retailprice FROM part")
def mask_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.mask(grid(spark, sf_dir), ~F.col("scene").isin(4, 5), ["p_retailprice"]).select("x", "y", "p_retailprice")


@query("""SELECT p_partkey % 40 AS x, p_partkey // 40 AS y, CASE WHEN c.k IS NOT NULL THEN p_retailprice END AS p_retailprice
FROM part LEFT JOIN (SELECT DISTINCT s_suppkey AS k FROM supplier WHERE s_nationkey < 15) c ON c.k = p_partkey""")
def mask_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 40).alias("x"), F.floor(F.col("s_suppkey") / 40).alias("y"), F.col("s_nationkey").alias("MAP"))
    return C.mask_by_layer(grid(spark, sf_dir), layer, "MAP", list(range(15)), ["p_retailprice"]).select("x", "y", "p_retailprice")


_NEAR = "SELECT DISTINCT p_partkey % 40 + dx.i AS x, p_partkey // 40 + dy.i AS y FROM part, range(-1, 2) dx(i), range(-1, 2) dy(i) WHERE p_size > 45"


_DILATED = f"WITH h AS ({_NEAR}) SELECT p_partkey % 40 AS x, p_partkey // 40 AS y, CASE WHEN h.x IS NULL THEN p_retailprice END AS p_retailprice FROM part LEFT JOIN h ON h.x = p_partkey % 40 AND h.y = p_partkey // 40"


@query(_DILATED)
def mask_dilation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.mask_dilated(grid(spark, sf_dir), F.col("scene") > 45, C.square_kernel(3), ["p_retailprice"], ["x", "y"]).select("x", "y", "p_retailprice")


@query(_DILATED)
def mask_dilation_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.mask_dilated_square(grid(spark, sf_dir), F.col("scene") > 45, 3, ["p_retailprice"], ["x", "y"]).select("x", "y", "p_retailprice")


@query("""WITH w AS (SELECT i, j, exp(-(i * i + j * j) / 2.0) AS w FROM range(-2, 3) a(i), range(-2, 3) b(j)),
s AS (SELECT p_partkey % 40 + i AS x, p_partkey // 40 + j AS y, sum(w / (SELECT sum(w) FROM w)) AS s FROM part, w WHERE p_size > 40 GROUP BY ALL)
SELECT p_partkey % 40 AS x, p_partkey // 40 AS y, CASE WHEN coalesce(s, 0) <= 0.3 THEN p_retailprice END AS p_retailprice FROM part LEFT JOIN s ON s.x = p_partkey % 40 AND s.y = p_partkey // 40""")
def mask_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.mask_convolved(grid(spark, sf_dir), F.col("scene") > 40, C.gaussian_kernel(5, 1.0), 0.3, ["p_retailprice"], ["x", "y"]).select("x", "y", "p_retailprice")


@query("SELECT p_partkey % 40 AS x, p_partkey // 40 AS y, p_partkey FROM part WHERE p_partkey % 40 BETWEEN 5 AND 20 AND p_partkey // 40 BETWEEN 2 AND 30")
def filter_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.filter_bbox(grid(spark, sf_dir), 5, 2, 20, 30).select("x", "y", "p_partkey")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def filter_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.filter_temporal(table(spark, sf_dir, "events"), "2024-01-05", "2024-01-12", "ts").select("event_id", "ts")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice <= 80000 AND o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'")
def filter_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = table(spark, sf_dir, "orders").withColumn("cloud_cover", F.col("o_totalprice"))
    return C.filter_metadata(scenes, 80000, o_orderstatus="F", o_orderpriority="2-HIGH").select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, floor(c_acctbal / 10) * 10 + 5.0 AS centre, CAST(floor(c_acctbal / 64) AS BIGINT) AS cell FROM customer")
def pixel_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", geo.snap("c_acctbal").alias("centre"), geo.cell("c_acctbal", 64).alias("cell"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size >= 1 AND p_size < 3 THEN 0 WHEN p_size >= 3 AND p_size < 8 THEN 1 WHEN p_size >= 8 AND p_size <= 40 THEN 2 END AS INT) AS range_no FROM part")
def bucket_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", arith.bucketize("p_size", [1, 8, 3, 40]).alias("range_no"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice / 1000 AS \"B08\", l_quantity AS \"B04\", 43000.0::DOUBLE AS \"groupID\" FROM lineitem")
def band_select_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = C.select_bands(lines(spark, sf_dir), ["nir", "red"], ["l_orderkey", "l_linenumber"])
    return C.array_modify(C.rename_bands(picked, {"nir": "B08", "red": "B04"}), groupID=43000.0)


_WIDE = "SELECT user_id AS pixel, " + ", ".join(f"max(CASE WHEN event_type = '{b}' THEN value END) AS {b}" for b in ("click", "view", "purchase", "signup", "error")) + " FROM events GROUP BY user_id"


@query(_WIDE)
def long_to_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.to_wide(series(spark, sf_dir), ["click", "view", "purchase", "signup", "error"], ["pixel"])


@query(f"WITH w AS ({_WIDE}) FROM w UNPIVOT INCLUDE NULLS (value FOR band IN (click, view, purchase, signup, error))")
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = ["click", "view", "purchase", "signup", "error"]
    return C.to_long(C.to_wide(series(spark, sf_dir), bands, ["pixel"]), bands, ["pixel"])


@query("""SELECT pixel, a.clicks, b.spent FROM (SELECT user_id AS pixel, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY ALL) a
FULL JOIN (SELECT o_custkey AS pixel, round(sum(o_totalprice) + 1e-9, 2) AS spent FROM orders GROUP BY ALL) b USING (pixel)""")
def merge_cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = series(spark, sf_dir).where("band = 'click'").groupBy("pixel").agg(F.count("value").alias("clicks"))
    b = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("pixel")).agg(arith.rounded(F.sum("o_totalprice"), 2).alias("spent"))
    return C.merge(a, b, ["pixel"])


@query("""WITH a AS (SELECT user_id AS pixel, ts::DATE AS t, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL),
b AS (SELECT user_id AS pixel, ts::DATE AS t, max(value) AS value FROM events WHERE event_type = 'error' GROUP BY ALL)
SELECT pixel, t::VARCHAR AS t, coalesce(a.value, b.value) AS value FROM a FULL JOIN b USING (pixel, t)""")
def merge_cubes_raw_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    def daily(kind: str) -> DataFrame:
        return series(spark, sf_dir).where(F.col("band") == kind).groupBy("pixel", F.to_date("t").alias("t")).agg(F.max("value").alias("value"))

    return C.merge(daily("view"), daily("error"), ["pixel", "t"], resolve=F.coalesce).withColumn("t", F.col("t").cast("string"))


@query("SELECT (p_partkey % 40) // 4 AS x, (p_partkey // 40) // 4 AS y, round(avg(p_retailprice) + 1e-9, 4) AS p_retailprice, max(p_size) AS scene FROM part GROUP BY ALL")
def resample_to_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.resample(grid(spark, sf_dir), 4, {"p_retailprice": "avg", "scene": "max"}).withColumn("p_retailprice", arith.rounded("p_retailprice"))


@query("SELECT p_partkey % 40 * 2 + i AS x, p_partkey // 40 * 2 + j AS y, p_size AS scene FROM part, range(2) a(i), range(2) b(j)")
def replicate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.replicate(grid(spark, sf_dir).select("x", "y", "scene"), 2)


_DIMS = ", ".join(f"max(CASE WHEN k = {k} THEN v END) AS value_t{i}" for i, k in enumerate((0, 9, 18, 27)))


@query(f"WITH {_CELLS} SELECT pixel, band, {_DIMS} FROM cells GROUP BY ALL")
def dims_to_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = T.aggregate_temporal(series(spark, sf_dir), START, MONTH, KEYS, ["value"])
    return C.dims_to_bands(cells, KEYS, "k", (0, 9, 18, 27), ["value"])


@query("""WITH c AS (SELECT (p_partkey % 40) // 4 AS x, (p_partkey // 40) // 4 AS y, p_size % 7 AS scene, count(*) AS n FROM part GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY n DESC, scene) AS r FROM c) SELECT x, y, scene FROM r WHERE r = 1""")
def overview_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.overview(grid(spark, sf_dir).withColumn("scene", F.col("scene") % 7), "scene", 2)


@query("SELECT p_partkey, CAST(least(greatest(p_size - 10, 0), 20) AS TINYINT) AS class FROM part")
def narrow_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", C.narrow_class(F.col("p_size") - 10).alias("class"))


@query("""SELECT c_custkey, p_size AS scene FROM customer LEFT JOIN part
ON floor(c_custkey % 400 / 10.0) = p_partkey % 40 AND floor(c_nationkey / 10.0) = p_partkey // 40""")
def nearest_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    raster = grid(spark, sf_dir).select((F.col("x") * 10 + 5).alias("x"), (F.col("y") * 10 + 5).alias("y"), "scene")
    points = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 400).alias("x"), F.col("c_nationkey").alias("y"))
    return C.nearest_pixel(points, raster, 10).select("c_custkey", "scene")


_WEEKS = Intervals(days=30, step=7, overlap=7, reducer="mean")


@query("""SELECT event_type, k::INT AS k, round(avg(value) + 1e-9, 4) AS mean FROM events
JOIN range(3) r(k) ON date_diff('day', DATE '2024-01-01', ts::DATE) >= k * 7 AND date_diff('day', DATE '2024-01-01', ts::DATE) < k * 7 + 14 GROUP BY ALL""")
def stream_interval_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window means of a stream of the events' files, run until all are read."""
    events = table_stream(spark, sf_dir, "events.parquet")
    found = completed(interval_means(events, _WEEKS, START, ["event_type"], late="40 days"), "stream", ["event_type", "k"])
    return found.withColumn("mean", arith.rounded("mean"))
