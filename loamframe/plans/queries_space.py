"""Queries of zones and geometry: customers are points on a plane of nation and balance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamframe.functions import arith, geo
from loamframe.operators import sequences, spatial
from loamframe.plans import workflows
from loamframe.plans.catalog import query, table
from loamframe.plans.queries_cube import grid


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("x"), (F.col("c_acctbal") / 100).alias("y"))


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangle per region, overlapping its neighbours."""
    r = F.col("r_regionkey")
    corners = ((r * 5.0 - 1.5, F.lit(-12.0)), (r * 5.0 + 7.5, F.lit(-12.0)), (r * 5.0 + 2.25, F.lit(101.0)))
    ring = F.array(*[F.struct(x.cast("double").alias("x"), y.alias("y")) for x, y in corners])
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("zone"), ring.alias("ring"))


# half planes of the triangles' edges, in the order of their corners
_INSIDE = "y > -12 AND (x - (r * 5.0 + 7.5)) * 113 < -5.25 * (y + 12) AND (x - (r * 5.0 - 1.5)) * 113 > 3.75 * (y + 12)"
_POINTS = "SELECT c_custkey, c_nationkey::DOUBLE AS x, c_acctbal / 100 AS y FROM customer"
_HITS = f"SELECT c_custkey, r AS zone FROM ({_POINTS}) p, (SELECT r_regionkey AS r FROM region) z WHERE {_INSIDE}"


@query(f"SELECT p.c_custkey, h.zone FROM ({_POINTS}) p LEFT JOIN ({_HITS}) h USING (c_custkey)")
def spatial_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.spatial_join(points(spark, sf_dir), strata(spark, sf_dir), "c_custkey", size=8.0).select("c_custkey", "zone")


@query(_HITS)
def spatial_inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.spatial_join(points(spark, sf_dir), strata(spark, sf_dir), "c_custkey", size=8.0, how="inner").select("c_custkey", "zone")


@query(f"SELECT c_custkey, min(zone) AS zone FROM ({_HITS}) GROUP BY c_custkey")
def spatial_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.spatial_join(points(spark, sf_dir), strata(spark, sf_dir), "c_custkey", size=8.0, how="inner", keep="zone").select("c_custkey", "zone")


@query(f"SELECT DISTINCT c_custkey FROM ({_HITS})")
def spatial_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.spatial_join(points(spark, sf_dir), strata(spark, sf_dir), "c_custkey", size=8.0, how="left_semi").select("c_custkey")


@query("SELECT c_custkey, x >= 2 AND x < 9 AND y >= 10 AND y < 60 AND NOT (x >= 4 AND x < 9 AND y >= 30 AND y < 60) AS inside FROM (" + _POINTS + ")")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = ((2, 10), (9, 10), (9, 30), (4, 30), (4, 60), (2, 60))
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in shape])
    return points(spark, sf_dir).select("c_custkey", geo.contains(ring, "x", "y").alias("inside"))


@query("""SELECT r_regionkey AS zone, 508.5::DOUBLE AS area, round((r_regionkey * 15 + 8.25)::DOUBLE / 3 + 1e-9, 4) AS cx, round((101 - 24)::DOUBLE / 3 + 1e-9, 4) AS cy,
  (r_regionkey * 5 - 1.5)::DOUBLE AS minx, 101.0::DOUBLE AS maxy FROM region""")
def polygon_area_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, box = geo.centroid("ring"), geo.ring_box("ring")
    return strata(spark, sf_dir).select("zone", geo.area("ring").alias("area"), arith.rounded(c.x).alias("cx"), arith.rounded(c.y).alias("cy"), box.minx.alias("minx"), box.maxy.alias("maxy"))


_LONLAT = "SELECT c_custkey, (c_custkey * 37 % 3600) / 10.0 - 180 AS lon, (c_custkey * 91 % 1600) / 10.0 - 80 AS lat FROM customer"


def lonlat(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", ((k * 37 % 3600) / 10.0 - 180).alias("lon"), ((k * 91 % 1600) / 10.0 - 80).alias("lat"))


@query(f"""WITH p AS ({_LONLAT}), z AS (
  SELECT *, CAST(CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32
    WHEN lat >= 72 AND lat <= 84 AND lon >= 0 AND lon < 42 THEN CASE WHEN lon < 9 THEN 31 WHEN lon < 21 THEN 33 WHEN lon < 33 THEN 35 ELSE 37 END
    ELSE floor((lon + 180) / 6) % 60 + 1 END AS INT) AS zone FROM p)
SELECT c_custkey, zone, substr('CDEFGHJKLMNPQRSTUVWXX', CAST(floor((lat + 80) / 8) AS INT) + 1, 1) AS letter, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + zone AS INT) AS epsg FROM z""")
def utm_zone_epsg(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lonlat(spark, sf_dir).withColumn("zone", geo.utm_zone("lon", "lat"))
    return p.select("c_custkey", "zone", geo.utm_letter("lat").alias("letter"), geo.utm_epsg("lat", "zone").alias("epsg"))


@query(f"SELECT c_custkey, round(lon + 1e-9, 6)::DOUBLE AS lon, round(lat + 1e-9, 6)::DOUBLE AS lat FROM ({_LONLAT})")
def utm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points projected to their zone's metres and back."""
    p = lonlat(spark, sf_dir).withColumn("zone", geo.utm_zone("lon", "lat")).withColumn("p", geo.utm_project("lon", "lat", "zone"))
    back = p.withColumn("b", geo.utm_unproject("p.x", "p.y", "zone", F.col("lat") < 0))
    return back.select("c_custkey", arith.rounded("b.lon", 6).alias("lon"), arith.rounded("b.lat", 6).alias("lat"))


@query(f"""WITH p AS ({_LONLAT}) SELECT c_custkey, round(2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(50 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(50)) * pow(sin(radians(10 - lon) / 2), 2)))) + 1e-9, 3) AS km FROM p""")
def haversine_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lonlat(spark, sf_dir).select("c_custkey", arith.rounded(geo.haversine_km("lon", "lat", F.lit(10.0), F.lit(50.0)), 3).alias("km"))


_CELL = " + ".join(f"(((cx >> {k}) & 1) << {2 * k}) + (((cy >> {k}) & 1) << {2 * k + 1})" for k in range(16))
_GAPS = f"""WITH p AS ({_LONLAT}), c AS (SELECT *, CAST(least(floor((lon + 180) / 360 * 65536), 65535) AS BIGINT) AS cx, CAST(least(floor((lat + 90) / 180 * 65536), 65535) AS BIGINT) AS cy FROM p),
o AS (SELECT c_custkey, lon, lat, {_CELL} AS cell FROM c),
l AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM o WINDOW w AS (ORDER BY cell, c_custkey)),
d AS (SELECT *, CASE WHEN plon IS NOT NULL THEN 2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2)))) END AS km FROM l),
g AS (SELECT *, CAST(sum(CASE WHEN km > 400 THEN 1 ELSE 0 END) OVER (ORDER BY cell, c_custkey) AS BIGINT) AS "group" FROM d),
i AS (SELECT *, "group" > 0 AND "group" < (SELECT max("group") FROM g) AS inside FROM g)"""


@query(_GAPS + ' SELECT c_custkey, cell, round(km + 1e-9, 3) AS distance_km, "group", inside FROM i')
def gap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequences.gap_groups(lonlat(spark, sf_dir), "c_custkey", break_km=400.0)
    return out.select("c_custkey", "cell", arith.rounded("distance_km", 3).alias("distance_km"), "group", "inside")


@query(_GAPS + ' SELECT "group", count(*) AS n, min(lon) AS minx, min(lat) AS miny, max(lon) AS maxx, max(lat) AS maxy FROM i WHERE inside GROUP BY "group"')
def cluster_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = sequences.gap_groups(lonlat(spark, sf_dir), "c_custkey", break_km=400.0).where("inside")
    return spatial.group_boxes(inside, ["group"], "lon", "lat")


@query()
def cluster_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hulls of the gap groups: group, number of corners and area."""
    inside = sequences.gap_groups(lonlat(spark, sf_dir), "c_custkey", break_km=400.0).where("inside")
    return spatial.convex_hulls(inside, "group", "lon", "lat").select("group", F.size("ring").alias("corners"), arith.rounded(geo.area("ring")).alias("area"))


@query("""SELECT r_name, o_orderstatus, round(avg(o_totalprice) + 1e-9, 2) AS o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL""")
def zonal_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    zones = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "r_name")
    return spatial.zonal(table(spark, sf_dir, "orders"), zones, ["o_custkey"], ["r_name"], ["o_totalprice"], by=["o_orderstatus"]).withColumn("o_totalprice", arith.rounded("o_totalprice", 2))


@query("SELECT p_brand AS zone, " + ", ".join(f"count(*) FILTER (p_size % 7 + 1 = {k}) AS c{k}" for k in range(1, 8)) + " FROM part GROUP BY p_brand")
def zonal_sum_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    raster = table(spark, sf_dir, "part").select(F.col("p_brand").alias("zone"), (F.col("p_size") % 7 + 1).alias("class"))
    return spatial.one_hot_counts(raster, ["zone"], "class", range(1, 8))


_HIST = "SELECT p_brand AS zone, (p_size % 4 * 10 + 10)::DOUBLE AS class, count(*) AS n FROM part GROUP BY ALL"


def land_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("zone"), (F.col("p_size") % 4 * 10 + 10).alias("class"))


@query(f"SELECT zone, string_agg(class || '=' || n, ',' ORDER BY class) AS histogram FROM ({_HIST}) GROUP BY zone")
def zonal_histogram_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = spatial.histogram_map(land_classes(spark, sf_dir), ["zone"], "class")
    pairs = F.transform(F.array_sort(F.map_entries("histogram")), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string")))
    return maps.select("zone", F.array_join(pairs, ",").alias("histogram"))


@query(f"""SELECT p_brand AS zone, count(*) FILTER (p_size % 4 = 2) AS grassland, count(*) FILTER (p_size % 4 = 3) AS cropland, 0::BIGINT AS water,
  100.0::DOUBLE * count(*) FILTER (p_size % 4 = 2) / 4000000 AS grassland_perc, 100.0::DOUBLE * count(*) FILTER (p_size % 4 = 3) / 4000000 AS cropland_perc, 0.0::DOUBLE AS water_perc FROM part GROUP BY p_brand""")
def landcover_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = land_classes(spark, sf_dir)
    grid_rows = rows.select("zone").distinct()
    return workflows.grid_histograms(grid_rows, spatial.histogram_map(rows, ["zone"], "class"), 2000 * 2000, {"grassland": 30, "cropland": 40, "water": 80})


_TILES = """SELECT n_nationkey AS tile, count(o_orderkey) FILTER (o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01') AS n
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_nationkey"""


def tile_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("tile"), F.col("o_orderdate").alias("t"))
    return spatial.tile_counts(products, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tile")), "1996-01-01", "1997-01-01")


@query(_TILES)
def tile_product_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tile_products(spark, sf_dir)


@query(f"SELECT tile, n AS sentinel2count, n - 10 AS sentinel1count, 0.0::DOUBLE AS cropland_perc, CASE WHEN n > 100 AND n - 10 > 80 THEN 'local' ELSE 'cloud' END AS provider FROM ({_TILES})")
def tile_provider_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflows.tile_providers(tile_products(spark, sf_dir).select("tile", F.col("n").alias("sentinel2count"), (F.col("n") - 10).alias("sentinel1count")))


@query("""WITH c AS (SELECT DISTINCT c_nationkey AS tile, o_orderdate::DATE AS date FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT t.tile, d.date::VARCHAR AS date FROM (SELECT n_nationkey AS tile FROM nation) t CROSS JOIN (SELECT unnest(generate_series(min(o_orderdate)::DATE, max(o_orderdate)::DATE, INTERVAL 1 DAY))::DATE AS date FROM orders) d
LEFT JOIN c ON c.tile = t.tile AND c.date = d.date WHERE c.tile IS NULL""")
def expected_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    catalogue = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("tile"), F.to_date("o_orderdate").alias("date"))
    span = orders.agg(F.min(F.to_date("o_orderdate")).cast("string").alias("first"), F.max(F.to_date("o_orderdate")).cast("string").alias("last")).first()
    return workflows.expected_gaps(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tile")), span.first, span.last, catalogue).withColumn("date", F.col("date").cast("string"))


@query("""WITH RECURSIVE b AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 500)::DOUBLE AS x, (s_suppkey * 53 % 300)::DOUBLE AS y FROM supplier),
e AS (SELECT a.id AS i, c.id AS j FROM b a JOIN b c ON a.x < c.x + 12 AND c.x < a.x + 12 AND a.y < c.y + 12 AND c.y < a.y + 12 AND a.id <> c.id),
r AS (SELECT id AS s, id AS t FROM b UNION SELECT r.s, e.j FROM r JOIN e ON e.i = r.t)
SELECT s AS s_suppkey, min(t) AS "group" FROM r GROUP BY s""")
def overlap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = (k * 37 % 500).cast("double"), (k * 53 % 300).cast("double")
    boxes = table(spark, sf_dir, "supplier").select("s_suppkey", x.alias("minx"), y.alias("miny"), (x + 12).alias("maxx"), (y + 12).alias("maxy"))
    return spatial.overlapping_groups(boxes, "s_suppkey", 24.0)


@query("SELECT p_partkey % 40 AS x, p_partkey // 40 AS y FROM part WHERE p_partkey % 40 >= 10 AND p_partkey % 40 < 20 AND p_partkey // 40 >= 5 AND p_partkey // 40 < 15")
def filter_spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = spark.range(1).select(geo.box_ring(F.lit(9.5), F.lit(4.5), F.lit(19.5), F.lit(14.5)).alias("ring"))
    return spatial.spatial_join(grid(spark, sf_dir), shape, "p_partkey", size=10.0, how="left_semi").select("x", "y")
