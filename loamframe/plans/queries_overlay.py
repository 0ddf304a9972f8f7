"""Queries of unions of polygons: suppliers and customers as parcels whose corners are whole numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamframe.functions import arith, geo
from loamframe.operators import buffers, overlay, radar
from loamframe.operators import cube as C
from loamframe.plans import workflows
from loamframe.plans.catalog import query, table
from loamframe.plans.queries_composites import squares
from loamframe.sources import readers, sinks
from loamframe.storage import fresh_path


def corners_ring(x, y, w, h):
    """Ring of a letter L: a row of w squares and, on its first one, a column of h squares in all."""
    return F.array(*[F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in ((x, y), (x + w, y), (x + w, y + 1), (x + 1, y + 1), (x + 1, y + h), (x, y + h))])


@query("""WITH l AS (SELECT c_nationkey, c_custkey * 37 % 40 AS x, c_custkey * 53 % 30 AS y, 2 + c_custkey % 5 AS w, 2 + c_custkey % 7 AS h FROM customer),
c AS (SELECT c_nationkey AS g, x + unnest(range(w)) AS i, y AS j FROM l UNION SELECT c_nationkey, x, y + unnest(range(h)) FROM l),
a AS (SELECT g, count(*) AS area FROM c GROUP BY g),
b AS (SELECT g, count(*) AS border FROM (SELECT g, i + di AS i, j + dj AS j FROM c, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(di, dj)) n ANTI JOIN c USING (g, i, j) GROUP BY g),
v AS (SELECT g, i + di AS i, j + dj AS j, sum(1 << (2 * di + dj)) AS m FROM c, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(di, dj) GROUP BY ALL),
k AS (SELECT g, sum(CASE WHEN m IN (1, 2, 4, 8, 14, 13, 11, 7) THEN 1 WHEN m IN (9, 6) THEN 2 ELSE 0 END) AS corners FROM v GROUP BY g)
SELECT g AS c_nationkey, area::DOUBLE AS area, border::DOUBLE AS border, corners::BIGINT AS corners FROM a JOIN b USING (g) JOIN k USING (g)""")
def dissolved_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, border length and number of corners of each nation's union of parcels."""
    k = F.col("c_custkey")
    shapes = table(spark, sf_dir, "customer").select("c_nationkey", corners_ring(k * 37 % 40, k * 53 % 30, 2 + k % 5, 2 + k % 7).alias("ring"))
    rings = overlay.union_rings(shapes, 8.0, by="c_nationkey", precision=1.0)
    after = F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))
    length = F.aggregate(F.zip_with("ring", after, lambda p, q: F.hypot(q.x - p.x, q.y - p.y)), F.lit(0.0), lambda s, d: s + d)
    return rings.groupBy("c_nationkey").agg(F.sum("area").alias("area"), F.sum(length).alias("border"), F.sum(F.size("ring")).alias("corners"))


@query("""WITH RECURSIVE s AS (SELECT s_suppkey AS id, s_nationkey AS kind, s_suppkey * 37 % 300 AS x, s_suppkey * 53 % 200 AS y, 5 + s_suppkey % 11 AS w, 5 + s_suppkey % 13 AS h FROM supplier),
p AS (SELECT a.id AS a, b.id AS b, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS ox, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS oy FROM s a JOIN s b ON a.id <> b.id),
e AS (SELECT a, b FROM p WHERE (ox > 0 AND oy >= 0) OR (ox >= 0 AND oy > 0)),
r AS (SELECT id AS a, id AS t FROM s UNION SELECT r.a, e.b FROM r JOIN e ON r.t = e.a),
m AS (SELECT a AS id, min(t) AS part FROM r GROUP BY a),
c AS (SELECT DISTINCT part, x + i AS i, y + unnest(range(h)) AS j FROM (SELECT part, x, y, h, unnest(range(w)) AS i FROM s JOIN m USING (id)))
SELECT part AS s_suppkey, any_value(s.kind) AS s_nationkey, count(*)::DOUBLE AS area FROM c JOIN s ON s.id = part GROUP BY part""")
def dissolved_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the union of all parcels with the attributes of their first parcel."""
    k = F.col("s_suppkey")
    x, y = k * 37 % 300, k * 53 % 200
    ring = F.array(*[F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in ((x, y), (x + 5 + k % 11, y), (x + 5 + k % 11, y + 5 + k % 13), (x, y + 5 + k % 13))])
    parcels = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", ring.alias("ring"))
    return workflows.dissolved_parcels(parcels, "s_suppkey", 16.0, precision=1.0).select("s_suppkey", "s_nationkey", "area")


_LETTERS = """l AS (SELECT c_custkey AS id, 4 + c_custkey % 9 AS w, 4 + c_custkey % 7 AS h, 2 + c_custkey % 4 AS t FROM customer),
c AS (SELECT id, i, j FROM (SELECT *, unnest(range(w + t)) AS i FROM (SELECT *, unnest(range(h + t)) AS j FROM l)) WHERE i < t OR j < t)"""
_AROUND = "(SELECT unnest(range(-{d}, {d} + 1)) AS di), (SELECT unnest(range(-{d}, {d} + 1)) AS dj)"


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters L with strokes of t, a foot of w and a stem of h beyond it."""
    k = F.col("c_custkey")
    w, h, t = 4 + k % 9, 4 + k % 7, 2 + k % 4
    corners = ((F.lit(0), F.lit(0)), (w + t, F.lit(0)), (w + t, t), (t, t), (t, h + t), (F.lit(0), h + t))
    ring = F.array(*[F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in corners])
    return table(spark, sf_dir, "customer").select("c_custkey", ring.alias("ring"))


@query(f"WITH {_LETTERS} SELECT id AS c_custkey, count(DISTINCT (i + di, j + dj))::DOUBLE AS area FROM c, {_AROUND.format(d=2)} GROUP BY id")
def buffer_outward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of each parcel with a mitred border of 2 around it."""
    found = buffers.buffered(letters(spark, sf_dir), "c_custkey", 2.0)
    return found.groupBy("c_custkey").agg(F.round(F.sum("area"), 3).alias("area"))


@query(f"""WITH {_LETTERS}, e AS (SELECT id, i + di AS i, j + dj AS j FROM c, {_AROUND.format(d=1)} GROUP BY ALL HAVING count(*) = 9)
SELECT l.id AS c_custkey, count(e.id)::DOUBLE AS area FROM l LEFT JOIN e ON e.id = l.id GROUP BY l.id""")
def buffer_inward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area that is left of each parcel without a mitred border of 1 inside it; 0 if nothing is."""
    shapes = letters(spark, sf_dir)
    found = buffers.buffered(shapes, "c_custkey", -1.0).groupBy("c_custkey").agg(F.round(F.sum("area"), 3).alias("area"))
    return shapes.select("c_custkey").join(found, "c_custkey", "left").select("c_custkey", F.coalesce("area", F.lit(0.0)).alias("area"))


@query("""WITH b AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 500)::DOUBLE + 6 AS x, (s_suppkey * 53 % 300)::DOUBLE + 6 AS y FROM supplier)
SELECT id AS s_suppkey FROM b WHERE greatest(100 - x, 0, x - 250) + greatest(50 - y, 0, y - 200) <= 6""")
def indexed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that meet a mask, read from the files whose boxes meet it."""
    path = fresh_path(spark, "indexed")
    sinks.write_indexed(squares(spark, sf_dir), path, 25.0, files=8)
    mask = spark.range(1).select(geo.box_ring(F.lit(100.0), F.lit(50.0), F.lit(250.0), F.lit(200.0)).alias("ring"))
    return readers.read_indexed(spark, path, mask, "s_suppkey", 50.0).select("s_suppkey")


_TARGETS = "t AS (SELECT p_partkey AS id, (p_partkey % 25 * 1.6 + 0.8)::DOUBLE AS x, (p_partkey // 25 * 1.6 + 0.8)::DOUBLE AS y FROM part), s AS (SELECT p_partkey % 40 AS i, p_partkey // 40 AS j, p_retailprice::DOUBLE AS v FROM part)"


def aligned(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    """Prices of parts, a raster of unit pixels, at the pixels of a grid 1.6 wide."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    cube = parts.select((k % 40 + 0.5).alias("x"), (F.floor(k / 40) + 0.5).alias("y"), "p_retailprice")
    targets = parts.select("p_partkey", (k % 25 * 1.6 + 0.8).cast("double").alias("x"), (F.floor(k / 25) * 1.6 + 0.8).cast("double").alias("y"))
    found = C.align(cube, targets, 1.0, ["p_retailprice"], how)
    return found.select("p_partkey", arith.rounded("p_retailprice", 4).alias("p_retailprice"))


@query(f"WITH {_TARGETS} SELECT id AS p_partkey, round(v + 1e-9, 4) AS p_retailprice FROM t LEFT JOIN s ON i = floor(x) AND j = floor(y)")
def resample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(spark, sf_dir, "nearest")


@query(f"""WITH {_TARGETS}, c AS (SELECT id, floor(x - 0.5) + a AS i, floor(y - 0.5) + b AS j, abs(1 - a - (x - 0.5 - floor(x - 0.5))) * abs(1 - b - (y - 0.5 - floor(y - 0.5))) AS w FROM t, range(2) r(a), range(2) q(b))
SELECT id AS p_partkey, round(sum(w * v) / nullif(sum(CASE WHEN v IS NOT NULL AND w > 0 THEN w END), 0) + 1e-9, 4) AS p_retailprice FROM c LEFT JOIN s USING (i, j) GROUP BY id""")
def resample_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(spark, sf_dir, "bilinear")


_ORBIT = "o AS (SELECT n_nationkey AS i, 7071000 * cos(0.9 + n_nationkey * 0.01) AS x, 1200000::DOUBLE AS y, 7071000 * sin(0.9 + n_nationkey * 0.01) AS z, -7071 * sin(0.9 + n_nationkey * 0.01) AS vx, 0::DOUBLE AS vy, 7071 * cos(0.9 + n_nationkey * 0.01) AS vz FROM nation)"
_PLACE = "(2*s*s*s - 3*s*s + 1) * a.{0} + (s*s*s - 2*s*s + s) * 10 * a.v{0} + (3*s*s - 2*s*s*s) * b.{0} + (s*s*s - s*s) * 10 * b.v{0} AS s{0}"


@query(f"""WITH {_ORBIT}, p AS (SELECT p_partkey AS id, p_partkey // 40 AS line, p_partkey % 40 AS px, p_size AS dn, 5 + p_partkey % 40 * 0.01 AS lon, 52 + p_partkey // 40 * 0.01 AS lat, p_partkey // 40 * 0.4 AS t FROM part),
g AS (SELECT line, px, 400 + p_retailprice / 10 AS v FROM part JOIN p ON id = p_partkey WHERE line % 10 = 0 AND px % 8 = 0),
c AS (SELECT id, floor(px / 8) + da AS i, floor(line / 10) + db AS j, abs(1 - da - (px / 8 - floor(px / 8))) * abs(1 - db - (line / 10 - floor(line / 10))) AS w FROM p, range(2) r(da), range(2) q(db)),
l AS (SELECT id, sum(w * v) / nullif(sum(CASE WHEN v IS NOT NULL AND w > 0 THEN w END), 0) AS scale FROM c LEFT JOIN g ON g.px = i * 8 AND g.line = j * 10 AND w > 0 GROUP BY id),
k AS (SELECT p.*, floor(t / 10) AS k, t / 10 - floor(t / 10) AS s FROM p),
m AS (SELECT k.*, {', '.join(_PLACE.format(x) for x in 'xyz')} FROM k LEFT JOIN o a ON a.i = k LEFT JOIN o b ON b.i = k + 1),
e AS (SELECT *, radians(lon) AS lam, radians(lat) AS phi, 6378137.0 / sqrt(1 - 0.00669437999014 * sin(radians(lat)) ** 2) AS n FROM m),
d AS (SELECT *, sx - n * cos(phi) * cos(lam) AS dx, sy - n * cos(phi) * sin(lam) AS dy, sz - n * (1 - 0.00669437999014) * sin(phi) AS dz FROM e),
f AS (SELECT *, acos((cos(phi) * cos(lam) * dx + cos(phi) * sin(lam) * dy + sin(phi) * dz) / sqrt(dx * dx + dy * dy + dz * dz)) AS angle FROM d)
SELECT id AS p_partkey, round(10 * log10((dn / scale) ** 2 * sin(angle)), 6) AS vv, round(degrees(angle), 6) AS incidence FROM f JOIN l USING (id)""")
def sigma_nought(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of parts as radar counts, calibrated by scales at every eighth pixel of every tenth line."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.floor(k / 40).alias("line"), (k % 40).alias("pixel"), F.col("p_size").alias("vv"), "p_retailprice")
    counts = parts.select("p_partkey", "line", "pixel", "vv", (5 + F.col("pixel") * 0.01).alias("lon"), (52 + F.col("line") * 0.01).alias("lat"), (F.col("line") * 0.4).alias("t"))
    scales = parts.where("line % 10 = 0 AND pixel % 8 = 0").select("line", "pixel", (400 + F.col("p_retailprice") / 10).alias("vv"))
    turn, i = 0.9 + F.col("n_nationkey") * 0.01, F.col("n_nationkey")
    orbit = table(spark, sf_dir, "nation").select(
        (i * 10.0).alias("t"), (7071000 * F.cos(turn)).alias("x"), F.lit(1200000.0).alias("y"), (7071000 * F.sin(turn)).alias("z"), (-7071 * F.sin(turn)).alias("vx"), F.lit(0.0).alias("vy"), (7071 * F.cos(turn)).alias("vz")
    )
    found = radar.calibrated(counts, scales, orbit, ["vv"], lines=10, pixels=8, orbit_step=10.0)
    return found.select("p_partkey", F.round("vv", 6).alias("vv"), F.round("incidence", 6).alias("incidence"))
