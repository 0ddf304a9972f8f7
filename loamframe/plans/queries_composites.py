"""Queries of the composites: feature cubes, training rows, validation, plans of work.

Lines of orders are the scenes of a raster whose pixels are the suppliers, parts
give its land cover, customers are points and parcels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamframe.functions import arith, geo, text
from loamframe.operators import cube as C
from loamframe.operators import boosting, learning, ledger, sequences, spatial, tables
from loamframe.plans import features, workflows
from loamframe.plans.catalog import query, table
from loamframe.plans.queries_cube import grid, lines
from loamframe.plans.queries_space import lonlat
from loamframe.plans.specs import PICKS, FeatureOptions, Intervals, Season
from loamframe.sources import readers

SEASON = Season.crops(1996)
_BANDS = {
    "B03": "l_extendedprice / 20",
    "B04": "l_quantity * 100",
    "B05": "l_extendedprice / 15",
    "B06": "l_extendedprice / 10",
    "B07": "l_extendedprice / 12 + 50",
    "B08": "l_extendedprice / 8",
    "B11": "l_discount * 50000",
    "B12": "l_tax * 60000",
}


def optical(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_suppkey") % 40, F.floor(F.col("l_suppkey") / 40)
    made = [F.expr(sql).alias(name) for name, sql in _BANDS.items()]
    return table(spark, sf_dir, "lineitem").select(x.alias("x"), y.alias("y"), F.col("l_shipdate").alias("t"), *made, F.col("l_linenumber").alias("SCL"), (F.col("l_quantity") * 2).alias("cloud_cover"))


def radar(spark: SparkSession, sf_dir: str, factor: int = 1) -> DataFrame:
    """Calibrated backscatter, on a grid `factor` times as fine as the optical one."""
    x, y = (F.col("l_suppkey") % 40) * factor + F.col("l_linenumber") % factor, F.floor(F.col("l_suppkey") / 40) * factor
    return table(spark, sf_dir, "lineitem").select(x.alias("x"), y.alias("y"), F.col("l_shipdate").alias("t"), (F.col("l_tax") * 10 + 0.01).alias("VV"), (F.col("l_discount") * 5 + 0.001).alias("VH"), F.col("l_returnflag").alias("orbit"))


def landcover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).select("x", "y", (F.col("scene") % 5 * 10).alias("MAP"))


_COVER = "SELECT DISTINCT p_partkey % 40 AS x, p_partkey // 40 AS y, true AS kept FROM part WHERE p_size % 5 * 10 IN (30, 40)"
_SCENES = "SELECT l_suppkey % 40 AS x, l_suppkey // 40 AS y, l_shipdate AS t, l_linenumber, " + ", ".join(f"{sql} AS {name}" for name, sql in _BANDS.items()) + " FROM lineitem WHERE l_quantity * 2 <= 80"
_CLEAR = f"SELECT x, y, t, " + ", ".join(f"CASE WHEN l_linenumber IN (4, 5) AND kept THEN {name} END AS {name}" for name in _BANDS) + f" FROM ({_SCENES}) LEFT JOIN ({_COVER}) USING (x, y)"


def _scaled(sql: str, kind: str) -> str:
    low, high = arith.RANGES[kind]
    return f"CASE WHEN ({sql}) IS NOT NULL THEN (least(greatest({sql}, {low}), {high}) - {low}) / ({high} - {low}) * 30000 END"


def _difference(name: str) -> str:
    a, b = arith.NORMALIZED_DIFFERENCES[name]
    return f"({a} - {b}) / nullif({a} + {b}, 0)"


_SIDES = "sqrt((B08 - B04) ** 2 + (0.842 - 0.665) ** 2) AS a, sqrt((B11 - B08) ** 2 + (1.61 - 0.842) ** 2) AS b, sqrt((B11 - B04) ** 2 + (1.61 - 0.665) ** 2) AS c"
_ANGLE = "acos(least(greatest((a * a + b * b - c * c) / nullif(2 * a * b, 0), -1), 1)) / pi()"
_FULL = FeatureOptions(SEASON)
_OPTICAL = ", ".join([f"{_scaled(b, 'band')} AS {b}" for b in _FULL.optical_bands] + [f"{_scaled(_difference(i), 'index')} AS {i}" for i in _FULL.indices] + [f"CASE WHEN a * b <> 0 THEN {_scaled(_ANGLE, 'angle')} END AS ANIR"])


def _rounded(columns: list[str], digits: int = 2) -> str:
    return ", ".join(f'round("{c}" + 1e-9, {digits}) + 0.0 AS "{c}"' for c in columns)


def rounded(df: DataFrame, keys: list[str], digits: int = 2) -> DataFrame:
    return df.select(*keys, *[(arith.rounded(c, digits) + 0.0).alias(c) for c in df.columns if c not in keys])


@query(f"WITH c AS ({_CLEAR}), s AS (SELECT *, {_SIDES} FROM c), o AS (SELECT x, y, t, {_OPTICAL} FROM s) SELECT x, y, t, {_rounded(list(_FULL.optical_features))} FROM o")
def optical_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.optical_bands(optical(spark, sf_dir), _FULL, landcover(spark, sf_dir)), ["x", "y", "t"])


_BACKSCATTER = "SELECT l_suppkey % 40 AS x, l_suppkey // 40 AS y, l_shipdate AS t, l_tax * 10 + 0.01 AS vv, l_discount * 5 + 0.001 AS vh, l_returnflag AS orbit FROM lineitem"
_RADAR = f"{_scaled('30 * vh / nullif(vv, 0)', 'decibel')} AS ratio, {_scaled('30 + 10 * log10(vv)', 'decibel')} AS \"VV\", {_scaled('30 + 10 * log10(vh)', 'decibel')} AS \"VH\""


@query(f"WITH b AS ({_BACKSCATTER}), r AS (SELECT x, y, t, {_RADAR} FROM b WHERE orbit = 'R') SELECT x, y, t, {_rounded(['ratio', 'VV', 'VH'])} FROM r")
def radar_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = FeatureOptions(SEASON, radar_predicates={"orbit": "R"})
    return rounded(features.radar_bands(radar(spark, sf_dir), options), ["x", "y", "t"])


def _statistics(name: str, source: str, bands: tuple[str, ...], spec: Intervals) -> str:
    """Common tables that end in `name`: per pixel the statistics of each band over the season's windows."""
    long = " UNION ALL ".join(f"SELECT x, y, '{b}' AS band, t, \"{b}\" AS v FROM ({source})" for b in bands)
    day = f"date_diff('day', DATE '{SEASON.start}', t::DATE)"
    picks = ", ".join(f"max(CASE WHEN k = {k} THEN v END) AS t{i}" for i, k in enumerate(spec.picks))
    edges = {"t0": "coalesce(t0, t1, t2)", "t1": "coalesce(t1, t2)", "t4": "coalesce(t4, t3)", "t5": "coalesce(t5, t4, t3)"}
    cells = ", ".join(f"max(CASE WHEN band = '{b}' THEN {edges.get(s, s)} END) AS \"{b}_{s}\"" for b in bands for s in ("p25", "p50", "p75", "sd", *(f"t{i}" for i in range(PICKS))))
    return f"""{name}_l AS ({long}),
{name}_c AS (SELECT x, y, band, k::INT AS k, {"median" if spec.reducer == "median" else "avg"}(v) AS v FROM {name}_l JOIN range({spec.count}) r(k) ON {day} >= k * {spec.step} AND {day} < k * {spec.step} + {spec.width} GROUP BY ALL),
{name}_d AS (SELECT p.x, p.y, p.band, r.k::INT AS k, c.v FROM (SELECT DISTINCT x, y, band FROM {name}_c) p CROSS JOIN range({spec.count}) r(k)
  LEFT JOIN {name}_c c ON c.x = p.x AND c.y = p.y AND c.band = p.band AND c.k = r.k),
{name}_e AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER b AS pk, last_value(v IGNORE NULLS) OVER b AS pv,
  first_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER a AS nk, first_value(v IGNORE NULLS) OVER a AS nv FROM {name}_d
  WINDOW b AS (PARTITION BY x, y, band ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY x, y, band ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{name}_f AS (SELECT x, y, band, k, coalesce(v, pv + (nv - pv) * (k - pk) / nullif(nk - pk, 0)) AS v FROM {name}_e),
{name}_p AS (SELECT x, y, band, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, stddev_samp(v) AS sd, {picks} FROM {name}_f GROUP BY ALL),
{name} AS (SELECT x, y, {cells} FROM {name}_p GROUP BY ALL)"""


_FEW = FeatureOptions(SEASON, optical_bands=("B06",), indices=("NDVI",), angle=False)
_FEW_OPTICAL = f"SELECT x, y, t, {_scaled('B06', 'band')} AS B06, {_scaled(_difference('NDVI'), 'index')} AS NDVI FROM ({_CLEAR})"
_COARSE = f"SELECT x, y, t, CASE WHEN kept THEN vv END AS vv, CASE WHEN kept THEN vh END AS vh FROM (SELECT x, y, t, avg(vv) AS vv, avg(vh) AS vh FROM ({_BACKSCATTER}) GROUP BY ALL) LEFT JOIN ({_COVER}) USING (x, y)"
_COARSE = f"SELECT x, y, t, {_RADAR} FROM ({_COARSE})"
_ALL_FEATURES = [f"{b}_{s}" for b in (*_FEW.optical_features, *_FEW.radar_features) for s in ("p25", "p50", "p75", "sd", *(f"t{i}" for i in range(PICKS)))]


@query(f"""WITH {_statistics("o", _FEW_OPTICAL, _FEW.optical_features, SEASON.optical())}, {_statistics("r", _COARSE, _FEW.radar_features, SEASON.radar())}
SELECT x, y, {_rounded(_ALL_FEATURES)} FROM o FULL JOIN r USING (x, y)""")
def load_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sensors' seasonal features, radar brought from a grid twice as fine."""
    cube, names = features.load_features(optical(spark, sf_dir), radar(spark, sf_dir, 2).drop("orbit"), _FEW, landcover(spark, sf_dir), radar_factor=2)
    return rounded(cube.select("x", "y", *names), ["x", "y"])


@query(f"""WITH o AS (SELECT l_suppkey % 40 AS x, l_suppkey // 40 AS y, l_shipdate AS t, avg(l_quantity * 100) AS "B04" FROM lineitem GROUP BY ALL),
r AS (SELECT x, y, t, avg(vv) AS vv, avg(vh) AS vh FROM ({_BACKSCATTER}) WHERE orbit = 'R' GROUP BY ALL),
m AS (SELECT x, y, t, "B04", 10 * log10(vv) AS "VV", 10 * log10(vh) AS "VH" FROM o FULL JOIN r USING (x, y, t) WHERE t >= TIMESTAMP '1996-01-01' AND t < TIMESTAMP '1999-01-01'),
a AS (SELECT r_regionkey AS sample, t, avg("B04") AS "B04", avg("VV") AS "VV", avg("VH") AS "VH" FROM m JOIN region ON r_regionkey = x % 5 GROUP BY ALL)
SELECT sample, t, {_rounded(["B04", "VV", "VH"])} FROM a""")
def raw_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw series of both sensors at samples of several pixels."""
    s1 = radar(spark, sf_dir).where("orbit = 'R'").groupBy("x", "y", "t").agg(F.avg("VV").alias("VV"), F.avg("VH").alias("VH"))
    s2 = optical(spark, sf_dir).groupBy("x", "y", "t").agg(F.avg("B04").alias("B04"))
    pixels = s2.select("x", "y").distinct()
    samples = pixels.join(table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("sample")), F.col("x") % 5 == F.col("sample")).select("x", "y", "sample")
    found = features.raw_series(s2, s1, "1996-01-01", "1999-01-01", samples)
    return rounded(found.withColumn("sample", F.col("sample").cast("int")), ["sample", "t"])


_SERIES = "SELECT 2017 + l_linenumber % 3 AS year, (29 + l_suppkey % 4)::INT AS zone, (1000 + l_partkey % 7)::INT AS crop, (l_suppkey % 2)::INT AS part, (l_orderkey % 10)::INT AS position, CASE WHEN l_quantity <> 50 THEN l_quantity END AS v, l_returnflag AS f FROM lineitem"


@query(f"""WITH s AS ({_SERIES}), t AS (SELECT year, zone, crop, part, position, avg(CASE WHEN f = 'A' THEN v END) AS a, avg(CASE WHEN f = 'N' THEN v END) AS n, avg(CASE WHEN f = 'R' THEN v END) AS r FROM s GROUP BY ALL)
SELECT year, zone, crop, part, position, {_rounded(["a", "n", "r"], 4).replace('AS "a"', 'AS "A_p50"').replace('AS "n"', 'AS "N_p50"').replace('AS "r"', 'AS "R_p50"')}, position * 1000 AS "groupID" FROM t WHERE position < 8""")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of features read from names of files, with the strata of their position."""
    lines = table(spark, sf_dir, "lineitem")
    name = F.format_string("out/year%d_zone%d_id%d_p%d/series_%d.nc", F.col("l_linenumber") % 3 + 2017, F.col("l_suppkey") % 4 + 29, F.col("l_partkey") % 7 + 1000, F.col("l_suppkey") % 2, F.col("l_orderkey") % 10)
    value = F.when(F.col("l_quantity") == 50, 65535.0).otherwise(F.col("l_quantity"))
    values = lines.select(name.alias("path"), F.col("l_returnflag").alias("band"), F.lit("p50").alias("stat"), value.alias("value"))
    keys = lines.select((F.col("l_linenumber") % 3 + 2017).cast("int").alias("year"), (F.col("l_suppkey") % 4 + 29).cast("int").alias("zone"), (F.col("l_partkey") % 7 + 1000).cast("int").alias("crop"), (F.col("l_suppkey") % 2).cast("int").alias("part"), (F.col("l_orderkey") % 10).cast("int").alias("position"))
    collections = keys.where("position < 8").distinct().withColumn("groupID", F.col("position") * 1000)
    names = ["A_p50", "N_p50", "R_p50"]
    return rounded(workflows.training_rows(values, names, collections), ["year", "zone", "crop", "part", "position", "groupID"], 4)


@query("""WITH c AS (SELECT o_custkey AS feature_index, """ + ", ".join(f"count(*) FILTER (o_orderkey % 9 = {k}) AS c{k}" for k in range(1, 8)) + """ FROM orders GROUP BY ALL)
SELECT c_custkey AS feature_index, c_nationkey AS crop_type, """ + ", ".join(f"c{k}" for k in range(1, 8)) + " FROM customer LEFT JOIN c ON feature_index = c_custkey WHERE c_acctbal / 1e10 > 1e-7 AND c_nationkey NOT IN (3, 4) AND " + "(" + " OR ".join(f"coalesce(c{k}, 0) > 0" for k in range(1, 8)) + ")")
def parcel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parcels = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("feature_index"), F.col("c_nationkey").alias("crop_type"), (F.col("c_acctbal") / 1e10).alias("area"))
    raster = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("feature_index"), (F.col("o_orderkey") % 9).alias("class"))
    return workflows.parcel_counts(parcels, raster, range(1, 8), without=(3, 4)).drop("area")


_VALID = """SELECT (c_custkey % 5)::INT AS target, CASE WHEN p_size * 3 < 100 THEN (p_size * 3 % 5)::INT END AS predicted FROM customer
LEFT JOIN part ON floor(c_custkey % 400 / 10.0) = p_partkey % 40 AND floor(c_nationkey / 10.0) = p_partkey // 40"""


def validated(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    size = F.col("scene") * 3
    raster = grid(spark, sf_dir).select((F.col("x") * 10 + 5).alias("x"), (F.col("y") * 10 + 5).alias("y"), F.when(size < 100, size % 5).otherwise(size).cast("int").alias("predicted"))
    points = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 400).alias("x"), F.col("c_nationkey").alias("y"), (F.col("c_custkey") % 5).cast("int").alias("target"))
    return workflows.map_validation(points, raster)


@query(f"SELECT target, predicted, count(*) AS n FROM ({_VALID}) WHERE predicted IS NOT NULL GROUP BY ALL")
def map_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion of a class raster at test points."""
    return validated(spark, sf_dir)["confusion"]


@query(f"SELECT count(*) FILTER (predicted IS NULL) AS missing, count(*) AS n FROM ({_VALID})")
def map_validation_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(spark, sf_dir)["missing"]


_CENTRES = "SELECT c_custkey, (c_custkey * 37 % 3600) / 10.0 - 180 AS lon, (c_custkey * 91 % 1600) / 10.0 - 80 AS lat, CASE WHEN c_nationkey % 6 = 5 THEN 50 ELSE c_nationkey % 6 END AS ct FROM customer WHERE c_nationkey % 6 <> 2"


@query(f"""WITH p AS ({_CENTRES}) SELECT c_custkey, ct::INT AS "CT", CASE WHEN c_custkey % 2 = 0 THEN 'parcel' ELSE 'point' END AS source,
CAST(CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32
  WHEN lat >= 72 AND lat <= 84 AND lon >= 0 AND lon < 42 THEN CASE WHEN lon < 9 THEN 31 WHEN lon < 21 THEN 33 WHEN lon < 33 THEN 35 ELSE 37 END
  ELSE floor((lon + 180) / 6) % 60 + 1 END AS INT) AS zonenumber FROM p""")
def reference_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels and points in one table with the zone of their place; codes remapped and left out."""
    rows = lonlat(spark, sf_dir).join(table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 6).cast("int").alias("CT")), "c_custkey")
    rows = rows.select("c_custkey", "CT", F.array(F.struct(F.col("lon").cast("double").alias("x"), F.col("lat").cast("double").alias("y"))).alias("ring"))
    found = workflows.reference_set(rows.where("c_custkey % 2 = 0"), rows.where("c_custkey % 2 = 1"), remap={5: 50}, without=[2])
    return found.select("c_custkey", "CT", "source", "zonenumber")


@query("""WITH f AS (SELECT p_partkey, 2017 + p_partkey % 3 AS year, 29 + p_size % 4 AS zone FROM part),
y AS (SELECT 2017 AS year UNION ALL SELECT 2018), p AS (SELECT 'a' AS provider UNION ALL SELECT 'b'), z AS (SELECT (29 + i)::INT AS zone FROM range(3) r(i))
SELECT p_partkey AS file, year::INT AS year, provider, zone::INT AS zone FROM y CROSS JOIN p CROSS JOIN z JOIN f USING (year, zone) WHERE NOT (provider = 'a' AND p_partkey % 5 = 0)""")
def extraction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractions that are not done, by year, provider, zone and file."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.format_string("sampleable_polygons_year%d_zone%d_id%d_p0.json", F.col("p_partkey") % 3 + 2017, F.col("p_size") % 4 + 29, F.col("p_partkey")).alias("path"))
    years = spark.createDataFrame([(2017,), (2018,)], "year int")
    providers, zones = spark.createDataFrame([("a",), ("b",)], "provider string"), spark.createDataFrame([(29,), (30,), (31,)], "zone int")
    done = parts.where("p_partkey % 5 = 0").select("path", F.lit("a").alias("provider"))
    plan = workflows.extraction_plan(parts.select("path"), done, years, providers, zones)
    return plan.select(text.sample_path_parts("path").crop.cast("long").alias("file"), "year", "provider", "zone")


@query("""SELECT o_orderkey, o_orderstatus = 'F' AS own FROM orders""")
def samples_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of one country and the others, by their reference ids."""
    country = F.when(F.col("o_orderstatus") == "F", "BE").otherwise("FR")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.format_string("2018_%s_LPIS_POLY_%d", country, F.col("o_orderkey")).alias("ref_id"))
    own, others = workflows.by_country(rows, "BE")
    return own.select("o_orderkey", F.lit(True).alias("own")).union(others.select("o_orderkey", F.lit(False)))


@query("""SELECT n_nationkey AS position, 100.0::DOUBLE * coalesce(round(v + 1e-9, 6), 0) AS cropland_perc FROM nation LEFT JOIN (SELECT c_nationkey, avg((c_mktsegment = 'BUILDING')::INT) AS v FROM customer GROUP BY ALL) ON c_nationkey = n_nationkey""")
def grid_cropland(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zonal means as percentages of a grid; zones without values have 0."""
    values = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("position")).agg(arith.rounded(F.avg((F.col("c_mktsegment") == "BUILDING").cast("double")), 6).alias("value"))
    return workflows.grid_means(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("position")), values)


@query("""WITH m AS (SELECT DISTINCT 't' || l_suppkey AS tile, 'S2_t' || l_suppkey || '_' || l_linenumber || '_done' AS product FROM lineitem WHERE l_suppkey % 3 <> 0)
SELECT tile, string_agg(product, ',' ORDER BY product) AS products, count(*)::INT AS n FROM m GROUP BY tile""")
def missing_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that the messages of unfinished tiles name."""
    tile = F.concat(F.lit("t"), F.col("l_suppkey").cast("string"))
    messages = table(spark, sf_dir, "lineitem").select(tile.alias("tile"), F.concat(F.lit("ERROR S2_"), tile, F.lit("_"), F.col("l_linenumber").cast("string"), F.lit("_done")).alias("message"))
    tiles = messages.select("tile").distinct()
    done = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("tile"))
    found = workflows.missing_products(messages, tiles, done)
    return found.select("tile", F.array_join("products", ",").alias("products"), "n")


@query("SELECT c_custkey AS tile, c_acctbal AS cropland_perc, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer WHERE c_acctbal > 100 AND c_custkey % 7 <> 0")
def production_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles still to produce with their place in the order."""
    tiles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tile"), F.col("c_acctbal").alias("cropland_perc"))
    found = workflows.production_tiles(tiles, tiles.where("tile % 7 = 0").select("tile"), 100.0)
    return sequences.ranked(found, "cropland_perc", ["tile"], "place").withColumn("place", F.col("place").cast("long"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.group_sizes(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


@query("SELECT s_suppkey, s_name || ' ' || printf('%.1f', round(s_acctbal + 1e-9, 1)) AS title FROM supplier")
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.title("s_name", arith.rounded_to_show("s_acctbal", 1)).alias("title"))


@query("SELECT l_orderkey, l_linenumber, coalesce(nullif(l_discount, 0), nullif(l_tax, 0), l_quantity) AS value FROM lineitem")
def first_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0.0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", arith.first_present(F.nullif("l_discount", zero), F.nullif("l_tax", zero), "l_quantity").alias("value"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 99, 'NOWHERE', 4")
def append_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.append_row(table(spark, sf_dir, "nation"), n_nationkey=99, n_name="NOWHERE", n_regionkey=4)


@query("SELECT vec_id, i::INT AS position, embedding[i + 1]::DOUBLE AS embedding FROM embeddings, range(64) r(i)")
def enumerated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequences.enumerated(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    return found.withColumn("embedding", F.col("embedding").cast("double"))


@query("SELECT user_id, event_id, 'product_' || event_id AS product FROM events WHERE event_type = 'error'")
def job_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error messages of job logs and the products that they name."""
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("info")
    logs = table(spark, sf_dir, "events").select("user_id", "event_id", level.alias("level"), F.concat(F.lit("ERROR product_"), F.col("event_id").cast("string")).alias("message"))
    return ledger.errors(logs).select("user_id", "event_id", text.product_of_message("message").alias("product"))


@query("""SELECT c_nationkey AS zone, count(*) AS n FROM customer, (SELECT 3.0 AS w, 2.0 AS s, 17.0 AS e, 55.0 AS n)
WHERE c_nationkey + 2 >= w AND c_nationkey - 2 <= e AND c_acctbal / 100 + 2 >= s AND c_acctbal / 100 - 2 <= n GROUP BY ALL""")
def boxes_in_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square buffers of points that meet an extent."""
    x, y = F.col("c_nationkey").cast("double"), F.col("c_acctbal") / 100
    box = geo.ring_box(geo.square(x, y, 2.0))
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("zone"), box.alias("b"))
    return tables.group_sizes(rows.where(geo.boxes_overlap(F.col("b.minx"), F.col("b.miny"), F.col("b.maxx"), F.col("b.maxy"), 3.0, 2.0, 17.0, 55.0)), "zone")


@query("SELECT c_nationkey AS zone, min(c_custkey) AS c_custkey FROM customer GROUP BY ALL")
def parcels_without_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One parcel of each group of overlapping boxes: all boxes of a zone overlap, those of two zones do not."""
    x = F.col("c_nationkey") * 10.0
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey", (F.col("c_custkey") % 9).alias("part")).agg(F.min("c_custkey").alias("c_custkey"))
    boxes = rows.select("c_custkey", F.col("c_nationkey").alias("zone"), (x + F.col("part") / 10).alias("minx"), F.lit(0.0).alias("miny"), (x + F.col("part") / 10 + 4).alias("maxx"), F.lit(4.0).alias("maxy"))
    return workflows.without_overlaps(boxes, "c_custkey", 8.0).select("zone", "c_custkey")


@query("SELECT p_brand AS zone, count(*) FILTER (p_size > 25) AS large, count(*) AS n FROM part GROUP BY ALL")
def zonal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raster = table(spark, sf_dir, "part").select(F.col("p_brand").alias("zone"), (F.col("p_size") > 25).cast("int").alias("class"))
    counts = spatial.one_hot_counts(raster, ["zone"], "class", [1]).withColumnRenamed("c1", "large")
    return counts.join(tables.group_sizes(raster, "zone"), "zone").select("zone", "large", "n")


@query("SELECT l_orderkey, l_linenumber, l_quantity AS red, round(l_extendedprice / 1000 - l_quantity + 1e-9, 4) AS gap FROM lineitem")
def bands_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A computed band beside one that stays; the others are dropped."""
    keys = ["l_orderkey", "l_linenumber"]
    return C.with_bands(lines(spark, sf_dir), {"gap": arith.rounded(F.col("nir") - F.col("red"))}, keep=[*keys, "red", "gap"])


@query("SELECT l_orderkey, l_linenumber, round((l_extendedprice / 1000 + l_quantity + coalesce(nullif(l_tax, 0) * 100, 0)) / (2 + (l_tax <> 0)::INT) + 1e-9, 4) AS mean FROM lineitem")
def bands_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over the bands that are not null."""
    rows = lines(spark, sf_dir).withColumn("green", F.nullif("green", F.lit(0.0)))
    return C.reduce_bands(rows, ["nir", "red", "green"], "mean", "mean", ["l_orderkey", "l_linenumber"]).withColumn("mean", arith.rounded("mean"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS label FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 200000")
def matching_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a predicate given as text, with their time as a label."""
    rows = tables.matching(table(spark, sf_dir, "orders"), "o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 200000")
    return rows.select("o_orderkey", text.time_label("o_orderdate").alias("label"))


@query("""WITH v AS (SELECT n_regionkey, list(n_nationkey * 1.5::DOUBLE ORDER BY n_nationkey) AS v FROM nation GROUP BY ALL),
r AS (SELECT c_custkey, n_regionkey, (c_custkey % 7)::INT AS position FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, v[position + 1] AS value FROM r JOIN v USING (n_regionkey)""")
def keyed_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of several lists by key and position."""
    nations = table(spark, sf_dir, "nation")
    values = nations.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.col("n_nationkey") * F.lit(1.5))).alias("v"))
    rows = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_regionkey", (F.col("c_custkey") % 7).cast("int").alias("position"))
    return tables.positional_join(rows, "position", values, "v", "value", ["n_regionkey"]).select("c_custkey", "value")


def squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square standing on a corner for each supplier."""
    k = F.col("s_suppkey")
    x, y = (k * 37 % 500).cast("double"), (k * 53 % 300).cast("double")
    corners = ((6.0, 0.0), (12.0, 6.0), (6.0, 12.0), (0.0, 6.0))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array(*[F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in corners]).alias("ring"))


_DIAMONDS = "SELECT s_suppkey AS id, (s_suppkey * 37 % 500)::DOUBLE + 6 AS x, (s_suppkey * 53 % 300)::DOUBLE + 6 AS y FROM supplier"


@query(f"""WITH RECURSIVE b AS ({_DIAMONDS}), e AS (SELECT a.id AS i, c.id AS j FROM b a JOIN b c ON abs(a.x - c.x) + abs(a.y - c.y) <= 12 AND a.id <> c.id),
r AS (SELECT id AS s, id AS t FROM b UNION SELECT r.s, e.j FROM r JOIN e ON e.i = r.t)
SELECT s AS s_suppkey, min(t) AS "group" FROM r GROUP BY s""")
def overlap_groups_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of polygons that share a point, whatever their boxes do."""
    return spatial.overlapping_rings(squares(spark, sf_dir), "s_suppkey", 24.0)


@query(f"SELECT id AS s_suppkey FROM ({_DIAMONDS}) WHERE greatest(100 - x, 0, x - 250) + greatest(50 - y, 0, y - 200) <= 6")
def masked_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that meet a mask polygon."""
    mask = spark.range(1).select(geo.box_ring(F.lit(100.0), F.lit(50.0), F.lit(250.0), F.lit(200.0)).alias("ring"))
    return readers.masked(squares(spark, sf_dir), mask, "s_suppkey", size=50.0).select("s_suppkey")


@query()
def ml_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracies of one-against-the-rest boosting over two learning rates."""
    names = [f"f{k}" for k in range(64)]
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("kind"), *[F.get("embedding", F.lit(k)).alias(f"f{k}") for k in range(64)])
    return learning.tuned_boosting(rows, learning.boosted(names, "kind", rounds=1, depth=2), rates=(0.1, 0.3), depths=(2,), folds=2)[1]


@query()
def ml_gbdt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracies over three folds of boosted trees of all features and classes, over a grid of rate, depth and L2."""
    names = [f"f{k}" for k in range(64)]
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.get("embedding", F.lit(k)).cast("double").alias(f"f{k}") for k in range(64)])
    grid = [boosting.Options(rounds=2, depth=d, rate=r, l2=l2) for r in (0.1, 0.3) for d in (2, 3) for l2 in (1.0, 5.0)]
    accuracy = boosting.fit(rows, names, "label", grid, folds=3, fold_col=F.pmod(F.xxhash64("vec_id"), F.lit(3)))[1]
    return spark.createDataFrame([(o.rate, o.depth, o.l2, a) for o, a in zip(grid, accuracy, strict=True)], "rate double, depth int, l2 double, accuracy double")
