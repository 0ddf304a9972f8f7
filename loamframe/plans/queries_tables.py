"""Queries of sampling, legends, metrics, the job ledger, learning and table operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamframe.functions import arith, legends, text
from loamframe.operators import learning, ledger, metrics, sampling, sequences, tables
from loamframe.plans import workflows
from loamframe.plans.catalog import query, table
from loamframe.sources import readers, sinks



# --- sampling -----------------------------------------------------------------


@query("SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('|' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= 40")
def sample_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_per_class(table(spark, sf_dir, "orders"), ["o_orderpriority"], ["o_orderkey"], 40).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('s|' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= 100")
def sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample(table(spark, sf_dir, "orders"), 100, ["o_orderkey"], "s").select("o_orderkey")


_REPLICATED = """SELECT s_suppkey, replica::INT AS replica, s_nationkey FROM (
  SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY md5('|' || s_suppkey || '|' || replica), s_suppkey, replica) AS r FROM supplier, range(1, 4) x(replica)) WHERE r <= 10"""


@query(_REPLICATED)
def sample_replicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_replicated(table(spark, sf_dir, "supplier"), ["s_nationkey"], ["s_suppkey"], 10, 3).select("s_suppkey", "replica", "s_nationkey")


@query(f"""SELECT s_suppkey AS id, s_nationkey AS class, replica, 1 AS source FROM ({_REPLICATED})
UNION ALL SELECT c_custkey, c_nationkey, 1, 2 FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('|' || c_custkey), c_custkey) AS r FROM customer) WHERE r <= 6""")
def sample_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("class"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("class"))
    return sampling.two_sources(a, b, "class", ["id"], 10, 6, repeat_first=3).select("id", "class", "replica", "source")


@query("""WITH n AS (SELECT o_orderkey, o_orderpriority, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey)),
k AS (SELECT *, n // 150 + 1 AS k FROM n), q AS (SELECT *, n // k AS q, n % k AS r FROM k)
SELECT o_orderkey, o_orderpriority, CAST(CASE WHEN i < r * (q + 1) THEN i // (q + 1) ELSE r + (i - r * (q + 1)) // q END AS INT) AS chunk FROM q""")
def chunk_array_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.chunked(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], ["o_orderkey"], 150)


@query("SELECT o_orderkey, ('0x' || substr(md5('190|' || o_orderkey), 1, 8))::BIGINT / 4294967296.0 < 0.7 AS train FROM orders")
def split_train_test_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", sampling.train_part(["o_orderkey"], 0.7, "190").alias("train"))


@query("""WITH e AS (SELECT quantile_cont(c_acctbal, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM customer),
b AS (SELECT c_custkey, c_acctbal, CAST(len(list_filter(e, lambda x: x < c_acctbal)) AS INT) AS bin FROM customer, e),
m AS (SELECT bin, median(c_acctbal) AS m FROM b GROUP BY bin),
r AS (SELECT b.*, row_number() OVER (PARTITION BY b.bin ORDER BY abs(c_acctbal - m), c_custkey) AS r FROM b JOIN m USING (bin))
SELECT bin, c_custkey, c_acctbal FROM r WHERE r = 1""")
def decile_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.decile_medians(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")


@query()
def polygon_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded point in each of many triangles; tested against containment."""
    k = F.col("s_suppkey").cast("double")
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((k, F.lit(0.0)), (k + 4, F.lit(1.0)), (k + 1, F.lit(6.0)))])
    shapes = table(spark, sf_dir, "supplier").select("s_suppkey", ring.alias("ring"))
    return sampling.points_in_polygons(shapes, "s_suppkey", margin=0.05, centroid_share=0.5).select("s_suppkey", "px", "py")


# --- sets, lists and joins ------------------------------------------------------


@query("SELECT y.year::INT AS year, p.r_name AS provider, z.n_nationkey AS zone FROM range(2017, 2020) y(year), region p, nation z")
def cross_job_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = spark.range(2017, 2020).select(F.col("id").cast("int").alias("year"))
    providers = table(spark, sf_dir, "region").select(F.col("r_name").alias("provider"))
    return tables.cross_grid(years, providers, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("zone")))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def anti_done_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return tables.not_done(table(spark, sf_dir, "customer").select("c_custkey"), done, ["c_custkey"])


@query("SELECT c_nationkey AS zone FROM customer UNION SELECT s_nationkey FROM supplier")
def union_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.union_distinct(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("zone")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("zone")))


@query("SELECT c_custkey AS id, c_nationkey AS zone, c_acctbal AS area, NULL::VARCHAR AS label FROM customer UNION ALL SELECT s_suppkey, s_nationkey, NULL, s_name FROM supplier")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("zone"), F.col("c_acctbal").alias("area"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("zone"), F.col("s_name").alias("label"))
    return tables.union_all([a, b])


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    poor = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("n_nationkey"))
    return tables.difference(table(spark, sf_dir, "nation").select("n_nationkey"), poor, ["n_nationkey"])


@query("SELECT o_custkey, unnest(list_distinct(list(o_orderpriority))) AS file FROM orders GROUP BY o_custkey")
def explode_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("files"))
    return tables.exploded(lists, "files", "file")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 1110 WHEN 1 THEN 1510 WHEN 2 THEN 1200 ELSE 1910 END AS \"CT\" FROM customer")
def remap_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "customer").withColumn("CT", F.get(F.array(*map(F.lit, (1100, 1500, 1200, 1900))), (F.col("c_custkey") % 4).cast("int")))
    return raw.select("c_custkey", legends.remap("CT", legends.SURVEY_REMAP).alias("CT"))


@query("SELECT c_custkey, c_nationkey < 12 AS belgian FROM customer")
def filter_ref_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.concat(F.lit("2018_"), F.when(F.col("c_nationkey") < 12, "BE").otherwise("FR"), F.lit("_LPIS_POLY_110"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.is_country(ref, "BE").alias("belgian"))


@query("SELECT o_orderkey, (2017 + o_orderkey % 3)::INT AS year, (29 + o_orderkey % 14)::INT AS zone, o_custkey::INT AS crop, (o_orderkey % 5)::INT AS part FROM orders")
def regex_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    path = F.concat(F.lit("/data/"), text.sample_path(2017 + k % 3, 29 + k % 14, F.col("o_custkey"), k % 5))
    return table(spark, sf_dir, "orders").withColumn("p", text.sample_path_parts(path)).select("o_orderkey", "p.*")


@query("SELECT event_id, props->>'$.k' AS k, coalesce(props->>'$.a.b', 'none') AS missing FROM events")
def json_deep_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.deep_get("props", "k").alias("k"), text.deep_get("props", "a", "b", default="none").alias("missing"))


@query("SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)', 1) AS scheme, regexp_extract(url, '^(https?)://([^/]+)', 2) AS host, CASE WHEN contains(url, 'example.org') THEN substr(url, 7, 60) END AS slice FROM pages")
def url_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = r"^(https?)://([^/]+)"
    cut = F.when(F.contains("url", F.lit("example.org")), text.product_of_message("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", host, 1).alias("scheme"), F.regexp_extract("url", host, 2).alias("host"), cut.alias("slice"))


@query("SELECT n_nationkey, n_name, list_extract([10.5, 20.5, 30.5], CASE WHEN n_nationkey < 3 THEN n_nationkey + 1 END)::DOUBLE AS mean FROM nation")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = spark.range(1).select(F.array(F.lit(10.5), F.lit(20.5), F.lit(30.5)).alias("means"))
    return tables.positional_join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", values, "means", "mean")


@query("SELECT (row_number() OVER (PARTITION BY c_custkey // 50 ORDER BY c_custkey) - 1)::INT AS position, CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE c_acctbal END::DOUBLE AS value FROM customer")
def zonal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone values of JSON results of 50 zones each; a zone without bands has the default."""
    bands = F.when(F.col("c_custkey") % 3 == 0, F.array().cast("array<double>")).otherwise(F.array("c_acctbal", F.lit(7.0)))
    zones = table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 50)).agg(F.array_sort(F.collect_list(F.struct("c_custkey", bands.alias("b")))).alias("z"))
    results = zones.select(F.to_json(F.create_map(F.lit("2020-12-31T00:00:00Z"), F.col("z.b"))).alias("value"))
    return readers.zonal_lists(spark, results, "2020-12-31T00:00:00Z")


@query("SELECT s_suppkey, s_acctbal, s_nationkey::BIGINT AS zone, 'new'::VARCHAR AS status, NULL::DOUBLE AS cpu FROM supplier")
def defaults_and_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("long").alias("zone"))
    return tables.with_defaults(rows, {"zone": F.lit(0).cast("long"), "status": F.lit("new"), "cpu": F.lit(None).cast("double")})


@query("SELECT user_id, " + ", ".join(f"round(avg(CASE WHEN event_type = '{f}' THEN value END) + 1e-9, 4) AS {f}" for f in ("click", "view", "error")) + " FROM events GROUP BY user_id")
def features_to_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.features_to_rows(table(spark, sf_dir, "events"), ["user_id"], "event_type", "value", ["click", "view", "error"])
    return out.select("user_id", *[arith.rounded(c).alias(c) for c in ("click", "view", "error")])


@query("SELECT p_brand, count(p_name) AS p_name, count(p_size) AS p_size, count(CASE WHEN p_size < 40 THEN 1 END) AS small FROM part GROUP BY p_brand")
def non_null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_brand", "p_name", "p_size", F.when(F.col("p_size") < 40, 1).alias("small"))
    return tables.non_null_counts(rows, "p_brand")


# --- legends and strata ---------------------------------------------------------




@query("""SELECT s_suppkey, code, substr(code, 1, 2) || '0' AS rolled, CAST(CASE substr(code, 1, 1) WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE 2 END AS INT) AS target
FROM (SELECT s_suppkey, list_extract(['A10', 'B11', 'B19', 'C10', 'E20', 'F40', 'G11'], s_suppkey % 7 + 1) AS code FROM supplier)""")
def legend_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.get(F.array(*map(F.lit, ("A10", "B11", "B19", "C10", "E20", "F40", "G11"))), (F.col("s_suppkey") % 7).cast("int"))
    classes = {"built": [c for c in legends.LAND_COVER if c[0] == "A"], "crops": [c for c in legends.LAND_COVER if c[0] == "B"], "other": [c for c in legends.LAND_COVER if c[0] > "B"]}
    numbers = legends.class_numbers(classes)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", code.alias("code")).withColumn("rolled", legends.roll_up("code"))
    return rows.withColumn("target", legends.lookup_or_fail("rolled", numbers))


_CODES = sorted(legends.LAND_COVER)


@query(f"SELECT substr(code, 1, 1) AS letter, count(*) AS n FROM (SELECT list_extract({_CODES}, p_partkey % {len(_CODES)} + 1) AS code FROM part) GROUP BY 1")
def legend_partition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes: dict[str, list[str]] = {}
    for code, name in legends.LAND_COVER.items():
        classes.setdefault(code[0], []).append(f"{code} {name}")
    numbers = legends.class_numbers(classes)
    letters = F.array(*[F.lit(letter) for letter in classes])
    rows = table(spark, sf_dir, "part").select(F.get(F.array(*map(F.lit, _CODES)), (F.col("p_partkey") % len(_CODES)).cast("int")).alias("code"))
    return rows.groupBy(F.get(letters, legends.lookup_or_fail("code", numbers)).alias("letter")).agg(F.count(F.lit(1)).alias("n"))


_CT = "list_extract([1110, 1120, 1200, 4351, 5100, 8100, 9100, 2210, 3300], {0} % 9 + 1)"


def crop_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*map(F.lit, (1110, 1120, 1200, 4351, 5100, 8100, 9100, 2210, 3300)))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.get(codes, (F.col("o_custkey") % 9).cast("int")).alias("CT"))


@query(f"SELECT DISTINCT {_CT.format('o_custkey')}::INT AS code, {_CT.format('o_custkey')} IN (1110, 1200, 5100) AS relevant FROM orders")
def crop_code_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legends.split_codes(crop_rows(spark, sf_dir), ["Winter wheat", "Maize", "Potatoes"])


@query(f"""SELECT CASE {_CT.format('o_custkey')} WHEN 1110 THEN 'Winter wheat' WHEN 1120 THEN 'Spring wheat' WHEN 1200 THEN 'Maize' WHEN 4351 THEN 'Winter rapeseed' WHEN 5100 THEN 'Potatoes'
  WHEN 8100 THEN 'Sugar beet' WHEN 9100 THEN 'Grasses and other fodder crops' WHEN 2210 THEN 'Cucumbers' ELSE 'Grapes' END AS crop,
  count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P", count(*) AS "TOTAL" FROM orders GROUP BY ALL""")
def crop_counts_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = crop_rows(spark, sf_dir).withColumn("crop", legends.lookup_or_fail("CT", legends.CROPS))
    return tables.count_matrix(named, "crop", "o_orderstatus", ["F", "O", "P"])


@query(f"""WITH c AS (SELECT o_orderkey, {_CT.format('o_custkey')} AS c FROM orders)
SELECT o_orderkey, CASE c WHEN 1110 THEN 'Winter wheat' WHEN 1120 THEN 'Spring wheat' WHEN 1200 THEN 'Maize' WHEN 4351 THEN 'Winter rapeseed' WHEN 5100 THEN 'Potatoes' WHEN 8100 THEN 'Sugar beet' ELSE 'Other' END AS apart,
  CASE c WHEN 1110 THEN 'Winter cereals' WHEN 1120 THEN 'Spring cereals' WHEN 1200 THEN 'Maize' WHEN 4351 THEN 'Winter rapeseed' WHEN 5100 THEN 'Potatoes' WHEN 8100 THEN 'Sugar beet'
    WHEN 9100 THEN 'Grasses and other fodder crops' ELSE 'Other' END AS joint FROM c""")
def training_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crop_rows(spark, sf_dir).select("o_orderkey", legends.training_class("CT").alias("apart"), legends.training_class("CT", joint_cereals=True, grass=True).alias("joint"))


@query("SELECT DISTINCT n_regionkey AS stratum FROM nation")
def strata_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("stratum"))
    sampled, _ = workflows.checked_strata(nations, table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("stratum")))
    return sampled.distinct()


# --- metrics --------------------------------------------------------------------


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of a line by its flag, and a guess by its number."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_quantity") % 4).cast("int").alias("target"), F.when(F.col("l_linenumber") < 7, F.col("l_linenumber") % 5).alias("predicted"))


_PAIRS = "SELECT CAST(l_quantity % 4 AS INT) AS target, CASE WHEN l_linenumber < 7 THEN l_linenumber % 5 END AS predicted FROM lineitem"


@query(f"SELECT count(*) AS n, round(avg((target = predicted)::INT) + 1e-9, 4) AS accuracy FROM ({_PAIRS}) WHERE predicted IS NOT NULL")
def metrics_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy(pairs(spark, sf_dir)).withColumn("accuracy", arith.rounded("accuracy"))


@query(f"""WITH p AS ({_PAIRS}), f AS (SELECT * FROM p WHERE predicted IS NOT NULL), l AS (SELECT target AS label FROM f UNION SELECT predicted FROM f),
s AS (SELECT label, count(*) FILTER (target = label AND predicted = label) AS tp, count(*) FILTER (predicted = label) AS p, count(*) FILTER (target = label) AS support FROM l, f GROUP BY label),
m AS (SELECT label, coalesce(tp / nullif(p, 0), 0)::DOUBLE AS pr, coalesce(tp / nullif(support, 0), 0)::DOUBLE AS re, support FROM s)
SELECT label, round(pr + 1e-9, 4) AS precision, round(re + 1e-9, 4) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0) + 1e-9, 4) AS fscore, support FROM m""")
def metrics_prf_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.precision_recall(pairs(spark, sf_dir))
    return out.select("label", *[arith.rounded(c).alias(c) for c in ("precision", "recall", "fscore")], "support")


@query(f"SELECT target, " + ", ".join(f"count(*) FILTER (predicted = {k}) AS p{k}" for k in range(5)) + f" FROM ({_PAIRS}) WHERE predicted IS NOT NULL GROUP BY target")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_matrix(pairs(spark, sf_dir), range(5))


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = [F.count_if(F.startswith("o_orderpriority", F.lit(str(k)))).alias(f"c{k}") for k in (1, 2, 3)]
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(*cells).withColumn("own", F.col("o_custkey") % 3 + 1)


_PARCELS = "SELECT o_custkey % 3 + 1 AS own, " + ", ".join(f"count(*) FILTER (o_orderpriority LIKE '{k}%') AS c{k}" for k in (1, 2, 3)) + " FROM orders GROUP BY o_custkey"


@query(f"""WITH p AS ({_PARCELS}) SELECT k::INT AS class, count(*) FILTER (own = k) AS n, count(*) FILTER (own = k AND c = 0) AS missed, count(*) FILTER (own <> k AND c > 0) AS falsely_found
FROM (SELECT own, 1 AS k, c1 AS c FROM p UNION ALL SELECT own, 2, c2 FROM p UNION ALL SELECT own, 3, c3 FROM p) GROUP BY k""")
def detection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.detections(parcels(spark, sf_dir), "own", {1: "c1", 2: "c2", 3: "c3"})


@query(f"SELECT own, c1, c2, c3 FROM ({_PARCELS}) WHERE c1 > 0 OR c2 > 0 OR c3 > 0")
def any_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.anything_detected(parcels(spark, sf_dir), ["c1", "c2", "c3"]).select("own", "c1", "c2", "c3")


@query(f"SELECT count(*) FILTER (target IS NULL) AS target, count(*) FILTER (predicted IS NULL) AS predicted FROM ({_PAIRS})")
def unmatched_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.missing_counts(pairs(spark, sf_dir))


# --- job ledger -----------------------------------------------------------------


_STATUS = "CASE event_type WHEN 'click' THEN 'created' WHEN 'view' THEN 'queued' WHEN 'purchase' THEN 'running' WHEN 'signup' THEN 'not_started' ELSE 'finished' END"
_STATE = f"""SELECT job_id, seq, status, backend FROM (SELECT user_id AS job_id, event_id AS seq, {_STATUS} AS status, 'b' || user_id % 3 AS backend,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = legends.lookup("event_type", {"click": "created", "view": "queued", "purchase": "running", "signup": "not_started"}, F.lit("finished"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), status.alias("status"), F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string")).alias("backend"))


@query(_STATE)
def job_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest(job_events(spark, sf_dir))


@query(f"SELECT status, count(*) AS n FROM ({_STATE}) GROUP BY status")
def job_status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.histogram(ledger.latest(job_events(spark, sf_dir)))


@query(f"SELECT backend, count(*) AS active FROM ({_STATE}) WHERE status IN ('created', 'queued', 'running') GROUP BY backend")
def job_backend_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.load(ledger.latest(job_events(spark, sf_dir)))


@query(f"SELECT job_id, status FROM ({_STATE}) WHERE status NOT IN ('finished', 'skipped', 'start_failed', 'error', 'canceled')")
def job_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.open_jobs(ledger.latest(job_events(spark, sf_dir))).select("job_id", "status")


@query(f"""WITH s AS ({_STATE}), a AS (SELECT backend, count(*) AS active FROM s WHERE status IN ('created', 'queued', 'running') GROUP BY backend),
b AS (SELECT 'b' || i AS backend, i AS position, 40 AS capacity FROM range(3) r(i)), f AS (SELECT backend, position, greatest(capacity - coalesce(active, 0), 0) AS free FROM b LEFT JOIN a USING (backend)),
c AS (SELECT backend, sum(free) OVER (ORDER BY position) AS hi, sum(free) OVER (ORDER BY position) - free AS lo FROM f),
w AS (SELECT job_id, row_number() OVER (ORDER BY job_id) AS n FROM s WHERE status = 'not_started')
SELECT w.job_id, c.backend FROM w JOIN c ON n > lo AND n <= hi""")
def job_capacity_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = ledger.latest(job_events(spark, sf_dir))
    backends = spark.range(3).select(F.concat(F.lit("b"), F.col("id").cast("string")).alias("backend"), F.col("id").alias("position"), F.lit(40).alias("capacity"))
    return ledger.assignments(state.where("status = 'not_started'").select("job_id"), backends, ledger.load(state))


@query("SELECT event_id, (props->>'$.k') || ' cpu-seconds' AS cpu, NULL::VARCHAR AS memory, NULL::VARCHAR AS duration FROM events")
def job_usage_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = F.concat(F.lit('{"cpu": {"value": '), F.get_json_object("props", "$.k"), F.lit(', "unit": "cpu-seconds"}}'))
    return ledger.usage_columns(table(spark, sf_dir, "events").select("event_id", usage.alias("usage"))).drop("usage")


# --- learning -------------------------------------------------------------------


FEATURES = [f"f{k}" for k in range(64)]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.get("embedding", F.lit(k)).alias(f"f{k}") for k in range(64)])
    return rows.withColumn("train", sampling.train_part(["vec_id"], 0.7))


@query()
def ml_train_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a forest on the rows it was not trained on."""
    rows = vectors(spark, sf_dir)
    model = learning.forest(FEATURES, "label_text", trees=20, depth=5).fit(rows.where("train").withColumn("label_text", F.col("label").cast("string")).drop("label"))
    test = rows.where("NOT train").withColumn("label_text", F.col("label").cast("string")).drop("label")
    return metrics.precision_recall(learning.predicted(model, test), "label_text", "predicted")


@query()
def ml_feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = learning.training_table(vectors(spark, sf_dir), FEATURES, "label").withColumn("label_text", F.col("label").cast("string")).drop("label")
    return learning.importances(learning.forest(FEATURES, "label_text", trees=20, depth=5).fit(rows), spark)


@query()
def ml_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).withColumn("label_text", F.col("label").cast("string")).drop("label", "train")
    return learning.tuned(rows, learning.forest(FEATURES, "label_text"), trees=(5, 10), depths=(3,), folds=3)[1]


# --- sinks ----------------------------------------------------------------------


@query("""SELECT 2018::INT AS year, (29 + s_nationkey % 3)::INT AS zone, 1110 AS crop, count(*) AS features, min(s_suppkey::VARCHAR) AS first_id FROM supplier GROUP BY ALL""")
def feature_collection_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections parsed back from their JSON."""
    k = F.col("s_suppkey").cast("double")
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((k, F.lit(0.0)), (k + 1, F.lit(0.0)), (k, F.lit(1.0)))])
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("feature_id"), ring.alias("ring"), F.lit(2018).alias("year"), (F.col("s_nationkey") % 3 + 29).alias("zone"), F.lit(1110).alias("crop"), F.lit(0).alias("chunk"), "s_name"
    )
    found = sinks.feature_collections(rows, ["s_name"]).withColumn("p", text.sample_path_parts("name")).withColumn("c", F.from_json("json", "features array<struct<id:string>>"))
    return found.select("p.year", "p.zone", "p.crop", F.size("c.features").cast("long").alias("features"), F.get("c.features.id", F.lit(0)).alias("first_id"))


@query("SELECT l_shipdate AS t, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l_shipdate) AS rank FROM lineitem GROUP BY l_shipdate")
def ranked_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return sequences.ranked(counts, "n", ["t"]).withColumn("rank", F.col("rank").cast("long"))
