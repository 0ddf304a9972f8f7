import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from loamframe.functions import geo, text
from loamframe.operators import learning, metrics
from loamframe.plans import workflows
from loamframe.sources import readers, sinks
from loamframe.streaming import runs, streams
from loamframe.plans.specs import Intervals


def collection(features):
    return {"type": "FeatureCollection", "ids": "1110", "year": "2019", "title": "1110", "name": "1110", "features": features}


def polygon(k, zone):
    ring = [[k, 0.0], [k + 1.0, 0.0], [k, 1.0], [k, 0.0]]
    return {"id": str(k), "type": "Feature", "properties": {"groupID": 46000.0, "zoneID": 1.0, "ref_id": "2018_FR_LPIS_POLY_110", "zone_num": zone}, "geometry": {"type": "Polygon", "coordinates": [ring]}}


def test_features_of_many_files(spark, tmp_path):
    for k, zone in enumerate((32, "31")):
        (tmp_path / f"sampleable_polygons_year2019_zone{zone}_id1110_p{k}.json").write_text(json.dumps(collection([polygon(float(k), zone), polygon(k + 5.0, zone)])))
    df = readers.read_features(spark, str(tmp_path / "*.json"))
    rows = df.withColumn("p", text.sample_path_parts("path")).withColumn("a", geo.area("ring")).orderBy("p.part", "position").collect()
    assert [(r.p.part, r.position, r.zone_num, r.feature_id, r.a) for r in rows] == [(0, 0, 32, "0.0", 0.5), (0, 1, 32, "5.0", 0.5), (1, 0, 31, "1.0", 0.5), (1, 1, 31, "6.0", 0.5)]
    area = spark.createDataFrame([([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)],)], "ring array<struct<x:double,y:double>>")
    assert {r.feature_id for r in readers.masked(df, area, "feature_id").collect()} == {"0.0", "1.0"}
    assert readers.features_from_dict(spark, collection([polygon(2.0, 3)])).first().properties["zone_num"] == "3"


def test_feature_collections_round_trip(spark, tmp_path):
    rows = [(str(k), 2019, 31, 1110, k % 2, 46000.0 + k, [(float(k), 0.0), (k + 1.0, 0.0), (float(k), 1.0)]) for k in range(5)]
    df = spark.createDataFrame(rows, "feature_id string, year int, zone int, crop int, chunk int, groupID double, ring array<struct<x:double,y:double>>")
    sinks.write_feature_collections(df, str(tmp_path / "fc"), ["groupID"])
    back = readers.read_features(spark, str(tmp_path / "fc" / "*" / "*" / "*" / "*" / "*.txt"))
    assert sorted((r.feature_id, r.groupID, len(r.ring)) for r in back.collect()) == [(str(k), 46000.0 + k, 4) for k in range(5)]
    name = {r.name for r in sinks.feature_collections(df, ["groupID"]).collect()}
    assert name == {f"sampleable_polygons_year2019_zone31_id1110_p{p}.json" for p in (0, 1)}


def test_tables_rasters_and_json(spark, tmp_path):
    df = spark.range(8).select((F.col("id") % 4).alias("x"), F.floor(F.col("id") / 4).alias("y"), (F.col("id") * 9).cast("int").alias("v"), F.lit("t1").alias("tile"))
    sinks.write_table(df, str(tmp_path / "csv"))
    assert readers.read_table(spark, str(tmp_path / "csv"), "x long, y long, v int, tile string").agg(F.sum("v")).first()[0] == 252
    sinks.write_raster(df, str(tmp_path / "map"), "v", levels=1)
    assert spark.read.parquet(str(tmp_path / "map" / "level=0")).agg(F.max("v")).first()[0] == 20
    assert spark.read.parquet(str(tmp_path / "map" / "level=1")).count() == 2
    sinks.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 8
    sinks.write_samples(df.withColumnRenamed("x", "feature_index"), str(tmp_path / "samples"))
    assert spark.read.parquet(str(tmp_path / "samples")).where("feature_index = 1").count() == 2


def test_scan_pushes_filters_and_prunes_columns(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("x"), F.lit(0).alias("y"), F.lit("2019-05-01").cast("timestamp").alias("t"), F.lit(1.0).alias("B04"), F.lit(2.0).alias("B08"), F.lit(50.0).alias("cloud_cover"), F.lit("A").alias("orbit")).write.parquet(str(tmp_path / "c"))
    df = readers.load_collection(spark, str(tmp_path / "c"), "2019-01-01", "2020-01-01", ["B04"], cloud_cover=80.0, equal={"orbit": "A"})
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(t" in plan and "LessThanOrEqual(cloud_cover" in plan and "B08" not in plan and df.count() == 100


def test_catalogue(spark):
    rows = [("31UFS", "2019-01-02", 10.0, False, 2.0, 50.0, 3.0, 51.0), ("31UFS", "2019-02-02", 90.0, False, 2.0, 50.0, 3.0, 51.0), ("32UFS", "2019-01-03", 5.0, True, 8.0, 50.0, 9.0, 51.0)]
    cat = spark.createDataFrame(rows, "tile string, t string, cloud_cover double, online boolean, minx double, miny double, maxx double, maxy double").withColumn("t", F.to_timestamp("t"))
    assert readers.product_count(cat, "2019-01-01", "2019-03-01", 2.5, 50.5, 4.0, 52.0).first().n == 2
    assert [r.tile for r in readers.query_catalogue(cat, "2019-01-01", "2020-01-01", ["31UFS", "32UFS"], 60.0, online=False).collect()] == ["31UFS"]
    grid = spark.createDataFrame([(0, "a"), (1, "b")], "position int, tile string")
    values = spark.createDataFrame([(0, 0.25)], "position int, value double")
    assert [(r.tile, r.cropland_perc) for r in workflows.grid_means(grid, values).orderBy("tile").collect()] == [("a", 25.0), ("b", 0.0)]


@pytest.fixture(scope="module")
def stream_dir(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "events")
    spark.read.parquet(f"{sf}/events.parquet").coalesce(2).write.parquet(path)
    return path


def run(spark, df, name, mode):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.table(name)


def test_streamed_means_equal_batch(spark, stream_dir):
    spec = Intervals(30, 2, 1, "mean")
    schema = spark.read.parquet(stream_dir).schema
    events = spark.readStream.schema(schema).parquet(stream_dir)
    found = run(spark, streams.interval_means(events, spec, "2024-01-01", ["event_type"], late="40 days"), "means", "complete")
    from loamframe.operators import temporal

    batch = temporal.aggregate_temporal(spark.read.parquet(stream_dir), "2024-01-01", spec, ["event_type"], ["value"], t_col="ts")
    a = {(r.event_type, r.k): round(r.mean, 9) for r in found.collect()}
    assert a == {(r.event_type, r.k): round(r.value, 9) for r in batch.collect()} and len(a) > 10


def test_a_folder_streams_like_a_file(spark, sf, stream_dir):
    folder, name = stream_dir.rsplit("/", 1)
    counts = []
    for where, table in ((folder, name), (sf, "events.parquet")):
        events = runs.table_stream(spark, where, table)
        counts.append(runs.completed(events.groupBy("event_type").count(), "test-stream", ["event_type"]).agg(F.sum("count")).first()[0])
    assert counts[0] == counts[1] == spark.read.parquet(stream_dir).count()


def test_streamed_sessions(spark, stream_dir):
    schema = spark.read.parquet(stream_dir).schema
    events = spark.readStream.schema(schema).parquet(stream_dir)
    found = run(spark, streams.sessions(events, ["user_id"], "3 hours", late="40 days"), "sessions", "complete")
    assert found.agg(F.sum("n")).first()[0] == spark.read.parquet(stream_dir).count()


def test_streamed_job_states(spark, tmp_path):
    rows = [("a", 0, "not_started"), ("a", 2, "running"), ("a", 1, "queued"), ("b", 5, "finished"), ("b", 3, "queued")]
    spark.createDataFrame(rows, "job_id string, seq long, status string").repartition(3).write.parquet(str(tmp_path / "e"))
    events = spark.readStream.schema("job_id string, seq long, status string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    found = run(spark, streams.job_states(events), "jobs", "update")
    last = {r.job_id: r.status for r in found.groupBy("job_id").agg(F.max_by("status", "seq").alias("status")).collect()}
    assert last == {"a": "running", "b": "finished"}


def test_model_round_trip(spark, tmp_path):
    rows = [(float(k % 2) + 0.1 * (k % 5), float(k % 3), str(k % 3), "wheat" if k % 2 else "maize") for k in range(200)] + [(65535.0, 1.0, "0", "maize")]
    df = spark.createDataFrame(rows, "B06_p25 double, B06_sd double, zoneID string, crop string")
    table = learning.training_table(df, ["B06_p25", "B06_sd"], "crop", ["zoneID"])
    assert table.count() == 200
    model = learning.forest(["B06_p25", "B06_sd"], "crop", ["zoneID"], trees=10, depth=3).fit(table)
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    out = learning.predicted(model, table)
    assert seen.get == {"n": 3} and metrics.accuracy(out, "crop", "predicted").first().accuracy > 0.95
    ranked = learning.importances(model, spark).orderBy("rank").collect()
    assert ranked[0].feature == "B06_p25" and all(r.importance != 0 for r in ranked)
    learning.save(model, str(tmp_path / "m"), ["B06_p25", "B06_sd"], "forest")
    again, described = learning.load(spark, str(tmp_path / "m"), table.columns)
    assert described["classes"] == list(model.stages[0].labels)
    assert learning.predicted(again, table).exceptAll(out).count() == 0
    with pytest.raises(ValueError, match="B06_sd"):
        learning.load(spark, str(tmp_path / "m"), ["B06_p25"])
    cube = spark.range(20).select(F.col("id").alias("x"), F.lit(0).alias("y"), (F.col("id") % 2).cast("double").alias("B06_p25"), F.lit(1.0).alias("B06_sd"), F.lit("0").alias("zoneID"))
    workflows.produce_map(cube, lambda c: learning.predicted(model, c.withColumn("crop", F.lit("maize"))).withColumn("predicted", (F.col("predicted") == "wheat").cast("int")), (0, 0, 9, 9), str(tmp_path / "map"), tile_size=5)
    got = spark.read.parquet(str(tmp_path / "map" / "level=0"))
    assert got.count() == 10 and got.select("tile").distinct().count() == 2 and got.where("predicted = x % 2").count() == 10
