"""Running a stream over what is there: all files of a folder, then stop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamframe.storage import fresh_path


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream of the files of a Parquet table, which is a folder or one file, with the table's schema."""
    path = f"{folder}/{name}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def completed(result: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """The rows of an aggregating stream after all available files, merged by key from tables in the shared folder.

    Each batch writes the rows that it changed to a folder of its own; of each key the last one counts.  So state
    behind the watermark is dropped, and no batch writes what it did not change.
    """
    spark = result.sparkSession
    path = fresh_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/changes/number={number}")

    query = result.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    others = [c for c in result.columns if c not in keys]
    changes = spark.read.parquet(f"{path}/changes")
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("_last"))
    return last.select(*[c if c in keys else F.col(f"_last.{c}").alias(c) for c in result.columns])
