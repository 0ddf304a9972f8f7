"""Launching jobs from their events: a stream with one row of state per job.

Events (job_id, seq, status, backend, ...) are files that anyone may add: who registers jobs, who polls the services, and the
launches themselves.  A job's state is its event of the largest seq, so events may come late, repeatedly and in any order.  Each
batch writes the states that it changed; the waiting jobs then meet the free slots of the backends as tables, and
only the launches of the batch, never more than there are slots, come to the driver, which calls `launch` for each.

A launch is written down before it is made and counts as active until the job's own events say more.  A batch that is run
again after a failure launches the jobs that it had written down and no others, so `launch` must bear a second call for a job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamframe.operators import ledger
from loamframe.storage import delete

#: So many batches are merged into one table of states.
MERGE_EVERY = 50
STATE = "job_id string, seq long, status string, backend string"


def changed_states(events: DataFrame) -> DataFrame:
    """Per job its event of the largest seq, as events arrive."""
    last = events.groupBy("job_id").agg(F.max(F.struct("seq", "status", "backend")).alias("e"))
    return last.select("job_id", "e.seq", "e.status", "e.backend")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def states(spark: SparkSession, path: str) -> DataFrame:
    """The state of every job that the stream has seen."""
    return ledger.latest(_read(spark, f"{path}/states", STATE))


def _launches(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, f"{path}/launches", "job_id string, backend string")


def load(spark: SparkSession, path: str) -> DataFrame:
    """Active jobs per backend, with launches whose events are still to come."""
    now = states(spark, path)
    unseen = _launches(spark, path).join(now.where("status <> 'not_started'").select("job_id"), "job_id", "left_anti")
    busy = now.where(F.col("status").isin(*ledger.ACTIVE)).select("job_id", "backend").unionByName(unseen.select("job_id", "backend"))
    return busy.groupBy("backend").agg(F.count(F.lit(1)).alias("active"))


def chosen(spark: SparkSession, path: str, backends: DataFrame) -> DataFrame:
    """Waiting jobs, in the order of their ids, with the backends that have room; backends: backend, position, capacity."""
    waiting = states(spark, path).where("status = 'not_started'").select("job_id").join(_launches(spark, path), "job_id", "left_anti")
    return ledger.assignments(waiting, backends, load(spark, path)).select("job_id", "backend")


def dispatch(spark: SparkSession, events: str, path: str, backends: DataFrame, launch: Callable[[str, str], None], until_done: bool = True, every: str = "60 seconds", files: int | None = None):
    """A running query that launches jobs as the events of a folder arrive; with until_done it ends after the files that are there."""

    def work(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/states/batch-{number}")
        if number and number % MERGE_EVERY == 0:
            _merge(spark, path, number)
        place = f"{path}/launches/batch-{number}"
        if not _exists(spark, f"{place}/_SUCCESS"):
            chosen(spark, path, backends).coalesce(1).write.mode("overwrite").parquet(place)
        for job in spark.read.schema("job_id string, backend string").parquet(place).collect():
            launch(job.job_id, job.backend)

    stream = spark.readStream.schema(ledger.EVENT_SCHEMA)
    stream = (stream.option("maxFilesPerTrigger", files) if files else stream).parquet(events)
    writer = changed_states(stream).writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").foreachBatch(work)
    return (writer.trigger(availableNow=True) if until_done else writer.trigger(processingTime=every)).start()


def _merge(spark: SparkSession, path: str, number: int) -> None:
    """One table of all states in place of the batches' tables; until these are gone, both say the same."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/states")
    old = [f.getPath().toString() for f in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]
    merged = f"{path}/states/merged-{number}"
    if merged.split("/")[-1] not in {o.split("/")[-1] for o in old}:
        states(spark, path).write.parquet(merged)
    for folder in old:
        if folder.split("/")[-1] not in (f"batch-{number}", f"merged-{number}"):
            delete(spark, folder)
