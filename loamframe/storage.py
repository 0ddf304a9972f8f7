"""Where operators keep intermediate tables: the folder that the cluster shares.

`spark.checkpoint.dir` is read from the session.  Only where it is unset, as in
tests on one machine, a folder of our own takes its place.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a temporary one of our own on a single machine without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="loamframe-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of df with a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager)


def read_back(df: DataFrame, path: str) -> DataFrame:
    """Write df to path and read it again; columns can be pruned, filters pushed, and the size is known to the optimizer."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder; it stays for whoever reads the result."""
    return read_back(df, fresh_path(df.sparkSession, name))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours with the file system that it lies in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables and broadcasts of one job, given back when the block ends.

    Everything that reads them must have run by then: results that outlive the
    block are `written` inside it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []
        self.broadcasts: list[Broadcast] = []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table in the shared folder until the block ends."""
        self.paths.append(fresh_path(self.spark, name))
        return read_back(df, self.paths[-1])

    def broadcast(self, value) -> Broadcast:
        self.broadcasts.append(self.spark.sparkContext.broadcast(value))
        return self.broadcasts[-1]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        for shared in self.broadcasts:
            shared.destroy()
        for path in self.paths:
            delete(self.spark, path)
