"""Structured Streaming counterparts: window means, sessions and the job ledger's state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamframe.plans.specs import Intervals


def timed(stream: DataFrame, t_col: str) -> DataFrame:
    """stream with its event time as a timestamp, which watermarks need."""
    return stream.withColumn(t_col, F.col(t_col).cast("timestamp"))


def interval_means(stream: DataFrame, spec: Intervals, start: str, keys: list[str], value_col: str = "value", t_col: str = "ts", late: str = "2 days") -> DataFrame:
    """Mean per key over the sliding windows of spec; windows outside the season's rule are dropped."""
    offset = (pd.Timestamp(start) - pd.Timestamp("1970-01-01")).days % spec.step
    windowed = timed(stream, t_col).withWatermark(t_col, late).groupBy(*keys, F.window(t_col, f"{spec.width} days", f"{spec.step} days", f"{offset} days").alias("w"))
    k = (F.datediff(F.col("w.start").cast("date"), F.lit(start).cast("date")) / spec.step).cast("int")
    found = windowed.agg(F.avg(value_col).alias("mean")).select(*keys, k.alias("k"), "mean")
    return found.where(F.col("k").between(0, spec.count - 1))


def sessions(stream: DataFrame, keys: list[str], gap: str = "6 hours", t_col: str = "ts", late: str = "1 day") -> DataFrame:
    """Events of a key that follow each other within the gap: start, end and number."""
    s = F.session_window(t_col, gap).alias("s")
    return timed(stream, t_col).withWatermark(t_col, late).groupBy(*keys, s).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def job_states(events: DataFrame, key: str = "job_id") -> DataFrame:
    """Each job's latest status as its events (job_id, seq, status) arrive, in any order and repeatedly; the state is one row per job."""
    return events.groupBy(key).agg(F.max(F.struct("seq", "status")).alias("_e")).select(key, "_e.seq", "_e.status")
