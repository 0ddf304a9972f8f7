"""Batch-job ledger: append-only status events, current state and capacity.

An event is (job_id, seq, status, backend, ...).  The current state of a job is
its event of the largest seq; nothing is updated in place, so that a run can go on
from the written events after any failure.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamframe.functions.text import deep_get, with_unit

ACTIVE = ("created", "queued", "running")
TERMINAL = ("finished", "skipped", "start_failed", "error", "canceled")

EVENT_SCHEMA = "job_id string, seq long, at timestamp, status string, backend string, backend_job string, usage string"

_log = logging.getLogger(__name__)


def latest(events: DataFrame, key: str = "job_id", seq: str = "seq") -> DataFrame:
    """Each job's last event."""
    others = [c for c in events.columns if c not in (key, seq)]
    last = events.groupBy(key).agg(F.max(F.struct(seq, *others)).alias("_e"))
    return last.select(key, F.col(f"_e.{seq}").alias(seq), *[F.col(f"_e.{c}").alias(c) for c in others])


def histogram(state: DataFrame) -> DataFrame:
    return state.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def load(state: DataFrame) -> DataFrame:
    """Active jobs per backend."""
    return state.where(F.col("status").isin(*ACTIVE)).groupBy("backend").agg(F.count(F.lit(1)).alias("active"))


def open_jobs(state: DataFrame) -> DataFrame:
    return state.where(~F.col("status").isin(*TERMINAL))


def errors(logs: DataFrame, level_col: str = "level") -> DataFrame:
    """Log entries of the level error, in any case."""
    return logs.where(F.lower(level_col) == "error")


def assignments(waiting: DataFrame, backends: DataFrame, active: DataFrame, order_col: str = "job_id") -> DataFrame:
    """waiting jobs with the backend that has room for them.

    Free slots, in the order of `position`, are cumulative ranges; the n-th waiting
    job gets the backend whose range holds n.  Only as many jobs as there are slots
    are numbered, so the ordered part is bounded by the capacity.
    """
    free = F.greatest(F.col("capacity") - F.coalesce(F.col("active"), F.lit(0)), F.lit(0))
    slots = backends.join(active, "backend", "left").withColumn("_free", free)
    order = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    ranges = slots.withColumn("_to", F.sum("_free").over(order)).withColumn("_from", F.col("_to") - F.col("_free")).where("_free > 0")
    each = ranges.select("backend", F.explode(F.sequence(F.col("_from") + 1, F.col("_to"))).alias("_n"))
    capacity = backends.agg(F.sum("capacity")).first()[0] or 0
    first = waiting.orderBy(order_col).limit(int(capacity))
    numbered = first.withColumn("_n", F.row_number().over(Window.orderBy(order_col)))
    return numbered.join(each, "_n").drop("_n")


def usage_columns(events: DataFrame, usage_col: str = "usage") -> DataFrame:
    """events with cpu, memory and duration as `value unit` texts from a JSON of usage."""
    parts = {name: with_unit(deep_get(usage_col, name, "value"), deep_get(usage_col, name, "unit")) for name in ("cpu", "memory", "duration")}
    return events.withColumns({k: F.when(v != "", v) for k, v in parts.items()})


def with_retries(call: Callable[[], Any], wait_seconds: float = 5.0, times: int = 3) -> Any:
    """call(), again after a wait where the connection fails; None if it fails each time."""
    for _ in range(times):
        try:
            return call()
        except ConnectionError:
            _log.warning("connection failed", exc_info=True)
            time.sleep(wait_seconds)
    return None
