"""Session factory: UTC, ANSI mode and adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "loamframe", master: str | None = None, **conf: str) -> SparkSession:
    """The active session or a new one; conf keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true",
    }
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
