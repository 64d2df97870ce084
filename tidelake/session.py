"""Spark sessions as the engine wants them."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tidelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; all else is left to the cluster, or given by name
    with ``__`` for dots."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
