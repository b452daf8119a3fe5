"""SparkSession settings the dialect relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",  # overflow and division by zero raise
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def create(master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS and ``more``; ``master`` as given to Spark, or the cluster's own."""
    builder = SparkSession.builder.appName("querl").config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()
