"""Session defaults: UTC, adaptive execution with skew handling; sizes are left to the cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(name: str = "verity", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    for k, v in {**settings, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()
