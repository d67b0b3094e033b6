"""Sessions with the settings the engine is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "quirelake", **conf: str) -> SparkSession:
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.filterPushdown": "true",
    }
    return SparkSession.builder.appName(app).config(map=base | conf).getOrCreate()
