"""A Spark session with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "voltledger", **settings: str) -> SparkSession:
    """UTC, ANSI SQL, adaptive plans that split skewed joins and merge small partitions."""
    builder = SparkSession.builder.appName(name)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
