"""A session with the settings that the engine expects; on a cluster, the caller's own session does as well."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "juriloom", **settings: str) -> SparkSession:
    """settings: names of settings and their values, which go before the defaults."""
    builder = SparkSession.builder.appName(name)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    for key, value in (defaults | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
