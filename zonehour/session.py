"""The session that the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "zonehour", **conf: str) -> SparkSession:
    """UTC, ANSI errors on, adaptive execution with skew handling; further settings as given."""
    b = SparkSession.builder.appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
