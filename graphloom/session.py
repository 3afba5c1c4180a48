"""Session settings that every operator assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "graphloom", **conf: object) -> SparkSession:
    """Adaptive execution with skewed joins split, UTC, and Arrow; ``conf`` has underscores for dots."""
    builder = SparkSession.builder.appName(name)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (base | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, str(v))
    return builder.getOrCreate()
