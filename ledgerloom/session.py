"""A session with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "ledgerloom", **conf: str) -> SparkSession:
    """UTC, ANSI arithmetic and adaptive execution with skew handling; ``conf`` overrides."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | conf
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()
