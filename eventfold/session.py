"""A session with the settings that the functions rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "eventfold", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, and the JVM's own character sets for CSV in GB18030."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.legacy.javaCharsets": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
