"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tracelake", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; anything else is left to the cluster, or given as conf."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
