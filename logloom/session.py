"""A session with the settings that the engine is tested with. Nothing depends on them for right results."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "logloom", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
