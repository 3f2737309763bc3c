"""Test tables as log records and metric series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

US = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts):
    """Microseconds since the epoch of a time without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def events_as_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts (no zone), us, source_type, source_id, level, message, labels, event_type, value."""
    e = table(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", "error").otherwise("info")
    k = F.get_json_object("props", "$.k")
    message = F.concat(F.col("event_type"), F.lit(" value="), F.col("value").cast("decimal(18,2)").cast("string"), F.lit(" k="), k)
    labels = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("level"), level, F.lit("user"), F.col("user_id").cast("string"))
    return e.select(F.col("event_id").alias("id"), "ts", micros(F.col("ts")).alias("us"), F.lit("events").alias("source_type"), F.col("user_id").cast("string").alias("source_id"), level.alias("level"), message.alias("message"), labels.alias("labels"), "event_type", "value")


#: The same as a SQL view's body.
LOG_SQL = """SELECT event_id AS id, ts, epoch_us(ts) AS us, 'events' AS source_type, CAST(user_id AS VARCHAR) AS source_id,
 CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level,
 event_type || ' value=' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || ' k=' || json_extract_string(props, '$.k') AS message,
 event_type, value, CAST(user_id AS VARCHAR) AS "user" FROM events"""
