"""JSON records as posted to an ingest address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import put
from ..schema import INGEST_REQUEST


def parse_requests(df: DataFrame, value: str = "value", client: Column | None = None) -> DataFrame:
    """The request's fields with defaults, and ``reject_reason`` (null for good ones)."""
    body = F.from_json(value, INGEST_REQUEST + ", _corrupt_record STRING", {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"})
    rows = df.withColumn("__b", body)
    text = lambda c, d: F.when(F.coalesce(F.col(f"__b.{c}"), F.lit("")) == "", d).otherwise(F.col(f"__b.{c}"))
    labels = put(F.col("__b.labels"), {"ingested_via": F.lit("http_api"), "client_ip": client if client is not None else F.lit("")})
    reason = F.when(F.col("__b").isNull() | F.col("__b._corrupt_record").isNotNull(), "invalid_json").when(F.coalesce(F.col("__b.message"), F.lit("")) == "", "missing_message")
    return rows.select(
        *(c for c in df.columns if c != value),
        F.col("__b.message").alias("message"), text("level", "info").alias("level"), text("source_type", "api").alias("source_type"), text("source_id", "http-ingest").alias("source_id"),
        labels.alias("labels"), F.col("__b.timestamp").alias("timestamp"), reason.alias("reject_reason"),
    )


def accepted_and_rejected(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("reject_reason is null").drop("reject_reason"), df.where("reject_reason is not null")
