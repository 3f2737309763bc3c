"""Dead letters, buffered records and services as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DLQ_ENTRY, SERVICE


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of dlq_*.log files; lines that don't parse are left out."""
    rows = spark.read.schema(DLQ_ENTRY + ", _corrupt_record STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("pathGlobFilter", "dlq_*").option("recursiveFileLookup", "true").json(path)
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def checksum(entry: Column) -> Column:
    return F.sha2(F.to_json(entry), 256)


def write_buffer(df: DataFrame, path: str, batch: str) -> None:
    """Append records with their checksum; a batch that is written again replaces itself."""
    entry = F.struct(*df.columns)
    df.select(F.lit(batch).alias("batch"), F.unix_micros(F.current_timestamp()).alias("written_us"), entry.alias("entry"), checksum(entry).alias("checksum")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def read_buffer(spark: SparkSession, path: str, most_bytes: int = 10 << 20) -> DataFrame:
    """Oldest batch first; rows whose checksum doesn't hold or that are too large are left out."""
    rows = spark.read.parquet(path)
    ok = (checksum(F.col("entry")) == F.col("checksum")) & (F.octet_length(F.to_json("entry")) <= most_bytes)
    return rows.where(ok).orderBy("batch").select("batch", "entry.*")


def buffer_cleanup(files: DataFrame, now_s: Column, **limits) -> DataFrame:
    from ..operators.reliability import retention

    return retention(files, now_s, **limits).where("delete_reason is not null")


def services_from_labels(containers: DataFrame, prefix: str = "log.", name: str = "name", labels: str = "labels") -> DataFrame:
    """Services that containers announce by labels <prefix>enabled, pipeline, component, tenant."""
    of = lambda k: F.col(labels)[f"{prefix}{k}"]
    on = containers.where(F.lower(F.coalesce(of("enabled"), F.lit("false"))).isin("true", "1", "yes"))
    return on.select(F.col("id"), F.col(name).alias("name"), F.lit("docker").alias("type"), F.col("status"), F.coalesce(of("pipeline"), F.lit("default")).alias("pipeline"), of("component").alias("component"), of("tenant").alias("tenant"), F.col(labels).alias("labels"))


def services_from_yaml(spark: SparkSession, text: str) -> DataFrame:
    """Services listed in a YAML document: services: [{id, name, ...}]."""
    import yaml

    rows = [(str(s.get("id") or s["name"]), s["name"], s.get("type", "file"), s.get("status", "configured"), s.get("pipeline", "default"), s.get("component"), s.get("tenant"), {str(k): str(v) for k, v in (s.get("labels") or {}).items()}) for s in (yaml.safe_load(text) or {}).get("services", [])]
    return spark.createDataFrame(rows, SERVICE)


def with_service(records: DataFrame, services: DataFrame, key: str = "source_id", most_rows: int = 100_000) -> DataFrame:
    """Service columns for records; the list is broadcast if it is small enough, else joined by a shuffle."""
    side = services.select(F.col("id").alias("__id"), F.col("pipeline").alias("service_pipeline"), F.col("component").alias("service_component"), F.col("tenant").alias("service_tenant"))
    small = side.limit(most_rows + 1).count() <= most_rows
    return records.join(F.broadcast(side) if small else side, F.col(key) == F.col("__id"), "left").drop("__id")
