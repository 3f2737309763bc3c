"""The folder that driver and executors share, for tables between two passes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a temporary folder in local mode; on a cluster that would lose data, so it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="logloom-"))
        base = _own_dir[0]
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/logloom/{label}-{uuid.uuid4().hex}"


#: Whether Spark removes an execution's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors.

    Nothing reads the write's shuffles again, so their files go at its end instead of when the driver collects garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    try:
        if before is not None:
            spark.conf.set(_CLEANUP, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is not None:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
