"""A stream from source to sinks: parse, split late records, window counts, fan out."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.validate import timestamp_result


def split_by_time(df: DataFrame, reference: Column, **options) -> tuple[DataFrame, DataFrame]:
    """Records with a valid (or clamped) time, and the rejected ones with their reason, before any watermark."""
    checked = df.withColumn("__v", timestamp_result(F.col("timestamp"), reference, **options))
    good = checked.where("__v.valid").withColumn("timestamp", F.col("__v.validated_time")).drop("__v")
    bad = checked.where("not __v.valid").withColumn("reject_reason", F.col("__v.reason")).drop("__v")
    return good, bad


def windowed_counts(df: DataFrame, keys: list[str], size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    w = F.window("timestamp", size, slide) if slide else F.window("timestamp", size)
    return df.withWatermark("timestamp", late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def session_counts(df: DataFrame, keys: list[str], gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    w = F.session_window("timestamp", gap)
    return df.withWatermark("timestamp", late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each micro-batch to a folder of its own, so that a replayed batch replaces itself."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def deliver(batch: DataFrame, batch_id: int, sinks: dict[str, Callable[[DataFrame, int], None]], dead_letters: Callable[[DataFrame, int], None], retries: int = 3, base_s: float = 1.0) -> dict[str, str]:
    """A batch to every sink; returns the sinks that never took it, with their errors.

    When all sinks refuse it, it goes to the dead letters at once. When some do, these alone are tried again, after ``base_s``
    seconds times the attempt, and the batch goes to the dead letters for those that still refuse it: one call, a row for each
    record and sink. Sinks have to take a batch twice without harm (``parquet_sink`` replaces it).
    """
    left = dict(sinks)
    for attempt in range(retries + 1):
        if attempt:
            time.sleep(attempt * base_s)
        errors: dict[str, str] = {}
        for name, write in left.items():
            try:
                write(batch, batch_id)
            except Exception as error:  # a sink's failure must not stop the others
                errors[name] = str(error)[:500]
        left = {name: left[name] for name in errors}
        if not left or len(left) == len(sinks):
            break
    if left:
        failed = F.explode(F.array(*(F.struct(F.lit(name).alias("failed_sink"), F.lit(error).alias("error_message")) for name, error in errors.items())))
        dead_letters(batch.select("*", failed.alias("__failed")).select(*(F.col(f"`{c}`") for c in batch.columns), "__failed.*"), batch_id)
    return errors


def fan_out(df: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], dead_letters: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, retries: int = 3, base_s: float = 1.0) -> StreamingQuery:
    """Each micro-batch to every sink, by ``deliver``: refused by some it is tried again, refused by all it is a dead letter."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            deliver(batch, batch_id, sinks, dead_letters, retries, base_s)
        finally:
            batch.unpersist()

    writer = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
