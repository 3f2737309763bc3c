"""Service levels and error budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compliance(value: Column, target: Column) -> Column:
    """Percent of the target that is reached, 100 at most."""
    return F.least(F.try_divide(value, target) * 100, F.lit(100.0))


def slo_compliance(measurements: DataFrame) -> DataFrame:
    """Per SLO and time the mean over its indicators."""
    return measurements.groupBy("slo", "ts").agg(F.avg(compliance(F.col("value"), F.col("target"))).alias("compliance"), F.first("window_s").alias("window_s"), F.first("interval_s").alias("interval_s"), F.first("budget_total").alias("budget_total"))


def error_budget(series: DataFrame) -> DataFrame:
    """burn rate, consumed and remaining budget (never below zero) after each measurement."""
    w = Window.partitionBy("slo").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    burn = (100 - F.col("compliance")) / 100
    out = series.withColumn("burn_rate", burn).withColumn("consumed", F.sum(F.col("burn_rate") * F.col("interval_s") / F.col("window_s")).over(w))
    return out.withColumn("remaining", F.greatest(F.col("budget_total") - F.col("consumed"), F.lit(0.0)))


def status(consumed: Column, total: Column, breached: Column) -> Column:
    used = F.try_divide(consumed, total) * 100
    return F.when(used >= 100, "breached").when(used >= 80, "critical").when((used >= 60) | breached, "warning").otherwise("healthy")
