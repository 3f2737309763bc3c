"""Counters, gauges, histograms and statistics of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def counters(df: DataFrame, labels: list[str]) -> DataFrame:
    return df.groupBy(*labels).agg(F.count("*").alias("value"))


def gauges(df: DataFrame, labels: list[str], value: str, ts: str) -> DataFrame:
    """The last value of each label set."""
    return df.groupBy(*labels).agg(F.max_by(value, ts).alias("value"), F.max(ts).alias("ts"))


def histogram(df: DataFrame, labels: list[str], value: str, bounds: tuple[float, ...]) -> DataFrame:
    """Cumulative buckets: le (text, +Inf last), count; sum and count of all."""
    aggs = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = df.groupBy(*labels).agg(*aggs, F.count(value).alias("n"), F.sum(value).alias("total"))
    rows = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)), F.struct(F.lit(float("inf")).alias("le"), F.col("n").alias("count")))
    return wide.select(*labels, F.explode(rows).alias("r"), "n", "total").select(*labels, "r.le", "r.count", "n", "total")


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def throughput(samples: DataFrame, keys: list[str], ts_s: str, total: str) -> DataFrame:
    """Growth of a total per second between neighbouring samples."""
    w = Window.partitionBy(*keys).orderBy(ts_s)
    return samples.withColumn("rate", F.try_divide(F.col(total) - F.lag(total).over(w), F.col(ts_s) - F.lag(ts_s).over(w)))


def ewma(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float, out: str = "ewma") -> DataFrame:
    from .fold import fold

    def step(s, x):
        s = x if s is None else s if x is None else alpha * x + (1 - alpha) * s
        return s, (s,)

    return fold(df, keys, order, [value], lambda: None, step, {out: "double"})


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, sd (n-1; 0 below two), min, max, sum, percentiles with linear interpolation."""
    p = F.percentile(value, list(PERCENTILES))
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum"), p.alias("p"))
    return out.select(*keys, "n", "mean", "sd", "min", "max", "sum", *(F.col("p")[i].alias(f"p{round(100 * q):02d}") for i, q in enumerate(PERCENTILES)))


def index_percentile(df: DataFrame, keys: list[str], value: str, q: int) -> DataFrame:
    """The value at place n*q/100 of the sorted ones, without interpolation."""
    w = Window.partitionBy(*keys).orderBy(value)
    ranked = df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    return ranked.where(F.col("__i") == F.least(F.floor(F.col("__n") * q / 100), F.col("__n") - 1)).select(*keys, F.col(value).alias(f"p{q}"))


def top(df: DataFrame, by: list[str], k: int) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by).limit(k)


def growth_percent(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    prev = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("growth", F.when(F.coalesce(prev, F.lit(0)) == 0, 0.0).otherwise((F.col(value) - prev) / prev * 100))


def growth_per_minute(df: DataFrame, keys: list[str], seconds: str, value: str, samples: int = 5) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(seconds).rowsBetween(-(samples - 1), 0)
    return df.withColumn("per_minute", F.coalesce(F.try_divide((F.last(value).over(w) - F.first(value).over(w)) * 60.0, F.last(seconds).over(w) - F.first(seconds).over(w)), F.lit(0.0)))


def delta_to_first(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("delta", F.col(value) - F.first(value).over(w))


def severity_of_ratio(value: Column, limit: Column) -> Column:
    r = F.try_divide(value, limit)
    return F.when(r > 2.0, "critical").when(r > 1.5, "high").otherwise("warning")


def cooldown(df: DataFrame, key: str, micros: str, wait_us: int) -> DataFrame:
    """``suppressed``: alerts within the wait since the last one that fired; exactly one wait later fires."""
    from .dedup import ttl_dedup

    return ttl_dedup(df, key, micros, wait_us, inclusive=False, out="suppressed")


def micro_batches(df: DataFrame, keys: list[str], micros: str, size: int, timeout_us: int) -> DataFrame:
    """``batch``: numbers of batches closed by size, or when the first record has waited for the timeout."""
    from .fold import fold

    def step(s, t):
        number, first, n = s
        if n and (n >= size or t - first >= timeout_us):
            number, first, n = number + 1, t, 0
        return (number, t if not n else first, n + 1), (number,)

    return fold(df, keys, [micros], [micros], lambda: (0, 0, 0), step, {"batch": "long"})


def adaptive_batches(df: DataFrame, keys: list[str], order: list[str], latency: str, rate: str, max_latency: float, least_rate: float, size0: int = 100, delay0: float = 1.0, sizes: tuple[int, int] = (10, 1000), delays: tuple[float, float] = (0.1, 10.0)) -> DataFrame:
    """Batch size and delay after each observation: slower than allowed shrinks both by a fifth, too little throughput grows them."""
    from .fold import fold

    def step(s, lat, r):
        size, delay = s
        if lat is not None and lat > max_latency:
            size, delay = int(size * 0.8), delay * 0.8
        elif r is not None and r < least_rate:
            size, delay = int(size * 1.2), delay * 1.1
        size, delay = min(max(size, sizes[0]), sizes[1]), min(max(delay, delays[0]), delays[1])
        return (size, delay), (size, delay)

    return fold(df, keys, order, [latency, rate], lambda: (size0, delay0), step, {"batch_size": "long", "batch_delay": "double"})


def changes(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """added, removed or changed rows between two snapshots, and which fields changed."""
    a, b = before.select(key, *(F.col(f).alias(f"old_{f}") for f in fields), F.lit(True).alias("__a")), after.select(key, *(F.col(f).alias(f"new_{f}") for f in fields), F.lit(True).alias("__b"))
    differ = F.array_compact(F.array(*(F.when(~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}")), F.lit(f)) for f in fields)))
    out = a.join(b, key, "full").withColumn("change", F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.size(differ) > 0, "changed"))
    return out.where("change is not null").select(key, "change", F.when(F.col("change") == "changed", differ).otherwise(F.array().cast("array<string>")).alias("fields"))
