"""Feature columns of log records for anomaly scoring (four families, named <family>_<feature>)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import pattern_features, text_features

#: Intervals that the temporal statistics look back on, the current one besides.
INTERVALS = 1000


def with_text(df: DataFrame, message: str = "message") -> DataFrame:
    return df.withColumns({f"text_{k}": v for k, v in text_features(F.col(message)).items()})


def with_patterns(df: DataFrame, message: str = "message", level: str = "level") -> DataFrame:
    return df.withColumns({f"pattern_{k}": v for k, v in pattern_features(F.col(message), F.col(level)).items()})


def with_statistical(df: DataFrame, keys: list[str] = ("source_id",), ts: str = "timestamp", message: str = "message", level: str = "level", source: str = "source_id") -> DataFrame:
    """Time parts, rates of the last minute and hour (the start excluded), running counts per source, level and message."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    by = Window.partitionBy(*keys).orderBy("__us")
    rate = lambda s: F.count("*").over(by.rangeBetween(-s * 1_000_000 + 1, 0)).cast("double")
    upto = lambda *k: F.row_number().over(Window.partitionBy(*keys, *k).orderBy("__us")).cast("double")
    rows = df.withColumn("__us", us)
    return rows.withColumns(
        {
            "statistical_time_diff_seconds": F.coalesce((F.col("__us") - F.lag("__us").over(by)) / 1e6, F.lit(0.0)),
            "statistical_hour_of_day": F.hour(ts).cast("double"),
            "statistical_day_of_week": (F.dayofweek(ts) - 1).cast("double"),
            "statistical_day_of_month": F.dayofmonth(ts).cast("double"),
            "statistical_month": F.month(ts).cast("double"),
            "statistical_events_per_minute": rate(60),
            "statistical_events_per_hour": rate(3600),
            "statistical_source_count": upto(source),
            "statistical_level_count": upto(level),
            "statistical_message_duplicate_count": upto(message),
        }
    ).drop("__us")


def with_temporal(df: DataFrame, keys: list[str] = ("source_id",), ts: str = "timestamp") -> DataFrame:
    """Intervals between records of a key and their statistics over the last ones; hour and day on the circle."""
    by = Window.partitionBy(*keys).orderBy("__us")
    last = by.rowsBetween(-INTERVALS, 0)
    rows = df.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("__i", F.col("__us") - F.lag("__us").over(by))
    # running sums of whole microseconds (exact in decimals) less those before the window, so that nothing is added up again for each row
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    whole = F.col("__i").cast("decimal(19,0)")
    rows = rows.withColumns({"__c": F.count("__i").over(upto), "__s": F.coalesce(F.sum(whole).over(upto), F.lit(0)).cast("decimal(38,0)"), "__q": F.coalesce(F.sum((whole * whole).cast("decimal(38,0)")).over(upto), F.lit(0)).cast("decimal(38,0)")})
    before = lambda c: F.coalesce(F.lag(c, INTERVALS + 1).over(by), F.lit(0))
    rows = rows.withColumns({"__n": F.col("__c") - before("__c"), "__s1": F.col("__s") - before("__s"), "__s2": F.col("__q") - before("__q")})
    n = F.col("__n")
    avg = F.when(n > 0, F.col("__s1").cast("double") / n / 1e6)
    spread = (n.cast("decimal(10,0)") * F.col("__s2") - F.col("__s1") * F.col("__s1")).cast("double")
    sd = F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (n.cast("double") * (n - 1))) / 1e6).otherwise(0.0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    turn = 2 * math.pi
    return rows.withColumns(
        {
            "temporal_current_interval": zero(F.col("__i") / 1e6),
            "temporal_avg_interval": zero(avg),
            "temporal_std_interval": sd,
            "temporal_min_interval": zero(F.min("__i").over(last) / 1e6),
            "temporal_max_interval": zero(F.max("__i").over(last) / 1e6),
            "temporal_median_interval": zero(F.percentile("__i", 0.5).over(last) / 1e6),
            "temporal_regularity_score": F.when(n < 3, 1.0).when(avg == 0, 0.0).otherwise(F.exp(-F.try_divide(sd, avg))),
            "temporal_hour_sin": F.sin(F.hour(ts) * (turn / 24)),
            "temporal_hour_cos": F.cos(F.hour(ts) * (turn / 24)),
            "temporal_dow_sin": F.sin((F.dayofweek(ts) - 1) * (turn / 7)),
            "temporal_dow_cos": F.cos((F.dayofweek(ts) - 1) * (turn / 7)),
        }
    ).drop("__us", "__i", "__c", "__s", "__q", "__n", "__s1", "__s2")


def feature_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.split("_")[0] in ("text", "statistical", "temporal", "pattern")]


def feature_map(df: DataFrame, names: list[str] | None = None):
    """A map column of the features that aren't null."""
    names = names or feature_names(df)
    return F.map_filter(F.create_map(*(x for n in names for x in (F.lit(n), F.col(n).cast("double")))), lambda _, v: v.isNotNull())
