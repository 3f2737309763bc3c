"""Metrics as text lines, and counters of a pipeline's steps as observed metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import matches
from ..plans.pipeline import Pipeline


def lines(samples: DataFrame) -> DataFrame:
    """name{label="value",...} value milliseconds, from (metric, labels, us, value)."""
    quoted = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), quoted(e["value"]), F.lit('"'))), ",")
    body = F.when(pairs != "", F.concat(F.lit("{"), pairs, F.lit("}"))).otherwise(F.lit(""))
    return samples.select(F.concat(F.col("metric"), body, F.lit(" "), F.col("value").cast("string"), F.lit(" "), F.floor(F.col("us") / 1000).cast("string")).alias("line"))


def step_counts(pipeline: Pipeline, message: Column | None = None) -> list[Column]:
    """For ``df.observe(name, *step_counts(p))``: how many records each step of a pipeline applies to."""
    m = F.col("message") if message is None else message
    out = []
    for i, s in enumerate(pipeline.steps):
        ok = F.lit(True)
        for pattern in (s.condition, s.config.get("pattern") if s.type in ("regex_extract", "log_level_extract") else None):
            if pattern:
                ok = ok & matches(m, pattern)
        out.append(F.count_if(ok).alias(f"{pipeline.name}_{i}_{s.name or s.type}"))
    return out


def elastic_template(pattern: str = "logs-*", shards: int = 1, replicas: int = 0) -> dict:
    """An index template for the documents of ``sinks.elastic_documents``."""
    keyword = {"type": "keyword"}
    fields = {"@timestamp": {"type": "date"}, "message": {"type": "text"}, "level": keyword, "source_id": keyword, "labels": {"type": "object", "dynamic": True}, "host": keyword, "service": keyword}
    return {"index_patterns": [pattern], "template": {"settings": {"number_of_shards": shards, "number_of_replicas": replicas}, "mappings": {"properties": fields}}}


def retrain_due(samples: Column, last_us: Column, now_us: Column, least_samples: int = 1000, interval_s: int = 3600) -> Column:
    """Whether a model should be fitted again: enough records since then, and the interval is over."""
    return (samples >= least_samples) & (F.coalesce(now_us - last_us, F.lit(interval_s * 1_000_000)) >= interval_s * 1_000_000)
