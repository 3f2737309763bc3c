"""Alert rules over metric rows (metric, keys, us, value)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import promql


@dataclass(frozen=True)
class Rule:
    """``kind``: value, rate, increase, deriv, ratio (of two metrics), rate_ratio, sum, quantile. ``hold``: seconds."""

    name: str
    severity: str
    kind: str
    metric: str
    op: str
    limit: float
    hold: int
    window: int = 300
    other: str = ""
    scale: float = 1.0
    q: float = 0.99


#: The shipped rules. Ratios of metrics from different jobs are matched on the instance.
RULES = (
    Rule("HighGoroutineCount", "critical", "value", "go_goroutines", ">", 8000, 300),
    Rule("GoroutineCountWarning", "warning", "value", "go_goroutines", ">", 5000, 300),
    Rule("HighMemoryUsage", "critical", "ratio", "process_resident_memory_bytes", ">", 80, 300, other="node_memory_MemTotal_bytes", scale=100),
    Rule("MemoryUsageWarning", "warning", "ratio", "process_resident_memory_bytes", ">", 70, 300, other="node_memory_MemTotal_bytes", scale=100),
    Rule("HighFileDescriptorUsage", "critical", "ratio", "process_open_fds", ">", 80, 300, other="process_max_fds", scale=100),
    Rule("FileDescriptorWarning", "warning", "ratio", "process_open_fds", ">", 70, 300, other="process_max_fds", scale=100),
    Rule("LowDiskSpace", "critical", "ratio", "node_filesystem_avail_bytes", "<", 20, 300, other="node_filesystem_size_bytes", scale=100),
    Rule("DiskSpaceWarning", "warning", "ratio", "node_filesystem_avail_bytes", "<", 30, 300, other="node_filesystem_size_bytes", scale=100),
    Rule("CircuitBreakerOpen", "warning", "sum", "circuit_breaker_state", ">", 0, 120),
    Rule("CircuitBreakerStuckOpen", "critical", "sum", "circuit_breaker_state", ">", 0, 900),
    Rule("HighErrorRate", "critical", "rate_ratio", "logs_errors_total", ">", 0.01, 300, other="logs_processed_total"),
    Rule("ElevatedErrorRate", "warning", "rate_ratio", "logs_errors_total", ">", 0.005, 300, other="logs_processed_total"),
    Rule("HighQueueUtilization", "critical", "ratio", "dispatcher_queue_size", ">", 90, 300, other="dispatcher_queue_capacity", scale=100),
    Rule("QueueUtilizationWarning", "warning", "ratio", "dispatcher_queue_size", ">", 70, 300, other="dispatcher_queue_capacity", scale=100),
    Rule("TargetDown", "critical", "value", "up", "==", 0, 60),
    Rule("NoLogsProcessed", "warning", "rate", "logs_processed_total", "==", 0, 600),
    Rule("LowThroughput", "warning", "rate", "logs_processed_total", "<", 10, 600, window=60),
    Rule("DLQGrowing", "warning", "increase", "dlq_entries_total", ">", 100, 300, window=600),
    Rule("DLQCritical", "critical", "value", "dlq_entries_total", ">", 10000, 300),
    Rule("HighCPUUsage", "warning", "value", "cpu_usage_percent", ">", 80, 600),
    Rule("HighGCPauseTime", "warning", "rate", "gc_pause_duration_seconds_sum", ">", 0.1, 300),
    Rule("SinkLatencyHigh", "warning", "quantile", "sink_send_duration_seconds_bucket", ">", 5, 300),
    Rule("ProcessingLatencyHigh", "warning", "quantile", "processing_duration_seconds_bucket", ">", 1, 300),
    Rule("GoroutineLeakSuspected", "warning", "deriv", "go_goroutines", ">", 10, 900, window=1800),
    Rule("MemoryLeakSuspected", "warning", "deriv", "process_resident_memory_bytes", ">", 10485760, 900, window=1800),
    Rule("FileDescriptorLeakSuspected", "warning", "deriv", "process_open_fds", ">", 5, 900, window=1800),
)


def evaluate(samples: DataFrame, rule: Rule, keys: list[str]) -> DataFrame:
    """alert, severity, keys, us, value, state of one rule; ``samples`` has metric, keys, us, value (and le for quantiles)."""
    return evaluate_all(samples, keys, (rule,))


def evaluate_all(samples: DataFrame, keys: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same for all rules together: each sample is dealt to the rules that read its metric, and rules of one kind share every
    shuffle (windows by rule and series, values by rule, series and time, states by rule and series)."""
    if "le" not in samples.columns:
        samples = samples.withColumn("le", F.lit(None).cast("double"))
    fields = ("alert", "severity", "kind", "op", "limit", "hold", "window", "scale", "q")

    def read(r: Rule, other: bool) -> Column:
        given = (r.name, r.severity, r.kind, r.op, float(r.limit), r.hold, r.window, float(r.scale), float(r.q))
        return F.struct(*(F.lit(v).alias(k) for k, v in zip(fields, given, strict=True)), F.lit(other).alias("other"))

    of_metric: dict[str, list[Column]] = {}
    for r in rules:
        of_metric.setdefault(r.metric, []).append(read(r, False))
        if r.other:
            of_metric.setdefault(r.other, []).append(read(r, True))
    chosen = None
    for metric, readers in of_metric.items():
        chosen = F.when(F.col("metric") == metric, F.array(*readers)) if chosen is None else chosen.when(F.col("metric") == metric, F.array(*readers))
    dealt = samples.where(F.col("metric").isin(*of_metric)).select(*keys, "us", "le", "value", F.explode(chosen).alias("r")).select(*keys, "us", "le", "value", "r.*")
    kinds = {r.kind for r in rules}
    series = ["alert", "other", *keys, "le"]
    grown, sloped = F.col("kind").isin("rate", "rate_ratio", "quantile", "increase"), F.col("kind") == "deriv"
    parts = []
    if kinds & {"rate", "rate_ratio", "quantile", "increase"}:
        rows = promql.with_increase(dealt.where(grown), series, "us", "value", F.col("window"), "value")
        parts.append(rows.withColumn("value", F.when(F.col("kind") == "increase", F.col("value")).otherwise(F.col("value") / F.col("window"))))
    if "deriv" in kinds:
        parts.append(promql.with_deriv(dealt.where(sloped), series, "us", "value", F.col("window"), "value"))
    if kinds - {"rate", "rate_ratio", "quantile", "increase", "deriv"}:
        parts.append(dealt.where(~grown & ~sloped))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    own, other = F.when(~F.col("other"), F.col("value")), F.when(F.col("other"), F.col("value"))
    at = rows.groupBy(*fields, *keys, "us").agg(F.sum(own).alias("own"), F.first(other, ignorenulls=True).alias("against"), F.count_if("other").alias("others"), F.collect_list(F.when(F.col("kind") == "quantile", F.struct("le", F.col("value").cast("double").alias("c")))).alias("b"))
    ratio = F.col("kind").isin("ratio", "rate_ratio")
    at = at.where(~ratio | ((F.col("others") > 0) & F.col("own").isNotNull()))
    value = F.when(ratio, F.try_divide("own", "against")).when(F.col("kind") == "quantile", promql.quantile_of(F.array_sort("b"), F.col("q"))).otherwise(F.col("own")) * F.col("scale")
    valued = at.withColumn("value", value)
    condition = F.when(F.col("op") == ">", F.col("value") > F.col("limit")).when(F.col("op") == "<", F.col("value") < F.col("limit")).otherwise(F.col("value") == F.col("limit"))
    return promql.held(valued, ["alert", *keys], "us", condition, F.col("hold")).select("alert", "severity", *keys, "us", "value", "state")
