"""Where a record goes: topics, keys, file names, index names, codecs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGH, LOW = ("error", "fatal", "critical"), ("debug", "trace")


def topic(labels: Column, high: str = "logs-high-priority", low: str = "logs-low-priority", default: str = "logs", level: Column | None = None) -> Column:
    """By level first, then by the label ``kafka_topic``, else the default."""
    lv = F.lower(labels["level"] if level is None else level)
    own = labels["kafka_topic"]
    return F.when(lv.isin(*HIGH), high).when(lv.isin(*LOW), low).when(F.coalesce(own, F.lit("")) != "", own).otherwise(default)


def rule_topic(labels: Column, rules: list[dict], default: str) -> Column:
    """Declared rules, highest priority first: {priority, topic, match: {label: pattern}}; all patterns of a rule must match."""
    out = None
    for r in sorted(rules, key=lambda r: (-r.get("priority", 0), r["topic"])):
        ok = F.lit(True)
        for k, p in sorted(r.get("match", {}).items()):
            ok = ok & F.coalesce(labels[k].rlike(p), F.lit(False))
        out = F.when(ok, r["topic"]) if out is None else out.when(ok, r["topic"])
    return F.lit(default) if out is None else out.otherwise(default)


def partition_key(labels: Column, source_id: Column, enabled: bool = True, field: str = "tenant") -> Column:
    return F.coalesce(labels[field], source_id) if enabled else F.lit("")


def clean_name(col: Column) -> Column:
    return F.regexp_replace(col, r'[/\\:*?"<>| ]', "_")


def _stem(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col, "^.*/", ""), r"\.[^.]*$", "")


def file_name(pattern: str, ts: Column, source_type: Column, labels: Column) -> Column:
    """Placeholders {date}, {hour}, {container}, {container_id} (12 characters), {file}; those without a value become unknown-*."""
    container = source_type.isin("docker", "container")
    name = F.coalesce(F.when(container, clean_name(labels["container_name"])), F.lit("unknown-container"))
    ident = F.coalesce(F.when(container, F.substring(labels["container_id"], 1, 12)), F.lit("unknown-id"))
    file = F.coalesce(F.when(source_type == "file", clean_name(_stem(F.coalesce(labels["file_path"], labels["file_name"])))), F.lit("unknown-file"))
    out = F.lit(pattern)
    for k, v in (("{date}", F.date_format(ts, "yyyy-MM-dd")), ("{hour}", F.date_format(ts, "HH")), ("{container}", name), ("{container_id}", ident), ("{file}", file)):
        out = F.replace(out, F.lit(k), v)
    return out


def index_name(pattern: str, ts: Column) -> Column:
    out = F.lit(pattern)
    for k, p in (("{date}", "yyyy.MM.dd"), ("{year}", "yyyy"), ("{month}", "MM"), ("{day}", "dd"), ("{hour}", "HH")):
        out = F.replace(out, F.lit(k), F.date_format(ts, p))
    return out


def codec(size: Column, min_bytes: int = 1024) -> Column:
    """Which codec a payload of so many bytes gets."""
    return F.when(size < min_bytes, "none").when(size < 4 * 1024, "lz4").when(size < 64 * 1024, "gzip").when(size < 1024 * 1024, "zstd").otherwise("lz4")


#: Answers after which sending again may help.
RETRYABLE_STATUS = (429, 500, 502, 503, 504)


def retryable(status: Column, error: Column) -> Column:
    return F.coalesce(status.isin(*RETRYABLE_STATUS) | (status >= 500), F.lit(False)) | F.coalesce(F.lower(error).rlike("connection|timeout|eof|temporary"), F.lit(False))


#: From which utilisation of a push queue how many seconds an entry may wait for a place; above the last, none.
ADMISSION_S = ((0.9, 1), (0.75, 3), (0.0, 10))
FULL = 0.95


def push_admission(utilisation: Column, free_after_s: Column) -> Column:
    """What happens to an entry at a queue so full, whose next place comes free after so many seconds (null: never).

    ``sent``, or the dead letter's reason: ``loki_queue_full`` without waiting above 0.95, ``loki_timeout`` when the wait is longer than
    the utilisation allows. An unknown utilisation counts as an empty queue.
    """
    u = F.coalesce(utilisation, F.lit(0.0))
    (first, least), *rest = ADMISSION_S
    allowed = F.when(u > first, least)
    for above, seconds in rest:
        allowed = allowed.when((u > above) | F.lit(above == 0.0), seconds)
    return F.when(u > FULL, "loki_queue_full").when(F.coalesce(free_after_s <= allowed, F.lit(False)), "sent").otherwise("loki_timeout")


def error_class(status: Column, body: Column) -> Column:
    """data errors (refused for their times) don't count against a sink; others do."""
    return F.when(status < 300, "ok").when((status == 400) & F.lower(body).rlike("timestamp|too old|out of order|too far"), "data_error").when(retryable(status, body), "retryable").otherwise("permanent")
