"""Label maps: what sources add and drop, and what goes into stream keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SERVICE = "logloom"

#: Labels that sources don't take over.
FORBIDDEN = (
    "test_label", "service_name", "project", "log_type", "maintainer", "job", "environment",
    "com.docker.compose.project", "com.docker.compose.project.config_files", "com.docker.compose.project.working_dir", "com.docker.compose.config-hash",
    "com.docker.compose.version", "com.docker.compose.oneoff", "com.docker.compose.depends_on", "com.docker.compose.image", "org.opencontainers.image.source",
)
#: Labels with many values, and prefixes of passing ones, that streams are not keyed by.
HIGH_CARDINALITY = (
    "timestamp", "time", "trace_id", "request_id", "transaction_id", "container_id", "file_path", "filepath", "pid", "thread_id", "line_number", "offset", "position",
    "instance", "instance_name", "image", "msg",
)
TEMPORARY = ("_temp_", "label__temp_", "temp_")


def put(labels: Column, new: dict[str, Column]) -> Column:
    """``labels`` with these set, whatever the session says of duplicate keys."""
    added = F.create_map(*(x for k, v in new.items() for x in (F.lit(k), v)))
    return F.map_concat(F.map_filter(F.coalesce(labels, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*new)), added)


def standard(labels: Column, source: str, instance: Column, instance_name: Column, service: str = SERVICE) -> Column:
    kept = F.map_filter(F.coalesce(labels, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*FORBIDDEN))
    return put(kept, {"service": F.lit(service), "source": F.lit(source), "instance": instance, "instance_name": instance_name})


def remove(labels: Column, *names: str) -> Column:
    return F.map_filter(labels, lambda k, _: ~k.isin(*names))


def stream_name(key: Column) -> Column:
    """A label's name as streams allow it."""
    clean = F.regexp_replace(key, "[^a-zA-Z0-9_]", "_")
    return F.when(clean == "", "unknown").when(~clean.rlike("^[a-zA-Z]"), F.concat(F.lit("label_"), clean)).otherwise(clean)


def dropped(key: Column) -> Column:
    out = key.isin(*HIGH_CARDINALITY)
    for p in TEMPORARY:
        out = out | key.startswith(p)
    return out


def stream_labels(labels: Column, defaults: dict[str, str] | None = None, service: str = SERVICE) -> Column:
    """Defaults, then the record's labels that may key a stream, under clean names (of equal names the last by key stays), and a service."""
    kept = F.array_sort(F.filter(F.map_entries(F.coalesce(labels, F.create_map().cast("map<string,string>"))), lambda e: ~dropped(e["key"])))
    start = F.create_map(*(F.lit(x) for kv in sorted((defaults or {}).items()) for x in kv)).cast("map<string,string>") if defaults else F.create_map().cast("map<string,string>")
    merged = F.aggregate(kept, start, lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != stream_name(e["key"])), F.map_from_arrays(F.array(stream_name(e["key"])), F.array(e["value"]))))
    return F.when(F.map_contains_key(merged, "service"), merged).otherwise(F.map_concat(merged, F.create_map(F.lit("service"), F.lit(service))))


def stream_key(labels: Column) -> Column:
    """{"a":"x","b":"y"} in order of name; values are not escaped."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":"'), e["value"], F.lit('"')))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
