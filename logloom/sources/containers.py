"""Container logs: lines, which containers are followed, and their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.labels import standard

_STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})\s+"


def clean_line(raw: Column) -> Column:
    """Without the eight bytes of a stream header, a leading time, and blanks around; null if nothing is left."""
    text = F.when(raw.rlike(r"^[\x00-\x02]\x00\x00\x00"), F.substring(raw, 9, 2**30)).otherwise(raw)
    text = F.trim(F.regexp_replace(text, _STAMP, ""))
    return F.when(text != "", text)


def read_runtime_json(spark: SparkSession, path: str) -> DataFrame:
    """Files of the runtime's JSON log driver: message, stream, time."""
    rows = spark.read.schema("log string, stream string, time timestamp").option("recursiveFileLookup", "true").json(path)
    return rows.select(clean_line(F.regexp_replace("log", "\n$", "")).alias("message"), "stream", "time").where("message is not null")


def _label_hit(labels: Column, rule: str) -> Column:
    k, eq, v = rule.partition("=")
    return F.coalesce(labels[k] == v, F.lit(False)) if eq else F.map_contains_key(labels, k)


def followed(name: Column, labels: Column, include_names: tuple[str, ...] = (), exclude_names: tuple[str, ...] = (), include_labels: tuple[str, ...] = (), exclude_labels: tuple[str, ...] = ()) -> Column:
    """Excluded by a part of the name or a label (key or key=value); then included by any of those, or by default."""
    any_name = lambda xs: sum((F.contains(name, F.lit(x)).cast("int") for x in xs), F.lit(0)) > 0
    any_label = lambda xs: sum((_label_hit(labels, x).cast("int") for x in xs), F.lit(0)) > 0
    out = ~any_name(exclude_names) & ~any_label(exclude_labels)
    if include_names:
        out = out & any_name(include_names)
    if include_labels:
        out = out & any_label(include_labels)
    return out


#: What an event means for the set of followed containers.
EVENT_STATE = {"start": "running", "unpause": "running", "pause": "paused", "die": "stopped", "stop": "stopped", "destroy": "removed"}


def states(events: DataFrame, container: str, action: str, ts: str) -> DataFrame:
    """The state of each container after its last event that matters."""
    state = F.create_map(*(F.lit(x) for kv in EVENT_STATE.items() for x in kv))[F.col(action)]
    known = events.withColumn("state", state).where("state is not null")
    return known.groupBy(container).agg(F.max_by("state", ts).alias("state"), F.max(ts).alias("since"))


def state_history(events: DataFrame, container: str, action: str, ts: str) -> DataFrame:
    """Intervals of states: from, to (null while it lasts)."""
    state = F.create_map(*(F.lit(x) for kv in EVENT_STATE.items() for x in kv))[F.col(action)]
    known = events.withColumn("state", state).where("state is not null")
    return known.select(container, "state", F.col(ts).alias("from"), F.lead(ts).over(Window.partitionBy(container).orderBy(ts)).alias("to"))


def container_labels(labels: Column, host: Column, hostname: Column) -> Column:
    return standard(labels, "docker", host, hostname)
