"""Retries, dead letters, limits, breakers, backpressure, offsets and retention as data operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import fold


def outcome(ok: Column, total: Column) -> Column:
    """What happens to a batch that ``ok`` of ``total`` sinks took."""
    return F.when(ok == total, "done").when(ok == 0, "dead_letter").otherwise("retry")


def linear_delay(attempt: Column, base_s: float = 1.0, most: int = 3) -> Column:
    """Seconds before a retry; null when there are no more."""
    return F.when(attempt <= most, attempt * base_s)


def exponential_delay(attempt: Column, initial_s: float = 60.0, factor: float = 2.0, cap_s: float = 1800.0) -> Column:
    return F.least(F.lit(initial_s) * F.pow(F.lit(factor), attempt - 1), F.lit(cap_s))


def dead_letters(failed: DataFrame, at: Column, sink: Column, message: Column, kind: Column) -> DataFrame:
    """Rows of the dead-letter table from failed records; the id is sink, nanoseconds and source."""
    entry = F.struct("timestamp", "message", "level", "source_type", "source_id", "labels")
    none = F.lit(None)
    return failed.select(
        at.alias("timestamp"), entry.alias("original_entry"), message.alias("error_message"), kind.alias("error_type"), sink.alias("failed_sink"), F.lit(0).alias("retry_count"),
        F.create_map().cast("map<string,string>").alias("context"), none.cast("string").alias("stack_trace"), F.lit(0).alias("reprocess_attempts"), none.cast("timestamp").alias("last_reprocess_attempt"),
        none.cast("timestamp").alias("next_reprocess_time"), F.lit(True).alias("reprocessing_enabled"), F.concat_ws("_", sink, (F.unix_micros(at) * 1000).cast("string"), F.col("source_id")).alias("entry_id"),
    )


def replay_selection(dlq: DataFrame, now: Column, most_attempts: int = 6, least_age_s: int = 300, batch: int | None = None) -> DataFrame:
    """Entries that are due, oldest first."""
    age = F.unix_micros(now) - F.unix_micros("timestamp")
    due = dlq.where(F.col("reprocessing_enabled") & (F.col("reprocess_attempts") < most_attempts) & (age >= least_age_s * 1_000_000) & (F.col("next_reprocess_time").isNull() | (F.col("next_reprocess_time") <= now)))
    return due.orderBy("timestamp", "entry_id").limit(batch) if batch else due


def after_attempt(dlq: DataFrame, ok: Column, now: Column, **delay) -> DataFrame:
    """The table after a replay: what succeeded goes, the rest waits longer."""
    n = F.col("reprocess_attempts") + 1
    wait = exponential_delay(n, **delay)
    return dlq.where(~ok).withColumn("next_reprocess_time", F.timestamp_micros((F.unix_micros(now) + wait * 1_000_000).cast("bigint"))).withColumns({"reprocess_attempts": n, "last_reprocess_attempt": now})


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``changes`` replace those of the same key; new ones are added."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def dlq_alerts(dlq: DataFrame, now: Column, per_minute: float = 10, total: int = 10_000) -> DataFrame:
    recent = F.count_if(F.unix_micros("timestamp") > F.unix_micros(now) - 60_000_000)
    return dlq.agg(F.count("*").alias("entries"), recent.alias("last_minute")).withColumns({"rate_alert": F.col("last_minute") > per_minute, "total_alert": F.col("entries") > total})


def dlq_health(snapshots: DataFrame, keys: list[str], micros: str, per_minute: float = 10, total: int = 10_000, queue: int = 1_000) -> DataFrame:
    """The four dead-letter alerts, one row each, from snapshots of (``total_entries``, ``queue_size``, ``write_errors``).

    Rate and write errors compare a snapshot with the one before of its keys; the first has none, and so neither of the two.
    """
    w = Window.partitionBy(*keys).orderBy(micros, "total_entries")
    before = {c: F.lag(c).over(w) for c in (micros, "total_entries", "write_errors")}
    s = snapshots.select("*", *(x.alias(f"__{i}") for i, x in enumerate(before.values())))
    minutes = F.when(F.col(micros) > F.col("__0"), (F.col(micros) - F.col("__0")) / 60_000_000)
    rate, errors = (F.col("total_entries") - F.col("__1")) / minutes, F.col("write_errors") - F.col("__2")
    kinds = [
        ("high_entry_rate", "warning", rate, float(per_minute)),
        ("high_total_count", "critical", F.when(F.lit(total > 0), F.col("total_entries")), float(total)),
        ("high_queue_size", "warning", F.col("queue_size"), float(queue)),
        ("write_errors", "error", errors, 0.0),
    ]
    alerts = [F.when(x > limit, F.struct(F.lit(kind).alias("type"), F.lit(level).alias("severity"), x.cast("double").alias("current"), F.lit(limit).alias("threshold"))) for kind, level, x, limit in kinds]
    return s.select(*keys, micros, F.inline(F.array_compact(F.array(*alerts))))


def token_bucket(df: DataFrame, keys: list[str], micros: str, rps: float, burst: float, need: str | None = None, out: str = "allowed") -> DataFrame:
    """Refill by elapsed time up to the burst; a record passes if the bucket holds what it needs (1, or a column)."""

    def step(s, t, n):
        tokens, last = s
        if last is not None:
            tokens = min(burst, tokens + (t - last) / 1e6 * rps)
        ok = tokens >= n
        return (tokens - n if ok else tokens, t), (ok,)

    rows = df if need else df.withColumn("__need", F.lit(1.0))
    return fold(rows, keys, [micros], [micros, need or "__need"], lambda: (burst, None), step, {out: "boolean"}).drop("__need")


def byte_tokens(size: Column) -> Column:
    return F.greatest(F.ceil(size / 65536.0), F.lit(1)).cast("double")


def adaptive_rate(df: DataFrame, keys: list[str], order: list[str], latency: str, target: float, rps0: float = 1000.0, least: float = 10.0, most: float = 10_000.0, smoothing: float = 0.1) -> DataFrame:
    """The allowed rate after each latency: above 1.2 of the target it falls by a tenth, below 0.8 it grows by a tenth."""

    def step(s, x):
        rps, avg = s
        if x is not None:
            avg = x if avg is None else smoothing * x + (1 - smoothing) * avg
            rps = rps * 0.9 if avg > target * 1.2 else rps * 1.1 if avg < target * 0.8 else rps
            rps = min(max(rps, least), most)
        return (rps, avg), (rps,)

    return fold(df, keys, order, [latency], lambda: (rps0, None), step, {"rps": "double"})


#: Weights of the load, and levels with their thresholds and factors.
LOAD = {"queue": 0.3, "memory": 0.25, "cpu": 0.2, "io": 0.15, "errors": 0.1}
LEVELS = (("critical", 0.95, 0.2), ("high", 0.9, 0.5), ("medium", 0.75, 0.7), ("low", 0.6, 0.9))


def load_score() -> Column:
    out = None
    for k, w in LOAD.items():
        out = F.col(k) * w if out is None else out + F.col(k) * w
    return out


def backpressure(score: Column) -> tuple[Column, Column]:
    """(level, factor) of a load; thresholds belong to the level."""
    level, factor = F.when(F.lit(False), ""), F.when(F.lit(False), 1.0)
    for name, limit, f in LEVELS:
        level, factor = level.when(score >= limit, name), factor.when(score >= limit, f)
    return level.otherwise("none"), factor.otherwise(1.0)


def backpressure_state(df: DataFrame, keys: list[str], seconds: str, score: str, cooldown_s: float = 30.0) -> DataFrame:
    """The level that is in force: it rises at once and falls only when the cooldown since its last change is over."""
    ranks = {"none": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}

    def step(s, t, x):
        level, since = s
        new = next((n for n, limit, _ in LEVELS if x is not None and x >= limit), "none")
        if ranks[new] > ranks[level] or (ranks[new] < ranks[level] and (since is None or t - since >= cooldown_s)):
            level, since = new, t
        return (level, since), (level,)

    return fold(df, keys, [seconds], [seconds, score], lambda: ("none", None), step, {"in_force": "string"})


#: Features that are switched off from a level on.
DEGRADED = {"low": ("debug_logging",), "medium": ("metrics_detail", "deduplication"), "high": ("anomaly_detection", "enrichment"), "critical": ("processing", "compression")}


def degraded_features(level: Column) -> Column:
    """All features off at a level: those of the lower levels too."""
    out, names = F.when(F.lit(False), F.array().cast("array<string>")), []
    for k in ("low", "medium", "high", "critical"):
        names = [*names, *DEGRADED[k]]
        out = out.when(level == k, F.array(*map(F.lit, names)))
    return out.otherwise(F.array().cast("array<string>"))


#: A breaker's state before its first attempt: name, failures, successes and calls while half open, time of the last change.
BREAKER_START = ("closed", 0, 0, 0, 0.0)


def breaker_step(s: tuple, t: float, good: bool, threshold: int, open_s: float, successes: int, half_open_calls: int) -> tuple[tuple, tuple[bool, str]]:
    """The state after an attempt, whether it was allowed, and the state's name."""
    state, fails, wins, calls, since = s
    if state == "open" and t - since >= open_s:
        state, wins, calls, since = "half_open", 0, 0, t
    if state == "half_open" and t - since >= 2 * open_s:
        state, since = "open", t
    if state == "open" or state == "half_open" and calls >= half_open_calls:
        return (state, fails, wins, calls, since), (False, state)
    if state == "half_open":
        calls += 1
        if good:
            wins += 1
            if wins >= successes:
                state, fails = "closed", 0
        else:
            state, since = "open", t
    elif good:
        fails = max(0, fails - 1)
    else:
        fails += 1
        if fails >= threshold:
            state, since = "open", t
    return (state, fails, wins, calls, since), (True, state)


def circuit_breaker(df: DataFrame, keys: list[str], seconds: str, ok: str, threshold: int = 5, open_s: float = 30.0, successes: int = 3, half_open_calls: int = 3) -> DataFrame:
    """``allowed`` and the breaker's ``state`` after each attempt. A success takes one failure back while closed."""
    return fold(df, keys, [seconds], [seconds, ok], lambda: BREAKER_START, lambda s, t, good: breaker_step(s, t, good, threshold, open_s, successes, half_open_calls), {"allowed": "boolean", "state": "string"})


def file_changes(positions: DataFrame, path: str = "file_path", order: str = "last_read") -> DataFrame:
    """rotated (another inode or device), truncated (smaller), and the offset to read from."""
    w = Window.partitionBy(path).orderBy(order)
    rotated = F.coalesce((F.col("inode") != F.lag("inode").over(w)) | (F.col("device") != F.lag("device").over(w)), F.lit(False))
    truncated = F.coalesce(F.col("size") < F.lag("size").over(w), F.lit(False)) & ~rotated
    return positions.withColumns({"rotated": rotated, "truncated": truncated}).withColumn("read_from", F.when(F.col("rotated") | F.col("truncated"), 0).otherwise(F.col("offset")))


def container_since(status: Column, last_log: Column, since: Column, created: Column, now: Column) -> Column:
    return F.coalesce(F.when(status.isin("restarted", "stopped"), last_log), since, created, now)


def stale_positions(positions: DataFrame, now: Column, days: int = 7) -> DataFrame:
    return positions.where(F.col("status").isin("removed", "deleted") & (F.unix_micros("last_read") < F.unix_micros(now) - days * 86_400_000_000))


def retention(files: DataFrame, now_s: Column, max_age_s: float | None = None, max_bytes: int | None = None, max_files: int | None = None, group: list[str] = ()) -> DataFrame:
    """``delete_reason`` by age, then size, then number; what is kept are the newest. ``mod_s``: epoch seconds."""
    from .sequences import running_order

    aged = files.withColumn("__aged", (now_s - F.col("mod_s") > max_age_s) if max_age_s is not None else F.lit(False))
    ranked = running_order(aged.where("not __aged"), list(group), [F.desc("mod_s"), F.col("path")], {"__bytes": F.col("size"), "__files": F.lit(1).cast("long")})
    by_size = F.col("__bytes") > max_bytes if max_bytes is not None else F.lit(False)
    by_count = F.col("__files") > max_files if max_files is not None else F.lit(False)
    kept = ranked.withColumn("delete_reason", F.when(by_size, "size").when(by_count, "count")).drop("__bytes", "__files", "__aged")
    return kept.unionByName(aged.where("__aged").drop("__aged").withColumn("delete_reason", F.lit("age")))


def admitted(df: DataFrame, keys: list[str], order: list, size: Column, capacity: int) -> DataFrame:
    """``admitted``: whether a record still fits into what its group may write."""
    from .sequences import running_order

    return running_order(df, keys, order, {"__bytes": size}).withColumn("admitted", F.col("__bytes") <= capacity).drop("__bytes")


def stale_tasks(beats: DataFrame, now: Column, timeout_s: int = 300) -> DataFrame:
    """Tasks whose last heartbeat is too old."""
    return beats.groupBy("task").agg(F.max("ts").alias("last")).where(F.unix_micros("last") < F.unix_micros(now) - timeout_s * 1_000_000)
