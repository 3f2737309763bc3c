"""Validation of times, paths, URLs, strings and labels, as expressions. Times are compared with an explicit reference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .layouts import parse
from .regex import re2

#: Layouts that times are accepted in.
ACCEPTED = ("2006-01-02T15:04:05Z07:00", "2006-01-02T15:04:05.999999999Z07:00", "2006-01-02T15:04:05.000Z", "2006-01-02T15:04:05Z", "2006-01-02 15:04:05")
#: Patterns that no path or string may hold, and the characters of a path.
BLOCKED = (r"\.\.", "/etc/", "/proc/", "/sys/", "/dev/", "/root/", r"\$\{", "`", r"\|", ";", "&")
PATH_CHARS = r"^[a-zA-Z0-9\-_./]*\z"
MAX_PATH, MAX_STRING, MAX_LABEL = 4096, 65536, 63
INJECTIONS = ("<script", "javascript:", "data:text/html", "vbscript:", "onload=", "onerror=")
#: Hosts and prefixes of private addresses.
PRIVATE_HOSTS = ("localhost", "127.0.0.1", "::1", "0.0.0.0")
PRIVATE_PREFIXES = ("10.", *(f"172.{n}." for n in range(16, 32)), "192.168.", "169.254.")
LOG_SECRETS = (r'password["\s]*[:=]["\s]*[^"\s,}]+', r'token["\s]*[:=]["\s]*[^"\s,}]+', r'secret["\s]*[:=]["\s]*[^"\s,}]+', r'key["\s]*[:=]["\s]*[^"\s,}]+', r'authorization["\s]*:["\s]*[^"\s,}]+')


def timestamp_result(ts: Column, reference: Column, future_s: float = 60, past_s: float = 21_600, action: str = "clamp", clamp: bool = True) -> Column:
    """struct(valid, action, reason, severity, original_time, validated_time) of one time."""
    micros = lambda s: F.expr(f"make_interval(0,0,0,0,0,0,{s})")
    future, past = ts > reference + micros(future_s), ts < reference - micros(past_s)
    bad = F.coalesce(future | past, F.lit(True))
    known = action if action in ("clamp", "reject", "warn") else "clamp"
    done = {"clamp": "clamped" if clamp else "rejected", "reject": "rejected", "warn": "warned"}[known]
    valid = done in ("clamped", "warned")
    severity = "error" if done == "rejected" else "warning"
    fixed = reference if done == "clamped" else ts
    return F.struct(
        (~bad | F.lit(valid)).alias("valid"),
        F.when(bad, done).otherwise("valid").alias("action"),
        F.when(ts.isNull(), "timestamp_missing").when(future, "timestamp_too_far_future").when(past, "timestamp_too_old").alias("reason"),
        F.when(bad, severity).otherwise("info").alias("severity"),
        ts.alias("original_time"),
        F.when(bad, fixed).otherwise(ts).alias("validated_time"),
    )


def parse_timestamp(col: Column, zone: str = "UTC") -> Column:
    return F.coalesce(*(parse(col, x, zone) for x in ACCEPTED))


def parse_and_validate(col: Column, reference: Column, **options) -> Column:
    """A text that is no time is rejected."""
    ts = parse_timestamp(col)
    checked = timestamp_result(ts, reference, **options)
    return F.when(ts.isNull(), F.struct(F.lit(False).alias("valid"), F.lit("rejected").alias("action"), F.lit("timestamp_parse_failed").alias("reason"), F.lit("error").alias("severity"), ts.alias("original_time"), ts.alias("validated_time"))).otherwise(checked)


def in_window(ts: Column, reference: Column, future_s: float = 60, past_s: float = 21_600) -> Column:
    """Strictly inside both bounds."""
    return (ts > reference - F.expr(f"make_interval(0,0,0,0,0,0,{past_s})")) & (ts < reference + F.expr(f"make_interval(0,0,0,0,0,0,{future_s})"))


def clamp_late(ts: Column, reference: Column, tolerance_s: float = 86_400) -> Column:
    return F.when(ts < reference - F.expr(f"make_interval(0,0,0,0,0,0,{tolerance_s})"), reference).otherwise(ts)


def _blocked(col: Column) -> Column:
    out = F.lit(False)
    for p in BLOCKED:
        out = out | col.rlike(p)
    return out


def path_error(col: Column, require_absolute: bool = True) -> Column:
    """The first reason against a path, or null."""
    out = F.when(F.coalesce(col, F.lit("")) == "", "empty").when(F.octet_length(col) > MAX_PATH, "too_long").when(F.contains(col, F.lit("..")), "traversal")
    if require_absolute:
        out = out.when(~col.startswith("/"), "not_absolute")
    return out.when(_blocked(col), "blocked_pattern").when(~col.rlike(PATH_CHARS), "invalid_characters")


def url_error(col: Column) -> Column:
    """The first reason against a URL, or null: only http and https to hosts that are public."""
    scheme = F.lower(F.regexp_extract(col, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))
    netloc = F.regexp_extract(col, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    host = F.regexp_replace(netloc, r"^(.+):[^:]*$", "$1")
    private = host.isin(*PRIVATE_HOSTS)
    for p in PRIVATE_PREFIXES:
        private = private | host.startswith(p)
    return F.when(F.coalesce(col, F.lit("")) == "", "empty").when(~scheme.isin("http", "https"), "unsupported_scheme").when(netloc == "", "empty_host").when(private, "private_host")


def string_error(col: Column) -> Column:
    clean = F.regexp_replace(col, r"\x00", "")
    return F.when(F.octet_length(col) > MAX_STRING, "too_long").when(clean.rlike(r"[\x01-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"), "control_characters").when(_blocked(clean), "blocked_pattern")


def clean_string(col: Column) -> Column:
    """Without NULs; null if the string is refused."""
    return F.when(string_error(col).isNull(), F.regexp_replace(col, r"\x00", ""))


def message_error(col: Column) -> Column:
    injected = F.lit(False)
    for x in INJECTIONS:
        injected = injected | F.contains(F.lower(col), F.lit(x))
    return F.when(F.coalesce(col, F.lit("")) == "", F.lit(None).cast("string")).otherwise(F.coalesce(string_error(col), F.when(injected, "injection")))


def label_key_ok(key: Column) -> Column:
    return key.rlike(r"^[a-zA-Z][a-zA-Z0-9_]*\z") & (F.length(key) <= MAX_LABEL)


def labels_ok(labels: Column) -> Column:
    """Whether all keys and values pass; a null map passes."""
    entries = F.map_entries(labels)
    return F.coalesce(F.forall(entries, lambda e: label_key_ok(e["key"]) & string_error(e["key"]).isNull() & string_error(e["value"]).isNull()), F.lit(True))


def safe_for_log(col: Column) -> Column:
    for p in LOG_SECRETS:
        col = F.regexp_replace(col, "(?i)" + re2(p), "[REDACTED]")
    return F.when(F.octet_length(col) > 1000, F.concat(F.substring(col, 1, 997), F.lit("..."))).otherwise(col)


#: Words that tell of the engine's own log lines.
SELF_WORDS = ("dispatcher", "file_monitor", "container_monitor", "loki_sink", "dead letter queue", "deduplication", "position_manager")


def guard_result(source_id: Column, labels: Column, message: Column, self_ids: tuple[str, ...] = (), container_patterns: tuple[str, ...] = (), path_patterns: tuple[str, ...] = (), message_patterns: tuple[str, ...] = (), words: tuple[str, ...] = SELF_WORDS, action: str = "drop") -> Column:
    """struct(is_self, action, reason, pattern): the first check that finds the engine's own output."""

    def own(x: Column) -> Column:
        found = F.lit(False)
        for s in self_ids:
            found = found | F.contains(x, F.lit(s)) | F.contains(F.lit(s), x)
        return F.coalesce(found, F.lit(False))

    def first(x: Column, patterns: tuple[str, ...]) -> Column:
        return F.coalesce(*(F.when(x.rlike(re2(p)), F.lit(p)) for p in patterns), F.lit(None).cast("string"))

    container, path = labels["container"], labels["source"]
    by_container, by_path, by_message = first(container, container_patterns), first(path, path_patterns), first(message, message_patterns)
    spoken = F.lit(False)
    for w in words:
        spoken = spoken | F.contains(F.lower(message), F.lit(w))
    reason = F.when(own(source_id), "self_source_id").when(own(container), "self_container_label").when(by_container.isNotNull(), "container_pattern_match").when(by_path.isNotNull(), "path_pattern_match").when(by_message.isNotNull(), "message_pattern_match").when(spoken, "own_log_words")
    pattern = F.when(own(source_id), source_id).when(own(container), container).otherwise(F.coalesce(by_container, by_path, by_message))
    taken = {"tag": "tag", "warn": "allow"}.get(action, "drop")
    return F.struct(reason.isNotNull().alias("is_self"), F.when(reason.isNotNull(), taken).otherwise("allow").alias("action"), reason.alias("reason"), F.when(reason.isNotNull(), pattern).alias("pattern"))
