"""Features of messages as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import count, matches

#: Patterns that are counted, and patterns of four scores.
COUNTED = (
    r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
    r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}",
    r"\b(ERROR|WARN|INFO|DEBUG|FATAL|PANIC)\b",
    r"\b\d+\b",
    r"\b[A-Z]{2,}\b",
)
ERRORS = ("(error|exception|fail|crash|abort)", "(timeout|deadline exceeded)", "(connection refused|connection reset)", "(out of memory|memory leak)", "(stack overflow|segmentation fault)")
WARNINGS = ("(warn|warning|caution)", "(deprecated|obsolete)", "(retry|retrying)", "(slow|performance)")
SECURITY = ("(auth|authentication|login|logout)", "(access denied|unauthorized|forbidden)", "(security|vulnerability|attack)", "(malware|virus|trojan)", "(injection|xss|csrf)")
PERFORMANCE = (r"\d+ms|\d+\.\d+s|\d+seconds?", r"\d+%", r"\d+MB|\d+GB|\d+KB", "(latency|throughput|qps|tps)")
SEVERITY = {"TRACE": 1.0, "DEBUG": 2.0, "INFO": 3.0, "WARN": 4.0, "WARNING": 4.0, "ERROR": 5.0, "FATAL": 6.0, "PANIC": 6.0}

_FIELDS = "[^\\t\\n\\x0B\\f\\r ]+"


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for the empty text. One pass over the sorted characters: a run of k of them
    adds k * log2(k), the difference k * log2(k) - (k - 1) * log2(k - 1) for each of its characters."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    n = F.size(chars).cast("double")

    def step(a: Column, c: Column) -> Column:
        k = F.when(c == a["last"], a["k"] + 1.0).otherwise(1.0)
        return F.struct(c.alias("last"), k.alias("k"), (a["sum"] + F.when(k > 1.0, k * F.log2(k) - (k - 1.0) * F.log2(k - 1.0)).otherwise(0.0)).alias("sum"))

    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("k"), F.lit(0.0).alias("sum"))
    return F.when(n > 0, F.aggregate(chars, start, step, lambda a: F.greatest(F.log2(n) - a["sum"] / n, F.lit(0.0)))).otherwise(0.0)


def text_features(m: Column) -> dict[str, Column]:
    n = F.char_length(m).cast("double")
    share = lambda x: F.when(n > 0, x / n)
    digits, letters, spaces = (F.regexp_count(m, F.lit(p)).cast("double") for p in (r"\p{Nd}", r"\p{L}", r"[\t\n\x0B\f\r \x85\xA0]"))
    words = F.regexp_extract_all(m, F.lit(_FIELDS), 0)
    out = {
        "message_length": F.octet_length(m).cast("double"),
        "word_count": F.size(words).cast("double"),
        "char_count": n,
        "digit_ratio": share(digits),
        "letter_ratio": share(letters),
        "space_ratio": share(spaces),
        "special_ratio": share(n - digits - letters - spaces),
    }
    out |= {f"pattern_{i}_count": count(m, p).cast("double") for i, p in enumerate(COUNTED)}
    bytes_hex = F.hex(F.encode(m, "utf-8"))
    size = F.octet_length(m)
    repeats = F.when(size > 1, F.aggregate(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), F.lit(0.0), lambda a, i: a + (F.substr(bytes_hex, 2 * i - 1, F.lit(2)) == F.substr(bytes_hex, 2 * i + 1, F.lit(2))).cast("double")) / (size - 1)).otherwise(0.0)
    out |= {
        "entropy": entropy(m),
        "unique_words": F.size(F.array_distinct(F.transform(words, F.lower))).cast("double"),
        "avg_word_length": F.when(F.size(words) > 0, F.aggregate(words, F.lit(0.0), lambda a, w: a + F.octet_length(w)) / F.size(words)).otherwise(0.0),
        "uppercase_count": F.regexp_count(m, F.lit(r"\p{Lu}")).cast("double"),
        "lowercase_count": F.regexp_count(m, F.lit(r"\p{Ll}")).cast("double"),
        "repetition_score": repeats,
    }
    return out


def level_severity(level: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))[F.upper(level)], F.lit(3.0))


def pattern_features(message: Column, level: Column) -> dict[str, Column]:
    """Scores count the patterns that match the lower-cased message; the performance score counts matches."""
    m = F.lower(message)
    score = lambda patterns: sum((matches(m, p).cast("double") for p in patterns), F.lit(0.0))
    numbers = F.transform(F.regexp_extract_all(m, F.lit(r"\d+(?:\.\d+)?"), 0), lambda x: x.cast("double"))
    some = F.size(numbers) > 0
    return {
        "error_pattern_score": score(ERRORS),
        "warning_pattern_score": score(WARNINGS),
        "security_pattern_score": score(SECURITY),
        "performance_pattern_score": sum((count(m, p).cast("double") for p in PERFORMANCE), F.lit(0.0)),
        "numeric_value_count": F.when(some, F.size(numbers).cast("double")),
        "max_numeric_value": F.array_max(numbers),
        "min_numeric_value": F.array_min(numbers),
        "avg_numeric_value": F.when(some, F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x) / F.size(numbers)),
        "level_severity": level_severity(level),
    }
