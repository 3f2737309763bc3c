"""Time layouts written with the reference time of 2 January 2006 15:04:05, as Spark patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Layout token to pattern letters.
TOKENS = {
    "2006": "yyyy", "January": "MMMM", "Jan": "MMM", "Monday": "EEEE", "Mon": "EEE", "01": "MM", "02": "dd", "_2": "d", "15": "HH", "03": "hh", "04": "mm", "05": "ss", "06": "yy", "PM": "a",
    "Z07:00": "XXX", "-07:00": "xxx", "Z0700": "XX", "-0700": "xx", "MST": "z", "1": "M", "2": "d", "3": "h", "4": "m", "5": "s",
}
_token = re.compile("|".join([r"[.,](?:0+|9+)(?!\d)", *sorted(map(re.escape, TOKENS), key=len, reverse=True)]))

#: Layouts tried in turn, and patterns of a leading time with their layout (None: epoch seconds or milliseconds).
COMMON_LAYOUTS = (
    "2006-01-02T15:04:05.000Z", "2006-01-02T15:04:05Z", "2006-01-02T15:04:05.000Z07:00", "2006-01-02T15:04:05Z07:00", "2006-01-02T15:04:05", "2006-01-02T15:04:05.999999999Z07:00",
    "2006-01-02 15:04:05", "2006-01-02 15:04:05.000", "2006/01/02 15:04:05", "01/02/2006 15:04:05",
    "Jan 2 15:04:05", "Jan _2 15:04:05", "Jan 02 15:04:05", "02/Jan/2006:15:04:05 -0700", "02/Jan/2006:15:04:05",
)
LEADING = (
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "2006-01-02T15:04:05"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", "2006-01-02 15:04:05"),
    (r"^\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}", "Jan 2 15:04:05"),
    (r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}", "01/02/2006 15:04:05"),
    (r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}", "2006/01/02 15:04:05"),
)


def spark_pattern(layout: str) -> str:
    """Literal letters are quoted; a fraction may follow the seconds even where the layout has none."""
    out, at = [], 0

    def literal(text: str) -> None:
        if text:
            out.append(re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", text.replace("'", "''")))

    for m in _token.finditer(layout):
        literal(layout[at : m.start()])
        t = m[0]
        if t[0] in ".,":
            if out and out[-1].endswith("]"):
                out[-1] = out[-1].partition("[")[0]
            out.append("[" + ("'" + t[0] + "'" if t[0] == "," else ".") + "SSSSSSSSS]" if t[1] == "9" else t[0] + "S" * (len(t) - 1))
        else:
            out.append(TOKENS[t])
            if t == "05" and not re.match(r"[.,](?:0+|9+)(?!\d)", layout[m.end() :]):
                out.append("[.SSSSSSSSS][.SSSSSS][.SSS]")
        at = m.end()
    literal(layout[at:])
    return "".join(out)


def has_zone(layout: str) -> bool:
    return any(t in layout for t in ("Z07:00", "-07:00", "Z0700", "-0700", "MST"))


def parse(col: Column, layout: str, zone: str = "UTC", default_year: int = 1970) -> Column:
    """The whole text by ``layout``, or null. A layout without a zone is read in ``zone``; one without a year takes ``default_year``."""
    pattern = spark_pattern(layout)
    text = F.regexp_replace(col, r"\s+", " ") if "Jan" in layout and "2006" not in layout else col
    if "2006" not in layout and "06" not in layout.replace("2006", ""):
        text, pattern = F.concat(F.lit(f"{default_year} "), text), f"yyyy {pattern}"
    if has_zone(layout):
        return F.try_to_timestamp(text, F.lit(pattern))
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")).cast("timestamp") if zone != "UTC" else F.try_to_timestamp(text, F.lit(pattern))


def detect(col: Column, zone: str = "UTC", default_year: int = 1970) -> Column:
    """The common layouts over the whole text, then epoch numbers, then a leading time."""
    tries = [parse(col, layout, zone, default_year) for layout in COMMON_LAYOUTS]
    tries.append(F.when(col.rlike(r"^\d{10}\z"), F.timestamp_seconds(F.when(col.rlike(r"^\d{10}\z"), col).cast("bigint"))))
    tries.append(F.when(col.rlike(r"^\d{13}\z"), F.timestamp_millis(F.when(col.rlike(r"^\d{13}\z"), col).cast("bigint"))))
    for pattern, layout in LEADING:
        tries.append(F.when(col.rlike(pattern), parse(F.regexp_extract(col, f"({pattern})", 1), layout, zone, default_year)))
    return F.coalesce(*tries)
