"""YAML pipelines of record steps, compiled to column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import layouts
from ..functions.labels import put, remove
from ..functions.regex import matches, re2

#: Fixed value: the alternation that finds a level where a step gives none.
LEVELS = r"(?i)\b(trace|debug|info|warn|warning|error|fatal|panic|critical)\b"


@dataclass(frozen=True)
class Step:
    name: str
    type: str
    config: dict = field(default_factory=dict)
    condition: str | None = None


@dataclass(frozen=True)
class Pipeline:
    name: str
    steps: tuple[Step, ...]


@dataclass
class Record:
    """The columns that steps read and write."""

    message: Column
    labels: Column
    timestamp: Column
    extra: dict[str, Column]


@dataclass(frozen=True)
class Mode:
    """``literal``: field_add stores templates as they are. ``overwrite``: field_add replaces labels that are there.

    The intended meaning (both false) fills ``{{name}}`` and, for the fields in ``Step.config``, leaves labels that a step before found.
    """

    literal: bool = False
    overwrite: bool = True
    default_year: int = 1970


STEPS: dict[str, Callable[[Record, dict, Mode], Record]] = {}


def step(name: str):
    """Register a step type: a function of (record, config, mode) that gives the record after it."""

    def add(f):
        STEPS[name] = f
        return f

    return add


def load(text: str) -> tuple[dict[str, Pipeline], dict[str, list[str]]]:
    """Pipelines by name and the source mapping; patterns and step types are checked at once."""
    doc = yaml.safe_load(text) or {}
    out = {}
    for p in doc.get("pipelines", []):
        steps = tuple(Step(s.get("name", ""), s["type"], s.get("config") or {}, s.get("condition")) for s in p.get("steps", []))
        for s in steps:
            if s.type not in STEPS:
                raise ValueError(f"{p['name']}: unknown step type {s.type!r}")
            for pattern in (s.condition, s.config.get("pattern")):
                if pattern:
                    re.compile(re2(pattern).replace("\\z", "\\Z"))
        out[p["name"]] = Pipeline(p["name"], steps)
    return out, {k: list(v or []) for k, v in (doc.get("source_mapping") or {}).items()}


@step("regex_extract")
def _regex_extract(r: Record, c: dict, mode: Mode) -> Record:
    names = [n for n in c.get("fields") or []]
    if not names:
        return r
    hit = matches(r.message, c["pattern"])
    found = {n: F.regexp_extract(r.message, re2(c["pattern"]), i + 1) for i, n in enumerate(names)}
    return Record(r.message, F.when(hit, put(r.labels, found)).otherwise(r.labels), r.timestamp, r.extra)


@step("timestamp_parse")
def _timestamp_parse(r: Record, c: dict, mode: Mode) -> Record:
    source = c.get("field")
    text = r.labels[source] if source and source != "message" else r.message
    zone = c.get("timezone") or "UTC"
    zone = "UTC" if zone == "Local" else zone
    formats = [c["format"]] if c.get("format") else list(c.get("formats") or [])
    ts = F.coalesce(*(layouts.parse(text, f, zone, mode.default_year) for f in formats)) if formats else layouts.detect(text, zone, mode.default_year)
    if c.get("use_as_log_timestamp", True):
        return Record(r.message, r.labels, F.coalesce(ts, r.timestamp), r.extra)
    name = c.get("target") or "parsed_timestamp"
    return Record(r.message, F.when(ts.isNotNull(), put(r.labels, {name: F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")})).otherwise(r.labels), r.timestamp, r.extra)


@step("json_parse")
def _json_parse(r: Record, c: dict, mode: Mode) -> Record:
    """The fields of a JSON object become labels (nested values as JSON); the labels' own keys stay."""
    source = c.get("field")
    text = r.labels[source] if source and source != "message" else r.message
    parsed = F.from_json(text, "map<string,string>")
    none = F.create_map().cast("map<string,string>")
    values = F.map_filter(F.coalesce(parsed, none), lambda k, v: v.isNotNull() & ~F.map_contains_key(r.labels, k))
    return Record(r.message, F.when(text.rlike(r"^\s*\{"), F.map_concat(r.labels, values)).otherwise(r.labels), r.timestamp, r.extra)


def _template(text: str, r: Record) -> Column:
    parts, at = [], 0
    for m in re.finditer(r"\{\{\s*([\w.]+)\s*\}\}", text):
        parts += [F.lit(text[at : m.start()])] * (m.start() > at)
        name = m[1]
        parts.append(F.coalesce(r.message if name == "message" else r.extra[name] if name in r.extra else r.labels[name], F.lit("")))
        at = m.end()
    parts += [F.lit(text[at:])] * (at < len(text))
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else F.lit("")


@step("field_add")
def _field_add(r: Record, c: dict, mode: Mode) -> Record:
    def text(v) -> str:
        return str(v).lower() if isinstance(v, bool) else str(v)

    new = {str(k): F.lit(text(v)) if mode.literal else _template(text(v), r) for k, v in (c.get("fields") or {}).items()}
    if not new:
        return r
    if not mode.overwrite:
        new = {k: F.coalesce(r.labels[k], v) for k, v in new.items()}
    return Record(r.message, put(r.labels, new), r.timestamp, r.extra)


@step("field_remove")
def _field_remove(r: Record, c: dict, mode: Mode) -> Record:
    names = [str(x) for x in c.get("fields") or []]
    return Record(r.message, remove(r.labels, *names) if names else r.labels, r.timestamp, r.extra)


@step("log_level_extract")
def _log_level_extract(r: Record, c: dict, mode: Mode) -> Record:
    pattern = c.get("pattern") or LEVELS
    level = F.lower(F.regexp_extract(r.message, re2(pattern), 1))
    return Record(r.message, F.when(matches(r.message, pattern), put(r.labels, {c.get("field") or "level": level})).otherwise(r.labels), r.timestamp, r.extra)


def simplified(steps: tuple[Step, ...]) -> tuple[Step, ...]:
    """Neighbouring field_add steps without guards become one (later values win), so that the labels are rebuilt once."""
    out: list[Step] = []
    for s in steps:
        last = out[-1] if out else None
        plain = s.type == "field_add" and not s.condition
        if plain and last and last.type == "field_add" and not last.condition and not any("{{" in str(v) for v in (s.config.get("fields") or {}).values()):
            out[-1] = Step(last.name, "field_add", {"fields": {**(last.config.get("fields") or {}), **(s.config.get("fields") or {})}})
        else:
            out.append(s)
    return tuple(out)


def apply(df: DataFrame, pipeline: Pipeline, mode: Mode = Mode(), extra: dict[str, Column] | None = None, only: Column | None = None) -> DataFrame:
    """``df`` (message, labels, timestamp) after the pipeline, with its name in ``pipeline``. ``only``: the records that it is for;
    others stay as they are.

    Each step is a projection of its own; Catalyst merges those that don't repeat work.
    """
    none = F.create_map().cast("map<string,string>")
    out = df.withColumn("labels", F.coalesce(F.col("labels"), none))
    for s in simplified(pipeline.steps) if mode.overwrite else pipeline.steps:
        before = Record(F.col("message"), F.col("labels"), F.col("timestamp"), extra or {})
        after = STEPS[s.type](before, s.config, mode)
        ok = matches(F.col("message"), s.condition) if s.condition else None
        ok = ok if only is None else only if ok is None else only & ok
        if ok is not None:
            after = Record(after.message, F.when(ok, after.labels).otherwise(before.labels), F.when(ok, after.timestamp).otherwise(before.timestamp), after.extra)
        out = out.withColumns({"labels": after.labels, "timestamp": after.timestamp})
    return out.withColumn("pipeline", F.lit(pipeline.name))


def route(source_type: Column, labels: Column, mapping: dict[str, list[str]], default: str = "default") -> Column:
    """The pipeline of a record: the first in the mapping's order whose pattern fits.

    ``key:value`` fits a label (or source_type) that holds the value; a bare word fits a source type or container name that holds it.
    """
    out = None
    for name, patterns in mapping.items():
        hit = F.lit(False)
        for p in patterns:
            k, colon, v = p.partition(":")
            if colon:
                col = source_type if k == "source_type" else labels[k]
                hit = hit | F.coalesce(F.contains(col, F.lit(v)), F.lit(False))
            else:
                hit = hit | F.coalesce(F.contains(source_type, F.lit(p)), F.lit(False)) | F.coalesce(F.contains(labels["container_name"], F.lit(p)), F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def apply_routed(df: DataFrame, pipelines: dict[str, Pipeline], mapping: dict[str, list[str]], mode: Mode = Mode(), default: str = "default") -> DataFrame:
    """Each record through its own pipeline, in one pass: the pipelines' steps follow each other, each on its own records.
    Records that are routed to no given pipeline are left out."""
    to = route(F.col("source_type"), F.col("labels"), {k: v for k, v in mapping.items() if k in pipelines}, default)
    out = df.withColumn("__to", to).where(F.col("__to").isin(*pipelines))
    for name, p in pipelines.items():
        out = apply(out, p, mode, only=F.col("__to") == name)
    return out.withColumn("pipeline", F.col("__to")).drop("__to")
