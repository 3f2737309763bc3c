"""The engine's own configuration: loaded from YAML on the driver and checked before anything runs."""

from __future__ import annotations

import re
from urllib.parse import urlparse

import yaml

_DURATION = re.compile(r"^(\d+(?:\.\d+)?(?:ns|us|µs|ms|s|m|h))+$")
_UNIT = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
_PART = re.compile(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)")


def seconds(text: str | int | float) -> float:
    """A duration such as 1h30m, 250ms or a number of seconds."""
    if isinstance(text, (int, float)):
        return float(text)
    if not _DURATION.match(text):
        raise ValueError(f"not a duration: {text!r}")
    return sum(float(n) * _UNIT[u] for n, u in _PART.findall(text))


def load(text: str) -> dict:
    """The configuration; raises ValueError with every fault that ``faults`` finds."""
    doc = yaml.safe_load(text) or {}
    if found := faults(doc):
        raise ValueError("; ".join(found))
    return doc


def faults(doc: dict) -> list[str]:
    """What is wrong: ports, addresses, durations, limits, and a configuration without any sink."""
    out = []
    for path, value in _leaves(doc):
        name = path[-1]
        where = ".".join(path)
        if name == "port" and not (isinstance(value, int) and 0 < value < 65536):
            out.append(f"{where}: not a port")
        elif name in ("url", "endpoint") and value:
            u = urlparse(str(value))
            if u.scheme not in ("http", "https") or not u.netloc:
                out.append(f"{where}: not an http(s) address")
        elif name.endswith(("_timeout", "_interval", "_delay", "_ttl")) and value not in (None, ""):
            try:
                if seconds(value) <= 0:
                    out.append(f"{where}: not positive")
            except ValueError:
                out.append(f"{where}: not a duration")
        elif name in ("batch_size", "queue_size", "worker_count", "max_size", "max_files") and not (isinstance(value, int) and value > 0):
            out.append(f"{where}: not a positive number")
        elif name.endswith("_ratio") and not (isinstance(value, (int, float)) and 0 <= value <= 1):
            out.append(f"{where}: not between 0 and 1")
    sinks = doc.get("sinks") or {}
    if not any((s or {}).get("enabled", True) for s in sinks.values()):
        out.append("sinks: none is enabled")
    return out


def _leaves(doc, path: tuple[str, ...] = ()):
    if isinstance(doc, dict):
        for k, v in doc.items():
            yield from _leaves(v, (*path, str(k)))
    elif isinstance(doc, list):
        for i, v in enumerate(doc):
            yield from _leaves(v, (*path, str(i)))
    elif path:
        yield path, doc


def digest(doc: dict) -> str:
    """A hash that changes when the configuration does."""
    import hashlib

    return hashlib.sha256(yaml.safe_dump(doc, sort_keys=True).encode()).hexdigest()
