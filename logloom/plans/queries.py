"""All registered queries of the log engine."""

from __future__ import annotations

from . import queries_metrics, queries_records  # noqa: F401
from .queries_metrics import records_per_topic  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
