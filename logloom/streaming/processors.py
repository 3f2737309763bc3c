"""Keyed state over streams: time-to-live dedup, token buckets and breakers, with the same steps as the batch folds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dedup_stream(df: DataFrame, key: str, us: str, ttl_us: int) -> DataFrame:
    """Accepted records only. State is one time per key and goes when the key has been quiet for a TTL of event time
    (``df`` needs a watermark on a column ``timestamp``)."""
    schema = df.schema

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(us, kind="stable")
        keep = []
        for t in rows[us]:
            ok = last is None or t - last > ttl_us
            last = t if ok else last
            keep.append(ok)
        state.update((int(last),))
        state.setTimeoutTimestamp(max(int(last + ttl_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield rows[keep]

    return df.groupBy(key).applyInPandasWithState(run, schema, "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def token_bucket_stream(df: DataFrame, key: str, us: str, rps: float, burst: float, quiet_ms: int = 86_400_000) -> DataFrame:
    """Every record with ``allowed``; state is the bucket's tokens and time, and goes when a key has been quiet for ``quiet_ms`` (its
    bucket is full again by then unless it refills more slowly)."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("allowed", T.BooleanType())])

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (burst, None)
        rows = pd.concat(list(batches)).sort_values(us, kind="stable")
        allowed = []
        for t in rows[us]:
            if last is not None:
                tokens = min(burst, tokens + (t - last) / 1e6 * rps)
            ok = tokens >= 1
            tokens, last = (tokens - 1 if ok else tokens), int(t)
            allowed.append(ok)
        state.update((float(tokens), last))
        state.setTimeoutDuration(max(quiet_ms, int(burst / rps * 1000) + 1))
        yield rows.assign(allowed=allowed)

    return df.groupBy(key).applyInPandasWithState(run, schema, "tokens double, last bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def breaker_stream(df: DataFrame, key: str, seconds: str, ok: str, threshold: int = 5, open_s: float = 30.0, successes: int = 3, half_open_calls: int = 3, quiet_ms: int = 86_400_000) -> DataFrame:
    """Every attempt with ``allowed`` and the breaker's ``state``, by the step of the batch operator. A key's state goes when it has
    been quiet for ``quiet_ms``."""
    from pyspark.sql import types as T

    from ..operators.reliability import BREAKER_START, breaker_step

    schema = T.StructType([*df.schema.fields, T.StructField("allowed", T.BooleanType()), T.StructField("state", T.StringType())])

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s = state.get if state.exists else BREAKER_START
        rows = pd.concat(list(batches)).sort_values([seconds, ok], kind="stable")
        said = []
        for t, good in zip(rows[seconds], rows[ok], strict=True):
            s, now = breaker_step(s, float(t), bool(good), threshold, open_s, successes, half_open_calls)
            said.append(now)
        name, fails, wins, calls, since = s
        state.update((name, int(fails), int(wins), int(calls), float(since)))
        state.setTimeoutDuration(quiet_ms)
        yield rows.assign(allowed=[x[0] for x in said], state=[x[1] for x in said])

    return df.groupBy(key).applyInPandasWithState(run, schema, "name string, fails int, wins int, calls int, since double", "append", GroupStateTimeout.ProcessingTimeTimeout)
