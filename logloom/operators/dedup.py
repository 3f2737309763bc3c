"""Duplicate records by hash and time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fold import fold


def hash_key(message: Column, source_id: Column, ts: Column | None = None, include_source: bool = True) -> Column:
    """SHA-256 of message, source and (if given) the minute; the source is always part of the whole key."""
    parts = [message] + [source_id] * include_source + ([F.date_format(F.date_trunc("minute", ts), "yyyy-MM-dd'T'HH:mm")] if ts is not None else [])
    return F.concat_ws("_", source_id, F.sha2(F.concat_ws("_", *parts), 256))


def ttl_dedup(df: DataFrame, key: str, micros: str, ttl_us: int, tie: str | None = None, inclusive: bool = True, out: str = "duplicate") -> DataFrame:
    """``out``: whether a record lies within the time to live of the last *accepted* one of its key.

    Duplicates don't extend the time. Exactly one TTL later is still a duplicate (``inclusive``); for cooldowns it isn't.
    """

    def step(last, t):
        if last is not None and t is not None and (t - last <= ttl_us if inclusive else t - last < ttl_us):
            return last, (True,)
        return (t if t is not None else last), (False,)

    return fold(df, [key], [micros, *([tie] if tie else [])], [micros], lambda: None, step, {out: "boolean"})


def dedup_stats(df: DataFrame, flag: str = "duplicate") -> DataFrame:
    n = F.count("*")
    return df.agg(n.alias("total"), F.count_if(flag).alias("duplicates"), F.count_if(~F.col(flag)).alias("accepted"), F.try_divide(F.count_if(flag), n).alias("duplicate_rate"))



def lru_admission(df: DataFrame, key: str, micros: str, capacity: int, shards: int = 64) -> DataFrame:
    """``cached``: whether a record's key is still in a cache of the ``capacity`` keys last used.

    The cache is split by hash of the key into ``shards`` of equal capacity, as a distributed cache is, so that the fold over each
    shard runs on its own; with one shard it is the single cache.
    """
    from collections import OrderedDict

    each = max(1, capacity // shards)

    def step(cache, k):
        hit = k in cache
        cache[k] = True
        cache.move_to_end(k)
        if len(cache) > each:
            cache.popitem(last=False)
        return cache, (hit,)

    dealt = df.withColumn("__shard", F.pmod(F.xxhash64(key), F.lit(shards)))
    return fold(dealt, ["__shard"], [micros], [key], OrderedDict, step, {"cached": "boolean"}).drop("__shard")
