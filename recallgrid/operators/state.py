"""Versioned key-value state as an append-only log.

A log row is (tenant_id, agent_id, key, value, version, deleted, changed_at,
expires_at). Current state is a fold of the log, so writes append and any
number of keys is set, compared or deleted in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["tenant_id", "agent_id", "key"]
LOG = "tenant_id string, agent_id string, key string, value string, version bigint, deleted boolean, changed_at timestamp, expires_at timestamp"


def current(log: DataFrame, now: Column | None = None, keys: list[str] = KEY) -> DataFrame:
    """The latest entry of each key unless deleted or, with ``now``, expired (expires_at <= now).

    A group limit keeps one row per key in each map task, so hot keys are
    reduced before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("changed_at"), F.desc("version"))
    out = log.withColumn("_r", F.row_number().over(w)).filter("_r = 1 and not coalesce(deleted, false)").drop("_r")
    return out if now is None else out.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def _next(log: DataFrame, writes: DataFrame, keys: list[str], now: Column | None = None) -> DataFrame:
    have = current(log, now, keys).select(*[F.col(k).alias(f"_h{k}") for k in keys], F.col("version").alias("_have"))
    return writes.join(have, [F.col(k).eqNullSafe(F.col(f"_h{k}")) for k in keys], "left").drop(*[f"_h{k}" for k in keys])


def set_values(log: DataFrame, writes: DataFrame, now: Column, keys: list[str] = KEY) -> DataFrame:
    """Log rows of one write per key (keys, value[, ttl_seconds]); the version goes up by one, a plain set clears a TTL."""
    ttl = F.col("ttl_seconds") if "ttl_seconds" in writes.columns else F.lit(None)
    w = _next(log, writes, keys)
    ends = F.when(ttl.isNotNull(), F.timestamp_micros(F.unix_micros(now) + (ttl * 1_000_000).cast("long")))
    return w.select(*keys, "value", (F.coalesce("_have", F.lit(0)) + 1).cast("long").alias("version"), F.lit(False).alias("deleted"), now.alias("changed_at"), ends.alias("expires_at"))


def compare_and_set(log: DataFrame, writes: DataFrame, now: Column, keys: list[str] = KEY) -> DataFrame:
    """(keys, value, expected, applied, version): a write applies where the version is the expected one (0: absent)."""
    w = _next(log, writes, keys, now)
    ok = F.coalesce("_have", F.lit(0)) == F.col("expected")
    return w.select(*keys, "value", "expected", ok.alias("applied"), (F.coalesce("_have", F.lit(0)) + F.when(ok, 1).otherwise(0)).cast("long").alias("version"))


def delete_keys(log: DataFrame, wanted: DataFrame, now: Column, keys: list[str] = KEY) -> DataFrame:
    """Tombstones of version 0 for those wanted keys that exist."""
    have = current(log, None, keys)
    hit = have.join(wanted.select(*keys), keys, "left_semi")
    return hit.select(*keys, F.lit(None).cast("string").alias("value"), F.lit(0).cast("long").alias("version"), F.lit(True).alias("deleted"), now.alias("changed_at"), F.lit(None).cast("timestamp").alias("expires_at"))


def list_keys(log: DataFrame, now: Column, agent: str | None = None, limit: int | None = None, keys: list[str] = KEY) -> DataFrame:
    """Current keys in order; all of them unless a limit is asked for."""
    out = current(log, now, keys)
    if agent is not None:
        out = out.filter(F.col("agent_id") == agent)
    out = out.select(*keys).distinct().orderBy(*keys)
    return out if limit is None else out.limit(limit)


def by_prefix(log: DataFrame, prefix: str, now: Column | None = None, keys: list[str] = KEY) -> DataFrame:
    """Entries whose agent id starts with a prefix, taken literally."""
    return current(log, now, keys).filter(F.col("agent_id").startswith(prefix))


def expired(log: DataFrame, now: Column, keys: list[str] = KEY) -> DataFrame:
    """Current entries whose time has run out, as tombstones to append."""
    out = current(log, None, keys).filter(F.col("expires_at") <= now)
    return out.withColumns({"value": F.lit(None).cast("string"), "version": F.lit(0).cast("long"), "deleted": F.lit(True), "changed_at": now, "expires_at": F.lit(None).cast("timestamp")})
