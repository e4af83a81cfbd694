"""Structured Streaming: change logs, event-time windows, stateful upkeep, sinks, loops."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def follow(spark: SparkSession, path: str, schema, tenant: str | None = None, agent: str | None = None, max_files: int | None = None) -> DataFrame:
    """A change log folder as a stream, filtered for a watcher. Nothing is dropped when a reader lags."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    s = r.parquet(path)
    if tenant is not None:
        s = s.filter(F.col("tenant_id") == tenant)
    if agent is not None:
        s = s.filter(F.col("agent_id") == agent)
    return s


def window_counts(events: DataFrame, ts: str, keys: list[str], length: str, slide: str | None = None, late: str | None = None, value: str | None = None) -> DataFrame:
    """Tumbling or sliding windows of event time; batch or stream. ``late`` sets the watermark."""
    src = events.withWatermark(ts, late) if late and events.isStreaming else events
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    aggs = [F.count(F.lit(1)).alias("n"), *([F.sum(value).alias("total")] if value else [])]
    return src.groupBy(w.alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *[F.col("n"), *([F.col("total")] if value else [])])


def session_counts(events: DataFrame, ts: str, keys: list[str], gap: str, late: str | None = None) -> DataFrame:
    """Session windows closed by a gap (an event exactly at the gap begins a new one)."""
    src = events.withWatermark(ts, late) if late and events.isStreaming else events
    return src.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def first_by_key(events: DataFrame, ts: str, key: str, late: str) -> DataFrame:
    """Streaming idempotency: one event per key within the watermark; null keys all pass.

    Null keys get a key of their own, so one stateful operator serves both.
    """
    k = F.coalesce(F.col(key), F.concat(F.lit("\u0000"), F.expr("uuid()")))
    return events.withColumn("_k", k).withWatermark(ts, late).dropDuplicatesWithinWatermark(["_k"]).drop("_k")


def resolve_stream(adds: DataFrame, key: str, content: str, order: str) -> DataFrame:
    """Contradictions on a stream: the state of a key is its active content.

    Gives (key, seq, content, outcome, version, supersedes) with the outcomes
    Inserted, Confirmed and Superseded, in the order of ``order`` (a number)
    within each batch of a key.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active = state.get if state.exists else (None, None, 0)
        text, seq, version = active
        out = []
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        for s, c in zip(rows["seq"], rows["content"]):
            s = int(s)
            if text is None and seq is None:
                out.append((k[0], s, c, "Inserted", 1, None))
                text, seq, version = c, s, 1
            elif (c or "").strip() == (text or "").strip():
                version += 1
                out.append((k[0], seq, text, "Confirmed", version, None))
            else:
                out.append((k[0], s, c, "Superseded", 1, seq))
                text, seq, version = c, s, 1
        state.update((text, seq, version))
        yield pd.DataFrame(out, columns=["key", "seq", "content", "outcome", "version", "supersedes"]).astype({"supersedes": "Int64"})

    src = adds.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content"), F.col(order).cast("long").alias("seq"))
    return src.groupBy("key").applyInPandasWithState(
        step, "key string, seq long, content string, outcome string, version long, supersedes long", "content string, seq long, version long", "append", GroupStateTimeout.NoTimeout
    )


def post_changes(url: str, stream_name: str, attempts: int = 3, first_wait_s: float = 0.2, send=None):
    """A foreachBatch function that posts each change as JSON; after the attempts a change is dropped.

    Waits double between attempts. ``send(url, body)`` may replace the HTTP call.
    """

    def http(u: str, data: bytes) -> None:
        req = urllib.request.Request(u, data, {"Content-Type": "application/json"})
        with urllib.request.urlopen(req, timeout=10) as r:
            if r.status >= 300:
                raise OSError(r.status)

    call = send or http

    def rows(it):
        for r in it:
            data = json.dumps({"stream": stream_name, "event": r.asDict(recursive=True)}, default=str).encode()
            for i in range(attempts):
                try:
                    call(url, data)
                    break
                except OSError:
                    if i + 1 < attempts:
                        time.sleep(first_wait_s * 2**i)

    def batch(df: DataFrame, _: int) -> None:
        df.foreachPartition(rows)

    return batch


def every(df: DataFrame, step, checkpoint: str, interval: str | None = None):
    """Run ``step(batch, id)`` over a stream: at an interval, or once over what is there."""
    w = df.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


def upkeep(store, now: Column, policies: DataFrame, default_days: int = 365, backups: str | None = None, keep: int = 0, half_life_days: float | None = None, name: str | None = None, embedder=None, text: Column | None = None) -> dict[str, int]:
    """One pass of the lifecycle: retention, expiry of state, decay, vectors of events that have none, a backup. Scheduled from outside."""
    from ..operators import cognition, runs, state
    from ..sources.ingest import reindex

    out = {}
    if store.current("episodic"):
        ev = store.read("episodic")
        kept = runs.retained(ev, policies, now, default_days)
        out["events"] = ev.count() - kept.count()
        if out["events"]:
            store.commit("episodic", kept)
    if store.current("state"):
        log = store.read("state")
        gone = state.expired(log, now)
        out["state"] = gone.count()
        if out["state"]:
            store.commit("state", log.unionByName(gone.select(*log.columns)))
    if half_life_days and store.current("memories"):
        mem = store.read("memories")
        after = cognition.forget(mem, now, half_life_days)
        out["memories"] = after.filter("state = 'expired'").count() - mem.filter("state = 'expired'").count()
        if out["memories"]:
            store.commit("memories", after)
    if embedder is not None and store.current("episodic"):
        have = store.read("event_vectors") if store.current("event_vectors") else store.spark.createDataFrame([], "id string, embedding array<float>")
        new = reindex(store.read("episodic"), have, F.col("payload") if text is None else text, embedder)
        v = store.commit("event_vectors", have.unionByName(new))
        out["vectors"] = store.read("event_vectors", v).count() - have.count()
    if backups and name:
        store.backup(backups, name)
        store.prune_backups(store.spark, backups, keep)
    return out
