"""Attributes as known at event time.

Method: entities are hashed to buckets; in each bucket an embedded DuckDB runs
an ASOF LEFT JOIN of the events on versions of the entity's current state.
The versions are made before the join: validity intervals become known at
``max(valid_from, recorded)`` and end at ``valid_to``; a sweep in order of
availability holds the intervals in force and writes a version whenever the
best of them changes, so all ties are settled and one version is in force at
any time.

Defined results: valid_from <= ts < valid_to (null is open) and recorded <= ts;
of several the latest valid_from, then the latest record, then the largest id.
Nulls in a key, in ts, valid_from or recorded match nothing. Intervals that end
before they are recorded never hold. Empty inputs give no row. Extra columns
are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..skew import HOT_ROWS, Hot, hint, hot_keys

OPEN = (1 << 63) - 1
NEVER = -(1 << 63) + 1


def state_versions(entity: np.ndarray, known: np.ndarray, until: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entity, from, row): from when on which row is in force; row -1 where none is.

    Rows must come sorted by entity and ``known``; a larger ``rank`` wins.
    O(n log n), with no more than the rows in force in memory at once.
    """
    ents, froms, rows = [], [], []
    n, i = len(entity), 0
    while i < n:
        e, heap, best = entity[i], [], -1

        def settle(upto: int, best: int) -> int:
            """Ends before ``upto``: when the row in force ends, the next best takes over."""
            while heap and until[heap[0][1]] <= upto:
                ended = int(until[heap[0][1]])
                while heap and until[heap[0][1]] <= ended:
                    heapq.heappop(heap)
                best = heap[0][1] if heap else -1
                ents.append(e), froms.append(ended), rows.append(best)
            return best

        while i < n and entity[i] == e:
            t = int(known[i])
            best = settle(t, best)
            while i < n and entity[i] == e and known[i] == t:
                if until[i] > t:
                    heapq.heappush(heap, (-int(rank[i]), i))
                i += 1
            top = heap[0][1] if heap else -1
            if top != best:
                best = top
                ents.append(e), froms.append(t), rows.append(best)
        settle(OPEN - 1, best)
    return np.array(ents, np.int64), np.array(froms, np.int64), np.array(rows, np.int64)


def _join_bucket(ev: pd.DataFrame, mem: pd.DataFrame) -> pd.DataFrame:
    if not len(ev) or not len(mem):
        return pd.DataFrame({"event_id": pd.Series([], dtype=str), "memory_id": pd.Series([], dtype=str)})
    import duckdb

    mem = mem.sort_values(["valid_from", "recorded", "memory_id"], kind="stable").reset_index(drop=True)
    rank = np.arange(len(mem))
    code, names = pd.factorize(mem["entity"])
    known = np.maximum(mem["known"].to_numpy(), NEVER)
    order = np.lexsort((known, code))
    e, f, r = state_versions(code[order].astype(np.int64), known[order], mem["until"].to_numpy()[order], rank[order])
    # of several changes at one time the last stands
    last = np.ones(len(e), bool)
    last[:-1] = (e[1:] != e[:-1]) | (f[1:] != f[:-1])
    ids = mem["memory_id"].to_numpy()[order]
    versions = pd.DataFrame({"entity": e[last], "since": f[last], "memory_id": [ids[x] if x >= 0 else None for x in r[last]]})  # noqa: F841
    where = pd.Series(np.arange(len(names)), index=names)
    events = pd.DataFrame({"event_id": ev["event_id"], "entity": ev["entity"].map(where), "ts": ev["ts"]})
    events = events[events["entity"].notna()].astype({"entity": "int64"})
    # a bucket is bounded, so nothing is spilled to a disk of the machine
    con = duckdb.connect(config={"threads": "1", "memory_limit": "500MB", "temp_directory": ""})
    try:
        con.register("events", events)
        con.register("versions", versions)
        return con.execute(
            "select e.event_id, v.memory_id from events e asof left join versions v on e.entity = v.entity and e.ts >= v.since where v.memory_id is not null"
        ).fetchdf()
    finally:
        con.close()


KEYS = ["tenant", "agent", "subject"]
_MEMORY = ["memory_id", "valid_from", "recorded", "known", "until"]


def _hot_sides(hot: Hot, ev: DataFrame, mem: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the hot entities, cut along time into slices.

    Events, beginnings and ends of intervals are ranged together, so a slice
    holds a bounded number of all three. It gets the intervals that begin or
    end in it; of those that span it wholly only the best can win, and it is
    found over a segment tree of the slices: an interval is listed at no more
    than two nodes per level, and a slice looks at one node per level.
    """
    nulls = [F.lit(None).cast(t).alias(c) for c, t in mem.select(*_MEMORY).dtypes]
    none = F.lit(None).cast(dict(ev.dtypes)["event_id"]).alias("event_id")
    rows = ev.select(*KEYS, F.lit(0).alias("kind"), F.col("ts").alias("at"), "event_id", *nulls)
    rows = rows.unionByName(mem.select(*KEYS, F.lit(1).alias("kind"), F.col("known").alias("at"), none, *_MEMORY))
    rows = rows.unionByName(mem.filter(F.col("until") < OPEN).select(*KEYS, F.lit(2).alias("kind"), F.col("until").alias("at"), none, *_MEMORY))
    cut = hot.ranged(hot.inside(rows), "at")
    own = cut.groupBy(*KEYS).agg(F.min("_slice").alias("lo"), F.max("_slice").alias("hi"))
    # repeated rows of one memory are one
    iv = cut.filter("kind > 0").groupBy(*KEYS, *_MEMORY).agg(F.min(F.when(F.col("kind") == 1, F.col("_slice"))).alias("f"), F.min(F.when(F.col("kind") == 2, F.col("_slice"))).alias("t"))
    iv = iv.join(hint(own.drop("lo"), hot.n_keys), KEYS).withColumn("t", F.coalesce("t", F.col("hi") + 1))
    edge = iv.withColumn("_slice", F.explode(F.array_distinct(F.filter(F.array("f", "t"), lambda x: x <= F.col("hi"))))).select(*KEYS, *_MEMORY, "_slice")
    levels = (hot.slices + 2).bit_length()
    node = (
        f"flatten(transform(sequence(0, {levels}), i -> transform(filter(array("
        "named_struct('ix', shiftright(f + shiftleft(1, i), i), 'odd', shiftright(f + shiftleft(1, i), i) % 2 = 1),"
        "named_struct('ix', shiftright(t, i) - 1, 'odd', shiftright(t, i) % 2 = 1)),"
        "x -> x.odd and shiftright(f + shiftleft(1, i), i) < shiftright(t, i)), x -> named_struct('lv', i, 'ix', x.ix))))"
    )
    value = F.struct("valid_from", "recorded", "memory_id", "known", "until").alias("m")
    best = iv.filter("t - f > 1").select(*KEYS, value, F.explode(F.expr(node)).alias("node")).groupBy(*KEYS, "node.lv", "node.ix").agg(F.max("m").alias("m"))
    look = own.select(*KEYS, F.explode(F.sequence("lo", "hi")).alias("_slice")).withColumn("lv", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("ix", F.expr("shiftright(_slice, lv)"))
    span = look.join(best, [*KEYS, "lv", "ix"]).groupBy(*KEYS, "_slice").agg(F.max("m").alias("m")).select(*KEYS, "m.*", "_slice")
    return cut.filter("kind = 0").select("event_id", *KEYS, F.col("at").alias("ts"), "_slice"), edge.unionByName(span)


def attributes_as_known(events: DataFrame, memories: DataFrame, rows_per_bucket: int = 50_000, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(event_id, memory_id) of ``events`` (event_id, k.., ts) and ``memories`` (memory_id, k.., valid_from, valid_to, recorded).

    Both have the key columns tenant, agent, subject and integer times. An
    entity with more than ``hot_rows`` rows of both is cut along time, so that
    a bucket holds about ``rows_per_bucket`` rows, or one slice.
    """
    full = " and ".join(f"{k} is not null" for k in KEYS)
    ev = events.filter(f"{full} and ts is not null").select("event_id", *KEYS, "ts")
    mem = memories.filter(f"{full} and valid_from is not null and recorded is not null").select(
        "memory_id", *KEYS, "valid_from", "recorded", F.greatest("valid_from", "recorded").alias("known"), F.coalesce("valid_to", F.lit(OPEN)).alias("until")
    )
    mem = mem.filter("until > known")
    hot = hot_keys(ev.select(*KEYS).unionByName(mem.select(*KEYS)).unionByName(mem.filter(F.col("until") < OPEN).select(*KEYS)), KEYS, hot_rows)
    if hot.table is None:
        ev, mem = ev.withColumn("_slice", F.lit(0)), mem.withColumn("_slice", F.lit(0))
    else:
        hot_ev, hot_mem = _hot_sides(hot, ev, mem)
        ev = hot.outside(ev).withColumn("_slice", F.lit(0)).unionByName(hot_ev)
        mem = hot.outside(mem).withColumn("_slice", F.lit(0)).unionByName(hot_mem)
    buckets = max(1, -(-hot.total // rows_per_bucket), ev.sparkSession.sparkContext.defaultParallelism)
    bucket = F.pmod(F.xxhash64(*KEYS, "_slice"), F.lit(buckets)).cast("int").alias("bucket")
    entity = F.concat_ws("\u001f", *KEYS, F.col("_slice").cast("string")).alias("entity")
    left = ev.select(bucket, "event_id", entity, "ts")
    right = mem.select(bucket, "memory_id", entity, "valid_from", "recorded", "known", "until")
    return left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInPandas(_join_bucket, "event_id string, memory_id string")
