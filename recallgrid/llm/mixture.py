"""Mixing sources to target shares of the total size in tokens.

Method: Sainte-Laguë apportionment. The mixture is cut into equal-token blocks;
shard by shard the blocks go to the sources by highest quotients
``share / (2 * seats + 1)``, which gives integer quotas per shard. Then blocks
are selected with a seed: each source's documents stand in seeded order, one
after the other on a line of tokens that repeats as often as the source may be
repeated, and a block is an equal piece of that line; a document is in the
block that holds its middle.

Defined results: documents with a null source, of a source without target, or
without tokens take no part; sources of equal trimmed lower-case name are one;
a target without documents reaches share 0 and the other shares are scaled up;
null or negative targets count as 0, null repeat limits as 1. The total is the
largest at which no document is needed more often than its source allows, or a
smaller one if given. Ties of the seeded order are settled by document id.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .tokenizer import VOCABULARY, count_column

#: Blocks of the mixture at least, blocks of the smallest share at least, and shards they are dealt to.
BLOCKS, LEAST_BLOCKS, SHARDS = 4096, 64, 16
#: Sources that are apportioned on the driver at most.
MAX_SOURCES = 10_000


def _seats(shares: dict[str, float], seats: int) -> dict[str, int]:
    """The ``seats`` highest quotients ``share / (2 * seats won + 1)``, ties by name.

    All quotients above a bound are counted at once; the bound is halved in
    until few seats are left, which go one by one to the highest quotients. So
    the work follows the number of sources, not of seats.
    """
    above = lambda v, t: max(0, -int(-(v / t - 1) // 2))  # noqa: E731  number of quotients over t
    low, high = 0.0, max(shares.values(), default=0.0)
    won = dict.fromkeys(shares, 0)
    if not high:
        return won
    for _ in range(200):
        t = (low + high) / 2
        if t <= 0 or t in (low, high):
            break
        got = {s: above(v, t) for s, v in shares.items()}
        n = sum(got.values())
        if n <= seats:
            high, won = t, got
            if seats - n <= len(shares):
                break
        else:
            low = t
    heap = [(-v / (2 * won[s] + 1), s) for s, v in sorted(shares.items()) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(won.values())):
        _, s = heapq.heappop(heap)
        won[s] += 1
        heapq.heappush(heap, (-shares[s] / (2 * won[s] + 1), s))
    return won


def apportion(shares: dict[str, float], seats: int, room: dict[str, int]) -> dict[str, int]:
    """Seats of each source; one that has no more room leaves its seats to the others."""
    full, live = {s: 0 for s, v in shares.items() if v <= 0 or room[s] <= 0}, {s: v for s, v in shares.items() if v > 0 and room[s] > 0}
    while True:
        got = _seats(live, seats - sum(full.values())) if live else {}
        over = [s for s, n in got.items() if n >= room[s] and n > 0]
        if not any(got[s] > room[s] for s in over):
            return {s: full.get(s, got.get(s, 0)) for s in shares}
        for s in over:
            full[s] = room[s]
            del live[s]


def sainte_lague(shares: dict[str, float], seats: int, shards: int, room: dict[str, int]) -> dict[str, list[int]]:
    """Seats of each source in each shard; ``room`` is the most seats a source can fill.

    Shards are dealt one after the other: more seats never take one away, so a
    shard gets what its seats add.
    """
    out = {s: [0] * shards for s in shares}
    before, dealt = dict.fromkeys(shares, 0), 0
    for k in range(shards):
        dealt += seats // shards + (k < seats % shards)
        now = apportion(shares, dealt, room)
        for s in shares:
            out[s][k] = now[s] - before[s]
        before = now
    return out


def _source(c: str):
    return F.lower(F.trim(F.regexp_replace(F.col(c), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")))


def mixture(docs: DataFrame, targets: DataFrame, seed: int = 17, total_tokens: int | None = None, blocks: int = BLOCKS, shards: int = SHARDS, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(copies, report).

    ``copies`` has (doc_id, source, copy, shard, tokens), one row per appearance;
    ``report`` has (source, target_share, max_repeats, documents, available_tokens,
    mixed_tokens, share, most_copies, blocks), one row per target: a source that
    got no block, or no document, shows as such.

    A source may hold any part of the rows: its seeded order is cut into hash
    ranges, ranges are summed map-side, and running sums are formed within a
    range only and moved by the sums of the ranges before it.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    goal = targets.select(_source("source").alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("reps"))
    goal = goal.filter("source is not null").groupBy("source").agg(F.sum("share").alias("share"), F.max("reps").alias("reps"))
    goals = {r["source"]: (r["share"], r["reps"]) for r in goal.limit(MAX_SOURCES + 1).collect()}
    if len(goals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    wanted = spark.createDataFrame([(s,) for s in goals], "source string")
    sized = docs.select(F.col("doc_id"), _source("source").alias("source"), F.col("text")).filter("text is not null and text <> ''")
    sized = sized.join(F.broadcast(wanted), "source", "left_semi").select("doc_id", "source", count_column(spark, F.col("text"), vocabulary).alias("tokens"))
    place = F.xxhash64(F.lit(seed), F.col("doc_id"))
    # filtered after the cut: a filter on the count would have it made twice
    sized = scratch.cut(sized.withColumn("place", place)).filter("tokens > 0")
    n = sized.count()
    ranges = max(1, n // 50_000)
    sized = sized.withColumn("range", F.floor((F.col("place").cast("double") + 9.223372036854775808e18) / 1.8446744073709551616e19 * ranges).cast("int"))
    per = sized.groupBy("source", "range").agg(F.sum("tokens").alias("sum"), F.count(F.lit(1)).alias("n"))
    sums = {r["source"]: (r["t"], r["n"]) for r in per.groupBy("source").agg(F.sum("sum").alias("t"), F.sum("n").alias("n")).collect()}

    have = {s: v for s, (v, _) in goals.items() if v > 0 and goals[s][1] > 0 and sums.get(s, (0, 0))[0] > 0}
    scale = sum(have.values())
    shares = {s: v / scale for s, v in have.items()}
    most = min((sums[s][0] * goals[s][1] / v for s, v in shares.items()), default=0)
    total = int(min(most, total_tokens or most))
    # so many blocks that the smallest share gets its part of them
    fine = math.ceil(LEAST_BLOCKS / min(shares.values(), default=1.0))
    seats = max(1, min(max(blocks, fine), total))
    block = total / seats
    room = {s: int(sums[s][0] * goals[s][1] / block + 1e-9) if block else 0 for s in shares}
    quota = sainte_lague(shares, seats, shards, room)

    rows = []
    for s, per_shard in quota.items():
        ends, at = [], 0
        for q in per_shard:
            at += q
            ends.append(at)
        rows.append((s, int(sums[s][0]), int(goals[s][1]), at * block, ends))
    plan = F.broadcast(spark.createDataFrame(rows, "source string, have long, reps int, upto double, ends array<int>"))
    w = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    moved = per.withColumn("moved", F.coalesce(F.sum("sum").over(w), F.lit(0))).select("source", "range", "moved")
    inner = Window.partitionBy("source", "range").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    line = sized.withColumn("own", F.coalesce(F.sum("tokens").over(inner), F.lit(0))).join(moved, ["source", "range"])
    line = line.join(plan, "source").withColumn("start", F.col("own") + F.col("moved") + F.col("tokens") / 2)
    copies = F.least(F.col("reps"), F.ceil((F.col("upto") - F.col("start")) / F.col("have"))).cast("int")
    line = line.withColumn("copies", copies).filter("copies > 0")
    line = line.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    seat = F.floor((F.col("copy") * F.col("have") + F.col("start")) / F.lit(block))
    out = line.select("doc_id", "source", F.col("copy"), F.size(F.filter("ends", lambda e: e <= seat)).alias("shard"), "tokens")

    mixed = out.groupBy("source").agg(F.sum("tokens").alias("mixed"), F.max(F.col("copy") + 1).alias("most_copies"))
    stock = per.groupBy("source").agg(F.sum("sum").alias("available"), F.sum("n").alias("documents"))
    dealt = {s: sum(q) for s, q in quota.items()}
    goal_df = spark.createDataFrame([(s, float(v), int(r), dealt.get(s, 0)) for s, (v, r) in goals.items()], "source string, target_share double, max_repeats int, blocks long")
    report = goal_df.join(stock, "source", "left").join(mixed, "source", "left")
    # one row per target, at most MAX_SOURCES
    report = report.withColumn("whole", F.sum("mixed").over(Window.partitionBy(F.lit(1)))).select(
        "source",
        "target_share",
        "max_repeats",
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("available", F.lit(0)).alias("available_tokens"),
        F.coalesce("mixed", F.lit(0)).alias("mixed_tokens"),
        F.round(F.coalesce(F.col("mixed") / F.col("whole"), F.lit(0.0)), 6).alias("share"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        "blocks",
    )
    return out, report
