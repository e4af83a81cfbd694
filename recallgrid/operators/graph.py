"""Temporal knowledge graph as an edge table, and algorithms on (src, dst, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import edge_id
from ..functions.text import triples
from ..session import Scratch
from .cognition import valid_at

DAMPING, ITERATIONS = 0.85, 40


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges and those of ``new`` whose id isn't there yet."""
    return edges.unionByName(new.dropDuplicates(["id"]).join(edges.select("id"), "id", "left_anti"), allowMissingColumns=True)


def functional(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Of edges that hold one at a time per key, each is closed by the next: valid_to, state, invalidated_by."""
    w = Window.partitionBy(*keys).orderBy("valid_from", "id")
    nxt = F.lead(F.struct("valid_from", "id")).over(w)
    return edges.withColumn("_n", nxt).withColumns(
        {"valid_to": F.col("_n.valid_from"), "invalidated_by": F.col("_n.id"), "state": F.when(F.col("_n").isNull(), "active").otherwise("superseded")}
    ).drop("_n")


def neighbors(edges: DataFrame, entity: str, limit: int | None = None, active_only: bool = False, at: Column | None = None) -> DataFrame:
    """Edges at an entity, heaviest first, ties by id; any state unless asked otherwise."""
    out = edges.filter((F.col("src") == entity) | (F.col("dst") == entity))
    if active_only:
        out = out.filter("state = 'active'")
    if at is not None:
        out = out.filter(valid_at(at, open_start=True))
    out = out.orderBy(F.desc("weight"), F.asc("id"))
    return out if limit is None else out.limit(limit)


def snapshot(edges: DataFrame, at: Column) -> DataFrame:
    return edges.filter(valid_at(at, open_start=True))


def subgraph(edges: DataFrame, entity: str, depth: int) -> DataFrame:
    """Distinct edges within ``depth`` hops of an entity, either direction, with the hop they are met at."""
    spark = edges.sparkSession
    scratch = Scratch(spark, "subgraph")
    reached = spark.createDataFrame([(entity, 0)], "node string, hop int")
    ends = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    front = reached
    for hop in range(1, max(depth, 1)):
        nxt = ends.join(front.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        front = scratch.cut(nxt.join(reached, "node", "left_anti").withColumn("hop", F.lit(hop)))
        reached = reached.unionByName(front)
    at = lambda c: edges.join(reached.select(F.col("node").alias(c), "hop"), c)
    both = at("src").select(*edges.columns, "hop").unionByName(at("dst").select(*edges.columns, "hop"))
    w = both.groupBy(*edges.columns).agg((F.min("hop") + 1).alias("hop"))
    return w


def degrees(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree), parallel edges counted; both ends in one aggregation."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


#: Hops after which the nodes that a path search has seen become one table.
SEEN_HOPS = 16

#: Merged edges of a graph that is ranked in memory at most (two ids and a weight each, some 10 MB).
FEW_EDGES = 100_000


def pagerank(edges: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING, few_edges: int = FEW_EDGES) -> DataFrame:
    """(node, pagerank): weights of 0 or less count 1, dangling mass is spread evenly, uniform start.

    Parallel edges are merged and normalised once. A graph of at most
    ``few_edges`` merged edges (counted) is ranked in memory; a larger one by
    joins: each step joins the ranks to the edges, sums map-side by target and
    writes the sums, which bounds the plan. Both give the same ranks.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "pagerank")
    e = edges.filter("src is not null and dst is not null").select("src", "dst", F.when(F.col("weight") <= 0, 1.0).otherwise(F.coalesce("weight", F.lit(1.0))).alias("w"))
    e = scratch.cut(e.groupBy("src", "dst").agg(F.sum("w").alias("w")))
    n_edges = e.count()
    if not n_edges:
        return spark.createDataFrame([], "node string, pagerank double")
    if n_edges <= few_edges:
        return _pagerank_small(e, iterations, damping)
    total = e.groupBy("src").agg(F.sum("w").alias("t"))
    e = scratch.cut(e.join(total, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("p")))
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    nodes = scratch.cut(nodes.join(e.select(F.col("src").alias("node")).distinct().withColumn("out", F.lit(True)), "node", "left"))
    n = nodes.count()
    rank, before = nodes.select("node", "out", F.lit(1.0 / n).alias("r")), None
    for i in range(iterations):
        if i:
            rank = scratch.cut(rank)
        lost = rank.filter("out is null").agg(F.sum("r")).first()[0] or 0.0
        flow = e.join(rank.select(F.col("node").alias("src"), "r"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("r") * F.col("p")).alias("x"))
        r = (1 - damping) / n + damping * (F.lit(lost / n) + F.coalesce("x", F.lit(0.0)))
        if before is not None:
            scratch.drop(before)
        before, rank = rank if i else None, nodes.join(flow, "node", "left").select("node", "out", r.alias("r"))
    return rank.select("node", F.col("r").alias("pagerank"))


def _pagerank_small(e: DataFrame, iterations: int, damping: float) -> DataFrame:
    import numpy as np
    import pandas as pd

    rows = e.toPandas()
    codes, names = pd.factorize(pd.concat([rows["src"], rows["dst"]]))
    s, d, w, n = codes[: len(rows)], codes[len(rows) :], rows["w"].to_numpy(float), len(names)
    out = np.bincount(s, w, n)
    p, r = w / out[s], np.full(n, 1 / n)
    for _ in range(iterations):
        r = (1 - damping) / n + damping * (r[out == 0].sum() / n + np.bincount(d, r[s] * p, n))
    return e.sparkSession.createDataFrame(pd.DataFrame({"node": names, "pagerank": r}))


def shortest_path(edges: DataFrame, src: str, dst: str) -> list[str] | None:
    """A shortest directed path, the smallest by its nodes among equals; None if there is none.

    The frontier is joined with the edges until the target is met or nothing
    new is reached, however many hops that takes; each node is reached once, so
    no paths but one per node are kept. The nodes seen are written anew every
    ``SEEN_HOPS`` hops, which bounds the plan.
    """
    if src == dst:
        return [src]
    spark = edges.sparkSession
    scratch = Scratch(spark, "path")
    links = scratch.cut(edges.filter("src is not null and dst is not null").select("src", "dst").distinct())
    front = spark.createDataFrame([(src, [src])], "node string, path array<string>")
    seen, parts = front.select("node"), []
    while True:
        step = links.join(front, links.src == front.node).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        front = scratch.cut(step.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")))
        n, path = front.agg(F.count(F.lit(1)), F.max(F.when(F.col("node") == dst, F.col("path")))).first()
        if path or not n:
            return path
        seen = seen.unionByName(front.select("node"))
        parts.append(front)
        if len(parts) >= SEEN_HOPS:
            seen = scratch.cut(seen)
            for old in parts[:-1]:
                scratch.drop(old)
            parts = [seen]


def communities(edges: DataFrame) -> DataFrame:
    """(node, community): connected components without direction, named by their smallest node.

    Large-star and small-star steps in turn until nothing changes: rounds grow
    with the logarithm of the component size, not with the diameter, and a node
    with very many neighbours is only ever reduced by a map-side minimum.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    pairs = edges.filter("src is not null and dst is not null").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    nodes = scratch.cut(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct())
    e = scratch.cut(pairs.filter("u <> v"))
    before = None
    while True:
        # large star: larger neighbours of each node are tied to its smallest neighbour
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself are tied to the smallest of them
        down = large.filter("u > v")
        m = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        old, e = e, scratch.cut(small)
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(old)
        if state == before:
            break
        before = state
    # at rest every edge leads from a node to its component's smallest node
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("community")), "node", "left").select("node", F.coalesce("community", "node").alias("community"))


def edges_on_add(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """The edge table after a batch of adds: edges of the new rows' sentences come in, those of closed rows are closed.

    ``changed`` are planned rows with ``outcome``; confirmed rows change nothing.
    """
    fresh = edges_from_memories(changed.filter("outcome <> 'Closed' and outcome <> 'Confirmed'"))
    gone = changed.filter("outcome = 'Closed'").select(F.col("id").alias("source_memory_id"), F.col("valid_to").alias("_end")).distinct()
    old = edges.join(gone, "source_memory_id", "left")
    hit = F.col("_end").isNotNull() & (F.col("state") == "active")
    old = old.withColumns({"valid_to": F.when(hit, F.col("_end")).otherwise(F.col("valid_to")), "state": F.when(hit, "superseded").otherwise(F.col("state"))}).select(*edges.columns)
    return add_edges(old, fresh)


def edges_from_memories(mem: DataFrame) -> DataFrame:
    """Edges of the simple sentences in active memories: the same text gives the same ids."""
    t = mem.filter("state = 'active'").select("id", "tenant_id", "valid_from", F.explode(triples("content")).alias("t"))
    return t.select(
        edge_id(F.col("id"), F.concat_ws("|", "t.subject", "t.relation", "t.object")).alias("id"),
        "tenant_id",
        F.col("t.subject").alias("src"),
        F.col("t.relation").alias("relation"),
        F.col("t.object").alias("dst"),
        F.lit(1.0).alias("weight"),
        F.col("id").alias("source_memory_id"),
        "valid_from",
        F.lit(None).cast("timestamp_ntz").alias("valid_to"),
        F.lit("active").alias("state"),
    )
