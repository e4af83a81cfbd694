"""Materialized views over guarded queries, and the assembly of retrieval context."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import SnapshotStore
from .sqlgate import Rejected, check


class MaterializedViews:
    """Views stored as snapshots: refreshed in full, or fed from a stream for plain aggregates."""

    def __init__(self, session: SparkSession, store: SnapshotStore):
        self.session, self.store, self.sql = session, store, {}

    def create(self, name: str, sql: str) -> int:
        if not re.fullmatch(r"[A-Za-z0-9_]+", name):
            raise Rejected("bad view name")
        check(self.session, sql)
        self.sql[name] = sql
        return self.refresh(name)

    def refresh(self, name: str) -> int:
        if name not in self.sql:
            raise KeyError(name)
        v = self.store.commit(f"mv_{name}", self.session.sql(self.sql[name]))
        self.read(name).createOrReplaceTempView(f"mv_{name}")
        return v

    def read(self, name: str) -> DataFrame:
        return self.store.read(f"mv_{name}")

    def drop(self, name: str) -> None:
        self.sql.pop(name, None)
        self.session.catalog.dropTempView(f"mv_{name}")
        self.store.files.delete(f"mv_{name}")

    def names(self) -> list[str]:
        return sorted(self.sql)

    def merge_counts(self, name: str, batch: DataFrame, keys: list[str], sums: list[str]) -> int:
        """Incremental upkeep of sums per key: a batch's own sums are added to the stored ones."""
        part = batch.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
        whole = self.read(name).select(*keys, *sums).unionByName(part) if self.store.current(f"mv_{name}") else part
        return self.store.commit(f"mv_{name}", whole.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]))


def retrieval_context(knowledge: DataFrame, recent: DataFrame, remembered: DataFrame, query_id: str = "query_id", least: float = 0.3) -> DataFrame:
    """(query_id, context): up to three sections per query.

    ``knowledge`` has (query_id, rank, source, score, content), ``remembered``
    (query_id, rank, content), ``recent`` (rank, source, event_type, ts); all
    are short rankings already.
    """

    def lines(df: DataFrame, line: Column, head: str, name: str) -> DataFrame:
        g = df.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("m"))
        return g.select(query_id, F.concat(F.lit(f"### {head}\n"), F.array_join(F.transform("m", lambda x: x["line"]), "\n")).alias(name))

    k = knowledge.filter(F.col("score") >= least)
    k = lines(k, F.concat(F.lit("- ["), F.coalesce("source", F.lit("unknown")), F.lit("] (score: "), F.format_number("score", 2), F.lit(") "), F.substring("content", 1, 300)), "Relevant knowledge (semantic search)", "a")
    m = lines(remembered, F.concat(F.lit("- "), F.substring("content", 1, 300)), "What we remember about this user", "c")
    e = recent.agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("- ["), "source", F.lit("] "), "event_type", F.lit(" (at "), F.col("ts").cast("string"), F.lit(")")).alias("line")))).alias("m"))
    e = e.select(F.when(F.size("m") > 0, F.concat(F.lit("### Recent events (episodic memory)\n"), F.array_join(F.transform("m", lambda x: x["line"]), "\n"))).alias("b"))
    return k.join(m, query_id, "full").join(F.broadcast(e)).select(query_id, F.concat_ws("\n\n", "a", "b", "c").alias("context"))


def newest(events: DataFrame, n: int = 5) -> DataFrame:
    """The newest n events with their rank (top-k, then a window over n rows)."""
    top = events.orderBy(F.desc("ts"), F.asc("id")).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("ts"), F.asc("id"))))


def cached_answers(cache: DataFrame, asked: DataFrame, now: Column, ttl_s: int = 3600, least: float = 0.95, near: int = 5) -> DataFrame:
    """(query_id, answer, how): a live entry of equal key, else of the 5 nearest in the same scope one at 0.95 or more."""
    from ..operators.vectors import knn

    live = cache.filter(F.unix_timestamp(now) - F.unix_timestamp("created_at") < ttl_s)
    exact = asked.join(live.select("key", "answer"), "key").select("query_id", "answer", F.lit("exact").alias("how"))
    rest = asked.join(exact.select("query_id"), "query_id", "left_anti")
    hit = knn(live, rest, near, id_col="key", scope="scope").filter(F.col("score") >= least)
    w = Window.partitionBy("query_id").orderBy("rank")
    best = hit.withColumn("_r", F.row_number().over(w)).filter("_r = 1").withColumnRenamed("id", "key").join(live.select("key", "answer"), "key")
    return exact.unionByName(best.select("query_id", "answer", F.lit("near").alias("how")))


def evict(cache: DataFrame, now: Column, ttl_s: int = 3600, most: int = 10_000) -> DataFrame:
    """cache without entries over their time; when more than ``most``, without those older than three quarters of it."""
    age = F.unix_timestamp(now) - F.unix_timestamp("created_at")
    limit = ttl_s if cache.count() < most else ttl_s * 3 // 4
    return cache.filter(age < limit)
