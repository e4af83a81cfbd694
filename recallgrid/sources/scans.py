"""Plain reads of the tables: by source, time, id, tenant; newest first; listings for upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids of an IN list at most; more are joined.
FEW_IDS = 1000


def by_source(events: DataFrame, source: str, limit: int) -> DataFrame:
    """Newest events of a source (a top-k, no full sort)."""
    return events.filter(F.col("source") == source).orderBy(F.desc("ts"), F.asc("id")).limit(limit)


def in_range(events: DataFrame, start, end) -> DataFrame:
    """Events from start to end, both included, oldest first; the bounds reach the parquet scan."""
    return events.filter(F.col("ts").between(start, end)).orderBy("ts", "id")


def by_ids(events: DataFrame, ids: list[str] | DataFrame, tenant: str | None = None) -> DataFrame:
    """Events of given ids; those of other tenants are just absent."""
    if isinstance(ids, list):
        wanted = sorted({i.lower() for i in ids})
        ids = None if len(wanted) <= FEW_IDS else events.sparkSession.createDataFrame([(i,) for i in wanted], "id string")
    out = events.filter(F.col("id").isin(wanted)) if ids is None else events.join(ids.select("id"), "id", "left_semi")
    return out if tenant is None else out.filter(F.coalesce("tenant_id", F.lit("default")) == tenant)


def of_tenant(events: DataFrame, tenant: str, limit: int = 10_000_000) -> DataFrame:
    """A tenant's events, oldest first."""
    return events.filter(F.coalesce("tenant_id", F.lit("default")) == tenant).orderBy("ts", "id").limit(min(max(limit, 1), 10_000_000))


def query(events: DataFrame, source: str | None = None, event_type: str | None = None, limit: int | None = None, newest_first: bool = True) -> DataFrame:
    """The fluent event query: optional source and type, order, limit."""
    if source is not None:
        events = events.filter(F.col("source") == source)
    if event_type is not None:
        events = events.filter(F.col("event_type") == event_type)
    out = events.orderBy(F.desc("ts") if newest_first else F.asc("ts"), "id")
    return out if limit is None else out.limit(limit)


def memory_by_id(memories: DataFrame, ident: str, tenant: str | None = None) -> DataFrame:
    out = memories.filter(F.col("id") == ident.lower())
    return out if tenant is None else out.filter(F.col("tenant_id") == tenant)


def hydrate(hits: DataFrame, memories: DataFrame) -> DataFrame:
    """Hits (id, score, …) with their memories, active ones only; the short side is joined last."""
    return memories.filter("state = 'active'").join(hits, "id")


def for_upkeep(memories: DataFrame, tenant: str | None = None, limit: int | None = None) -> DataFrame:
    """Active memories: all, longest untouched first; of one tenant, last touched first."""
    act = memories.filter("state = 'active'")
    out = act.orderBy("updated_at", "id") if tenant is None else act.filter(F.col("tenant_id") == tenant).orderBy(F.desc("updated_at"), "id")
    return out if limit is None else out.limit(limit)


def as_json(df: DataFrame) -> DataFrame:
    """Rows as JSON texts with their types: numbers and booleans as such, times and decimals as text."""
    cols = [F.col(f.name).cast("string").alias(f.name) if f.dataType.typeName() in ("decimal", "date") or "interval" in f.dataType.typeName() else F.col(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))
