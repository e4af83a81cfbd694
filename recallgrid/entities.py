"""Standing rows of the raw tables: events, memories, runs.

Raw tables repeat rows (redelivery, retries, older states). Each function here
reduces them to the row that stands, with keys in their compared form.

Rows without an id are no events, memories or runs and are left out. Where an
id occurs with several idempotency keys, the key of its standing row counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tenant(c: str = "tenant_id") -> Column:
    return F.coalesce(F.col(c), F.lit("default"))


def micros(c: str | Column) -> Column:
    """Microseconds since 1970-01-01 UTC of a zoneless or zoned timestamp."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def subject_norm(c: str | Column) -> Column:
    """Trimmed, inner white space reduced to one blank, lower case."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " ")))


def link_norm(c: str) -> Column:
    """An id reference: trimmed, lower case, null where blank."""
    v = F.lower(F.trim(F.regexp_replace(F.col(c), r"[\s\p{Z}]+", " ")))
    return F.when(v != "", v)


def retries(ep: DataFrame) -> DataFrame:
    """(id, canon): ids that repeat another event's idempotency key, and the id that stands.

    Only the standing row of an id is judged, so one event of each key always
    stands. The groups are reduced map-side to one row per key before any join,
    so a key that holds most rows costs one row per map task.
    """
    raw = ep.filter("id is not null").select(F.lower("id").alias("id"), tenant().alias("_t"), F.col("idempotency_key").alias("_k"), "ingested_at")
    w = Window.partitionBy("id").orderBy(F.col("ingested_at").asc_nulls_last(), "_t", "_k")
    k = raw.withColumn("_r", F.row_number().over(w)).filter("_r = 1 and _k is not null").drop("_r")
    first = (
        k.groupBy("_t", "_k")
        .agg(F.min(F.struct(F.col("ingested_at").isNull().alias("n"), "ingested_at", "id")).alias("w"), F.min("id").alias("a"), F.max("id").alias("b"))
        .filter("a <> b")
        .select("_t", "_k", F.col("w.id").alias("canon"))
    )
    return k.join(first, ["_t", "_k"]).filter("id <> canon").select("id", "canon")


def standing_events(ep: DataFrame, *cols: Column | str) -> DataFrame:
    """One row per event: the smallest ``ingested_at`` of an id or of a tenant's idempotency key.

    Returns ``id`` (lower case) and ``cols``. The ranking keeps one row per id
    in each map task (window group limit) before the shuffle.
    """
    picked = ep.filter("id is not null").select(F.lower("id").alias("id"), F.col("ingested_at").alias("_ing"), *cols)
    w = Window.partitionBy("id").orderBy(F.col("_ing").asc_nulls_last())
    one = picked.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_ing")
    return one.join(retries(ep).select("id"), "id", "left_anti")


def standing_memories(mem: DataFrame, *cols: Column | str) -> DataFrame:
    """One row per memory id: the largest ``version``, then the latest ``updated_at``."""
    picked = mem.filter("id is not null").select(F.lower("id").alias("id"), F.col("version").alias("_v"), F.col("updated_at").alias("_u"), *cols)
    w = Window.partitionBy("id").orderBy(F.col("_v").desc_nulls_last(), F.col("_u").desc_nulls_last())
    return picked.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_v", "_u")


def standing_runs(runs: DataFrame, *cols: Column | str) -> DataFrame:
    """One row per run id: the latest ``updated_at``."""
    picked = runs.filter("id is not null").select(F.lower("id").alias("id"), F.col("updated_at").alias("_u"), *cols)
    w = Window.partitionBy("id").orderBy(F.col("_u").desc_nulls_last())
    return picked.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_u")
