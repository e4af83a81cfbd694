"""Continuous periods and gaps of overlapping intervals per entity.

Method: sort by start within each entity, compare each start with the running
maximum of the previous ends, label islands cumulatively, aggregate the periods
and derive the gaps.

Defined results: half-open intervals; touching ones join; an interval that does
not end after its start covers nothing; a null end is open; a null start or a
null in a key covers nothing; repeated intervals count once; an empty input
gives no row. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..skew import HOT_ROWS, hint, with_slices

OPEN = (1 << 63) - 1


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str, hot_rows: int = HOT_ROWS, count_from: DataFrame | None = None) -> DataFrame:
    """(keys, kind, start_us, end_us) of integer intervals; an open end is -1.

    Rows of one start are reduced to their largest end before the shuffle.
    An entity with more than ``hot_rows`` rows is cut along ``start`` into
    slices; each slice is scanned on its own and takes over the largest end and
    the last island of the slices before it (at most one row per slice).
    ``count_from`` may give a cheaper relation with the keys to count entities in.
    """
    k = [f"_k{i}" for i in range(len(keys))]
    named = [F.col(a).alias(b) for a, b in zip(keys, k)]
    iv = (
        df.select(*named, F.col(start).alias("_s"), F.coalesce(F.col(end), F.lit(OPEN)).alias("_e"))
        .filter(" and ".join(f"{c} is not null" for c in k) + " and _s is not null and _e > _s")
        .groupBy(*k, "_s")
        .agg(F.max("_e").alias("_e"))
    )
    iv, slices = with_slices(iv, k, "_s", hot_rows, None if count_from is None else count_from.select(*named))
    group = [*k, "_slice"] if slices else k
    before = Window.partitionBy(*group).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*group).orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*k).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    if slices:
        # the slice is part of the grouping, and of the placement, of every row
        iv = iv.repartition(*group)

    def of_slices_before(value: str) -> DataFrame:
        """iv with ``_before``: the largest ``value`` of the slices before a row's own."""
        most = iv.filter("_slice > 0").groupBy(*group).agg(F.max(value).alias("_m")).withColumn("_before", F.max("_m").over(earlier))
        most = most.select(*[F.col(c).alias(f"_c{c}") for c in group], "_before")
        return iv.join(hint(most, slices), [F.col(c) == F.col(f"_c{c}") for c in group], "left").drop(*[f"_c{c}" for c in group])

    prev = F.max("_e").over(before)
    if slices:
        iv = of_slices_before("_e")
        prev = F.greatest(prev, F.col("_before"))
    iv = iv.withColumn("_prev", prev).drop("_before")
    iv = iv.withColumn("_new", F.col("_prev").isNull() | (F.col("_s") > F.col("_prev")))
    iv = iv.withColumn("_island", F.max(F.when(F.col("_new"), F.col("_s"))).over(upto))
    if slices:
        iv = of_slices_before("_island").withColumn("_island", F.coalesce("_island", "_before")).drop("_before")
    # a period and the gap before it come out of one aggregation
    isl = iv.groupBy(*k, "_island").agg(F.max("_e").alias("_e"), F.max(F.when(F.col("_new"), F.col("_prev"))).alias("_gap"))
    rows = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("_island").alias("s"), F.col("_e").alias("e")),
        F.when(F.col("_gap").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.col("_gap").alias("s"), F.col("_island").alias("e"))),
    )
    out = isl.select(*k, F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r"))
    return out.select(
        *[F.col(b).alias(a) for a, b in zip(keys, k)],
        F.col("r.kind").alias("kind"),
        F.col("r.s").alias("start_us"),
        F.when(F.col("r.e") == OPEN, F.lit(-1).cast("long")).otherwise(F.col("r.e")).alias("end_us"),
    )
