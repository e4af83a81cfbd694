"""Joins that SQL engines offer beyond equality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..skew import HOT_ROWS, hint, with_slices


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, value: list[str], strict: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """left with ``value`` of the last right row of equal keys at or before ``on`` (before, if strict).

    One shuffle of the union of both sides and one window, instead of a range
    join; rows of both sides travel once. Of right rows at one time the
    largest by value stands. A key with more than ``hot_rows`` rows is cut
    along time; a slice takes over the last value of the slices before it.
    Left rows with a null key or time get nulls.
    """
    v = F.struct(*[F.col(c) for c in value])
    lcols = left.columns
    a = left.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col(on).alias("_on"), F.lit(0 if strict else 1).alias("_side"), F.struct(*lcols).alias("_row"), F.lit(None).cast(right.select(v.alias("v")).schema["v"].dataType).alias("_v"))
    b = right.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col(on).alias("_on"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), v.alias("_v"))
    keys = [f"_b{i}" for i in range(len(by))]
    whole = " and ".join(f"{k} is not null" for k in [*keys, "_on"])
    both = a.unionByName(b)
    rows, slices = with_slices(both.filter(whole), keys, "_on", hot_rows)
    group = [*keys, "_slice"] if slices else keys
    w = Window.partitionBy(*group).orderBy("_on", "_side", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_got", F.last("_v", ignorenulls=True).over(w))
    if slices:
        earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        last = rows.filter("_slice > 0 and _v is not null").groupBy(*group).agg(F.max_by("_v", F.struct("_on", "_v")).alias("_l"))
        own = rows.filter("_slice > 0").groupBy(*group).agg(F.lit(1).alias("_o"))
        carry = own.join(last, group, "left").withColumn("_carry", F.last("_l", ignorenulls=True).over(earlier)).select(*[F.col(c).alias(f"_c{c}") for c in group], "_carry")
        out = out.join(hint(carry, slices), [F.col(c) == F.col(f"_c{c}") for c in group], "left").withColumn("_got", F.coalesce("_got", "_carry"))
    out = out.filter("_row is not null").select("_row", "_got")
    rest = both.filter(f"not ({whole}) and _row is not null").select("_row", F.lit(None).cast(out.schema["_got"].dataType).alias("_got"))
    return out.unionByName(rest).select("_row.*", *[F.col(f"_got.{c}").alias(c) for c in value])


def range_join(points: DataFrame, ranges: DataFrame, by: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Points and the ranges [start, end) around them, by equality on buckets of ``width``.

    A range is listed in each bucket it touches; numbers only. For large inputs
    where a nested loop would compare all with all.
    """
    p = points.withColumn("_bucket", F.floor(F.col(at) / width).cast("long"))
    r = ranges.filter(F.col(end) > F.col(start)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor((F.col(end) - 1) / width).cast("long"))))
    return p.join(r, [*by, "_bucket"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bucket")
