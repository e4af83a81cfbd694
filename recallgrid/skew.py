"""Splitting hot keys along an ordered column, so that no ordered group lands in one task.

A key is hot with more than ``limit`` rows, whatever the size of the data, so
there are at most ``rows / limit`` of them. Their rows are range-partitioned by
key and order; the partition is the slice. Nothing is collected: hot keys and
slices are tables, which are broadcast only up to FEW rows and joined beyond.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import Scratch

#: Rows of one key from which its group is cut into slices, and the rows of a slice.
HOT_ROWS = 500_000
#: Rows of a table of hot keys or slices that is broadcast at most (some MB).
FEW = 100_000


def hint(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast where its counted rows are few."""
    return F.broadcast(df) if rows <= FEW else df


@dataclass
class Hot:
    """The hot keys of a relation: a written table of the keys as _h0, _h1, …; their number; rows; rows of all keys."""

    keys: list[str]
    table: DataFrame | None
    n_keys: int
    rows: int
    total: int
    limit: int

    def _join(self, df: DataFrame, how: str) -> DataFrame:
        on = [df[k].eqNullSafe(self.table[f"_h{i}"]) for i, k in enumerate(self.keys)]
        return df.join(hint(self.table, self.n_keys), on, how)

    def inside(self, df: DataFrame) -> DataFrame:
        return self._join(df, "left_semi")

    def outside(self, df: DataFrame) -> DataFrame:
        return self._join(df, "left_anti")

    @property
    def slices(self) -> int:
        """Twice as many as the rows need, since the bounds come from samples."""
        return 2 * math.ceil(self.rows / self.limit)

    def ranged(self, df: DataFrame, order: str, *ties: Column) -> DataFrame:
        """Rows of hot keys with ``_slice`` from 1, growing with key and order; written, so that a row keeps its slice."""
        out = df.repartitionByRange(self.slices, *self.keys, order, *ties).withColumn("_slice", F.spark_partition_id() + 1)
        return Scratch(df.sparkSession, "slices").cut(out)


def hot_keys(df: DataFrame, keys: list[str], limit: int = HOT_ROWS) -> Hot:
    """The keys with more than ``limit`` rows; counts are made map-side."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, most = n.agg(F.sum("_n"), F.max("_n")).first()
    if not total or most <= limit:
        return Hot(keys, None, 0, 0, total or 0, limit)
    table = Scratch(df.sparkSession, "hot").cut(n.filter(F.col("_n") > limit).select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], "_n"))
    n_keys, rows = table.agg(F.count(F.lit(1)), F.sum("_n")).first()
    return Hot(keys, table.drop("_n"), n_keys, rows, total, limit)


def with_slices(df: DataFrame, keys: list[str], order: str, limit: int = HOT_ROWS, count_from: DataFrame | None = None, ties: tuple[Column, ...] = ()) -> tuple[DataFrame, int]:
    """(df with ``_slice``, number of slices): slice 0 for keys that aren't hot.

    ``count_from`` may give a cheaper relation to count keys in. Rows of equal
    key, order and ``ties`` share a slice. Where keys are hot, df is read twice.
    """
    hot = hot_keys(df if count_from is None else count_from, keys, limit)
    if hot.table is None:
        return df.withColumn("_slice", F.lit(0)), 0
    cold = hot.outside(df).withColumn("_slice", F.lit(0))
    return cold.unionByName(hot.ranged(hot.inside(df), order, *ties)), hot.slices + hot.n_keys
