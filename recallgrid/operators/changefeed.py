"""Change feeds applied through equality deletes with sequence numbers.

Method: every change gets a sequence number, its place in the order of effect.
Row values are appended to insert files, keys that cease to hold to delete
files; nothing is rewritten. A reader drops each row for whose key there is a
delete of a later sequence number.

A set (insert or update) appends its row and deletes the key's earlier rows; a
deletion deletes the earlier rows and those of its own number.

Defined results: changes take effect in order of time, at equal times by
version (nulls first); of a set and a deletion equal in both, the deletion
holds; of sets equal in both, the one that arrived first; repeated changes are
one; a null deleted flag is false; a null key field is a key of its own;
late and out-of-order arrival makes no difference; an empty feed gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch


class EqualityDeleteTable:
    """Insert files and delete files under one folder, appended batch by batch.

    ``append`` may be called with any split of the feed into batches and in any
    order; ``read`` gives the state after all of them.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path, keys
        self._k = [f"_k{i}" for i in range(len(keys))]

    def append(self, changes: DataFrame, time: str, version: str, deleted: str, offset: str) -> None:
        """Write one batch. The number is (time, version); ``_off`` only settles equal sets."""
        gone = F.coalesce(F.col(deleted), F.lit(False))
        seq = F.struct(F.col(time).alias("t"), F.col(version).alias("v"))
        # the row travels as one struct, so that no name of its columns can clash
        c = changes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], F.struct("*").alias("_row"), seq.alias("_seq"), gone.alias("_gone"), F.col(offset).alias("_off"))
        c.filter("not _gone").drop("_gone").write.mode("append").parquet(f"{self.path}/inserts")
        # a delete counts against numbers below it, one of a deletion also against its own
        c.groupBy(*self._k).agg(F.max(F.struct("_seq", "_gone")).alias("_del")).write.mode("append").parquet(f"{self.path}/deletes")

    def read(self) -> DataFrame:
        """The rows that no later delete removes, one per key.

        Deletes are reduced map-side to the last of each key, so the join meets
        at most one of them per row, and a key that holds most of the feed is
        split by the adaptive skew join.
        """
        ins = self.spark.read.parquet(f"{self.path}/inserts")
        dels = self.spark.read.parquet(f"{self.path}/deletes").groupBy(*self._k).agg(F.max("_del").alias("_del"))
        d = dels.select(*[F.col(k).alias(f"_d{k}") for k in self._k], "_del")
        later = (F.col("_del._seq") > F.col("_seq")) | ((F.col("_del._seq") == F.col("_seq")) & F.col("_del._gone"))
        cond = later
        for k in self._k:
            cond = F.col(k).eqNullSafe(F.col(f"_d{k}")) & cond
        left = ins.join(d, cond, "left_anti")
        w = Window.partitionBy(*self._k).orderBy(F.col("_off").asc_nulls_last())
        return left.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("_row.*")


def current_state(changes: DataFrame, keys: list[str], time: str, version: str, deleted: str, offset: str) -> DataFrame:
    """The current rows of a whole feed, through a table written in the shared folder."""
    scratch = Scratch(changes.sparkSession, "eqdel")
    table = EqualityDeleteTable(changes.sparkSession, scratch.root, keys)
    table.append(changes, time, version, deleted, offset)
    return table.read()
