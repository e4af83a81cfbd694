"""Session set-up, table loading and scratch space shared by all executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects: UTC, AQE, Arrow."""
    b = SparkSession.builder.appName("recallgrid")
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors this package as a zip; in local mode only where their Python doesn't find it already."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    seen = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    local = sc.master == "local" or sc.master.startswith("local[")
    if getattr(ship, "_done", None) == sc.applicationId or local and (root in seen or os.getcwd() == root):
        return
    ship._done = sc.applicationId
    at = os.path.join(tempfile.mkdtemp(prefix="recallgrid-ship-"), "recallgrid.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "recallgrid")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(at)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder. Times carry no zone and are read as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def file_state(spark: SparkSession, sf_dir: str, table: str) -> tuple:
    """What tells one state of a table's file from another within a session: for things derived from it and kept."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
    at = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    return (spark.sparkContext.applicationId, sf_dir, table, at.getModificationTime(), at.getLen())


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent, a local master gets a temporary folder; on a
    cluster that is an error, since a machine-local folder would not be shared.
    """
    sc = spark.sparkContext
    own = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(checkpoint_dir, "_made", None)
    if not made:
        made = checkpoint_dir._made = tempfile.mkdtemp(prefix="recallgrid-")
        atexit.register(lambda: __import__("shutil").rmtree(made, ignore_errors=True))
    return "file://" + made


class Scratch:
    """Written intermediate tables in the shared folder.

    ``cut(df)`` writes df as parquet and reads it back: the lineage ends there,
    and the loss of an executor costs no recomputation of earlier steps.
    """

    _live: list["Scratch"] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        if not Scratch._live:
            atexit.register(Scratch._sweep)
        Scratch._live.append(self)

    def cut(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        self._delete(getattr(df, "_scratch_path", None))

    def _delete(self, path: str | None) -> None:
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    @staticmethod
    def _sweep() -> None:
        for s in Scratch._live:
            try:
                s._delete(s.root)
            except Exception:
                local = s.root.removeprefix("file://")
                if os.path.isdir(local):
                    __import__("shutil").rmtree(local, ignore_errors=True)
