"""Tables as versioned parquet snapshots, with backup, restore and tenant moves.

A commit writes a new folder and then replaces one small pointer file, so
readers see the old or the new state, never a part. Paths are Hadoop paths
(file:, s3a:, hdfs:).
"""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Files:
    """The few file operations needed, over any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}" if p else self.root)

    def write(self, p: str, data: bytes) -> None:
        """Written beside its place and then renamed over it."""
        tmp = self._path(p + ".tmp")
        out = self.fs.create(tmp, True)
        out.write(bytearray(data))
        out.close()
        opts = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        array = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        array[0] = opts
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(tmp, self._path(p), array)

    def read(self, p: str) -> bytes | None:
        if not self.fs.exists(self._path(p)):
            return None
        s = self.fs.open(self._path(p))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(s))
        finally:
            s.close()

    def names(self, p: str = "") -> list[str]:
        if not self.fs.exists(self._path(p)):
            return []
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._path(p)))

    def tree(self, p: str = "") -> list[str]:
        """Files below a folder, relative to it."""
        at = self._path(p)
        if not self.fs.exists(at):
            return []
        it, out = self.fs.listFiles(at, True), []
        base = self.fs.resolvePath(at).toString().rstrip("/") + "/"
        while it.hasNext():
            out.append(self.fs.resolvePath(it.next().getPath()).toString().removeprefix(base))
        return sorted(out)

    def delete(self, p: str) -> bool:
        return self.fs.delete(self._path(p), True)

    def copy(self, p: str, to: "Files", q: str) -> None:
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self._path(p), to.fs, to._path(q), False, True, self.spark._jsc.hadoopConfiguration())


class SnapshotStore:
    """Named tables under a root; every version stays readable until it is vacuumed."""

    def __init__(self, spark: SparkSession, root: str, schema_version: int = 1):
        self.spark, self.files, self.schema_version = spark, Files(spark, root), schema_version

    def versions(self, table: str) -> list[int]:
        return [int(n[1:]) for n in self.files.names(table) if n.startswith("v") and n[1:].isdigit()]

    def current(self, table: str) -> int | None:
        p = self.files.read(f"{table}/_current")
        return json.loads(p)["version"] if p else None

    def commit(self, table: str, df: DataFrame, partition_by: list[str] | None = None, expected: int | None = None) -> int:
        """Write the next version and point to it; with ``expected`` only if that is still the current one."""
        now = self.current(table)
        if expected is not None and now != expected:
            raise RuntimeError(f"{table} is at version {now}, not {expected}")
        v = max([0, *self.versions(table)]) + 1
        w = df.write
        (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{self.files.root}/{table}/v{v}")
        self.files.write(f"{table}/_current", json.dumps({"version": v, "schema_version": self.schema_version, "at": datetime.now(timezone.utc).isoformat()}).encode())
        return v

    def read(self, table: str, version: int | None = None) -> DataFrame:
        v = version or self.current(table)
        if v is None:
            raise KeyError(f"no table {table}")
        return self.spark.read.parquet(f"{self.files.root}/{table}/v{v}")

    def append_log(self, table: str, df: DataFrame) -> None:
        """Append to a change log, which streams read."""
        df.write.mode("append").parquet(f"{self.files.root}/{table}/log")

    def log(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.files.root}/{table}/log")

    def vacuum(self, table: str, keep: int = 2) -> int:
        """Drop all but the newest ``keep`` versions; the current one always stays."""
        old = [v for v in self.versions(table)[:-keep] if v != self.current(table)] if keep > 0 else []
        for v in old:
            self.files.delete(f"{table}/v{v}")
        return len(old)

    def tables(self) -> list[str]:
        return [n for n in self.files.names() if self.current(n)]

    # backups

    def backup(self, root: str, name: str) -> dict:
        """Copy the current versions and write a manifest with row counts and SHA-256 of every file."""
        out = Files(self.spark, f"{root.rstrip('/')}/{name}")
        counts = {}
        for t in self.tables():
            self.read(t).write.parquet(f"{out.root}/{t}")
            counts[t] = self.spark.read.parquet(f"{out.root}/{t}").count()
        manifest = {"format": 1, "counts": counts, "sha256": _digests(self.spark, out)}
        out.write("manifest.json", json.dumps(manifest, sort_keys=True).encode())
        return manifest

    def restore(self, root: str, name: str) -> dict:
        """Check every file against the manifest, then commit all tables; a mismatch changes nothing."""
        src = Files(self.spark, f"{root.rstrip('/')}/{name}")
        data = src.read("manifest.json")
        if data is None:
            raise FileNotFoundError("no manifest")
        manifest = json.loads(data)
        if _digests(self.spark, src) != manifest["sha256"]:
            raise ValueError("the backup does not match its manifest")
        for t in manifest["counts"]:
            self.commit(t, self.spark.read.parquet(f"{src.root}/{t}"))
        return manifest

    @staticmethod
    def prune_backups(spark: SparkSession, root: str, keep: int) -> list[str]:
        """Delete all but the newest ``keep`` folders that have a manifest, by name; 0 keeps all."""
        f = Files(spark, root)
        have = [n for n in f.names() if f.read(f"{n}/manifest.json") is not None]
        gone = have[:-keep] if keep else []
        for n in gone:
            f.delete(n)
        return gone

    # tenants

    def export_tenant(self, tenant: str, root: str) -> None:
        """A tenant's events, active memories and state as JSON lines."""
        for t in ("episodic", "memories", "state"):
            if self.current(t):
                df = self.read(t).filter(F.coalesce("tenant_id", F.lit("default")) == tenant)
                (df.filter("state = 'active'") if t == "memories" else df).write.mode("overwrite").json(f"{root}/{t}", ignoreNullFields=False)

    def import_tenant(self, tenant: str, root: str) -> None:
        """Add an exported tenant's rows under a tenant id; rows of equal id are replaced."""
        f = Files(self.spark, root)
        for t in ("episodic", "memories", "state"):
            if t in f.names() and self.current(t):
                have = self.read(t)
                rows = self.spark.read.schema(have.schema).json(f"{root}/{t}").withColumn("tenant_id", F.lit(tenant)).select(*have.columns)
                keys = ["id"] if "id" in have.columns else ["tenant_id", "agent_id", "key"]
                self.commit(t, have.join(rows.select(*keys), keys, "left_anti").unionByName(rows))

    def move_tenant(self, tenant: str, to: "SnapshotStore", memories_only: bool = False) -> None:
        """Move a tenant to another store: memories only, or everything.

        A table's rows are copied, counted there, and only then removed here; rows of
        the tenant that an interrupted move left there are replaced, so it may be repeated.
        """
        for t in ["memories"] if memories_only else self.tables():
            have = self.read(t)
            if "tenant_id" not in have.columns:
                continue
            mine = F.coalesce("tenant_id", F.lit("default")) == tenant
            rows = have.filter(mine)
            before = to.read(t).filter(~mine | ~F.lit(self._started(to, t, tenant))) if to.current(t) else None
            self.files.write(f"{t}/_moving", json.dumps({"tenant": tenant, "to": to.files.root}).encode())
            v = to.commit(t, rows if before is None else before.unionByName(rows))
            if to.read(t, v).count() != rows.count() + (0 if before is None else before.count()):
                raise RuntimeError(f"the copy of {t} is not whole")
            self.commit(t, have.filter(~mine))
            self.files.delete(f"{t}/_moving")

    def _started(self, to: "SnapshotStore", table: str, tenant: str) -> bool:
        """Whether a move of the tenant's table to that store began and did not end."""
        data = self.files.read(f"{table}/_moving")
        return data is not None and json.loads(data) == {"tenant": tenant, "to": to.files.root}


def _digests(spark: SparkSession, files: Files) -> dict[str, str]:
    """SHA-256 of data files, computed where they are read; the manifest itself is left out."""
    names = [n for n in files.tree() if n.endswith(".parquet")]
    root = files.root if "://" in files.root else "file://" + files.root

    def digest(rows):
        from pyarrow import fs

        for r in rows:
            at, path = fs.FileSystem.from_uri(f"{root}/{r.name}")
            h = hashlib.sha256()
            with at.open_input_stream(path) as f:
                while part := f.read(1 << 22):
                    h.update(part)
            yield r.name, h.hexdigest()

    # a row per file: as many as the manifest lists; files are read in parts, of any size
    table = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, min(len(names), 200)))
    return dict(sorted(table.rdd.mapPartitions(digest).collect())) if names else {}


class ObjectStore:
    """put, get, delete and list of blobs by key, on any Hadoop path."""

    def __init__(self, spark: SparkSession, root: str):
        self.files = Files(spark, root)

    def put(self, key: str, data: bytes) -> str:
        self.files.write(self._safe(key), data)
        return hashlib.sha256(data).hexdigest()

    def get(self, key: str) -> bytes | None:
        return self.files.read(self._safe(key))

    def delete(self, key: str) -> bool:
        return self.files.delete(self._safe(key))

    def list(self, prefix: str = "") -> list[str]:
        return [n for n in self.files.tree() if n.startswith(prefix) and not n.endswith(".crc")]

    @staticmethod
    def _safe(key: str) -> str:
        if not key or key.startswith("/") or ".." in key.split("/"):
            raise ValueError(f"bad key {key!r}")
        return key


class Attachments:
    """Blobs with a metadata table (id, tenant_id, memory_id, content_type, filename, size, storage_key, created_at)."""

    SCHEMA = "id string, tenant_id string, memory_id string, content_type string, filename string, size long, storage_key string, created_at timestamp"

    def __init__(self, spark: SparkSession, store: SnapshotStore, objects: ObjectStore):
        self.spark, self.store, self.objects = spark, store, objects

    def table(self) -> DataFrame:
        return self.store.read("attachments") if self.store.current("attachments") else self.spark.createDataFrame([], self.SCHEMA)

    def put(self, ident: str, tenant: str, data: bytes, content_type: str, now: datetime, memory_id: str | None = None, filename: str | None = None) -> None:
        key = f"{tenant}/{ident}"
        self.objects.put(key, data)
        row = self.spark.createDataFrame([(ident, tenant, memory_id, content_type, filename, len(data), key, now)], self.SCHEMA)
        self.store.commit("attachments", self.table().filter(F.col("id") != ident).unionByName(row))

    def get(self, ident: str, tenant: str) -> bytes | None:
        r = self.table().filter((F.col("id") == ident) & (F.col("tenant_id") == tenant)).first()
        return self.objects.get(r["storage_key"]) if r else None

    def list(self, tenant: str, memory_id: str | None = None) -> DataFrame:
        out = self.table().filter(F.col("tenant_id") == tenant)
        return (out if memory_id is None else out.filter(F.col("memory_id") == memory_id)).orderBy(F.desc("created_at"), "id")

    def delete(self, ident: str, tenant: str) -> bool:
        r = self.table().filter((F.col("id") == ident) & (F.col("tenant_id") == tenant)).first()
        if r:
            self.store.commit("attachments", self.table().filter(F.col("id") != ident))
            self.objects.delete(r["storage_key"])
        return r is not None


AUDIT = "timestamp timestamp, tenant string, actor string, action string, target string, detail string"


def append_audit(store: SnapshotStore, rows: DataFrame) -> None:
    """Append audit rows (columns of AUDIT, missing ones null) to the store's log; rows without a time or action are an error."""
    from pyspark.sql.types import StructType

    kinds = {f.name: f.dataType for f in StructType.fromDDL(AUDIT).fields}
    full = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
    sound = F.assert_true(F.col("timestamp").isNotNull() & F.col("action").isNotNull(), "an audit row needs a time and an action").isNull()
    store.append_log("audit", full.filter(sound))


def audit_since(audit: DataFrame, since, tenant: str | None = None) -> DataFrame:
    """Audit rows from a time on, oldest first."""
    out = audit.filter(F.col("timestamp") >= since)
    return (out if tenant is None else out.filter(F.col("tenant") == tenant)).orderBy("timestamp")
