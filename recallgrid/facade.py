"""The embedded API: open, remember, add, recall, all, flush, on a snapshot store."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import hashed_embedding
from .functions.text import fact_list
from .operators import cognition, ranking, vectors
from .sources.store import SnapshotStore

MEMORY = (
    "id string, tenant_id string, user_id string, agent_id string, session_id string, subject string, content string, importance double, valid_from timestamp, valid_to timestamp, "
    "state string, supersedes string, source_event_ids array<string>, version long, created_at timestamp, updated_at timestamp, metadata string, mem_type string"
)
#: A stored memory has the vector of its text.
STORED = MEMORY + ", embedding array<float>"


class Memory:
    """Memories of one user in a folder.

    Adds are collected and planned as one batch on ``flush``; ``recall`` and
    ``all`` flush first. ``now`` may be injected for tests.
    """

    def __init__(self, spark: SparkSession, path: str, tenant: str = "default", user: str | None = None, embedder=hashed_embedding, now=None, merge_at: float = 0.92):
        self.merge_at = merge_at
        self.spark, self.store, self.tenant, self.user, self.embedder = spark, SnapshotStore(spark, path), tenant, user, embedder
        self.now = now or (lambda: datetime.now(timezone.utc))
        self.pending: list[tuple] = []

    @classmethod
    def open(cls, spark: SparkSession, path: str, **kw) -> "Memory":
        return cls(spark, path, **kw)

    def _table(self) -> DataFrame:
        if not self.store.current("memories"):
            return self.spark.createDataFrame([], STORED)
        df = self.store.read("memories")
        if "embedding" in df.columns:
            return df
        # a table from before vectors were stored gets them here, and keeps them with the next commit
        return df.withColumn("embedding", self.embedder("content") if self.embedder else F.lit(None).cast("array<float>"))

    def add(self, content: str, subject: str | None = None, importance: float | None = None, metadata: str | None = None, mem_type: str | None = None) -> str:
        ident = str(uuid.uuid4())
        subj = " ".join(subject.lower().split()) if subject else None
        if any(p[1] == subj for p in self.pending if subj):
            self.flush()  # one add per subject and batch, in order
        self.pending.append((ident, subj or None, content, importance, metadata, mem_type))
        return ident

    def remember(self, text: str, extract=None) -> list[str]:
        """Facts of a text, or the text itself. ``extract(text)`` may return a model's answer with a JSON list."""
        facts = None
        if extract is not None:
            row = self.spark.createDataFrame([(extract(text),)], "t string").select(fact_list("t").alias("f")).first()
            facts = row["f"]
        return [self.add(f["content"], f["subject"]) for f in facts] if facts else [self.add(text)]

    def flush(self) -> DataFrame | None:
        """Plan and commit the collected adds; the outcomes are returned."""
        if not self.pending:
            return None
        now = F.lit(self.now())
        rows = [(i, self.tenant, self.user, None, None, s, c, imp, [], md, t) for i, s, c, imp, md, t in self.pending]
        new = self.spark.createDataFrame(rows, "id string, tenant_id string, user_id string, agent_id string, session_id string, subject string, content string, importance double, source_event_ids array<string>, metadata string, mem_type string")
        self.pending = []
        mem = self._table()
        new = new.withColumn("embedding", self.embedder("content") if self.embedder else F.lit(None).cast("array<float>"))
        keyed = cognition.plan_subject_adds(mem, new.filter("subject is not null").drop("embedding"), now)
        # vectors are made once, when a text comes in, and stored
        keyed = keyed.drop("embedding").join(new.select("id", F.col("embedding").alias("_e")), "id", "left").join(mem.select("id", F.col("embedding").alias("_o")), "id", "left")
        keyed = keyed.withColumn("embedding", F.coalesce("_e", "_o"))
        plain = cognition.plan_similar_adds(mem, new.filter("subject is null"), now, self.merge_at)
        changed = keyed.select(*mem.columns, "outcome").unionByName(plain)
        self.store.append_log("memory_changes", changed.select("id", "tenant_id", "user_id", "outcome", "subject"))
        v = self.store.commit("memories", cognition.apply_rows(mem, changed))
        return self.store.read("memories", v).join(changed.select("id", "outcome"), "id")

    def recall(self, query: str, k: int = 5) -> list[dict]:
        """Hybrid search: words and vectors, fused and blended with importance and recency."""
        self.flush()
        act = self._table().filter(cognition.in_scope(self.tenant, self.user)).filter("state = 'active'")
        if not query.strip() or k <= 0:
            return [{**r.asDict(), "score": 0.0} for r in act.orderBy(F.desc("importance"), F.desc("valid_from"), "id").limit(max(k, 1)).collect()]
        q = self.spark.createDataFrame([("q", query)], "query_id string, query string")
        hits = hybrid(act, q, self.embedder, F.lit(self.now()), pool=max(50, k))
        rows = hits.orderBy(F.desc("score"), "id").limit(k).join(act, "id").orderBy(F.desc("score"), "id").collect()
        return [r.asDict() for r in rows]

    def all(self) -> list[dict]:
        self.flush()
        return [r.asDict() for r in self._table().filter(cognition.in_scope(self.tenant, self.user)).filter("state = 'active'").orderBy("created_at", "id").collect()]


def hybrid(memories: DataFrame, queries: DataFrame, embedder, now, pool: int = 50, weights: tuple[float, float] = (1.0, 1.0), edges: DataFrame | None = None, blend: tuple[float, float] = (0.3, 0.2), postings: ranking.Postings | None = None) -> DataFrame:
    """(query_id, id, score) of many queries: word, vector and graph rankings, fused, cut to a pool, blended.

    Memories with an ``embedding`` column are searched by it; without one their texts are embedded here. ``postings``
    of the memories save reading the texts.
    """
    lex = ranking.ranked(postings.search(queries) if postings else ranking.bm25(memories, "id", "content", queries), "query_id", "id", "score")
    arms = [(lex, weights[1])]
    if embedder is not None:
        store = memories.select("id", "embedding" if "embedding" in memories.columns else embedder("content").alias("embedding"))
        vec = vectors.knn(store, queries.select("query_id", embedder("query").alias("embedding")), pool)
        arms.append((vec, weights[0]))
    if edges is not None:
        arms.append((ranking.ranked(ranking.graph_arm(edges, queries, "query_id", "query", memories), "query_id", "id", "score"), weights[1]))
    fused = ranking.ranked(ranking.rrf(arms, "query_id", "id"), "query_id", "id", "rrf", pool)
    m = memories.select("id", "importance", "updated_at")
    return fused.join(m, "id").select("query_id", "id", ranking.blend(F.col("rrf"), F.coalesce("importance", F.lit(0.5)), F.col("updated_at"), now, *blend).alias("score"))
