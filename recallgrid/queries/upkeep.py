"""Operators of stores, ledgers, scopes and scalars over the reference tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..entities import micros, standing_events, standing_runs, tenant
from ..functions import scalars, text
from ..operators import cognition, graph, lexical, ranking, runs, state, vectors
from ..plans.sqlgate import Rejected, check, run_sql, substitute, tenant_session
from ..plans.views import MaterializedViews
from ..session import Scratch, load
from ..sources import ingest, scans
from ..sources.store import SnapshotStore, append_audit, audit_since
from ..streaming import flows
from .memory import edges, events, memories, state_log

NOW = "2018-03-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _store(spark: SparkSession, name: str) -> SnapshotStore:
    return SnapshotStore(spark, Scratch(spark, name).root)


def _counting(c):
    """An embedder in native expressions: length, words and vowels of a text."""
    t = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.array(F.length(t), F.size(text.words(t)), F.length(F.regexp_replace(t, "[^aeiou]", ""))).cast("array<float>")


# sources and sinks


def log_append(spark: SparkSession, d: str) -> DataFrame:
    """The events appended to a log in two parts, and read back."""
    s, ev = _store(spark, "log"), events(spark, d).select("id", "source")
    s.append_log("events", ev.filter(F.xxhash64("id") % 2 == 0))
    s.append_log("events", ev.filter(F.xxhash64("id") % 2 != 0))
    return s.log("events")


def ingest_stored(spark: SparkSession, d: str) -> DataFrame:
    """The events ingested before February are stored; the raw log arrives again as one batch: what is appended, with vectors."""
    b = load(spark, d, "episodic").select(F.lower("id").alias("id"), tenant().alias("tenant_id"), "source", "idempotency_key", "ingested_at", "payload")
    early = b.filter(F.col("ingested_at") < F.lit("2018-01-20").cast("timestamp_ntz"))
    stored = Scratch(spark, "stored").cut(ingest.new_events(early.limit(0), early, "ingested_at"))
    out = ingest.ingest(stored, b, "ingested_at", F.col("payload"), _counting)
    return out.select("id", "embedded", F.col("embedding")[0].cast("long").alias("n"))


def reindex_pending(spark: SparkSession, d: str) -> DataFrame:
    """Vectors for the events that no memory cites yet, by source."""
    ev = events(spark, d)
    have = load(spark, d, "memories").select(F.explode("source_event_ids").alias("id")).select(F.lower("id").alias("id")).distinct()
    new = ingest.reindex(ev, have, F.col("payload"), _counting)
    return new.join(ev.select("id", "source"), "id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("embedding")[1].cast("long")).alias("words"))


def memory_reembed(spark: SparkSession, d: str) -> DataFrame:
    """New vectors for all active memories."""
    m = ingest.embed(memories(spark, d).filter("state = 'active'"), F.col("content"), _counting)
    return m.select("id", *[F.col("embedding")[i].cast("long").alias(f"v{i}") for i in range(3)])


def tenant_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tenant and session from the payload."""
    e = load(spark, d, "events")
    p = F.when(F.col("user_id") % 3 == 0, F.format_string('{"_tenant_id":"t%d","_session_id":"s%d"}', "user_id", "event_id")).otherwise(F.lit('{"x":1}'))
    return ingest.tagged(e.select("event_id", p.alias("payload"))).select("event_id", "tenant_id", "session_id")


def events_by_ids(spark: SparkSession, d: str) -> DataFrame:
    """The default tenant's events that memories cite."""
    ids = load(spark, d, "memories").select(F.explode("source_event_ids").alias("id")).select(F.lower("id").alias("id")).distinct()
    return scans.by_ids(events(spark, d), ids, "default").select("id", "source")


def tenant_events(spark: SparkSession, d: str) -> DataFrame:
    return scans.of_tenant(events(spark, d), "nordwerk").select("id", micros("ts").alias("us"))


def range_scan(spark: SparkSession, d: str) -> DataFrame:
    return scans.in_range(events(spark, d), F.lit("2018-01-10").cast("timestamp_ntz"), F.lit("2018-01-12").cast("timestamp_ntz")).select("id", micros("ts").alias("us"))


def memory_lookup(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d)
    return scans.memory_by_id(m, m.agg(F.min("id")).first()[0] or "").select("id", "content", "state", "version")


def upkeep_listing(spark: SparkSession, d: str) -> DataFrame:
    return scans.for_upkeep(memories(spark, d), "default").select("id", micros("updated_at").alias("us"))


def fluent_query(spark: SparkSession, d: str) -> DataFrame:
    return scans.query(events(spark, d), "agent-00007", "message", 50).select("id", micros("ts").alias("us"))


def hydrated(spark: SparkSession, d: str) -> DataFrame:
    """Active memories behind the hits of a word search."""
    m = memories(spark, d)
    q = spark.createDataFrame([(1, "review owner of the project")], "query_id int, query string")
    hits = ranking.bm25(m.filter("state = 'active'"), "id", "content", q)
    return scans.hydrate(hits, m).select("id", "content", F.round("score", 6).alias("score"))


def tenant_export(spark: SparkSession, d: str) -> DataFrame:
    """A tenant's active memories exported and imported under another name, beside what was there."""
    s = _store(spark, "export")
    s.commit("memories", memories(spark, d))
    s.export_tenant("nordwerk", f"{s.files.root}-out")
    s.import_tenant("copied", f"{s.files.root}-out")
    return s.read("memories").groupBy("tenant_id", "state").agg(F.count(F.lit(1)).alias("n"))


def tenant_move(spark: SparkSession, d: str) -> DataFrame:
    """A tenant's events and memories moved to another store: rows of both afterwards."""
    a, b = _store(spark, "from"), _store(spark, "to")
    a.commit("episodic", events(spark, d))
    a.commit("memories", memories(spark, d))
    a.move_tenant("nordwerk", b)
    parts = [s.read(t).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("store"), F.lit(t).alias("name"), "tenant_id", "n") for n, s in (("from", a), ("to", b)) for t in ("episodic", "memories")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def backup_restore(spark: SparkSession, d: str) -> DataFrame:
    """Two tables backed up, lost, and restored from the backup."""
    s = _store(spark, "backup")
    s.commit("episodic", events(spark, d).select("id", "source"))
    s.commit("memories", memories(spark, d).select("id", "state"))
    s.backup(f"{s.files.root}-kept", "b1")
    for t in ("episodic", "memories"):
        s.commit(t, s.read(t).limit(0))
    s.restore(f"{s.files.root}-kept", "b1")
    return s.read("episodic").groupBy(F.col("source").alias("part")).agg(F.count(F.lit(1)).alias("n")).unionByName(s.read("memories").groupBy(F.col("state").alias("part")).agg(F.count(F.lit(1)).alias("n")))


def backup_counts(spark: SparkSession, d: str) -> DataFrame:
    s = _store(spark, "manifest")
    s.commit("episodic", events(spark, d).select("id"))
    s.commit("memories", memories(spark, d).select("id"))
    return spark.createDataFrame(sorted(s.backup(f"{s.files.root}-kept", "b1")["counts"].items()), "name string, n long")


def audit_log(spark: SparkSession, d: str) -> DataFrame:
    """Every event as an audit row; those of a tenant from a time on."""
    s = _store(spark, "audit")
    append_audit(s, events(spark, d).filter("ts is not null").select(F.col("ts").alias("timestamp"), F.col("tenant_id").alias("tenant"), F.col("source").alias("actor"), F.coalesce("event_type", F.lit("none")).alias("action"), F.col("id").alias("target")))
    return audit_since(s.log("audit"), F.lit("2018-01-15").cast("timestamp"), "default").select("actor", "action", "target", micros("timestamp").alias("us"))


# filters, guard, SQL surface


def json_rows(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return scans.as_json(n)


_STATEMENTS = (
    "select * from orders", "select a.id from (select 1 as id) a", "with x as (select * from part) select count(*) from x", "drop table orders", "insert into orders select * from orders", "select * from read_csv('/etc/passwd')",
    "select * from parquet.`/tmp/x`", "select 1; select 2", "", "select * from orders where o_orderkey in (select l_orderkey from lineitem)", "select 'drop table x' as t", "set x = 1", "select java_method('a', 'b')", "show tables",
)


def sql_guard(spark: SparkSession, d: str) -> DataFrame:
    """Which statements the guard lets pass, and the tables they name."""
    out = []
    for i, s in enumerate(_STATEMENTS):
        try:
            out.append((i, True, " ".join(check(spark, s))))
        except Rejected:
            out.append((i, False, ""))
    return spark.createDataFrame(out, "n int, passes boolean, tables string")


def row_cap(spark: SparkSession, d: str) -> DataFrame:
    """A guarded query under the surface's row cap."""
    s = tenant_session(spark, {"orders": load(spark, d, "orders")}, "default")
    return run_sql(s, "select o_orderkey, o_custkey from orders order by o_totalprice desc, o_orderkey", max_rows=100)


def hybrid_state(spark: SparkSession, d: str) -> DataFrame:
    """A SELECT that joins events with the current value of one state key."""
    log = state_log(spark, d)
    first = state.current(log).filter("value is not null and agent_id is not null and key is not null").agg(F.min(F.struct("agent_id", "key")).alias("k")).first()["k"]
    s = tenant_session(spark, {"episodic": load(spark, d, "episodic")}, "default")

    def value(agent: str, key: str) -> DataFrame:
        return state.current(log).filter((F.col("agent_id") == agent) & (F.col("key") == key)).select("agent_id", "key", "value", "version")

    sql = f"select m.agent_id, m.key, m.version, count(*) as n from episodic e join memory_state('{first['agent_id']}', '{first['key']}') m on e.source = m.agent_id group by all"
    return run_sql(s, substitute(s, sql, None, value), max_rows=None)


def view_life(spark: SparkSession, d: str) -> DataFrame:
    """A view made, refreshed after its table changed, and read by another query."""
    s = tenant_session(spark, {"orders": load(spark, d, "orders")}, "default")
    v = MaterializedViews(s, _store(s, "views"))
    v.create("by_status", "select o_orderstatus, count(*) as n from orders group by 1")
    v.create("gone", "select 1 as x")
    v.drop("gone")
    v.refresh("by_status")
    assert v.names() == ["by_status"]
    return run_sql(s, "select o_orderstatus, n from mv_by_status", max_rows=None)


# retrieval


def graph_expanded(spark: SparkSession, d: str) -> DataFrame:
    """Nations behind edges that share a word with the name of a region."""
    n, r, c = load(spark, d, "nation"), load(spark, d, "region"), load(spark, d, "customer")
    w = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    e = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).join(w, "n_nationkey").select(F.col("n_name").alias("id"), F.col("n_name").alias("src"), F.col("r_name").alias("dst"), "weight", F.col("n_name").alias("source_memory_id"))
    q = r.select(F.col("r_regionkey").alias("query_id"), F.concat(F.lit("nations of the "), "r_name").alias("query"))
    return ranking.graph_arm(e, q, "query_id", "query", n.select(F.col("n_name").alias("id"))).select("query_id", "id", "score")


def rerank_pool(spark: SparkSession, d: str) -> DataFrame:
    """A second score over a pool of documents: the share of the query's length in the text's."""
    docs = load(spark, d, "documents").select("doc_id", "text", F.col("created_at").cast("timestamp").alias("created_at"), F.lit("agent memory").alias("query"), F.lit(0.25).alias("score"))
    out = ranking.rerank(docs, "query", "text", "created_at", F.lit("2022-01-01").cast("timestamp"), lambda q, t: F.when(F.length(t) > 0, F.length(q) / F.length(t)))
    return out.select("doc_id", F.round("score", 9).alias("score"))


def bm25_all(spark: SparkSession, d: str) -> DataFrame:
    """The texts of all documents whose id is divisible by 50 as queries, against all: the ten best of each."""
    q = load(spark, d, "documents").filter("doc_id % 50 = 0 and text is not null").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return lexical.best(load(spark, d, "documents"), "doc_id", "text", q, 10)


# vectors


def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Repeated rows of the even ids replace them, the last by version; the rest stays, and new ids come in."""
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    new = e.filter("id % 2 = 0").select("id", "embedding", F.explode(F.array(F.struct(F.col("label").alias("l"), F.lit(1).alias("version")), F.struct((F.col("label") + 1000).alias("l"), F.lit(2).alias("version")))).alias("x"))
    new = new.select("id", "embedding", F.col("x.l").alias("label"), "x.version").unionByName(e.select((F.col("id") + 10_000_000).alias("id"), "embedding", F.lit(-1).alias("label"), F.lit(1).alias("version")))
    return vectors.upsert(e, new, order="version").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def vector_entries(spark: SparkSession, d: str) -> DataFrame:
    """A page of the entries of one label, after others were deleted, saved and read again."""
    s = _store(spark, "vectors")
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    s.commit("vectors", vectors.delete(e, F.col("id") % 3 == 0))
    return vectors.entries(s.read("vectors"), F.col("label") < 10, limit=40, offset=20).select("id", "label")


def modality_search(spark: SparkSession, d: str) -> DataFrame:
    """The nearest over two modalities at once."""
    e = load(spark, d, "embeddings")
    q = e.orderBy("vec_id").first()["embedding"]
    store = e.select(F.col("vec_id").alias("id"), "embedding", F.when(F.col("label") % 2 == 0, "text").otherwise("image").alias("modality"))
    parts = [vectors.search_modalities(store, q, 10, m).select(F.lit(m or "any").alias("asked"), "id", F.round("score", 6).alias("score")) for m in ("text", "image", None)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# memories


def review_adds(spark: SparkSession, d: str) -> DataFrame:
    """New content for every active subject in review mode: it stands beside the old one."""
    m = memories(spark, d)
    p = cognition.plan_subject_adds(m, _changed_adds(m), _now(), review=True)
    return p.select("id", "outcome", "state", "version", "supersedes")


def _changed_adds(m: DataFrame) -> DataFrame:
    act = m.filter("state = 'active' and subject is not null")
    new = act.groupBy(*cognition.SCOPE, "subject").agg(F.min("id").alias("first"))
    return new.select(*cognition.SCOPE, "subject", F.concat(F.lit("new-"), "first").alias("id"), F.lit("changed").alias("content"), F.lit(0.5).alias("importance"), F.array().cast("array<string>").alias("source_event_ids"), F.lit(None).cast("string").alias("metadata"), F.lit(None).cast("string").alias("mem_type"))


def applied_adds(spark: SparkSession, d: str) -> DataFrame:
    """The whole table after those adds were planned and applied."""
    m = memories(spark, d)
    return cognition.apply_rows(m, cognition.plan_subject_adds(m, _changed_adds(m), _now())).select("id", "state", "version", micros("valid_to").alias("to_us"))


def add_merged(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as memories of their label: those of odd ids are added, and merge into the nearest even one."""
    e = load(spark, d, "embeddings")
    none = F.lit(None).cast("string")
    rows = e.select(F.format_string("%08d", "vec_id").alias("id"), F.lit("default").alias("tenant_id"), F.col("label").cast("string").alias("user_id"), none.alias("agent_id"), none.alias("session_id"),
                    F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("s"), "vec_id")).alias("subject"), F.concat(F.lit("c"), "vec_id").alias("content"), (F.col("vec_id") % 10 / 10.0).alias("importance"), F.array(F.concat(F.lit("e"), F.col("vec_id") % 3)).alias("source_event_ids"),
                    none.alias("metadata"), none.alias("mem_type"), "embedding", "vec_id")
    act = rows.filter("vec_id % 2 = 0").drop("vec_id").withColumns({"state": F.lit("active"), "valid_from": _now(), "valid_to": F.lit(None).cast("timestamp_ntz"), "supersedes": none, "version": F.lit(1), "created_at": _now(), "updated_at": _now()})
    p = cognition.plan_similar_adds(act, rows.filter("vec_id % 2 = 1").drop("vec_id"), _now(), 0.3)
    return p.select("id", "outcome", "subject", F.round("importance", 6).alias("importance"), F.array_join(F.array_sort("source_event_ids"), " ").alias("sources"), "supersedes")


def consolidated_similar(spark: SparkSession, d: str) -> DataFrame:
    """Memories of equal subject and scope as clusters of their smallest id: summaries in, members expired."""
    m = memories(spark, d)
    act = m.filter("state = 'active' and subject is not null")
    keys = [*cognition.SCOPE, "subject"]
    lead = act.groupBy(*keys).agg(F.min("id").alias("cluster"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(*[F.col(k).alias(f"_{k}") for k in keys], "cluster")
    c = act.join(lead, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).select("id", "cluster")
    out = cognition.consolidate_similar(m, c, _now())
    return out.select("id", "state", F.round("importance", 6).alias("importance"), F.size(F.split("content", "\n")).alias("lines"), F.array_join(F.array_sort("source_event_ids"), " ").alias("sources"))


def resolved(spark: SparkSession, d: str) -> DataFrame:
    """The first contradiction resolved in favour of its smallest id: the losers."""
    m = memories(spark, d)
    c = cognition.contradictions(m).filter("tenant_id = 'default'")
    first = c.orderBy("id").first()
    if first is None:
        return m.select("id", "state", "supersedes").limit(0)
    scope = cognition.in_scope(first["tenant_id"], first["user_id"], first["agent_id"], first["session_id"])
    return cognition.resolve(m, scope, first["subject"], first["id"], _now()).select("id", "state", "supersedes")


def subject_history(spark: SparkSession, d: str) -> DataFrame:
    """All versions of the subject that the smallest id is about."""
    m = memories(spark, d)
    f = m.filter("subject is not null").orderBy("id").first()
    return cognition.history(m, cognition.in_scope(f["tenant_id"], f["user_id"], f["agent_id"], f["session_id"]), f["subject"]).select("id", "state", "content")


def touched(spark: SparkSession, d: str) -> DataFrame:
    """Memories marked as used whose id ends in a letter; what a memory replaces is closed."""
    m = memories(spark, d)
    t = cognition.touch(m, m.filter(F.col("id").rlike("[a-f]$")).select("id"), _now())
    pairs = m.filter("supersedes is not null").select(F.col("supersedes").alias("old"), F.col("id").alias("new"))
    return cognition.supersede(t, pairs, _now()).select("id", "state", micros("updated_at").alias("us"))


def template_rows(spark: SparkSession, d: str) -> DataFrame:
    """Templates filled from the star schema; a blank required field gives nothing."""
    n = load(spark, d, "nation")
    kind = F.element_at(F.array(*map(F.lit, ("preference", "person", "decision", "task"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    f = F.create_map(F.lit("subject"), F.col("n_name"), F.lit("value"), F.lit(" x "), F.lit("name"), F.col("n_name"), F.lit("detail"), F.when(F.col("n_regionkey") > 1, "of a region").otherwise(""), F.lit("topic"), F.when(F.col("n_regionkey") != 3, F.col("n_name")).otherwise(" "), F.lit("decision"), F.lit("yes"), F.lit("task"), F.concat(F.lit("visit "), "n_name"))
    return n.select("n_nationkey", text.from_template(kind, f).alias("t")).select("n_nationkey", "t.content", "t.subject", "t.mem_type")


def distilled(spark: SparkSession, d: str) -> DataFrame:
    """Session digests, one fact drawn from each by an extractor, planned as adds against the memories."""
    ev = events(spark, d).filter("session_id is not null")
    own = ev.groupBy("session_id").agg(F.min("tenant_id").alias("tenant_id"))
    dig = runs.session_digests(ev).join(own, "session_id")
    none = F.lit(None).cast("string")
    answer = F.format_string('Facts: [{"subject": "Session  %s", "content": "%d events"}]', "session_id", "n_events")  # what a model would answer
    facts = dig.select(F.col("session_id").alias("id"), "tenant_id", none.alias("user_id"), none.alias("agent_id"), "session_id", text.fact_list(answer).alias("facts"))
    p = cognition.plan_subject_adds(memories(spark, d), cognition.facts_to_adds(facts), _now())
    return p.select("id", "tenant_id", "subject", "content", "outcome")


def grant_life(spark: SparkSession, d: str) -> DataFrame:
    """Agents grant to the users they have memories of; grants of one agent are revoked; what is left of a tenant."""
    m = memories(spark, d).filter("agent_id is not null and user_id is not null")
    new = m.select("tenant_id", F.col("agent_id").alias("grantor_user"), F.col("user_id").alias("grantee_user"))
    g = cognition.add_grants(new.limit(0), new.unionByName(new))
    left = cognition.revoke_grants(g, g.filter("grantor_user = 'agent-00007'"))
    return cognition.list_grants(left, "default")


# graph


def edges_added(spark: SparkSession, d: str) -> DataFrame:
    """Edges of even customers are there, all arrive: each is stored once."""
    e = edges(spark, d)
    return graph.add_edges(e.filter("substring(src, 2) % 2 = 0"), e.unionByName(e)).groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


def graph_on_add(spark: SparkSession, d: str) -> DataFrame:
    """Two facts per nation, the second replacing the first of some: edges come in, and end with their memory."""
    n = load(spark, d, "nation")
    row = lambda ident, content, state_, end: n.select(F.concat(F.lit(ident), F.lpad(F.col("n_nationkey").cast("string"), 12, "0")).alias("id"), F.lit("default").alias("tenant_id"), F.concat(F.col("n_name"), F.lit(content)).alias("content"), F.lit(state_).alias("state"), _now().alias("valid_from"), F.lit(end).cast("timestamp_ntz").alias("valid_to"), F.col("n_nationkey"))
    first = row("00000000-0000-0000-0000-", " likes rain. It owns hills", "active", None)
    edges_ = graph.edges_from_memories(first.drop("n_nationkey"))
    closed = row("00000000-0000-0000-0000-", " likes rain. It owns hills", "superseded", NOW).filter("n_nationkey % 2 = 0").withColumn("outcome", F.lit("Closed"))
    fresh = row("00000000-0000-0000-0001-", " hates rain", "active", None).filter("n_nationkey % 2 = 0").withColumn("outcome", F.lit("Superseded"))
    e = graph.edges_on_add(edges_, closed.unionByName(fresh).drop("n_nationkey"))
    return e.groupBy("src", "relation", "dst", "state").agg(F.count(F.lit(1)).alias("n"), F.max(micros("valid_to")).alias("to_us"))


# state


def state_delete(spark: SparkSession, d: str) -> DataFrame:
    """All keys of one agent deleted: the tombstones."""
    s = state_log(spark, d)
    return state.delete_keys(s, s.filter("agent_id = 'agent-00007'").select(*state.KEY).distinct(), F.lit(NOW).cast("timestamp")).select("agent_id", "key", "version", "deleted")


def state_list(spark: SparkSession, d: str) -> DataFrame:
    return state.list_keys(state_log(spark, d), F.lit(NOW).cast("timestamp")).select("agent_id", "key")


def state_expired(spark: SparkSession, d: str) -> DataFrame:
    """Entries that lived ten days from their change and are over: tombstones to append."""
    s = state_log(spark, d).withColumn("expires_at", F.timestamp_micros(F.unix_micros("changed_at") + 10 * 86_400_000_000))
    return state.expired(s, F.lit("2018-01-20").cast("timestamp")).select("agent_id", "key", "deleted")


def replay_once(spark: SparkSession, d: str) -> DataFrame:
    """Of repeated calls of one key the first result counts."""
    s = load(spark, d, "state_changes").filter("key is not null").select(F.concat_ws("|", "agent_id", "key").alias("call"), "feed_offset", "value")
    return runs.once(s, "call", "feed_offset").select("call", "feed_offset", "value")


# runs


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return standing_runs(load(spark, d, "runs"), "tenant_id", "agent_id", "parent_run_id", "status", "input", "result", "error", "cursor", "created_at", "updated_at", "started_at", "ended_at")


def runs_created(spark: SparkSession, d: str) -> DataFrame:
    """A run for every agent, twice; those of a tenant and state, newest first."""
    r = _runs(spark, d)
    new = r.filter("agent_id is not null").groupBy("agent_id").agg(F.lit(None).cast("string").alias("tenant_id")).select(F.concat(F.lit("run-"), "agent_id").alias("id"), "tenant_id", "agent_id", F.lit(None).cast("string").alias("parent_run_id"), F.lit("{}").alias("input"))
    out = runs.create_runs(r, new.unionByName(new).unionByName(new.withColumn("id", F.lit(None).cast("string")).limit(0)), _now())
    return runs.list_runs(out, "default", status="pending").select("id", "agent_id", micros("created_at").alias("us"))


def runs_patched(spark: SparkSession, d: str) -> DataFrame:
    """Pending runs start, running ones succeed."""
    r = _runs(spark, d)
    none = F.lit(None).cast("string")
    p = r.filter("status in ('pending', 'running')").select("id", F.when(F.col("status") == "pending", "running").otherwise("succeeded").alias("status"), F.when(F.col("status") == "running", F.lit('"ok"')).alias("result"), none.alias("error"), none.alias("cursor"))
    return runs.patch_runs(r, p, _now()).select("id", "status", "result", micros("started_at").alias("start_us"), micros("ended_at").alias("end_us"))


def run_steps(spark: SparkSession, d: str) -> DataFrame:
    """The step log of the longest trace."""
    e = standing_events(load(spark, d, "episodic"), tenant().alias("tenant_id"), "event_type", "ts", "session_id", "trace_id")
    top = e.filter("trace_id is not null").groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "trace_id").first()
    return runs.run_trace(e, top["trace_id"] if top else "").select("step", "id", "event_type")


def approvals(spark: SparkSession, d: str) -> DataFrame:
    """Runs that wait are decided twice; the first decision counts, others stay as they are."""
    r = _runs(spark, d).select("id", F.when(F.col("status") == "waiting_approval", "pending").otherwise(F.col("status")).alias("status"), "updated_at")
    dec = r.select("id", F.explode(F.array(F.struct(F.lit(2).alias("decided_at"), F.lit(True).alias("approve")), F.struct(F.lit(1).alias("decided_at"), F.col("id").rlike("[0-7]$").alias("approve")))).alias("x")).select("id", "x.*")
    return runs.decide(r, dec, _now()).select("id", "status")


def session_life(spark: SparkSession, d: str) -> DataFrame:
    """Sessions started from the log; those without an event since a day are ended with their number of events."""
    ev = events(spark, d).filter("session_id is not null")
    own = ev.groupBy("session_id").agg(F.min("source").alias("agent_id"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"), F.min("tenant_id").alias("tenant_id"))
    s = runs.start_sessions(own.select("session_id", "agent_id", F.lit(None).cast("string").alias("parent_session_id"), F.lit(None).cast("string").alias("metadata"), "tenant_id"), F.lit("2018-01-01").cast("timestamp"))
    ends = own.filter(F.col("last") < F.lit("2018-01-15").cast("timestamp_ntz")).select("session_id", F.concat("n", F.lit(" events")).alias("summary"))
    done = runs.end_sessions(s, ends, F.lit(NOW).cast("timestamp"))
    return runs.sessions_of(done, "agent-00007").select("session_id", "summary", micros("ended_at").alias("end_us"))


def recalled_session(spark: SparkSession, d: str) -> DataFrame:
    """The events of the longest session, in order."""
    ev = events(spark, d)
    top = ev.filter("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "session_id").first()
    return runs.session_events(ev, top["session_id"] if top else "").select("id", micros("ts").alias("us"))


# streams


def change_stream(spark: SparkSession, d: str) -> DataFrame:
    """A log of planned adds followed by a watcher of one tenant, as a stream."""
    s = _store(spark, "changes")
    m = memories(spark, d)
    for outcome in ("Superseded", "Closed"):
        s.append_log("changes", cognition.plan_subject_adds(m, _changed_adds(m), _now()).filter(F.col("outcome") == outcome).select("id", "tenant_id", "agent_id", "outcome"))
    src = flows.follow(spark, f"{s.files.root}/changes/log", "id string, tenant_id string, agent_id string, outcome string", tenant="default", max_files=1)
    out = f"{s.files.root}/seen"
    flows.every(src, lambda b, i: b.write.mode("append").parquet(out), f"{s.files.root}/cp").awaitTermination()
    return spark.read.schema("id string, tenant_id string, agent_id string, outcome string").parquet(out).select("id", "outcome")


def stream_resolved_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every outcome of the stateful resolution, row by row: order priorities as facts about customers."""
    scratch = Scratch(spark, "stream")
    o = spark.readStream.schema(load(spark, d, "orders").schema).parquet(f"{d}/orders.parquet*")
    seq = F.unix_date(F.col("o_orderdate").cast("date")) * F.lit(10_000_000_000) + F.col("o_orderkey")
    res = flows.resolve_stream(o.withColumn("seq", seq), "o_custkey", "o_orderpriority", "seq")
    flows.every(res, lambda b, i: b.write.mode("append").parquet(f"{scratch.root}/out"), f"{scratch.root}/cp").awaitTermination()
    return spark.read.parquet(f"{scratch.root}/out").select("key", F.pmod("seq", F.lit(10_000_000_000)).alias("o_orderkey"), "content", "outcome", "version", F.pmod("supersedes", F.lit(10_000_000_000)).alias("supersedes"))


def stream_first(spark: SparkSession, d: str) -> DataFrame:
    """One event per user, type and hour as they stream by, within a watermark longer than the data."""
    scratch = Scratch(spark, "stream")
    e = spark.readStream.schema(load(spark, d, "events").schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withColumn("k", F.concat_ws("|", "user_id", "event_type", F.date_trunc("hour", "ts").cast("string")))
    first = flows.first_by_key(e.select("k", "ts"), "ts", "k", "3650 days")
    flows.every(first, lambda b, i: b.write.mode("append").parquet(f"{scratch.root}/out"), f"{scratch.root}/cp").awaitTermination()
    return spark.read.parquet(f"{scratch.root}/out").select("k")


def upkeep_pass(spark: SparkSession, d: str) -> DataFrame:
    """One pass of the lifecycle: retention, expiry, decay, vectors: what it did."""
    s = _store(spark, "upkeep")
    s.commit("episodic", events(spark, d))
    s.commit("memories", memories(spark, d))
    s.commit("state", state_log(spark, d).withColumn("expires_at", F.timestamp_micros(F.unix_micros("changed_at") + 10 * 86_400_000_000)))
    policies = spark.createDataFrame([("agent-00007", 40), ("agent-00000", 0)], "source string, days int")
    did = flows.upkeep(s, F.lit(NOW).cast("timestamp"), policies, 50, half_life_days=10.0, embedder=_counting)
    return spark.createDataFrame(sorted(did.items()), "what string, n long")


# text and scalars


def triple_texts(spark: SparkSession, d: str) -> DataFrame:
    """Lines as a model answers them, from orders: good, blank and broken ones."""
    o = load(spark, d, "orders")
    t = F.concat(F.lit("c"), "o_custkey", F.lit(" | Placed By | o"), "o_orderkey", F.lit("\nno triple here\n a |b c| "), "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, "\nx||y").otherwise("\np|q|r|s"))
    return o.select("o_orderkey", F.posexplode(text.triple_lines(t)).alias("at", "t")).select("o_orderkey", "at", "t.subject", "t.relation", "t.object")


def fact_texts(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation")
    t = F.when(F.col("n_nationkey") % 5 == 0, F.lit("no list")).otherwise(F.concat(F.lit('Sure: [{"subject": "'), "n_name", F.lit('", "content": "is in '), F.col("n_regionkey").cast("string"), F.lit('"}, {"content": " "}, {"subject": null, "content": "x"}] done')))
    return n.select("n_nationkey", F.explode_outer(text.fact_list(t)).alias("f")).select("n_nationkey", "f.subject", "f.content")


def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation")
    return n.select("n_nationkey", text.cache_key(F.concat(F.lit("  What  about\t"), "n_name", F.lit("? ")), F.lit("default"), F.col("n_regionkey").cast("string")).alias("key"))


def file_names(spark: SparkSession, d: str) -> DataFrame:
    """Note titles and file names of memories."""
    m = memories(spark, d)
    return m.select("id", text.note_title("subject", "id").alias("title"), text.file_name(F.concat(F.lit("..a/"), F.coalesce("subject", F.lit("")), F.lit(":?"))).alias("file"))


def time_parse(spark: SparkSession, d: str) -> DataFrame:
    """Times written in several ways, and texts that are none."""
    o = load(spark, d, "orders")
    k, day = F.col("o_orderkey") % 5, F.date_format("o_orderdate", "yyyy-MM-dd")
    t = F.when(k == 0, F.concat(day, F.lit("T10:11:12Z"))).when(k == 1, F.concat(day, F.lit(" 10:11:12.5"))).when(k == 2, F.concat(day, F.lit("T10:11:12+02:00"))).when(k == 3, F.concat(F.lit(" "), day, F.lit(" 10:11:12 "))).otherwise(F.lit("soon"))
    return o.select("o_orderkey", micros(scalars.parse_time(t)).alias("us"))


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Scope keys, task prefixes and digests of memories."""
    m = memories(spark, d)
    key = scalars.scope_key(F.col("tenant_id"), F.col("user_id"), F.col("agent_id"), F.col("session_id"))
    return m.select("id", key.alias("scope"), scalars.task_prefix(F.col("content"), "nomic-embed-text", True).alias("asked"), scalars.task_prefix(F.col("content"), "e5-small", False).alias("stored"), scalars.context_fingerprint(F.col("content"), F.col("id")).alias("digest"))


def fnv_hashes(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation")
    return n.select("n_nationkey", scalars.fnv1a64_hex(F.col("n_name")).alias("h"))


QUERIES = {
    f.__name__: f
    for f in (
        log_append, ingest_stored, reindex_pending, memory_reembed, tenant_tags, events_by_ids, tenant_events, range_scan, memory_lookup, upkeep_listing, fluent_query, hydrated, tenant_export, tenant_move, backup_restore, backup_counts, audit_log,
        json_rows, sql_guard, row_cap, hybrid_state, view_life, graph_expanded, rerank_pool, bm25_all, vector_upsert, vector_entries, modality_search,
        review_adds, applied_adds, add_merged, consolidated_similar, resolved, subject_history, touched, template_rows, distilled, grant_life, edges_added, graph_on_add,
        state_delete, state_list, state_expired, replay_once, runs_created, runs_patched, run_steps, approvals, session_life, recalled_session,
        change_stream, stream_resolved_rows, stream_first, upkeep_pass, triple_texts, fact_texts, cache_keys, file_names, time_parse, fingerprints, fnv_hashes,
    )
}
