"""Memories, events, state, runs and graph: queries over the reference tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..entities import link_norm, micros, retries, standing_events, standing_memories, standing_runs, subject_norm, tenant
from ..functions.text import subject
from ..operators import cognition, graph, runs, state
from ..operators.hierarchy import resolve_tree
from ..operators.joins import asof_join
from ..session import Scratch, load
from ..sources import exchange, ingest
from .problems_sql import EVENTS, MEMORIES

NOW = "2018-03-01 00:00:00"
THEN = "1998-06-30 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def memories(spark: SparkSession, d: str) -> DataFrame:
    """The memory table: one row per memory, ids in lower case, subjects normalised."""
    mem = load(spark, d, "memories")
    cols = [F.col(c) for c in ("user_id", "agent_id", "session_id", "content", "importance", "valid_from", "valid_to", "state", "supersedes", "version", "created_at", "updated_at", "metadata", "mem_type")]
    return standing_memories(mem, tenant().alias("tenant_id"), subject("subject").alias("subject"), F.coalesce("source_event_ids", F.array().cast("array<string>")).alias("source_event_ids"), *cols)


def events(spark: SparkSession, d: str) -> DataFrame:
    """The event table: one row per event."""
    return standing_events(load(spark, d, "episodic"), tenant().alias("tenant_id"), "source", "event_type", "payload", "ts", "session_id", "tags")


def state_log(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "state_changes")
    return s.select(F.lit("default").alias("tenant_id"), "agent_id", "key", "value", "version", F.coalesce("deleted", F.lit(False)).alias("deleted"), F.col("changed_at").cast("timestamp").alias("changed_at"), F.lit(None).cast("timestamp").alias("expires_at"))


# memories


def memory_versions(spark: SparkSession, d: str) -> DataFrame:
    """Order priorities as facts about customers: which were inserted, confirmed, superseded."""
    o = load(spark, d, "orders")
    v = cognition.versions(o, ["o_custkey"], "o_orderpriority", "o_orderdate", "o_orderkey")
    return v.select("o_custkey", "content", "first_seq", micros("valid_from").alias("from_us"), micros("valid_to").alias("to_us"), "version", "outcome", "supersedes", "state")


def memory_as_of(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    v = cognition.versions(o, ["o_custkey"], "o_orderpriority", "o_orderdate", "o_orderkey").withColumnRenamed("first_seq", "id")
    return cognition.as_of(v, ["o_custkey"], F.lit(THEN).cast("timestamp_ntz")).select("o_custkey", "content", "id")


def memory_history(spark: SparkSession, d: str) -> DataFrame:
    """Every version of every subject with its place in the chain."""
    from pyspark.sql import Window

    m = memories(spark, d).filter("subject is not null")
    w = Window.partitionBy(*cognition.SCOPE, "subject").orderBy("valid_from", "id")
    return m.select("id", "subject", F.row_number().over(w).alias("place"))


def subject_as_of(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d).filter("subject is not null")
    return cognition.as_of(m, [*cognition.SCOPE, "subject"], F.lit("2018-01-10 12:00:00").cast("timestamp_ntz")).select("id", "subject")


def contradictions(spark: SparkSession, d: str) -> DataFrame:
    return cognition.contradictions(memories(spark, d))


def scope_cap(spark: SparkSession, d: str) -> DataFrame:
    return cognition.over_cap(memories(spark, d), 2).select("id")


def consolidate_tail(spark: SparkSession, d: str) -> DataFrame:
    t = cognition.consolidate_tail(memories(spark, d), 3, ["tenant_id", "agent_id"])
    return t.select("tenant_id", "agent_id", "content", "importance", F.size("source_memory_ids").alias("n"))


def decay_forget(spark: SparkSession, d: str) -> DataFrame:
    m = cognition.forget(memories(spark, d), _now(), 30.0, 0.2)
    return m.select("id", "state", micros("valid_to").alias("to_us"))


def feedback_apply(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d)
    signals = m.select("id", F.when(F.col("version") % 3 == 1, "helpful").when(F.col("version") % 3 == 2, "wrong").alias("signal")).filter("signal is not null")
    return cognition.feedback(m, signals, _now()).select("id", F.round("importance", 6).alias("importance"), "version", "state")


def patch_apply(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d)
    p = m.filter("mem_type = 'episodic'").select("id", F.lit(None).cast("string").alias("content"), (F.col("importance") + 0.5).alias("importance"), F.lit("semantic").alias("mem_type"), F.lit(None).cast("string").alias("metadata"))
    return cognition.patch(m, p, _now()).select("id", F.round("importance", 6).alias("importance"), "mem_type", "version")


def plan_adds(spark: SparkSession, d: str) -> DataFrame:
    """New observations of all active subjects: those of odd version repeat the content, the others change it."""
    m = memories(spark, d)
    act = m.filter("state = 'active' and subject is not null")
    new = act.groupBy(*cognition.SCOPE, "subject").agg(F.min("id").alias("first"), F.min_by("content", "id").alias("content"), F.min_by("version", "id").alias("version"))
    new = new.select(*cognition.SCOPE, "subject", F.concat(F.lit("new-"), "first").alias("id"), F.when(F.col("version") % 2 == 1, F.col("content")).otherwise(F.concat("content", F.lit(" again"))).alias("content"), F.lit(0.9).alias("importance"), F.array().cast("array<string>").alias("source_event_ids"), F.lit(None).cast("string").alias("metadata"), F.lit(None).cast("string").alias("mem_type"))
    p = cognition.plan_subject_adds(m, new, _now())
    return p.select("id", "outcome", "state", "version", "supersedes", F.round("importance", 6).alias("importance"))


def provenance(spark: SparkSession, d: str) -> DataFrame:
    p = cognition.provenance(memories(spark, d), events(spark, d))
    return p.select("id", "event_id", "event_source", "event_type", micros("event_ts").alias("event_us"))


def memory_scopes(spark: SparkSession, d: str) -> DataFrame:
    return cognition.scopes(memories(spark, d))


def list_paged(spark: SparkSession, d: str) -> DataFrame:
    """The second page of the important semantic memories of an agent."""
    m = memories(spark, d).withColumns({c: F.lit(None).cast("string") for c in ("user_id", "session_id")})
    return cognition.list_paged(m, cognition.in_scope("default", agent="agent-00007"), limit=10, offset=10, mem_type="semantic", min_importance=0.3).select("id", "importance")


def memory_counts(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).groupBy("state", "mem_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("importance"), 3).alias("importance"))


def published(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d)
    return m.filter((F.get_json_object("metadata", "$.published") == "true") & (F.col("state") == "active")).select("id")


def scope_erase(spark: SparkSession, d: str) -> DataFrame:
    left = cognition.erase({"memories": memories(spark, d)}, "nordwerk")["memories"]
    return left.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"))


# events


def event_counts(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("source", F.lower(F.trim("event_type")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session_id").alias("sessions"))


def events_in_range(spark: SparkSession, d: str) -> DataFrame:
    ep = load(spark, d, "episodic").filter(F.col("ts").between(F.lit("2018-01-10 00:00:00").cast("timestamp_ntz"), F.lit("2018-01-12 00:00:00").cast("timestamp_ntz")))
    return ep.select(F.lower("id").alias("id"), micros("ts").alias("us"), micros("ingested_at").alias("seen_us")).distinct()


def distinct_sources(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "episodic").select(tenant().alias("tenant_id"), "source").distinct()


def idempotent_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The raw log as one batch in order of ingestion, into an empty store: what is appended."""
    ep = load(spark, d, "episodic")
    b = ep.select(F.lower("id").alias("id"), tenant().alias("tenant_id"), "source", "idempotency_key", "ingested_at")
    return ingest.new_events(b.limit(0), b, "ingested_at").select("id", "source")


def entity_events(spark: SparkSession, d: str) -> DataFrame:
    return exchange.entity_events(events(spark, d), "recall step").select("id")


def retention_sweep(spark: SparkSession, d: str) -> DataFrame:
    p = spark.createDataFrame([("agent-00007", 40), ("agent-00000", 0)], "source string, days int")
    kept = runs.retained(events(spark, d), p, F.lit(NOW).cast("timestamp"), 50)
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def webhook_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Vendor payloads made from the events table, normalised."""
    e = load(spark, d, "events")
    k = F.col("user_id") % 5
    j = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    t, u = F.col("event_type"), F.col("user_id")
    payload = (
        F.when(k == 0, F.when(u % 2 == 0, j('{"action":"', t, '","issue":{"n":1},"repository":{"full_name":"org/r', u, '"}}')).otherwise(j('{"commits":[1],"repository":{"full_name":"org/r', u, '"}}')))
        .when(k == 1, j('{"action":"', t, '","data":{"issue":{"title":"x","project":{"slug":"p', u, '"}}}}'))
        .when(k == 2, j('{"event":{"type":"', t, '","channel":"c', u, '"}}'))
        .when(k == 3, j('{"event":{"data":{"service":{"name":"s', u, '"}}}}'))
        .otherwise(j('{"type":"', t, '","value":1}'))
    )
    kind = F.when(k == 0, "github").when(k == 1, "sentry").when(k == 2, "slack").when(k == 3, "pagerduty").otherwise(F.concat(F.lit("custom-"), u.cast("string")))
    return ingest.normalize_webhooks(e.select("event_id", kind.alias("source"), t, payload.alias("payload"))).select("event_id", "source", "event_type")


def session_recall(spark: SparkSession, d: str) -> DataFrame:
    """Every event with its place in its session."""
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("ts", "id")
    return events(spark, d).filter("session_id is not null").select("session_id", "id", F.row_number().over(w).alias("place"))


def session_digest(spark: SparkSession, d: str) -> DataFrame:
    return runs.session_digests(events(spark, d))


def trigger_match(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([("all-messages", "a", "*", "message"), ("seven", "b", "agent-00007", "*"), ("pair", "c", "agent-00000", "tool.trace"), ("any", "d", "*", None)], "name string, agent_id string, source string, event_type string")
    return runs.match_triggers(events(spark, d), t)


def last_view(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the user's last view before it."""
    e = load(spark, d, "events")
    buys = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return asof_join(buys, views, ["user_id"], "ts", ["view_id"]).select("event_id", "view_id")


# runs


def orphan_runs(spark: SparkSession, d: str) -> DataFrame:
    r = standing_runs(load(spark, d, "runs"), "status", "updated_at")
    return runs.orphans(r, F.lit("2018-01-20 00:00:00").cast("timestamp_ntz")).select("id", "status")


def run_ledger(spark: SparkSession, d: str) -> DataFrame:
    r = standing_runs(load(spark, d, "runs"), tenant().alias("tenant_id"), "status", "started_at", "ended_at")
    took = (micros("ended_at") - micros("started_at")) / 1e6
    return r.groupBy("tenant_id", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(took), 3).alias("seconds"))


# state


def state_current(spark: SparkSession, d: str) -> DataFrame:
    return state.current(state_log(spark, d)).select("agent_id", "key", "value", "version")


def state_ttl(spark: SparkSession, d: str) -> DataFrame:
    """Entries live for ten days from their change: what is left at a time."""
    s = state_log(spark, d).withColumn("expires_at", F.timestamp_micros(F.unix_micros("changed_at") + 10 * 86_400_000_000))
    return state.current(s, F.lit("2018-01-20 00:00:00").cast("timestamp")).select("agent_id", "key", "version")


def state_set(spark: SparkSession, d: str) -> DataFrame:
    """A write to every key ever seen: versions go on, deleted keys begin at 1."""
    s = state_log(spark, d)
    writes = s.select(*state.KEY).distinct().withColumn("value", F.lit("1"))
    return state.set_values(s, writes, F.lit(NOW).cast("timestamp")).select("agent_id", "key", "version")


def state_cas(spark: SparkSession, d: str) -> DataFrame:
    s = state_log(spark, d)
    writes = s.select(*state.KEY).distinct().withColumns({"value": F.lit("1"), "expected": F.lit(2).cast("long")})
    return state.compare_and_set(s, writes, F.lit(NOW).cast("timestamp")).select("agent_id", "key", "applied", "version")


def state_prefix(spark: SparkSession, d: str) -> DataFrame:
    return state.by_prefix(state_log(spark, d), "agent-0000").groupBy("agent_id").agg(F.count(F.lit(1)).alias("n"))


# graph


def edges(spark: SparkSession, d: str) -> DataFrame:
    """customer -buys_from-> supplier, weighted by order lines, since the first order."""
    o, li = load(spark, d, "orders"), load(spark, d, "lineitem")
    e = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).cast("double").alias("weight"), F.min("o_orderdate").alias("valid_from"))
    src, dst = F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("s"), "l_suppkey")
    return e.select(F.concat_ws("|", src, dst).alias("id"), src.alias("src"), F.lit("buys_from").alias("relation"), dst.alias("dst"), "weight", "valid_from", F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit("active").alias("state"))


def last_supplier(spark: SparkSession, d: str) -> DataFrame:
    """part -last_supplier-> supplier, one at a time: each order line closes the one before."""
    li = load(spark, d, "lineitem")
    e = li.select(F.format_string("%010d-%02d", "l_orderkey", "l_linenumber").alias("id"), F.col("l_partkey").cast("string").alias("src"), F.lit("last_supplier").alias("relation"), F.col("l_suppkey").cast("string").alias("dst"), F.lit(1.0).alias("weight"), F.col("l_shipdate").alias("valid_from"), F.lit("active").alias("state"))
    return graph.functional(e, ["src", "relation"])


def edge_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbors(edges(spark, d), "s1", 50).select("src", "dst", "weight")


def edge_as_of(spark: SparkSession, d: str) -> DataFrame:
    return graph.snapshot(edges(spark, d), F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")).groupBy("dst").agg(F.count(F.lit(1)).alias("n"))


def functional_link(spark: SparkSession, d: str) -> DataFrame:
    return last_supplier(spark, d).select("id", micros("valid_to").alias("to_us"), "invalidated_by", "state")


def degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(edges(spark, d))


def pagerank(spark: SparkSession, d: str) -> DataFrame:
    """On the graph of nations: customers' nations to suppliers' nations, by order lines."""
    return graph.pagerank(_nation_edges(spark, d)).select("node", F.round("pagerank", 9).alias("pagerank"))


def _nation_edges(spark: SparkSession, d: str) -> DataFrame:
    c, s = load(spark, d, "customer"), load(spark, d, "supplier")
    e = edges(spark, d).select(F.substring("src", 2, 20).cast("long").alias("c"), F.substring("dst", 2, 20).cast("long").alias("s"), "weight")
    e = e.join(c.select(F.col("c_custkey").alias("c"), "c_nationkey"), "c").join(s.select(F.col("s_suppkey").alias("s"), "s_nationkey"), "s")
    return e.groupBy(F.col("c_nationkey").cast("string").alias("src"), F.col("s_nationkey").cast("string").alias("dst")).agg(F.sum("weight").alias("weight"))


def pagerank_large(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(edges(spark, d)).select("node", F.round("pagerank", 12).alias("pagerank"))


def communities(spark: SparkSession, d: str) -> DataFrame:
    """Components of the events' parent links."""
    ep = load(spark, d, "episodic").select(F.lower("id").alias("src"), F.lower(F.trim("parent_id")).alias("dst")).filter("dst <> ''")
    return graph.communities(ep)


def subgraph_2hop(spark: SparkSession, d: str) -> DataFrame:
    return graph.subgraph(edges(spark, d), "c1", 2).groupBy("hop").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    """From the event farthest below the top of its tree (the smallest id among equals) up its links to that top."""
    ep = load(spark, d, "episodic")
    t, canon = F.lit("episodic").alias("table_name"), retries(ep).groupBy(F.col("id").alias("parent_id")).agg(F.min("canon").alias("canon"))
    ev = standing_events(ep, link_norm("parent_id").alias("parent_id")).join(canon, "parent_id", "left")
    nodes = Scratch(spark, "links").cut(ev.select(t, F.col("id").alias("node_id"), F.coalesce("canon", "parent_id").alias("parent_id")))
    tree = resolve_tree(nodes, nodes.select("table_name", F.col("node_id").alias("ref"), F.col("node_id").alias("canon")))
    far = tree.filter("depth > 0").orderBy(F.desc("depth"), "node_id").select("node_id", "root_id").first()
    links = nodes.select(F.col("node_id").alias("src"), F.col("parent_id").alias("dst"))
    path = graph.shortest_path(links, far["node_id"], far["root_id"]) if far else []
    return spark.createDataFrame(list(enumerate(path)), "place int, node string")


def memory_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the sentences in active memories."""
    return graph.edges_from_memories(memories(spark, d)).select("id", "src", "relation", "dst", "source_memory_id")


def vault_notes(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d)
    return exchange.render_notes(m, graph.edges_from_memories(m).select("src", "dst"))


QUERIES = {
    f.__name__: f
    for f in (
        memory_versions, memory_as_of, memory_history, subject_as_of, contradictions, scope_cap, consolidate_tail, decay_forget, feedback_apply, patch_apply, plan_adds, provenance, memory_scopes, list_paged, memory_counts, published, scope_erase,
        event_counts, events_in_range, distinct_sources, idempotent_ingest, entity_events, retention_sweep, webhook_normalize, session_recall, session_digest, trigger_match, last_view,
        orphan_runs, run_ledger, state_current, state_ttl, state_set, state_cas, state_prefix,
        edge_neighbors, edge_as_of, functional_link, degree_centrality, pagerank, pagerank_large, communities, subgraph_2hop, shortest_path, memory_edges, vault_notes,
    )
}

# the same in SQL

_M = MEMORIES + r""",
  m as (select * replace (nullif(lower(trim(regexp_replace(subject, '\s+', ' ', 'g'))), '') as subject), tenant as tenant_id from mm)"""
_SCOPE = "tenant_id, user_id, agent_id, session_id"
_RUNS = """
  w0 as (select *, lag(trim(o_orderpriority)) over w is not distinct from trim(o_orderpriority) and lag(o_orderkey) over w is not null as same from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
  w1 as (select *, sum((not same)::int) over (partition by o_custkey order by o_orderdate, o_orderkey) as run from w0),
  rn as (select o_custkey, run, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) as content, min((o_orderdate, o_orderkey))[2] as first_seq, min(o_orderdate) as valid_from, count(*) as version from w1 group by all),
  v as (select *, lead(valid_from) over c as valid_to, lag(first_seq) over c as supersedes from rn window c as (partition by o_custkey order by run))"""
_EDGES = """
  ed as (select 'c' || o_custkey || '|s' || l_suppkey as id, 'c' || o_custkey as src, 's' || l_suppkey as dst, count(*)::double as weight, min(o_orderdate) as valid_from
    from orders join lineitem on o_orderkey = l_orderkey group by o_custkey, l_suppkey)"""
_STATE = """
  sc as (select * from state_changes qualify row_number() over (partition by agent_id, key order by changed_at desc, version desc) = 1),
  cur as (select * from sc where not coalesce(deleted, false))"""
_CTES = ", ".join(
    f"r{i} as materialized (select n.node, (1 - 0.85::double) / cnt + 0.85::double * (coalesce(lost, 0) / cnt + coalesce(x, 0)) as r from nodes n cross join (select count(*) as cnt from nodes) cross join (select sum(r) as lost from r{i - 1} where node not in (select src from p)) left join (select dst as node, sum(r * pr) as x from p join r{i - 1} on src = node group by dst) using (node))"
    for i in range(1, 41)
)

ORACLE = {
    "memory_versions": f"""with {_RUNS} select o_custkey, content, first_seq, epoch_us(valid_from) as from_us, epoch_us(valid_to) as to_us, version,
  case when run = 1 then 'Inserted' else 'Superseded' end as outcome, supersedes, case when valid_to is null and run = max(run) over (partition by o_custkey) then 'active' else 'superseded' end as state from v""",
    "memory_as_of": f"""with {_RUNS} select o_custkey, content, first_seq as id from v where valid_from <= timestamp '{THEN}' and (valid_to is null or valid_to > timestamp '{THEN}')
qualify row_number() over (partition by o_custkey order by valid_from desc, first_seq desc) = 1""",
    "memory_history": f"with {_M} select id, subject, (row_number() over (partition by {_SCOPE}, subject order by valid_from nulls first, id))::int as place from m where subject is not null",
    "subject_as_of": f"""with {_M} select id, subject from m where subject is not null and valid_from <= timestamp '2018-01-10 12:00:00' and (valid_to is null or valid_to > timestamp '2018-01-10 12:00:00')
qualify row_number() over (partition by {_SCOPE}, subject order by valid_from desc, id desc) = 1""",
    "contradictions": f"with {_M} select {_SCOPE}, subject, count(*) over (partition by {_SCOPE}, subject) as n, id, content from m where state = 'active' and subject is not null qualify n > 1",
    "scope_cap": f"with {_M} select id from m where state = 'active' qualify row_number() over (partition by {_SCOPE} order by importance desc nulls last, updated_at desc nulls last, id) > 2",
    "consolidate_tail": f"""with {_M}, t as (select *, row_number() over (partition by tenant_id, agent_id order by importance desc nulls last, valid_from desc nulls last, id) as r from m where state = 'active')
select tenant_id, agent_id, 'Consolidated ' || count(*) || ' memories:' || chr(10) || string_agg('- ' || coalesce(content, ''), chr(10) order by r) as content, 0.6::double as importance, count(*)::int as n from t where r > 3 group by tenant_id, agent_id""",
    "decay_forget": f"""with {_M}, f as (select *, state = 'active' and importance * pow(0.5::double, date_diff('day', valid_from, timestamp '{NOW}') / 30.0) < 0.2 as gone from m)
select id, case when gone then 'expired' else state end as state, case when gone then epoch_us(timestamp '{NOW}') else epoch_us(valid_to) end as to_us from f""",
    "feedback_apply": f"""with {_M} select id, round(case when state = 'active' and version % 3 = 1 then least(importance + 0.1, 1.0) else importance end, 6) as importance,
  version + case when state = 'active' and version % 3 = 1 then 1 else 0 end as version, case when state = 'active' and version % 3 = 2 then 'expired' else state end as state from m""",
    "patch_apply": f"""with {_M}, h as (select *, coalesce(state = 'active' and mem_type = 'episodic', false) as hit from m)
select id, round(case when hit then coalesce(greatest(0, least(1, importance + 0.5)), importance) else importance end, 6) as importance, case when hit then 'semantic' else mem_type end as mem_type, version + hit::int as version from h""",
    "plan_adds": f"""with {_M}, a as (select *, row_number() over (partition by {_SCOPE}, subject order by valid_from desc, id desc) as r from m where state = 'active' and subject is not null),
  n as (select {_SCOPE}, subject, 'new-' || min(id) as nid, arg_min(content, id) as c, arg_min(version, id) as v from a group by {_SCOPE}, subject),
  j as (select a.*, n.nid, case when n.v % 2 = 1 then n.c else n.c || ' again' end as nc from a join n on a.tenant_id = n.tenant_id and a.user_id is not distinct from n.user_id and a.agent_id is not distinct from n.agent_id and a.session_id is not distinct from n.session_id and a.subject = n.subject),
  h as (select *, trim(content) = trim(nc) as same from j where r = 1)
select id, 'Confirmed' as outcome, state, version + 1 as version, supersedes, round(greatest(importance, 0.9), 6) as importance from h where same
union all select nid, 'Superseded', 'active', 1, id, 0.9 from h where not same
union all select j.id, 'Closed', 'superseded', j.version, j.supersedes, round(j.importance, 6) from j join (select nid from h where not same) using (nid)""",
    "provenance": f"""with {_M}, {EVENTS}, s as (select distinct id, tenant_id, lower(e) as event_id from (select id, tenant_id, unnest(source_event_ids) as e from m))
select s.id, event_id, ev.source as event_source, ev.event_type, epoch_us(ev.ts) as event_us from s join ev on ev.id = event_id and ev.tenant = s.tenant_id""",
    "memory_scopes": f"with {_M} select user_id, agent_id, session_id, count(*) as n from m where state = 'active' group by user_id, agent_id, session_id",
    "list_paged": f"""with {_M} select id, importance from m where state = 'active' and tenant_id = 'default' and agent_id = 'agent-00007' and mem_type = 'semantic' and importance >= 0.3 order by importance desc, valid_from desc, id limit 10 offset 10""",
    "memory_counts": f"with {_M} select state, mem_type, count(*) as n, round(sum(importance), 3) as importance from m group by state, mem_type",
    "published": f"with {_M} select id from m where state = 'active' and json_valid(metadata) and json_extract_string(metadata, '$.published') = 'true'",
    "scope_erase": f"with {_M} select tenant_id, count(*) as n from m where tenant_id <> 'nordwerk' group by tenant_id",
    "event_counts": f"with {EVENTS} select source, lower(trim(event_type)) as kind, count(*) as n, count(distinct session_id) as sessions from ev group by 1, 2",
    "events_in_range": "select distinct lower(id) as id, epoch_us(ts) as us, epoch_us(ingested_at) as seen_us from episodic where ts between timestamp '2018-01-10' and timestamp '2018-01-12'",
    "distinct_sources": "select distinct coalesce(tenant_id, 'default') as tenant_id, source from episodic",
    "idempotent_ingest": f"with {EVENTS} select id, source from ev",
    "entity_events": f"with {EVENTS} select id from ev where contains(payload, 'recall step')",
    "retention_sweep": f"""with {EVENTS} select source, count(*) as n from ev where source = 'agent-00000' or ts >= timestamp '{NOW}' - case when source = 'agent-00007' then interval 40 day else interval 50 day end group by source""",
    "webhook_normalize": """select event_id, case user_id % 5 when 0 then 'github/org/r' || user_id when 1 then 'sentry/p' || user_id when 2 then 'slack/c' || user_id when 3 then 'pagerduty/s' || user_id else 'custom-' || user_id end as source,
  case user_id % 5 when 0 then case when user_id % 2 = 0 then 'issue.' || event_type else 'push' end when 1 then 'issue.' || event_type when 2 then event_type when 3 then 'incident.trigger' else event_type end as event_type from events""",
    "session_recall": f"with {EVENTS} select session_id, id, (row_number() over (partition by session_id order by ts, id))::int as place from ev where session_id is not null",
    "session_digest": f"""with {EVENTS}, t as (select *, row_number() over (partition by session_id order by ts, id) as r from ev where session_id is not null qualify r <= 200)
select session_id, count(*) as n_events, 'Session ' || session_id || ' summary. Events:' || chr(10) || string_agg('- [' || coalesce(source, '') || '] ' || coalesce(event_type, 'event') || ': ' || substring(coalesce(payload, ''), 1, 300), chr(10) order by r) || chr(10) as digest from t group by session_id""",
    "trigger_match": f"""with {EVENTS}, t as (from (values ('all-messages', 'a', '*', 'message'), ('seven', 'b', 'agent-00007', '*'), ('pair', 'c', 'agent-00000', 'tool.trace'), ('any', 'd', '*', '*')) t(name, agent_id, s, e))
select name as trigger, t.agent_id, id as event_id from ev join t on (s = '*' or s = source) and (e = '*' or e = event_type)""",
    "last_view": """with b as (select * from events where event_type = 'purchase'), v as (select user_id, ts, max(event_id) as view_id from events where event_type = 'view' group by all)
select b.event_id, v.view_id from b asof left join v on b.user_id = v.user_id and b.ts >= v.ts""",
    "orphan_runs": """with r as (select * from runs where id is not null qualify row_number() over (partition by lower(id) order by updated_at desc) = 1)
select lower(id) as id, status from r where status in ('pending', 'running') and updated_at < timestamp '2018-01-20'""",
    "run_ledger": """with r as (select * from runs where id is not null qualify row_number() over (partition by lower(id) order by updated_at desc) = 1)
select coalesce(tenant_id, 'default') as tenant_id, status, count(*) as n, round(avg((epoch_us(ended_at) - epoch_us(started_at)) / 1e6::double), 3) as seconds from r group by 1, 2""",
    "state_current": f"with {_STATE} select agent_id, key, value, version from cur",
    "state_ttl": f"with {_STATE} select agent_id, key, version from cur where changed_at + interval 10 day > timestamp '2018-01-20'",
    "state_set": f"with {_STATE} select agent_id, key, case when coalesce(deleted, false) then 0 else version end + 1 as version from sc",
    "state_cas": f"""with {_STATE}, h as (select agent_id, key, case when coalesce(deleted, false) then 0 else version end as have from sc) select agent_id, key, have = 2 as applied, have + (have = 2)::int as version from h""",
    "state_prefix": f"with {_STATE} select agent_id, count(*) as n from cur where starts_with(agent_id, 'agent-0000') group by agent_id",
    "edge_neighbors": f"with {_EDGES} select src, dst, weight from ed where src = 's1' or dst = 's1' order by weight desc, id limit 50",
    "edge_as_of": f"with {_EDGES} select dst, count(*) as n from ed where valid_from <= timestamp '1996-01-01' group by dst",
    "functional_link": """with e as (select printf('%010d-%02d', l_orderkey, l_linenumber) as id, l_partkey, l_shipdate from lineitem), n as (select *, lead(id) over w as nid, lead(l_shipdate) over w as nt from e window w as (partition by l_partkey order by l_shipdate, id))
select id, epoch_us(nt) as to_us, nid as invalidated_by, case when nid is null then 'active' else 'superseded' end as state from n""",
    "degree_centrality": f"with {_EDGES} select node, sum(i)::bigint as in_degree, sum(o)::bigint as out_degree from (select src as node, 0 as i, 1 as o from ed union all select dst, 1, 0 from ed) group by node",
    "pagerank": f"""with {_EDGES}, ne as (select c_nationkey::varchar as src, s_nationkey::varchar as dst, sum(weight) as w from ed join customer on 'c' || c_custkey = src join supplier on 's' || s_suppkey = dst group by 1, 2),
  p as (select src, dst, w / sum(w) over (partition by src) as pr from ne), nodes as (select src as node from p union select dst from p),
  r0 as (select node, 1.0::double / (select count(*) from nodes) as r from nodes), {_CTES} select node, round(r, 9) as pagerank from r40""",
    "subgraph_2hop": f"""with {_EDGES}, h1 as (select * from ed where src = 'c1' or dst = 'c1'), n1 as (select src as n from h1 union select dst from h1), h2 as (select * from ed where src in (from n1) or dst in (from n1))
select case when id in (select id from h1) then 1 else 2 end as hop, count(*) as n, round(sum(weight), 6) as weight from h2 group by 1""",
}
