"""The queries of the general problems 1 to 5 and 7, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..entities import link_norm, micros, retries, standing_events, standing_memories, standing_runs, subject_norm, tenant
from ..operators.asof import attributes_as_known
from ..operators.changefeed import current_state
from ..operators.hierarchy import descendants, resolve_tree
from ..operators.intervals import periods_and_gaps
from ..operators.nested import array_items, child_table, element_kinds, schema_graph, shred, table_elements
from ..operators.sessions import sessionize
from ..session import Scratch, file_state, load

PAUSE_US = 30 * 60 * 1_000_000


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    ep, mem = load(spark, d, "episodic"), load(spark, d, "memories")
    doc = F.try_parse_json("payload")
    named = subject_norm(F.try_variant_get(doc, "$.subject", "string"))
    ev = standing_events(ep, tenant().alias("tenant"), F.col("source").alias("agent"), named.alias("subject"), micros("ts").alias("ts"))
    ev = ev.filter("subject is not null and subject <> ''").withColumnRenamed("id", "event_id")
    m = standing_memories(mem, tenant().alias("tenant"), F.col("agent_id").alias("agent"), subject_norm("subject").alias("subject"),
                          micros("valid_from").alias("valid_from"), micros("valid_to").alias("valid_to"), micros("created_at").alias("recorded"))
    scratch = Scratch(spark, "asof")
    return attributes_as_known(scratch.cut(ev), scratch.cut(m.withColumnRenamed("id", "memory_id")))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return standing_events(load(spark, d, "episodic"), "payload", "tags")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The repeated rows of all tables that shared inlining gives, and the tags."""
    ev = _records(spark, d)
    tables = table_elements(schema_graph(load(spark, d, "episodic"), "payload"))
    rows = shred(ev, "id", "payload", tables, columns=False, lists=("tags",)).filter("kind = 'repeated' or kind = 'value'")
    return rows.select(F.col("record_id").alias("event_id"), "node_path", F.col("array_path").alias("parent_path"))


def p2_tags(spark: SparkSession, d: str) -> DataFrame:
    """The child table of the tags."""
    ev = standing_events(load(spark, d, "episodic"), "tags")
    return array_items(ev, "id", "tags", "tags").select(F.col("record_id").alias("event_id"), "node_path", F.col("value").alias("tag"))


_SHREDDED: dict[tuple, DataFrame] = {}


def _tables(spark: SparkSession, d: str) -> DataFrame:
    """All tables of the payloads, shredded once per session and state of the file, written by kind, in order of the elements."""
    key = file_state(spark, d, "episodic")
    if key not in _SHREDDED:
        tables = table_elements(schema_graph(load(spark, d, "episodic"), "payload"))
        out = shred(_records(spark, d), "id", "payload", tables)
        _SHREDDED[key] = Scratch(spark, "tables").cut(out.sortWithinPartitions("kind", "element"), partition_by=["kind"])
    return _SHREDDED[key]


def _child(element: str, columns: list[str]):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = child_table(_tables(spark, d).filter("kind = 'repeated'"), element, columns)
        return rows.withColumnRenamed("record_id", "event_id")

    return query


def p2_top(spark: SparkSession, d: str) -> DataFrame:
    """The parent table: one row per record, with the inlined fields as JSON in order of their names."""
    top = _tables(spark, d).filter("kind = 'top'")
    fields = F.array_sort(F.map_entries("columns"))
    return top.select(F.col("record_id").alias("event_id"), F.to_json(F.map_from_entries(fields), {"ignoreNullFields": "false"}).alias("fields"))


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """Scalars in arrays of the payloads."""
    v = _tables(spark, d).filter("kind = 'value'")
    return v.select(F.col("record_id").alias("event_id"), "element", "node_path", "parent_path", F.col("columns")["value"].alias("value"))


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    """How the tables hang together: how many rows of an element hang below rows of which."""
    t = _tables(spark, d).filter("kind <> 'value'").select("record_id", "element", "kind", "node_path", "parent_path")
    up = t.select("record_id", F.col("node_path").alias("parent_path"), F.col("element").alias("above"))
    return t.filter("parent_path is not null").join(up, ["record_id", "parent_path"], "left").groupBy("element", "kind", "above").agg(F.count(F.lit(1)).alias("n"))


def p2_elements(spark: SparkSession, d: str) -> DataFrame:
    """The elements with a table, and why."""
    return element_kinds(schema_graph(load(spark, d, "episodic"), "payload"))


def p2_schema(spark: SparkSession, d: str) -> DataFrame:
    return schema_graph(load(spark, d, "episodic"), "payload")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    raw, key = load(spark, d, "memories"), [tenant().alias("tenant_id"), F.col("agent_id"), subject_norm("subject").alias("subject")]
    m = standing_memories(raw, *key, micros("valid_from").alias("s"), micros("valid_to").alias("e"))
    return periods_and_gaps(m, ["tenant_id", "agent_id", "subject"], "s", "e", count_from=raw.select(*key))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    feed = load(spark, d, "state_changes").select("feed_offset", "agent_id", "key", "version", "deleted", "changed_at")
    now = current_state(feed, ["agent_id", "key"], "changed_at", "version", "deleted", "feed_offset")
    return now.select("agent_id", "key", "version", micros("changed_at").alias("changed_us"))


def p4_state(spark: SparkSession, d: str) -> DataFrame:
    feed = load(spark, d, "state_changes").drop("arrived_at")
    now = current_state(feed, ["agent_id", "key"], "changed_at", "version", "deleted", "feed_offset")
    return now.select("agent_id", "key", "value", "version", micros("changed_at").alias("changed_us"))


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    ep = load(spark, d, "episodic")
    kind = F.lower(F.trim(F.regexp_replace("event_type", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")))
    ev = standing_events(ep, tenant().alias("tenant"), "source", micros("ts").alias("us"), kind.alias("kind"))
    raw = ep.filter("source is not null and ts is not null").select(tenant().alias("a"), F.col("source").alias("b"))
    return sessionize(ev, "tenant", "source", "us", "kind", PAUSE_US, count_from=raw)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).drop("duration_us")


def p5_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d)


def _tree(spark: SparkSession, d: str, keep_path: bool) -> DataFrame:
    ep, runs = load(spark, d, "episodic"), load(spark, d, "runs")
    ev = standing_events(ep, link_norm("parent_id").alias("parent_id"))
    rn = standing_runs(runs, link_norm("parent_run_id").alias("parent_id"))
    e, r = F.lit("episodic").alias("table_name"), F.lit("runs").alias("table_name")
    nodes = ev.select(e, F.col("id").alias("node_id"), "parent_id").unionByName(rn.select(r, F.col("id").alias("node_id"), "parent_id"))
    nodes = Scratch(spark, "nodes").cut(nodes)
    own = nodes.select("table_name", F.col("node_id").alias("ref"), F.col("node_id").alias("canon"))
    refs = own.unionByName(retries(ep).select(e, F.col("id").alias("ref"), "canon"))
    return resolve_tree(nodes, refs, keep_path)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d, False).filter("parent_id is not null").select("table_name", "node_id", "root_id", "depth")


def p7_paths(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d, True).select("table_name", "node_id", "root_id", "depth", F.array_join("path", "/").alias("path"))


def p7_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(_tree(spark, d, True))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_schema": p2_schema,
    "p2_tags": p2_tags,
    "p2_top": p2_top,
    "p2_values": p2_values,
    "p2_links": p2_links,
    "p2_elements": p2_elements,
    "p2_steps": _child("steps", ["tool", "ms", "note"]),
    "p2_calls": _child("calls", ["call_id", "args.q", "args.limit", "error.code", "error.detail"]),
    "p2_results": _child("results", ["ref", "score", "labels.lang"]),
    "p2_commits": _child("commits", ["id", "message"]),
    "p2_files": _child("files", ["path"]),
    "p2_hunks": _child("hunks", ["at", "add", "del"]),
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_state": p4_state,
    "p5_found": p5_found,
    "p5_sessions": p5_sessions,
    "p7_found": p7_found,
    "p7_paths": p7_paths,
    "p7_descendants": p7_descendants,
}
