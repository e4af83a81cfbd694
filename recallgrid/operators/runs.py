"""Sessions, run ledger, workflows, triggers, approvals, retention."""

from __future__ import annotations

from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("pending", "running", "waiting_approval", "succeeded", "failed", "cancelled")


def session_events(events: DataFrame, session: str, tenant: str | None = None) -> DataFrame:
    """Events of a session, oldest first."""
    out = events.filter(F.col("session_id") == session)
    if tenant is not None:
        out = out.filter(F.col("tenant_id") == tenant)
    return out.orderBy("ts", "id")


def session_digests(events: DataFrame, first: int = 200, cut: int = 300) -> DataFrame:
    """(session_id, n_events, digest): a line for each of the first events of every session, payloads cut."""
    w = Window.partitionBy("session_id").orderBy("ts", "id")
    top = events.filter("session_id is not null").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= first)
    line = F.concat(F.lit("- ["), F.coalesce("source", F.lit("")), F.lit("] "), F.coalesce("event_type", F.lit("event")), F.lit(": "), F.substring(F.coalesce("payload", F.lit("")), 1, cut))
    g = top.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("_r", line.alias("line")))).alias("m"))
    text = F.concat(F.lit("Session "), F.col("session_id"), F.lit(" summary. Events:\n"), F.array_join(F.transform("m", lambda x: x["line"]), "\n"), F.lit("\n"))
    return g.select("session_id", F.size("m").cast("long").alias("n_events"), text.alias("digest"))


def sessions_of(sessions: DataFrame, agent: str) -> DataFrame:
    return sessions.filter(F.col("agent_id") == agent).orderBy(F.desc("started_at"), "session_id")


def start_sessions(rows: DataFrame, now: Column) -> DataFrame:
    """New session rows (session_id, agent_id, parent_session_id, metadata, tenant_id)."""
    return rows.withColumns({"started_at": now, "ended_at": F.lit(None).cast("timestamp"), "summary": F.lit(None).cast("string")})


def end_sessions(sessions: DataFrame, ends: DataFrame, now: Column) -> DataFrame:
    """sessions with those named in ``ends`` (session_id, summary) closed."""
    j = sessions.join(ends.select("session_id", F.col("summary").alias("_s"), F.lit(True).alias("_e")), "session_id", "left")
    return j.withColumns({"ended_at": F.when(F.col("_e"), now).otherwise(F.col("ended_at")), "summary": F.coalesce("_s", "summary")}).drop("_s", "_e")


def create_runs(runs: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """runs with new pending ones (id, tenant_id, agent_id, parent_run_id, input) added; an id that is there stays as it is."""
    kinds = dict(runs.dtypes)
    made = {**{c: F.col(c) for c in ("id", "tenant_id", "agent_id", "parent_run_id", "input")}, "status": F.lit("pending"), "created_at": now, "updated_at": now}
    rows = new.dropDuplicates(["id"]).join(runs.select("id"), "id", "left_anti")
    return runs.unionByName(rows.select(*[made.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in runs.columns]))


def list_runs(runs: DataFrame, tenant: str, agent: str | None = None, status: str | None = None, limit: int | None = None) -> DataFrame:
    """A tenant's runs, newest first."""
    out = runs.filter(F.coalesce("tenant_id", F.lit("default")) == tenant)
    for c, v in (("agent_id", agent), ("status", status)):
        if v is not None:
            out = out.filter(F.col(c) == v)
    out = out.orderBy(F.desc("created_at"), "id")
    return out if limit is None else out.limit(limit)


def run_trace(events: DataFrame, run: str) -> DataFrame:
    """The step log of a run: the events recorded under its id as session or trace, numbered from 1 in order of time."""
    w = Window.partitionBy(F.lit(1)).orderBy("ts", "id")
    mine = events.filter((F.col("session_id") == run) | (F.col("trace_id") == run))
    return mine.withColumn("step", F.row_number().over(w))


def patch_runs(runs: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """runs after patches (id, status, result, error, cursor), nulls leave a field; final states set the end."""
    p = patches.select("id", F.struct("status", "result", "error", "cursor").alias("_p"))
    j = runs.join(p, "id", "left")
    hit = F.col("_p").isNotNull()
    final = F.col("_p.status").isin("succeeded", "failed", "cancelled")
    return j.withColumns(
        {
            **{c: F.coalesce(F.col(f"_p.{c}"), F.col(c)) for c in ("status", "result", "error", "cursor")},
            "started_at": F.when(hit & (F.col("_p.status") == "running"), F.coalesce("started_at", now)).otherwise(F.col("started_at")),
            "ended_at": F.when(hit & final, now).otherwise(F.col("ended_at")),
            "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
        }
    ).drop("_p")


def orphans(runs: DataFrame, cutoff: Column) -> DataFrame:
    """Runs pending or running without a change since the cutoff, oldest first."""
    return runs.filter(F.col("status").isin("pending", "running") & (F.col("updated_at") < cutoff)).orderBy("updated_at", "id")


def decide(approvals: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """approvals with pending ones approved or rejected, once only: the first decision of an id counts."""
    w = Window.partitionBy("id").orderBy("decided_at")
    d = decisions.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("id", F.when(F.col("approve"), "approved").otherwise("rejected").alias("_d"))
    j = approvals.join(d, "id", "left")
    hit = F.col("_d").isNotNull() & (F.col("status") == "pending")
    return j.withColumns({"status": F.when(hit, F.col("_d")).otherwise(F.col("status")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}).drop("_d")


def once(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key: repeated tool calls of a replay give their recorded result."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def workflow_order(nodes: list[dict]) -> list[str]:
    """Ids of workflow nodes in waves: each wave holds the nodes whose ``deps`` are done, by their place in the list.

    An unknown dependency or a cycle is an error. Workflows are small; this runs on the driver.
    """
    place = {n["id"]: i for i, n in enumerate(nodes)}
    if missing := {d for n in nodes for d in n.get("deps") or ()} - place.keys():
        raise ValueError(f"unknown dependency {min(missing)}")
    waves, out = TopologicalSorter({n["id"]: n.get("deps") or () for n in nodes}), []
    try:
        waves.prepare()
    except CycleError as e:
        raise ValueError("the workflow has a cycle") from e
    while waves.is_active():
        wave = sorted(waves.get_ready(), key=place.__getitem__)
        out += wave
        waves.done(*wave)
    return out


def run_workflow(nodes: list[dict], step) -> dict[str, object]:
    """Results of ``step(node, results)`` in order; stops at the first failure, which is raised."""
    by, done = {n["id"]: n for n in nodes}, {}
    for i in workflow_order(nodes):
        done[i] = step(by[i], done)
    return done


def match_triggers(events: DataFrame, triggers: DataFrame) -> DataFrame:
    """(trigger, agent_id, event_id): triggers whose source and type, or ``*``, meet an event's.

    The four wildcard patterns of an event are equi-joined, so no nested loop
    is needed however many triggers there are.
    """
    pats = F.array(*[F.struct(s.alias("_s"), t.alias("_t")) for s in (F.col("source"), F.lit("*")) for t in (F.col("event_type"), F.lit("*"))])
    e = events.select(F.col("id").alias("event_id"), "source", "event_type").select("event_id", F.explode(F.array_distinct(pats)).alias("p")).select("event_id", "p.*")
    t = triggers.select(F.col("name").alias("trigger"), "agent_id", F.coalesce("source", F.lit("*")).alias("_s"), F.coalesce("event_type", F.lit("*")).alias("_t"))
    return e.join(t, ["_s", "_t"]).select("trigger", "agent_id", "event_id")


def retained(events: DataFrame, policies: DataFrame, now: Column, default_days: int = 365) -> DataFrame:
    """Events that retention keeps: a source's own days (0 keeps all), else the default days (0 keeps all)."""
    p = policies.select(F.col("source").alias("_s"), F.col("days").alias("_d"))
    j = events.join(p, events.source == F.col("_s"), "left")
    days = F.coalesce("_d", F.lit(default_days))
    cutoff = F.timestamp_micros(F.unix_micros(now) - days.cast("long") * 86_400_000_000)
    return j.filter((days == 0) | (F.col("ts").cast("timestamp") >= cutoff)).drop("_s", "_d")
