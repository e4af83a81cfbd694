"""Bi-temporal memories: planning of adds, reads as of a time, upkeep.

Everything is a function from tables to tables with an explicit ``now``; a
store applies the changed rows (see sources.store). A scope is the exact tuple
(tenant_id, user_id, agent_id, session_id), nulls match nulls only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import decayed
from .vectors import knn

SCOPE = ["tenant_id", "user_id", "agent_id", "session_id"]


def in_scope(tenant: str | None = "default", user: str | None = None, agent: str | None = None, session: str | None = None) -> Column:
    """Rows of one exact scope; an empty tenant is ``default``."""
    want = (tenant or "default", user, agent, session)
    return F.expr(" and ".join(f"{c} <=> {'null' if v is None else _quote(v)}" for c, v in zip(SCOPE, want)))


def _quote(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def valid_at(t: Column, start: str = "valid_from", end: str = "valid_to", open_start: bool = False) -> Column:
    """start <= t < end, a null end is open; ``open_start``: a null start is since ever."""
    begun = F.col(start) <= t
    if open_start:
        begun = F.col(start).isNull() | begun
    return begun & (F.col(end).isNull() | (F.col(end) > t))


def versions(observed: DataFrame, keys: list[str], content: str, time: str, seq: str, importance: str | None = None) -> DataFrame:
    """The version chain that a series of adds leaves: one row per run of equal trimmed content.

    Columns: keys, content, first_seq, valid_from, valid_to, version (confirmations
    + 1), importance (the largest), outcome (Inserted or Superseded), supersedes
    (first_seq of the version before), state. Order is (time, seq).
    """
    w = Window.partitionBy(*keys).orderBy(time, seq)
    same = F.trim(F.lag(content).over(w)).eqNullSafe(F.trim(F.col(content))) & F.lag(seq).over(w).isNotNull()
    run = observed.withColumn("_run", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_run").over(w))
    imp = F.max(importance) if importance else F.lit(0.5)
    runs = run.groupBy(*keys, "_run").agg(
        F.min_by(content, F.struct(time, seq)).alias("content"),
        F.min(F.struct(time, seq)).getField(seq).alias("first_seq"),
        F.min(time).alias("valid_from"),
        F.count(F.lit(1)).alias("version"),
        imp.alias("importance"),
    )
    c = Window.partitionBy(*keys).orderBy("_run")
    return runs.select(
        *keys,
        "content",
        "first_seq",
        "valid_from",
        F.lead("valid_from").over(c).alias("valid_to"),
        "version",
        "importance",
        F.when(F.col("_run") == 1, "Inserted").otherwise("Superseded").alias("outcome"),
        F.lag("first_seq").over(c).alias("supersedes"),
        F.when(F.lead("valid_from").over(c).isNull(), "active").otherwise("superseded").alias("state"),
    )


def as_of(mem: DataFrame, keys: list[str], t: Column) -> DataFrame:
    """The latest memory of each key that was valid at t, whatever its state is now."""
    w = Window.partitionBy(*keys).orderBy(F.desc("valid_from"), F.desc("id"))
    return mem.filter(valid_at(t)).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def history(mem: DataFrame, scope: Column, subject: str) -> DataFrame:
    """Every version of a subject in a scope, oldest first."""
    return mem.filter(scope & (F.col("subject") == subject)).orderBy("valid_from", "id")


def plan_subject_adds(actives: DataFrame, inputs: DataFrame, now: Column, review: bool = False) -> DataFrame:
    """Changed rows for one input per (scope, subject) against the active memories.

    Equal trimmed content confirms the most recent active (version + 1, larger
    importance; metadata and sources stay); other content supersedes all actives
    and inserts, or in review mode inserts beside them. Columns: those of a
    memory, and ``outcome``.
    """
    keys = [*SCOPE, "subject"]
    w = Window.partitionBy(*keys).orderBy(F.desc("valid_from"), F.desc("id"))
    act = actives.filter("state = 'active'").withColumn("_r", F.row_number().over(w))
    new = inputs.select(*[F.col(k).alias(f"_n{k}") for k in keys], F.struct(F.col("id"), F.col("content"), F.col("importance"), F.col("source_event_ids"), F.col("metadata"), F.col("mem_type")).alias("n"))
    on = [F.col(k).eqNullSafe(F.col(f"_n{k}")) for k in keys]
    head = act.filter("_r = 1").join(new, on, "inner")
    same = F.trim("content") == F.trim("n.content")
    cols = actives.columns
    confirmed = head.filter(same).withColumns({"version": F.col("version") + 1, "importance": F.greatest("importance", F.coalesce("n.importance", F.lit(0.5))), "updated_at": now}).select(*cols, F.lit("Confirmed").alias("outcome"))

    def fresh(df: DataFrame, outcome: str, supersedes: Column) -> DataFrame:
        made = {
            **{k: F.col(f"_n{k}") for k in keys}, "id": F.col("n.id"), "content": F.col("n.content"), "importance": F.coalesce("n.importance", F.lit(0.5)), "source_event_ids": F.col("n.source_event_ids"), "metadata": F.col("n.metadata"),
            "mem_type": F.coalesce("n.mem_type", F.lit("semantic")), "valid_from": now, "valid_to": F.lit(None), "state": F.lit("active"), "supersedes": supersedes, "version": F.lit(1), "created_at": now, "updated_at": now,
        }
        kinds = dict(actives.dtypes)
        return df.select(*[made.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in cols], F.lit(outcome).alias("outcome"))

    changed = head.filter(~same)
    inserted = fresh(new.join(act.select(*keys), [F.col(k).eqNullSafe(F.col(f"_n{k}")) for k in keys], "left_anti"), "Inserted", F.lit(None))
    out = confirmed.unionByName(inserted)
    if review:
        return out.unionByName(fresh(changed, "Conflict", F.lit(None)))
    closing = act.join(changed.select(*[F.col(k).alias(f"_x{k}") for k in keys]), [F.col(k).eqNullSafe(F.col(f"_x{k}")) for k in keys], "left_semi")
    closed = closing.withColumns({"state": F.lit("superseded"), "valid_to": now, "updated_at": now}).select(*cols, F.lit("Closed").alias("outcome"))
    return out.unionByName(closed).unionByName(fresh(changed, "Superseded", F.col("id")))


def apply_rows(mem: DataFrame, changed: DataFrame) -> DataFrame:
    """The table with changed rows in place of those of equal id, and new ones added."""
    rows = changed.select(*mem.columns)
    return mem.join(rows.select("id"), "id", "left_anti").unionByName(rows)


def merge_fold(rows: DataFrame, scope: str, order: str, vector: str, threshold: float = 0.92) -> DataFrame:
    """Adds without subject, in order: each merges into the nearest active of its scope at or above the threshold.

    (scope, order, outcome, merged_into): the old row is closed and the new one
    takes its place. The state of a scope is the set of its actives; rows come
    in order, batch by batch, so memory follows the actives, not the history.
    """
    sk, ok = rows.schema[scope].dataType.simpleString(), rows.schema[order].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        now, act, ids, n = object(), None, [], 0
        for pdf in batches:
            out = []
            for s, o, v in zip(pdf["scope"], pdf["o"], pdf["v"]):
                if s != now:
                    now, act, ids, n = s, np.zeros((64, len(v))), [], 0
                v = np.asarray(v, np.float64)
                v = v / (np.linalg.norm(v) or 1)
                best = -1
                if n:
                    sim = act[:n] @ v
                    best = int(sim.argmax())
                if best >= 0 and sim[best] >= threshold:
                    out.append((s, o, "Merged", ids[best]))
                    act[best], ids[best] = v, o
                    continue
                out.append((s, o, "Inserted", None))
                if n == len(act):
                    act = np.concatenate([act, np.zeros_like(act)])
                act[n] = v
                ids.append(o)
                n += 1
            yield pd.DataFrame(out, columns=["scope", "o", "outcome", "merged_into"]).astype({"merged_into": "object"})

    src = rows.filter(F.col(vector).isNotNull() & F.col(scope).isNotNull()).select(F.col(scope).alias("scope"), F.col(order).alias("o"), F.col(vector).alias("v"))
    out = src.repartition("scope").sortWithinPartitions("scope", "o").mapInPandas(run, f"scope {sk}, o {ok}, outcome string, merged_into {ok}")
    return out.select(F.col("scope").alias(scope), F.col("o").alias(order), "outcome", "merged_into")


def plan_similar_adds(actives: DataFrame, inputs: DataFrame, now: Column, threshold: float = 0.92, vector: str = "embedding") -> DataFrame:
    """Changed rows for a batch of adds without subject, merged by likeness: those of a memory, its vector, and ``outcome``.

    An input whose nearest active of its scope (cosine, ties by id) is at or
    above the threshold is Merged: the active is Closed, and the new row takes
    its subject, the union of both source ids, the larger importance and points
    back to it. Of several inputs nearest to one active the nearest (then the
    smallest id) merges; the others, and those near none, are Inserted. A null
    vector is near nothing. Adds that build on one another go through
    ``merge_fold`` in order.
    """
    cols = actives.columns
    near = knn(
        actives.filter("state = 'active'").select("id", vector, _scope_text().alias("_scope")), inputs.select(F.col("id").alias("query_id"), vector, _scope_text().alias("_scope")), 1, vector=vector, scope="_scope"
    ).filter(F.col("score") >= threshold)
    w = Window.partitionBy("id").orderBy(F.desc("score"), F.asc("query_id"))
    pair = near.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(F.col("query_id").alias("_new"), F.col("id").alias("_old"))
    old = actives.join(pair, F.col("id") == F.col("_old"))
    closed = old.withColumns({"state": F.lit("superseded"), "valid_to": now, "updated_at": now}).select(*cols, F.lit("Closed").alias("outcome"))
    kept = old.select("_new", "_old", F.struct("subject", "importance", "source_event_ids").alias("o"))
    new = inputs.join(kept, F.col("id") == F.col("_new"), "left")
    none = F.array().cast("array<string>")
    own = F.coalesce("source_event_ids", none)
    made = {
        "subject": F.coalesce("subject", "o.subject"), "importance": F.greatest(F.coalesce("importance", F.lit(0.5)), F.col("o.importance")),
        "source_event_ids": F.array_distinct(F.concat(F.coalesce("o.source_event_ids", none), own)), "valid_from": now, "valid_to": F.lit(None), "state": F.lit("active"), "supersedes": F.col("_old"),
        "version": F.lit(1), "created_at": now, "updated_at": now, "mem_type": F.coalesce("mem_type", F.lit("semantic")),
    }
    kinds = dict(actives.dtypes)
    fresh = new.select(*[made.get(c, F.col(c) if c in inputs.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in cols], F.when(F.col("_old").isNull(), "Inserted").otherwise("Merged").alias("outcome"))
    return closed.unionByName(fresh)


def _scope_text() -> Column:
    """A scope as one text, nulls apart from empty texts."""
    return F.to_json(F.struct(*SCOPE), {"ignoreNullFields": "false"})


def consolidate_similar(mem: DataFrame, clusters: DataFrame, now: Column) -> DataFrame:
    """Changed rows that replace each cluster (id, cluster) of active memories by its summary.

    The summary is a new memory with the id ``sum-<cluster>``, of the scope of
    the cluster's leader; its members expire.
    """
    act = mem.filter("state = 'active'").join(clusters.select("id", F.col("cluster").alias("_c")), "id")
    gone = act.withColumns({"state": F.lit("expired"), "valid_to": now, "updated_at": now}).select(*mem.columns)
    lead = act.filter("id = _c").select("_c", *SCOPE)
    made = summarize(act, ["_c"], "importance").join(lead, "_c")
    kinds = dict(mem.dtypes)
    value = {
        "id": F.concat(F.lit("sum-"), F.col("_c")), **{c: F.col(c) for c in (*SCOPE, "content", "importance", "source_event_ids")}, "state": F.lit("active"), "version": F.lit(1), "mem_type": F.lit("semantic"),
        "valid_from": now, "created_at": now, "updated_at": now,
    }
    return gone.unionByName(made.select(*[value.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in mem.columns]))


def touch(mem: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """mem with the named active rows (id) marked as used now."""
    j = mem.join(ids.select("id").distinct().withColumn("_t", F.lit(True)), "id", "left")
    return j.withColumn("updated_at", F.when(F.col("_t") & (F.col("state") == "active"), now).otherwise(F.col("updated_at"))).select(*mem.columns)


def supersede(mem: DataFrame, pairs: DataFrame, now: Column) -> DataFrame:
    """mem with each active ``old`` of pairs (old, new) closed, and ``new`` pointing back to it."""
    j = mem.join(pairs.select(F.col("old").alias("id"), F.lit(True).alias("_o")).distinct(), "id", "left")
    j = j.join(pairs.groupBy(F.col("new").alias("id")).agg(F.min("old").alias("_n")), "id", "left")
    hit = F.coalesce("_o", F.lit(False)) & (F.col("state") == "active")
    return j.withColumns(
        {"state": F.when(hit, "superseded").otherwise(F.col("state")), "valid_to": F.when(hit, now).otherwise(F.col("valid_to")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at")), "supersedes": F.coalesce("_n", "supersedes")}
    ).select(*mem.columns)


def facts_to_adds(facts: DataFrame) -> DataFrame:
    """Inputs for ``plan_subject_adds`` of rows (id, scope columns, facts: array<struct<subject, content>>).

    Ids are ``<id>-<place>``; of several facts of one scope and subject the last of the largest id stands.
    """
    f = facts.select("id", *SCOPE, F.posexplode("facts").alias("_p", "f"))
    f = f.select(F.concat("id", F.lit("-"), F.col("_p").cast("string")).alias("id"), *SCOPE, F.lower(F.trim(F.regexp_replace("f.subject", r"[\s\p{Z}]+", " "))).alias("subject"), F.col("f.content").alias("content"), "_p", F.col("id").alias("_o"))
    w = Window.partitionBy(*SCOPE, "subject").orderBy(F.desc("_o"), F.desc("_p"))
    one = f.withColumn("_r", F.row_number().over(w)).filter("_r = 1 or subject is null")
    return one.select("id", *SCOPE, "subject", "content", F.lit(None).cast("double").alias("importance"), F.array().cast("array<string>").alias("source_event_ids"), F.lit(None).cast("string").alias("metadata"), F.lit(None).cast("string").alias("mem_type"))


def contradictions(mem: DataFrame) -> DataFrame:
    """Members of subjects with more than one active memory in a scope: (scope, subject, n, id, content).

    The count is made map-side and joined back, so no group is gathered.
    """
    keys = [*SCOPE, "subject"]
    act = mem.filter("state = 'active' and subject is not null")
    several = act.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*[F.col(k).alias(f"_g{k}") for k in keys], "n")
    return act.join(several, [F.col(k).eqNullSafe(F.col(f"_g{k}")) for k in keys]).select(*keys, "n", "id", "content")


def resolve(mem: DataFrame, scope: Column, subject: str, keep_id: str, now: Column) -> DataFrame:
    """Closed losers of a contradiction; an error where ``keep_id`` isn't an active member."""
    act = mem.filter(scope & (F.col("subject") == subject) & (F.col("state") == "active"))
    if act.filter(F.col("id") == keep_id).isEmpty():
        raise ValueError(f"{keep_id} is no active memory of subject {subject!r} in this scope")
    return act.filter(F.col("id") != keep_id).withColumns({"state": F.lit("superseded"), "valid_to": now, "updated_at": now, "supersedes": F.lit(keep_id)})


def feedback(mem: DataFrame, signals: DataFrame, now: Column) -> DataFrame:
    """mem after signals (id, signal): helpful adds 0.1 up to 1 and a version; wrong and obsolete expire."""
    s = signals.groupBy("id").agg(F.max(F.col("signal").isin("wrong", "obsolete")).alias("_bad"), F.max(F.col("signal") == "helpful").alias("_good"))
    j = mem.join(s, "id", "left")
    bad = F.coalesce("_bad", F.lit(False)) & (F.col("state") == "active")
    good = F.coalesce("_good", F.lit(False)) & ~bad & (F.col("state") == "active")
    return j.withColumns(
        {
            "importance": F.when(good, F.least(F.col("importance") + 0.1, F.lit(1.0))).otherwise(F.col("importance")),
            "version": F.col("version") + F.when(good, 1).otherwise(0),
            "valid_to": F.when(bad, now).otherwise(F.col("valid_to")),
            "updated_at": F.when(bad | good, now).otherwise(F.col("updated_at")),
            "state": F.when(bad, "expired").otherwise(F.col("state")),
        }
    ).select(*mem.columns)


def patch(mem: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """mem after patches (id, content, importance, mem_type, metadata), nulls leave a field; active rows only."""
    p = patches.select(F.col("id"), F.struct("content", "importance", "mem_type", "metadata").alias("_p"))
    j = mem.join(p, "id", "left")
    hit = F.col("_p").isNotNull() & (F.col("state") == "active")
    take = lambda c, v: F.when(hit, F.coalesce(v, F.col(c))).otherwise(F.col(c))
    return j.withColumns(
        {
            "content": take("content", F.col("_p.content")),
            "importance": take("importance", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_p.importance")))),
            "mem_type": take("mem_type", F.col("_p.mem_type")),
            "metadata": take("metadata", F.col("_p.metadata")),
            "version": F.col("version") + F.when(hit, 1).otherwise(0),
            "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
        }
    ).select(*mem.columns)


def expire(mem: DataFrame, condition: Column, now: Column) -> DataFrame:
    """mem with the active rows that meet the condition expired."""
    hit = (F.col("state") == "active") & F.coalesce(condition, F.lit(False))
    return mem.withColumns({"valid_to": F.when(hit, now).otherwise(F.col("valid_to")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at")), "state": F.when(hit, "expired").otherwise(F.col("state"))})


def forget(mem: DataFrame, now: Column, half_life_days: float = 30.0, threshold: float = 0.05) -> DataFrame:
    """Decay: active rows whose decayed importance falls below the threshold expire."""
    return expire(mem, decayed(F.col("importance"), F.col("valid_from"), now, half_life_days) < threshold, now)


def over_cap(mem: DataFrame, cap: int) -> DataFrame:
    """Active rows beyond the ``cap`` best of their scope by importance, then update time; none for cap 0."""
    if cap <= 0:
        return mem.limit(0)
    w = Window.partitionBy(*SCOPE).orderBy(F.desc("importance"), F.desc("updated_at"), F.asc("id"))
    return mem.filter("state = 'active'").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") > cap).drop("_r")


def consolidate_tail(mem: DataFrame, keep: int, scope: list[str] = SCOPE) -> DataFrame:
    """One summary per scope of the active rows beyond the ``keep`` most important.

    (scope, content, importance 0.6, source_memory_ids); the members then expire.
    """
    w = Window.partitionBy(*scope).orderBy(F.desc("importance"), F.desc("valid_from"), F.asc("id"))
    tail = mem.filter("state = 'active'").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") > keep)
    return summarize(tail, scope, "_r").withColumn("importance", F.lit(0.6))


def summarize(members: DataFrame, group: list[str], order: str) -> DataFrame:
    """(group, content, importance, source_memory_ids, source_event_ids) of consolidated members in order."""
    items = F.sort_array(F.collect_list(F.struct(order, "id", "content", "source_event_ids")))
    g = members.groupBy(*group).agg(items.alias("m"), F.max("importance").alias("importance"))
    lines = F.transform("m", lambda x: F.concat(F.lit("- "), F.coalesce(x["content"], F.lit(""))))
    head = F.concat(F.lit("Consolidated "), F.size("m").cast("string"), F.lit(" memories:\n"))
    return g.select(
        *group,
        F.concat(head, F.array_join(lines, "\n")).alias("content"),
        "importance",
        F.transform("m", lambda x: x["id"]).alias("source_memory_ids"),
        F.array_distinct(F.flatten(F.transform("m", lambda x: F.coalesce(x["source_event_ids"], F.array().cast("array<string>"))))).alias("source_event_ids"),
    )


def list_paged(mem: DataFrame, scope: Column, limit: int = 100, offset: int = 0, mem_type: str | None = None, min_importance: float | None = None, updated_after: Column | None = None, updated_before: Column | None = None, metadata: tuple[str, str] | None = None) -> DataFrame:
    """One page of the active memories of a scope by importance, then recency, then id."""
    out = mem.filter(scope & (F.col("state") == "active"))
    if mem_type is not None:
        out = out.filter(F.col("mem_type") == mem_type)
    if min_importance is not None:
        out = out.filter(F.col("importance") >= min(max(min_importance, 0.0), 1.0))
    if updated_after is not None:
        out = out.filter(F.col("updated_at") >= updated_after)
    if updated_before is not None:
        out = out.filter(F.col("updated_at") < updated_before)
    if metadata is not None:
        key, value = metadata
        safe = bool(key) and all(c.isascii() and (c.isalnum() or c in "_-") for c in key)
        out = out.filter(F.get_json_object("metadata", f"$['{key}']") == value) if safe else out.filter(F.lit(False))
    return out.orderBy(F.desc("importance"), F.desc("valid_from"), F.asc("id")).offset(min(max(offset, 0), 10_000_000)).limit(min(max(limit, 1), 10_000))


def scopes(mem: DataFrame, tenant: str | None = None) -> DataFrame:
    """(user_id, agent_id, session_id, n) of active memories, most first."""
    act = mem.filter("state = 'active'")
    if tenant is not None:
        act = act.filter(F.col("tenant_id") == tenant)
    return act.groupBy("user_id", "agent_id", "session_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("user_id"), F.asc_nulls_last("agent_id"), F.asc_nulls_last("session_id"))


def provenance(mem: DataFrame, events: DataFrame) -> DataFrame:
    """(id, event_id, event_source, event_type, event_ts): the source events of each memory within its tenant."""
    ids = mem.select(F.col("id"), "tenant_id", F.explode("source_event_ids").alias("event_id")).withColumn("event_id", F.lower("event_id")).distinct()
    e = events.select(F.col("id").alias("event_id"), F.col("tenant_id"), F.col("source").alias("event_source"), "event_type", F.col("ts").alias("event_ts"))
    return ids.join(e, ["event_id", "tenant_id"]).select("id", "event_id", "event_source", "event_type", "event_ts")


def add_grants(grants: DataFrame, new: DataFrame) -> DataFrame:
    """grants (tenant_id, grantor_user, grantee_user) with new ones, each once; nobody grants to themselves."""
    cols = ["tenant_id", "grantor_user", "grantee_user"]
    return grants.select(*cols).unionByName(new.select(*cols)).filter("not grantor_user <=> grantee_user").distinct()


def revoke_grants(grants: DataFrame, gone: DataFrame) -> DataFrame:
    cols = ["tenant_id", "grantor_user", "grantee_user"]
    return grants.join(gone.select(*cols).distinct(), cols, "left_anti")


def list_grants(grants: DataFrame, tenant: str, grantor: str | None = None) -> DataFrame:
    """A tenant's grants, of one grantor if given, in order."""
    out = grants.filter(F.col("tenant_id") == tenant)
    return (out if grantor is None else out.filter(F.col("grantor_user") == grantor)).orderBy("grantor_user", "grantee_user")


def shared_scopes(grants: DataFrame, tenant: str, user: str) -> DataFrame:
    """(tenant_id, user_id) whose memories a user may search: their own and those of their grantors."""
    own = grants.sparkSession.createDataFrame([(tenant, user)], "tenant_id string, user_id string")
    given = grants.filter((F.col("tenant_id") == tenant) & (F.col("grantee_user") == user)).select("tenant_id", F.col("grantor_user").alias("user_id"))
    return own.unionByName(given).distinct()


def erase(tables: dict[str, DataFrame], tenant: str, user: str | None = None) -> dict[str, DataFrame]:
    """All tables without a tenant's rows; with ``user``, memories without those of one user."""
    if user is not None:
        return {n: t.filter(~((F.col("tenant_id") == tenant) & F.col("user_id").eqNullSafe(F.lit(user)))) if n == "memories" else t for n, t in tables.items()}
    return {n: t.filter(F.coalesce(F.col("tenant_id"), F.lit("default")) != tenant) for n, t in tables.items()}
