"""Events in: shaping, tenant tags, idempotent append, webhooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BATCH = 10_000
COLUMNS = ["id", "tenant_id", "source", "event_type", "payload", "ts", "parent_id", "trace_id", "tags", "idempotency_key", "session_id"]


def shape_rest(spark, source: str, events: list[dict]) -> DataFrame:
    """Event rows of a request ``{source, events: [payload, …]}``; more than MAX_BATCH are refused."""
    import json

    if len(events) > MAX_BATCH:
        raise ValueError(f"at most {MAX_BATCH} events a batch")
    rows = [(source, e.get("event_type") if isinstance(e.get("event_type"), str) else "unknown", json.dumps(e), e.get("idempotency_key")) for e in events]
    return spark.createDataFrame(rows, "source string, event_type string, payload string, idempotency_key string")


def tagged(events: DataFrame, tenant: str | None = None) -> DataFrame:
    """tenant_id and session_id as columns: given, or from the payload's ``_tenant_id`` and ``_session_id``."""
    t = F.lit(tenant) if tenant else F.coalesce(F.get_json_object("payload", "$._tenant_id"), F.lit("default"))
    s = F.get_json_object("payload", "$._session_id")
    return events.withColumns({"tenant_id": t, "session_id": F.coalesce(F.col("session_id"), s) if "session_id" in events.columns else s})


def new_events(stored: DataFrame, batch: DataFrame, arrival: str, per_tenant: bool = True) -> DataFrame:
    """Rows of a batch to append: the first arrival of an id and of a non-null key, none that is stored."""
    scope = ["tenant_id"] if per_tenant else []
    by_id = Window.partitionBy("id").orderBy(arrival)
    by_key = Window.partitionBy(*scope, "idempotency_key").orderBy(arrival)
    b = batch.withColumn("_i", F.row_number().over(by_id)).filter("_i = 1").drop("_i")
    keyless = b.filter("idempotency_key is null")
    keyed = b.filter("idempotency_key is not null").withColumn("_k", F.row_number().over(by_key)).filter("_k = 1").drop("_k")
    keyed = keyed.join(stored.filter("idempotency_key is not null").select(*scope, "idempotency_key"), [*scope, "idempotency_key"], "left_anti")
    return keyless.unionByName(keyed).join(stored.select("id"), "id", "left_anti").select(*batch.columns)


def unembedded(events: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Events without a vector, oldest first: by their flag, or against the vector table."""
    out = events.filter(~F.coalesce("embedded", F.lit(False))) if vectors is None else events.join(vectors.select("id"), "id", "left_anti")
    return out.orderBy("ts", "id")


def reindex(events: DataFrame, vectors: DataFrame, text: Column, embedder) -> DataFrame:
    """Vectors (id, embedding) of the events that have none yet; append them to the vector table."""
    todo = events.join(vectors.select("id"), "id", "left_anti").select("id", text.alias("_text"))
    return todo.select("id", embedder(F.col("_text")).alias("embedding")).filter("embedding is not null")


def ingest(stored: DataFrame, batch: DataFrame, arrival: str, text: Column, embedder) -> DataFrame:
    """The whole pipeline of a batch: rows to append, with ``embedding`` and whether it could be made (``embedded``)."""
    fresh = new_events(stored, batch, arrival).withColumn("embedding", embedder(text))
    return fresh.withColumn("embedded", F.col("embedding").isNotNull())


def _j(path: str) -> Column:
    return F.get_json_object("payload", path)


def _text(path: str) -> Column:
    """A string value at a path; other kinds count as absent."""
    v = F.try_parse_json("payload")
    x = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(v, path, "string"))


def _there(path: str) -> Column:
    return F.try_variant_get(F.try_parse_json("payload"), path, "variant").isNotNull()


def normalize_webhooks(raw: DataFrame) -> DataFrame:
    """(…, source, event_type, payload) of vendor payloads by their kind in ``source``.

    github, sentry, slack and pagerduty are shaped, anything else keeps source
    and payload. One projection, so any mix of vendors is one pass.
    """
    or_unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    action = or_unknown(_text("$.action"))
    gh_type = (
        F.when(_there("$.pull_request"), F.concat(F.lit("pull_request."), action))
        .when(_there("$.issue"), F.concat(F.lit("issue."), action))
        .when(_there("$.commits"), F.lit("push"))
        .when(_there("$.release"), F.concat(F.lit("release."), action))
        .otherwise(F.concat(F.lit("github."), action))
    )
    repo, sender = or_unknown(_text("$.repository.full_name")), or_unknown(_text("$.sender.login"))
    s_action = F.coalesce(_text("$.action"), F.lit("triggered"))
    pick = lambda a, b, d: F.coalesce(F.when(_there(a), _text(a)).otherwise(_text(b)), F.lit(d))
    project, title = pick("$.data.issue.project.slug", "$.project_slug", "unknown"), pick("$.data.issue.title", "$.message", "")
    level = F.coalesce(_text("$.data.issue.level"), F.lit("error"))
    sl_type = F.coalesce(_text("$.event.type"), F.lit("message"))
    channel = or_unknown(_text("$.event.channel"))
    pd_type = F.coalesce(_text("$.event.event_type"), F.lit("incident.trigger"))
    service = or_unknown(_text("$.event.data.service.name"))
    first = F.when(_there("$.event_type"), _text("$.event_type")).when(_there("$.type"), _text("$.type")).otherwise(_text("$.action"))
    kind = F.col("source")
    source = (
        F.when(kind == "github", F.concat(F.lit("github/"), repo))
        .when(kind == "sentry", F.concat(F.lit("sentry/"), project))
        .when(kind == "slack", F.concat(F.lit("slack/"), channel))
        .when(kind == "pagerduty", F.concat(F.lit("pagerduty/"), service))
        .otherwise(kind)
    )
    event_type = F.when(kind == "github", gh_type).when(kind == "sentry", F.concat(F.lit("issue."), s_action)).when(kind == "slack", sl_type).when(kind == "pagerduty", pd_type).otherwise(F.coalesce(first, F.lit("webhook")))
    shaped = (
        F.when(kind == "sentry", F.to_json(F.struct(project.alias("project"), title.alias("title"), level.alias("level"), s_action.alias("action"))))
        .when(kind == "slack", F.to_json(F.struct(channel.alias("channel"), or_unknown(_text("$.event.user")).alias("user"), F.coalesce(_text("$.event.text"), F.lit("")).alias("text"))))
        .when(kind == "pagerduty", F.to_json(F.struct(service.alias("service"), F.coalesce(_text("$.event.data.title"), F.lit("")).alias("title"), pd_type.alias("event_type"))))
        .when(kind == "github", F.concat(F.regexp_replace(F.to_json(F.struct(action.alias("action"), repo.alias("repository"), sender.alias("sender"))), r"\}$", ""), F.lit(',"raw":'), F.col("payload"), F.lit("}")))
        .otherwise(F.col("payload"))
    )
    return raw.select(*[c for c in raw.columns if c not in ("source", "event_type", "payload")], source.alias("source"), event_type.alias("event_type"), shaped.alias("payload"))


def embed(rows: DataFrame, text: Column, embedder, out: str = "embedding") -> DataFrame:
    """rows with vectors by a pandas UDF ``embedder``."""
    return rows.withColumn(out, embedder(text))
