"""The SQL surface, streams and context assembly as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..entities import micros
from ..functions.text import wikilinks, words
from ..operators import ranking
from ..plans.sqlgate import run_sql, substitute, tenant_session
from ..plans.views import newest, retrieval_context
from ..session import Scratch, load
from ..sources import ingest, scans
from ..streaming import flows
from .memory import _RUNS, events, memories
from .problems_sql import EVENTS
from .retrieval import _BM, ASK, _ask, documents_index


def hybrid_sql(spark: SparkSession, d: str) -> DataFrame:
    """A SELECT that joins a table with the search function."""
    s = tenant_session(spark, {"documents": load(spark, d, "documents").drop("tenant_id")}, "default")

    def search(text: str, k: int) -> DataFrame:
        q = spark.createDataFrame([(1, text)], "query_id int, query string")
        hits = documents_index(spark, d).search(q)
        return hits.select(F.col("doc_id").alias("id"), "score").orderBy(F.desc("score"), "id").limit(k)

    sql = f"select lower(trim(d.source)) as source, count(*) as n, round(max(m.score), 6) as best from documents d join memory_search('{ASK}', 40) m on d.doc_id = m.id group by 1"
    return run_sql(s, substitute(s, sql, search, None), max_rows=None)


def _stream_dir(d: str, table: str) -> str:
    return f"{d}/{table}.parquet*"


def stream_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts by a streaming query over the events file, kept by key over its batches."""
    scratch = Scratch(spark, "stream")
    src = spark.readStream.schema(load(spark, d, "events").schema).parquet(_stream_dir(d, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = flows.window_counts(src, "ts", ["event_type"], "1 hour")
    q = counts.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{scratch.root}/cp")
    q.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{scratch.root}/out")).start().awaitTermination()
    return spark.read.parquet(f"{scratch.root}/out").select(micros("window_start").alias("start_us"), "event_type", "n")


def stream_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Order priorities as a stream of facts about customers: outcomes of the stateful resolution."""
    scratch = Scratch(spark, "stream")
    o = spark.readStream.schema(load(spark, d, "orders").schema).parquet(_stream_dir(d, "orders"))
    seq = F.unix_date(F.col("o_orderdate").cast("date")) * F.lit(10_000_000_000) + F.col("o_orderkey")
    res = flows.resolve_stream(o.withColumn("seq", seq), "o_custkey", "o_orderpriority", "seq")
    q = res.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{scratch.root}/cp")
    q.foreachBatch(lambda b, i: b.write.mode("append").parquet(f"{scratch.root}/out")).start().awaitTermination()
    return spark.read.parquet(f"{scratch.root}/out").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("customers"))


def rag_context(spark: SparkSession, d: str) -> DataFrame:
    """Context for a question: knowledge from the documents, the newest events, what is remembered."""
    docs = load(spark, d, "documents")
    k = ranking.ranked(documents_index(spark, d).search(_ask(spark)), "query_id", "doc_id", "score", 5).join(docs.select("doc_id", "source", F.col("text").alias("content")), "doc_id")
    mem = memories(spark, d).filter("state = 'active'")
    q = spark.createDataFrame([(1, "deploy region of the project")], "query_id int, query string")
    m = ranking.ranked(ranking.bm25(mem, "id", "content", q), "query_id", "id", "score", 5).join(mem.select("id", "content"), "id")
    return retrieval_context(k, newest(events(spark, d)), m)


def newest_of_source(spark: SparkSession, d: str) -> DataFrame:
    return scans.by_source(events(spark, d), "agent-00007", 100).select("id", micros("ts").alias("us"))


def embedded_drift(spark: SparkSession, d: str) -> DataFrame:
    """Events that no memory cites: those left to be processed, by source."""
    cited = load(spark, d, "memories").select(F.explode("source_event_ids").alias("id")).select(F.lower("id").alias("id")).distinct()
    return ingest.unembedded(events(spark, d), cited).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def substring_hits(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return docs.filter(F.lower("text").contains("planner") & (F.size(words("text")) > 20)).select("doc_id")


def link_extract(spark: SparkSession, d: str) -> DataFrame:
    """Wiki links of the documents as edges."""
    docs = load(spark, d, "documents")
    return docs.select("doc_id", F.explode(wikilinks("text")).alias("target"))


QUERIES = {f.__name__: f for f in (hybrid_sql, stream_hourly, stream_resolve, rag_context, newest_of_source, embedded_drift, substring_hits, link_extract)}

ORACLE = {
    "link_extract": r"""select distinct doc_id, trim(regexp_extract(x, '^([^#|]*)', 1)) as target from (select doc_id, unnest(regexp_extract_all(text, '\[\[(.*?)\]\]', 1)) as x from documents) where trim(regexp_extract(x, '^([^#|]*)', 1)) <> ''""",
    "hybrid_sql": f"with {_BM}, top as (select doc_id, score from scored order by score desc, doc_id limit 40) select lower(trim(source)) as source, count(*) as n, round(max(score), 6) as best from documents join top using (doc_id) group by 1",
    "stream_hourly": "select epoch_us(time_bucket(interval 1 hour, ts)) as start_us, event_type, count(*) as n from events group by 1, 2",
    "stream_resolve": f"""with {_RUNS} select outcome, sum(n)::bigint as n, count(distinct o_custkey) as customers from (
  select o_custkey, case when run = 1 then 'Inserted' else 'Superseded' end as outcome, 1 as n from v
  union all select o_custkey, 'Confirmed', version - 1 from v where version > 1) group by outcome""",
    "newest_of_source": f"with {EVENTS} select id, epoch_us(ts) as us from ev where source = 'agent-00007' order by ts desc, id limit 100",
    "embedded_drift": f"with {EVENTS} select source, count(*) as n from ev where id not in (select lower(e) from (select unnest(source_event_ids) as e from memories) where e is not null) group by source",
    "substring_hits": r"select doc_id from documents where contains(lower(text), 'planner') and len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) > 20",
}
