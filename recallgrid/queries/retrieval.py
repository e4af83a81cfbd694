"""Retrieval: words, vectors, fusion, evaluation, text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..entities import standing_memories, subject_norm, tenant
from ..facade import hybrid
from ..functions.scalars import cosine, hashed_embedding
from ..functions.text import STOP_WORDS, embedding_text, frontmatter, tokens, triples, words
from ..operators import ranking, vectors
from ..session import Scratch, file_state, load

ASK = "the planner archived snapshots for agents"
NOW = "2022-01-01 00:00:00"


def _ask(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, ASK)], "query_id int, query string")


_INDEXES: dict[tuple, object] = {}


def documents_index(spark: SparkSession, d: str) -> ranking.Postings:
    """The postings of the documents, built once per session and state of the file."""
    key = file_state(spark, d, "documents")
    if key not in _INDEXES:
        _INDEXES[key] = ranking.Postings.build(load(spark, d, "documents"), "doc_id", "text")
    return _INDEXES[key]


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = documents_index(spark, d).search(_ask(spark))
    return hits.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


def _first_vector(spark: SparkSession, d: str) -> list[float]:
    return load(spark, d, "embeddings").orderBy("vec_id").first()["embedding"]


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.nearest(load(spark, d, "embeddings"), _first_vector(spark, d), 10, id_col="vec_id")
    return near.select("vec_id", F.round("score", 6).alias("score"))


def vector_topk_by_label(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    q = e.select(F.col("label").alias("query_id"), "label").distinct().withColumn("embedding", F.array(*map(F.lit, _first_vector(spark, d))))
    near = vectors.knn(e, q, 3, id_col="vec_id", scope="label")
    return near.select(F.col("query_id").alias("label"), F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


def vector_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 50, against all."""
    e = load(spark, d, "embeddings")
    near = vectors.knn(e, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5, id_col="vec_id")
    return near.select("query_id", F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


def _arms(spark: SparkSession, d: str):
    lex = ranking.ranked(documents_index(spark, d).search(_ask(spark)), "query_id", "doc_id", "score")
    q = spark.createDataFrame([(1, _first_vector(spark, d))], "query_id int, embedding array<float>")
    vec = vectors.knn(load(spark, d, "embeddings"), q, 50, id_col="vec_id").withColumnRenamed("id", "doc_id")
    return lex, vec


def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    lex, vec = _arms(spark, d)
    fused = ranking.rrf([(lex, 1.0), (vec, 1.0)], "query_id", "doc_id")
    return fused.select("doc_id", F.round("rrf", 9).alias("rrf")).orderBy(F.desc("rrf"), "doc_id").limit(20)


def hybrid_blend(spark: SparkSession, d: str) -> DataFrame:
    lex, vec = _arms(spark, d)
    fused = ranking.ranked(ranking.rrf([(vec, 2.0), (lex, 1.0)], "query_id", "doc_id"), "query_id", "doc_id", "rrf", 50)
    docs = load(spark, d, "documents").select("doc_id", (F.col("doc_id") % 10 / 10.0).alias("importance"), "created_at")
    score = ranking.blend(F.col("rrf"), F.col("importance"), F.col("created_at").cast("timestamp"), F.lit(NOW).cast("timestamp"))
    out = fused.join(docs, "doc_id").select("doc_id", F.round(score, 9).alias("score"))
    return out.orderBy(F.desc("score"), "doc_id").limit(20)


def memory_search(spark: SparkSession, d: str) -> DataFrame:
    """The whole hybrid search over active memories, three queries at once; vectors and postings are stored."""
    key = file_state(spark, d, "memories")
    if key not in _INDEXES:
        m = standing_memories(load(spark, d, "memories"), "content", "importance", "updated_at", "state").filter("state = 'active'")
        m = m.select("id", "content", "importance", F.col("updated_at").cast("timestamp").alias("updated_at"), hashed_embedding("content").alias("embedding"))
        m = Scratch(spark, "memories").cut(m)
        _INDEXES[key] = (m, ranking.Postings.build(m, "id", "content"))
    m, words_of = _INDEXES[key]
    q = spark.createDataFrame([(1, "deploy region of the project"), (2, "which time zone changed"), (3, "review owner team")], "query_id int, query string")
    hits = hybrid(m, q, hashed_embedding, F.lit(NOW).cast("timestamp"), postings=words_of)
    top = ranking.ranked(hits, "query_id", "id", "score", 10)
    return top.select("query_id", "id", "rank", F.round("score", 9).alias("score"))


def grants_search(spark: SparkSession, d: str) -> DataFrame:
    """Runbook readers also search tickets and wiki notes: each scope by its own statistics, best score per document."""
    docs = load(spark, d, "documents").withColumn("scope", F.lower(F.trim("source"))).filter("scope is not null")
    grants = spark.createDataFrame([("default", "runbook", "ticket"), ("default", "runbook", "wiki_note")], "tenant_id string, grantee_user string, grantor_user string")
    from ..operators.cognition import shared_scopes

    q = shared_scopes(grants, "default", "runbook").select(F.col("user_id").alias("scope"), F.lit(1).alias("query_id"), F.lit(ASK).alias("query"))
    hits = ranking.bm25(docs, "doc_id", "text", q, scope=["scope"]).groupBy("doc_id").agg(F.max("score").alias("score"))
    return hits.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select(F.explode(tokens("text")).alias("token"))
    return docs.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def triple_extract(spark: SparkSession, d: str) -> DataFrame:
    mem = standing_memories(load(spark, d, "memories"), "content")
    t = mem.select("id", F.explode(triples("content")).alias("t"))
    return t.select("id", "t.subject", "t.relation", "t.object")


def note_titles(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", frontmatter("text").alias("f")).filter(F.size("f") > 0)
    return docs.select("doc_id", F.col("f")["title"].alias("title"), F.col("f")["tags"].alias("tags"))


def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    ep = load(spark, d, "episodic")
    return ep.select(F.lower("id").alias("id"), embedding_text(F.col("event_type"), F.col("payload"), F.coalesce("tags", F.array().cast("array<string>"))).alias("text")).distinct()


def retrieval_eval(spark: SparkSession, d: str) -> DataFrame:
    """Questions of the conversation samples against the turns of their sample: recall and MRR by category."""
    s = load(spark, d, "locomo_samples").dropDuplicates(["sample_id"])
    turns = s.select("sample_id", F.posexplode("turns").alias("pos", "turn")).filter("turn is not null").withColumn("turn_id", F.col("sample_id") * 1000 + F.col("pos"))
    qa = s.select("sample_id", F.posexplode("qa").alias("no", "qa")).select("sample_id", (F.col("sample_id") * 1000 + F.col("no")).alias("query_id"), F.col("qa.question").alias("query"), F.lower("qa.expected").alias("expected"), F.coalesce("qa.category", F.lit(0)).alias("category"))
    hits = ranking.ranked(ranking.bm25(turns, "turn_id", "turn", qa.filter("query is not null"), scope=["sample_id"]), "query_id", "turn_id", "score")
    good = hits.join(turns.select("turn_id", "turn"), "turn_id").join(qa.select("query_id", "expected"), "query_id").filter(F.lower("turn").contains(F.col("expected")))
    first = good.groupBy("query_id").agg(F.min("rank").alias("rank"))
    m = ranking.retrieval_metrics(qa.select("query_id", "category").join(first, "query_id", "left"), ["category"])
    return m.select("category", "questions", *[F.round(c, 6).alias(c) for c in ("recall_1", "recall_3", "recall_5", "mrr")])


def answer_f1(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "locomo_samples").dropDuplicates(["sample_id"])
    qa = s.select("sample_id", F.posexplode("qa").alias("no", "qa"))
    return qa.select("sample_id", "no", F.round(ranking.token_f1(F.col("qa.question"), F.col("qa.expected")), 6).alias("f1"))


def exact_dup_merge(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").filter("text is not null")
    k = docs.select("doc_id", F.sha2(subject_norm("text"), 256).alias("k"))
    g = k.groupBy("k").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    return k.join(g, "k").select("doc_id", "class_id", "copies")


def semantic_clusters(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").withColumn("importance", F.lit(0.5))
    return vectors.near_duplicate_clusters(e, "label", "vec_id", "embedding", "importance", 0.3)


def semantic_merge_fold(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.cognition import merge_fold

    return merge_fold(load(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.3)


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, vector_topk, vector_topk_by_label, vector_neighbors, hybrid_rrf, hybrid_blend, memory_search, grants_search, token_counts, triple_extract, note_titles, embedding_texts, retrieval_eval, answer_f1, exact_dup_merge, semantic_clusters, semantic_merge_fold,
    )
}

# the same in SQL

_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_STEM = r"""case when not regexp_full_match(w, '[\x00-\x7F]*') then w when length(w) > 4 and w like '%ing' then w[:-4] when length(w) > 3 and w like '%ies' then w[:-4] || 'y'
  when length(w) > 3 and w like '%ed' then w[:-3] when length(w) > 3 and w like '%s' and w not like '%ss' and w not like '%us' then w[:-2] else w end"""


def _tokens(c: str) -> str:
    return f"list_transform(list_filter({_WORDS.format(c)}, lambda w: not list_contains({_STOP}, w)), lambda w: {_STEM})"


def _bm25(source: str, ident: str, text: str, queries: str, scope: str = "0") -> str:
    """CTEs up to ``scored`` (query_id, doc_id, score) over source with queries (query_id, scope, query)."""
    return f"""
  dt as (select {ident} as doc_id, {scope} as scope, {_tokens(text)} as t from {source}),
  st as (select scope, count(*) as n, greatest(avg(len(t)), 1.0) as avgdl from dt group by scope),
  qs as ({queries}),
  qt as (select distinct query_id, scope, unnest({_tokens('query')}) as term from qs),
  tf as (select scope, doc_id, dl, term, count(*) as f from (select scope, doc_id, len(t) as dl, unnest(t) as term from dt) group by all),
  df as (select scope, term, count(*) as df from tf group by all),
  scored as (select query_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * (f * 2.2) / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score
    from qt join tf using (scope, term) join df using (scope, term) join st using (scope) group by query_id, doc_id having score > 0)"""


_Q = f"select 1 as query_id, 0 as scope, '{ASK}' as query"
_BM = _bm25("documents", "doc_id", "text", _Q)
_COS = "list_cosine_similarity(e.embedding::double[], q.embedding::double[])"
_ARMS = f"""{_BM},
  lex as (select doc_id, row_number() over (order by score desc, doc_id) as rank from scored),
  q as (select embedding from embeddings order by vec_id limit 1),
  vec as (select vec_id as doc_id, row_number() over (order by {_COS} desc, vec_id) as rank from embeddings e, q qualify rank <= 50)"""
_MET = ", ".join(f"round(avg((coalesce(rank, 1000000) <= {k})::int), 6) as recall_{k}" for k in (1, 3, 5))

ORACLE = {
    "bm25_topk": f"with {_BM} select doc_id, round(score, 6) as score from scored order by score desc, doc_id limit 20",
    "vector_topk": f"with q as (select embedding from embeddings order by vec_id limit 1) select vec_id, round({_COS}, 6) as score from embeddings e, q order by {_COS} desc, vec_id limit 10",
    "vector_topk_by_label": f"""with q as (select embedding from embeddings order by vec_id limit 1)
select label, vec_id, (row_number() over (partition by label order by {_COS} desc, vec_id))::int as rank, round({_COS}, 6) as score from embeddings e, q qualify rank <= 3""",
    "vector_neighbors": f"""select q.vec_id as query_id, e.vec_id, (row_number() over (partition by q.vec_id order by {_COS} desc, e.vec_id))::int as rank, round({_COS}, 6) as score
from embeddings e, (select * from embeddings where vec_id % 50 = 0) q qualify rank <= 5""",
    "hybrid_rrf": f"""with {_ARMS} select doc_id, round(sum(1.0::double / (60.0::double + rank)), 9) as rrf from (select * from lex union all select * from vec) group by doc_id order by sum(1.0::double / (60.0::double + rank)) desc, doc_id limit 20""",
    "hybrid_blend": f"""with {_ARMS},
  fused as (select doc_id, sum(w / (60.0::double + rank)) as rrf from (select doc_id, rank, 1.0::double as w from lex union all select doc_id, rank, 2.0::double from vec) group by doc_id order by rrf desc, doc_id limit 50)
select doc_id, round(rrf * (1.0 + 0.3::double * (doc_id % 10 / 10.0::double) + 0.2::double * pow(0.5::double, greatest(epoch(timestamp '{NOW}') - floor(epoch(created_at)), 0) / 86400.0 / 30.0)), 9) as score
from fused join documents using (doc_id) order by score desc, doc_id limit 20""",
    "grants_search": "with " + _bm25("documents", "doc_id", "text", f"select 1 as query_id, unnest(['runbook', 'ticket', 'wiki_note']) as scope, '{ASK}' as query", "lower(trim(source))")
    + " select doc_id, round(max(score), 6) as score from scored group by doc_id order by max(score) desc, doc_id limit 20",
    "token_counts": f"select token, count(*) as n from (select unnest({_tokens('text')}) as token from documents) group by token",
    "exact_dup_merge": r"""select doc_id, min(doc_id) over w as class_id, count(*) over w as copies from documents where text is not null
window w as (partition by lower(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))))""",
    "retrieval_eval": "with s as (select * from locomo_samples qualify row_number() over (partition by sample_id) = 1), tu as (select sample_id, sample_id * 1000 + p - 1 as turn_id, turns[p] as turn from (select sample_id, turns, unnest(range(1, len(turns) + 1)) as p from s) where turns[p] is not null), qa as (select sample_id, sample_id * 1000 + p - 1 as query_id, qa[p].question as query, lower(qa[p].expected) as expected, coalesce(qa[p].category, 0) as category from (select sample_id, qa, unnest(range(1, len(qa) + 1)) as p from s)), "
    + _bm25("tu", "turn_id", "turn", "select query_id, sample_id as scope, query from qa where query is not null", "sample_id")
    + f""", r as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank from scored),
  f as (select r.query_id, min(rank) as rank from r join tu on turn_id = doc_id join qa on qa.query_id = r.query_id where contains(lower(turn), expected) group by 1)
select category, count(*) as questions, {_MET}, round(avg(coalesce(1.0 / rank, 0)), 6) as mrr from qa left join f using (query_id) group by category""",
    "answer_f1": f"""with s as (select * from locomo_samples qualify row_number() over (partition by sample_id) = 1),
  q as (select sample_id, (p - 1)::int as no, {_WORDS.format('qa[p].question')} as g, {_WORDS.format('qa[p].expected')} as w from (select sample_id, qa, unnest(range(1, len(qa) + 1)) as p from s)),
  c as (select *, coalesce(list_sum(list_transform(list_distinct(g), lambda x: least(len(list_filter(g, lambda y: y = x)), len(list_filter(w, lambda y: y = x))))), 0) as k from q)
select sample_id, no, round(case when len(g) = 0 and len(w) = 0 then 1.0 when len(g) = 0 or len(w) = 0 or k = 0 then 0.0 else 2.0 * (k / len(g)) * (k / len(w)) / (k / len(g) + k / len(w)) end, 6) as f1 from c""",
}
