"""Lexical ranking, rank fusion, blending and retrieval metrics, for many queries at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import recency
from ..functions.text import tokens
from ..session import Scratch

K1, B, RRF_K = 1.2, 0.75, 60


def bm25(docs: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str = "query_id", query: str = "query", scope: list[str] | None = None) -> DataFrame:
    """(query_id, doc_id, score), positive scores only.

    ``scope`` names columns of both sides: a query ranks the documents of its
    scope, by the statistics of that scope. Documents are tokenised once in the
    JVM; of each only the counts of asked terms leave the scan, so the join
    with the queries moves matches, not texts. Terms of the queries are
    distinct; a query without terms ranks nothing.
    """
    scope = scope or []
    # terms asked for, as one small relation; Spark broadcasts it while it is small
    asked = queries.select(*scope, query_id, F.explode(F.array_distinct(tokens(query))).alias("term"))
    toks = docs.select(*scope, F.col(doc_id).alias("_doc"), tokens(text).alias("_toks"))
    sized = toks.select(*scope, "_doc", F.size("_toks").alias("dl"), "_toks")
    stats = sized.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"))
    terms = asked.select(*scope, "term").distinct()
    tf = sized.select(*scope, "_doc", "dl", F.explode("_toks").alias("term")).join(terms, [*scope, "term"]).groupBy(*scope, "_doc", "dl", "term").agg(F.count(F.lit(1)).alias("f"))
    return _score(tf, stats, asked, scope, query_id, doc_id)


def _score(tf: DataFrame, stats: DataFrame, asked: DataFrame, scope: list[str], query_id: str, doc_id: str) -> DataFrame:
    """Scores of the counts (scope, _doc, dl, term, f) of asked terms."""
    df = tf.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"))
    w = df.join(stats, scope) if scope else df.join(F.broadcast(stats))
    w = w.select(*scope, "term", "avgdl", F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0).alias("idf"))
    f, dl = F.col("f"), F.col("dl")
    part = F.col("idf") * (f * (K1 + 1.0)) / F.greatest(f + K1 * (1.0 - B + B * dl / F.col("avgdl")), F.lit(1e-6))
    hit = tf.join(w, [*scope, "term"]).join(asked, [*scope, "term"])
    return hit.groupBy(query_id, F.col("_doc").alias(doc_id)).agg(F.sum(part).alias("score")).filter("score > 0")


#: Asked terms that are looked up by value in the postings, so that other row groups are skipped; more are joined.
FEW_TERMS = 2000


class Postings:
    """The words of a corpus as a written table, sorted by term, so that a search reads the asked terms only.

    Columns are scope, _doc, dl, term and f; ``stats`` has one row per scope.
    Built by one pass over the texts; counts are made map-side.
    """

    def __init__(self, table: DataFrame, stats: DataFrame, doc_id: str, scope: list[str]):
        self.table, self.stats, self.doc_id, self.scope = table, stats, doc_id, scope

    @classmethod
    def build(cls, docs: DataFrame, doc_id: str, text: str, scope: list[str] | None = None) -> "Postings":
        scope = scope or []
        scratch = Scratch(docs.sparkSession, "postings")
        toks = docs.select(*scope, F.col(doc_id).alias("_doc"), tokens(text).alias("_toks"))
        tf = toks.select(*scope, "_doc", F.size("_toks").alias("dl"), F.explode("_toks").alias("term")).groupBy(*scope, "_doc", "dl", "term").agg(F.count(F.lit(1)).alias("f"))
        table = scratch.cut(tf.repartitionByRange("term").sortWithinPartitions("term"))
        n, size = docs.groupBy(*scope).agg(F.count(F.lit(1)).alias("n")), table.groupBy(*scope).agg(F.sum("f").alias("size"))
        both = n.join(size, [c for c in scope], "left") if scope else n.crossJoin(size)  # one row each
        stats = scratch.cut(both.select(*scope, "n", F.greatest(F.coalesce("size", F.lit(0)) / F.greatest("n", F.lit(1)), F.lit(1.0)).alias("avgdl")))
        return cls(table, stats, doc_id, scope)

    def search(self, queries: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
        """(query_id, doc_id, score), as ``bm25`` gives it."""
        asked = queries.select(*self.scope, query_id, F.explode(F.array_distinct(tokens(query))).alias("term"))
        terms = asked.select(*self.scope, "term").distinct()
        few = [r[0] for r in asked.select("term").distinct().limit(FEW_TERMS + 1).collect()]
        rows = self.table.filter(F.col("term").isin(few)) if len(few) <= FEW_TERMS else self.table
        return _score(rows.join(terms, [*self.scope, "term"], "left_semi"), self.stats, asked, self.scope, query_id, self.doc_id)


def ranked(arm: DataFrame, query_id: str, doc_id: str, score: str, top: int | None = None) -> DataFrame:
    """arm with ``rank`` from 1 by score, ties by id; only ``top`` ranks if given (pruned before the shuffle)."""
    w = Window.partitionBy(query_id).orderBy(F.desc(score), F.asc(doc_id))
    out = arm.withColumn("rank", F.row_number().over(w))
    return out.filter(F.col("rank") <= top) if top else out


def rrf(arms: list[tuple[DataFrame, float]], query_id: str, doc_id: str, k: float = RRF_K) -> DataFrame:
    """(query_id, doc_id, rrf): sum of weight / (k + rank) over ranked arms."""
    parts = [a.select(query_id, doc_id, (F.lit(float(w)) / (F.lit(float(k)) + F.col("rank"))).alias("part")) for a, w in arms]
    return reduce(DataFrame.unionByName, parts).groupBy(query_id, doc_id).agg(F.sum("part").alias("rrf"))


def blend(rrf_score: Column, importance: Column, updated: Column, now: Column, w_importance: float = 0.3, w_recency: float = 0.2) -> Column:
    """rrf * (1 + w_importance * importance + w_recency * recency)."""
    return rrf_score * (1.0 + w_importance * importance + w_recency * recency(updated, now))


def rerank(pool: DataFrame, query: str, content: str, updated: str, now: Column, scorer, score: str = "score") -> DataFrame:
    """Second stage over a small pool: ``scorer(query, content)`` is a pandas UDF; a null score keeps the first one."""
    s = scorer(F.col(query), F.col(content))
    return pool.withColumn(score, F.coalesce(s * (1.0 + 0.1 * recency(F.col(updated), now)), F.col(score)))


def graph_arm(edges: DataFrame, queries: DataFrame, query_id: str, query: str, memories: DataFrame) -> DataFrame:
    """(query_id, id, score): memories behind edges of which an end shares a term with the query.

    ``edges`` has (id, src, dst, weight, source_memory_id); the first edge by
    weight counts, ``memories`` limits what may be found.
    """
    asked = queries.select(query_id, F.explode(F.array_distinct(tokens(query))).alias("term"))
    ends = edges.filter("source_memory_id is not null").select("id", "weight", "source_memory_id", F.explode(F.array_union(tokens("src"), tokens("dst"))).alias("term"))
    w = Window.partitionBy(query_id, "source_memory_id").orderBy(F.desc("weight"), "id")
    hit = ends.join(asked, "term").withColumn("r", F.row_number().over(w)).filter("r = 1")
    return hit.select(query_id, F.col("source_memory_id").alias("id"), F.col("weight").alias("score")).join(memories.select("id"), "id", "left_semi")


def token_f1(got: Column, want: Column) -> Column:
    """F1 of two word lists as multisets."""
    from ..functions.text import words

    g, w = words(got), words(want)
    common = F.aggregate(F.array_distinct(g), F.lit(0), lambda s, x: s + F.least(F.size(F.filter(g, lambda y: y == x)), F.size(F.filter(w, lambda y: y == x))))
    p, r = common / F.size(g), common / F.size(w)
    return F.when((F.size(g) == 0) & (F.size(w) == 0), 1.0).when((F.size(g) == 0) | (F.size(w) == 0) | (common == 0), 0.0).otherwise(2 * p * r / (p + r))


def retrieval_metrics(ranks: DataFrame, group: list[str]) -> DataFrame:
    """recall@1/3/5 and MRR of rows with the rank of the first relevant hit (null: none)."""
    hit = lambda k: F.avg(F.when(F.coalesce(F.col("rank") <= k, F.lit(False)), 1.0).otherwise(0.0))
    return ranks.groupBy(*group).agg(
        F.count(F.lit(1)).alias("questions"), hit(1).alias("recall_1"), hit(3).alias("recall_3"), hit(5).alias("recall_5"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr")
    )
