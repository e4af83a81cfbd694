"""Vector store operators: exact search in blocks, upsert, scope partitions, clusters.

Queries form a block that is broadcast while it is small; the corpus is only
scanned, never shuffled: each partition keeps the best k of each query before
anything moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import similarity


def check_dimension(v: Column, dim: int) -> Column:
    """The vector, or an error where its length isn't ``dim``."""
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(v).cast("string"))))


def upsert(store: DataFrame, rows: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """store with ``rows`` replacing those of equal key; of repeated keys in rows the last by ``order`` stands.

    Without an order a key may stand once in rows; of repeated ones any stays.
    """
    if order is None:
        fresh = rows.dropDuplicates([key])
    else:
        w = Window.partitionBy(key).orderBy(F.desc_nulls_last(order))
        fresh = rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
        fresh = fresh if order in store.columns else fresh.drop(order)
    return store.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def entries(store: DataFrame, condition: Column | None = None, limit: int | None = None, offset: int = 0, key: str = "id") -> DataFrame:
    """Stored entries in order of their key, a page of them if asked for."""
    out = (store if condition is None else store.filter(condition)).orderBy(key).offset(max(offset, 0))
    return out if limit is None else out.limit(limit)


def delete(store: DataFrame, condition: Column) -> DataFrame:
    return store.filter(~F.coalesce(condition, F.lit(False)))


#: Queries of one block at most; more are searched block by block.
BLOCK = 2048


def _best_of_partition(block, dim: int, k: int, metric: str, scoped: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        qids, q, qscope = block.value
        qn = np.linalg.norm(q, axis=1)
        best: list[tuple] = []  # per batch: arrays of (query, id, score)
        for pdf in batches:
            ok = pdf["v"].map(lambda x: x is not None and len(x) == dim)
            pdf = pdf[ok]
            if not len(pdf):
                continue
            m = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            if metric == "l2":
                s = -np.sqrt(np.maximum((m**2).sum(1)[:, None] - 2 * m @ q.T + (q**2).sum(1)[None], 0))
            else:
                s = m @ q.T
                if metric == "cosine":
                    n = np.linalg.norm(m, axis=1)[:, None] * qn[None]
                    s = np.where(n > 0, s / np.where(n > 0, n, 1), -np.inf)
            if scoped:
                s = np.where(pdf["scope"].to_numpy()[:, None] == qscope[None], s, -np.inf)
            ids = pdf["id"].to_numpy()
            for j in range(len(qids)):
                col = s[:, j]
                # all that tie with the k-th are kept, the id settles them afterwards
                cut = np.partition(col, -k)[-k] if len(col) > k else -np.inf
                at = np.flatnonzero((col >= cut) & np.isfinite(col))
                best.append((np.full(len(at), j), ids[at], col[at]))
            if len(best) > 4 * len(qids):
                best = [_trim(best, k)]
        if best:
            j, i, v = _trim(best, k)
            yield pd.DataFrame({"query_id": [qids[x] for x in j], "id": i, "score": v})

    return run


def _trim(parts: list[tuple], k: int) -> tuple:
    import numpy as np

    j, i, v = (np.concatenate([p[c] for p in parts]) for c in range(3))
    order = np.lexsort((i, -v, j))
    j, i, v = j[order], i[order], v[order]
    first = np.searchsorted(j, j, "left")
    keep = np.arange(len(j)) - first < k
    return j[keep], i[keep], v[keep]


def knn(store: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector: str = "embedding", metric: str = "cosine", scope: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): the exact k nearest of each query, ties by id.

    ``queries`` has (query_id, vector) and the scope column if one is named:
    then only rows of equal scope are searched. Queries are taken in blocks of
    at most BLOCK (a fixed number of vectors on the driver at once); a block is
    one scan of the store in which each partition keeps k per query.
    """
    if k <= 0:
        return store.sparkSession.createDataFrame([], "query_id string, id string, score double, rank int")
    spark = store.sparkSession
    kind = store.schema[id_col].dataType.simpleString()
    qkind = queries.schema["query_id"].dataType.simpleString()
    cols = ["query_id", F.col(vector).alias("v"), *([F.col(scope).alias("scope")] if scope else [])]
    src = store.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), *([F.col(scope).alias("scope")] if scope else []))
    parts, block = [], []

    def search(rows):
        import numpy as np

        dims = {}
        for r in rows:
            dims.setdefault(len(r["v"]), []).append(r)
        for dim, rs in dims.items():
            sent = spark.sparkContext.broadcast(([r["query_id"] for r in rs], np.array([r["v"] for r in rs], np.float64), np.array([r["scope"] if scope else None for r in rs], object)))
            parts.append(src.mapInPandas(_best_of_partition(sent, dim, k, metric, bool(scope)), f"query_id {qkind}, id {kind}, score double"))

    for r in queries.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(*cols).toLocalIterator():
        block.append(r)
        if len(block) == BLOCK:
            search(block)
            block = []
    if block:
        search(block)
    if not parts:
        return spark.createDataFrame([], f"query_id {qkind}, id {kind}, score double, rank int")
    near = parts[0]
    for p in parts[1:]:
        near = near.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(store: DataFrame, query: list[float], k: int, id_col: str = "id", vector: str = "embedding", metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """The k nearest of one vector, in JVM expressions only; ``where`` filters before ranking."""
    q = F.array(*[F.lit(float(x)) for x in query])
    src = store if where is None else store.filter(where)
    return src.withColumn("score", similarity(F.col(vector), q, metric)).filter("score is not null").orderBy(F.desc("score"), F.asc(id_col)).limit(k)


#: Rows of one round of clustering: the bound of what the driver holds.
ROUND = 4096


def _assign(sent, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        by_scope = sent.value
        for pdf in batches:
            out = np.empty(len(pdf), object)
            for s, at in pdf.groupby("scope", dropna=False).indices.items():
                got = by_scope.get(None if pd.isna(s) else s)
                if got is None:
                    continue
                ids, lead = got
                m = np.stack(pdf["v"].to_numpy()[at]).astype(np.float64)
                n = np.linalg.norm(m, axis=1, keepdims=True)
                hit = (m / np.where(n > 0, n, 1)) @ lead.T >= threshold
                first = hit.argmax(1)
                ok = hit[np.arange(len(at)), first]
                out[at[ok]] = ids[first[ok]]
            yield pdf.assign(cluster=out)

    return run


def near_duplicate_clusters(rows: DataFrame, scope: str, id_col: str, vector: str, importance: str, threshold: float, block: int = ROUND) -> DataFrame:
    """(scope, id, cluster): greedy clusters of at least two, leaders in order of importance, then id.

    A row joins the first leader before it at or above the threshold, else it
    leads. Rounds take the next ``block`` rows in order (all the driver ever
    holds), settle them among themselves, and send their leaders to all rows
    that are left; what they match leaves the field. No pairs are listed and no
    scope is gathered in a task. The work is rows times leaders, as for any
    exact greedy order.
    """
    import numpy as np

    from ..session import Scratch

    spark = rows.sparkSession
    scratch = Scratch(spark, "clusters")
    kind, sk = rows.schema[id_col].dataType.simpleString(), rows.schema[scope].dataType.simpleString()
    left = scratch.cut(rows.filter(F.col(vector).isNotNull() & F.col(id_col).isNotNull()).select(F.col(scope).alias("scope"), F.col(id_col).alias("id"), F.col(vector).cast("array<float>").alias("v"), F.col(importance).cast("double").alias("imp")))
    done = []
    while True:
        top = left.orderBy(F.desc_nulls_last("imp"), "id").limit(block).collect()
        if not top:
            break
        per: dict = {}
        for r in top:
            per.setdefault(r["scope"], []).append(r)
        leaders, settled = {}, []
        for s, rs in per.items():
            m = np.array([r["v"] for r in rs], np.float64)
            n = np.linalg.norm(m, axis=1, keepdims=True)
            m = m / np.where(n > 0, n, 1)
            lead = np.full(len(rs), -1)
            for i in range(len(rs)):
                if lead[i] < 0:
                    lead[i] = i
                    later = np.arange(i + 1, len(rs))[lead[i + 1 :] < 0]
                    lead[later[m[later] @ m[i] >= threshold]] = i
            own = np.unique(lead)
            ids = np.array([r["id"] for r in rs], object)
            leaders[s] = (ids[own], m[own])
            settled += [(s, ids[i], ids[lead[i]]) for i in range(len(rs))]
        done.append(spark.createDataFrame(settled, f"scope {sk}, id {kind}, cluster {kind}"))
        if len(top) < block:
            break
        sent = spark.sparkContext.broadcast(leaders)
        taken = done[-1].select(F.col("scope").alias("_s"), F.col("id").alias("_i"))
        rest = left.join(F.broadcast(taken), F.col("scope").eqNullSafe(F.col("_s")) & (F.col("id") == F.col("_i")), "left_anti")
        rest = scratch.cut(rest.mapInPandas(_assign(sent, threshold), f"scope {sk}, id {kind}, v array<float>, imp double, cluster {kind}"))
        done.append(rest.filter("cluster is not null").select("scope", "id", "cluster"))
        left = rest.filter("cluster is null").drop("cluster")
    if not done:
        return spark.createDataFrame([], f"scope {sk}, id {kind}, cluster {kind}")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    several = out.groupBy("scope", "cluster").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("scope").alias("_s"), F.col("cluster").alias("_c"))
    return out.join(several, F.col("scope").eqNullSafe(F.col("_s")) & (F.col("cluster") == F.col("_c")), "left_semi")


def search_modalities(store: DataFrame, query: list[float], k: int, modality: str | None = None) -> DataFrame:
    """Top k over one modality, or over all whose vectors have the query's length."""
    cond = F.size("embedding") == len(query)
    if modality is not None:
        cond = cond & (F.col("modality") == modality)
    return nearest(store, query, k, where=cond)
