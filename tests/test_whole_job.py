"""Queries against brute force, where they once did less than the whole job."""

import os

import duckdb
import numpy as np
import pytest

from compare import duck_rows, spark_rows
from recallgrid.entities import retries, standing_events
from recallgrid.operators import graph, lexical
from recallgrid.queries import memory, upkeep, upkeep_sql
from recallgrid.queries.problems_sql import EVENTS

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def brute_ranks(d, steps):
    e = duckdb.sql(f"select 'c' || o_custkey as src, 's' || l_suppkey as dst, count(*)::double as w from '{d}/orders.parquet' join '{d}/lineitem.parquet' on o_orderkey = l_orderkey group by all").fetchall()
    at = {n: i for i, n in enumerate(sorted({x for s, t, _ in e for x in (s, t)}))}
    n, m = len(at), np.zeros((len(at), len(at)))
    for s, t, w in e:
        m[at[t], at[s]] += w
    out = m.sum(0)
    m[:, out > 0] /= out[out > 0]
    m[:, out == 0] = 1 / n
    r = np.full(n, 1 / n)
    for _ in range(steps):
        r = 0.15 / n + 0.85 * m @ r
    return {k: r[i] for k, i in at.items()}


def test_pagerank_large_takes_40_steps(spark):
    want = brute_ranks(D, 40)
    joined = graph.pagerank(memory.edges(spark, D), few_edges=0)
    for df in (memory.pagerank_large(spark, D), joined):
        assert {r["node"]: r["pagerank"] for r in df.collect()} == pytest.approx(want, rel=1e-9, abs=2e-12)


def test_shortest_path_has_no_hop_limit(spark):
    pairs = [(f"n{i:03}", f"n{i + 1:03}") for i in range(70)] + [("n070", "n000"), ("n003", "side"), ("side", "n005")]
    e = spark.createDataFrame(pairs, "src string, dst string")
    assert graph.shortest_path(e, "n000", "n070") == [f"n{i:03}" for i in range(71)]
    assert graph.shortest_path(e.filter("src >= 'n069' and src < 's' or src = 'n000'"), "n069", "nowhere") is None


def test_shortest_path_climbs_to_the_top(spark):
    con = duckdb.connect()
    con.execute(f"create view episodic as select * from '{D}/episodic.parquet'")
    up = dict(con.execute(f"with {EVENTS} select id, nullif(lower(trim(parent_id)), '') from ev").fetchall())
    stands = dict(con.execute(f"""with {EVENTS} select e1.id, ev.id from e1 join ev on e1.tenant = ev.tenant and e1.idempotency_key = ev.idempotency_key""").fetchall())

    def climb(n):
        path = [n]
        while (n := stands.get(up[n], up[n])) in up:
            if n in path:
                return []
            path.append(n)
        return path

    want = min((p for p in map(climb, up) if p), key=lambda p: (-len(p), p[0]))
    assert len(want) > 2
    assert [r["node"] for r in memory.shortest_path(spark, D).orderBy("place").collect()] == want


def test_ids_under_each_others_keys_stand(spark, tmp_path):
    raw = [("A", "k1", 1), ("b", "k2", 2), ("b", "k1", 3), ("A", "k2", 4), ("c", "k1", 5), ("d", None, 6), ("d", "k1", 7)]
    ep = spark.createDataFrame(raw, "id string, idempotency_key string, n int").selectExpr("id", "cast(null as string) as tenant_id", "idempotency_key", "timestamp_seconds(n) as ingested_at")
    ep.write.parquet(str(tmp_path / "ep"))
    con = duckdb.connect()
    con.execute(f"create view episodic as select * from '{tmp_path}/ep/*.parquet'")
    want = sorted(r[0] for r in con.execute(f"with {EVENTS} select id from ev").fetchall())
    assert sorted(r["id"] for r in standing_events(ep).collect()) == want == ["a", "b", "d"]
    assert [tuple(r) for r in retries(ep).collect()] == [("c", "a")]


def shuffled(spark):
    """Rows that all stages so far have written for a shuffle."""
    sc, none = spark.sparkContext, spark.sparkContext._jvm.java.util.ArrayList
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(none(), False, False, sc._gateway.new_array(sc._jvm.double, 0), none())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def write_documents(path, rows):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    con.execute(f"copy documents to '{path}/documents.parquet' (format parquet)")


def test_bm25_all_does_not_move_matches(spark, tmp_path):
    """Matches grow with the square of the documents; they once were rows of a shuffle."""
    r = np.random.default_rng(1)
    write_documents(tmp_path, [(i, " ".join(f"w{x}" for x in r.integers(0, 40, 30))) for i in range(3000)])
    before = shuffled(spark)
    assert upkeep.bm25_all(spark, str(tmp_path)).count() == 600
    assert shuffled(spark) - before < 60_000  # 3,000 documents times 60 queries have 180,000 scores


def test_bm25_all_of_odd_documents(spark, tmp_path):
    """Ids that repeat (with texts of equal and other lengths) or are null, texts that tie, are empty or null."""
    r = np.random.default_rng(2)
    text = lambda: " ".join(f"w{x}" for x in r.zipf(1.4, r.integers(1, 25)) % 300)
    rows = [(int(i), text()) for i in r.integers(0, 700, 1500)] + [(None, text()) for _ in range(3)] + [(50, "x y z"), (50, "y z w1"), (9001, None), (9050, ""), (9100, "the of")]
    rows += [(i, "the same rare words") for i in [*range(9200, 9230), None]]
    write_documents(tmp_path, rows)
    want = duck_rows(upkeep_sql.ORACLE["bm25_all"], str(tmp_path))
    assert spark_rows(upkeep.bm25_all(spark, str(tmp_path))) == want and len(want[1]) >= 100
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    q = docs.filter("doc_id % 50 = 0 and text is not null").selectExpr("doc_id as query_id", "text as query")
    assert spark_rows(lexical.best(docs, "doc_id", "text", q, 10, sent_terms=40)) == want  # several scans
    assert lexical.best(docs.limit(0), "doc_id", "text", q, 10).count() == lexical.best(docs, "doc_id", "text", q.limit(0), 10).count() == 0
