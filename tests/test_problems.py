"""The problem operators against brute force on small tables, hot keys and odd rows included."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recallgrid.operators.asof import attributes_as_known
from recallgrid.operators.changefeed import EqualityDeleteTable, current_state
from recallgrid.operators.hierarchy import descendants, resolve_tree
from recallgrid.operators.intervals import periods_and_gaps
from recallgrid.operators.joins import asof_join, range_join
from recallgrid.operators.nested import child_table, element_kinds, parse, schema_graph, shred, table_elements, unwrap
from recallgrid.operators.sessions import sessionize
from recallgrid.queries import QUERIES, problems
from recallgrid.session import Scratch
from recallgrid.skew import hot_keys


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 1

ENTITY = "tenant string, agent string, subject string"


def brute_asof(ev, mem):
    out = []
    for e, t, a, s, ts in ev:
        if None in (t, a, s, ts):
            continue
        best = max(((vf, rec, m) for m, mt, ma, ms, vf, vt, rec in mem if None not in (vf, rec) and (mt, ma, ms) == (t, a, s) and vf <= ts and rec <= ts and (vt is None or ts < vt)), default=None)
        if best:
            out.append((e, best[2]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot_rows", [1_000_000, 40])
def test_attributes_as_known(spark, hot_rows):
    r = random.Random(3)
    key = lambda: ("t", r.choice(["a", "a", "a", "b", None]), r.choice(["s", "s", "s", "u"]))
    ev = [(f"e{i}", *key(), r.choice([None, *range(0, 200)])) for i in range(600)]
    mem = []
    for i in range(150):
        vf = r.randrange(0, 200)
        mem.append((f"m{i:03}", *key(), r.choice([vf, vf, vf, None]), r.choice([None, vf + r.randrange(-5, 90)]), r.choice([vf, vf + r.randrange(0, 60), None])))
    e = spark.createDataFrame(ev, f"event_id string, {ENTITY}, ts long").withColumn("until", F.lit(1)).withColumn("bucket", F.lit("x"))
    m = spark.createDataFrame(mem, f"memory_id string, {ENTITY}, valid_from long, valid_to long, recorded long").withColumn("ts", F.lit(0))
    got = rows(attributes_as_known(e, m, rows_per_bucket=100, hot_rows=hot_rows))
    assert got == brute_asof(ev, mem)
    assert rows(attributes_as_known(e.limit(0), m)) == [] == rows(attributes_as_known(e, m.limit(0)))


def test_asof_and_range_join_helpers(spark):
    left = spark.createDataFrame([(1, "k", 5), (2, "k", 9), (3, "x", 9), (4, None, 9), (5, "k", None)], "id int, k string, t int")
    right = spark.createDataFrame([("k", 4, "a"), ("k", 5, "b"), ("k", 5, "c"), (None, 1, "z")], "k string, t int, v string")
    assert rows(asof_join(left, right, ["k"], "t", ["v"]).select("id", "v")) == [(1, "c"), (2, "c"), (3, None), (4, None), (5, None)]
    assert rows(asof_join(left, right, ["k"], "t", ["v"], strict=True).select("id", "v"))[0] == (1, "a")
    ranges = spark.createDataFrame([("k", 0, 6), ("k", 5, 5), ("k", 9, 30)], "k string, a int, b int")
    assert rows(range_join(left, ranges, ["k"], "t", "a", "b", 4).select("id", "a")) == [(1, 0), (2, 9)]


def test_more_than_a_thousand_hot_keys(spark):
    """The bound of a slice does not grow with the data or with the number of hot keys."""
    e = spark.range(4400).select((F.col("id") % 1100).alias("agent"), F.col("id").alias("ts"))
    hot = hot_keys(e, ["agent"], 3)
    assert (hot.n_keys, hot.rows, hot.total) == (1100, 4400, 4400)
    sliced = hot.ranged(hot.inside(e), "ts")
    assert sliced.count() == 4400 and sliced.groupBy("_slice").count().agg(F.max("count")).first()[0] <= 9


def test_slices_change_no_result(spark):
    r = random.Random(12)
    ev = [(f"e{i}", "t", f"a{i % 30}", "s", r.randrange(0, 300)) for i in range(900)]
    mem = [(f"m{i}", "t", f"a{i % 30}", "s", v, v + r.randrange(1, 150) if i % 3 else None, v + r.randrange(0, 20)) for i in range(400) for v in [r.randrange(0, 250)]]
    e = spark.createDataFrame(ev, f"event_id string, {ENTITY}, ts long")
    m = spark.createDataFrame(mem, f"memory_id string, {ENTITY}, valid_from long, valid_to long, recorded long")
    assert rows(attributes_as_known(e, m, hot_rows=8)) == brute_asof(ev, mem)
    right = m.select("agent", F.col("valid_from").alias("ts"), F.col("memory_id").alias("v"))
    assert rows(asof_join(e, right, ["agent"], "ts", ["v"], hot_rows=8)) == rows(asof_join(e, right, ["agent"], "ts", ["v"]))


# 2


def test_parse_and_unwrap():
    assert parse('{"a": NaN}') is None and parse("{") is None and parse(None) is None and parse("") is None
    assert parse("[" * 100_000) is None
    assert unwrap('[{"a": 1}]') == [{"a": 1}] and unwrap("[x") == "[x" and unwrap("") == "" and unwrap('"[]"') == '"[]"'


def brute_nested(i, text):
    out = []
    v = parse(text)

    def walk(v, path, up, name):
        v = unwrap(v)
        if isinstance(v, dict):
            if name in ("steps", "calls", "results", "commits", "files", "hunks"):
                return walk([v], path, up, None)
            for k, x in v.items():
                walk(x, f"{path}/{k}" if path else k, up, k)
        elif isinstance(v, list):
            for n, x in enumerate(v):
                x, p = unwrap(x), f"{path}/{n}" if path else str(n)
                if isinstance(x, dict):
                    out.append((i, p, up))
                    for k, y in x.items():
                        walk(y, f"{p}/{k}", p, k)
                else:
                    walk(x, p, up, None)

    walk(v, "", "", None)
    return out


DOCS = [
    {"steps": [{"tool": "a", "calls": [{"call_id": "1", "args": {"q": "x"}, "results": '[{"ref": "r"}, null]'}, None]}, None, {"tool": "b", "calls": {"call_id": "2"}}]},
    {"steps": '{"tool": "c", "note": "long"}', "labels": {"lang": "en"}},
    {"raw": '{"commits": {"id": 1, "files": [{"hunks": [{"at": 1}, {"at": 2}]}]}}'},
    [[{"deep": [[{"x": 1}]]}], {"y": {"results": {}}}],
    {"a": {"b": {"a": {"b": 1}}}, "text": "x" * 50_000},
    {"labels": None, "results": [], "calls": None},
]


def test_shared_inlining(spark):
    texts = [(f"e{i}", json.dumps(x)) for i, x in enumerate(DOCS)] + [("bad", '{"a'), ("none", None), ("empty", ""), ("scalar", "3")]
    df = spark.createDataFrame(texts, "id string, payload string").withColumn("doc", F.lit(1)).withColumn("kind", F.lit("k"))
    tables = table_elements(schema_graph(df, "payload"))
    assert tables["steps"] == "repeated" and tables["a"] == "recursive"
    want = sorted((x for i, t in texts for x in brute_nested(i, t)), key=repr)
    bare = shred(df, "id", "payload", tables, columns=False)
    assert rows(bare.filter("kind = 'repeated'").select("record_id", "node_path", "array_path")) == want
    full = shred(df, "id", "payload", tables)
    assert rows(full.filter("kind = 'repeated'").select("record_id", "node_path", "array_path")) == want
    # every foreign key names a row
    keys = {(x["record_id"], x["node_path"]) for x in full.collect() if x["kind"] != "value"}
    assert all((x["record_id"], x["parent_path"]) in keys for x in full.collect() if x["kind"] != "top")
    a = {x["node_path"]: (x["kind"], x["parent_path"], x["columns"]) for x in full.filter("record_id = 'e4'").collect()}
    assert a["a"][:2] == ("recursive", "") and a["a/b"][:2] == ("recursive", "a") and a["a/b/a"] == ("recursive", "a/b", {"b": "1"})
    calls = child_table(full, "calls", ["call_id", "args.q"])
    assert rows(calls) == [("e0", "steps/0/calls/0", "steps/0", "1", "x"), ("e0", "steps/2/calls/0", "steps/2", "2", None)]
    assert rows(shred(df.limit(0), "id", "payload", {})) == []
    tags = spark.createDataFrame([("a", None, ["x", None, "x"]), ("b", '{"steps": {}}', None), ("c", "{", [])], "id string, payload string, tags array<string>")
    got = rows(shred(tags, "id", "payload", tables, columns=False, lists=("tags",)).filter("kind <> 'top'").select("record_id", "node_path", "parent_path"))
    assert got == [("a", "tags/0", ""), ("a", "tags/2", ""), ("b", "steps/0", "")]


def test_shared_elements_have_a_row_and_stay_inlined(spark):
    docs = [("x", json.dumps({"p": {"args": {"q": "1"}}, "calls": [{"args": {"q": "2", "deep": {"z": True}}}]}))]
    df = spark.createDataFrame(docs, "id string, payload string")
    tables = table_elements(schema_graph(df, "payload"))
    assert tables == {"args": "shared", "calls": "repeated"}
    full = shred(df, "id", "payload", tables)
    assert rows(child_table(full, "args", ["q", "deep.z"])) == [("x", "calls/0/args", "calls/0", "2", "true"), ("x", "p/args", "", "1", None)]
    assert rows(child_table(full, "calls", ["args.q", "args.deep.z"])) == [("x", "calls/0", "", "2", "true")]
    assert rows(child_table(full, "payload", ["p.args.q"])) == [("x", "", None, "1")]


@pytest.mark.parametrize("many", [100_000, 10])
def test_very_many_names(spark, many):
    """Data used as keys: 20,000 element names, with loops; rows are the same however the graph is reduced."""
    docs = [(f"d{i}", json.dumps({f"k{i}_{j}": {"items": [{"v": j}]} for j in range(100)} | {"loop": {"x": {"y": {"x": {}}}}})) for i in range(200)]
    df = spark.createDataFrame(docs, "id string, payload string")
    graph = schema_graph(df, "payload")
    kinds = {x["element"]: x["kind"] for x in element_kinds(graph, many).collect()}
    assert kinds == {"items": "repeated", "x": "recursive", "y": "recursive"}
    got = shred(df, "id", "payload", table_elements(graph, many), columns=False).filter("kind = 'repeated'")
    assert got.count() == 20_000


def nested_texts():
    """Payloads with repeated, shared and recursive names, on top of DOCS; ids that repeat or are null."""
    docs = [*DOCS, {"p": {"args": {"q": "1"}}, "calls": [{"args": {"q": "2", "deep": {"z": True}}}]}, {"o": {"args": {"m": [{"v": 1}, [2]]}}}, {"w": {"args": {"q": 3}}}, {"steps": ["s", {"p": {"n": None}}]}]
    return [(f"e{i}", json.dumps(x)) for i, x in enumerate(docs)] + [("bad", '{"a'), ("none", None), ("scalar", "3"), (None, '{"a": {"x": {"a": {"y": 1}}}}'), ("e0", '{"o": {"p": {"k": [1]}}}')]


def test_tables_do_not_depend_on_the_number_of_names(spark):
    """Beyond the limit of names shared and recursive objects once lost their tables."""
    df = spark.createDataFrame([(*x, ["t", None]) for x in nested_texts()], "id string, payload string, tags array<string>")
    graph = schema_graph(df, "payload")
    few, many = table_elements(graph), table_elements(graph, 2)
    assert isinstance(few, dict) and {"shared", "recursive", "repeated"} == set(few.values())
    for columns in (True, False):
        for lists in ((), ("tags",)):
            want, got = (rows(shred(df, "id", "payload", t, columns=columns, lists=lists)) for t in (few, many))
            assert got == want and len(want) > 30
    part = {k: v for k, v in few.items() if k != "calls"}  # a map that names fewer elements
    joined = spark.createDataFrame(list(part.items()), "element string, kind string")
    assert rows(shred(df, "id", "payload", joined)) == rows(shred(df, "id", "payload", part))


@pytest.mark.parametrize("query", ["p2_found", "p2_top", "p2_values", "p2_links", "p2_steps", "p2_elements"])
def test_queries_do_not_depend_on_the_number_of_names(spark, query, tmp_path, monkeypatch):
    ep = spark.createDataFrame([(*x, n, ["t"]) for n, x in enumerate(nested_texts())], "id string, payload string, n int, tags array<string>")
    ep = ep.selectExpr("id", "cast(null as string) as tenant_id", "cast(null as string) as idempotency_key", "timestamp_seconds(n) as ingested_at", "payload", "tags")
    ep.write.parquet(f"{tmp_path}/episodic.parquet")
    run = lambda: rows(QUERIES[query](spark, str(tmp_path)))
    want = run()
    problems._SHREDDED.clear()
    for name in ("table_elements", "element_kinds"):
        monkeypatch.setattr(problems, name, lambda graph, f=getattr(problems, name): f(graph, 2))
    assert run() == want != []
    problems._SHREDDED.clear()


# 3


def brute_periods(iv):
    out = []
    for k in {x[0] for x in iv if x[0] is not None}:
        spans = sorted((s, e if e is not None else float("inf")) for kk, s, e in iv if kk == k and s is not None and (e is None or e > s))
        merged = []
        for s, e in spans:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(k, "period", s, -1 if e == float("inf") else e) for s, e in merged]
        out += [(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot_rows", [1_000_000, 30])
@pytest.mark.parametrize("span", [4, 60])
def test_periods_and_gaps(spark, hot_rows, span):
    r = random.Random(span)
    iv = []
    for _ in range(500):
        s = r.randrange(0, 1500)
        iv.append((r.choice(["a", "a", "a", "b", "c", None]), r.choice([s] * 20 + [None]), r.choice([s + r.randrange(-2, span)] * 60 + [None])))
    iv += iv[:20]
    df = spark.createDataFrame(iv, "k string, s long, e long").withColumns({"_s": F.lit(1), "kind": F.lit("x"), "_slice": F.lit(0)})
    assert rows(periods_and_gaps(df, ["k"], "s", "e", hot_rows)) == brute_periods(iv)
    assert rows(periods_and_gaps(df.limit(0), ["k"], "s", "e")) == []


# 4


def test_change_feed_in_any_order_and_split(spark):
    r = random.Random(9)
    t0 = datetime(2020, 1, 1)
    feed = []
    for i in range(400):
        feed.append((i, r.choice(["a", "a", None]), r.choice(["k1", "k2", None]), f"v{i}", r.choice([None, 0, 1, 2]), r.choice([None, False, True]), t0 + timedelta(minutes=r.randrange(0, 150))))
    feed += [(1000 + i, *x[1:]) for i, x in enumerate(feed[:50])]  # repeated changes
    best = {}
    for off, a, k, v, ver, dl, at in feed:
        seq = (at, ver is not None, ver or 0, bool(dl), -off)
        if (a, k) not in best or seq > best[a, k][0]:
            best[a, k] = (seq, dl, v)
    want = sorted(((a, k, v) for (a, k), (_, dl, v) in best.items() if not dl), key=repr)
    schema = "off long, agent string, key string, value string, version long, deleted boolean, at timestamp"
    df = spark.createDataFrame(feed, schema).withColumns({"_seq": F.lit(1), "_del": F.lit(2), "_row": F.lit(3), "_k0": F.lit(4)})
    assert rows(current_state(df, ["agent", "key"], "at", "version", "deleted", "off").select("agent", "key", "value")) == want
    table = EqualityDeleteTable(spark, Scratch(spark, "test").root, ["agent", "key"])
    for part in (2, 0, 1):
        table.append(df.filter(F.col("off") % 3 == part), "at", "version", "deleted", "off")
    assert rows(table.read().select("agent", "key", "value")) == want
    assert rows(current_state(df.limit(0), ["agent", "key"], "at", "version", "deleted", "off")) == []


# 5


def brute_sessions(ev, gap):
    out = []
    for k in {(a, b) for a, b, *_ in ev}:
        if None in k:
            continue
        mine = sorted((t, y) for a, b, t, y in ev if (a, b) == k and t is not None) if True else []
        cur = []
        for t, y in sorted(mine, key=lambda x: x[0]):
            if cur and t - cur[-1][0] > gap:
                out.append((*k, cur))
                cur = []
            cur.append((t, y))
        if cur:
            out.append((*k, cur))
    return sorted(((a, b, c[0][0], c[-1][0], c[-1][0] - c[0][0], len(c), len({y for _, y in c if y is not None})) for a, b, c in out), key=repr)


@pytest.mark.parametrize("hot_rows", [1_000_000, 50])
@pytest.mark.parametrize("batch", ["10000", "7"])
def test_sessions(spark, hot_rows, batch):
    r = random.Random(1)
    ev = [(r.choice(["t", "t", None]), r.choice(["a", "a", "a", "b", "c", None]), r.choice([None] + [r.randrange(0, 4000)] * 30), r.choice(["x", "y", "z"])) for _ in range(1500)]
    ev = [(a, b, t, r.choice([y, y, ""]) or "w") for a, b, t, y in ev]
    df = spark.createDataFrame(ev, "tenant string, source string, us long, kind string").withColumns({"a": F.lit(1), "_slice": F.lit("s"), "edge": F.lit(0)})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for gap in (3, 10):
            assert rows(sessionize(df, "tenant", "source", "us", "kind", gap, hot_rows)) == brute_sessions(ev, gap)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert rows(sessionize(df.limit(0), "tenant", "source", "us", "kind", 3)) == []


def test_session_types_null(spark):
    df = spark.createDataFrame([("t", "a", 1, None), ("t", "a", 2, "x"), ("t", "b", 5, None)], "tenant string, source string, us long, kind string")
    assert rows(sessionize(df, "tenant", "source", "us", "kind", 3)) == [("t", "a", 1, 2, 1, 2, 1), ("t", "b", 5, 5, 0, 1, 0)]


# 7


@pytest.mark.parametrize("few", [100_000, 0])
def test_hierarchy(spark, few):
    r = random.Random(4)
    nodes = [("t", f"n{i}", f"n{r.randrange(0, i)}" if i and r.random() < 0.9 else None) for i in range(300)]
    nodes += [("t", f"c{i}", f"c{(i + 1) % 5}") for i in range(5)] + [("t", "below", "c0"), ("t", "self", "self"), ("t", "lost", "nowhere"), ("u", "n1", "n2"), ("u", "n2", None), ("t", None, "n1")]
    nodes += [("t", f"d{i}", f"d{i - 1}" if i else "n5") for i in range(40)]
    nodes += [("t", f"h{i}", "n0") for i in range(200)]  # a node with very many children
    df = spark.createDataFrame(nodes, "table_name string, node_id string, parent_id string").withColumn("depth", F.lit(1))
    refs = df.filter("node_id is not null").select("table_name", F.col("node_id").alias("ref"), F.col("node_id").alias("canon"))
    up = {(t, n): p for t, n, p in nodes if n}
    want, pairs = [], []
    for (t, n), p in up.items():
        path, x = [n], n
        while up.get((t, x)) is not None and (t, up[t, x]) in up and up[t, x] not in path:
            x = up[t, x]
            path.append(x)
        cyc = up.get((t, x)) is not None and (t, up[t, x]) in up
        want.append((t, n, p, "", -1, None) if cyc else (t, n, p, x, len(path) - 1, "/".join(reversed(path))))
        if not cyc:
            pairs += [(t, a, n, i + 1) for i, a in enumerate(path[1:])]
    tree = resolve_tree(df, refs, keep_path=True, few_links=few)
    assert rows(tree.withColumn("path", F.array_join("path", "/"))) == sorted(want, key=repr)
    assert rows(descendants(tree)) == sorted(pairs, key=repr)
    plain = resolve_tree(df, refs, few_links=few)
    assert rows(plain) == sorted((x[:5] for x in want), key=repr)
    assert rows(resolve_tree(df.limit(0), refs.limit(0))) == []
