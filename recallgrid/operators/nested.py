"""Flat related tables from deeply nested records (shared inlining).

Method: the fields of all records form a schema graph whose nodes are element
names. Elements that occur once below their parent are inlined into the
parent's table; elements that are repeated (in arrays), shared (below several
parents) or recursive get a table of their own. A row's key is its path, its
foreign key the path of the row it hangs below, whatever table that is in.

Defined results: a record that isn't valid JSON, is null or is nested deeper
than the parser allows has no fields; a string that holds a JSON object or
array stands for that value; a single object in one of the listed fields is an
array of one; nulls keep their position but give no row; of a repeated key the
last value counts. Very long texts are kept whole. Any number of element names
gives the same tables (see ``table_elements``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Fields whose single object is an array of one (fixed values of the data model).
ARRAY_FIELDS = ("steps", "calls", "results", "commits", "files", "hunks")
TOP = "payload"


def _no_constant(name: str):
    raise ValueError(name)


_decode = json.JSONDecoder(parse_constant=_no_constant).decode


def parse(text: str | None):
    """The value of a JSON text, or None where it isn't valid."""
    if text is None:
        return None
    try:
        return _decode(text)
    except (ValueError, RecursionError):
        return None


def unwrap(v):
    """A string holding a JSON object or array stands for that value."""
    while type(v) is str:
        s = v.lstrip()
        if not s or s[0] not in "{[":
            return v
        w = parse(v)
        if type(w) is not dict and type(w) is not list:
            return v
        v = w
    return v


def _edges(array_fields: frozenset):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, int] = {}

        def flush():
            out = pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["parent", "child", "kind", "n"])
            seen.clear()
            return out

        for pdf in batches:
            for text in pdf["doc"]:
                top = unwrap(parse(text))
                if type(top) is list:
                    seen["", TOP, "array"] = seen.get(("", TOP, "array"), 0) + 1
                stack = [(TOP, top)]
                while stack:
                    name, v = stack.pop()
                    if type(v) is dict:
                        for k, x in v.items():
                            x = unwrap(x)
                            t = type(x)
                            many = t is list or (t is dict and k in array_fields)
                            kind = "array" if many else "object" if t is dict else "scalar"
                            e = (name, k, kind)
                            seen[e] = seen.get(e, 0) + 1
                            if t is dict or t is list:
                                stack.append((k, x))
                    elif type(v) is list:
                        stack.extend((name, w) for w in map(unwrap, v) if type(w) is dict or type(w) is list)
            if len(seen) > 50_000:
                yield flush()
        if seen:
            yield flush()

    return run


def schema_graph(df: DataFrame, doc: str, array_fields=ARRAY_FIELDS) -> DataFrame:
    """(parent, child, kind, n): the edges of the schema graph over all records, counted."""
    part = df.select(F.col(doc).alias("doc")).filter("doc is not null").mapInPandas(_edges(frozenset(array_fields)), "parent string, child string, kind string, n long")
    return part.groupBy("parent", "child", "kind").agg(F.sum("n").alias("n"))


#: Composite edges of the schema graph, and elements with a table, that the driver reads at most (a few MB); more are joined.
MANY_EDGES = 100_000


def _loops(edges: list[tuple[str, str]]) -> set[str]:
    """Elements that reach themselves: those of a strongly connected component with an inner edge."""
    below: dict[str, list[str]] = {}
    for p, c in edges:
        below.setdefault(p, []).append(c)
    order, low, open_, stack, out = {}, {}, set(), [], set()
    for root in below:
        todo = [(root, iter(below[root]))] if root not in order else []
        while todo:
            v, kids = todo[-1]
            if v not in order:
                order[v] = low[v] = len(order)
                stack.append(v)
                open_.add(v)
            for w in kids:
                if w not in order:
                    todo.append((w, iter(below.get(w, ()))))
                    break
                if w in open_:
                    low[v] = min(low[v], order[w])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[v])
                if low[v] == order[v]:
                    part = []
                    while not part or part[-1] != v:
                        part.append(stack.pop())
                    open_.difference_update(part)
                    if len(part) > 1 or v in below.get(v, ()):
                        out.update(part)
    return out


def _loops_joined(comp: DataFrame) -> DataFrame:
    """(element): the same by joins, for graphs of any size.

    Elements without a parent or a child left are peeled off round by round;
    what remains is followed by doubling joins.
    """
    scratch = Scratch(comp.sparkSession, "schema")
    left = scratch.cut(comp.select("parent", "child").distinct())
    n, before = left.count(), None
    while n and n != before:
        has_parent, has_child = left.select(F.col("child").alias("parent")).distinct(), left.select(F.col("parent").alias("child")).distinct()
        left = scratch.cut(left.join(has_parent, "parent", "left_semi").join(has_child, "child", "left_semi").select("parent", "child"))
        n, before = left.count(), n
    reach, before = left, None
    while n and n != before:
        longer = reach.select("parent", F.col("child").alias("x")).join(reach.select(F.col("parent").alias("x"), "child"), "x").select("parent", "child")
        reach = scratch.cut(reach.union(longer).distinct())
        n, before = reach.count(), n
    return reach.filter("parent = child").select(F.col("child").alias("element")).distinct()


def element_kinds(graph: DataFrame, many_edges: int = MANY_EDGES) -> DataFrame:
    """(element, kind): the elements with a table of their own: repeated, recursive or shared."""
    comp = graph.filter("kind <> 'scalar'")
    rows = comp.select("parent", "child").distinct().limit(many_edges + 1).collect()
    if len(rows) > many_edges:
        loops = _loops_joined(comp)
    else:
        loops = graph.sparkSession.createDataFrame([(x,) for x in sorted(_loops([(r[0], r[1]) for r in rows]))], "element string")
    by = comp.groupBy(F.col("child").alias("element")).agg(F.max(F.col("kind") == "array").alias("many"), F.countDistinct("parent").alias("parents"))
    kind = F.when(F.col("many"), "repeated").when(F.col("loop"), "recursive").when(F.col("parents") > 1, "shared")
    return by.join(loops.withColumn("loop", F.lit(True)), "element", "left").select("element", kind.alias("kind")).filter("kind is not null")


def table_elements(graph: DataFrame, many_edges: int = MANY_EDGES) -> dict[str, str] | DataFrame:
    """Element name -> why it has a table; of more than ``many_edges`` names (data used as keys) a written table of both.

    ``shred`` gives the same rows with either.
    """
    kinds = element_kinds(graph, many_edges)
    rows = kinds.limit(many_edges + 1).collect()
    return {r["element"]: r["kind"] for r in rows} if len(rows) <= many_edges else Scratch(graph.sparkSession, "elements").cut(kinds)


def _names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, element) of (id, doc): the names of objects and arrays of each record."""
    for pdf in batches:
        ids, names = [], []
        for i, text in zip(pdf["id"], pdf["doc"]):
            own, stack = {TOP: None}, [unwrap(parse(text))]
            if type(stack[0]) is not dict and type(stack[0]) is not list:
                continue
            while stack:
                v = stack.pop()
                if type(v) is dict:
                    for k, x in v.items():
                        x = unwrap(x)
                        if type(x) is dict or type(x) is list:
                            own[k] = None
                            stack.append(x)
                else:
                    stack.extend(x for x in map(unwrap, v) if type(x) is dict or type(x) is list)
            ids += [i] * len(own)
            names += own
        yield pd.DataFrame({"id": pd.Series(ids, dtype=object), "element": pd.Series(names, dtype=object)})


def _with_tables(src: DataFrame, tables: DataFrame) -> DataFrame:
    """src (id, doc, …) with the part of ``tables`` that each record needs, as lists ``elements`` and ``kinds``."""
    found = src.select("id", "doc").filter("doc is not null").mapInPandas(_names, "id string, element string")
    own = found.join(tables, "element").groupBy(F.col("id").alias("_id")).agg(F.collect_set(F.struct("element", "kind")).alias("_own"))
    both = src.join(own, F.col("id").eqNullSafe(F.col("_id")), "left")
    return both.select(*src.columns, F.col("_own.element").alias("elements"), F.col("_own.kind").alias("kinds"))


def _shred(tables: dict[str, str] | None, array_fields: frozenset, columns: bool, lists: tuple[str, ...]):
    """Without tables, those of a record stand beside it."""
    given = tables, {k: v for k, v in (tables or {}).items() if v != "repeated"}

    def beside(pdf: pd.DataFrame):
        for names, kinds in zip(pdf["elements"], pdf["kinds"]):
            own = {} if names is None else dict(zip(names, kinds))
            yield own, {k: v for k, v in own.items() if v != "repeated"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict[str, list] = {c: [] for c in ("record_id", "element", "kind", "node_path", "parent_path", "array_path", "columns")}
            rid, element, kind, node, parent, array, cols = out.values()

            def add(i, name, why, path, up, near, own):
                rid.append(i), element.append(name), kind.append(why), node.append(path), parent.append(up), array.append(near), cols.append(own)

            for at, name in enumerate(lists):
                for i, items in zip(pdf["id"], pdf[f"list{at}"]):
                    if items is not None and len(items):
                        for n, x in enumerate(items):
                            if x is not None:
                                add(i, name, "value", f"{name}/{n}", "", "", {"value": str(x)})
            for i, text, (tabled, single) in zip(pdf["id"], pdf["doc"], repeat(given) if tables is not None else beside(pdf)):
                v = unwrap(parse(text))
                if type(v) is not dict and type(v) is not list:
                    continue
                top: dict = {}
                # (value, path, name, path of the row above, of the array element above, where its scalars go: rows with prefixes)
                stack = [(v, "", TOP, "", "", ((top, ""),))]
                add(i, TOP, "top", "", None, "", top)
                while stack:
                    v, path, name, up, near, into = stack.pop()
                    if type(v) is dict:
                        for k, x in v.items():
                            x = unwrap(x)
                            t = type(x)
                            p = f"{path}/{k}" if path else k
                            if t is dict:
                                if k in array_fields:
                                    stack.append(([x], p, k, up, near, into))
                                elif k in single:
                                    row: dict = {}
                                    add(i, k, single[k], p, up, near, row)
                                    # a shared object has its own row, and its fields stand in the row above too
                                    also = tuple((r, f"{pre}{k}.") for r, pre in into) if single[k] == "shared" else ()
                                    stack.append((x, p, k, p, near, ((row, ""), *also)))
                                else:
                                    stack.append((x, p, k, up, near, tuple((r, f"{pre}{k}.") for r, pre in into)))
                            elif t is list:
                                stack.append((x, p, k, up, near, into))
                            elif columns:
                                s = None if x is None else x if t is str else json.dumps(x)
                                for r, pre in into:
                                    r[pre + k] = s
                    else:
                        for at, x in enumerate(v):
                            x = unwrap(x)
                            t = type(x)
                            p = f"{path}/{at}" if path else str(at)
                            if t is dict:
                                if name in tabled:
                                    row = {}
                                    add(i, name, "repeated", p, up, near, row)
                                    stack.append((x, p, name, p, p, ((row, ""),)))
                            elif t is list:
                                stack.append((x, p, name, up, near, into))
                            elif columns and x is not None:
                                add(i, name, "value", p, up, near, {"value": x if t is str else json.dumps(x)})
            if rid:
                yield pd.DataFrame(out if columns else {k: v for k, v in out.items() if k != "columns"})

    return run


def shred(df: DataFrame, record_id: str, doc: str, tables: dict[str, str] | DataFrame, array_fields=ARRAY_FIELDS, columns: bool = True, lists: tuple[str, ...] = ()) -> DataFrame:
    """(record_id, element, kind, node_path, parent_path, array_path[, columns]), one row per row of a table.

    kind is repeated (an object in an array), shared or recursive (a single
    object with a table of its own), value (a scalar in an array) or top (the
    record itself). ``node_path`` is the key, ``parent_path`` the key of the
    row above, of any table (null for the top row); ``array_path`` is that of
    the nearest object in an array above, or ''. ``columns`` holds the inlined
    fields by dotted name; without it no scalars are read. ``lists`` names list
    columns whose non-null items become rows of kind value, with path
    name/position. ``tables`` is what ``table_elements`` gives; a table of them
    is joined with the names in each record.
    """
    schema = "record_id string, element string, kind string, node_path string, parent_path string, array_path string" + ", columns map<string,string>" * columns
    src = df.select(F.col(record_id).cast("string").alias("id"), F.col(doc).alias("doc"), *[F.col(c).alias(f"list{i}") for i, c in enumerate(lists)])
    if not lists:
        src = src.filter("doc is not null")
    if isinstance(tables, DataFrame):
        src, tables = _with_tables(src, tables), None
    return src.mapInPandas(_shred(tables, frozenset(array_fields), columns, tuple(lists)), schema)


def child_table(shredded: DataFrame, element: str, columns: list[str]) -> DataFrame:
    """The flat table of one element, with the named columns."""
    rows = shredded.filter((F.col("element") == element) & F.col("kind").isin("top", "repeated", "shared", "recursive"))
    return rows.select("record_id", "node_path", "parent_path", *[F.col("columns")[c].alias(c.replace(".", "_")) for c in columns])


def array_items(df: DataFrame, record_id: str, items: str, name: str) -> DataFrame:
    """(record_id, node_path, parent_path, value) of an array column's non-null items."""
    return df.select(F.col(record_id).alias("record_id"), F.posexplode(F.col(items)).alias("at", "value")).filter("value is not null").select(
        "record_id", F.concat(F.lit(f"{name}/"), F.col("at").cast("string")).alias("node_path"), F.lit("").alias("parent_path"), "value"
    )
