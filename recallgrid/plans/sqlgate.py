"""The SQL surface: read-only guard, tenant sessions, search and state as tables, row cap, timeout.

Guard and substitution work on Spark's own parsed plan, never on the text's
surface, so literals and comments cannot confuse them.
"""

from __future__ import annotations

import re
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

# Functions that read files or run foreign code.
FORBIDDEN = (
    "read_text read_blob read_csv read_csv_auto read_json read_json_auto read_json_objects read_ndjson read_ndjson_auto read_ndjson_objects read_parquet read_xlsx "
    "parquet_scan parquet_metadata parquet_schema parquet_file_metadata parquet_kv_metadata csv_sniff sniff_csv glob reflect try_reflect java_method read_files"
).split()
EPISODIC, COGNITION = {"episodic", "sessions"}, {"memories", "memory_edges", "memory_grants", "memory_attachments"}
_PATH = re.compile(r"^(?:parquet|json|csv|text|orc|avro|binaryfile|delta|jdbc|xml)$", re.I)


#: Expressions of Spark's parser that hold a plan (fixed values).
_WITH_PLAN = ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression")


class Rejected(ValueError):
    """SQL that isn't allowed."""


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def _walk(plan):
    """All nodes of a parsed plan, those of common table expressions and subqueries too."""
    yield plan
    kids = _seq(plan.children())
    if plan.nodeName() == "UnresolvedWith":
        # of each (name, query[, depth])
        kids += [t._2() for t in _seq(plan.cteRelations())]
    for e in _seq(plan.expressions()):
        for x in _expressions(e):
            if x.getClass().getSimpleName() in _WITH_PLAN:
                kids.append(x.plan())
    for k in kids:
        yield from _walk(k)


def _expressions(e):
    yield e
    for c in _seq(e.children()):
        yield from _expressions(c)


def parse(spark: SparkSession, sql: str):
    if not sql or not sql.strip().strip(";").strip():
        raise Rejected("empty SQL statement")
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";"))
    except Exception as e:
        raise Rejected(f"SQL parse error: {str(e)[:300]}") from None


def check(spark: SparkSession, sql: str) -> list[str]:
    """The tables a query names, in order; raises Rejected for anything but a harmless query."""
    plan = parse(spark, sql)
    tables: list[str] = []
    for node in _walk(plan):
        kind, cls = node.nodeName(), node.getClass().getName()
        if ".command." in cls or kind.startswith(("Insert", "Create", "Drop", "Alter", "Delete", "Update", "Merge", "Set", "Reset", "Cache", "Refresh", "Truncate", "Show", "Describe", "Explain", "Add", "Overwrite", "Append")):
            raise Rejected(f"only queries are allowed, got {kind}")
        if kind == "UnresolvedRelation":
            parts = _seq(node.multipartIdentifier())
            if len(parts) > 1 and (_PATH.match(parts[0]) or "/" in parts[-1]):
                raise Rejected("files may not be read by path")
            name = parts[-1].lower()
            if name in FORBIDDEN:
                raise Rejected("this SQL function is not permitted")
            if name not in tables:
                tables.append(name)
        if kind == "SubqueryAlias" and node.alias().lower() == "asof":
            raise Rejected("ASOF JOIN is not part of this dialect; use operators.asof")
        if kind == "UnresolvedTableValuedFunction" and _seq(node.name())[-1].lower() in FORBIDDEN:
            raise Rejected("this SQL function is not permitted")
        for e in _seq(node.expressions()):
            for x in _expressions(e):
                if x.getClass().getSimpleName() == "UnresolvedFunction" and _seq(x.nameParts())[-1].lower() in FORBIDDEN:
                    raise Rejected("this SQL function is not permitted")
    return tables


def tenant_session(spark: SparkSession, tables: dict[str, DataFrame], tenant: str) -> SparkSession:
    """A session whose catalog holds nothing but this tenant's rows.

    The filters are part of the views, so Catalyst pushes them to the scans;
    rows without a tenant are of tenant ``default``.
    """
    s = spark.newSession()
    s.conf.set("spark.sql.runSQLOnFiles", "false")
    s.conf.set("spark.sql.session.timeZone", "UTC")
    for name, df in tables.items():
        mine = DataFrame(df._jdf, s)
        if "tenant_id" in df.columns:
            from pyspark.sql import functions as F

            cond = F.col("tenant_id") == tenant
            mine = mine.filter(cond | F.col("tenant_id").isNull() if tenant == "default" else cond)
        _view(s, mine, name)
    return s


def _view(session: SparkSession, df: DataFrame, name: str) -> None:
    """A temporary view in ``session`` of a frame that may stem from another one."""
    jvm = session._jvm
    jdf = jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, df._jdf.queryExecution().analyzed())
    jdf.createOrReplaceTempView(name)


# search('text', k) and state('agent', 'key') as tables
_CALL = re.compile(r"\b(memory_search|memory_state)\s*\(", re.I)


def _arguments(sql: str, at: int) -> tuple[list, int]:
    """Literal arguments from an opening parenthesis on, and where the call ends."""
    out, i, n = [], at, len(sql)
    while i < n:
        c = sql[i]
        if c == ")":
            return out, i + 1
        if c == "'":
            j, v = i + 1, []
            while j < n:
                if sql[j] == "'" and sql[j + 1 : j + 2] == "'":
                    v.append("'")
                    j += 2
                elif sql[j] == "'":
                    break
                else:
                    v.append(sql[j])
                    j += 1
            out.append("".join(v))
            i = j + 1
        elif c.isdigit():
            j = i
            while j < n and sql[j].isdigit():
                j += 1
            out.append(int(sql[i:j]))
            i = j
        elif c in ", \t\n":
            i += 1
        else:
            raise Rejected("function arguments must be literals")
    raise Rejected("unclosed function call")


def _outside_literals(sql: str):
    """Positions of calls that aren't inside a string literal or a comment."""
    quoted = [(m.start(), m.end()) for m in re.finditer(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", sql, re.S)]
    for m in _CALL.finditer(sql):
        if not any(a <= m.start() < b for a, b in quoted):
            yield m


def substitute(session: SparkSession, sql: str, search, state) -> str:
    """The query with each table function replaced by a temporary view of its rows.

    ``search(text, k)`` and ``state(agent, key)`` give DataFrames; both are
    small (k rows, one row), so Spark broadcasts them in joins.
    """
    out, at = [], 0
    for m in _outside_literals(sql):
        if m.start() < at:
            continue
        args, end = _arguments(sql, m.end())
        if m[1].lower() == "memory_search":
            df = search(args[0], args[1] if len(args) > 1 else 5)
        else:
            df = state(args[0], args[1])
        name = f"fn_{uuid.uuid4().hex[:12]}"
        _view(session, df, name)
        out += [sql[at : m.start()], name]
        at = end
    return "".join(out) + sql[at:]


def run_sql(session: SparkSession, sql: str, max_rows: int | None = 10_000, timeout_s: float | None = None, strict_stores: bool = False) -> DataFrame:
    """A guarded query, capped at ``max_rows``; after ``timeout_s`` its jobs are cancelled."""
    names = set(check(session, sql))
    if strict_stores and names & EPISODIC and names & COGNITION:
        raise Rejected("a query may not join the event and the cognition store")
    df = session.sql(sql.strip().rstrip(";"))
    df = df if max_rows is None else df.limit(max_rows)
    if timeout_s is None:
        return df
    tag = f"sql-{uuid.uuid4().hex[:12]}"
    sc = session.sparkContext
    timer = threading.Timer(timeout_s, lambda: sc.cancelJobsWithTag(tag))
    sc.addJobTag(tag)
    timer.start()
    try:
        return session.createDataFrame(df.collect(), df.schema)
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
