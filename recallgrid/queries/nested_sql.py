"""DuckDB SQL of problem 2: a recursive walk over the payloads, without the operator's method."""

from .problems_sql import EVENTS

#: A string that holds an object or array stands for that value, up to three times over.
_OPEN = "case when json_type({0}) = 'VARCHAR' and ltrim({0}->>'$', ' \t\n\r')[1] in ('{{', '[') and json_valid({0}->>'$') then ({0}->>'$')::json else {0} end"


def _unwrapped(x: str) -> str:
    return f"(select {_OPEN.format('c.z')} from (select {_OPEN.format('b.y')} as z from (select {_OPEN.format('a.x')} as y from (select {x} as x) a) b) c)"


_FIELDS = "('steps', 'calls', 'results', 'commits', 'files', 'hunks')"
_PATH = "path || case when path = '' then '' else '/' end || k || case when one then '/0' else '' end"
_PART = "json_extract(v, case when place then '$[' || k || ']' else '$.\"' || k || '\"' end)"
#: Walks the payloads: (id, path, near: nearest array element at or above, above: nearest one above, elem, name, v).
WALK = f"""with recursive {EVENTS},
  walk as (
    select id, '' as path, '' as near, '' as above, false as elem, '' as name, {_unwrapped('payload::json')} as v from ev where json_valid(payload)
    union all
    select id, {_PATH}, case when one or place and json_type(x) = 'OBJECT' then {_PATH} else near end, near, one or place and json_type(x) = 'OBJECT', case when place then name else k end, x
    from (select id, path, near, name, k, place, x, not place and json_type(x) = 'OBJECT' and k in {_FIELDS} as one
      from (select id, path, near, name, k, place, {_unwrapped(_PART)} as x
        from (select id, path, near, name, v, json_type(v) = 'ARRAY' as place,
            unnest(case when json_type(v) = 'ARRAY' then range(json_array_length(v)::bigint)::varchar[] else json_keys(v) end) as k
          from walk where json_type(v) in ('OBJECT', 'ARRAY'))))
    where json_type(x) in ('OBJECT', 'ARRAY'))
"""


def _own(*names: str) -> dict[str, str]:
    return {n: f"v->>'$.{n}'" for n in names}


def _below(*paths: str) -> dict[str, str]:
    out = {}
    for p in paths:
        a, b = p.split(".")
        inner = f"v->'$.{a}'"
        out[f"{a}_{b}"] = f"{_unwrapped(inner)}->>'$.{b}'"
    return out


def _child(element: str, columns: dict[str, str]) -> str:
    cols = ", ".join(f"{expr} as {c}" for c, expr in columns.items())
    return WALK + f"select id as event_id, path as node_path, above as parent_path, {cols} from walk where elem and name = '{element}'"


ORACLE = {
    "p2_found": WALK
    + "select id as event_id, path as node_path, above as parent_path from walk where elem union all select id, 'tags/' || (p - 1), '' from (select id, tags, unnest(range(1, len(tags) + 1)) as p from ev) where tags[p] is not null",
    "p2_steps": _child("steps", _own("tool", "ms", "note")),
    "p2_calls": _child("calls", _own("call_id") | _below("args.q", "args.limit", "error.code", "error.detail")),
    "p2_results": _child("results", _own("ref", "score") | _below("labels.lang")),
    "p2_commits": _child("commits", _own("id", "message")),
    "p2_files": _child("files", _own("path")),
    "p2_hunks": _child("hunks", _own("at", "add", "del")),
}
