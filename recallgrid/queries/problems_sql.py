"""DuckDB SQL of the problem queries. Written from the definitions, without the operators' methods."""

SUBJECT = r"lower(trim(regexp_replace({0}, '\s+', ' ', 'g')))"

EVENTS = """
  e0 as (select lower(id) as id, coalesce(tenant_id, 'default') as tenant, * exclude (id, tenant_id) from episodic where id is not null),
  e1 as (select * from e0 qualify row_number() over (partition by id order by ingested_at nulls last) = 1),
  ev as (select * from e1 qualify idempotency_key is null
         or row_number() over (partition by tenant, idempotency_key order by ingested_at nulls last, id) = 1)
"""

MEMORIES = """
  m0 as (select lower(id) as id, coalesce(tenant_id, 'default') as tenant, * exclude (id, tenant_id) from memories where id is not null),
  mm as (select * from m0 qualify row_number() over (partition by id order by version desc nulls last, updated_at desc nulls last) = 1)
"""

P1 = f"""with {EVENTS}, {MEMORIES},
  es as (select id as event_id, tenant, source, ts, {SUBJECT.format("case when json_valid(payload) then json_extract_string(payload, '$.subject') end")} as subject from ev),
  ms as (select id as memory_id, tenant, agent_id, {SUBJECT.format('subject')} as subject, valid_from, valid_to, created_at from mm)
select event_id, memory_id from es join ms on es.tenant = ms.tenant and es.source = ms.agent_id and es.subject = ms.subject and es.subject <> ''
  and valid_from <= ts and (valid_to is null or ts < valid_to) and created_at <= ts
qualify row_number() over (partition by event_id order by valid_from desc, created_at desc, memory_id desc) = 1"""

P3 = f"""with {MEMORIES},
  iv as (select tenant as tenant_id, agent_id, {SUBJECT.format('subject')} as subject, epoch_us(valid_from) as s,
         coalesce(epoch_us(valid_to), 9223372036854775807) as e from mm
         where agent_id is not null and subject is not null and valid_from is not null and (valid_to is null or valid_to > valid_from)),
  p as (select *, max(e) over (partition by tenant_id, agent_id, subject order by s, e rows between unbounded preceding and 1 preceding) as pe from iv),
  q as (select *, sum((pe is null or s > pe)::int) over (partition by tenant_id, agent_id, subject order by s, e rows unbounded preceding) as g from p),
  r as (select tenant_id, agent_id, subject, g, min(s) as s, max(e) as e from q group by all),
  n as (select *, lead(s) over (partition by tenant_id, agent_id, subject order by s) as nx from r)
select tenant_id, agent_id, subject, 'period' as kind, s as start_us, case when e = 9223372036854775807 then -1 else e end as end_us from n
union all
select tenant_id, agent_id, subject, 'gap', e, nx from n where nx is not null"""


def _p4(cols: str) -> str:
    return f"""with c as (select * from state_changes
  qualify row_number() over (partition by agent_id, key order by changed_at desc nulls last, version desc nulls last, coalesce(deleted, false) desc, feed_offset) = 1)
select {cols} from c where not coalesce(deleted, false)"""


def _p5(duration: str) -> str:
    return f"""with {EVENTS},
  x as (select tenant, source, epoch_us(ts) as us, lower(trim(event_type)) as ty from ev where source is not null and ts is not null),
  p as (select *, lag(us) over (partition by tenant, source order by us) as pu from x),
  q as (select *, sum((pu is null or us - pu > 1800000000)::int) over (partition by tenant, source order by us rows unbounded preceding) as g from p)
select tenant as tenant_id, source, min(us) as start_us, max(us) as end_us, {duration} count(*) as n_events, count(distinct ty) as n_types from q group by tenant, source, g"""


TREE = f"""with recursive {EVENTS},
  keyed as (select id, tenant, idempotency_key as k, ingested_at from e1 where idempotency_key is not null),
  alias as (select id, first_value(id) over (partition by tenant, k order by ingested_at nulls last, id) as canon from keyed),
  r0 as (select lower(id) as id, parent_run_id, updated_at from runs where id is not null
         qualify row_number() over (partition by lower(id) order by updated_at desc nulls last) = 1),
  n as (select 'episodic' as t, id, nullif(lower(trim(parent_id)), '') as named from ev
        union all select 'runs', id, nullif(lower(trim(parent_run_id)), '') from r0),
  ref as (select t, id as ref, id as canon from n union select 'episodic', id, canon from alias where id <> canon),
  l as (select n.t, n.id, n.named, ref.canon as parent from n left join ref on ref.t = n.t and ref.ref = n.named),
  tree as (select t, id, named, id as root, 0::bigint as depth, [id] as path from l where parent is null
           union all select l.t, l.id, l.named, tree.root, tree.depth + 1, list_append(tree.path, l.id) from l join tree on l.t = tree.t and l.parent = tree.id)
"""

P7 = TREE + """select l.t as table_name, l.id as node_id, coalesce(root, '') as root_id, coalesce(depth, -1) as depth
from l left join tree on tree.t = l.t and tree.id = l.id where l.named is not null"""
P7_PATHS = TREE + """select l.t as table_name, l.id as node_id, coalesce(root, '') as root_id, coalesce(depth, -1) as depth, array_to_string(path, '/') as path
from l left join tree on tree.t = l.t and tree.id = l.id"""
P7_BELOW = TREE + """select t as table_name, a as ancestor_id, id as node_id, depth - i as distance
from (select t, id, depth, unnest(path[1:depth]) as a, generate_subscripts(path[1:depth], 1) - 1 as i from tree where depth > 0)"""

ORACLE = {
    "p1_found": P1,
    "p2_tags": f"""with {EVENTS} select id as event_id, 'tags/' || (p - 1) as node_path, tags[p] as tag from (select id, tags, unnest(range(1, len(tags) + 1)) as p from ev) where tags[p] is not null""",
    "p3_found": P3,
    "p4_found": _p4("agent_id, key, version, epoch_us(changed_at) as changed_us"),
    "p4_state": _p4("agent_id, key, value, version, epoch_us(changed_at) as changed_us"),
    "p5_found": _p5(""),
    "p5_sessions": _p5("max(us) - min(us) as duration_us,"),
    "p7_found": P7,
    "p7_paths": P7_PATHS,
    "p7_descendants": P7_BELOW,
}
