"""DuckDB SQL of the queries in ``upkeep``, and of those whose SQL is long."""

from ..functions.text import PLAIN_VERBS, PREPOSITION_VERBS, PREPOSITIONS
from .memory import _EDGES, _M, _RUNS, _SCOPE, _STATE
from .problems_sql import EVENTS, TREE
from .retrieval import _WORDS, _bm25, _tokens

NOW = "timestamp '2018-03-01'"
_CITED = "(select lower(e) from (select unnest(source_event_ids) as e from memories) where e is not null)"
_GROUPS = f"select 'new-' || min(id) as nid, {_SCOPE}, subject from m where state = 'active' and subject is not null group by {_SCOPE}, subject"
_SAME = "a.tenant_id = b.tenant_id and a.user_id is not distinct from b.user_id and a.agent_id is not distinct from b.agent_id and a.session_id is not distinct from b.session_id"
_RUN = "r as (select lower(id) as id, * exclude (id) from runs where id is not null qualify row_number() over (partition by lower(id) order by updated_at desc nulls last) = 1)"
_N_WORDS = f"len({_WORDS.format('{0}')})"
_LINES = "coalesce(len(string_split(content, chr(10))), -1)"
_COS = "list_cosine_similarity({0}.embedding::double[], {1}.embedding::double[])"
_OWN = "select session_id, min(source) as agent_id, max(ts) as last, count(*) as n from ev where session_id is not null group by 1"


def _words(c: str) -> str:
    return f"len({_WORDS.format(c)})"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


#: (id, …, subject, relation, object) of the sentences in ``content`` of the rows of ``src``.
_TRIPLES = rf"""
  sen as (select *, unnest(regexp_split_to_array(content, '[.\n;!?]')) as s from src),
  wor as (select * exclude (s), list_filter(string_split(trim(regexp_replace(s, '[\s\p{{Z}}]+', ' ', 'g')), ' '), lambda w: w <> '') as w from sen),
  pos as (select *, unnest(range(2, len(w)))::int as i from wor where len(w) >= 3),
  rel as (select *, lower(w[i]) as a, lower(w[i + 1]) as b from pos),
  kin as (select *, a in {_in(PLAIN_VERBS)} as plain, (a in {_in(PREPOSITION_VERBS)} and b in {_in(PREPOSITIONS)}) or (a = 'married' and b = 'to') as prep from rel),
  tri as (select *, array_to_string(w[1:i - 1], ' ') as subject, case when plain then a else a || '_' || b end as relation, array_to_string(case when plain then w[i + 1:] else w[i + 2:] end, ' ') as object from kin where plain or prep)"""
_FRONT = r"regexp_extract(text, '(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)', 1)"


def _field(k: str) -> str:
    line = f"list_filter(ls, lambda x: trim(regexp_extract(x, '^([^:]+):', 1)) = '{k}')[-1]"
    return rf"""regexp_replace(trim(regexp_extract({line}, '^[^:]+:(.*)$', 1)), '^"+|"+$', '', 'g')"""


_H = "sha1(unhex(replace(id, '-', '')) || encode(concat_ws('|', subject, relation, object)))"
_UUID5 = f"substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"

ORACLE = {
    "triple_extract": f"with {_M}, src as (select id, content from m), {_TRIPLES} select id, subject, relation, object from tri where object <> ''",
    "memory_edges": f"""with {_M}, src as (select id, content from m where state = 'active'), {_TRIPLES}, k as (select *, case when try_cast(id as uuid) is not null then {_H} end as h from tri where object <> '')
select {_UUID5} as id, subject as src, relation, object as dst, id as source_memory_id from k""",
    "note_titles": rf"""with l as (select doc_id, list_filter(regexp_split_to_array({_FRONT}, '\r?\n'), lambda x: regexp_matches(x, '^[^:]+:')) as ls from documents)
select doc_id, {_field('title')} as title, {_field('tags')} as tags from l where len(ls) > 0""",
    "communities": """with recursive e as (select lower(id) as a, lower(trim(parent_id)) as b from episodic where id is not null and trim(parent_id) <> ''), both_ as (select a, b from e union select b, a from e),
  reach as (select a as node, a as x from both_ union select r.node, t.b from reach r join both_ t on r.x = t.a) select node, min(x) as community from reach group by node""",
    "shortest_path": TREE + """, f as (select list_reverse(path) as path from tree where t = 'episodic' and depth > 0 order by depth desc, id limit 1)
select (p - 1)::int as place, path[p] as node from (select path, unnest(range(1, len(path) + 1)) as p from f)""",
    "log_append": f"with {EVENTS} select id, source from ev",
    "ingest_stored": f"""with {EVENTS}, s1 as (select * from e0 where ingested_at < timestamp '2018-01-20' qualify row_number() over (partition by id order by ingested_at) = 1),
  st as (select * from s1 qualify idempotency_key is null or row_number() over (partition by tenant, idempotency_key order by ingested_at, id) = 1)
select id, true as embedded, length(coalesce(payload, '')) as n from ev where id not in (select id from st) and not exists (select 1 from st where st.tenant = ev.tenant and st.idempotency_key = ev.idempotency_key)""",
    "reindex_pending": f"with {EVENTS} select source, count(*) as n, sum({_words('payload')})::bigint as words from ev where id not in {_CITED} group by source",
    "memory_reembed": f"with {_M} select id, length(coalesce(content, '')) as v0, {_words('content')} as v1, length(regexp_replace(coalesce(content, ''), '[^aeiou]', '', 'g')) as v2 from m where state = 'active'",
    "tenant_tags": "select event_id, case when user_id % 3 = 0 then 't' || user_id else 'default' end as tenant_id, case when user_id % 3 = 0 then 's' || event_id end as session_id from events",
    "events_by_ids": f"with {EVENTS} select id, source from ev where tenant = 'default' and id in {_CITED}",
    "tenant_events": f"with {EVENTS} select id, epoch_us(ts) as us from ev where tenant = 'nordwerk'",
    "range_scan": f"with {EVENTS} select id, epoch_us(ts) as us from ev where ts between timestamp '2018-01-10' and timestamp '2018-01-12'",
    "memory_lookup": f"with {_M} select id, content, state, version from m where id = (select min(id) from m)",
    "upkeep_listing": f"with {_M} select id, epoch_us(updated_at) as us from m where state = 'active' and tenant_id = 'default'",
    "fluent_query": f"with {EVENTS} select id, epoch_us(ts) as us from ev where source = 'agent-00007' and event_type = 'message' order by ts desc, id limit 50",
    "hydrated": f"with {_M}, ac as (select id as mid, content from m where state = 'active'), " + _bm25("ac", "mid", "content", "select 1 as query_id, 0 as scope, 'review owner of the project' as query") + " select mid as id, content, round(score, 6) as score from scored join ac on mid = doc_id",
    "tenant_export": f"with {_M} select case when tenant_id = 'nordwerk' and state = 'active' then 'copied' else tenant_id end as tenant_id, state, count(*) as n from m group by 1, 2",
    "tenant_move": f"""with {_M}, {EVENTS} select case when tenant = 'nordwerk' then 'to' else 'from' end as store, 'episodic' as name, tenant as tenant_id, count(*) as n from ev group by all
union all select case when tenant_id = 'nordwerk' then 'to' else 'from' end, 'memories', tenant_id, count(*) from m group by all""",
    "backup_restore": f"with {_M}, {EVENTS} select source as part, count(*) as n from ev group by 1 union all select state, count(*) from m group by 1",
    "backup_counts": f"with {_M}, {EVENTS} select 'episodic' as name, count(*) as n from ev union all select 'memories', count(*) from m",
    "audit_log": f"with {EVENTS} select source as actor, coalesce(event_type, 'none') as action, id as target, epoch_us(ts) as us from ev where tenant = 'default' and ts >= timestamp '2018-01-15'",
    "json_rows": """select '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' as json from nation""",
    "sql_guard": """select * from (values (0, true, 'orders'), (1, true, ''), (2, true, 'x part'), (3, false, ''), (4, false, ''), (5, false, ''), (6, false, ''), (7, false, ''), (8, false, ''), (9, true, 'orders lineitem'), (10, true, ''),
  (11, false, ''), (12, false, ''), (13, false, '')) t(n, passes, tables)""",
    "row_cap": "select o_orderkey, o_custkey from orders order by o_totalprice desc, o_orderkey limit 100",
    "hybrid_state": f"""with {_STATE}, f as (select agent_id, key from cur where value is not null and agent_id is not null and key is not null order by agent_id, key limit 1)
select c.agent_id, c.key, c.version, count(*) as n from cur c join f using (agent_id, key) join episodic e on e.source = c.agent_id where coalesce(e.tenant_id, 'default') = 'default' group by all""",
    "view_life": "select o_orderstatus, count(*) as n from orders group by 1",
    "graph_expanded": f"""with e as (select n_name, {_tokens('n_name')} as a, {_tokens('r_name')} as b, (select count(*) from customer where c_nationkey = n_nationkey)::double as w from nation join region on n_regionkey = r_regionkey)
select r_regionkey as query_id, n_name as id, w as score from e join (select r_regionkey, {_tokens("'nations of the ' || r_name")} as q from region) on list_has_any(a, q) or list_has_any(b, q) where w > 0""",
    "rerank_pool": """select doc_id, round(coalesce(case when length(text) > 0 then 12.0::double / length(text) end * (1.0 + 0.1::double * pow(0.5::double, greatest(epoch(timestamp '2022-01-01') - floor(epoch(created_at)), 0) / 86400.0 / 30.0)), 0.25), 9) as score from documents""",
    "bm25_all": "with " + _bm25("documents", "doc_id", "text", "select doc_id as query_id, 0 as scope, text as query from documents where doc_id % 50 = 0 and text is not null")
    + " select query_id, doc_id, round(score, 6) as score, (row_number() over (partition by query_id order by round(score, 6) desc, doc_id))::int as rank from scored qualify rank <= 10",
    "vector_upsert": "select case when vec_id % 2 = 0 then label + 1000 else label end as label, count(*) as n from embeddings group by 1 union all select -1, count(*) from embeddings having count(*) > 0",
    "vector_entries": "select vec_id as id, label from embeddings where vec_id % 3 <> 0 and label < 10 order by vec_id limit 40 offset 20",
    "modality_search": f"""with q as (select embedding from embeddings order by vec_id limit 1), s as (select vec_id as id, case when label % 2 = 0 then 'text' else 'image' end as modality, {_COS.format('e', 'q')} as score from embeddings e, q),
  x as (select modality as asked, id, score from s union all select 'any', id, score from s)
select asked, id, round(score, 6) as score from x qualify row_number() over (partition by asked order by score desc, id) <= 10""",
    "review_adds": f"with {_M}, g as ({_GROUPS}) select nid as id, 'Conflict' as outcome, 'active' as state, 1::bigint as version, null::varchar as supersedes from g",
    "applied_adds": f"""with {_M}, g as ({_GROUPS}), c as (select *, state = 'active' and subject is not null as shut from m)
select id, case when shut then 'superseded' else state end as state, version, case when shut then epoch_us({NOW}) else epoch_us(valid_to) end as to_us from c union all select nid, 'active', 1, null from g""",
    "add_merged": f"""with e as (select *, printf('%08d', vec_id) as id, vec_id % 10 / 10.0::double as imp from embeddings),
  near as (select a.id as nid, b.id as oid, {_COS.format('a', 'b')} as s from e a join e b on a.label = b.label and a.vec_id % 2 = 1 and b.vec_id % 2 = 0 qualify row_number() over (partition by a.id order by s desc, b.id) = 1),
  p as (select * from near where s >= 0.3 qualify row_number() over (partition by oid order by s desc, nid) = 1)
select o.id, 'Closed' as outcome, 's' || o.vec_id as subject, round(o.imp, 6) as importance, 'e' || o.vec_id % 3 as sources, null::varchar as supersedes from e o join p on p.oid = o.id
union all select n.id, 'Merged', 's' || o.vec_id, round(greatest(n.imp, o.imp), 6), case when n.vec_id % 3 = o.vec_id % 3 then 'e' || n.vec_id % 3 else 'e' || least(n.vec_id % 3, o.vec_id % 3) || ' e' || greatest(n.vec_id % 3, o.vec_id % 3) end, o.id from p join e n on n.id = nid join e o on o.id = oid
union all select n.id, 'Inserted', null, round(n.imp, 6), 'e' || n.vec_id % 3, null from e n where n.vec_id % 2 = 1 and n.id not in (select nid from p)""",
    "consolidated_similar": f"""with {_M}, c as (select *, min(id) over w as lead from m where state = 'active' and subject is not null window w as (partition by {_SCOPE}, subject) qualify count(*) over w > 1)
select id, 'expired' as state, round(importance, 6) as importance, {_LINES} as lines, array_to_string(list_sort(coalesce(source_event_ids, [])), ' ') as sources from c
union all select 'sum-' || lead, 'active', round(max(importance), 6), (1 + sum(greatest({_LINES}, 1)))::int, array_to_string(list_sort(list_distinct(flatten(list(coalesce(source_event_ids, []))))), ' ') from c group by lead""",
    "resolved": f"""with {_M}, c as (select * from m where state = 'active' and subject is not null and tenant_id = 'default' qualify count(*) over (partition by {_SCOPE}, subject) > 1), b as (select * from c order by id limit 1)
select a.id, 'superseded' as state, b.id as supersedes from c a join b on {_SAME} and a.subject = b.subject where a.id <> b.id""",
    "subject_history": f"with {_M}, b as (select * from m where subject is not null order by id limit 1) select a.id, a.state, a.content from m a join b on {_SAME} and a.subject = b.subject",
    "touched": f"""with {_M}, t as (select id, state, case when regexp_matches(id, '[a-f]$') and state = 'active' then {NOW} else updated_at end as u, state = 'active' and id in (select supersedes from m where supersedes is not null) as hit from m)
select id, case when hit then 'superseded' else state end as state, epoch_us(case when hit then {NOW} else u end) as us from t""",
    "template_rows": """with t as (select n_nationkey, n_name, case n_nationkey % 4 when 0 then n_name || ': x' when 1 then n_name || case when n_regionkey > 1 then ' — of a region' else '' end
  when 2 then case when n_regionkey <> 3 then 'Decision on ' || n_name || ': yes' end else 'visit ' || n_name end as content from nation)
select n_nationkey, content, case when content is not null then case when n_nationkey % 4 = 3 then 'visit ' || n_name else n_name end end as subject, case when content is not null then case when n_nationkey % 4 = 3 then 'procedural' else 'semantic' end end as mem_type from t""",
    "distilled": f"with {EVENTS} select session_id || '-0' as id, min(tenant) as tenant_id, 'session ' || lower(session_id) as subject, least(count(*), 200) || ' events' as content, 'Inserted' as outcome from ev where session_id is not null group by session_id",
    "grant_life": f"with {_M} select distinct tenant_id, agent_id as grantor_user, user_id as grantee_user from m where agent_id is not null and user_id is not null and agent_id <> user_id and agent_id <> 'agent-00007' and tenant_id = 'default'",
    "edges_added": f"with {_EDGES} select dst, count(*) as n, round(sum(weight), 6) as weight from ed group by dst",
    "graph_on_add": f"""with n as (select n_name, n_nationkey % 2 = 0 as even from nation), e as (
  select n_name as src, 'likes' as relation, 'rain' as dst, case when even then 'superseded' else 'active' end as state from n
  union all select 'It', 'owns', 'hills', case when even then 'superseded' else 'active' end from n union all select n_name, 'hates', 'rain', 'active' from n where even)
select *, count(*) as n, max(case when state = 'superseded' then epoch_us({NOW}) end) as to_us from e group by src, relation, dst, state""",
    "state_delete": f"with {_STATE} select agent_id, key, 0::bigint as version, true as deleted from cur where agent_id = 'agent-00007' and key is not null",
    "state_list": f"with {_STATE} select agent_id, key from cur",
    "state_expired": f"with {_STATE} select agent_id, key, true as deleted from cur where changed_at + interval 10 day <= timestamp '2018-01-20'",
    "replay_once": "select concat_ws('|', agent_id, key) as call, feed_offset, value from state_changes where key is not null qualify row_number() over (partition by concat_ws('|', agent_id, key) order by feed_offset) = 1",
    "runs_created": f"""with {_RUN} select id, agent_id, epoch_us(created_at) as us from r where status = 'pending' and coalesce(tenant_id, 'default') = 'default'
union all select distinct 'run-' || agent_id, agent_id, epoch_us({NOW}) from r where agent_id is not null""",
    "runs_patched": f"""with {_RUN} select id, case status when 'pending' then 'running' when 'running' then 'succeeded' else status end as status, case when status = 'running' then '"ok"' else result end as result,
  epoch_us(case when status = 'pending' then coalesce(started_at, {NOW}) else started_at end) as start_us, epoch_us(case when status = 'running' then {NOW} else ended_at end) as end_us from r""",
    "run_steps": f"""with {EVENTS}, t as (select trace_id as run from ev where trace_id is not null group by 1 order by count(*) desc, 1 limit 1)
select (row_number() over (order by ts, id))::int as step, id, event_type from ev, t where session_id = run or trace_id = run""",
    "approvals": f"with {_RUN} select id, case when status = 'waiting_approval' then case when regexp_matches(id, '[0-7]$') then 'approved' else 'rejected' end when status = 'pending' then case when regexp_matches(id, '[0-7]$') then 'approved' else 'rejected' end else status end as status from r",
    "session_life": f"with {EVENTS}, o as ({_OWN}) select session_id, case when last < timestamp '2018-01-15' then n || ' events' end as summary, case when last < timestamp '2018-01-15' then epoch_us({NOW}) end as end_us from o where agent_id = 'agent-00007'",
    "recalled_session": f"with {EVENTS}, t as (select session_id as s from ev where session_id is not null group by 1 order by count(*) desc, 1 limit 1) select id, epoch_us(ts) as us from ev, t where session_id = s",
    "change_stream": f"with {_M}, g as ({_GROUPS}) select nid as id, 'Superseded' as outcome from g where tenant_id = 'default' union all select id, 'Closed' from m where state = 'active' and subject is not null and tenant_id = 'default'",
    "stream_resolved_rows": f"""with {_RUNS}, x as (select w1.o_custkey, w1.run, row_number() over (partition by w1.o_custkey, w1.run order by o_orderdate, o_orderkey) as pos from w1)
select x.o_custkey::varchar as key, first_seq as o_orderkey, content, case when pos > 1 then 'Confirmed' when x.run = 1 then 'Inserted' else 'Superseded' end as outcome, pos as version, case when pos = 1 then supersedes end as supersedes from x join v on v.o_custkey = x.o_custkey and v.run = x.run""",
    "stream_first": "select distinct concat_ws('|', user_id, event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S')) as k from events",
    "upkeep_pass": f"""with {_M}, {EVENTS}, {_STATE}, kept as (select * from ev where source = 'agent-00000' or ts >= {NOW} - case when source = 'agent-00007' then interval 40 day else interval 50 day end)
select 'events' as what, (select count(*) from ev) - (select count(*) from kept) as n union all select 'state', count(*) from cur where changed_at + interval 10 day <= {NOW}
union all select 'memories', count(*) from m where state = 'active' and importance * pow(0.5::double, date_diff('day', valid_from, {NOW}) / 10.0) < 0.05 union all select 'vectors', count(*) from kept""",
    "triple_texts": "select o_orderkey, 0 as at, 'c' || o_custkey as subject, 'placed_by' as relation, 'o' || o_orderkey as object from orders union all select o_orderkey, 1, 'a', 'b_c', o_orderstatus from orders",
    "fact_texts": """select n_nationkey, case when n_nationkey % 5 > 0 then n_name end as subject, case when n_nationkey % 5 > 0 then 'is in ' || n_regionkey end as content from nation union all select n_nationkey, null, 'x' from nation where n_nationkey % 5 > 0""",
    "cache_keys": "select n_nationkey, 'default' || chr(31) || n_regionkey || chr(31) || 'what about ' || lower(n_name) || '?' as key from nation",
    "file_names": f"""with {_M} select id, coalesce(subject, 'memory-' || split_part(id, '-', 1)) as title, 'a-' || regexp_replace(coalesce(subject, ''), '[/\\\\:*?"<>|#^\\[\\]]', '-', 'g') || '--' as file from m""",
    "time_parse": """select o_orderkey, epoch_us(case o_orderkey % 5 when 0 then o_orderdate::date + time '10:11:12' when 1 then o_orderdate::date + time '10:11:12.5' when 2 then o_orderdate::date + time '08:11:12' when 3 then o_orderdate::date + time '10:11:12' end) as us from orders""",
    "fingerprints": f"""with {_M} select id, tenant_id || chr(31) || coalesce(user_id, '') || chr(31) || coalesce(agent_id, '') || chr(31) || coalesce(session_id, '') as scope, 'search_query: ' || content as asked, 'passage: ' || content as stored, sha256(concat_ws(chr(30), content, id)) as digest from m""",
    "fnv_hashes": """select n_nationkey, lpad(lower(to_hex(list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(string_split(n_name, ''), lambda c: unicode(c)::hugeint)),
  lambda h, b: (xor(h, b) * 1099511628211::hugeint) % 18446744073709551616::hugeint)::ubigint)), 16, '0') as h from nation""",
}
