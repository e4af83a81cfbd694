"""General SELECTs over events and the star schema: joins, aggregates, windows, sets, event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..entities import micros
from ..operators.joins import range_join
from ..plans.sqlgate import run_sql, tenant_session
from ..session import load
from ..streaming.flows import session_counts, window_counts

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _views(spark: SparkSession, d: str) -> None:
    for t in TABLES:
        load(spark, d, t).createOrReplaceTempView(t)


def _sql(text: str):
    """A guarded query over the tables as views."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        _views(spark, d)
        return run_sql(spark, text, max_rows=None)

    return query


def tenant_counts(spark: SparkSession, d: str) -> DataFrame:
    """One tenant's own session: its event kinds."""
    s = tenant_session(spark, {"episodic": load(spark, d, "episodic")}, "default")
    return run_sql(s, "select lower(trim(event_type)) as kind, count(*) as n from episodic group by all", max_rows=None)


def tumbling(spark: SparkSession, d: str) -> DataFrame:
    w = window_counts(load(spark, d, "events"), "ts", ["event_type"], "1 hour", value="value")
    return w.select(micros("window_start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding(spark: SparkSession, d: str) -> DataFrame:
    w = window_counts(load(spark, d, "events"), "ts", ["event_type"], "1 hour", "15 minutes")
    return w.select(micros("window_start").alias("start_us"), "event_type", "n")


def session_windows(spark: SparkSession, d: str) -> DataFrame:
    w = session_counts(load(spark, d, "events"), "ts", ["user_id"], "30 minutes")
    return w.select("user_id", micros("window_start").alias("start_us"), micros("window_end").alias("end_us"), "n")


def range_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Events inside the hour after a user's error, by buckets instead of a nested loop."""
    e = load(spark, d, "events").withColumn("us", micros("ts"))
    hour = 3_600_000_000
    err = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("us").alias("a"), (F.col("us") + hour).alias("b"))
    return range_join(e.select("event_id", "user_id", "us"), err, ["user_id"], "us", "a", "b", hour).select("error_id", "event_id")


def top_per_group(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("o_orderpriority", "o_orderkey", "rank")


#: name -> (Spark SQL, DuckDB SQL where it differs)
SQL: dict[str, tuple[str, str | None]] = {
    "dashboard_hourly": (
        "select unix_micros(cast(date_trunc('HOUR', ts) as timestamp)) as hour_us, event_type, count(*) as n, count(distinct user_id) as users from events group by date_trunc('HOUR', ts), event_type",
        "select epoch_us(date_trunc('hour', ts)) as hour_us, event_type, count(*) as n, count(distinct user_id) as users from events group by date_trunc('hour', ts), event_type",
    ),
    "features_filtered": (
        """select user_id, count(*) filter (where event_type = 'error') as errors, round(avg(value) filter (where event_type = 'purchase'), 6) as avg_purchase,
           count(distinct event_type) filter (where value > 10) as kinds, bool_or(event_type = 'signup') as signed_up, unix_micros(cast(max(ts) as timestamp)) as last_us from events group by user_id""",
        """select user_id, count(*) filter (where event_type = 'error') as errors, round(avg(value) filter (where event_type = 'purchase'), 6) as avg_purchase,
           count(distinct event_type) filter (where value > 10) as kinds, bool_or(event_type = 'signup') as signed_up, epoch_us(max(ts)) as last_us from events group by user_id""",
    ),
    "rate_per_hour": (
        "select event_type, round(count(*) / greatest((unix_micros(cast(max(ts) as timestamp)) - unix_micros(cast(min(ts) as timestamp))) / 3600e6, 1), 6) as per_hour from events group by event_type",
        "select event_type, round(count(*) / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600e6::double, 1), 6) as per_hour from events group by event_type",
    ),
    "json_props": (
        "select cast(get_json_object(props, '$.k') as bigint) as k, count(*) as n from events group by 1",
        "select cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n from events group by 1",
    ),
    "case_projection": ("select event_id, case when value is null then 'none' when value < 10 then 'low' when value < 100 then 'mid' else 'high' end as band from events where event_type in ('view', 'purchase')", None),
    "join_inner": ("select n_name, count(*) as orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name", None),
    "join_left": ("select c_custkey, count(o_orderkey) as orders from customer left join orders on c_custkey = o_custkey group by c_custkey", None),
    "join_full": ("select coalesce(cn, sn) as nation, customers, suppliers from (select c_nationkey as cn, count(*) as customers from customer where c_acctbal > 9000 group by 1) a full join (select s_nationkey as sn, count(*) as suppliers from supplier group by 1) b on cn = sn", None),
    "join_semi": ("select p_partkey from part where exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 49)", None),
    "join_anti": ("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')", None),
    "in_subquery": ("select s_suppkey from supplier where s_nationkey in (select n_nationkey from nation join region on n_regionkey = r_regionkey where r_name like 'A%')", None),
    "correlated": ("select o_orderkey from orders o where o_totalprice > 1.2 * (select avg(i.o_totalprice) from orders i where i.o_custkey = o.o_custkey)", None),
    "theta_join": ("select r_name, count(*) as n from region join nation on n_nationkey between r_regionkey * 4 and r_regionkey * 4 + 6 group by r_name", None),
    "lateral_top": (
        "select r_name, n_name from region, lateral (select n_name from nation where n_regionkey = r_regionkey order by n_name limit 2)",
        "select r_name, n_name from region, lateral (select n_name from nation where n_regionkey = r_regionkey order by n_name limit 2) t",
    ),
    "pricing_summary": (
        """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as discount, count(*) as n
           from lineitem where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus""",
        None,
    ),
    "cube": ("select o_orderstatus, o_orderpriority, count(*) as n, grouping(o_orderstatus) + grouping(o_orderpriority) as level from orders group by cube (o_orderstatus, o_orderpriority)", None),
    "rollup": ("select r_name, n_name, count(*) as customers from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)", None),
    "grouping_sets": ("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as qty from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())", None),
    "distinct_aggs": ("select o_orderstatus, count(distinct o_custkey) as customers, count(distinct o_orderpriority) as priorities, sum(distinct cast(o_totalprice as bigint)) as total from orders group by o_orderstatus having count(*) > 10", "select o_orderstatus, count(distinct o_custkey) as customers, count(distinct o_orderpriority) as priorities, sum(distinct cast(floor(o_totalprice) as bigint))::bigint as total from orders group by o_orderstatus having count(*) > 10"),
    "ordered_set": (
        "select event_type, round(percentile_cont(0.5) within group (order by value), 6) as median, max_by(event_id, struct(value, event_id)) as top, listagg(distinct cast(user_id % 3 as string), ',') within group (order by cast(user_id % 3 as string)) as thirds from events group by event_type",
        "select event_type, round(quantile_cont(value, 0.5), 6) as median, arg_max(event_id, (value, event_id)) as top, string_agg(distinct cast(user_id % 3 as varchar), ',' order by cast(user_id % 3 as varchar)) as thirds from events group by event_type",
    ),
    "window_rank": (
        """select o_orderkey, rank() over w as r, dense_rank() over w as dr, ntile(4) over (partition by o_custkey order by o_orderdate, o_orderkey) as quarter, round(percent_rank() over w, 6) as pr, round(cume_dist() over w, 6) as cd
           from orders window w as (partition by o_custkey order by o_orderpriority)""",
        """select o_orderkey, (rank() over w)::int as r, (dense_rank() over w)::int as dr, (ntile(4) over (partition by o_custkey order by o_orderdate, o_orderkey))::int as quarter, round(percent_rank() over w, 6) as pr, round(cume_dist() over w, 6) as cd
           from orders window w as (partition by o_custkey order by o_orderpriority)""",
    ),
    "window_frames": (
        """select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), 2) as last3,
           lag(o_orderkey) over w as before, lead(o_orderkey, 2) over w as later, first_value(o_orderkey) over w as first, nth_value(o_orderkey, 2) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following) as second
           from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""",
        None,
    ),
    "qualify_rewrite": (
        "select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r = 1",
        "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1",
    ),
    "set_union": ("select c_nationkey as k from customer union select s_nationkey from supplier", None),
    "set_intersect": ("select c_nationkey as k from customer where c_acctbal > 9900 intersect select s_nationkey from supplier", None),
    "set_except": ("select n_nationkey as k from nation except select s_nationkey from supplier where s_acctbal > 5000", None),
    "recursive_cte": ("with recursive t(n, s) as (select 1, 1 union all select n + 1, s + n + 1 from t where n < 40) select n, s from t", None),
    "cte_reuse": ("with t as (select o_custkey, sum(o_totalprice) as total from orders group by o_custkey) select count(*) as above from t where total > (select avg(total) from t)", None),
    "order_nulls": ("select o_orderkey, o_orderdate from orders order by o_totalprice desc nulls last, o_orderkey limit 25 offset 5", "select o_orderkey, o_orderdate from orders order by o_totalprice desc nulls last, o_orderkey limit 25 offset 5"),
    "string_functions": (
        "select p_partkey, upper(substring(p_name, 1, 5)) as head, length(p_name) as n, replace(p_brand, '#', '-') as brand, p_type like '%BRASS' as brass, concat_ws('/', p_brand, p_type) as path from part",
        None,
    ),
    "date_functions": (
        "select o_orderkey, year(o_orderdate) as y, quarter(o_orderdate) as q, datediff(timestamp '1999-01-01', o_orderdate) as days from orders",
        "select o_orderkey, year(o_orderdate)::int as y, quarter(o_orderdate)::int as q, date_diff('day', o_orderdate, timestamp '1999-01-01')::int as days from orders",
    ),
    "list_functions": (
        "select o_custkey, array_join(transform(slice(sort_array(collect_list(o_orderkey)), 1, 3), x -> cast(x as string)), ',') as firsts, size(array_distinct(collect_list(o_orderpriority))) as kinds from orders group by o_custkey",
        "select o_custkey, array_to_string(list_sort(list(o_orderkey))[1:3], ',') as firsts, len(list_distinct(list(o_orderpriority)))::int as kinds from orders group by o_custkey",
    ),
    "pivot": (
        "select * from (select o_orderpriority, o_orderstatus, o_orderkey from orders) pivot (count(o_orderkey) for o_orderstatus in ('O' as open, 'F' as filled, 'P' as partial))",
        "select o_orderpriority, nullif(count(*) filter (where o_orderstatus = 'O'), 0) as open, nullif(count(*) filter (where o_orderstatus = 'F'), 0) as filled, nullif(count(*) filter (where o_orderstatus = 'P'), 0) as partial from orders group by 1",
    ),
}

QUERIES = {
    **{k: _sql(a) for k, (a, _) in SQL.items()},
    **{f.__name__: f for f in (tenant_counts, tumbling, sliding, session_windows, range_lookup, top_per_group)},
}

ORACLE = {
    **{k: b or a for k, (a, b) in SQL.items()},
    "tenant_counts": "select lower(trim(event_type)) as kind, count(*) as n from episodic where coalesce(tenant_id, 'default') = 'default' group by 1",
    "tumbling": "select epoch_us(time_bucket(interval 1 hour, ts)) as start_us, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "sliding": """select epoch_us(time_bucket(interval 15 minute, ts)) - i * 900000000 as start_us, event_type, count(*) as n from events, range(4) t(i) group by 1, 2""",
    "session_windows": """with p as (select user_id, epoch_us(ts) as us, lag(epoch_us(ts)) over (partition by user_id order by ts) as pu from events),
  q as (select *, sum((pu is null or us - pu >= 1800000000)::int) over (partition by user_id order by us rows unbounded preceding) as g from p)
select user_id, min(us) as start_us, max(us) + 1800000000 as end_us, count(*) as n from q group by user_id, g""",
    "range_lookup": "select r.event_id as error_id, e.event_id from events r join events e on r.user_id = e.user_id and r.event_type = 'error' and e.ts >= r.ts and e.ts < r.ts + interval 1 hour",
    "top_per_group": "select o_orderpriority, o_orderkey, (row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey))::int as rank from orders qualify rank <= 5",
}
