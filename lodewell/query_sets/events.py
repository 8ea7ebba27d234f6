"""Logs, sessions and graphs over events, lineitem and orders."""

from pyspark.sql import functions as F

from lodewell.catalog import query
from lodewell.operators import graph as G
from lodewell.operators import logs as L
from lodewell.plans.storage import spread, table

_LINE = "strftime(ts, '%Y-%m-%d %H:%M:%S') || '.' || lpad((date_part('microsecond', ts)::bigint % 1000000 // 1000)::varchar, 3, '0')"


@query("log_lines", f"""
select event_id, 1 as line_number, {_LINE} as timestamp, upper(event_type) as level, 'u' || user_id as source, props as message from events where event_type not in ('view', 'click')
union all select event_id, 1, null, case when regexp_matches(upper(event_type || ' ' || props), 'ERR|FAIL') then 'ERROR' else 'INFO' end, 'unknown', event_type || ' ' || props from events where event_type in ('view', 'click')""")
def _(spark, d):
    e = table(spark, d, "events")
    full = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" ["), F.upper("event_type"), F.lit("] [u"), F.col("user_id").cast("string"), F.lit("] - "), F.col("props"))
    plain = F.concat(F.col("event_type"), F.lit(" "), F.col("props"))
    files = e.select("event_id", F.concat(F.when(F.col("event_type").isin("view", "click"), plain).otherwise(full), F.lit("\n  \n")).alias("content"))
    return L.parse_lines(files, "event_id", "content").select("event_id", "line_number", "timestamp", "level", "source", "message")


@query("protocol_entries", "select conv_id, turn, role from conversations where regexp_matches(lower(text), 'send|recv|tx|rx|packet|frame|cmd|ack|nack|connect|disconnect|publish|subscribe|ble|can|mqtt|dp_|data_point|payload|protocol|0x|frame_id')")
def _(spark, d):
    c = table(spark, d, "conversations")
    return L.protocol_entries(c.withColumn("raw_line", F.col("text")).withColumn("message", F.col("text"))).select("conv_id", "turn", "role")


@query("gap_sessions", """
with l as (select user_id, event_id, ts, lag(ts) over (partition by user_id order by ts, event_id) as b from events),
s as (select *, sum(case when b is not null and ts - b > interval 30 minute then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as session from l)
select user_id, session, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from s group by all""")
def _(spark, d):
    s = L.gap_sessions(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "ts", 1800.0)
    return L.session_totals(s, ["user_id"], "ts")


@query("gap_sessions_one_log", """
with l as (select event_id, ts, lag(ts) over (order by ts, event_id) as b from events),
s as (select *, sum(case when b is not null and ts - b > interval 1 minute then 1 else 0 end) over (order by ts, event_id rows unbounded preceding)::bigint as session from l)
select session, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from s group by all""")
def _(spark, d):
    rows = table(spark, d, "events").withColumn("log", F.lit("all"))
    return L.session_totals(L.gap_sessions(rows, ["log"], ["ts", "event_id"], "ts", 60.0, parts=64), ["log"], "ts").drop("log")


@query("node_edges", """
with e as (select distinct 'p' || l_partkey as f, 's' || l_suppkey as t from lineitem),
x as (select f as id, 'out' as dir from e union all select t, 'in' from e where f <> t)
select id, count_if(dir = 'out')::bigint as n_out, count_if(dir = 'in')::bigint as n_in from x group by id""")
def _(spark, d):
    return G.edge_counts(_edges(spark, d))


@query("node_edge_lists", """
with e as (select distinct 'p' || l_partkey as f, 's' || l_suppkey as t from lineitem),
x as (select f as id, 'calls:' || t || ':out' as e from e union all select t, 'calls:' || f || ':in' from e where f <> t),
n as (select 'p' || p_partkey as id from part union all select 's' || s_suppkey from supplier)
select id, coalesce(string_agg(e, ',' order by e), '') as edges from n left join x using (id) group by id""")
def _(spark, d):
    nodes = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id")).unionByName(table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id")))
    lists = G.node_edges(nodes, _edges(spark, d))
    return lists.select("id", F.array_join(F.array_sort(F.transform("edges", lambda e: F.concat_ws(":", e["type"], e["target"], e["direction"]))), ",").alias("edges"))


def _calls(spark, d):
    return table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("from_node"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("to_node"))


def _edges(spark, d):
    return _calls(spark, d).distinct().withColumn("edge_type", F.lit("calls"))


@query("callers", "select distinct 's' || l_suppkey as id, 'p' || l_partkey as caller from lineitem")
def _(spark, d):
    of = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    return G.callers(_calls(spark, d), of)


@query("callees", "select 'p' || l_partkey as id, count(distinct l_suppkey) as n from lineitem group by 1")
def _(spark, d):
    of = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    return G.callees(_calls(spark, d), of).groupBy("id").agg(F.count("*").alias("n"))


@query("resolved_calls", """
with f as (select distinct s_nationkey as file, (s_suppkey % 7)::varchar as name from supplier)
select c_nationkey as file, c_custkey as caller, (c_custkey % 9)::varchar as callee, case when f.name is not null or c_custkey % 9 = 3 then 'func:' else 'ext:' end || (c_custkey % 9)::varchar as target
from customer left join f on f.file = c_nationkey and f.name = (c_custkey % 9)::varchar""")
def _(spark, d):
    calls = table(spark, d, "customer").select(F.col("c_nationkey").alias("file"), F.col("c_custkey").alias("caller"), (F.col("c_custkey") % 9).cast("string").alias("callee"))
    fs = table(spark, d, "supplier").select(F.col("s_nationkey").alias("file"), (F.col("s_suppkey") % 7).cast("string").alias("name"))
    return G.resolve_calls(calls, fs, builtins=("3",)).select("file", "caller", "callee", "target")


@query("proximity_join", """
with e as (select user_id, event_type, floor(epoch(ts))::bigint as pos, event_id from events),
a as (select user_id, pos, event_id from e where event_type = 'purchase'), b as (select user_id, pos, event_id from e where event_type = 'error')
select a.user_id, a.pos, a.event_id, count(b.event_id) as n from a left join b on a.user_id = b.user_id and abs(a.pos - b.pos) < 86400 group by all""")
def _(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("pos"), F.col("event_id").alias("match"))
    near = G.near(e.where("event_type = 'purchase'").drop("event_type"), e.where("event_type = 'error'").withColumn("match", F.col("match").cast("string")).drop("event_type"), "user_id", 86400)
    return near.select("user_id", "pos", F.col("match").alias("event_id"), F.size("others").cast("long").alias("n"))


_MARKS = "select doc_id, unnest(list_transform(range(1, len(ms) + 1), lambda k: {{'p': (coalesce(list_sum(list_transform(gs[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0))::bigint, 'm': ms[k]}})) as x from (select doc_id, regexp_extract_all(t, '{0}') as ms, string_split_regex(t, '{0}') as gs from t) where len(ms) > 0"


@query("dp_relations", f"""
with t as (select doc_id, replace(replace(text, ' the ', ' DP 7 '), ' of ', ' 0x00FE ') as t from documents),
a as ({_MARKS.format(G.DP_MARK)}), b as ({_MARKS.format(G.CAN_MARK)})
select a.doc_id, a.x.p::int as pos, coalesce(nullif(regexp_extract(a.x.m, '0x([0-9A-Fa-f]+)', 1), ''), nullif(regexp_extract(a.x.m, '([0-9]+)$', 1), ''), 'unknown') as dp_id, count(b.x.p)::int as n
from a left join b on a.doc_id = b.doc_id and abs(a.x.p - b.x.p) < 200 group by all""")
def _(spark, d):
    t = F.replace(F.replace("text", F.lit(" the "), F.lit(" DP 7 ")), F.lit(" of "), F.lit(" 0x00FE "))
    return G.dp_relations(table(spark, d, "documents").select("doc_id", t.alias("t")), "doc_id", "t").select("doc_id", "pos", "dp_id", F.size("related_can_ids").alias("n"))


def _code(spark, d):
    k = F.col("p_partkey").cast("string")
    lines = ("int f_{0}(int a) {{", "  return g_{0}(a) + printf(\"x\");", "}}", "#define M_{0} 1", "struct s_{0} {{ int x; }};", "enum e_{0} {{ A_{0}, B_{0} }};", "int v_{0} = 3;", "int g_{0}(int b) {{ return b; }}")
    text = F.concat_ws("\n", *[F.replace(F.lit(x.replace("{{", "{").replace("}}", "}")), F.lit("{0}"), k) for x in lines])
    return spread(table(spark, d, "part").select("p_partkey"), "p_partkey").select(F.concat(F.lit("cil/ble/p"), k, F.lit(".c")).alias("path"), text.alias("code"))


@query("code_nodes", """
select 'cil/ble/p' || p_partkey || '.c' as file, x.type, x.prefix || p_partkey as name, x.a as line_start, x.b as line_end, x.pre || ':' || x.prefix || p_partkey as id, 'cil/ble' as subsystem, 'BLE' as module
from part, (values ('function', 'f_', 1, 3, 'func'), ('macro', 'M_', 4, 4, 'macro'), ('struct', 's_', 5, 5, 'struct'), ('enum', 'e_', 6, 6, 'enum'), ('variable', 'v_', 7, 7, 'variable'), ('function', 'g_', 8, 8, 'func')) x(type, prefix, a, b, pre)""")
def _(spark, d):
    return G.code_nodes(_code(spark, d), "path", "code").select("file", "type", "name", "line_start", "line_end", "id", "subsystem", "module")


@query("code_edges", """
select 'cil/ble/p' || p_partkey || '.c' as file, replace(x.a, '*', p_partkey::varchar) as from_node, replace(x.b, '*', p_partkey::varchar) as to_node, x.t as edge_type
from part, (values ('func:f_*', 'param:a', 'has_param'), ('func:f_*', 'type:int', 'uses_type'), ('func:f_*', 'func:g_*', 'calls'), ('func:f_*', 'ext:printf', 'calls'), ('func:g_*', 'param:b', 'has_param'), ('func:g_*', 'type:int', 'uses_type'), ('enum:e_*', 'value:A_*', 'has_value'), ('enum:e_*', 'value:B_*', 'has_value')) x(a, b, t)""")
def _(spark, d):
    return G.code_edges(_code(spark, d), "path", "code")


@query("code_blocks", """
select 'cil/ble/p' || p_partkey || '.c:' || x.line || ':' || x.type || ':' || x.prefix || p_partkey as id, x.prefix || p_partkey as name, x.line as line_number
from part, (values ('function', 'f_', 1), ('macro', 'M_', 4), ('struct', 's_', 5), ('enum', 'e_', 6), ('function', 'g_', 8)) x(type, prefix, line)""")
def _(spark, d):
    return G.code_blocks(_code(spark, d), "path", "code").select("id", "name", "line_number")


@query("call_targets", """
select 'p' || l_partkey as id, string_agg(distinct 's' || l_suppkey, ',' order by 's' || l_suppkey) as callees from lineitem group by 1
union all select 's' || l_suppkey, '' from lineitem group by 1""")
def _(spark, d):
    e = _edges(spark, d)
    nodes = e.select(F.col("from_node").alias("id")).union(e.select("to_node")).distinct()
    return G.call_chain(e, nodes).select("id", F.array_join(F.array_sort("callees"), ",").alias("callees"))


@query("hourly_counts", "select date_trunc('hour', ts) as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def _(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
