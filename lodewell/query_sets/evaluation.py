"""Evaluation and registry queries over the relational tables."""

from pyspark.sql import functions as F

from lodewell.catalog import query
from lodewell.operators import evaluate as E
from lodewell.operators import rank as R
from lodewell.operators import registry as G
from lodewell.plans.storage import table

_DENSE = """
v as (select vec_id, label, embedding::double[] as e from embeddings), top as (
  select a.vec_id as q, b.vec_id as i, row_number() over (partition by a.vec_id order by round(list_dot_product(a.e, b.e), 9) desc, b.vec_id) as r from v a join v b on a.vec_id % 100 = 0 qualify r <= 10),
lab as (select a.vec_id as q, count(*) as want from v a join v b on a.label = b.label where a.vec_id % 100 = 0 group by 1),
hit as (select q, r from top join v a on a.vec_id = q join v b on b.vec_id = i where a.label = b.label),
k as (select unnest([1, 3, 5, 10]) as k)"""


@query("recall_metrics", f"""
with {_DENSE[1:]} select lab.q::varchar as question_id, k.k, count(hit.r)::int as hits, round(count(hit.r) / any_value(want), 6) as hit_rate, round(coalesce(1.0 / min(hit.r), 0), 6) as mrr
from lab cross join k left join hit on hit.q = lab.q and hit.r <= k.k group by lab.q, k.k""")
def _(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label")
    asked = v.where(F.col("item_id") % 100 == 0).select(F.col("item_id").alias("query_id"), "vector", "label")
    hits = R.dense(v, asked, 10).join(v.select("item_id", "label"), "item_id").join(asked.select("query_id", F.col("label").alias("own")), "query_id")
    wants = asked.select("query_id", "label").join(v.groupBy("label").agg(F.count("*").alias("want")), "label")
    name = F.col("query_id").cast("string").alias("question_id")
    m = E.hit_metrics(hits.where(F.col("label") == F.col("own")).select(name, "rank"), wants.select(name, "want"))
    return m.select("question_id", "k", "hits", F.round("hit_rate", 6).alias("hit_rate"), F.round("mrr", 6).alias("mrr"))


@query("score_histogram", "select c_nationkey, least(5, greatest(1, floor((c_acctbal + 1000) / 11000 * 5)::int + 1)) as bin, count(*) as n from customer group by all")
def _(spark, d):
    return E.score_histogram(table(spark, d, "customer").withColumn("score", (F.col("c_acctbal") + 1000) / 11000), ["c_nationkey"])


_EV = "ev as (select o_orderpriority as config_id, o_custkey % 2 as set_id, (o_custkey % 50)::varchar as question, (o_orderkey % 11) / 10.0 as hit_rate, 1.0 / (1 + o_orderkey % 4) as mrr, (o_orderkey % 11)::int as hits from orders)"


def _evaluations(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderpriority").alias("config_id"), (F.col("o_custkey") % 2).alias("set_id"), (F.col("o_custkey") % 50).cast("string").alias("question"), ((F.col("o_orderkey") % 11) / 10.0).alias("hit_rate"), (1.0 / (1 + F.col("o_orderkey") % 4)).alias("mrr"), (F.col("o_orderkey") % 11).cast("int").alias("hits"))


@query("aggregate_metrics", f"with {_EV} select config_id, round(avg(hit_rate), 6) as avg_hit_rate, round(avg(mrr), 6) as avg_mrr, count(*) as n, sum(hits)::bigint as total_hits from ev group by config_id")
def _(spark, d):
    return E.aggregate_metrics(_evaluations(spark, d), ["config_id"]).select("config_id", F.round("avg_hit_rate", 6).alias("avg_hit_rate"), F.round("avg_mrr", 6).alias("avg_mrr"), "n", "total_hits")


@query("compare_configs", f"""
with {_EV}, c as (select config_id, avg(hit_rate) as h, avg(mrr) as m, count(*) as n from ev group by config_id),
a as (select distinct o_orderpriority as config_id from orders), r as (select config_id, coalesce(h, 0) as h, coalesce(m, 0) as m, coalesce(n, 0) as n from a left join c using (config_id))
select config_id, round(h, 6) as avg_hit_rate, round(m, 6) as avg_mrr, n, config_id = (select config_id from r order by h desc, config_id limit 1) as is_best from r""")
def _(spark, d):
    ev = _evaluations(spark, d)
    c = E.compare_configs(ev.select("config_id").distinct(), ev)
    return c.select("config_id", F.round("avg_hit_rate", 6).alias("avg_hit_rate"), F.round("avg_mrr", 6).alias("avg_mrr"), "n", "is_best")


@query("document_recall", f"with {_EV}, qs as (select distinct (c_custkey % 2) as set_id, (c_custkey % 50)::varchar as question, c_mktsegment as source from customer) select source, round(avg(hit_rate), 6) as recall from ev join qs using (set_id, question) group by source")
def _(spark, d):
    qs = table(spark, d, "customer").select((F.col("c_custkey") % 2).alias("set_id"), (F.col("c_custkey") % 50).cast("string").alias("question"), F.col("c_mktsegment").alias("source"))
    return E.document_recall(_evaluations(spark, d), qs).select("source", F.round("recall", 6).alias("recall"))


@query("keyword_coverage", r"""
with k as (select distinct item_id as query_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda t: length(t) >= 6)) as keyword from benchmark),
h as (select item_id as query_id, text from benchmark union all select doc_id as query_id, text from documents where doc_id in (select item_id + 1 from benchmark)),
f as (select query_id, keyword, coalesce(bool_or(contains(lower(h.text), keyword)), false) as found from k left join h using (query_id) group by all)
select query_id, count_if(found)::bigint as matched, count(*) as total, round(count_if(found) / count(*), 6) as coverage, count_if(found) / count(*) >= 0.4 as satisfactory from f group by query_id""")
def _(spark, d):
    b = table(spark, d, "benchmark")
    k = b.select(F.col("item_id").alias("query_id"), F.explode(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)), lambda t: F.length(t) >= 6)).alias("keyword"))
    docs = table(spark, d, "documents").join(b.select((F.col("item_id") + 1).alias("doc_id")), "doc_id", "left_semi")
    h = b.select(F.col("item_id").alias("query_id"), "text").union(docs.select("doc_id", "text"))
    return E.keyword_coverage(h, k).select("query_id", "matched", "total", F.round("coverage", 6).alias("coverage"), "satisfactory")


@query("best_iteration", "select o_custkey, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) as best, max(o_totalprice) as coverage from orders group by 1")
def _(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("iteration"), F.col("o_totalprice").alias("coverage"))
    return E.best_iteration(runs).select(F.col("question_id").alias("o_custkey"), F.col("best_iteration").alias("best"), "coverage")


@query("list_page", "select c_custkey, c_name, c_acctbal from customer where c_mktsegment = 'BUILDING' order by c_acctbal desc, c_custkey limit 20 offset 10")
def _(spark, d):
    return G.list_rows(table(spark, d, "customer"), {"c_mktsegment": "BUILDING", "c_nationkey": None}, [F.desc("c_acctbal"), F.col("c_custkey")], 20, 10).select("c_custkey", "c_name", "c_acctbal")


@query("counts_by_category", "select o_orderpriority, count(*) as n, max(o_orderdate) as last_created from orders group by 1")
def _(spark, d):
    return G.counts_by(table(spark, d, "orders"), "o_orderpriority", "o_orderdate")


@query("registry_totals", "select count(*) as total, count_if(o_orderstatus = 'F')::bigint as done, count(distinct o_custkey) as n_sources from orders")
def _(spark, d):
    return G.totals(table(spark, d, "orders"), "o_orderstatus", "o_custkey", "F")


_STATUS = "case o_orderstatus when 'O' then 'uploaded' when 'F' then 'indexed' else 'parsing' end"
_NEW = "case o_orderkey % 3 when 0 then 'parsing' when 1 then 'parsed' else 'error' end"


def _assets(spark, d):
    s = F.when(F.col("o_orderstatus") == "O", "uploaded").when(F.col("o_orderstatus") == "F", "indexed").otherwise("parsing")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("asset_id"), s.alias("status"))


@query("state_transitions", f"""
with t as (select * from (values ('uploaded','parsing'),('uploaded','error'),('parsing','parsed'),('parsing','error'),('parsed','indexing'),('parsed','error'),('indexing','indexed'),('indexing','error'),('indexed','parsing'),('error','parsing'),('error','uploaded')) x(a, b))
select o_orderkey as asset_id, case when t.a is not null then n else s end as status from (select o_orderkey, {_STATUS} as s, {_NEW} as n from orders) left join t on t.a = s and t.b = n""")
def _(spark, d):
    new = F.when(F.col("asset_id") % 3 == 0, "parsing").when(F.col("asset_id") % 3 == 1, "parsed").otherwise("error")
    assets = _assets(spark, d)
    return G.transition(assets, assets.select("asset_id", new.alias("new_status")))[0]


@query("rejected_transitions", f"""
select o_orderkey as asset_id, s as status, n as new_status, 'not allowed' as reason from (select o_orderkey, {_STATUS} as s, {_NEW} as n from orders)
where (s, n) not in (('uploaded','parsing'),('uploaded','error'),('parsing','parsed'),('parsing','error'),('indexed','parsing'))""")
def _(spark, d):
    new = F.when(F.col("asset_id") % 3 == 0, "parsing").when(F.col("asset_id") % 3 == 1, "parsed").otherwise("error")
    assets = _assets(spark, d)
    return G.transition(assets, assets.select("asset_id", new.alias("new_status")))[1]


@query("upsert", "select c_custkey as id, case when c_custkey % 3 = 0 then 'new ' || c_name else c_name end as title, c_custkey % 3 <> 0 as is_vectorized from customer")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit(True).alias("is_vectorized"))
    new = c.where("id % 3 = 0").withColumn("title", F.concat(F.lit("new "), F.col("title")))
    return G.upsert(c, new)


@query("partial_update", "select p_partkey, case when p_partkey % 5 = 0 then upper(p_name) else p_name end as p_name, p_partkey % 5 <> 0 as is_vectorized from part")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name").withColumn("is_vectorized", F.lit(True))
    return G.patch(p, p.where("p_partkey % 5 = 0").select("p_partkey", F.upper("p_name").alias("p_name")), "p_partkey", ("p_name",))


@query("anti_join_delete", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 49)")
def _(spark, d):
    return G.hard_delete(table(spark, d, "part"), table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")).distinct(), "p_partkey").select("p_partkey")


@query("parents", "select c.doc_id as id, c.doc_id // 10 as parent_id, md5(p.text) as parent_digest from documents c left join documents p on p.doc_id = c.doc_id // 10")
def _(spark, d):
    i = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 10).alias("parent_id"), F.lit("t").alias("title"), F.col("text").alias("content"))
    return G.parents(i).select("id", "parent_id", F.md5(F.col("parent_content").cast("binary")).alias("parent_digest"))


@query("with_parents", """
select c.doc_id as rank, coalesce(p.doc_id, c.doc_id) as id, md5(coalesce(p.text, c.text)) as digest from documents c left join documents p on c.doc_id % 7 = 0 and p.doc_id = c.doc_id // 7""")
def _(spark, d):
    i = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 == 0, F.floor(F.col("doc_id") / 7)).alias("parent_id"), F.lit("t").alias("title"), F.col("text").alias("content"))
    hits = i.select("id", F.col("id").alias("rank"))
    return G.with_parents(hits, i).select("rank", "id", F.md5(F.col("content").cast("binary")).alias("digest"))


@query("provenance", "select l_orderkey as chunk_id, l_linenumber as chunk_index, o_orderkey as asset_id, o_orderstatus as status from lineitem join orders on l_orderkey = o_orderkey")
def _(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("chunk_index"), F.col("l_orderkey").alias("asset_id"))
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("asset_id"), F.col("o_orderpriority").alias("file_name"), F.lit("c").alias("category"), F.col("o_orderstatus").alias("status"))
    return G.provenance(m, a).select("chunk_id", "chunk_index", "asset_id", "status")


@query("page_spans", "select l_orderkey as asset_id, max(l_quantity)::int as pages, count(*) as n from lineitem group by 1")
def _(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("asset_id"), F.col("l_quantity").cast("int").alias("original_page_number"), F.col("l_linenumber").alias("chunk_index"), F.col("l_partkey").alias("chunk_id"))
    return G.page_spans(m).select("asset_id", "pages", F.size("regions").cast("long").alias("n"))


@query("content_search", "select doc_id as id from documents where contains(lower(text), 'license') order by doc_id limit 10")
def _(spark, d):
    i = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("title"), F.col("text").alias("content"))
    return G.search_content(i, "License", 10).select("id")


@query("document_content", r"""
with c as (select doc_id, text from documents where contains(lower(source), 'src3') order by doc_id limit 50) select md5(string_agg(text, chr(10) || chr(10) order by doc_id)) as digest, count(*) as n from c""")
def _(spark, d):
    i = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_file"), F.col("text").alias("content"))
    return G.document_content(i, "src3").select(F.md5(F.col("content").cast("binary")).alias("digest"), "n")


@query("summary_inputs", r"""
with f as (select source, doc_id, text from documents qualify row_number() over (partition by source order by doc_id) <= 10)
select source, md5(substring(string_agg(text, chr(10) order by doc_id), 1, 5000)) as digest from f group by source""")
def _(spark, d):
    i = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_file"), F.col("text").alias("content"))
    return G.summary_input(i).select(F.col("source_file").alias("source"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("index_status", """
select n_name as path, case when s.n is not null then 'indexed' else 'pending' end as status, coalesce(s.n, 0) as n_items from nation left join (select n_name as k, count(*) as n from supplier join nation on s_nationkey = n_nationkey group by 1) s on s.k = n_name""")
def _(spark, d):
    n = table(spark, d, "nation")
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("kb\\"), F.col("n_name")).alias("source_file"))
    none = n.select(F.col("n_name").alias("name"), F.lit(None).cast("string").alias("summary"))
    return G.index_status(n.select(F.concat(F.lit("docs/"), F.col("n_name")).alias("path")), s, none).select(F.regexp_replace("path", "^docs/", "").alias("path"), "status", "n_items")


@query("merged_graph_hits", """
select s_suppkey as id, s_acctbal as score, false as is_graph from supplier
union all select p_partkey, p_retailprice, true from part where p_partkey not in (select s_suppkey from supplier)""")
def _(spark, d):
    normal = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"))
    return G.merge_graph_hits(normal, table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score")))


@query("active_config", "select n_name as config_id, case when n_name = 'FRANCE' then 'active' when n_regionkey = 1 then 'draft' else 'archived' end as status from nation")
def _(spark, d):
    c = table(spark, d, "nation").select(F.col("n_name").alias("config_id"), F.when(F.col("n_regionkey") == 1, "active").otherwise("archived").alias("status"))
    return G.activate(c, "FRANCE")


@query("shadow_versions", "select c_mktsegment as config_name, count_if(c_acctbal < 0)::bigint + 1 as next_version from customer group by 1")
def _(spark, d):
    return G.shadow_names(table(spark, d, "customer").select(F.col("c_mktsegment").alias("config_name"), (F.col("c_acctbal") < 0).alias("is_shadow")))


@query("valid_configs", "select p_partkey from part where p_size * 100 in (500, 800, 1000) and p_partkey % 2 = 0")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 100).alias("chunk_size"), F.when(F.col("p_partkey") % 2 == 0, 0.15).otherwise(0.2).alias("overlap_ratio"), F.lit("fixed").alias("splitter_type"))
    return G.valid_configs(p).select("p_partkey")
