"""Plan shapes: pushed filters, pruned columns, top-k limits, JVM-only text functions; and partition invariance."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodewell import catalog
from lodewell.functions import text as X
from lodewell.functions import tokens as T
from lodewell.operators import chunk as C
from lodewell.operators import graph as G
from lodewell.operators import rank as R
from lodewell.operators import registry as K
from lodewell.plans.storage import in_blocks, materialize, scratch_root

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    c = spark.read.parquet(f"{D}/customer.parquet")
    p = plan(K.list_rows(c, {"c_mktsegment": "BUILDING"}, [F.col("c_custkey")], 5).select("c_custkey"))
    assert "EqualTo(c_mktsegment,BUILDING)" in p and "TakeOrderedAndProject" in p
    assert re.search(r"ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>", p)


def test_top_k_is_limited_before_the_shuffle(spark):
    s = spark.range(100).select((F.col("id") % 3).alias("query_id"), F.col("id").alias("item_id"), F.rand(1).alias("score"))
    p = plan(R.top(s, 5, ["query_id"]))
    assert "WindowGroupLimit" in p and p.index("Final") < p.index("Partial")


@pytest.mark.parametrize("name", ["text_quality", "text_sanitize", "text_garble_rate", "log_lines", "chunks_fixed", "bm25", "tfidf", "node_edges", "proximity_join", "gap_sessions"])
def test_built_in_queries_run_no_python(spark, name):
    assert not re.search("Python|Pandas|Arrow", plan(catalog.queries()[name](spark, D)))


def test_a_kept_index_reads_the_folders_of_the_asked_tokens(spark):
    from lodewell.operators import index as I

    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = I.items(docs, F.col("doc_id"), F.col("source"), F.col("text"))
    kept = I.Kept.build(rows, R.name_tokens(docs.select(F.col("source").alias("scope"), F.col("source").alias("names"))), buckets=8)
    asked = spark.createDataFrame([("the",), ("of",)], "token string")
    hits = kept.postings("words", asked)
    assert re.search(r"PartitionFilters: \[isnotnull\(bucket#\d+\), bucket#\d+ IN|PartitionFilters: \[bucket#\d+ IN", plan(hits)) and "In(token, [" in plan(hits) and {r.token for r in hits.select("token").distinct().collect()} == {"the", "of"}
    assert kept.postings("words", asked, most=1).count() == hits.count()
    whole = I.term_frequencies(rows, T.bm25_tokens)
    assert hits.count() == whole.where("token in ('the', 'of')").count()
    queries = spark.createDataFrame([(1, "the of"), (2, "nothing_here_at_all"), (3, "src1")], "query_id int, query string")
    items = docs.select(F.col("doc_id").alias("item_id"), "source", F.lit("t").alias("title"), "text", F.lit("x").alias("type"), F.lit(None).cast("string").alias("scene"), F.lit(None).cast("string").alias("subsystem"))
    found = R.search(kept, items, queries, 3)
    assert {r.query_id for r in found.collect()} >= {1}


@pytest.fixture(scope="module")
def small_index(spark):
    """Documents in five files and more, in small blocks and dictionary parts."""
    from lodewell.operators import index as I

    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "source", "text")
    more = spark.createDataFrame([(10_000 + i, "cjk", f"蓝牙配对 蓝牙连接{i} 升级 naïve Ωmega 😀face {'x' * i}") for i in range(30)] + [(20_000, "cjk", None)], "doc_id long, source string, text string")
    rows = materialize(I.items(docs.unionByName(more), F.col("doc_id"), F.col("source"), F.col("text")), "rows")
    names = R.name_tokens(rows.select("scope", F.col("scope").alias("names")).distinct())
    layout = I.Layout(buckets=4, block_items=8, part_terms=500, segments=2, row_group=1 << 16)
    return rows, names, I.Kept.build(rows, names, layout=layout)


def test_a_prefix_is_a_range_of_the_dictionary(spark, small_index):
    from lodewell.operators import index as I

    rows, _, kept = small_index
    segment = kept.manifest["segments"][0]
    assert len(segment["parts"]) > 3
    terms = kept.table("terms").orderBy("token").collect()
    assert [r.term for r in terms] == sorted(r.term for r in terms)  # terms are numbered in the order of tokens
    for prefixes in (["the"], ["蓝", "蓝牙"], ["zz", "a1", "😀"], ["升级"]):
        got = kept.prefix_terms(segment, prefixes)
        p = plan(got)
        assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(token,", p) and len({f.split("part=")[1].split("/")[0] for f in got.inputFiles()}) < len(segment["parts"])
        assert {r.token for r in got.collect()} == {r.token for r in terms if r.token.startswith(tuple(prefixes))}
    assert {r.token for r in kept.prefix_terms(segment, [chr(97 + i) + chr(97 + j) for i in range(26) for j in range(26)], ranges=5).collect()} >= {r.token for r in terms if re.match("[a-z]{2}", r.token)}
    assert I.spans(["ab", "a", "b", "b\U0010ffff", "\U0010ffff"]) == [("a", "b"), ("b", "c"), ("\U0010ffff", None)] and I.after("x\ud7ff") == "x\ue000"
    queries = spark.createDataFrame([(1, "the of"), (2, "蓝牙配"), (3, "zzzz_nothing"), (4, "ωme"), (5, "the"), (6, None)], "query_id int, query string")
    want = sorted(map(tuple, I.fts_match(I.fts_postings(rows), queries).collect()))
    assert want and sorted(map(tuple, kept.matches(queries).collect())) == want == sorted(map(tuple, kept.matches(queries, most=1).collect()))
    assert kept.matches(queries.where("query_id = 3")).count() == 0


def test_block_bounds_prune_and_lose_nothing(spark, small_index):
    rows, _, kept = small_index
    queries = spark.createDataFrame([(1, "the of and"), (2, "the"), (3, "蓝牙 x1 the"), (4, "nothing_at_all"), (5, "the the of")], "query_id int, query string")
    for k in (1, 5, 1000):
        want = sorted((r.query_id, r.scope, r.item_id, r["rank"], round(r.score, 9)) for r in R.top(R.bm25(rows, queries), k, ["query_id", "scope"]).collect())
        got = sorted((r.query_id, r.scope, r.item_id, r["rank"], round(r.score, 9)) for r in R.bm25_top(kept, queries, k).collect())
        assert got == want
    # a common word: of its blocks, those whose limit is below the k-th best score are not opened
    asked = R.query_tokens(queries.where("query_id = 2"), T.bm25_tokens)
    limits = R.block_limits(kept, asked)
    best = R.bm25_top(kept, queries.where("query_id = 2"), 3).where("rank = 3").select("scope", "score")
    opened = limits.join(best, "scope").where("most >= score").count()
    assert opened < 0.7 * limits.join(best, "scope").count()
    some = limits.orderBy("most").limit(2)
    assert "In(grp, [" in plan(kept.blocks_of(asked, some)) and kept.blocks_of(asked, some, most=1).count() > kept.blocks_of(asked, some).count()


def test_a_changed_file_is_a_segment_of_its_own(spark, small_index, tmp_path):
    from lodewell.operators import index as I
    from lodewell.plans import versions

    rows, names, _ = small_index
    layout = I.Layout(buckets=4, block_items=8, part_terms=500, segments=3)
    kept = I.Kept.build(rows, names, root=str(tmp_path / "index"), layout=layout)
    queries = spark.createDataFrame([(1, "the of"), (2, "蓝牙 fresh"), (3, "src1")], "query_id int, query string")
    state = rows
    for step in range(3):
        new = spark.createDataFrame([(30_000 + step * 10 + i, "cjk" if step < 2 else "new", f"fresh 蓝牙 the {step} {'of ' * i}") for i in range(4)], "item_id long, scope string, text string").select("item_id", "scope", "text")
        scope = "cjk" if step < 2 else "new"
        gone = spark.createDataFrame([("src2",)], "scope string") if step == 1 else None
        state = state.where(F.col("scope") != scope).unionByName(new)
        state = state.where("scope != 'src2'") if step >= 1 else state
        before = kept
        kept = kept.update(new, R.name_tokens(new.select("scope", F.col("scope").alias("names")).distinct()), gone)
        segment = kept.manifest["segments"][-1]
        if step == 2:  # one too many: the two small ones are merged
            assert segment["items"] == 8 and len(kept.manifest["segments"]) == 2
            continue
        assert segment["items"] == 4 and spark.read.parquet(f"{kept.root}/{segment['path']}/words").count() < before.table("words").count() / 10
    assert len(kept.manifest["segments"]) <= 3 and I.Kept.open(spark, kept.root).number == kept.number
    state = materialize(state, "state")
    whole = I.Kept.build(state, R.name_tokens(state.select("scope", F.col("scope").alias("names")).distinct()), layout=layout)
    for name in ("scopes", "files", "words", "tokens", "blocks"):
        columns = [c for c in whole.table(name).columns if c != "bucket"]
        shown = lambda k: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in k.table(name).select(*columns).collect())  # noqa: E731, B023
        assert shown(kept) == shown(whole), name
    assert sorted(map(tuple, kept.matches(queries).collect())) == sorted(map(tuple, whole.matches(queries).collect()))
    score = lambda k: sorted((r.query_id, r.item_id, round(r.score, 9)) for r in R.bm25_top(k, queries, 5).collect())
    assert score(kept) == score(whole)
    with pytest.raises(versions.Conflict):
        before.update(new, names.where("false"))
    none = I.Kept.build(rows.where("false"), names.where("false"), layout=layout)
    assert none.matches(queries).count() == 0 and R.bm25_top(none, queries).count() == 0


def test_vocabulary_takes_the_best_of_each_bucket_first(spark):
    from lodewell.operators import index as I

    tf = I.term_frequencies(I.items(spark.read.parquet(f"{D}/documents.parquet"), F.col("doc_id"), F.col("source"), F.col("text")))
    plain = I.vocabulary(tf, 50, buckets=1).select("scope", "token", "rank").collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, I.vocabulary(tf, 50, buckets=7).select("scope", "token", "rank").collect()))
    assert plan(I.vocabulary(tf, 50)).count("WindowGroupLimit") >= 2


def test_disjunctive_and_band_joins_are_equi_joins(spark):
    e = spark.read.parquet(f"{D}/lineitem.parquet").select(F.col("l_partkey").cast("string").alias("from_node"), F.col("l_suppkey").cast("string").alias("to_node"), F.lit("calls").alias("edge_type"))
    assert "NestedLoop" not in plan(G.node_edges(e.select(F.col("from_node").alias("id")).distinct(), e)) and "Cartesian" not in plan(catalog.queries()["proximity_join"](spark, D))


def test_results_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for n in (1, 5):
        docs.repartition(n).createOrReplaceTempView(f"d{n}")
    for f in (lambda d: C.fixed_windows(d, "doc_id", "text"), lambda d: d.select("doc_id", X.clean(F.col("text")).alias("t")), lambda d: C.structure_chunks(d, "doc_id", "text")):
        a, b = (sorted(map(str, f(spark.table(f"d{n}")).collect())) for n in (1, 5))
        assert a == b


def test_blocks_and_scratch(spark):
    ids = spark.range(50).withColumnRenamed("id", "k")
    assert in_blocks(ids, "k", 7, lambda x: x).count() == in_blocks(ids, "k", 700, lambda x: x).count() == 50
    assert in_blocks(ids.where("k < 0"), "k", 7, lambda x: x).count() == 0
    t = materialize(ids, "t")
    assert t._lodewell_path.startswith(scratch_root(spark)) and t.count() == 50


WORDS = st.lists(st.sampled_from(["a", "bb ", "- c", "1. d", "", "e:", "x" * 25, "标题"]), max_size=12)


@given(WORDS)
@settings(max_examples=200, deadline=None)
def test_line_merge_keeps_all_characters(lines):
    joined = "".join(X.merge_lines(lines))
    assert joined == "".join(x.strip() for x in lines)


@given(st.text(alphabet="ab \n", max_size=300), st.integers(5, 40), st.integers(0, 4))
@settings(max_examples=200, deadline=None)
def test_paragraphs_keep_all_words(text, size, overlap):
    parts = list(C.pack_paragraphs(text, size, overlap))
    assert all(len(p) <= size for p in parts)
    kept = "".join("".join(parts).split())
    assert len(kept) >= len("".join(text.split())) if not overlap else True


@given(st.lists(st.text(alphabet="abc# 1.\n", max_size=60), max_size=10))
@settings(max_examples=200, deadline=None)
def test_chunks_cover_every_line(lines):
    text = "\n".join(lines)
    joined = "".join(c["content"] for c in C.chunks_of(text, small=10, large=60))
    assert all(line.strip() in joined for line in text.split("\n"))
