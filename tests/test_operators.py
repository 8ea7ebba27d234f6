"""Ranking, expansion, logs, graphs, dedup, evaluation and registry on literal fixtures."""

import math
import random
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodewell.functions import text as X
from lodewell.operators import dedup as D
from lodewell.operators import edits
from lodewell.operators import evaluate as E
from lodewell.operators import expand as Q
from lodewell.operators import graph as G
from lodewell.operators import index as I
from lodewell.operators import logs as L
from lodewell.operators import rank as R
from lodewell.operators import registry as K
from lodewell.plans.components import connected_components


def rows(spark):
    return spark.createDataFrame([("d1", "f1", "ble pair ble"), ("d2", "f1", "ota flash")], "item_id string, scope string, text string")


def ask(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")


def test_bm25_and_tfidf(spark):
    got = R.bm25(rows(spark), ask(spark, "ble"), weights={}).collect()
    assert [(r.item_id, round(r.score, 6)) for r in got] == [("d1", 0.930399)]
    got = R.bm25(rows(spark), ask(spark, "ble")).collect()
    assert round(got[0].score, 6) == 1.395598
    got = {r.item_id: round(r.score, 6) for r in R.tfidf(rows(spark), ask(spark, "ble"), keep_zero=True).collect()}
    assert got == {"d1": 0.894427, "d2": 0.0}
    assert math.isclose(math.log(3 / 2) + 1, 1.405465, rel_tol=1e-6)


def test_rrf(spark):
    leg = lambda *ids: spark.createDataFrame([(0, i, 1.0 - k / 10) for k, i in enumerate(ids)], "query_id int, item_id string, score double")
    legs = [leg("a", "b", "c"), leg("b", "a"), leg("c")]
    for order in (legs, legs[::-1]):
        got = R.top(R.reciprocal_rank_fusion(order), 9, ["query_id"]).orderBy("rank").collect()
        assert [(r.item_id, round(r.score, 6)) for r in got] == [("a", 0.032522), ("b", 0.032522), ("c", 0.032266)]


def test_boosts_sources_and_budget(spark):
    hits = spark.createDataFrame([(0, "x", "ble", "business_doc", "About BLE", None, None, "s1", 1.0), (0, "y", "gps", "section", "t", "gps scene", "can/vehicle", "s1", 1.0)], "query_id int, item_id string, query string, type string, title string, scene string, subsystem string, source string, score double")
    got = {r.item_id: round(r.score, 6) for r in R.boost(hits).collect()}
    assert got == {"x": 20.0, "y": 0.45}
    s = spark.createDataFrame([(0, "a", "s1", 0.9), (0, "b", "s1", 0.95), (0, "c", "s2", 0.5)], "query_id int, item_id string, source string, score double")
    assert sorted((r.item_id, r.score) for r in R.best_per_source(s).collect()) == [("b", 0.95), ("c", 0.5)]
    c = spark.createDataFrame([(0, i, "x" * n) for i, n in enumerate((5, 5, 5), 1)], "query_id int, rank int, text string")
    assert R.context_budget(c, 10).count() == 2


def test_hybrid_is_stable_under_partitions(spark):
    items = spark.createDataFrame([(i, f"s{i % 3}", f"t{i}", f"ble word{i} pair {'ota ' * (i % 4)}", "section", None, None) for i in range(40)], "item_id int, source string, title string, text string, type string, scene string, subsystem string")
    a = R.hybrid(items.repartition(1), ask(spark, "ble pair", "ota")).collect()
    b = R.hybrid(items.repartition(7), ask(spark, "ble pair", "ota")).collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and {r.query_id for r in a} == {0, 1}


def test_fts(spark):
    files = spark.createDataFrame([("d1", "f1", "骑行记录上报"), ("d2", "f2", "生成骑行记录 格式"), ("d3", "f3", "行程 记录")], "item_id string, scope string, text string")
    post = I.fts_postings(files)
    hit = lambda q, contains=False: {r.scope for r in I.fts_match(post, ask(spark, q), contains).where(F.length(F.lit(q)) > 0).collect()}
    assert "f1" in hit("骑行") and "f2" not in {r.scope for r in post.where("startswith(token, '骑行')").collect()}
    assert "f3" in hit("记录") and hit("记录", True) == {"f1", "f2", "f3"}
    assert hit("don't (x") == set() and hit("") == set()
    grams = I.bigram_index(files)
    assert {r.scope for r in I.files_with_bigrams(grams, spark.createDataFrame([("记录",)], "bigram string")).collect()} == {"f1", "f2", "f3"}
    assert {r.scope: r.content for r in I.grouped_text(files).collect()}["f1"] == "骑行记录上报"


def test_candidates(spark):
    files = spark.createDataFrame([("a/business_docs/x", 9, "x"), ("b", 1, "ble_pair.c"), ("c", 5, "other ble")], "scope string, n_items int, names string")
    met = spark.createDataFrame([(0, "a/business_docs/x"), (0, "b"), (0, "c")], "query_id int, scope string")
    assert [r.scope for r in R.candidate_files(files, met).orderBy("rank").collect()] == ["a/business_docs/x", "b", "c"]
    assert [r.scope for r in R.overlap_files(files, ask(spark, "ble pair")).orderBy("rank").collect()] == ["b", "c"]


def test_dense_and_priority(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0])], "item_id int, vector array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, vector array<double>")
    for most in (1, 100):
        two = q.union(q.select(F.lit(1), "vector"))
        assert sorted((r.query_id, r.item_id) for r in R.dense(v, two, 2, most).collect()) == [(0, 1), (0, 2), (1, 1), (1, 2)]
    hits = spark.createDataFrame([(0, "log", 1), (0, "c", 2)], "query_id int, category string, item int")
    pr = spark.createDataFrame([(0, "x", 1), (0, "c", 2), (0, "log", 3)], "query_id int, category string, priority int")
    assert [r.item for r in R.category_priority(hits, pr).collect()] == [2]


def test_expansion(spark):
    got = [r.expansion for r in Q.expand(ask(spark, "BLE fe01")).orderBy("ord").collect()]
    assert got[0] == "ble fe01" and {"0xfe01", "0x00fe01", "ble"} <= set(got) and len(got) <= 20
    assert Q.expand(ask(spark, "dp " + "a b c d e f g h i j k l m n o p q r s t")).count() == 20
    assert Q.structured(ask(spark, "fault report")).first().expression == "fault AND report" and Q.structured(ask(spark, "x")).first().expression == "x"
    assert {"同步 sync", "sync"} & {r.expansion for r in Q.expand(ask(spark, "同步")).collect()} and "0x8003" in {x for r in Q.expand(ask(spark, "0x8003")).collect() for x in r.expansion.split()}
    assert Q.detect_entities(ask(spark, "蓝牙升级")).first().entities == ["bluetooth", "ota"]
    assert Q.related_queries(ask(spark, "ota")).count() == 4


def test_classifiers(spark):
    df = ask(spark, "蓝牙协议", "error log", "struct enum", "hello", "怎么配对 0x8001", "为什么")
    q = F.col("query")
    got = df.select(Q.coarse_category(q).alias("c"), Q.fine_intent(q).alias("f"), Q.question_type(q).alias("k")).collect()
    assert [r.c for r in got] == ["protocol", "log", "c_code", None, "protocol", None]
    assert got[3].f.category == "business" and got[3].f.confidence == 0.5
    assert got[4].f.category == "bluetooth" and got[4].f.score == 2.5 and got[4].f.confidence == 0.5
    assert [r.k for r in got][4:] == ["how", "what"]
    assert [r.r for r in ask(spark, "那个咋办", "查询功能码", "功能码0x01").select(Q.rewrite(q).alias("r")).collect()] == ["设备解决方案", "查询功能码0x0000或0x0003", "功能码0x01"]
    assert ask(spark, "如何绑定").select(Q.hypothetical_queries(q).alias("h")).first().h[0] == "如何方法绑定"
    assert ask(spark, "can协议x").select(Q.hypothetical_queries(q).alias("h")).first().h == ["CAN协议格式", "CAN PGN定义", "CAN指令下发"]
    assert ask(spark, "abcd efgh,ijkl mnop").select(Q.hypothetical_queries(q).alias("h")).first().h == ["abcd efgh", "ijkl mnop"]
    s = ask(spark, "x" * 80).select(Q.search_string(q, F.array(F.lit("enhance"))).alias("s")).first().s
    assert len(s) <= 50
    assert Q.refine(ask(spark, "ble")).count() >= 2 and Q.fallback_queries(ask(spark, "alpha be gamma")).orderBy("ord").first().fallback == "alpha"
    assert ask(spark, "alpha beta").select(Q.overlap_relevant(q, F.lit("beta x alpha")).alias("r")).first().r


def test_log_lines(spark):
    text = "2024-01-01 10:00:00.123 [ERROR] [ble] - x\n2024/01/01 10:00:00 WARN x\nplain fail\n\nok"
    got = L.parse_lines(spark.createDataFrame([("f", text)], "file string, t string"), "file", "t").orderBy("line_number").collect()
    assert [(r.line_number, r.timestamp, r.level, r.source, r.message) for r in got] == [(1, "2024-01-01 10:00:00.123", "ERROR", "ble", "x"), (2, None, "WARN", "unknown", "2024/01/01 10:00:00 WARN x"), (3, None, "ERROR", "unknown", "plain fail"), (5, None, "INFO", "unknown", "ok")]
    assert got[0].id == "log:f:1" and got[0].legacy_id == "log:1"


def test_gap_sessions(spark):
    times = ["10:00:00", "10:00:05", "10:00:11", None, "10:00:30", "10:00:29"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(times, 1)], "file string, line_number int, raw string").withColumn("ts", L.parse_timestamp(F.col("raw")))
    got = L.gap_sessions(df, ["file"], ["line_number"], "ts", 5.0, F.col("raw").isNotNull()).orderBy("line_number").collect()
    assert [r.session for r in got] == [0, 0, 1, 1, 1, 1]
    bad = df.withColumn("raw", F.when(F.col("line_number") == 2, "junk").otherwise(F.col("raw"))).withColumn("ts", L.parse_timestamp(F.col("raw")))
    got = L.gap_sessions(bad, ["file"], ["line_number"], "ts", 5.0, F.col("raw").isNotNull()).orderBy("line_number").collect()
    assert [r.session for r in got][:3] == [0, 1, 2]


def test_edges(spark):
    edges = spark.createDataFrame([("a", "b", "calls"), ("a", "b", None), ("b", "a", "calls"), ("c", "c", "calls")], "from_node string, to_node string, edge_type string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    got = {r.id: [(e.target, e.direction) for e in r.edges] for r in G.node_edges(nodes, edges).collect()}
    assert sorted(got["a"]) == [("b", "in"), ("b", "out"), ("b", "out")] and got["c"] == [("c", "out")] and got["d"] == []
    assert {r.callee for r in G.callees(edges, nodes.where("id = 'a'")).collect()} == {"b"}
    chain = {r.id: (r.callers, r.callees) for r in G.call_chain(edges, nodes).collect()}
    assert chain["a"] == (["b"], ["b"]) and chain["d"] == ([], [])
    assert G.mentions(spark.createDataFrame([("i", "x Foo y")], "item_id string, text string"), spark.createDataFrame([("foo",), ("bar",)], "name string")).count() == 1


def test_proximity(spark):
    text = "DP 7" + "." * 195 + "0x1111" + " 0x2222" + "." * 244 + "0x3333"
    got = G.dp_relations(spark.createDataFrame([("f", text)], "f string, t string"), "f", "t").collect()
    assert [(r.pos, r.dp_id, r.related_can_ids) for r in got] == [(0, "7", ["1111"])]


CODE = """#define MAX 10
typedef struct pair { int a; } pair_t;
enum mode { OFF, ON = 2 };
static int counter = 0;
char *name_of(int id) {
    // helper(1);
    switch (id) { case 1: { break; } }
    return lookup(id);
}
void run(void) { name_of(3); printf("x(%d)", 1); }
"""


def test_code(spark):
    nodes, edges = G.code_parts(CODE)
    assert {(n[0], n[1]) for n in nodes} == {("macro", "MAX"), ("struct", "pair"), ("enum", "mode"), ("variable", "counter"), ("function", "name_of"), ("function", "run"), ("state_machine", "state_machine_id")}
    assert ("func:run", "func:name_of", "calls") in edges and ("func:name_of", "ext:lookup", "calls") in edges and ("enum:mode", "value:ON", "has_value") in edges
    assert not any("helper" in e[1] for e in edges)
    df = spark.createDataFrame([("src/ble/a.c", CODE)], "file string, code string")
    n, e = G.code_nodes(df, "file", "code"), G.code_edges(df, "file", "code")
    assert {r.line_start for r in n.where("name = 'run'").collect()} == {10}
    items = G.graph_items(n.withColumn("has_params", F.size("params") > 0), e)
    assert items.where("title = 'name_of'").first().keywords == "function,has_params,name_of"
    assert G.function_search(n, "RUN").count() == 1
    block = G.code_blocks(df, "file", "code").where("name = 'MAX'").first()
    assert block.id == "src/ble/a.c:1:macro:MAX" and block.content.startswith("/* [BLE] a.c */\n")
    calls = spark.createDataFrame([("f", "a", "b"), ("f", "a", "printf"), ("g", "a", "b")], "file string, caller string, callee string")
    fs = spark.createDataFrame([("f", "b")], "file string, name string")
    assert sorted((r.file, r.target) for r in G.resolve_calls(calls, fs).collect()) == [("f", "func:b"), ("f", "func:printf"), ("g", "ext:b")]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 9), (5, 5), (None, 1), (2, 1), (7, 8), (8, 9)], "src long, dst long")
    assert {r.node: r.component for r in connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, 10: 7}
    line = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.component for r in connected_components(line).collect()} == {0}
    assert connected_components(edges.where("src > 99")).count() == 0


def _greedy_plain(rows, threshold=0.8):
    """The rule as it reads: rows (nth, kind, hash, content) in order; {nth: first} and [(nth, content)] of what is kept."""
    def ratio(a, b):
        a, b = a.lower()[:500], b.lower()[:500]
        if not a or not b or abs(len(a) - len(b)) > max(len(a), len(b)) * 0.5:
            return 0.0
        return 1 - D.edit_distance(a, b) / max(len(a), len(b))

    kept, at = [], {}
    for nth, kind, h, content in rows:
        same = next((e for e in kept if e["h"] == h or ratio(e["content"], content) >= threshold), None)
        if same is None:
            same = {"nth": nth, "kind": kind, "h": h, "content": content}
            kept.append(same)
        elif not (same["kind"] == "command" and kind != "command") and len(content) > len(same["content"]):
            same["h"], same["content"] = h, content
        at[nth] = same["nth"]
    return at, [(e["nth"], e["content"]) for e in kept]


def test_blocks_of_many_slices(spark, monkeypatch):
    """A file larger than a slice gives what the rule gives in order; clusters are those of all pairs."""
    monkeypatch.setattr(D, "SLICE", 32)
    r = random.Random(5)
    heads = ["".join(r.choice("abcde fgh") for _ in range(r.randint(1, 120))) for _ in range(12)]
    rows = []
    for i in range(140):
        t = list(r.choice(heads))
        for _ in range(r.randint(0, max(1, len(t) // 4))):
            at = r.randrange(len(t) + 1)
            t[at : at + r.randint(0, 1)] = r.choice(["", "x", "yz"])
        text = "".join(t) if i % 40 else [None, "", "  "][i // 40 % 3]
        rows.append(("f" if i % 5 else None if i % 2 else "g", i, "command" if r.random() < 0.15 else "section", f"b{i}", text, i))
    df = spark.createDataFrame(rows, "k string, n long, kind string, name string, content string, o long")
    hashes = {x.n: x.h for x in df.select("n", X.min_shingle_hash(F.coalesce("content", F.lit(""))).alias("h")).collect()}
    first = {x.n: x.first for x in D.block_slots(df, "k", "n").collect()}
    kept = sorted((x.n, x.content or "") for x in D.greedy_blocks(df, "k", "n").collect())
    component = {x.n: x.component for x in D.cluster_blocks(df, "k", "n").collect()}
    want_first, want_kept = {}, []
    for file in ("f", "g", None):
        of = [(x[1], x[2], hashes[x[1]], x[4] or "") for x in rows if x[0] == file]
        at, keep = _greedy_plain(of)
        want_first |= at
        want_kept += keep
        root = {x[0]: x[0] for x in of}
        for _ in range(len(of)):
            before = dict(root)
            for i, a in enumerate(of):
                for b in of[i + 1 :]:
                    if root[a[0]] != root[b[0]] and len(_greedy_plain([a, b])[1]) == 1:
                        root[a[0]] = root[b[0]] = min(root[a[0]], root[b[0]])
            if root == before:
                break
        assert {n: component[n] for n in root} == root
    assert first == want_first and kept == sorted(want_kept)
    assert len(set(first.values())) < 110 and any(first[n] != component[n] for n in first)
    none = df.where("n < 0")
    assert D.greedy_blocks(none, "k", "n").count() == D.block_slots(none, "k", "n").count() == D.cluster_blocks(none, "k", "n").count() == 0


def test_dedup(spark):
    b = spark.createDataFrame([(1, 1, "command", "c", "the quick brown fox jumps"), (1, 2, "section", "s", "the quick brown fox jumps x"), (1, 3, "section", "t", "nothing like it at all"), (2, 1, "section", "u", "the quick brown fox jumps")], "f long, n long, kind string, name string, content string")
    got = sorted((r.f, r.n, r.name) for r in D.greedy_blocks(b, "f", "n").collect())
    assert got == [(1, 1, "c"), (1, 3, "t"), (2, 1, "u")]
    r = random.Random(2)
    for _ in range(300):
        x, y = ("".join(r.choice("ab") for _ in range(r.randint(0, 12))) for _ in range(2))
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            diag, row[0] = row[0], i
            for j, e in enumerate(y, 1):
                diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (c != e))
        assert D.edit_distance(x, y) == row[-1]
    new = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z")], "id long, c string")
    known = new.where("id = 4").select(F.md5(F.col("c").cast("binary")).alias("md5_hash"))
    assert sorted(r.id for r in D.new_assets(new, known, "id", "c").collect()) == [1, 3]


def test_metrics(spark):
    df = spark.createDataFrame([("q", ["x", "y"], ["p", "x", "q", "y"]), ("n", [], ["p"]), ("z", ["x"], None)], "question_id string, expected_ids array<string>, retrieved_ids array<string>")
    got = {(r.question_id, r.k): (r.hits, r.hit_rate, r.mrr) for r in E.metrics(df).collect()}
    assert got["q", 1] == (0, 0.0, 0.0) and got["q", 3] == (1, 0.5, 0.5) and got["q", 10] == (2, 1.0, 0.5)
    assert got["n", 10] == got["z", 1] == (0, 0.0, 0.0)
    s = spark.createDataFrame([(0.0,), (0.19,), (0.2,), (1.0,), (None,)], "score double").select(E.score_bin(F.col("score")).alias("b")).collect()
    assert [r.b for r in s][:4] == [1, 1, 2, 5]
    q = spark.createDataFrame([("s", "a")], "set_id string, question string")
    got = spark.createDataFrame([("a", ["1"], 1), ("a", ["2"], 2)], "question string, retrieved_ids array<string>, run_ord int")
    assert E.match_results(q, got).first().retrieved_ids == ["1"]
    assert [r.item_id for r in E.best_scores(spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 3.0)], "item_id string, score double"), 1).collect()] == ["a"]


def test_states(spark):
    a = spark.createDataFrame([("1", "uploaded"), ("2", "parsing"), ("3", "error"), ("4", "indexed")], "asset_id string, status string")
    c = spark.createDataFrame([("1", "parsed"), ("2", "parsed"), ("3", "parsing"), ("4", "parsing"), ("9", "error")], "asset_id string, new_status string")
    after, bad = K.transition(a, c)
    assert {r.asset_id: r.status for r in after.collect()} == {"1": "uploaded", "2": "parsed", "3": "parsing", "4": "parsing"}
    assert {r.asset_id: r.reason for r in bad.collect()} == {"1": "not allowed", "9": "no such asset"}
    assert a.select(K.next_status(F.col("status")).alias("n")).collect()[0].n == "parsing"
    gone = a.withColumn("is_active", F.lit(True))
    assert K.soft_delete(gone, a.where("asset_id = '1'")).where("is_active").count() == 3


def test_items(spark, tmp_path):
    i = spark.createDataFrame([("a", "T_1", "x 100% y", "d\\f.md", None, True), ("b", "T2", "other", "d/g.md", "a", True)], "id string, title string, content string, source_file string, parent_id string, is_vectorized boolean")
    assert [r.id for r in K.by_file(i, "z/f.md").collect()] == ["a"]
    assert [r.id for r in K.search_content(i, "100%").collect()] == ["a"] and K.search_content(i, "T_").count() == 1
    up = K.upsert(i, i.where("id = 'b'").withColumn("title", F.lit("new")))
    assert {r.id: (r.title, r.is_vectorized) for r in up.collect()} == {"a": ("T_1", True), "b": ("new", False)}
    assert {r.id: r.parent_title for r in K.parents(i).collect()} == {"a": None, "b": "T_1"}
    hits = spark.createDataFrame([("b", 1), ("a", 2), ("z", 3)], "id string, rank int")
    assert [r.id for r in K.with_parents(hits, i).orderBy("rank").collect()] == ["a", "a"]
    assert [r.id for r in K.by_ids(i, hits, "id").collect()] == ["b", "a"]
    assert K.delete_wrong(i, "other").count() == 1 and K.fix_item(i, "other", "fixed").where("content = 'fixed'").first().id == "b"
    assert {r.id: r.is_vectorized for r in K.mark(i.withColumn("is_vectorized", F.lit(False)), hits.where("rank = 1"), "id").collect()} == {"a": False, "b": True}
    m = spark.createDataFrame([("m1", "a"), ("m2", "b")], "mapping_id string, chunk_id string")
    left, maps = K.delete_document(i, m, "F.MD")
    assert [r.id for r in left.collect()] == ["b"] and [r.mapping_id for r in maps.collect()] == ["m2"]
    for n in (1, 2):
        K.commit(i.limit(n), str(tmp_path), "items")
    assert K.current(spark, str(tmp_path), "items").count() == 2
    assert [r.category_of for r in spark.createDataFrame([("a.C",), ("b.txt",), ("x",)], "f string").select(K.category_of(F.col("f")).alias("category_of")).collect()] == ["c_code", "log", "other"]


def test_feedback(spark):
    f = spark.createDataFrame([(1, False, "2024-01-01", None), (2, False, "2024-01-02", None), (3, True, "2024-01-03", "2024-01-04")], "id long, is_resolved boolean, created_at string, resolved_at string").withColumn("resolved_at", F.col("resolved_at").cast("timestamp"))
    assert [r.id for r in K.open_feedback(f).collect()] == [2, 1]
    done = K.resolve_feedback(f, f.where("id < 2"), "2024-02-01")
    assert {r.id for r in done.where("is_resolved").collect()} == {1, 3}


def test_registry_rows(spark, tmp_path):
    sets = spark.createDataFrame([("s",), ("t",)], "set_id string")
    qs = spark.createDataFrame([("q1", "s", 2), ("q2", "s", 4)], "qa_id string, set_id string, difficulty int")
    more = K.append(qs, spark.createDataFrame([("q3", "s")], "qa_id string, set_id string"))
    assert more.count() == 3 and more.columns == qs.columns
    assert {r.set_id: (r.question_count, r.avg_difficulty) for r in K.question_counts(sets, more).collect()} == {"s": (3, 3.0), "t": (0, None)}
    a = spark.createDataFrame([("1", "error"), ("2", "parsing")], "asset_id string, status string")
    after, tasks, bad = K.reprocess(a, a)
    assert {r.asset_id: r.status for r in after.collect()} == {"1": "parsing", "2": "parsing"}
    assert [r.asset_id for r in tasks.collect()] == ["1"] and [r.asset_id for r in bad.collect()] == ["2"]
    rows = spark.createDataFrame([("a", 1)], "id string, v int")
    assert K.upsert_counted(rows, spark.createDataFrame([("a", 2), ("b", 3)], "id string, v int"), str(tmp_path), "t") == 2
    assert {r.id: r.v for r in K.current(spark, str(tmp_path), "t").collect()} == {"a": 2, "b": 3}
    c = spark.createDataFrame([("x", "active"), ("y", "draft")], "config_id string, status string")
    assert {r.config_id: r.status for r in K.activate(c, "y").collect()} == {"x": "draft", "y": "active"}


def test_edit_ratios_in_bulk():
    """Bulk comparison gives what each pair gives alone, and costs a small part of it (block_slots and near_duplicate_blocks failed by time)."""
    r = random.Random(9)
    for letters, longest, threshold in (("ab", 12, 0.8), ("abcdef é漢", 500, 0.8), ("abc", 150, 0.5), ("abc", 200, 0.95)):
        heads = ["".join(r.choice(letters) for _ in range(r.randint(1, longest))) for _ in range(4)]
        texts = []
        for h in heads * 8:
            t = list(h)
            for _ in range(r.randint(0, len(h) // 3)):
                at = r.randrange(len(t) + 1)
                t[at : at + r.randint(0, 1)] = r.choice(["", "x", "yz"])
            texts.append("".join(t)[:500] or "a")
        codes, size, n = edits.coded(texts)
        i, j = (x.ravel() for x in np.indices((len(texts), len(texts))))
        want = [1.0 - D.edit_distance(texts[a], texts[b]) / max(len(texts[a]), len(texts[b])) >= threshold for a, b in zip(i, j, strict=True)]
        assert edits.similar(codes, size, n, i, j, threshold).tolist() == want
        grams = [Counter(t[k : k + 3] for k in range(len(t) - 2)) for t in texts]
        assert edits.common_grams(codes, n, 20, 12).tolist() == [[(a & b).total() for b in grams[12:]] for a in grams[:20]]
    texts = ["".join(r.choice("abcdefgh ") for _ in range(500)) for _ in range(200)]
    codes, size, n = edits.coded(texts)
    i, j = (x.ravel() for x in np.indices((100, 100)))
    began = time.process_time()
    edits.similar(codes, size, n, i, j + 100, 0.8)
    bulk = (time.process_time() - began) / len(i)
    began = time.process_time()
    for k in range(100):
        D.edit_distance(texts[k], texts[100 + k])
    assert 10 * bulk < (time.process_time() - began) / 100


def test_callers_hold_a_bounded_number_of_rows(spark, monkeypatch):
    """Tasks follow the number of edges, whatever their bytes (callers and callees put 4 million rows into one)."""
    monkeypatch.setattr("lodewell.plans.storage.TASK_ROWS", 100)
    edges = spark.range(2000).select(F.concat(F.lit("p"), F.col("id") % 40).alias("from_node"), F.concat(F.lit("s"), F.col("id") % 30).alias("to_node"))
    nodes = edges.select(F.col("to_node").alias("id")).where("id != 's7'")
    got = G.callers(edges, nodes)
    assert got.rdd.getNumPartitions() == 20
    want = {(f"s{i % 30}", f"p{i % 40}") for i in range(2000) if i % 30 != 7}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    back = G.callees(edges, edges.select(F.col("from_node").alias("id")))
    assert sorted(map(tuple, back.collect())) == sorted({(f"p{i % 40}", f"s{i % 30}") for i in range(2000)})
