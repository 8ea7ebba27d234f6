"""Queries against their SQL on small tables of their own, for what the given tables do not show."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodewell.functions import segment as S
from lodewell.functions import tokens as T
from lodewell.operators import index
from lodewell.operators import rank as R
from lodewell.query_sets import events, readers, registry, search
from lodewell.sources import files, pdf


def against_sql(spark, tmp_path, name, **tables):
    """(rows of the query, rows of its SQL), sorted, over the given DataFrames."""
    con = duckdb.connect()
    for table, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    own = __spark_entry__.queries()[name](spark, str(tmp_path))
    sql = con.sql(f"select {', '.join(own.columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, own.collect())), sorted(sql)


def test_line_ends_of_a_text_are_no_corruption_of_the_query(spark, tmp_path):
    docs = spark.createDataFrame([(1, "e" + "x" * 30 + "\n\t\n"), (2, "ee" + "x" * 30), (3, "e\x80\xa0\x00" + "x" * 40)], "doc_id long, text string")
    own, sql = against_sql(spark, tmp_path, "text_corrupted", documents=docs)
    assert own == sql == [(1, False), (2, True), (3, False)]


def test_a_dictionary_of_any_size_splits_as_a_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S.dictionary, "__defaults__", (2,))  # the query's dictionary has no such limit
    docs = spark.createDataFrame([(i, "the cat sat on them all") for i in range(6)] + [(9, "cats once the the")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "The cats at on, them ALL"), (2, "zz9"), (3, "123"), (4, None), (5, "satall")], "item_id long, text string")
    own, sql = against_sql(spark, tmp_path, "segmented_passages", documents=docs, benchmark=asked)
    assert own == sql and dict((r[0], r[1]) for r in own)[5] == "sat all"


def test_runs_split_by_a_table_as_by_a_segmenter(spark):
    counts = {"ab": 5, "a": 2, "abc": 1, "bc": 9, "d" * 40: 3, "": 4, "e": 0}
    runs = [(1, "abcabc"), (2, ""), (3, None), (4, "d" * 41 + "ab"), (5, "q"), (6, "e")]
    table = spark.createDataFrame(list(counts.items()), "w string, n int")
    got = {r.k: r.words for r in S.split_by_table(spark.createDataFrame(runs, "k int, run string"), "k", "run", table, "w", "n").collect()}
    assert got == {k: None if run is None else S.Segmenter(counts).split(run) for k, run in runs}
    none = S.split_by_table(spark.createDataFrame(runs, "k int, run string"), "k", "run", table.where("false"), "w", "n")
    assert {r.k: r.words for r in none.collect()}[1] == list("abcabc")


def test_copies_tie_to_the_last_bit(spark, tmp_path):
    rows = [(i, "f", f"alpha beta gamma {'delta ' * (i % 7)}" if i % 2 else "alpha beta delta delta gamma omega") for i in range(600)]
    docs = spark.createDataFrame([*rows, *[(i, "f", ["alpha", "beta beta", "omega"][i % 3]) for i in range(600, 1100)]], "doc_id long, source string, text string")
    asked = spark.createDataFrame([(1, "gamma alpha beta")], "item_id long, text string")
    docs.repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    asked.write.parquet(f"{tmp_path}/benchmark.parquet")
    hits = __spark_entry__.queries()["bm25_top10"](spark, str(tmp_path)).orderBy("rank").collect()
    assert len(hits) == 10 and [(r.score, r.doc_id) for r in hits] == sorted([(r.score, r.doc_id) for r in hits], key=lambda r: (-r[0], r[1]))
    parts = spark.createDataFrame([(k, x) for k, own in enumerate(([0.1, 0.7, 0.3], [0.3, 0.1, 0.7], [0.7, 0.3, 0.1])) for x in own], "k int, x double").coalesce(1)
    assert parts.groupBy("k").agg(R._ordered_sum(F.col("x")).alias("s")).select("s").distinct().count() == 1


def test_files_made_of_a_small_table_are_dealt_over_tasks(spark):
    d = "/root/testdata/sf0.001"
    for made in (readers._ruled(spark, d), registry._pdfs(spark, d), events._code(spark, d)):
        assert made.rdd.getNumPartitions() >= 4  # the table itself is one split
    data = [bytes(r.content) for r in readers._ruled(spark, d).limit(3).collect()] + [b"%PDF-1.4\n1 0 obj << /Type /Page /Contents 2 0 R >> endobj\n2 0 obj << /Length 99 >> stream\nBT /F1 9 Tf 2 Tc 3 Tw (a\xa0b  c) Tj () Tj [(d) -900 (e)] TJ <6667> Tj ET\nendstream endobj"]
    for x in data:
        assert [s.words for s in pdf.read(x, words_only=True)] == [s.words for s in pdf.read(x)]
    words = pdf.read(data[-1])[0].words
    assert [w.text for w in words] == ["a", "b", "cd", "efg"] and words[1].x0 == 2 * 6.5 and words[2].x0 == 5 * 6.5 + 2 * 3


def test_whole_texts_go_to_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for name in ("text_clean", "chunks_structure", "chunks_semantic"):
        spark.conf.set(key, "10000")
        __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(key)) <= 512, name


def test_terms_are_counted_where_their_items_are(spark, monkeypatch):
    monkeypatch.setattr(index, "TASK_ITEMS", 3)
    rows = spark.createDataFrame([(i, "f", "b a b") for i in range(20)] + [(3, "f", "b a b"), (4, "f", "c"), (5, "g", None)], "item_id long, scope string, text string")
    tf = index.term_frequencies(rows)
    plan = tf._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and tf.rdd.getNumPartitions() >= 8  # texts move, terms do not
    got = {(r.item_id, r.token, r.dl): (r.tf, r.pos) for r in tf.collect()}
    assert len(got) == 41 and got[0, "b", 3] == (2, 0) and got[3, "b", 3] == (4, 0) and got[4, "c", 1] == (1, 0)


def test_blank_and_odd_texts_are_parsed_as_in_the_sql(spark, tmp_path):
    texts = ["", " \n", "x\n| a | b\nc", "|", "| a |\nb", "end\xa0", "end\x85\n", "end \t\r\n", " ", "plain"]
    rows = [(2 * i + odd, "s", t) for i, t in enumerate(texts) for odd in (0, 1)] + [(1000, None, "no path")]
    own, sql = against_sql(spark, tmp_path, "parsed_files", documents=spark.createDataFrame(rows, "doc_id long, source string, text string"))
    assert own == sql and len(own) == 30
    pages = files.read_markdown(b"| a | b |\n\n# A\n| h |\n|---|\n| 1 |\n\n# B\n| h |\n| :-: |\n\nend\n\n# C\n|-|")
    assert [(p.text[-3:], p.tables) for p in pages] == [("b |", []), ("|\n\n", [[["h"], ["1"]]]), ("end", [[["h"]]]), ("|-|", [])]


def test_a_query_is_searched_in_all_of_its_files(spark, tmp_path):
    rows = [(10 * s + i, f"s{s:02d}", f"alpha beta gamma {'delta ' * (s % 5 + i)}omega{s}") for s in range(30) for i in range(2)]
    rows += [(1000 + i, "s29", "alpha beta gamma" if i < 2 else "delta") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    own, sql = against_sql(spark, tmp_path, "hybrid_search", documents=docs, benchmark=spark.createDataFrame([(1, "alpha beta gamma"), (2, "s29 doc_1004 none"), (3, "omega7 x y")], "item_id long, text string"))
    assert own == sql and {r[2] for r in own} >= {"s29"}  # the file with most items, which comes last among candidates


def test_a_query_builds_only_the_parts_of_the_index_that_it_reads(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    rows, names = search._rows(spark, d), spark.createDataFrame([("src1", "src1")], "scope string, token string")
    kept = index.Kept.build(rows, names, root=str(tmp_path / "index"), layout=index.Layout(buckets=4, size=40), parts=("tokens",))
    assert kept.parts == ("tokens",) and set(kept.manifest["segments"][0]["schemas"]) == {"files", "tokens"}
    want = index.vocabulary(index.term_frequencies(rows), 40).select("scope", "token").collect()  # ties at the cut by first item and place
    assert sorted(map(tuple, kept.table("tokens").select("scope", "token").distinct().collect())) == sorted(map(tuple, want))
    tied = spark.createDataFrame([(i, "f", " ".join(f"w{(j * 7 + i) % 90}" for j in range(90))) for i in range(3)], "item_id long, scope string, text string")
    for size in (1, 40, 89, 90):
        got = index._chosen(tied, index.term_frequencies(tied), size).collect()
        assert sorted(r.token for r in got) == sorted(r.token for r in index.vocabulary(index.term_frequencies(tied), size).collect())
    queries = spark.createDataFrame([(1, "the of")], "query_id int, query string")
    with pytest.raises(ValueError):
        kept.matches(queries)
    whole = kept.with_parts(rows, names, ("full", "words"))
    assert whole.parts == ("words", "tokens", "full") and whole.matches(queries).count() > 0 and R.bm25_top(whole, queries, 3).count() > 0
    assert index.Kept.open(spark, kept.root).parts == whole.parts and whole.with_parts(rows, names, ("tokens",)) is whole


def test_postings_move_once_to_their_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "FILE_ITEMS", 10)
    writer = index._Writer(spark, str(tmp_path), index.Layout(buckets=4), {}, items=100)
    df = spark.range(1000).select(F.lit("f").alias("scope"), (F.col("id") % 50).alias("item_id"), F.concat(F.lit("t"), F.col("id") % 30).alias("token"))
    plans = []
    monkeypatch.setattr(index._Writer, "write", lambda self, df, *_: plans.append(df) or df)
    writer.put(df, "tokens", ("scope",), ("item_id",))
    text = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in text and text.count("Exchange") == 1 and plans[0].rdd.getNumPartitions() == 12
    assert all(len({r.bucket for r in part}) <= 1 for part in plans[0].rdd.glom().collect())


def test_texts_are_split_into_tokens_once(spark):
    rows = spark.createDataFrame([(i, "f", "b a b" if i % 2 else "") for i in range(20)] + [(30, "g", None)], "item_id long, scope string, text string").select("scope", "item_id", "text")
    for made in (index.term_frequencies(rows), index.term_frequencies(rows, T.bm25_tokens), index.fts_postings(rows)):
        text = made._jdf.queryExecution().optimizedPlan().toString()
        below = text.partition("Repartition")[2]
        assert "Filter" not in below and not any("regexp" in line for line in text.splitlines() if "Filter" in line), text
    assert {(r.item_id, r.token, r.tf, r.pos, r.dl) for r in index.term_frequencies(rows).collect()} == {(i, t, n, p, 3) for i in range(1, 20, 2) for t, n, p in (("b", 2, 0), ("a", 1, 1))}
    assert sorted(map(tuple, index.fts_postings(rows).collect())) == [("f", "a"), ("f", "b")]
