"""Text functions, tokens and chunkers on literal fixtures."""

import pytest
from pyspark.sql import functions as F

from lodewell.functions import text as X
from lodewell.functions import tokens as T
from lodewell.operators import chunk as C


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_bigrams_and_tokens(spark):
    assert one(spark, T._pairs, "骑a行 记录") == ["骑行", "行记", "记录"]
    assert one(spark, T.tfidf_tokens, "骑a行 记录") == ["a", "骑行", "行记", "记录"]
    assert one(spark, T._pairs, "骑") == [] and one(spark, T.tfidf_tokens, "") == []
    assert one(spark, T.bm25_tokens, "0x8005 dp_query") == ["0x8005", "dp", "query", "dp", "DP", "data", "Data"]
    assert one(spark, T.fts_prefixes, "ble 骑行记") == ["ble", "骑", "行", "记", "骑行", "行记", "骑行记"]


def test_forms(spark):
    assert one(spark, X.normalize_nfkc, "⾏⽤。，é") == "行用。,é"
    assert one(spark, X.normalize_forms, "⾏用个户") == "行用个户"
    assert one(spark, X.remove_zero_width, "a​b") == "ab"
    assert one(spark, X.normalize_punctuation, "‘a’ “b” 　") == "'a' \"b\"  "
    assert one(spark, F.length, "a😀b") == 3


def test_whitespace_pages_headers(spark):
    assert one(spark, X.normalize_whitespace, "  a \t b\r\nc\r\n\n\n\nd  ") == "a b\nc\n\nd"
    assert one(spark, X.remove_page_numbers, "a\n12\nb\nPage 3\nc\n第 4 页\nd") == "a\nb\nc\nd"
    assert one(spark, X.remove_headers_footers, "Page 3\nbody\n- 4 -") == "body"
    assert one(spark, X.remove_headers_footers, "12\n13") == "12\n13"


def test_html_table(spark):
    html = "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td><b>2</b></td></tr></table>"
    assert one(spark, X.html_table_to_markdown, html) == "| A | B |\n|---|---|\n| 1 | 2 |"
    assert one(spark, X.html_table_to_markdown, None) is None
    assert one(spark, X.remove_html_tags, "a<b>c</b>") == "ac"


@pytest.mark.parametrize(
    "lines,want",
    [
        (["short", "next line"], ["shortnext line"]),
        (["ends:", "next"], ["ends:", "next"]),
        (["1. item", "tail"], ["1. item", "tail"]),
        (["a", "- item"], ["a", "- item"]),
        (["a", "", "b"], ["a", "", "b"]),
        (["a", "b", "c"], ["ab", "c"]),
        (["x" * 30, "y"], ["x" * 30, "y"]),
    ],
)
def test_merge_lines(lines, want):
    assert X.merge_lines(lines) == want


def test_sanitize_and_clean(spark):
    assert one(spark, X.sanitize, "﻿a\x00b\x85\n\n\n\nc ") == "ab\n\nc"
    text = "⾏ <b>x</b>\r\n\r\n\r\n\r\ny"
    cleaned = one(spark, X.clean, text)
    assert cleaned == one(spark, X.clean, cleaned) and "<b>" not in cleaned


def test_quality(spark):
    good = one(spark, X.quality, "A plain line of text that is long enough.")
    assert good.score == 1.0 and good.is_quality and good.issues == []
    short = one(spark, X.quality, "tiny")
    assert not short.is_quality and short.issues == ["too short"] and abs(short.score - 0.9) < 1e-9
    bad = one(spark, X.quality, "ÀÈÌÒÙ" * 10)
    assert bad.garbage_ratio == 1.0 and "high garbage ratio" in bad.issues and abs(bad.score - 0.5) < 1e-9
    assert one(spark, X.garbage_ratio, "") == 1.0 and one(spark, X.structure_score, "a\n\n\n\n") == 0.2
    assert one(spark, X.garble_rate, "ab??�") == 60.0
    assert one(spark, X.looks_corrupted, "\x01\x02a") and not one(spark, X.looks_corrupted, "abc")


def test_hash_and_ratio(spark):
    import hashlib

    t = "A  b " * 30
    folded = " ".join(t.lower().split())
    want = min(hashlib.md5(folded[i : i + 50].encode()).hexdigest()[:8] for i in range(len(folded) - 49))
    assert one(spark, X.min_shingle_hash, t) == want
    assert one(spark, X.min_shingle_hash, "Ab") == hashlib.md5(b"ab").hexdigest()[:12]
    pairs = [("kitten", "sitting", 0.571429), ("ab", "abcdef", 0.0), ("same", "SAME", 1.0), ("", "x", 0.0)]
    df = spark.createDataFrame(pairs, "a string, b string, want double")
    assert all(abs(r.got - r.want) < 1e-6 for r in df.select("want", X.edit_ratio(F.col("a"), F.col("b")).alias("got")).collect())


def test_headings(spark):
    assert one(spark, X.heading, "3. 全程未连接") == ("全程未连接", 1)
    assert C.heading_of("3. 全程未连接") == ("全程未连接", 1)
    assert C.heading_of("第一章 总则") == ("总则", 0) and C.heading_of("2.1 Scope") == ("Scope", 2) and C.heading_of("plain") is None
    assert one(spark, X.heading, "plain") is None
    assert one(spark, X.is_list_item, "- a") and not one(spark, X.is_list_item, "a")


def test_fields(spark):
    assert one(spark, X.hex_fields, "0x03 0x8001 0x77 0x00FE01") == ["0x03", "0x8001", "0x00FE01"]
    assert one(spark, X.dp_ids, "dp_12 DP 3 数据点 12") == ["12", "3"]
    assert one(spark, X.hex_bytes, "0x0A ff") == (2, [10, 255]) and one(spark, X.hex_bytes, "0xz") == (None, None)
    assert one(spark, X.json_in, '<think>{no}</think>x {"a": 1} y') == '{"a": 1}'
    assert one(spark, X.log_level, "plain fail") == "ERROR" and one(spark, X.log_level, "ok") == "INFO"
    assert one(spark, X.scene, "在此场景下") == "场景下" and one(spark, X.scene, "x") == ""
    assert one(spark, lambda t: X.module_of(t, F.lit(None).cast("string")), "src/ble/x.c") == "BLE"
    assert one(spark, X.subsystem_of, "a\\gnss\\b.c") == "gil/gps"
    assert one(spark, lambda t: X.code_to_business(t, {"vl_ble": "蓝牙"}), "call vl_ble // x\n/* y */ end") == "call 蓝牙 end"
    assert one(spark, lambda t: X.image_description(F.lit(50), F.lit(60), t, F.lit(0)), "") == "图标/装饰图"
    assert one(spark, lambda t: X.image_description(F.lit(500), F.lit(300), t, F.lit(0)), "flow of") == "流程图"
    assert one(spark, lambda t: X.node_keywords(F.lit("function"), t, F.lit(True)), "f") == "function,has_params,f"
    assert one(spark, lambda t: X.block_name(F.lit("command"), t, F.lit("n"), F.lit(1)), "x 0x8001 y") == "命令_0x8001"


def test_fixed_windows(spark):
    df = spark.createDataFrame([(1, "x" * 2000), (2, None), (3, "  ")], "id long, t string")
    out = C.fixed_windows(df, "id", "t").orderBy("start").collect()
    assert [(r.start, len(r.content)) for r in out] == [(0, 800), (680, 800), (1360, 640)]
    with pytest.raises(ValueError):
        C.overlap_of(800, 100)


def test_header_and_semantic(spark):
    df = spark.createDataFrame([(1, "# a\nx\n## b\ny\n#### c")], "id long, t string")
    assert [r.content for r in C.header_sections(df, "id", "t").orderBy("nth").collect()] == ["# a\nx", "## b\ny\n#### c"]
    assert list(C.pack_paragraphs("aa\n\nbb\n\n" + "c" * 25, 10, 2)) == ["aa\n\nbb", "c" * 10, "c" * 10, "c" * 9, "c"]
    parts = list(C.semantic_parts("intro\n[表格 1 on Page 2] a|b\n[Page 3] more", 100, 10))
    assert parts == ["intro", "[表格 1 on Page 2] a|b\n", "[Page 3] more"]
    t = spark.createDataFrame([("k", "intro\n[表格 1 on Page 2] a")], "id string, t string")
    assert [r.has_table for r in C.semantic_windows(t, "id", "t").orderBy("nth").collect()] == [False, True]


def test_structure_chunks(spark):
    text = "preface\n\n# Title one here\nbody " + "word " * 30 + "\n## Sub\n" + "\n".join("line %03d of a long section with some words in it" % i for i in range(40))
    chunks = C.chunks_of(text)
    assert chunks[0]["title"] == "Section_0" and chunks[1]["type"] == "chapter"
    assert [c["type"] for c in chunks[2:]] == ["subsection"] * len(chunks[2:]) and len(chunks) > 4
    assert all(len(c["content"]) <= 1000 for c in chunks)
    joined = "\n".join(c["content"] for c in chunks)
    assert all(line.strip() in joined for line in text.split("\n"))
    out = C.structure_chunks(spark.createDataFrame([(1, text), (2, None)], "id long, t string"), "id", "t")
    assert out.count() == len(chunks)


def test_command_blocks(spark):
    text = "a" * 60 + "命令: 0x8001 " + "b" * 300 + " CMD AB12"
    out = C.command_blocks(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").orderBy("nth").collect()
    assert [r.command for r in out] == ["0x8001", "AB12"] and out[0].start == 60 and out[0].content == text[: 60 + len("命令: 0x8001") + 200]


def test_tables(spark):
    rows = [["A", "B"], ["1", "x" * 40], [None, "2"]]
    df = spark.createDataFrame([(rows,)], "r array<array<string>>")
    text = df.select(C.table_to_markdown(F.col("r")).alias("x")).first().x.split("\n")
    assert text[0].startswith("|  A  |  B") and set(text[1]) == {"|", "-"} and "..." in text[2] and len(text) == 4
    assert df.select(C.table_to_tsv(F.col("r")).alias("x")).first().x == "A\tB\n1\t" + "x" * 40 + "\n\t2"
    ok = spark.createDataFrame([([["a", "b"], ["c", "d"]],), ([["a", "b"]],), ([["a", ""], ["b", ""]],)], "r array<array<string>>")
    assert [r.x for r in ok.select(C.is_valid_table(F.col("r")).alias("x")).collect()] == [True, False, False]
    words = spark.createDataFrame([(1, 0.0, 5.0, 0.0, "a"), (1, 30.0, 35.0, 0.0, "b"), (1, 6.0, 9.0, 0.0, "c"), (1, 0.0, 5.0, 40.0, "d")], "k long, x0 double, x1 double, top double, word string")
    assert [r.cells for r in C.grid_from_words(words, "k").orderBy("row_no").collect()] == [["a c", "b"], ["d"]]
