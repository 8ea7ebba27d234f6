"""The build from files to items, and the knowledge base over them."""

import pytest
from pyspark.sql import functions as F

from lodewell import schemas
from lodewell.plans import ingest
from lodewell.plans.storage import materialize
from lodewell.plans.knowledge import KnowledgeBase, content_hashes, stale_files
from lodewell.sources import files as S

CODE = "int helper(int a) { return a; }\nint ble_pair(void) { return helper(1); }\n"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    (root / "ble").mkdir()
    (root / "ble/a.c").write_text(CODE)
    (root / "run.log").write_text("2024-01-01 10:00:00.123 [ERROR] [ble] - pair failed\n\nok")
    (root / "p.md").write_text("# BLE protocol pairing rules\n" + "The device pairs over ble when the button is held. " * 4 + "\n| name | id |\n|---|---|\n| pairing | 0x8001 |\n")
    (root / "x.docx").write_bytes(b"broken")
    (root / "z.bin").write_bytes(b"\0")
    items, bad = ingest.build(S.listing(spark, str(root), content=True))
    return materialize(items, "items"), materialize(bad, "bad")


def test_build(spark, built):
    items, bad = built
    assert items.schema.simpleString() == spark.createDataFrame([], schemas.KNOWLEDGE_ITEMS).schema.simpleString()
    assert {r.category for r in items.collect()} == {"c_code", "graph", "log", "protocol"}
    assert items.groupBy("id").count().where("count > 1").count() == 0
    assert {r.path.rpartition("/")[2] for r in bad.collect()} == {"x.docx", "z.bin"}
    assert items.where("category = 'log'").count() == 2 and items.where("type = 'table'").count() == 1
    assert ingest.is_garbled(items).where("needs_ocr").count() == 0


def test_search_and_changes(spark, built, tmp_path):
    kb = KnowledgeBase(built[0])
    ask = spark.createDataFrame([(1, "ble pair protocol"), (2, "error log"), (3, "helper")], "query_id int, query string")
    hits = kb.search(ask, 3).collect()
    assert {r.query_id for r in hits} == {1, 2, 3} and {r.category for r in hits if r.query_id == 2} == {"log"}
    assert kb.retrieve(ask, 1).count() == 3 and kb.search_expanded(ask, 2).count() >= 3
    chain = {r.id: r.callers for r in kb.call_chain(spark.createDataFrame([("func:helper",)], "id string")).collect()}
    assert chain == {"func:helper": ["func:ble_pair"]}
    n = built[0].count()
    one = built[0].where("category = 'log'").limit(1).select("id")
    kb.update(one.withColumn("title", F.lit("new")).withColumn("content", F.lit(None).cast("string")))
    assert kb.items.where("title = 'new'").count() == 1 and kb.items.count() == n
    kb.delete(one)
    assert kb.items.count() == n - 1 and kb.delete_category("graph").items.where("category = 'graph'").count() == 0
    kb.save(str(tmp_path))
    assert KnowledgeBase.load(spark, str(tmp_path)).items.count() == kb.items.count()
    assert kb.by_category("protocol").count() > 0 and kb.files("log").count() == 1 and kb.stats().count() >= 2
    assert kb.blocks("table").count() == 1 and kb.protocol_related().count() > 0 and KnowledgeBase.empty(spark).items.count() == 0


def test_vectors(spark, built):
    kb = KnowledgeBase(built[0]).vectorize()
    assert kb.items.where("not is_vectorized").count() == 0 and stale_files(kb.items, kb.vectors).count() == 0
    changed = kb.items.withColumn("content", F.when(F.col("category") == "log", F.lit("other")).otherwise(F.col("content")))
    assert [r.source_file.rpartition("/")[2] for r in stale_files(changed, kb.vectors).collect()] == ["run.log"]
    ask = spark.createDataFrame([(1, "ble pair")], "query_id int, query string")
    assert kb.search(ask, 3).count() > 0 and content_hashes(kb.items).count() == 3


def test_manual_rows(spark, built):
    rows = spark.createDataFrame([("code", "t", "x", "s"), ("faq", None, "y", None)], "content_type string, title string, content string, source string")
    items = ingest.route(rows)
    assert sorted((r.category, r.title, r.source_file) for r in items.collect()) == [("c_code", "t", "s"), ("protocol", "Untitled", "manual")]
    again, refused = ingest.add_new(items, items)
    assert again.count() == 2 and refused.count() == 2
