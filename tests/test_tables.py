"""Keyed tables: what a commit writes, and who sees it."""

import pytest
from pyspark.sql import functions as F

from lodewell import schemas
from lodewell.operators import registry as K
from lodewell.plans import versions
from lodewell.plans.knowledge import KnowledgeBase
from lodewell.plans.tables import Table


@pytest.fixture
def rows(spark):
    return spark.range(2000).select("id", (F.col("id") % 10).alias("v"), F.lit(True).alias("is_vectorized"))


def test_a_commit_writes_only_the_buckets_it_touches(spark, rows, tmp_path):
    t = Table.create(rows, str(tmp_path / "t"), buckets=32)
    new = spark.range(1995, 2005).select("id", F.lit(99).cast("long").alias("v"), F.lit(True).alias("is_vectorized"))
    u = t.upsert(new)
    changed = [b for b in u.manifest["files"] if u.manifest["files"][b] != t.manifest["files"][b]]
    assert 0 < len(changed) <= 10 and u.number == t.number + 1
    assert {r.id: r.v for r in u.rows().where("id >= 1994").collect()} == {1994: 4, **{i: 99 for i in range(1995, 2005)}}
    assert u.rows().where("v = 99 and is_vectorized").count() == 0 and u.rows().count() == 2005
    assert t.rows().count() == 2000 and t.rows().where("v = 99").count() == 0  # readers keep their version
    assert Table.open(spark, t.root).number == u.number and Table.open(spark, t.root, 1).rows().count() == 2000
    read = u.lookup(new.where("id = 2000"))
    assert len(read.inputFiles()) < len(u.rows().inputFiles()) and [r.v for r in read.collect()] == [99]
    assert u.mark(new).rows().where("v = 99 and is_vectorized").count() == 10
    left = Table.open(spark, t.root).delete(rows.select("id"))
    assert sorted(r.id for r in left.rows().collect()) == list(range(2000, 2005))
    assert left.vacuum(1) > 0 and left.rows().count() == 5
    assert left.upsert(new.where("false")) is left
    assert left.delete(left.rows()).rows().count() == 0


def test_of_two_writers_one_fails(spark, rows, tmp_path):
    a = Table.create(rows, str(tmp_path / "t"), buckets=4)
    b = Table.open(spark, a.root)
    a.delete(rows.where("id = 1"))
    before = versions.children(spark, f"{a.root}/data")
    with pytest.raises(versions.Conflict):
        b.delete(rows.where("id = 2"))
    assert versions.children(spark, f"{a.root}/data") == before
    with pytest.raises(versions.Conflict):
        Table.create(rows, a.root)
    now = Table.open(spark, a.root)
    assert now.rows().count() == 1999 and now.rows().where("id = 2").count() == 1
    # a version that its writer has not finished is not read, and not overtaken
    (tmp_path / "t" / "versions" / "v3.json").write_text('{"fi')
    assert Table.open(spark, a.root).number == 2
    with pytest.raises(versions.Conflict):
        now.delete(rows.where("id = 2"))


def test_null_and_repeated_keys(spark, tmp_path):
    rows = spark.createDataFrame([(None, 1), (1, 1), (1, 2)], "id long, v int")
    t = Table.create(rows, str(tmp_path / "t"), buckets=4)
    assert t.rows().count() == 3
    assert t.append(rows).rows().count() == 6
    assert Table.open(spark, t.root).upsert(spark.createDataFrame([(1, 7)], "id long, v int")).rows().where("id = 1").count() == 1
    empty = Table.create(rows.where("false"), str(tmp_path / "e"), buckets=4)
    assert empty.rows().count() == 0 and empty.upsert(rows.where("id = 1 and v = 1")).rows().count() == 1


def test_whole_tables_are_versioned_too(spark, tmp_path):
    for n in (1, 2):
        K.commit(spark.range(n), str(tmp_path), "t")
    assert K.current(spark, str(tmp_path), "t").count() == 2
    with pytest.raises(FileNotFoundError):
        K.current(spark, str(tmp_path), "none")


def test_a_stored_knowledge_base(spark, tmp_path):
    base = KnowledgeBase.empty(spark).items
    row = {f.name: None for f in schemas.KNOWLEDGE_ITEMS.fields} if hasattr(schemas.KNOWLEDGE_ITEMS, "fields") else {n: None for n in base.columns}
    rows = spark.createDataFrame([row | {"id": i, "title": i, "content": "ble pairing", "source_file": "a.md", "category": c, "is_vectorized": False} for i, c in (("x", "p"), ("y", "q"))], base.schema)
    kb = KnowledgeBase.stored(spark, str(tmp_path / "kb"), rows, buckets=4)
    kb.update(spark.createDataFrame([("x", "new")], "id string, title string"), ("title",)).vectorize()
    again = KnowledgeBase.stored(spark, str(tmp_path / "kb"))
    assert {r.id: (r.title, r.is_vectorized) for r in again.items.collect()} == {"x": ("new", True), "y": ("y", True)}
    assert again.delete_category("p").items.count() == 1
    assert again.add(rows).items.count() == 2 and again.delete(rows).items.count() == 0
