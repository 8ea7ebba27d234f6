"""Segmentation, folds in ranges and blocked products against brute force, with their plans."""

import itertools
import math
import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodewell.functions import segment as S
from lodewell.functions import tokens as T
from lodewell.operators import logs as L
from lodewell.operators import rank as R
from lodewell.plans import scan

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_best_split_of_all():
    dice = random.Random(4)
    for _ in range(300):
        counts = {"".join(dice.choice("abc") for _ in range(dice.randint(1, 4))): dice.randint(1, 50) for _ in range(dice.randint(0, 9))}
        own, run = S.Segmenter(counts), "".join(dice.choice("abcd") for _ in range(dice.randint(0, 8)))
        total = sum(counts.values()) or 1

        def weight(words):
            return sum(math.log(counts[w] if w in counts else 1) - math.log(total) if w in counts or len(w) == 1 else -math.inf for w in words)

        every = [[run[a:b] for a, b in itertools.pairwise([0, *cuts, len(run)])] for k in range(max(1, len(run))) for cuts in itertools.combinations(range(1, len(run)), k)] if run else [[]]
        got = own.split(run)
        assert "".join(got) == run and abs(weight(got) - max(map(weight, every))) < 1e-9, (counts, run)


def test_words_by_a_dictionary_differ_from_pairs(spark):
    own = S.Segmenter({"蓝牙": 50, "配对": 40, "蓝牙配对": 60, "升级": 30, "固件": 30, "件升": 1})
    df = spark.createDataFrame([(1, "蓝牙配对 failed 固件升级 dp_id"), (2, None), (3, ""), (4, "未知")], "id int, t string")
    got = {r.id: (r.w, r.b, r.k) for r in df.select("id", S.chinese_words(F.col("t"), own).alias("w"), S.bm25_words(own)(F.col("t")).alias("b"), S.key_words(F.col("t"), own).alias("k")).collect()}
    assert got[1][0] == ["蓝牙配对", "固件", "升级"] and got[4][0] == ["未", "知"] and got[2][0] == got[3][0] == []
    assert got[1][1] == ["failed", "dp", "id", "dp", "DP", "data", "Data", "蓝牙配对", "固件", "升级", "蓝牙配对固件", "固件升级"]
    assert "件升" in df.select(T.bm25_tokens(F.col("t"))).first()[0] and "件升" not in got[1][1]
    assert got[1][2] == ["dp_id", "failed", "升级", "固件", "蓝牙配对"]
    items = spark.createDataFrame([(1, "f", "硬件升温"), (2, "f", "固件升级")], "item_id int, scope string, text string")
    hits = R.bm25(items, spark.createDataFrame([(1, "件升")], "query_id int, query string"), tokenizer=S.bm25_words(own))
    assert [r.item_id for r in hits.collect()] == [1]  # by pairs, both
    assert R.bm25(items, spark.createDataFrame([(1, "件升")], "query_id int, query string")).count() == 2
    rows = spark.createDataFrame([("a", 3), ("b", 0), (None, 9), ("a", 1)], "w string, n int")
    assert S.dictionary(rows, "w", "n").counts == {"a": 4.0}
    deep = pickle.loads(pickle.dumps(S.Segmenter({"字" * 3000: 5, "符": 5})))
    assert deep.split("字" * 3000 + "符") == ["字" * 3000, "符"]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_sessions_of_one_log_in_ranges(spark, parts):
    dice = random.Random(parts)
    rows = [("a" if dice.random() < 0.8 else "b" if dice.random() < 0.8 else None, i, None if dice.random() < 0.15 else dice.choice([0, 1, 2, 4, 8]) + 3 * i, dice.random() < 0.9) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, n int, s int, present boolean").withColumn("t", F.timestamp_seconds("s"))
    for present in (None, F.col("present")):
        plain = L.gap_sessions(df, ["k"], ["n"], "t", 5.0, present)
        split = L.gap_sessions(df, ["k"], ["n"], "t", 5.0, present, parts=parts)
        assert split.columns == plain.columns and sorted(map(repr, split.collect())) == sorted(map(repr, plain.collect()))
    assert L.gap_sessions(df.where("false"), ["k"], ["n"], "t", parts=parts).count() == 0


def test_one_key_is_dealt_over_tasks(spark):
    e = spark.read.parquet(f"{D}/events.parquet").withColumn("log", F.lit("all"))
    ranges = scan.dealt(e, ["log"], ["ts", "event_id"], 16)
    sizes = [r["count"] for r in ranges.groupBy(scan.PART).count().collect()]
    assert len(sizes) > 8 and max(sizes) < e.count() / 4
    split = L.gap_sessions(e, ["log"], ["ts", "event_id"], "ts", 60.0, parts=16)
    assert "hashpartitioning(log" in plan(split) and "_part" in plan(split)
    summed = scan.running_sum(ranges.withColumn("one", F.lit(1)), ["log"], ["ts", "event_id"], "one", "upto")
    assert sorted(r.upto for r in summed.collect()) == list(range(1, e.count() + 1))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_blocked_products_equal_brute_force(spark, kind):
    dice = np.random.default_rng(1)
    centres = dice.normal(size=(5, 8)) * 6
    data = np.round(centres[dice.integers(0, 5, 900)] + dice.normal(size=(900, 8)), 3)
    data[100:400] = data[100]  # a third of the rows are one vector
    name = (lambda i: i) if kind == "long" else (lambda i: f"é{i}")
    rows = [(name(i), v.tolist()) for i, v in enumerate(data)]
    bad = [(name(9000), None), (name(9001), [1.0]), (name(9002), [None] * 8), (name(9003), [float("nan")] * 8), (None, [9.0] * 8), (name(9004), [float("inf")] * 8)]
    v = spark.createDataFrame(rows + bad, f"item_id {kind}, vector array<double>").repartition(5)
    asked = data[[3, 100, 500, 800]]
    q = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(asked)] + [(9, None)], "query_id int, vector array<double>")
    for most in (2, 5000):
        for k in (1, 7, 950):
            got = {}
            for r in R.dense(v, q, k, most).collect():
                got.setdefault(r.query_id, {})[r["rank"]] = (r.item_id, r.score)
            assert set(got) == set(range(len(asked)))
            for i, a in enumerate(asked):
                want = sorted((-round(float(s), 12), name(j)) for j, s in enumerate(data @ a))[:k]
                found = [got[i][n + 1] for n in range(len(got[i]))]
                assert len(found) == len(want) and all(abs(s + w) < 1e-9 for (_, s), (w, _) in zip(found, want, strict=True))
                if k == 1:
                    assert found[0][0] == want[0][1]
    p = plan(R.dense(v, q, 5))
    assert "NestedLoop" not in p and "Cartesian" not in p and "MapInArrow" in p
    assert R.dense(v.where("false"), q, 5).count() == R.dense(v, q.where("false"), 5).count() == 0


def test_far_blocks_are_left_out():
    asked = np.array([[1.0, 0.0]])
    heap = R._Heap(asked, 2)
    heap.add(np.array([1, 2, 3]), np.array([[5.0, 0], [4.0, 1], [3.0, 0]]))
    assert heap.ids[0].tolist() == [1, 2] and heap.floor[0] == 4.0
    heap.add(np.array([0]), np.array([[4.0, 0.0]]))  # a tie with the last: the lower id goes in
    assert heap.ids[0].tolist() == [1, 0]
    before = heap.scores[0]
    heap.add(np.array([7, 8]), np.array([[1.0, 50.0], [1.5, 50.0]]))
    assert heap.scores[0] is before

