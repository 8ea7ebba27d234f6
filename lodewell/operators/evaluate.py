"""Evaluation of retrieval: hits, recall, reciprocal rank, histograms, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_results(questions: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Ground-truth questions with what was retrieved for the same text; the first answer on ties, null if none."""
    first = retrieved.withColumn("_n", F.row_number().over(Window.partitionBy("question").orderBy("run_ord"))).where("_n = 1").select("question", "retrieved_ids")
    return questions.join(first, "question", "left")


def metrics(rows: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(question_id, k, hits, hit_rate, mrr) for each k, from arrays expected_ids and retrieved_ids.

    hits counts distinct expected ids in the first k; hit_rate is their share; mrr the reciprocal place of the first.
    """
    asked = rows.select("question_id", F.array_distinct(F.coalesce("expected_ids", F.array().cast("array<string>"))).alias("want"), F.coalesce("retrieved_ids", F.array().cast("array<string>")).alias("got"), F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    cut = asked.withColumn("got", F.expr("slice(got, 1, k)"))
    hits = F.size(F.array_intersect("got", "want"))
    first = F.array_position(F.transform("got", lambda x: F.array_contains("want", x)), F.lit(True))
    return cut.select("question_id", "k", hits.alias("hits"), F.when(F.size("want") > 0, hits / F.size("want")).otherwise(0.0).alias("hit_rate"), F.when(first > 0, 1.0 / first).otherwise(0.0).alias("mrr"))


def hit_metrics(hits: DataFrame, wants: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """`metrics` from counts: hits (question_id, rank) are the retrieved ids that were expected, wants (question_id,
    want) how many are; no list of expected ids is made."""
    asked = wants.select("question_id", "want", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    met = asked.join(hits.select("question_id", F.col("rank").alias("r")), "question_id", "left").withColumn("r", F.when(F.col("r") <= F.col("k"), F.col("r")))
    found = met.groupBy("question_id", "k").agg(F.count("r").cast("int").alias("hits"), F.max("want").alias("want"), F.min("r").alias("first"))
    return found.select("question_id", "k", "hits", F.when(F.col("want") > 0, F.col("hits") / F.col("want")).otherwise(0.0).alias("hit_rate"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


def score_bin(score: Column, bins: int = 5) -> Column:
    """Equal bins of 0 to 1, from 1; 1.0 lies in the last."""
    return F.least(F.lit(bins), F.greatest(F.lit(1), F.floor(score * bins).cast("int") + 1))


def score_histogram(scored: DataFrame, keys: list[str], bins: int = 5) -> DataFrame:
    return scored.withColumn("bin", score_bin(F.col("score"), bins)).groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def aggregate_metrics(evaluations: DataFrame, keys: list[str]) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return evaluations.groupBy(*keys).agg(zero(F.avg("hit_rate")).alias("avg_hit_rate"), zero(F.avg("mrr")).alias("avg_mrr"), F.count("*").alias("n"), F.sum("hits").alias("total_hits"))


def compare_configs(configs: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Configurations with their averages, best first, and whether each is the best."""
    totals = aggregate_metrics(evaluations, ["config_id"])
    rows = configs.select("config_id").join(totals, "config_id", "left").select("config_id", F.coalesce("avg_hit_rate", F.lit(0.0)).alias("avg_hit_rate"), F.coalesce("avg_mrr", F.lit(0.0)).alias("avg_mrr"), F.coalesce("n", F.lit(0)).alias("n"))
    best = rows.agg(F.min_by("config_id", F.struct((-F.col("avg_hit_rate")).alias("h"), F.col("config_id").alias("i"))).alias("best_id"))
    return rows.join(F.broadcast(best)).withColumn("is_best", F.col("config_id") == F.col("best_id")).drop("best_id").orderBy(F.desc("avg_hit_rate"), "config_id")


def document_recall(evaluations: DataFrame, questions: DataFrame) -> DataFrame:
    """(source, recall): the mean hit rate of the questions about each source, joined on set and question text."""
    return evaluations.join(questions.select("set_id", "question", "source").distinct(), ["set_id", "question"]).groupBy("source").agg(F.avg("hit_rate").alias("recall"))


def keyword_coverage(hits: DataFrame, keywords: DataFrame, passing: float = 0.4) -> DataFrame:
    """(query_id, matched, total, coverage, satisfactory): keywords that occur in any of a query's hits.

    hits: query_id, text; keywords: query_id, keyword. A query without keywords is covered at 0.
    """
    met = keywords.distinct().join(hits, "query_id", "left")
    found = met.groupBy("query_id", "keyword").agg(F.max(F.coalesce(F.lower("text").contains(F.lower("keyword")), F.lit(False))).alias("found"))
    return found.groupBy("query_id").agg(F.count_if("found").alias("matched"), F.count("*").alias("total")).withColumn("coverage", F.col("matched") / F.col("total")).withColumn("satisfactory", F.col("coverage") >= passing)


def best_iteration(runs: DataFrame) -> DataFrame:
    """(question_id, best_iteration, coverage): the iteration of highest coverage, the earliest on ties."""
    return runs.groupBy("question_id").agg(F.min_by("iteration", F.struct((-F.col("coverage")).alias("c"), F.col("iteration").alias("i"))).alias("best_iteration"), F.max("coverage").alias("coverage"))


def best_scores(hits: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, score): the best score of each item over categories and query variants, the first k."""
    return hits.groupBy("item_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "item_id").limit(k)
