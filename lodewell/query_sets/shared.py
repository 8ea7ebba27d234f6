"""How the driver's tables stand for the engine's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.plans.storage import table


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def items(spark: SparkSession, d: str) -> DataFrame:
    """Documents as knowledge items: item_id, source, title (first line), text, type, scene, subsystem."""
    line = F.element_at(F.split("text", "\n"), 1)
    return documents(spark, d).select(F.col("doc_id").alias("item_id"), "source", F.substring(line, 1, 40).alias("title"), "text", F.when(F.col("source") == "src1", "business_doc").otherwise("document_section").alias("type"), F.lit(None).cast("string").alias("scene"), F.lit(None).cast("string").alias("subsystem"))


def queries(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages as the query batch: their first three words."""
    b = table(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", r"\s+"), 1, 3), " ").alias("query"))


#: The same in DuckDB.
QUERIES_SQL = "q as (select item_id as query_id, array_to_string(regexp_split_to_array(text, '\\s+')[1:3], ' ') as query from benchmark)"
TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9_]+')"
