"""Assets, experiments, questions, provenance and knowledge items as DataFrames: lists, upserts, state changes.

Without a transactional table format an update is a new DataFrame over the old one; `commit` writes it as the
next version of a table and never reads and overwrites the same path.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodewell.operators.dedup import latest
from lodewell.plans import versions

#: Allowed changes of an asset's state.
TRANSITIONS = {"uploaded": ("parsing", "error"), "parsing": ("parsed", "error"), "parsed": ("indexing", "error"), "indexing": ("indexed", "error"), "indexed": ("parsing",), "error": ("parsing", "uploaded")}
#: What an experiment may be set to.
CHUNK_SIZES, OVERLAPS = (500, 800, 1000), (0.10, 0.15)
SPLITTERS = ("fixed", "header", "semantic")
#: Upload types and the categories of their contents.
CATEGORIES = {"c": "c_code", "h": "c_code", "log": "log", "txt": "log", "pdf": "protocol", "docx": "protocol", "xlsx": "protocol", "md": "protocol"}


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def list_rows(rows: DataFrame, filters: dict[str, object], order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """Rows that equal every given filter, in order, one page of them."""
    for name, value in filters.items():
        if value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    return page(rows, order, limit, offset)


def category_of(file_name: Column) -> Column:
    ext = F.lower(F.element_at(F.split(file_name, r"\."), -1))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv]), ext), F.lit("other"))


def allowed(old: Column, new: Column) -> Column:
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, bs in TRANSITIONS.items() for b in bs]
    return F.array_contains(F.array(*pairs), F.struct(old.alias("a"), new.alias("b")))


def next_status(status: Column) -> Column:
    """The state that follows on success; null at the end and from error."""
    steps = {"uploaded": "parsing", "parsing": "parsed", "parsed": "indexing", "indexing": "indexed"}
    return F.element_at(F.create_map(*[F.lit(x) for kv in steps.items() for x in kv]), status)


def transition(assets: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assets after the legal changes, rejected changes with reason); changes: asset_id, new_status."""
    met = changes.join(assets.select("asset_id", "status"), "asset_id", "left")
    ok = F.coalesce(allowed(F.col("status"), F.col("new_status")), F.lit(False))
    good = met.where(ok).select("asset_id", "new_status")
    bad = met.where(~ok).select("asset_id", "status", "new_status", F.when(F.col("status").isNull(), "no such asset").otherwise("not allowed").alias("reason"))
    after = assets.join(good, "asset_id", "left").withColumn("status", F.coalesce("new_status", "status")).select(*assets.columns)
    return after, bad


def soft_delete(assets: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select("asset_id", F.lit(True).alias("_gone")).distinct()
    return assets.join(gone, "asset_id", "left").withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).select(*assets.columns)


def hard_delete(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


def upsert(rows: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Replace on the key, the last writer winning; what is replaced loses its vector mark."""
    both = rows.withColumn("_seq", F.lit(0).cast("long")).unionByName(new.withColumn("_seq", F.monotonically_increasing_id() + 1).withColumn("is_vectorized", F.lit(False)) if "is_vectorized" in new.columns else new.withColumn("_seq", F.monotonically_increasing_id() + 1))
    return latest(both, key, "_seq").drop("_seq")


def patch(rows: DataFrame, changes: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Partial update: non-null values of the given columns replace the old ones; changed rows lose their vector mark."""
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    met = rows.join(new, key, "left")
    touched = reduce(lambda a, b: a | b, [F.col(f"_{c}").isNotNull() for c in columns])
    out = met.withColumn("_t", touched)
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    if "is_vectorized" in rows.columns:
        out = out.withColumn("is_vectorized", F.col("is_vectorized") & ~F.col("_t"))
    return out.select(*rows.columns)


def mark(rows: DataFrame, ids: DataFrame, key: str, column: str = "is_vectorized") -> DataFrame:
    hit = ids.select(key, F.lit(True).alias("_hit")).distinct()
    return rows.join(hit, key, "left").withColumn(column, F.col(column) | F.col("_hit").isNotNull()).select(*rows.columns)


def by_ids(rows: DataFrame, ranked: DataFrame, key: str, k: int | None = None) -> DataFrame:
    """Rows of the ranked ids, in rank order; missing ids fall out."""
    out = ranked.join(rows, key).orderBy("rank", key)
    return out.limit(k) if k is not None else out


def by_file(items: DataFrame, path: str) -> DataFrame:
    """Items of a file, by its path or by its base name."""
    path = path.replace("\\", "/")
    own = F.translate("source_file", "\\", "/")
    return items.where((own == path) | own.endswith(path.rpartition("/")[2]))


def like(text: Column, word: str) -> Column:
    """Case-folded substring test, with % and _ taken as themselves."""
    return F.lower(text).contains(word.lower())


def search_content(items: DataFrame, word: str, limit: int = 10, filters: dict[str, object] | None = None) -> DataFrame:
    rows = items.where(like(F.col("content"), word) | like(F.col("title"), word))
    return list_rows(rows, filters or {}, [F.col("id")], limit)


def document_content(items: DataFrame, source: str, limit: int = 50, joiner: str = "\n\n") -> DataFrame:
    rows = items.where(like(F.col("source_file"), source)).orderBy("id").limit(limit)
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "content"))), lambda x: x["content"]), joiner).alias("content"), F.count("*").alias("n"))


def summary_input(items: DataFrame, chunks: int = 10, longest: int = 5000) -> DataFrame:
    """(source_file, text): the first chunks of every file joined, cut to `longest` characters."""
    w = Window.partitionBy("source_file").orderBy("id")
    first = items.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= chunks)
    return first.groupBy("source_file").agg(F.substring(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "content"))), lambda x: x["content"]), "\n"), 1, longest).alias("text"))


def parents(items: DataFrame) -> DataFrame:
    """(id, parent_id, parent_title, parent_content): one step up."""
    up = items.select(F.col("id").alias("parent_id"), F.col("title").alias("parent_title"), F.col("content").alias("parent_content"))
    return items.select("id", "parent_id").join(up, "parent_id", "left").select("id", "parent_id", "parent_title", "parent_content")


def with_parents(hits: DataFrame, items: DataFrame) -> DataFrame:
    """Hits (id, rank) as their parents where there are any, else as themselves."""
    child = items.select("id", "parent_id", F.col("title").alias("c_title"), F.col("content").alias("c_content"))
    up = items.select(F.col("id").alias("p_id"), F.col("title").alias("p_title"), F.col("content").alias("p_content"))
    met = hits.join(child, "id").join(up, F.col("parent_id") == F.col("p_id"), "left")
    return met.select("rank", F.coalesce("p_id", "id").alias("id"), F.coalesce("p_title", "c_title").alias("title"), F.coalesce("p_content", "c_content").alias("content"))


def valid_configs(configs: DataFrame) -> DataFrame:
    return configs.where(F.col("chunk_size").isin(*CHUNK_SIZES) & F.col("overlap_ratio").isin(*OVERLAPS) & F.col("splitter_type").isin(*SPLITTERS))


def activate(configs: DataFrame, config_id: str) -> DataFrame:
    """One active configuration: the given one; the one before becomes a draft."""
    now = F.when(F.col("config_id") == config_id, "active").when(F.col("status") == "active", "draft").otherwise(F.col("status"))
    return configs.withColumn("status", now)


def shadow_names(configs: DataFrame) -> DataFrame:
    """(config_name, next_version): one more than the shadow versions so far."""
    return configs.groupBy("config_name").agg((F.count_if("is_shadow") + 1).alias("next_version"))


def provenance(mappings: DataFrame, assets: DataFrame) -> DataFrame:
    """Chunk mappings with their assets, by asset and chunk."""
    return mappings.join(assets.select("asset_id", "file_name", "category", "status"), "asset_id")


def page_spans(mappings: DataFrame) -> DataFrame:
    """(asset_id, pages, regions): the last page of each asset and its highlighted chunks, by page and chunk."""
    return mappings.groupBy("asset_id").agg(F.max("original_page_number").alias("pages"), F.sort_array(F.collect_list(F.struct("original_page_number", "chunk_index", "chunk_id"))).alias("regions"))


def delete_document(items: DataFrame, mappings: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Items less those of a document, and the mappings less those of its chunks."""
    gone = items.where(like(F.col("source_file"), name)).select(F.col("id").alias("chunk_id"))
    return items.where(~F.coalesce(like(F.col("source_file"), name), F.lit(False))), mappings.join(gone, "chunk_id", "left_anti")


def index_status(files: DataFrame, items: DataFrame, summaries: DataFrame) -> DataFrame:
    """(path, name, status, n_items, summary): found files against what is indexed, by base name."""
    base = lambda c: F.element_at(F.split(F.translate(c, "\\", "/"), "/"), -1)
    counted = items.groupBy(base(F.col("source_file")).alias("name")).agg(F.count("*").alias("n_items"))
    rows = files.select("path", base(F.col("path")).alias("name"))
    met = rows.join(counted, "name", "left").join(summaries.select("name", "summary"), "name", "left")
    return met.select("path", "name", F.when(F.col("n_items").isNotNull(), "indexed").otherwise("pending").alias("status"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "summary")


def merge_graph_hits(normal: DataFrame, graph: DataFrame) -> DataFrame:
    """Graph hits not found otherwise are appended; ordinary hits come first, then score, then id."""
    fresh = graph.join(normal.select("id"), "id", "left_anti").withColumn("is_graph", F.lit(True))
    return normal.withColumn("is_graph", F.lit(False)).unionByName(fresh).orderBy("is_graph", F.desc("score"), "id")


def open_feedback(feedback: DataFrame) -> DataFrame:
    return feedback.where(~F.col("is_resolved")).orderBy(F.desc("created_at"), F.desc("id"))


def resolve_feedback(feedback: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    hit = ids.select("id", F.lit(True).alias("_hit")).distinct()
    done = F.col("_hit").isNotNull() & ~F.col("is_resolved")
    return feedback.join(hit, "id", "left").withColumn("resolved_at", F.when(done, F.lit(at).cast("timestamp")).otherwise(F.col("resolved_at"))).withColumn("is_resolved", F.col("is_resolved") | F.col("_hit").isNotNull()).select(*feedback.columns)


def best_match(items: DataFrame, word: str) -> DataFrame:
    """The item that a correction refers to: the first by id whose text holds the words."""
    return search_content(items, word, 1)


def fix_item(items: DataFrame, word: str, content: str) -> DataFrame:
    changes = best_match(items, word).select("id", F.lit(content).alias("content"))
    return patch(items, changes, "id", ("content",))


def delete_wrong(items: DataFrame, word: str) -> DataFrame:
    return items.join(best_match(items, word).select("id"), "id", "left_anti")


def counts_by(rows: DataFrame, key: str, created: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.max(created).alias("last_created"))


def totals(rows: DataFrame, status: str, source: str, done: str = "indexed") -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col(status) == done).alias("done"), F.countDistinct(source).alias("n_sources"))


def commit(df: DataFrame, root: str, table: str, partition: str | None = None) -> str:
    """Write df as a new version of a table under root, and point the table at it; older versions stay readable.

    The whole table is written: for changes of a few rows see `plans.tables`. A writer that another one has overtaken fails.
    """
    spark: SparkSession = df.sparkSession
    at = f"{root}/{table}"
    base = max([0, *versions.numbers(spark, at)])
    path = f"{at}/data/{uuid.uuid4().hex}"
    (df.write.partitionBy(partition) if partition else df.write).parquet(path)
    try:
        versions.publish(spark, at, base, {"path": path})
    except versions.Conflict:
        versions.remove(spark, path)
        raise
    return path


def current(spark: SparkSession, root: str, table: str, merge: bool = False) -> DataFrame:
    """The newest committed version of a table."""
    found = versions.newest(spark, f"{root}/{table}")
    if found is None:
        raise FileNotFoundError(f"no table {table} under {root}")
    return spark.read.option("mergeSchema", merge).parquet(found[1]["path"])


def append(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Further rows (questions, evaluations, mappings, tasks, feedback); columns they lack are null."""
    return rows.unionByName(new, allowMissingColumns=True).select(*rows.columns)


def question_counts(sets: DataFrame, questions: DataFrame) -> DataFrame:
    """(set_id, question_count, avg_difficulty): derived from the questions, never stored."""
    totals_ = questions.groupBy("set_id").agg(F.count("*").alias("question_count"), F.avg("difficulty").alias("avg_difficulty"))
    return sets.select("set_id").join(totals_, "set_id", "left").select("set_id", F.coalesce("question_count", F.lit(0)).alias("question_count"), "avg_difficulty")


def reprocess(assets: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assets set to parsing where that is allowed, a pending task for each of them, rejects)."""
    asked = ids.select("asset_id", F.lit("parsing").alias("new_status")).distinct()
    after, bad = transition(assets, asked)
    ok = asked.join(bad.select("asset_id"), "asset_id", "left_anti")
    tasks = ok.select(F.concat(F.lit("reprocess:"), F.col("asset_id")).alias("task_id"), F.lit("parse").alias("task_type"), "asset_id", F.lit("pending").alias("status"), F.lit(0.0).alias("progress"))
    return after, tasks, bad


def upsert_counted(rows: DataFrame, new: DataFrame, root: str, table: str, key: str = "id") -> int:
    """Upsert and commit in one job; returns how many rows the table now holds, counted as they are written."""
    from pyspark.sql import Observation

    seen = Observation("rows")
    commit(upsert(rows, new, key).observe(seen, F.count(F.lit(1)).alias("n")), root, table)
    return seen.get["n"]
