"""From files to knowledge items: one batch job over a distributed listing.

Readers, cleaning, blocks, code graphs and logs each give rows of one schema (lodewell.schemas.KNOWLEDGE_ITEMS);
files that fail are kept as rejects with their errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewell import schemas
from lodewell.functions import text as X
from lodewell.operators import chunk as C
from lodewell.operators import dedup as D
from lodewell.operators import graph as G
from lodewell.operators import logs as L
from lodewell.operators import registry as K
from lodewell.sources import files as S

CODE, LOGS, DOCUMENTS = ("c", "h"), ("log", "txt"), ("md", "docx", "xlsx", "csv", "pdf")


def to_items(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows as knowledge items: the given columns, null or default for the rest, in the schema's order."""
    base = {"is_vectorized": F.lit(False), "created_at": F.lit(None), "edges": F.array(), "metadata": F.create_map()}
    out = []
    for field in schemas.KNOWLEDGE_ITEMS.replace("map<string,string>", "map<string;string>").replace("array<struct<type:string,target:string,direction:string>>", "array<struct<type:string;target:string;direction:string>>").split(", "):
        name, kind = field.split(" ", 1)
        out.append(columns.get(name, base.get(name, F.lit(None))).cast(kind.replace(";", ",")).alias(name))
    return rows.select(*out)


def code_items(files: DataFrame) -> DataFrame:
    """C files (path, text) as block items and graph items."""
    blocks = G.code_blocks(files, "path", "text")
    nodes = G.code_nodes(files, "path", "text").withColumn("has_params", F.size("params") > 0)
    graph = G.graph_items(nodes.dropDuplicates(["file", "id"]), G.code_edges(files, "path", "text"))
    a = to_items(blocks, id=F.col("id"), type=F.col("type"), category=F.lit("c_code"), title=F.col("name"), content=F.col("content"), source_file=F.col("file_path"), line_number=F.col("line_number"), metadata=F.create_map(F.lit("module"), F.col("module"), F.lit("description"), F.col("description")))
    b = to_items(graph, id=F.col("id"), type=F.col("type"), category=F.lit("graph"), title=F.col("title"), content=F.concat_ws(" ", "title", "keywords", G.edges_text(F.col("edges"))), source_file=F.col("source_file"), edges=F.col("edges"), metadata=F.create_map(F.lit("keywords"), F.col("keywords"), F.lit("legacy_id"), F.col("legacy_id")))
    return a.unionByName(b)


def log_items(files: DataFrame) -> DataFrame:
    e = L.parse_lines(files, "path", "text")
    return to_items(e, id=F.col("id"), type=F.lit("log_entry"), category=F.lit("log"), title=F.concat_ws(" ", "level", "source"), content=F.col("raw_line"), source_file=F.col("path"), line_number=F.col("line_number"), metadata=F.create_map(F.lit("level"), F.col("level"), F.lit("source"), F.col("source"), F.lit("timestamp"), F.coalesce("timestamp", F.lit(""))))


def document_items(pages: DataFrame) -> DataFrame:
    """Pages (path, page, text, tables) as cleaned, deduplicated blocks; table blocks are named by their headers."""
    whole = pages.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n").alias("t")).withColumn("t", X.clean(F.col("t")))
    text = C.protocol_blocks(whole, "path", "t")
    tables = pages.select("path", "page", F.posexplode("tables").alias("nth", "rows")).select("path", F.lit("table").alias("kind"), F.concat(F.lit("Table_"), (F.col("page") * 100 + F.col("nth")).cast("string")).alias("name"), C.table_to_markdown(F.col("rows")).alias("content")).where("length(trim(content)) >= 10")
    pictures = C.image_blocks(S.images(pages)).select("path", "kind", "name", "content")
    both = text.unionByName(tables).unionByName(pictures).withColumn("nth", F.monotonically_increasing_id())
    kept = D.greedy_blocks(both, "path", "nth")
    named = kept.withColumn("name", X.block_name(F.col("kind"), F.col("content"), F.col("name"), F.col("nth")))
    return to_items(named, id=F.concat_ws(":", "path", F.col("nth").cast("string")), type=F.col("kind"), category=F.lit("protocol"), title=F.coalesce("name", F.lit("Untitled")), content=F.col("content"), source_file=F.col("path"), metadata=F.create_map(F.lit("scene"), X.scene(F.col("content"))))


def build(files: DataFrame, readers: S.Readers | None = None) -> tuple[DataFrame, DataFrame]:
    """(knowledge items, rejects) of files (path, extension, content)."""
    parsed = S.parse(files.where(F.col("extension").isin(*DOCUMENTS)), readers)
    plain = S.decoded(files.where(F.col("extension").isin(*CODE, *LOGS)))
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    items = code_items(plain.where(ext.isin(*CODE))).unionByName(log_items(plain.where(ext.isin(*LOGS)))).unionByName(document_items(parsed.where("success")))
    unknown = files.where(~F.col("extension").isin(*DOCUMENTS, *CODE, *LOGS)).select("path", F.concat(F.lit("no reader for ."), F.col("extension")).alias("error"))
    return items, parsed.where("not success").select("path", "error").unionByName(unknown)


def is_garbled(items: DataFrame, share: float = 0.15) -> DataFrame:
    """(source_file, garbled_share, needs_ocr): the share of a file's blocks that are garbled."""
    rate = F.avg(X.is_garbled_block(F.col("content")).cast("double"))
    return items.groupBy("source_file").agg(rate.alias("garbled_share")).withColumn("needs_ocr", F.col("garbled_share") > share)


def route(content: DataFrame) -> DataFrame:
    """Rows added by hand (content_type, title, content, source) as items of the category that the type stands for."""
    kind = F.col("content_type")
    category = F.when(kind == "code", "c_code").when(kind == "log", "log").otherwise("protocol")
    return to_items(content, id=F.md5(F.concat_ws("\n", "source", "title", "content").cast("binary")), type=F.when(kind == "code", "function").when(kind == "log", "log_entry").otherwise("document_section"), category=category, title=F.coalesce("title", F.lit("Untitled")), content=F.col("content"), source_file=F.coalesce("source", F.lit("manual")))


def add_new(items: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with the new files' rows, rows refused because a file of that base name is there already)."""
    name = lambda c: F.element_at(F.split(F.translate(c, "\\", "/"), "/"), -1)
    known = items.select(name(F.col("source_file")).alias("_n")).distinct()
    marked = new.withColumn("_n", name(F.col("source_file")))
    fresh = marked.join(known, "_n", "left_anti").drop("_n")
    return K.upsert(items, fresh), marked.join(known, "_n", "left_semi").drop("_n")
