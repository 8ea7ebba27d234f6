"""The knowledge base as one object over DataFrames: search, lookups, changes and vectors.

Every method returns DataFrames; `items` is replaced by the changed one, and `save` commits it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell import providers, schemas
from lodewell.operators import expand as E
from lodewell.operators import graph as G
from lodewell.operators import index as I
from lodewell.operators import rank as R
from lodewell.operators import registry as K
from lodewell.plans.tables import Table

#: Code is stored as graph items too; a search for one category looks into these.
ALIASES = {"c_code": ("c_code", "graph")}


def content_hashes(items: DataFrame) -> DataFrame:
    """(source_file, content_hash, doc_count): a digest of a file's items, by sums of their digests: no text is gathered."""
    digest = F.md5(F.concat_ws("|", F.col("id").cast("string"), F.coalesce("content", F.lit(""))).cast("binary"))
    part = lambda at: F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return items.groupBy("source_file").agg(F.concat_ws(":", part(1), part(16)).alias("content_hash"), F.count("*").cast("int").alias("doc_count"))


def stale_files(items: DataFrame, vectors: DataFrame) -> DataFrame:
    """(source_file, content_hash, doc_count) of files without vectors of their present content."""
    known = vectors.select("source_file", "content_hash").distinct()
    return content_hashes(items).join(known, ["source_file", "content_hash"], "left_anti")


class KnowledgeBase:
    """Searches go through an index that is built at the first of them and again after the items have changed."""

    def __init__(self, items: DataFrame, vectors: DataFrame | None = None, table: Table | None = None):
        self.items, self.vectors, self.table = items, vectors, table

    @property
    def items(self) -> DataFrame:
        return self._items

    @items.setter
    def items(self, rows: DataFrame) -> None:
        self._items, self._kept = rows, None

    @property
    def kept(self) -> I.Kept:
        if self._kept is None:
            rows = I.items(self._items, F.col("id"), F.col("source_file"), F.col("content"))
            base = F.element_at(F.split(F.translate("source_file", "\\", "/"), "/"), -1)
            names = self._items.select(F.col("source_file").alias("scope"), F.explode(F.array(base, F.col("id"))).alias("names"))
            self._kept = I.Kept.build(rows, R.name_tokens(names))
        return self._kept

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> KnowledgeBase:
        return cls(K.current(spark, root, "knowledge_items"))

    @classmethod
    def empty(cls, spark: SparkSession) -> KnowledgeBase:
        return cls(spark.createDataFrame([], schemas.KNOWLEDGE_ITEMS))

    @classmethod
    def stored(cls, spark: SparkSession, root: str, rows: DataFrame | None = None, buckets: int = 64) -> KnowledgeBase:
        """A knowledge base whose changes are committed to a keyed table under root; rows begin a new one."""
        table = Table.open(spark, root) if rows is None else Table.create(rows, root, "id", buckets)
        return cls(table.rows(), table=table)

    def _now(self, table: Table) -> KnowledgeBase:
        self.table, self.items = table, table.rows()
        return self

    def save(self, root: str) -> str:
        return K.commit(self.items, root, "knowledge_items")

    # search

    def _ranked(self, rows: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
        shaped = rows.select(F.col("id").alias("item_id"), F.col("source_file").alias("source"), "title", F.col("content").alias("text"), "type", F.col("metadata")["scene"].alias("scene"), F.col("metadata")["subsystem"].alias("subsystem"), "category")
        legs = ()
        if self.vectors is not None:
            asked = providers.encode(queries, "query_id", "query")
            legs = (R.dense(self.vectors.select(F.col("id").alias("item_id"), "vector"), asked),)
        return R.search(self.kept, shaped, queries, top_k, extra_legs=legs, aliases=ALIASES)

    def search(self, queries: DataFrame, top_k: int = 5, category: str | None = None) -> DataFrame:
        """Hits of a query batch with their items, in rank order.

        Without a category each query is classified; a query whose category finds nothing is searched in all.
        """
        named = queries.withColumn("category", F.lit(category) if category else E.coarse_category(F.col("query")))
        hits = self._ranked(self.items, named, top_k)
        return hits.join(self.items.select(F.col("id").alias("item_id"), "category", "type", "line_number"), "item_id").orderBy("query_id", "rank")

    def search_expanded(self, queries: DataFrame, top_k: int = 5, variants: int = 5) -> DataFrame:
        """Hits over the query and its related queries: each item once, longer variants first."""
        related = E.related_queries(queries, most=variants).withColumn("variant", F.concat_ws("#", F.col("query_id").cast("string"), F.col("ord").cast("string")))
        hits = self._ranked(self.items, related.select(F.col("variant").alias("query_id"), F.col("related").alias("query")), 2 * top_k)
        met = hits.withColumnRenamed("query_id", "variant").join(related, "variant")
        return R.union_first(met.select("query_id", "ord", "item_id", "score", "title", F.length("related").alias("matched"))).orderBy("query_id", F.desc("matched"), "ord", "item_id")

    def retrieve(self, queries: DataFrame, top_k: int = 5, longest: int = 500) -> DataFrame:
        hits = self.search(queries, top_k)
        return hits.select("query_id", "rank", "item_id", "source", "title", "score", F.substring("content_preview", 1, longest).alias("content"))

    # lookups

    def by_ids(self, ids: DataFrame) -> DataFrame:
        return self.items.join(ids.select("id"), "id", "left_semi")

    def by_category(self, category: str, limit: int = 50, year: int | None = None) -> DataFrame:
        return K.list_rows(self.items, {"category": category, "year": year}, [F.col("id")], limit)

    def files(self, category: str | None = None) -> DataFrame:
        rows = self.items.where(F.col("category") == category) if category else self.items
        return rows.select("source_file").distinct()

    def blocks(self, kind: str) -> DataFrame:
        return self.items.where(F.col("type") == kind)

    def protocol_related(self) -> DataFrame:
        return self.items.where(F.lower("content").rlike("ble|can|mqtt|rs485|uart|protocol|frame|packet|dp_|cmd|协议|命令"))

    def edges(self) -> DataFrame:
        out = self.items.select(F.col("metadata")["legacy_id"].alias("from_node"), F.explode("edges").alias("e")).where("e.direction = 'out'")
        return out.select("from_node", F.col("e.target").alias("to_node"), F.col("e.type").alias("edge_type"))

    def call_chain(self, ids: DataFrame) -> DataFrame:
        return G.call_chain(self.edges().where("edge_type = 'calls'"), ids)

    def stats(self) -> DataFrame:
        return self.items.groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("source_file").alias("n_files"), F.max("created_at").alias("last_created"))

    # changes

    def add(self, rows: DataFrame) -> KnowledgeBase:
        if self.table is not None:
            return self._now(self.table.upsert(rows))
        self.items = K.upsert(self.items, rows)
        return self

    def update(self, changes: DataFrame, columns: tuple[str, ...] = ("title", "content")) -> KnowledgeBase:
        if self.table is not None:
            return self._now(self.table.patch(changes, columns))
        self.items = K.patch(self.items, changes, "id", columns)
        return self

    def delete(self, ids: DataFrame) -> KnowledgeBase:
        if self.table is not None:
            return self._now(self.table.delete(ids))
        self.items = K.hard_delete(self.items, ids, "id")
        return self

    def delete_category(self, category: str) -> KnowledgeBase:
        if self.table is not None:
            return self._now(self.table.delete(self.items.where(F.col("category") == category)))
        self.items = self.items.where((F.col("category") != category) | F.col("category").isNull())
        return self

    def vectorize(self, encoder: str = "hashing") -> KnowledgeBase:
        """Encode the files whose vectors are missing or stale, keep the others', and mark the items."""
        old = self.vectors
        stale = stale_files(self.items, old) if old is not None else content_hashes(self.items)
        rows = self.items.join(stale.select("source_file", "content_hash"), "source_file")
        new = providers.encode(rows, "id", "content", encoder).join(rows.select("id", "source_file", "content_hash"), "id")
        kept = old.join(stale.select("source_file"), "source_file", "left_anti").unionByName(new) if old is not None else new
        self.vectors = kept.select("id", "source_file", "content_hash", "vector")
        kept = self._kept
        if self.table is not None:
            self._now(self.table.mark(self.vectors))
        else:
            self.items = K.mark(self.items, self.vectors, "id")
        self._kept = kept  # texts are as before
        return self
