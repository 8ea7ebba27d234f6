"""Ranking of items for a batch of queries: BM25, TF-IDF, dense vectors, fusion, boosts, top-k.

Queries are a DataFrame (query_id, query), so one plan answers any number of them. Scoring joins
query tokens with posting rows on the token: only items that share a token with a query are touched.
Every cut has a total order, with ties broken by item_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodewell.functions import tokens as T
from lodewell.operators import index as I
from lodewell.plans.storage import in_blocks, materialize, small_batches

#: Term weights of the scoring: a small table, passed as data.
TERM_WEIGHTS = {"dp": 2.0, "dpid": 2.0, "dp_id": 2.0, "data_point": 2.0, "datapoint": 2.0, "cmd": 1.8, "command": 1.8, "frame_id": 1.8, "frameid": 1.8, "message_id": 1.8, "messageid": 1.8, "ota": 1.5, "ble": 1.5, "fault": 1.5, "alarm": 1.5}


#: Queries that are searched together, at most; a query has five variants.
QUERIES = 5000


def _weight(token: Column, weights: dict[str, float]) -> Column:
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.element_at(table, token), F.lit(1.0))


def query_tokens(queries: DataFrame, tokenizer=T.tfidf_tokens) -> DataFrame:
    """(query_id, token, times)"""
    return queries.select("query_id", F.explode(tokenizer(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))


def bm25(rows: DataFrame, queries: DataFrame, tokenizer=T.bm25_tokens, k1: float = 1.5, b: float = 0.75, weights: dict[str, float] = TERM_WEIGHTS, tf: DataFrame | None = None) -> DataFrame:
    """(query_id, scope, item_id, score): scores over 0; counts and mean lengths are those of the item's scope."""
    tf = tf if tf is not None else I.term_frequencies(rows, tokenizer)
    asked = query_tokens(queries, tokenizer)
    size = I.lengths(rows, tf)
    hit = tf.join(asked.select("token").distinct(), "token", "left_semi")  # postings of the asked tokens only
    met = hit.join(asked, "token").join(I.document_frequencies(hit), ["scope", "token"]).join(size, "scope")
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return met.groupBy("query_id", "scope", "item_id").agg(F.sum(part * F.col("times") * _weight(F.col("token"), weights)).alias("score")).where("score > 0")


def tfidf(rows: DataFrame, queries: DataFrame, vocabulary_size: int = 2000, keep_zero: bool = False, tf: DataFrame | None = None) -> DataFrame:
    """(query_id, scope, item_id, score): cosine of L2-normalised tf-idf vectors over the scope's vocabulary.

    With keep_zero, items of a query's scopes that share no token with it come with score 0.
    """
    tf = tf if tf is not None else I.term_frequencies(rows)
    n = rows.groupBy("scope").agg(F.count("*").alias("n"))
    idf = I.vocabulary(tf, vocabulary_size).join(n, "scope").select("scope", "token", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    weight = tf.join(idf, ["scope", "token"]).select("scope", "item_id", "token", (F.col("tf") / F.col("dl") * F.col("idf")).alias("w"))
    norm = weight.groupBy("scope", "item_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    asked = query_tokens(queries)
    length = asked.groupBy("query_id").agg(F.sum("times").alias("ql"))
    qw = asked.join(length, "query_id").join(idf, "token").select("query_id", "scope", "token", (F.col("times") / F.col("ql") * F.col("idf")).alias("qw"))
    qnorm = qw.groupBy("query_id", "scope").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    dot = weight.join(qw, ["scope", "token"]).groupBy("query_id", "scope", "item_id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    scored = dot.join(norm, ["scope", "item_id"]).join(qnorm, ["query_id", "scope"]).select("query_id", "scope", "item_id", (F.col("dot") / F.col("norm") / F.col("qnorm")).alias("score"))
    if not keep_zero:
        return scored
    every = rows.select("scope", "item_id").join(qnorm.select("query_id", "scope"), "scope")
    return every.join(scored, ["query_id", "scope", "item_id"], "left").select("query_id", "scope", "item_id", F.coalesce("score", F.lit(0.0)).alias("score"))


class _Heap:
    """The k best of each query so far: scores and ids, best first, ties by id."""

    def __init__(self, asked: np.ndarray, k: int):
        self.asked, self.k, self.length = asked, k, np.sqrt((asked * asked).sum(1))
        self.scores, self.ids = [np.zeros(0)] * len(asked), [None] * len(asked)
        self.floor = np.full(len(asked), -np.inf)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Rows of a block: queries that the block's centre and radius rule out are not multiplied."""
        centre = rows.mean(0)
        radius = np.sqrt(((rows - centre) ** 2).sum(1).max())
        limit = self.asked @ centre + self.length * radius
        open_ = np.flatnonzero(limit * (1 + 1e-9 * np.sign(limit)) + 1e-9 >= self.floor)
        products = np.round(self.asked[open_] @ rows.T, 12)
        for q, own in zip(open_[(products >= self.floor[open_, None]).any(1)], products[(products >= self.floor[open_, None]).any(1)], strict=True):
            near = own >= self.floor[q]
            scores, found = np.concatenate((self.scores[q], own[near])), ids[near] if self.ids[q] is None else np.concatenate((self.ids[q], ids[near]))
            best = np.lexsort((found, -scores))[: self.k]
            self.scores[q], self.ids[q] = scores[best], found[best]
            if len(best) == self.k:
                self.floor[q] = self.scores[q][-1]


def dense(vectors: DataFrame, queries: DataFrame, top_k: int = 50, most: int = 5000) -> DataFrame:
    """(query_id, item_id, score, rank): the top_k inner products of a stated query set against all vectors.

    Queries go to the tasks `most` at a time; each task multiplies its Arrow batches with them, in double precision, and keeps top_k
    rows a query, so what moves is bounded by that. Exact: a batch is left out for a query only where its centre and radius
    rule out the query's top_k. Scores are rounded to 12 digits; ties go to the lower item_id. Rows without an id and rows and
    queries without a vector of the queries' length, or with null or infinite components, have no score.
    """
    kinds = [f"query_id {queries.schema['query_id'].dataType.simpleString()}", f"item_id {vectors.schema['item_id'].dataType.simpleString()}", "score double"]
    text = vectors.schema["item_id"].dataType.typeName() == "string"
    whole = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    rows = vectors.where(whole & F.col("item_id").isNotNull()).select("item_id", F.col("vector").cast("array<double>").alias("vector"))
    small_batches(vectors.sparkSession)

    def block(some: DataFrame) -> DataFrame:
        own = some.where(whole).select("query_id", F.col("vector").cast("array<double>").alias("vector")).collect()  # `most` rows
        names, width = [r["query_id"] for r in own], max([len(r["vector"]) for r in own], default=0)
        names = [n for n, r in zip(names, own, strict=True) if len(r["vector"]) == width]
        asked = np.array([r["vector"] for r in own if len(r["vector"]) == width], np.float64).reshape(len(names), width)
        names, asked = [n for n, ok in zip(names, np.isfinite(asked).all(1), strict=True) if ok], asked[np.isfinite(asked).all(1)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            heap = _Heap(asked, top_k)
            for batch in batches:
                column = batch.column(1)
                fits = np.diff(column.offsets.to_numpy()) == width
                if not fits.any() or not width:
                    continue
                kept = batch.filter(pa.array(fits)) if not fits.all() else batch
                found = np.array(kept.column(0).to_pylist()) if text else kept.column(0).to_numpy()
                values = kept.column(1).flatten().to_numpy().reshape(-1, width)
                finite = np.isfinite(values).all(1)
                if finite.any():
                    heap.add(found[finite], values[finite])
            for name, ids, scores in zip(names, heap.ids, heap.scores, strict=True):
                if len(scores):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(scores), kind), pa.array(ids.tolist(), item), pa.array(scores)], names=["query_id", "item_id", "score"])

        kind, item = (to_arrow_type(t.schema[c].dataType) for t, c in ((queries, "query_id"), (vectors, "item_id")))
        return top(rows.mapInArrow(run, ", ".join(kinds)), top_k, ["query_id"])

    return in_blocks(queries, "query_id", most, block)


def top(scored: DataFrame, k: int, keys: list[str], order: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """The k best rows of each key, by score and then by the given columns."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), *order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def reciprocal_rank_fusion(legs: list[DataFrame], k: int = 60, cut: int = 50) -> DataFrame:
    """(query_id, item_id, score): the sum over methods of 1 / (k + rank), ranks from 1 within each method's first `cut`."""
    ranked = [top(leg.select("query_id", "item_id", "score"), cut, ["query_id"]) for leg in legs]
    parts = ranked[0].select("query_id", "item_id", "rank")
    for leg in ranked[1:]:
        parts = parts.unionByName(leg.select("query_id", "item_id", "rank"))
    return parts.groupBy("query_id", "item_id").agg(F.round(F.sum(F.lit(1.0) / (F.col("rank") + k)), 12).alias("score"))


def boost(hits: DataFrame, gps: str = "gps|gil|定位|卫星", vehicle: str = "can|fe01|控制器|整车") -> DataFrame:
    """Multipliers on hits (query, type, title, scene, subsystem): business documents, title, scene, subsystem mismatch."""
    query, sub = F.lower("query"), F.lower(F.coalesce("subsystem", F.lit("")))
    of_gps, of_vehicle = sub.rlike("gps|gil"), sub.rlike("can|vehicle")
    factor = F.when(F.col("type").isin("business_doc", "protocol_doc"), 10.0).otherwise(1.0)
    factor = factor * F.when(F.lower(F.coalesce("title", F.lit(""))).contains(query), 2.0).otherwise(1.0)
    factor = factor * F.when((F.coalesce("scene", F.lit("")) != "") & F.lower("scene").contains(query), 1.5).otherwise(1.0)
    factor = factor * F.when(query.rlike(gps) & ~of_gps & of_vehicle, 0.3).otherwise(1.0)
    factor = factor * F.when(query.rlike(vehicle) & of_gps, 0.3).otherwise(1.0)
    return hits.withColumn("score", F.col("score") * factor)


def best_per_source(hits: DataFrame, source: str = "source") -> DataFrame:
    """The best hit of each source for each query; ties go to the lower item_id."""
    w = Window.partitionBy("query_id", source).orderBy(F.desc("score"), "item_id")
    return hits.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def _in_category(legs: list[DataFrame], items: DataFrame, queries: DataFrame, aliases: dict[str, tuple[str, ...]]) -> list[DataFrame]:
    """Legs less the hits outside their query's category; queries for which the first leg has none inside keep all."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, bs in aliases.items() for b in bs]) if aliases else None
    kind, want = F.col("_kind"), F.col("_want")
    fits = want.isNull() | (kind == want)
    if pairs is not None:
        fits = fits | F.array_contains(pairs, F.struct(want.alias("a"), kind.alias("b")))
    kinds = items.select("item_id", F.col("category").alias("_kind"))
    marked = [leg.select("query_id", "item_id", "score").join(kinds, "item_id").join(queries.select("query_id", F.col("category").alias("_want")), "query_id").withColumn("_in", F.coalesce(fits, F.lit(False))) for leg in legs]
    any_ = marked[0].groupBy("query_id").agg(F.max("_in").alias("_any"))
    return [m.join(any_, "query_id", "left").where(F.col("_in") | ~F.coalesce("_any", F.lit(False))).select("query_id", "item_id", "score") for m in marked]


def hybrid(items: DataFrame, queries: DataFrame, top_k: int = 5, extra_legs: tuple[DataFrame, ...] = (), overfetch: int = 1, keep_zero: bool = False, aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(query_id, item_id, source, title, score, rank, content_preview): the whole hybrid search of a query batch.

    items: item_id, source, title, text, type, scene, subsystem. BM25 and TF-IDF per source (and any further
    legs) are fused; the cut to top_k comes before boosts and the best hit per source, so fewer rows are normal
    (`overfetch` widens that cut). If queries have a category (and items too), hits of other categories fall out,
    unless BM25 finds none in the query's own; `aliases` name the categories that one stands for.
    """
    rows = I.items(items, F.col("item_id"), F.col("source"), F.col("text"))
    per_file = max(50, 3 * top_k)
    # both term tables are written once: scoring reads them several times
    words, tokens = materialize(I.term_frequencies(rows, T.bm25_tokens), "bm25"), materialize(I.term_frequencies(rows), "tfidf")
    scored = (bm25(rows, queries, tf=words), tfidf(rows, queries, keep_zero=keep_zero, tf=tokens))
    legs = [top(leg.withColumn("score", F.round("score", 9)), per_file, ["query_id", "scope"]).drop("rank") for leg in scored] + list(extra_legs)
    if "category" in queries.columns:
        legs = _in_category(legs, items, queries, aliases or {})
        queries = queries.drop("category")
    fused = top(reciprocal_rank_fusion(legs), top_k * overfetch, ["query_id"]).drop("rank")
    hits = fused.join(items, "item_id").join(queries, "query_id")
    final = top(best_per_source(boost(hits)), top_k, ["query_id"])
    return final.select("query_id", "item_id", "source", "title", "score", "rank", F.substring("text", 1, 800).alias("content_preview"))


def search_files(kept: I.Kept, variants: DataFrame) -> DataFrame:
    """(query_id, scope): the files in which a query is searched, however many there are.

    variants: query_id, ord, variant, query. Each variant takes its candidates by full text, else by shared names; a
    query takes those of all its variants.
    """
    asked = variants.select(F.col("variant").alias("query_id"), "query")
    matched = materialize(kept.matches(asked), "matched")
    rest = asked.join(matched.select("query_id").distinct(), "query_id", "left_anti")
    tokens = query_tokens(rest).select("query_id", "token")
    named = kept.postings("names", tokens).join(tokens, "token").select("query_id", "scope")
    every = matched.select("query_id", "scope").unionByName(named).withColumnRenamed("query_id", "variant")
    return every.join(variants.select("query_id", "variant"), "variant").select("query_id", "scope").distinct()


def kept_scores(kept: I.Kept, variants: DataFrame, files: DataFrame, k1: float = 1.5, b: float = 0.75, weights: dict[str, float] = TERM_WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """BM25 and TF-IDF scores (query_id, variant, scope, item_id, score) over 0 of each variant in its query's files."""
    own = variants.select("query_id", "variant")
    asked = variants.select(F.col("variant").alias("query_id"), "query")
    few = I.small(files)

    def within(hits: DataFrame, tokens: DataFrame) -> DataFrame:
        # variants of at most QUERIES queries: `search` goes by blocks
        met = hits.join(F.broadcast(tokens.withColumnRenamed("query_id", "variant")), "token").join(F.broadcast(own), "variant")
        return met.join(few, ["query_id", "scope"], "left_semi")

    words = query_tokens(asked, T.bm25_tokens)
    met = within(kept.postings("words", words), words).join(frequencies(kept, words), ["token", "scope"])
    part = _bm25_part("tf", "dl", k1, b)
    by = ["query_id", "variant", "scope", "item_id"]
    bm = met.groupBy(*by).agg(F.sum(part * F.col("times") * _weight(F.col("token"), weights)).alias("score")).where("score > 0")
    plain = query_tokens(asked)
    length = plain.groupBy("query_id").agg(F.sum("times").alias("ql"))
    met = within(kept.postings("tokens", plain), plain.join(length, "query_id")).withColumn("qw", F.col("times") / F.col("ql") * F.col("idf"))
    # the query's own norm counts each of its tokens once in every file whose vocabulary has it
    known = met.select("variant", "scope", "token", "qw").distinct().groupBy("variant", "scope").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    dot = met.groupBy(*by).agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    ti = dot.join(known, ["variant", "scope"]).select(*by, (F.col("dot") / F.col("qnorm")).alias("score"))
    return bm, ti


def bm25_top(kept: I.Kept, queries: DataFrame, k: int = 10, probe: int = 2, k1: float = 1.5, b: float = 0.75, weights: dict[str, float] = TERM_WEIGHTS) -> DataFrame:
    """(query_id, scope, item_id, score, rank): the k best BM25 scores of each query in each scope, by blocks of postings.

    The bounds of the blocks (greatest count, least length) limit what a query can score in each group of items. The `probe` best groups
    are scored first; the k-th score so far is a floor, and of the others only groups whose limit reaches it are scored. Exact, ties included.
    """
    return in_blocks(queries.select("query_id", "query"), "query_id", QUERIES, lambda some: _bm25_block(kept, some, k, probe, k1, b, weights))


def frequencies(kept: I.Kept, asked: DataFrame) -> DataFrame:
    """(token, scope, df, n, avgdl) of the asked tokens, by the counts of their blocks."""
    counts = kept.postings("blocks", asked).groupBy("token", "scope").agg(F.sum("n").alias("df"))
    return I.small(materialize(counts.join(kept.table("scopes"), "scope"), "frequencies"))


def block_limits(kept: I.Kept, asked: DataFrame, k1: float = 1.5, b: float = 0.75, weights: dict[str, float] = TERM_WEIGHTS) -> DataFrame:
    """(query_id, scope, grp, most): an upper limit of the scores of asked (query_id, token, times) in each group that has any of its tokens."""
    blocks = kept.postings("blocks", asked).drop("n").join(F.broadcast(asked), "token").join(frequencies(kept, asked), ["token", "scope"])
    limit = _bm25_part("max_tf", "min_dl", k1, b) * F.col("times") * _weight(F.col("token"), weights)
    return blocks.groupBy("query_id", "scope", "grp").agg((F.sum(limit) * (1 + 1e-9)).alias("most"))


def _bm25_part(tf: str, dl: str, k1: float, b: float) -> Column:
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return idf * F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col(dl) / F.col("avgdl")))


def _ordered_sum(part: Column) -> Column:
    """The sum of a few doubles from the least to the greatest: equal parts give equal sums, to the last bit, so that copies tie."""
    return F.aggregate(F.array_sort(F.collect_list(part)), F.lit(0.0), lambda acc, x: acc + x)


def _bm25_block(kept: I.Kept, queries: DataFrame, k: int, probe: int, k1: float, b: float, weights: dict[str, float]) -> DataFrame:
    asked = materialize(query_tokens(queries, T.bm25_tokens), "asked")
    by, known = ["query_id", "scope"], frequencies(kept, asked)
    limits = materialize(block_limits(kept, asked, k1, b, weights).withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("most"), "grp"))), "limits")

    def scored(groups: DataFrame) -> DataFrame:
        part = _bm25_part("tf", "dl", k1, b) * F.col("times") * _weight(F.col("token"), weights)
        met = kept.blocks_of(asked, groups).join(F.broadcast(asked), "token").join(groups.select(*by, "grp"), [*by, "grp"], "left_semi").join(known, ["token", "scope"])
        return met.groupBy(*by, "item_id").agg(_ordered_sum(part).alias("score")).where("score > 0")

    first = materialize(top(scored(limits.where(F.col("nth") <= probe)), k, by), "first")
    floor = first.where(F.col("rank") == k).select(*by, F.col("score").alias("floor"))
    rest = limits.where(F.col("nth") > probe).join(floor, by, "left").where(F.col("floor").isNull() | (F.col("most") >= F.col("floor")))
    rest = materialize(rest.select(*by, "grp"), "rest")
    return top(first.drop("rank").unionByName(scored(rest)), k, by)


def search(kept: I.Kept, items: DataFrame, queries: DataFrame, top_k: int = 5, extra_legs: tuple[DataFrame, ...] = (), variants: int = 5, overfetch: int = 1, aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(query_id, item_id, source, title, score, rank, content_preview): the whole search of a query batch in a kept index.

    Queries are expanded, `variants` of each searched; candidate files are picked first, and only the asked tokens'
    postings in these are scored. An item's scores are summed over the variants, the legs are fused, and the
    first top_k are boosted, the best of each source kept. Categories fall out as in `hybrid`.
    """
    if "category" not in queries.columns:
        queries = queries.select("query_id", "query")
    return in_blocks(queries, "query_id", QUERIES, lambda some: _search_block(kept, items, some, top_k, extra_legs, variants, overfetch, aliases or {}))


def _search_block(kept: I.Kept, items: DataFrame, queries: DataFrame, top_k: int, extra_legs: tuple[DataFrame, ...], variants: int, overfetch: int, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """`search` for at most QUERIES queries, whose variants and hits are broadcast."""
    from lodewell.operators.expand import expand

    asked = queries.select("query_id", "query")
    extra_legs = tuple(leg.join(F.broadcast(asked.select("query_id")), "query_id", "left_semi") for leg in extra_legs)
    rows = expand(asked).where(F.col("ord") <= variants).select("query_id", "ord", F.col("expansion").alias("query"))
    rows = materialize(rows.withColumn("variant", F.concat_ws("#", F.col("query_id").cast("string"), F.col("ord").cast("string"))), "variants")
    within = materialize(search_files(kept, rows), "files")
    per_file = max(50, 3 * top_k)
    legs = []
    for scored in kept_scores(kept, rows, within):
        best = top(scored.withColumn("score", F.round("score", 9)), per_file, ["variant", "scope"]).drop("rank")
        legs.append(best.groupBy("query_id", "item_id").agg(F.round(F.sum("score"), 9).alias("score")))
    legs += list(extra_legs)
    if "category" in queries.columns:
        legs = _in_category(legs, items, queries, aliases or {})
    fused = top(reciprocal_rank_fusion(legs), top_k * overfetch, ["query_id"]).drop("rank")
    hits = items.join(F.broadcast(fused), "item_id").join(F.broadcast(asked), "query_id")
    final = top(best_per_source(boost(hits)), top_k, ["query_id"])
    return final.select("query_id", "item_id", "source", "title", "score", "rank", F.substring("text", 1, 800).alias("content_preview"))


def category_priority(hits: DataFrame, priorities: DataFrame) -> DataFrame:
    """Of hits (query_id, category, ...), those of the first category in the query's order that has any."""
    met = hits.join(priorities, ["query_id", "category"])
    first = F.min("priority").over(Window.partitionBy("query_id"))
    return met.withColumn("first", first).where("priority = first").drop("first", "priority")


def union_first(parts: DataFrame) -> DataFrame:
    """Of (query_id, ord, item_id, score), each item once, from the earliest query variant that found it."""
    w = Window.partitionBy("query_id", "item_id").orderBy("ord")
    return parts.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def context_budget(hits: DataFrame, longest: int = 4000) -> DataFrame:
    """Hits (query_id, rank, text) while their running length stays within the budget."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("used", F.sum(F.length("text")).over(w)).where(F.col("used") <= longest)


def candidate_files(files: DataFrame, matched: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, scope, rank) of matched files: business documents first, then files of fewer items.

    files: scope, n_items; matched: query_id, scope. Up to 3 * most business files and `most` others compete.
    """
    met = matched.join(files, "scope").withColumn("business", F.col("scope").rlike("protocol_docs|business_docs"))
    w = Window.partitionBy("query_id", "business").orderBy("scope")
    met = met.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= F.when(F.col("business"), 3 * most).otherwise(most))
    order = Window.partitionBy("query_id").orderBy(F.desc("business"), "n_items", "scope")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("query_id", "scope", "n_items", "business", "rank")


def name_tokens(names: DataFrame) -> DataFrame:
    """(scope, token): the distinct words of what names a file (scope, names), whole and split at _."""
    words = F.flatten(F.transform(T.tfidf_tokens(F.col("names")), lambda t: F.array_union(F.array(t), F.split(t, "_"))))
    return names.select("scope", F.explode(words).alias("token")).where("token != ''").distinct()


def overlap_files(files: DataFrame, queries: DataFrame, most: int = 10) -> DataFrame:
    """Fallback without full-text hits: files by how many distinct query words their names or item ids share.

    files: scope, n_items, names (text of file name and item ids).
    """
    return by_overlap(name_tokens(files.select("scope", "names")), files.select("scope", "n_items"), query_tokens(queries).select("query_id", "token"), most)


def by_overlap(words: DataFrame, files: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """The `most` files (scope, n_items) of each query (query_id, token) that share most of their words (scope, token) with it."""
    met = asked.join(words, "token").join(files, "scope").groupBy("query_id", "scope", "n_items").agg(F.count("*").cast("double").alias("score"))
    business = F.col("scope").rlike("protocol_docs|business_docs")
    met = met.withColumn("score", F.col("score") + F.when(business, 1000.0).otherwise(0.0))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "n_items", "scope")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
