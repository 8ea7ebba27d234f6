"""Inverted indexes and term statistics over items (item_id, scope, text).

`scope` is the file (or source) within which document counts and mean lengths are taken; pass a
literal to take them over everything. All tables are long and keyed, so that they shuffle by key
and pre-aggregate; nothing is collected.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodewell.functions import tokens as T
from lodewell.plans import versions
from lodewell.plans.skew import BROADCAST_ROWS
from lodewell.plans.storage import discard, materialize, scratch_path


def items(df: DataFrame, item_id: Column, scope: Column, text: Column) -> DataFrame:
    return df.select(item_id.alias("item_id"), scope.alias("scope"), text.alias("text"))


#: Items whose terms one task counts, about: with some hundred words each, a few hundred MB.
TASK_ITEMS = 2000
#: Items whose postings in one bucket of an index lie in one file, for each bucket.
FILE_ITEMS = 8000


def term_frequencies(rows: DataFrame, tokenizer=T.tfidf_tokens) -> DataFrame:
    """(scope, item_id, token, dl, tf, pos): counts of each token in each item, its first place, and the item's length.

    The one pass over texts: every other statistic is derived from this table. Texts are dealt out by item first, which moves
    a fraction of what their terms would; a task counts TASK_ITEMS items, however large the table is.
    """
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(rows.count() / TASK_ITEMS))
    split = rows.select("scope", "item_id", "text").repartition(n, "item_id").select("scope", "item_id", tokenizer(F.col("text")).alias("tokens")).withColumn("dl", F.size("tokens"))
    # an inner explode would have its filter on empty tokens pushed below the shuffle, and so every text split twice
    terms = split.select("scope", "item_id", "dl", F.posexplode_outer("tokens").alias("pos", "token")).where("token is not null")
    return terms.groupBy("scope", "item_id", "token", "dl").agg(F.count("*").alias("tf"), F.min("pos").alias("pos"))


def lengths(rows: DataFrame, tf: DataFrame) -> DataFrame:
    """(scope, n, avgdl): items of each scope and their mean number of tokens, empty ones included."""
    total = tf.groupBy("scope").agg(F.sum("tf").alias("total"))
    n = rows.groupBy("scope").agg(F.count("*").alias("n"))
    return n.join(total, "scope", "left").select("scope", "n", (F.coalesce("total", F.lit(0)) / F.col("n")).alias("avgdl"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    """(scope, token, df)"""
    return tf.groupBy("scope", "token").agg(F.count("*").alias("df"))


def vocabulary(tf: DataFrame, size: int = 2000, buckets: int = 32) -> DataFrame:
    """(scope, token, cf, df): the most frequent tokens of each scope; ties go to the one met first (item, then place).

    The best of each bucket of a scope are taken first, so no task sorts all tokens of a scope.
    """
    counts = tf.groupBy("scope", "token").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"), F.min(F.struct("item_id", "pos")).alias("first"))
    counts = counts.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)))
    order = [F.desc("cf"), "first"]
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("scope", "bucket").orderBy(*order))).where(F.col("rank") <= size)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("scope").orderBy(*order))).where(F.col("rank") <= size).select("scope", "token", "cf", "df", "rank")


def bigram_index(rows: DataFrame) -> DataFrame:
    """(bigram, scope): the distinct Chinese bigrams of each file."""
    return rows.select("scope", F.explode(T._pairs(F.col("text"))).alias("bigram")).distinct()


def files_with_bigrams(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The files that hold any of the wanted bigrams."""
    return index.join(wanted.select("bigram").distinct(), "bigram", "left_semi").select("scope").distinct()


def grouped_text(rows: DataFrame, items: int = 1000, lane: Column | None = None) -> DataFrame:
    """(scope, piece, content): the non-empty texts of each file joined by blanks in item order, `items` of them a piece.

    lane: a range of ids, in their order; `items` numbers in a row, or strings that begin alike. Items are numbered
    lane by lane, so that no task numbers a whole file.
    """
    kept = rows.where("text is not null and text != ''")
    text = rows.schema["item_id"].dataType.typeName() == "string"
    wide = lane if lane is not None else F.substring("item_id", 1, 4) if text else F.floor(F.col("item_id") / items)
    sizes = kept.groupBy("scope", wide.alias("lane")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("scope").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = kept.withColumn("lane", wide).join(sizes.withColumn("before", before).drop("n"), ["scope", "lane"])
    nth = F.col("before") + F.row_number().over(Window.partitionBy("scope", "lane").orderBy("item_id")) - 1
    return at.withColumn("piece", F.floor(nth / items)).groupBy("scope", "piece").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_id", "text"))), lambda x: x["text"]), " ").alias("content"))


def fts_postings(rows: DataFrame) -> DataFrame:
    """(token, scope): distinct full-text tokens of each file."""
    return rows.select("scope", F.explode_outer(T.fts_runs(F.col("text"))).alias("token")).where("token is not null").distinct()


def fts_match(postings: DataFrame, queries: DataFrame, contains: bool = False) -> DataFrame:
    """(query_id, scope) of files with a token that starts with a prefix of the query (or contains it).

    Prefixes are joined on their first characters, so the match is an equi-join with a residual test, never a product.
    """
    asked = queries.select("query_id", F.explode(T.fts_prefixes(F.col("query"))).alias("prefix"))
    if contains:
        cut = postings.select("scope", "token", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.substring("token", i, 1)))).alias("head"))
        met = asked.withColumn("head", F.substring("prefix", 1, 1)).join(cut, "head").where(F.col("token").contains(F.col("prefix")))
    else:
        width = F.least(F.length("prefix"), F.lit(2))
        cut = postings.select("scope", "token", F.explode(F.array_distinct(F.array(F.substring("token", 1, 1), F.substring("token", 1, 2)))).alias("head"))
        met = asked.withColumn("head", F.expr("substring(prefix, 1, least(length(prefix), 2))")).where(width > 0).join(cut, "head").where(F.col("token").startswith(F.col("prefix")))
    return met.select("query_id", "scope").distinct()


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def after(prefix: str) -> str | None:
    """The least string above all that start with prefix, in the order of code points; None if there is none."""
    while prefix:
        code = ord(prefix[-1]) + 1
        if code <= 0x10FFFF:
            return prefix[:-1] + chr(0xE000 if 0xD800 <= code < 0xE000 else code)
        prefix = prefix[:-1]
    return None


def spans(prefixes: list[str]) -> list[tuple[str, str | None]]:
    """Prefixes as ranges [from, to) of strings, sorted, those within others left out."""
    out: list[tuple[str, str | None]] = []
    for p in sorted(set(prefixes)):
        if not out or not (out[-1][1] is None or p < out[-1][1]):
            out.append((p, after(p)))
    return out


@dataclass(frozen=True)
class Layout:
    """How a segment is written. block_items: items of a block of postings, about; part_terms: terms of a part of the dictionary."""

    buckets: int = 16
    size: int = 2000
    block_items: int = 1024
    part_terms: int = 200_000
    segments: int = 6
    row_group: int = 4 << 20


#: What an index can hold besides its files: BM25, TF-IDF, names of files, full text.
PARTS = ("words", "tokens", "names", "full")


@dataclass(frozen=True)
class Kept:
    """A written index: postings with their statistics, in segments that are never changed.

    words: scope, item_id, token, tf, dl, grp (BM25); blocks: token, scope, grp, n, max_tf, min_dl, the bounds of the
    blocks of words; tokens: scope, item_id, token, w (unit tf-idf weights), idf; scopes: scope, n, avgdl; terms: token,
    term, a sorted dictionary in parts; full: term, scope (full text); names: token, scope; files: scope, n_items.
    An index may hold only some of PARTS; `with_parts` adds others.

    Tables with a token lie in folders by its hash; the dictionary and its postings in parts by ranges of terms, whose bounds
    are kept, so a prefix is a range of parts and, in these, of row groups. A scope (a file) lies in one segment: `update`
    writes one with the changed scopes and notes that the older segments' rows of them are dead, and merges the
    smaller segments when there are too many. Statistics are those of a scope, so scores do not depend on the segments.
    """

    spark: SparkSession
    root: str
    number: int
    manifest: dict
    layout: Layout

    @property
    def buckets(self) -> int:
        return self.layout.buckets

    @staticmethod
    def build(rows: DataFrame, names: DataFrame, root: str | None = None, buckets: int = 16, size: int = 2000, layout: Layout | None = None, parts: tuple[str, ...] = PARTS) -> Kept:
        """Index rows (scope, item_id, text); names: (scope, token), the words by which a file is found without its text."""
        spark = rows.sparkSession
        root = root or scratch_path(spark, "index")
        layout = layout or Layout(buckets=buckets, size=size)
        segment = _write_segment(rows, names, root, layout, parts)
        manifest = {"segments": [segment], "layout": asdict(layout)}
        return Kept(spark, root, versions.publish(spark, root, max([0, *versions.numbers(spark, root)]), manifest), manifest, layout)

    @staticmethod
    def open(spark: SparkSession, root: str) -> Kept:
        found = versions.newest(spark, root)
        if found is None:
            raise FileNotFoundError(f"no index under {root}")
        return Kept(spark, root, *found, Layout(**found[1]["layout"]))

    def _next(self, segments: list[dict]) -> Kept:
        manifest = self.manifest | {"segments": segments}
        return Kept(self.spark, self.root, versions.publish(self.spark, self.root, self.number, manifest), manifest, self.layout)

    @property
    def parts(self) -> tuple[str, ...]:
        return tuple(p for p in PARTS if all(p in s["schemas"] for s in self.manifest["segments"]))

    def with_parts(self, rows: DataFrame, names: DataFrame, parts: tuple[str, ...]) -> Kept:
        """The index with these parts, too, from the same rows and names; to be called before any update."""
        if set(parts) <= set(self.parts):
            return self
        (segment,) = self.manifest["segments"]
        return self._next([_write_segment(rows, names, self.root, self.layout, tuple(p for p in parts if p not in self.parts), segment)])

    def update(self, rows: DataFrame, names: DataFrame, gone: DataFrame | None = None) -> Kept:
        """The next version: the scopes of rows are indexed anew, those of gone (scope) fall out; others are not read.

        rows holds all items of each scope that it holds any of.
        """
        segment = _write_segment(rows, names, self.root, self.layout, self.parts)
        dead = self._rows(segment, "files").select("scope")
        dead = (dead.unionByName(gone.select("scope")) if gone is not None else dead).distinct()
        at = f"{segment['path']}/dead"
        dead.write.parquet(f"{self.root}/{at}")
        n = self.spark.read.parquet(f"{self.root}/{at}").count()
        older = [s | {"dead": [*s["dead"], [at, n]]} for s in self.manifest["segments"]]
        return self._next([*older, segment])._merged()

    def _merged(self) -> Kept:
        """Where there are more than `segments`, the newest ones that together are no larger than the one before them become one."""
        segments = self.manifest["segments"]
        if len(segments) <= self.layout.segments:
            return self
        first = len(segments) - 2
        while first > 0 and (segments[first - 1]["items"] <= sum(s["items"] for s in segments[first:]) or first >= self.layout.segments):
            first -= 1
        new = _merge_segments(self, segments[first:])
        return self._next([*segments[:first], new])

    def _rows(self, segment: dict, name: str, paths: list[str] | None = None) -> DataFrame:
        """A table of one segment less its dead scopes."""
        base = f"{self.root}/{segment['path']}/{name}"
        reader = self.spark.read.schema(StructType.fromJson(json.loads(segment["schemas"][name]))).option("basePath", base)
        rows = reader.parquet(*(paths if paths is not None else [base]))
        if "scope" in rows.columns:
            for at, n in segment["dead"]:
                gone = self.spark.read.parquet(f"{self.root}/{at}")
                rows = rows.join(F.broadcast(gone) if n <= BROADCAST_ROWS else gone, "scope", "left_anti")
        return rows

    def table(self, name: str) -> DataFrame:
        parts = [self._rows(s, name) for s in self.manifest["segments"]]
        return reduce(DataFrame.unionByName, parts)

    def postings(self, name: str, asked: DataFrame, most: int = 5000) -> DataFrame:
        """Rows of the asked tokens. Up to `most` of them are written into the plan, so that only their folders are
        read, and in these the row groups that can hold them; more are joined."""
        asked = asked.select("token").distinct()
        some = [r["token"] for r in asked.limit(most + 1).collect()]
        rows = self.table(name)
        if len(some) > most:
            return rows.join(asked, "token").drop("bucket")
        folders = self.spark.createDataFrame([(t,) for t in some], "token string").select(_bucket(F.col("token"), self.buckets).alias("b")).distinct()
        return rows.where(F.col("bucket").isin([r["b"] for r in folders.collect()]) & F.col("token").isin(some)).drop("bucket")

    def blocks_of(self, asked: DataFrame, groups: DataFrame, most: int = 2000) -> DataFrame:
        """Postings of the asked tokens in the given blocks (grp): of few blocks, these reach the scan, which skips other row groups."""
        rows = self.postings("words", asked)
        some = [r["grp"] for r in groups.select("grp").distinct().limit(most + 1).collect()]
        return rows.where(F.col("grp").isin(some)) if len(some) <= most else rows

    def prefix_terms(self, segment: dict, prefixes: list[str], ranges: int = 256) -> DataFrame:
        """(token, term) of a segment's terms that start with one of the prefixes: of the parts and row groups that can hold them."""
        wanted = spans(prefixes)
        parts = [p for p, low, high, *_ in segment["parts"] if any(high >= a and (b is None or low < b) for a, b in wanted)]
        if not parts:
            return self.spark.createDataFrame([], "token string, term long, part int")
        rows = self._rows(segment, "terms", [f"{self.root}/{segment['path']}/terms/part={p}" for p in parts])
        if len(wanted) > ranges:  # neighbours are read as one range; the caller's join has the prefixes themselves
            step = -(-len(wanted) // ranges)
            wanted = [(wanted[i][0], wanted[min(i + step, len(wanted)) - 1][1]) for i in range(0, len(wanted), step)]
        token = F.col("token")
        return rows.where(reduce(lambda x, y: x | y, [(token >= a) & (token < b) if b is not None else token >= a for a, b in wanted]))

    def matches(self, queries: DataFrame, most: int = 5000) -> DataFrame:
        """(query_id, scope): the files with a token that starts with a prefix of the query.

        Up to `most` distinct prefixes prune the dictionary and the postings of its terms; more meet the whole dictionary.
        """
        asked = materialize(queries.select("query_id", F.explode(T.fts_prefixes(F.col("query"))).alias("prefix")).distinct(), "prefixes")
        some = [r["prefix"] for r in asked.select("prefix").distinct().limit(most + 1).collect()]
        heads = asked.withColumn("head", F.expr("substring(prefix, 1, least(length(prefix), 2))"))
        found = []
        if "full" not in self.parts:
            raise ValueError("the index has no full text")
        for segment in self.manifest["segments"]:
            terms = self.prefix_terms(segment, some) if len(some) <= most else self._rows(segment, "terms")
            bounds = terms.groupBy("part").agg(F.min("term").alias("low"), F.max("term").alias("high")).collect()  # one row a part
            if not bounds:
                continue
            cut = terms.select("token", "term", F.explode(F.array_distinct(F.array(F.substring("token", 1, 1), F.substring("token", 1, 2)))).alias("head"))
            met = heads.join(cut, "head").where(F.col("token").startswith(F.col("prefix"))).select("query_id", "term")
            full = self._rows(segment, "full", [f"{self.root}/{segment['path']}/full/part={r['part']}" for r in bounds])
            inside = reduce(lambda x, y: x | y, [F.col("term").between(r["low"], r["high"]) for r in bounds]) if len(bounds) <= 256 else F.lit(True)
            found.append(full.where(inside).join(met, "term").select("query_id", "scope"))
        if not found:
            kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), "scope": self.table("files").schema["scope"].dataType.simpleString()}
            return self.spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in kinds.items()))
        return reduce(DataFrame.unionByName, found).distinct()


@dataclass
class _Writer:
    """Writes the tables of one segment and keeps their schemas, since a table without rows has no file."""

    spark: SparkSession
    at: str
    layout: Layout
    schemas: dict
    items: int = 0

    def write(self, df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
        writer = df.write.option("parquet.block.size", self.layout.row_group)
        (writer.partitionBy(partition) if partition else writer).parquet(f"{self.at}/{name}")
        self.schemas[name] = df.schema.json()
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{name}")

    def put(self, df: DataFrame, name: str, order: tuple[str, ...] = (), over: tuple[str, ...] = ("scope",)) -> DataFrame:
        """A table with a token: in folders by its hash, sorted, each over as many files as give FILE_ITEMS items to one, dealt by `over`.

        Rows move once, to the file that their hashes name; nothing is sampled before.
        """
        files = max(1, ceil(self.items / (FILE_ITEMS * self.layout.buckets)))
        df = df.withColumn("bucket", _bucket(F.col("token"), self.layout.buckets))
        at = F.col("bucket") * files + F.pmod(F.xxhash64(*over), F.lit(files)).cast("int")
        return self.write(df.repartitionById(self.layout.buckets * files, at).sortWithinPartitions("bucket", "token", *order), name, "bucket")

    def dictionary(self, full: DataFrame) -> list[list]:
        """terms and full of (token, scope) in parts by ranges of tokens; gives [part, first, last, least term, greatest term]."""
        full = materialize(full, "full")
        distinct = materialize(full.select("token").distinct(), "distinct")
        parts = max(1, ceil(distinct.count() / self.layout.part_terms))
        placed = distinct.repartitionByRange(parts, "token").sortWithinPartitions("token")
        terms = self.write(placed.withColumn("term", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "terms", "part")
        met = full.join(terms, "token").select("term", "scope", "part")
        self.write(met.repartitionByRange("part", "term", "scope").sortWithinPartitions("part", "term", "scope"), "full", "part")
        discard(full)
        discard(distinct)
        bounds = terms.groupBy("part").agg(F.min("token").alias("a"), F.max("token").alias("b"), F.min("term").alias("c"), F.max("term").alias("d"))
        return [[r["part"], r["a"], r["b"], r["c"], r["d"]] for r in bounds.orderBy("part").collect()]  # one row a part

    def words(self, words: DataFrame, n: DataFrame) -> DataFrame:
        """words with the block of each posting, and the bounds of the blocks.

        A block holds items of like length, by a hash: the same items for every token of a scope.
        """
        kind = (F.floor(F.log2(F.greatest("dl", F.lit(1))) * 2) * (1 << 20)).cast("int")
        spread = F.pmod(F.xxhash64("item_id"), F.least(F.greatest(F.ceil(F.col("n") / self.layout.block_items), F.lit(1)), F.lit(1 << 20))).cast("int")
        written = self.put(words.join(small(n), "scope").withColumn("grp", kind + spread).drop("n"), "words", ("scope", "grp"), ("scope", "grp"))
        self.put(written.groupBy("token", "scope", "grp").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl")), "blocks", ("scope",), ("scope", "grp"))
        return written

    def tokens(self, rows: DataFrame, n: DataFrame) -> None:
        """Unit tf-idf weights of the vocabulary of each scope. Texts are read twice, so that no counts wait on disk for the vocabulary."""
        tf = term_frequencies(rows)
        idf = _chosen(rows, tf, self.layout.size).join(n, "scope").select("scope", "token", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
        idf = materialize(idf, "idf")
        weight = tf.join(small(idf), ["scope", "token"]).withColumn("w", F.col("tf") / F.col("dl") * F.col("idf"))
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("scope", "item_id")))
        self.put(weight.select("scope", "item_id", "token", (F.col("w") / norm).alias("w"), "idf"), "tokens", ("scope",), ("item_id",))
        discard(idf)

    def done(self, parts: list[list], own: str) -> dict:
        return {"path": own, "items": self.items, "parts": parts, "dead": [], "schemas": self.schemas}


def small(table: DataFrame) -> DataFrame:
    """A written table, broadcast where it has no more than BROADCAST_ROWS rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _chosen(rows: DataFrame, tf: DataFrame, size: int, buckets: int = 32) -> DataFrame:
    """(scope, token, df): `vocabulary` of rows, by counts and first items; places are looked up only in the one item of a scope where
    the cut falls between tokens of the same count and first item."""
    counts = tf.groupBy("scope", "token").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"), F.min("item_id").alias("item_id"))
    counts = counts.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)))
    order = [F.desc("cf"), F.asc("item_id")]
    best = counts.withColumn("rank", F.rank().over(Window.partitionBy("scope", "bucket").orderBy(*order))).where(F.col("rank") <= size)
    best = best.withColumn("rank", F.rank().over(Window.partitionBy("scope").orderBy(*order))).where(F.col("rank") <= size)
    best = materialize(best.withColumn("tied", F.count("*").over(Window.partitionBy("scope", "rank"))), "best")
    tied = best.where(F.col("rank") + F.col("tied") - 1 > size)
    texts = rows.join(small(tied.select("scope", "item_id").distinct()), ["scope", "item_id"], "left_semi")
    place = texts.select("scope", "item_id", F.posexplode(T.tfidf_tokens(F.col("text"))).alias("pos", "token")).groupBy("scope", "item_id", "token").agg(F.min("pos").alias("pos"))
    last = tied.join(place, ["scope", "item_id", "token"]).withColumn("nth", F.row_number().over(Window.partitionBy("scope").orderBy("pos")))
    return best.where(F.col("rank") + F.col("tied") - 1 <= size).select("scope", "token", "df").unionByName(last.where(F.col("rank") + F.col("nth") - 1 <= size).select("scope", "token", "df"))


def _write_segment(rows: DataFrame, names: DataFrame, root: str, layout: Layout, parts: tuple[str, ...], old: dict | None = None) -> dict:
    """A segment of rows with these parts; with an old one of the same rows, that and these parts, in its folder."""
    spark, own = rows.sparkSession, old["path"] if old else f"segments/{uuid.uuid4().hex}"
    out = _Writer(spark, f"{root}/{own}", layout, dict(old["schemas"]) if old else {})
    files = spark.read.schema(StructType.fromJson(json.loads(out.schemas["files"]))).parquet(f"{out.at}/files") if old else out.write(rows.groupBy("scope").agg(F.count("*").alias("n_items")), "files")
    out.items = files.agg(F.coalesce(F.sum("n_items"), F.lit(0)).alias("n")).first()["n"]
    n = files.withColumnRenamed("n_items", "n")
    if "words" in parts:
        words = out.words(term_frequencies(rows, T.bm25_tokens).drop("pos"), n)
        total = words.groupBy("scope").agg(F.sum("tf").alias("total"))
        out.write(n.join(total, "scope", "left").select("scope", "n", (F.coalesce("total", F.lit(0)) / F.col("n")).alias("avgdl")), "scopes")
    if "tokens" in parts:
        out.tokens(rows, n)
    if "names" in parts:
        out.put(names.select("token", "scope").distinct(), "names")
    return out.done(out.dictionary(fts_postings(rows)) if "full" in parts else old["parts"] if old else [], own)


def _merge_segments(kept: Kept, segments: list[dict]) -> dict:
    """One segment with the live rows of several; texts are not read again."""
    own = f"segments/{uuid.uuid4().hex}"
    out = _Writer(kept.spark, f"{kept.root}/{own}", kept.layout, {})
    live = lambda name: reduce(DataFrame.unionByName, [kept._rows(s, name) for s in segments])
    files = out.write(live("files"), "files")
    out.items = files.agg(F.coalesce(F.sum("n_items"), F.lit(0)).alias("n")).first()["n"]
    if "words" in kept.parts:
        out.write(live("scopes"), "scopes")
    for part, name, order, over in (("words", "words", ("scope", "grp"), ("scope", "grp")), ("words", "blocks", ("scope",), ("scope", "grp")), ("tokens", "tokens", ("scope",), ("item_id",)), ("names", "names", (), ("scope",))):
        if part in kept.parts:
            out.put(live(name).drop("bucket"), name, order, over)
    if "full" not in kept.parts:
        return out.done([], own)
    full = [kept._rows(s, "full").join(kept._rows(s, "terms").select("term", "token"), "term").select("token", "scope") for s in segments]
    return out.done(out.dictionary(reduce(DataFrame.unionByName, full)), own)
