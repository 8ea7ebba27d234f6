"""Exact n-gram Jaccard join through a token-group matrix.

The figures here are those of the defaults, the query's; shingle width and similarity are parameters, from
which levels and parts follow. A document's set holds the hashes of its distinct 3-word shingles (A-Z lowered, words
split at ASCII white space); with fewer words, its whole sequence as one; without words, or with null text, the set
is empty and links with nothing. Two documents link when 100 * |intersection| >= 90 * |union|.

Tokens. Linked sets of sizes s and t differ in at most (s + t) / 19 shingles; for a set of size s, and its largest
partner, this is its H. Sizes are cut into classes of ratio 10/9, so linked sets lie in one class or in neighbours;
level j serves pairs whose larger class is j. There the shingle space is cut into parts, and a token is (level, part,
content of the set in that part). A shingle that differs spoils one part, so a set with K tokens shares at least
K - H of them, its `need`, with every linked set. There are so many parts that `need` is some 0.3 H and more: a
passage that many documents quote makes a token here and there, never enough. Parts without a shingle give no token,
but where a set has no more than H others.

Groups. Documents with equal sets collapse first. Every document picks the document with which it shares most
tokens, among the first documents of its tokens; those that pick the same one, the lead, are a group, in parts
of GROUP documents or GROUP_SHINGLES shingles, the lead in every part; leads are compared with their own picks too,
so groups of one family meet in a tree. A task compares each part with itself, and connected components of what
it found are the classes so far. The matrix then holds, for every token, the units that have it: classes of two
and more, and the other documents by the part of their group. A query document is bounded by the number of
its tokens in a unit; only units that reach its `need` are opened, by the document of the smaller unit, and only where
they are not of its class. In an opened part the query must have at least 90 % of its own shingles in the
union of the members before it is counted, shingle by shingle, against every member. No pair of a group is
emitted, tasks return spanning links, and no link between two classes is lost.

Texts move once into their group and once for each unit opened. Queries of a unit that is opened often are
dealt to slices of SLICE. Rows with a null doc_id stand alone (component_id null); repeated rows share a class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby
from math import exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodewell.llm.skew import fetch
from lodewell.llm.textkit import mix, shingles, words
from lodewell.plans import skew
from lodewell.plans.components import connected_components
from lodewell.plans.storage import discard, materialize, small_batches


@dataclass(frozen=True)
class Params:
    """Linked: num * union <= den * intersection; the defaults are those of the query."""

    shingle: int = 3
    num: int = 90
    den: int = 100


#: Documents and shingles of a part of a group, and queries of a slice.
GROUP = 512
GROUP_SHINGLES = 1 << 20
SLICE = 4096
#: Documents of a token beyond which it is counted last.
HOT = 32


def shingle_set(text: str | None, p: Params) -> np.ndarray:
    return np.unique(shingles(words((text or "").encode())[2], p.shingle))


@lru_cache(maxsize=4096)
def _level(j: int, p: Params) -> tuple[int, int, np.ndarray]:
    """Smallest and largest size in class j, and the lower bounds of the parts that serve level j."""
    low = 1
    for _ in range(j):
        low = low * p.den // p.num + 1
    high = low * p.den // p.num
    least = -(-low * p.num // p.den)  # the smallest set that links with one of this class
    parts = 2 * high * (p.den - p.num) // (p.den + p.num) + 1
    while parts < 2 * least:  # until the smallest set has 1.3 times as many parts with shingles as may differ
        full = parts * (1 - exp(-least / parts))
        if full - 2 * sqrt(full * exp(-least / parts)) >= 1.3 * _most(least, high, p):
            break
        parts += 1
    return low, high, np.array([-((-i << 64) // parts) for i in range(parts)], np.uint64)


def _most(n: int, high: int, p: Params) -> int:
    """In how many shingles a set of n can differ from a linked one of `high` shingles at most."""
    return (n + min(high, n * p.den // p.num)) * (p.den - p.num) // (p.den + p.num)


def _class_of(n: int, p: Params) -> int:
    j = 0
    while _level(j, p)[1] < n:
        j += 1
    return j


def _levels(n: int, p: Params) -> list[int]:
    """The levels that a set of n needs: that of its class, and the next one if a linked set can lie there."""
    j = _class_of(n, p)
    return [j, j + 1] if n * p.den // p.num >= _level(j + 1, p)[0] else [j]


def _cut(own: np.ndarray, level: int, p: Params) -> tuple[np.ndarray, np.ndarray, int]:
    """The bounds of the parts of a sorted set, which of them give tokens, and how many a linked set must share."""
    _, high, bounds = _level(level, p)
    at = np.append(np.searchsorted(own, bounds), len(own))
    full = np.diff(at) > 0
    need = int(full.sum()) - _most(len(own), high, p)
    return at, full if need > 0 else np.ones(len(full), bool), max(1, need)


def tokens(own: np.ndarray, p: Params) -> np.ndarray:
    """The tokens of a sorted set at its levels; the last bit is that of the level."""
    sums = np.zeros(len(own) + 1, np.uint64)
    np.cumsum(mix(own + np.uint64(1)), out=sums[1:])
    out = []
    for level in _levels(len(own), p):
        at, kept, _ = _cut(own, level, p)
        part = np.arange(len(kept), dtype=np.uint64) + np.uint64(level << 40)
        whole = mix((sums[at[1:]] - sums[at[:-1]]) ^ mix(part + np.uint64(0x51ED27)))[kept]
        out.append((whole & ~np.uint64(1)) | np.uint64(level & 1))
    return np.concatenate(out)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def features(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, n_shingles, a 128-bit signature of the set, and the needs at its even and at its odd level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, needs = [], [], [], ([], [])
            for text in batch.column(1).to_pylist():
                own = shingle_set(text, p)
                n.append(len(own))
                one.append(mix(own).sum(dtype=np.uint64))
                two.append(mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
                need = {level & 1: _cut(own, level, p)[2] for level in _levels(len(own), p)}
                for k in (0, 1):
                    needs[k].append(need.get(k, 1))
            sig = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *sig, *(pa.array(x, pa.int32()) for x in needs)], names=["doc_id", "n_shingles", "sig1", "sig2", "even", "odd"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_shingles long, sig1 long, sig2 long, even int, odd int")


def token_rows(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, token) of all tokens of all documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = shingle_set(text, p)
                if len(own):
                    found.append(tokens(own, p))
                    ids.append(np.full(len(found[-1]), doc, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(found).view(np.int64))], names=["doc_id", "token"])

    return docs.where("doc_id is not null and text is not null").mapInArrow(run, "doc_id long, token long")


class Group:
    """The members of a part of a group, their union of shingles, and the classes found so far."""

    def __init__(self, members: list[tuple[int, int, np.ndarray]]):
        self.owners, self.classes = [d for d, _, _ in members], [c for _, c, _ in members]
        sets = [x for _, _, x in members]
        self.union = np.unique(np.concatenate(sets))
        self.flat = np.concatenate([np.searchsorted(self.union, x) for x in sets])
        self.sizes = np.array([len(x) for x in sets])
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.flags = np.zeros(len(self.union), np.int64)
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while self.up.setdefault(x, x) != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def ask(self, label: int, own: np.ndarray, p: Params) -> list[int]:
        """Members of other classes that link with a set of class label: one for each class, which are united."""
        at = np.searchsorted(self.union, own)
        at = at[(at < len(self.union)) & (self.union[np.minimum(at, len(self.union) - 1)] == own)]
        if p.den * len(at) < p.num * len(own):
            return []
        self.flags[at] = 1
        both = np.add.reduceat(self.flags[self.flat], self.starts)
        self.flags[at] = 0
        found = []
        for i in np.flatnonzero(p.den * both >= p.num * (len(own) + self.sizes - both)):
            a, b = self.top(label), self.top(self.classes[i])
            if a != b:
                self.up[max(a, b)] = min(a, b)
                found.append(self.owners[i])
        return found


def _in_groups(docs: DataFrame, visits: DataFrame, key: list[str], handle, schema: str, p: Params) -> DataFrame:
    """handle(rows of one key, as an iterator of (doc_id, class, asks, set); members come before those that ask)."""
    texts = fetch(_texts(docs), visits, "doc_id", visits.count())
    laid = texts.repartition(*key).sortWithinPartitions(*key, "asks", "doc_id").select(*key, "doc_id", "class", "asks", "text")
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for i, doc in enumerate(columns[-4]):
                yield tuple(c[i] for c in columns[:-4]), (doc, columns[-3][i], columns[-2][i], shingle_set(columns[-1][i], p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(len(names))], names=names)
            out.clear()
            return done

        for _, own in groupby(rows(batches), key=lambda x: x[0]):
            for found in handle(x for _, x in own):
                out.append(found)
                if len(out) >= 8192:
                    yield batch()
        yield batch()

    return laid.mapInArrow(run, schema)


def within(docs: DataFrame, visits: DataFrame, p: Params) -> DataFrame:
    """(doc_id, label): the classes inside the parts (lead, part); a class that holds the lead is named by it."""

    def handle(rows) -> Iterator[tuple[int, int]]:
        members, lead = [], None
        for doc, own, _, found in rows:
            lead = own
            members.append((doc, doc, found))
        members.sort(key=lambda x: x[0] != lead)
        group = Group(members)
        for i, (doc, _, found) in enumerate(members):
            if i == 0 or group.top(doc) != group.top(lead):
                group.ask(doc, found, p)
        main = group.top(lead)
        yield from {(doc, lead if group.top(doc) == main else group.top(doc)) for doc, _, _ in members}

    return _in_groups(docs, visits, ["lead", "part"], handle, "doc_id long, label long", p)


def between(docs: DataFrame, visits: DataFrame, p: Params) -> DataFrame:
    """(src, dst): links of the documents that ask with the members of the parts that they open."""

    def handle(rows) -> Iterator[tuple[int, int]]:
        members, group = [], None
        for doc, label, asks, found in rows:
            if not asks:
                members.append((doc, label, found))
                continue
            if group is None:
                group = Group(members)
            yield from ((doc, other) for other in group.ask(label, found, p))

    return _in_groups(docs, visits, ["unit", "part", "slice"], handle, "src long, dst long", p)


def shared_tokens(docs: DataFrame, feats: DataFrame, p: Params) -> DataFrame:
    """(doc_id, token, leader) of the tokens that more than one document has; of documents with equal sets only the first counts."""
    sets = feats.where("doc_id is not null and n_shingles > 0")
    reps = sets.groupBy("sig1", "sig2", "n_shingles").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    copies = materialize(sets.select("doc_id").distinct().join(reps, "doc_id", "left_anti"), "copies")
    few = copies.count() <= skew.BROADCAST_ROWS
    texts = _texts(docs)
    rows = token_rows(texts.join(F.broadcast(copies), "doc_id", "left_anti") if few else texts, p)
    places = Window.partitionBy("token").orderBy("doc_id")
    met = rows.withColumn("leader", F.first("doc_id").over(places.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("doc_id").over(places))
    met = met.where((F.col("leader") < F.col("doc_id")) | (F.col("leader") < F.col("next"))).select("doc_id", "token", "leader")
    if not few:
        met = met.join(copies, "doc_id", "left_anti")
    met = materialize(met, "shared")
    discard(copies)
    return met


def groups(shared: DataFrame, feats: DataFrame) -> DataFrame:
    """doc_id, lead, part, parts, n (of the group), pick, even, odd for every document that shares a token; pick is that of a lead."""
    needs = feats.where("doc_id is not null").groupBy("doc_id").agg(F.sum("n_shingles").alias("size"), F.min("even").alias("even"), F.min("odd").alias("odd"))
    common = shared.where("doc_id != leader").groupBy("doc_id", "leader").agg(F.count("*").alias("c"))
    best = common.groupBy("doc_id").agg(F.max(F.struct("c", (-F.col("leader")).alias("k"))).alias("best")).select("doc_id", F.col("best.c").alias("c"), (-F.col("best.k")).alias("lead"))
    known = shared.select("doc_id").distinct().join(needs, "doc_id")
    picks = known.join(best, "doc_id", "left").select("doc_id", "size", "even", "odd", F.when(F.col("c") >= F.least("even", "odd"), F.col("lead")).alias("lead"))
    picks = materialize(picks, "picks")
    leads = picks.where("lead is not null").select(F.col("lead").alias("doc_id")).distinct().withColumn("leads", F.lit(True))
    own = picks.join(leads, "doc_id", "left").select("doc_id", "size", "even", "odd", F.when(F.col("leads") | F.col("lead").isNull(), F.col("doc_id")).otherwise(F.col("lead")).alias("lead"), F.when(F.col("leads"), F.col("lead")).alias("pick"))
    sizes = own.groupBy("lead").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("size") / GROUP_SHINGLES)).cast("int").alias("parts")).withColumn("m", F.col("n"))
    laid = skew.hot_join(own, sizes, ["lead"], "m", picks.count())
    return laid.select("doc_id", "lead", F.pmod(F.xxhash64("doc_id"), "parts").cast("int").alias("part"), "parts", "n", "pick", "even", "odd")


def open_units(shared: DataFrame, marked: DataFrame) -> DataFrame:
    """(doc_id, unit): the units that a document must ask, by its tokens in them.

    marked: doc_id, unit, size (of the unit), class, even, odd. No token of a document that is not deep has more than
    HOT rows, so the rows that meet grow with the tokens.
    """
    hot = shared.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("token", F.lit(True).alias("hot"))
    hot = materialize(hot, "hot")
    is_odd = F.col("token").bitwiseAND(F.lit(1)) == 1
    rows = shared.select("doc_id", "token").join(F.broadcast(hot) if hot.count() <= skew.BROADCAST_ROWS else hot, "token", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    lost = rows.where("hot").groupBy("doc_id").agg(F.count_if(~is_odd).alias("lost_even"), F.count_if(is_odd).alias("lost_odd"))
    less = lambda k: F.col(k) - F.coalesce(f"lost_{k}", F.lit(0))
    needs = marked.join(lost, "doc_id", "left").withColumn("deep", (less("even") < 1) | (less("odd") < 1))
    needs = needs.select("doc_id", "unit", "size", "class", "deep", *[F.when(F.col("deep"), F.col(k)).otherwise(less(k)).alias(k) for k in ("even", "odd")])
    rows = rows.join(needs, "doc_id").where("deep or not hot").withColumn("need", F.when(is_odd, F.col("odd")).otherwise(F.col("even"))).drop("even", "odd", "hot")
    matrix = rows.groupBy("token", "unit", "deep").agg(F.first("size").alias("of"), F.min("class").alias("low"), F.max("class").alias("high")).withColumnsRenamed({"unit": "other", "deep": "other_deep"})
    smaller = F.struct("size", "unit") < F.struct(F.col("of").alias("size"), F.col("other").alias("unit"))
    asks = F.when(F.col("deep") == F.col("other_deep"), smaller).otherwise(~F.col("deep") & (F.col("unit") != F.col("other")))
    met = rows.join(matrix, "token").where(asks & ((F.col("low") != F.col("class")) | (F.col("high") != F.col("class"))))
    counts = met.groupBy("doc_id", "other", "other_deep", is_odd.alias("is_odd")).agg(F.count("*").alias("c"), F.first("need").alias("need"))
    return counts.where(F.col("c") >= F.col("need")).select("doc_id", F.col("other").alias("unit")).distinct()


def links(docs: DataFrame, feats: DataFrame, p: Params) -> DataFrame:
    """(src, dst): spanning links of all documents with different sets."""
    shared = shared_tokens(docs, feats, p)
    laid = materialize(groups(shared, feats), "groups")
    inside = laid.where("n > 1").select("doc_id", "lead", "part")
    heads = laid.where("doc_id = lead").select("lead", "parts")
    spread = heads.where("parts > 1").select(F.col("lead").alias("doc_id"), "lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    bridge = laid.where("pick is not null").select("doc_id", F.col("pick").alias("lead")).join(heads, "lead").select("doc_id", "lead", F.pmod(F.xxhash64("doc_id"), "parts").cast("int").alias("part"))
    inside = inside.union(spread).union(bridge).union(bridge.select(F.col("lead").alias("doc_id"), "lead", "part")).distinct()
    inside = materialize(inside.select("doc_id", "lead", "part", F.col("lead").alias("class"), F.lit(False).alias("asks")), "inside")
    stars = materialize(within(docs, inside, p), "stars")
    classes = connected_components(stars, "doc_id", "label")
    marked = laid.join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "lead", "part", F.coalesce("component", "doc_id").alias("class"), "even", "odd")
    marked = materialize(marked, "marked")
    total = marked.count()
    sizes = marked.groupBy("class").agg(F.count("*").alias("n"), F.ceil(F.count("*") / GROUP).cast("int").alias("parts")).withColumn("m", F.col("n"))
    own = skew.hot_join(marked, sizes, ["class"], "m", total)
    many = F.col("n") > 1
    own = own.select("doc_id", F.when(many, F.xxhash64("class")).otherwise(F.xxhash64("lead", "part")).alias("unit"), F.when(many, F.pmod(F.xxhash64("doc_id"), "parts")).otherwise(0).cast("int").alias("part"), "class", "even", "odd")
    own = materialize(own, "own")
    sizes = own.groupBy("unit").agg(F.count("*").alias("size")).withColumn("m", F.col("size"))
    units = materialize(skew.hot_join(own, sizes, ["unit"], "m", total), "units")
    opened = materialize(open_units(shared, units.select("doc_id", "unit", "size", "class", "even", "odd")), "opened")
    discard(shared)
    asks = opened.join(units.select("unit", "part").distinct(), "unit").join(units.select("doc_id", "class"), "doc_id")
    asks = materialize(asks.select("doc_id", "unit", "part", "class"), "asks")
    slices = asks.groupBy("unit", "part").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    members = units.join(slices, ["unit", "part"]).select("doc_id", "unit", "part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "class", F.lit(False).alias("asks"))
    queries = asks.join(slices, ["unit", "part"]).select("doc_id", "unit", "part", F.pmod(F.xxhash64("doc_id"), "slices").cast("int").alias("slice"), "class", F.lit(True).alias("asks"))
    visits = materialize(members.unionByName(queries), "visits")
    return stars.select(F.col("doc_id").alias("src"), F.col("label").alias("dst")).union(between(docs, visits, p))


def jaccard_classes(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs; an empty table gives an empty result."""
    small_batches(docs.sparkSession)
    feats = materialize(features(docs, p), "features")
    final = connected_components(links(docs, feats, p))
    sets = feats.where("doc_id is not null and n_shingles > 0")
    reps = sets.groupBy("sig1", "sig2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m"))
    named = reps.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("sig1", "sig2", "n_shingles", "m", F.coalesce("component", "rep").alias("component_id"))
    found = skew.hot_join(sets.select("doc_id", "n_shingles", "sig1", "sig2"), named, ["sig1", "sig2", "n_shingles"], "m", feats.count())
    alone = feats.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.select("doc_id", "n_shingles", "component_id").union(alone)


def keep_one(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One document of each class, that with the smallest doc_id, with all its columns.

    Documents with an empty set or a null doc_id stand alone and stay; rows that repeat a kept doc_id stay.
    """
    gone = materialize(jaccard_classes(docs, p).where("doc_id != component_id").select("doc_id").distinct(), "gone")
    if gone.count() <= skew.BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
