"""Embedding near-dedup over a robust-pruned flat graph.

Vectors are compared only within a block: equal, non-null labels and equal dimensions. Equal vectors
collapse first and count by their multiplicity. Every block is split into overlapping cluster shards, `tables` times
over: a cell of more than `max_shard_rows` vectors gets pivots, centres of a bounded sample of its own, and each of its
vectors goes to the `overlap` nearest, level by level, until all cells are small; pivots are made in tasks,
for any number of blocks. A cell that does not shrink, since its vectors nearly all have one direction, is dealt out in
parts that share landmarks of it.

Each shard builds nearest-neighbour lists and prunes them robustly; the lists of a vector from all its shards are united
into one flat graph. The search then goes shard by shard over the united lists: neighbours outside the shard, within twice
the threshold's angle, come along as nodes with lists of their own, so a search crosses the borders of shards.
It runs for every vector from the shard's medoid, greedily, with a beam whose range grows while the vectors at
its rim are still within reach. All pairs so met that have a cosine of `threshold` or more, in double precision, are
links; a union-find in the task reduces them to a spanning forest.

Connected components of the links are then verified whole: every component is cut into blocks of
`block_rows` and each two blocks are compared in one matrix product, so the number of links of every
vector is exact within its component, without a row per pair. `audit` measures the recall of links
against brute force for all vectors whose id is divisible by 100.

Null labels, and vectors that are null, empty, zero or hold null or non-finite parts, link with nothing;
they are returned with no links, alone. Each row counts as a vector, so rows that repeat a vec_id link with
each other. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewell.llm.textkit import mix
from lodewell.plans import skew
from lodewell.plans.components import connected_components
from lodewell.plans.storage import materialize, small_batches


@dataclass(frozen=True)
class Params:
    threshold: float = 0.93
    shard_rows: int = 400
    max_shard_rows: int = 800
    tables: int = 2
    overlap: int = 2
    degree: int = 16
    candidates: int = 32
    alpha: float = 1.2
    beam: int = 32
    block_rows: int = 1024
    #: Pivots of a cell, sampled vectors for each, and rows of a task that deals out.
    max_pivots: int = 256
    per_pivot: int = 16
    chunk_rows: int = 4096
    landmarks: int = 16
    max_levels: int = 40


_KEY = ["label", "dim", "cell"]
_NODE = "label long, dim int, cell long, parent long, rep long, u binary"


def units(vectors: DataFrame) -> DataFrame:
    """One row per vector that can link: vec_id, label, dim, a digest of the vector, and its unit vector's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for vec_id, parts, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not parts or None in parts:
                    continue
                v = np.array(parts, np.float64) + 0.0
                if not np.isfinite(v).all() or not v.any():
                    continue
                v /= np.abs(v).max()
                u = v / np.sqrt(v @ v)
                d = hashlib.blake2b(np.array(parts, np.float64).tobytes(), digest_size=16).digest()
                rows.append((vec_id, label, len(v), int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), u.tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["vec_id", "label", "dim", "d1", "d2", "u"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    return rows.where("vec_id is not null and embedding is not null and label is not null").mapInArrow(run, "vec_id long, label long, dim int, d1 long, d2 long, u binary")


def _matrix(column) -> np.ndarray:
    rows = [np.frombuffer(x, np.float64) for x in column]
    return np.vstack(rows) if rows else np.zeros((0, 0))

def _sized(rows: DataFrame, sizes: DataFrame, n: int, total: int) -> DataFrame:
    """rows joined to a table of cells (`n` rows, counted, each with the rows of its cell in m)."""
    return rows.join(F.broadcast(sizes.drop("m")), _KEY) if n <= skew.BROADCAST_ROWS else skew.hot_join(rows, sizes, _KEY, "m", total)


def _centres(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = sample[np.sort(rng.choice(len(sample), k, replace=False))]
    for _ in range(3):
        near = np.argmax(sample @ centres.T, 1)
        for c in range(k):
            if (near == c).any():
                m = sample[near == c].mean(0)
                centres[c] = m / (np.sqrt(m @ m) or 1.0)
    return centres


def pivots(sample: DataFrame, p: Params) -> DataFrame:
    """label, dim, cell, k, centres: for each cell cluster centres of its sampled vectors (rep, u, size: of the cell)."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep")
        size = t.column("size")[0].as_py()
        v = _matrix(t.column("u").to_pylist())
        k = min(p.max_pivots, max(2 * p.overlap, -(-p.overlap * size // p.shard_rows)), len(v))
        centres = _centres(v, k, t.column("cell")[0].as_py() & 0xFFFFFFFF)
        return pa.table({c: t.column(c).slice(0, 1) for c in _KEY} | {"k": pa.array([k], pa.int32()), "centres": pa.array([centres.tobytes()], pa.binary())})

    return sample.groupBy(*_KEY).applyInArrow(run, "label long, dim int, cell long, k int, centres binary")


def _split(rows: DataFrame, large: DataFrame, n_large: int, total: int, level: int, p: Params) -> DataFrame:
    """The vectors of large cells (size in m) under the cells of their `overlap` nearest pivots."""
    sized = _sized(rows, large.withColumn("size", F.col("m")), n_large, total)
    want = F.least(F.lit(p.max_pivots), F.greatest(F.lit(2 * p.overlap), F.ceil(p.overlap * F.col("size") / p.shard_rows))) * (2 * p.per_pivot)
    dice = F.pmod(F.xxhash64("rep", F.lit(level)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = sized.where(dice * F.col("size") <= want).select(*_KEY, "rep", "u", "size")
    found = pivots(sample, p)
    chunks = F.ceil(F.col("size") / p.chunk_rows).cast("int")
    dealt = sized.withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(level + 1000)), chunks).cast("int")).select(*_KEY, "chunk", "rep", "u")
    copies = _sized(found, large.withColumn("size", F.col("m")), n_large, n_large).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).select(*_KEY, "chunk", "k", "centres")

    def assign(t: pa.Table, c: pa.Table) -> pa.Table:
        if not len(t) or not len(c):
            return pa.table({k: pa.array([], x) for k, x in zip(("label", "dim", "cell", "parent", "rep", "u"), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)})
        centres = np.frombuffer(c.column("centres")[0].as_py(), np.float64).reshape(c.column("k")[0].as_py(), -1)
        v = _matrix(t.column("u").to_pylist())
        near = np.argsort(-(v @ centres.T), 1, kind="stable")[:, : p.overlap]
        cell = t.column("cell")[0].as_py()
        names = mix(np.arange(len(centres), dtype=np.uint64) ^ mix(np.array([cell], np.int64).view(np.uint64) + np.uint64(level))).view(np.int64)
        at = np.repeat(np.arange(len(v)), near.shape[1])
        return pa.table({"label": t.column("label").take(at), "dim": t.column("dim").take(at), "cell": names[near.ravel()], "parent": np.full(len(at), cell, np.int64), "rep": t.column("rep").take(at), "u": t.column("u").take(at)})

    by = [*_KEY, "chunk"]
    return dealt.groupBy(*by).cogroup(copies.groupBy(*by)).applyInArrow(assign, _NODE)


def deal(reps: DataFrame, p: Params) -> DataFrame:
    """(label, dim, cell, rep, u): every vector under all the shards it belongs to, none of them large."""
    node = [x.split()[0] for x in _NODE.split(", ")]
    small = reps.groupBy("label", "dim").agg(F.count("*").alias("n"))
    tables = F.when(F.col("n") > p.max_shard_rows, p.tables).otherwise(1)
    total = reps.count()
    start = skew.hot_join(reps.select("label", "dim", "rep", "u"), small.withColumn("m", F.col("n")), ["label", "dim"], "m", total)
    open_ = start.withColumn("cell", F.explode(F.sequence(F.lit(0), tables - 1))).select("label", "dim", F.col("cell").cast("long").alias("cell"), F.lit(None).cast("long").alias("parent"), "rep", "u")
    open_ = materialize(open_, "cells")
    done, before = [], None
    for level in range(p.max_levels):
        rows = open_.count()
        sizes = open_.groupBy(*_KEY).agg(F.count("*").alias("m"), F.first("parent").alias("parent"))
        if before is not None:
            sizes = sizes.join(before, ["label", "dim", "parent"], "left")
        else:
            sizes = sizes.withColumn("of", F.lit(None).cast("long"))
        sizes = materialize(sizes.where(F.col("m") > p.max_shard_rows).select(*_KEY, "m", F.coalesce(F.col("m") > 0.75 * F.col("of"), F.lit(False)).alias("stuck")), "sizes")
        n_large = sizes.count()
        if not n_large:
            done.append(open_)
            break
        keys = sizes.select(*_KEY)
        done.append(open_.join(F.broadcast(keys) if n_large <= skew.BROADCAST_ROWS else keys, _KEY, "left_anti").select(*node))
        stuck = sizes.where("stuck").select(*_KEY, "m")
        if n_stuck := stuck.count():
            done.append(_parts(_sized(open_, stuck.withColumn("size", F.col("m")), n_stuck, rows), p))
        large = sizes.where("not stuck").select(*_KEY, "m")
        if not (n_large := n_large - n_stuck):
            break
        open_ = materialize(_split(open_.select(*_KEY, "rep", "u"), large, n_large, rows, level, p), "cells")
        before = large.select("label", "dim", F.col("cell").alias("parent"), F.col("m").alias("of"))
    else:
        raise RuntimeError(f"cells still large after {p.max_levels} levels")
    return reduce(DataFrame.unionByName, [x.select(*_KEY, "rep", "u") for x in done])


def _parts(stuck: DataFrame, p: Params) -> DataFrame:
    """Cells that do not shrink (their rows in size), in parts by hash; the vectors of the lowest hashes, the landmarks, are in all parts."""
    parts = F.ceil(F.col("size") / p.shard_rows).cast("int")
    low = F.pmod(F.xxhash64("rep", F.lit(77)), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("size") < p.landmarks
    at = F.pmod(F.xxhash64("rep"), parts).cast("int")
    laid = stuck.withColumn("part", F.explode(F.when(low, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(at))))
    return laid.select("label", "dim", F.xxhash64("cell", "part", F.lit("part")).alias("cell"), F.col("cell").alias("parent"), "rep", "u")


def robust_prune(u: np.ndarray, p: Params) -> np.ndarray:
    """Neighbour lists (row numbers, -1 as filler) of every row, pruned so that no kept neighbour covers another."""
    n = len(u)
    width = min(p.candidates, n - 1)
    out = np.full((n, min(p.degree, max(width, 1))), -1, np.int64)
    if width < 1:
        return out
    for at in range(0, n, 256):
        own = np.arange(at, min(n, at + 256))
        cos = u[own] @ u.T
        cos[np.arange(len(own)), own] = -2
        near = np.argpartition(-cos, width - 1, 1)[:, :width]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(cos, near, 1), 1, kind="stable"), 1)
        far = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(cos, near, 1)))
        alive = np.ones(near.shape, bool)
        line = np.arange(len(own))
        for r in range(out.shape[1]):
            some = alive.any(1)
            if not some.any():
                break
            best = np.argmax(alive, 1)
            picked = near[line, best]
            out[own[some], r] = picked[some]
            between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("bd,bcd->bc", u[picked], u[near])))
            alive &= ~((p.alpha * between <= far) & some[:, None])
            alive[line, best] = False
    return out


def search(u: np.ndarray, lists: np.ndarray, asked: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with a cosine of threshold or more met by beam searches from the medoid, one for each row asked."""
    n = len(u)
    mean = u.mean(0)
    medoid = int(np.argmax(u @ mean))
    src, dst = [], []
    for at in range(0, len(asked), 512):
        own = asked[at : at + 512]
        q = u[own]
        line = np.arange(len(own))[:, None]
        size = min(p.beam, n)
        beam = np.full((len(own), size), -1, np.int64)
        cos = np.full((len(own), size), -2.0)
        open_ = np.zeros((len(own), size), bool)
        beam[:, 0], cos[:, 0], open_[:, 0] = medoid, q @ u[medoid], True
        seen = np.zeros((len(own), n + 1), bool)  # the last column takes the fillers
        seen[:, medoid] = True
        for _ in range(4 * p.beam):
            if not open_.any():
                break
            best = np.argmax(np.where(open_, cos, -3), 1)
            active = open_[line[:, 0], best]
            at_node = beam[line[:, 0], best]
            open_[line[:, 0], best] = False
            fresh = np.where(active[:, None], lists[np.maximum(at_node, 0)], -1)
            fresh[seen[line, fresh]] = -1
            seen[line, fresh] = True
            seen[:, -1] = False
            new = np.where(fresh >= 0, np.einsum("bd,bcd->bc", q, u[np.maximum(fresh, 0)]), -2)
            hit = new >= p.threshold
            if hit.any():
                i, j = np.nonzero(hit)
                src.append(own[i])
                dst.append(fresh[i, j])
            beam, cos, open_ = np.concatenate([beam, fresh], 1), np.concatenate([cos, new], 1), np.concatenate([open_, fresh >= 0], 1)
            order = np.argsort(-cos, 1, kind="stable")[:, :size]
            beam, cos, open_ = beam[line, order], cos[line, order], open_[line, order]
            if size < min(n, 4 * p.beam) and (cos[:, -1] >= p.threshold).any():  # the rim is still within range
                grow = min(n, 2 * size) - size
                beam = np.pad(beam, ((0, 0), (0, grow)), constant_values=-1)
                cos = np.pad(cos, ((0, 0), (0, grow)), constant_values=-2.0)
                open_ = np.pad(open_, ((0, 0), (0, grow)))
                size += grow
    near = np.einsum("nd,nrd->nr", u, u[np.maximum(lists, 0)])
    i, j = np.nonzero((lists >= 0) & (near >= p.threshold))
    src.append(i)
    dst.append(lists[i, j])
    src, dst = np.concatenate(src), np.concatenate(dst)
    return src[src != dst], dst[src != dst]


def forest(n: int, src: np.ndarray, dst: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the edges."""
    up, out = list(range(n)), []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(src.tolist(), dst.tolist(), strict=True):
        x, y = top(a), top(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def graph_links(reps: DataFrame, p: Params) -> DataFrame:
    """(src, dst): spanning links of all that the searches over the flat graph found."""
    dealt = materialize(deal(reps, p), "dealt")
    halo = 2 * p.threshold**2 - 1  # the cosine of twice the threshold's angle

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep")
        ids, u = t.column("rep").to_numpy(), _matrix(t.column("u").to_pylist())
        lists = robust_prune(u, p)
        cos = np.einsum("nd,nrd->nr", u, u[np.maximum(lists, 0)])
        own, slot = np.nonzero(lists >= 0)
        return pa.table({"rep": ids[own], "near": ids[lists[own, slot]], "close": cos[own, slot] >= halo})

    edges = dealt.groupBy(*_KEY).applyInArrow(build, "rep long, near long, close boolean")
    # united: at most tables * 2 ** levels lists of `degree`
    graph = materialize(edges.groupBy("rep").agg(F.collect_set("near").alias("near"), F.collect_set(F.when(F.col("close"), F.col("near"))).alias("close")), "graph")
    inside = dealt.select(*_KEY, "rep")
    across = inside.join(graph.select("rep", F.explode("close").alias("other")), "rep").select(*_KEY, F.col("other").alias("rep")).distinct()
    across = across.join(inside, [*_KEY, "rep"], "left_anti").join(reps.select("rep", "u"), "rep").select(*_KEY, "rep", "u", F.lit(False).alias("own"))
    nodes = dealt.withColumn("own", F.lit(True)).unionByName(across).join(graph.select("rep", "near"), "rep", "left")

    def look(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep")
        ids, u = t.column("rep").to_numpy(), _matrix(t.column("u").to_pylist())
        at = {int(x): i for i, x in enumerate(ids)}
        own = [[at[x] for x in near or () if x in at] for near in t.column("near").to_pylist()]
        lists = np.full((len(ids), max(1, *map(len, own), 1)), -1, np.int64)
        for i, near in enumerate(own):
            lists[i, : len(near)] = near
        edges = forest(len(ids), *search(u, lists, np.flatnonzero(t.column("own").to_numpy(zero_copy_only=False)), p))
        return pa.table({"src": pa.array([ids[a] for a, _ in edges], pa.int64()), "dst": pa.array([ids[b] for _, b in edges], pa.int64())})

    return nodes.select(*_KEY, "rep", "u", "near", "own").groupBy(*_KEY).applyInArrow(look, "src long, dst long")


def exact_counts(members: DataFrame, p: Params) -> DataFrame:
    """(rep, links): weight of the vectors within reach of each one in its component, by blocks against blocks."""
    members = materialize(members, "members")
    sizes = members.groupBy("component").agg(F.count("*").alias("m")).withColumn("blocks", (F.floor((F.col("m") - 1) / p.block_rows) + 1).cast("int"))
    rows = skew.hot_join(members, sizes, ["component"], "m", members.count()).withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "copies", "u")

    def compare(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        own, ids = t.column("own").to_numpy(), t.column("rep").to_numpy()
        u, copies = _matrix(t.column("u").to_pylist()), t.column("copies").to_numpy().astype(np.float64)
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        near = (u[a] @ u[b].T) >= p.threshold
        if i == j:
            np.fill_diagonal(near, False)
            found = [(ids[a], near @ copies[b])]
        else:
            found = [(ids[a], near @ copies[b]), (ids[b], copies[a] @ near)]
        return pa.table({"rep": pa.array(np.concatenate([x for x, _ in found]), pa.int64()), "n": pa.array(np.concatenate([x for _, x in found]).round().astype(np.int64))})

    return rows.groupBy("component", "i", "j").applyInArrow(compare, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("links"))


def near_duplicates(vectors: DataFrame, p: Params = Params()) -> DataFrame:
    """vec_id, n_links, component_id and kept for every vector."""
    small_batches(vectors.sparkSession)
    valid = materialize(units(vectors), "units")
    key = ["label", "dim", "d1", "d2"]
    # a vec_id may be repeated with other vectors, so graph vertices are numbered by digest, not by id
    firsts = valid.groupBy(*key).agg(F.min(F.struct("vec_id", "u")).alias("first"), F.count("*").alias("copies"))
    nodes = materialize(firsts.select(*key, F.xxhash64(*key).alias("rep"), F.col("first.vec_id").alias("vec"), F.col("first.u").alias("u"), "copies"), "nodes")
    parts = connected_components(graph_links(nodes, p))
    named = materialize(nodes.join(parts.withColumnRenamed("node", "rep"), "rep").select("rep", "component", "vec", "copies"), "named")
    counts = exact_counts(named.join(nodes.select("rep", "u"), "rep").select("component", "rep", "copies", "u"), p)
    lowest = named.groupBy("component").agg(F.min("vec").alias("low"), F.count("*").alias("m"))
    linked = skew.hot_join(named.select("rep", "component"), lowest, ["component"], "m", named.count()).join(counts, "rep").select("rep", "links", "low")
    known = nodes.join(linked, "rep", "left").select(*key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("low", "vec").alias("component_id"), F.col("copies").alias("m"))
    met = skew.hot_join(valid.select("vec_id", *key), known, key, "m", valid.count()).select("vec_id", "n_links", "component_id", F.lit(1).alias("n"))
    # all rows again: those that cannot link stand alone
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).groupBy("vec_id").count()
    short = every.join(valid.groupBy("vec_id").agg(F.count("*").alias("n")), "vec_id", "left").select("vec_id", (F.col("count") - F.coalesce("n", F.lit(0))).cast("int").alias("alone")).where("alone > 0")
    single = short.select("vec_id", F.explode(F.array_repeat(F.lit(0).cast("long"), F.col("alone"))).alias("n_links"), F.col("vec_id").alias("component_id"))
    return met.drop("n").unionByName(single).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def audit(vectors: DataFrame, found: DataFrame, p: Params = Params(), every: int = 100, block: int = 2000) -> float:
    """Recall of links against brute force for all vectors whose id is divisible by `every`, `block` queries at a time.

    Each block of queries, a bounded number, goes to the tasks with their code and meets all rows there.
    """
    valid = materialize(units(vectors), "units")
    asked = valid.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min(F.struct("label", "dim", "u")).alias("q"))  # a repeated id counts once
    asked = materialize(asked.select("vec_id", "q.*"), "asked")
    blocks = -(-asked.count() // block)
    of = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks)))
    truth = []
    for i in range(blocks):
        queries: dict = {}
        for r in asked.where(of == i).collect():
            queries.setdefault((r["label"], r["dim"]), []).append(r)
        queries = {k: ([r["vec_id"] for r in v], _matrix([r["u"] for r in v])) for k, v in queries.items()}

        def count(batches: Iterator[pa.RecordBatch], queries: dict = queries) -> Iterator[pa.RecordBatch]:
            total: dict = {}
            for batch in batches:
                own: dict = {}
                for label, dim, u in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own.setdefault((label, dim), []).append(u)
                for k, rows in own.items():
                    if k in queries:
                        ids, q = queries[k]
                        for x, n in zip(ids, ((q @ _matrix(rows).T) >= p.threshold).sum(1).tolist(), strict=True):
                            total[x] = total.get(x, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["vec_id", "n"])

        truth.append(materialize(valid.select("label", "dim", "u").mapInArrow(count, "vec_id long, n long").groupBy("vec_id").agg((F.sum("n") - 1).alias("truth")), "truth"))
    if not truth:
        return 1.0
    r = reduce(DataFrame.unionByName, truth).join(found.groupBy("vec_id").agg(F.max("n_links").alias("n_links")), "vec_id").agg(F.sum(F.least("n_links", "truth")), F.sum("truth")).first()
    return 1.0 if not r[1] else r[0] / r[1]
