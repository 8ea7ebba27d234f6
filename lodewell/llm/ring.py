"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has `vnodes` places on a ring of 60-bit hashes (the head of an md5); a key belongs to the first place clockwise.
Loads are bounded by quotas that differ by one row at most (`balance` 1.0), or by `balance` times
the mean. Arcs are taken clockwise; rows that overflow a full shard continue clockwise to the next shard
with room. Because an arc's rows are in ring order, the overflow is decided on row counts of arcs alone: a
table of shards * vnodes counts, worked through on the driver, with at most one cut arc for
each shard that fills up. The ring depends on the shards and virtual nodes only, never on the number of rows. Rows find
their shard and slot by their rank within their arc: arcs are counted in cells, ranges of the hash that hold about
`cell_rows` rows; a row's rank is that of its cell and its place within the cell, so no task sorts more
than a cell.

doc_id is a key; rows with a null doc_id take the place of their text, so that many of them do not meet in one arc.
Null text weighs 8 bytes. Rows that repeat a doc_id are rows of their own, next to each other. An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ring:
    shards: int = 24
    vnodes: int = 64
    cell_rows: int = 20_000
    balance: float = 1.0


def places(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ring positions of all virtual nodes, and their shards."""
    found = sorted((int(hashlib.md5(f"{s}/{v}".encode()).hexdigest()[:15], 16), s) for s in range(shards) for v in range(vnodes))
    return np.array([p for p, _ in found], np.int64), np.array([s for _, s in found], np.int32)


def plan(counts: dict[int, int], owners: np.ndarray, shards: int, balance: float = 1.0) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, slot of the first rank) for all rows, loads bounded.

    With balance 1.0 the quotas are n // shards, plus one for the first n % shards shards.
    """
    n = sum(counts.values())
    quota = [n // shards + (s < n % shards) for s in range(shards)] if balance <= 1 else [ceil(balance * n / shards)] * shards
    load, out, open_ = [0] * shards, [], shards
    size = len(owners)
    for arc in sorted(counts):
        rank, left, at = 0, counts[arc], arc
        while left:
            s = int(owners[at % size])
            room = quota[s] - load[s]
            if room > 0:
                take = min(room, left)
                out.append((arc, rank, rank + take, s, load[s]))
                load[s] += take
                rank, left = rank + take, left - take
            at += 1
            if at > arc + size and left:
                raise RuntimeError(f"no room on {open_} shards")
    return out


def shard_rows(docs: DataFrame, ring: Ring = Ring()) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) for every row."""
    spark = docs.sparkSession
    data = F.col("text").cast("string").cast("binary")
    name = F.coalesce(F.col("doc_id").cast("long").cast("string").cast("binary"), data, F.lit("").cast("binary"))
    at = F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(data), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32(data), F.lit(0)).cast("long").alias("text_crc32"), at.alias("at"))
    # ranges of the hash, a power of two of them; they only say how rows are counted, not where they go
    bits = max(0, ceil(docs.count() / ring.cell_rows) - 1).bit_length()
    vnodes = ring.vnodes
    shards = ring.shards

    def arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots = places(shards, vnodes)[0]
        for batch in batches:
            arc = np.searchsorted(spots, batch.column(3).to_numpy()) % len(spots)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(arc.astype(np.int32))], names=["doc_id", "size", "text_crc32", "at", "arc"])

    laid = rows.mapInArrow(arcs, "doc_id long, size long, text_crc32 long, at long, arc int")
    laid = laid.withColumn("cell", F.shiftright("at", 60 - bits))
    cells = laid.groupBy("arc", "cell").agg(F.count("*").alias("n"))
    counts = {r["arc"]: r["n"] for r in cells.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    cuts = plan(counts, places(shards, vnodes)[1], shards, ring.balance)
    # one row an arc and one more for each shard that fills up
    segments = F.broadcast(spark.createDataFrame(cuts, "of int, first long, stop long, shard int, slot0 long"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("arc", "cell", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("arc", "cell").orderBy("at", "doc_id", "size", "text_crc32")) - 1
    ranked = laid.withColumn("within", within).join(cells, ["arc", "cell"]).withColumn("rank", F.col("before") + F.col("within"))
    met = ranked.join(segments, (F.col("arc") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("stop")))
    return met.select("doc_id", "size", "text_crc32", "shard", (F.col("slot0") + F.col("rank") - F.col("first")).cast("long").alias("slot"))
