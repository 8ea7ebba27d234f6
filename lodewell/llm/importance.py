"""Importance resampling towards a target distribution, over hashed word n-grams.

The documents become a sparse matrix of counts, documents by hash buckets, that is written to the shared folder as
blocks in compressed sparse rows (offsets, bucket numbers, counts), one block for each batch of rows. Its column sums are the
corpus distribution; those of the benchmark's matrix are the target. A bucket's gain is the logarithm of their ratio,
smoothed by one, in thousandths; the product of the blocks with the vector of gains gives each document the floored mean gain of
its features. With Gumbel noise from a hash of doc_id the highest scores are a sample without replacement.

Words are runs of letters, digits and characters beyond ASCII, A-Z taken as a-z; features are all runs of 1 to `longest` words.
The gains (one number a bucket, `buckets` of them) are the only table that passes the driver. The draw finds the lowest drawn
score on counts per score, so only drawn rows are ordered, each score's rows by themselves.

Null or empty text has no features and weight 0; documents of fewer than `min_words` words are never drawn. A null doc_id has the
noise of the empty name and comes last in ties. Repeated rows count and are drawn each on its own; tables without rows give none, a target without rows has T = 0;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewell.plans.storage import materialize, small_batches

#: ASCII other than letters and digits parts words; A-Z becomes a-z.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Feature names whose bucket a task keeps.
_KNOWN = 1 << 18

BLOCK = "ids array<long>, n_words array<long>, n_features array<long>, offsets array<int>, buckets array<int>, counts array<int>"


@dataclass(frozen=True)
class Params:
    buckets: int = 10_000
    longest: int = 1
    min_words: int = 20
    share: tuple[int, int] = (10, 100)
    seed: int = 2024


def features(words: list[bytes], longest: int) -> Counter:
    """How often each run of 1 to `longest` words occurs."""
    found = Counter(words)
    for n in range(2, longest + 1):
        found.update(map(b" ".join, zip(*(words[k:] for k in range(n)))))
    return found


def count_matrix(rows: DataFrame, params: Params = Params(), key: str = "doc_id", name: str = "blocks") -> DataFrame:
    """The documents' sparse count matrix as a table of CSR blocks in the shared folder."""
    small_batches(rows.sparkSession)
    most, longest = params.buckets, params.longest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            n_words, n_features, offsets, columns, counts = [], [], [0], [], []
            for data in batch.column(1).to_pylist():
                words = (data or b"").translate(_CLEAN).split()
                found = features(words, longest)
                if len(known) > _KNOWN:
                    known.clear()
                for w in found:
                    if w not in known:
                        known[w] = zlib.crc32(w) % most
                at = np.fromiter((known[w] for w in found), np.int64, len(found))
                col, inverse = np.unique(at, return_inverse=True)
                per = np.bincount(inverse, np.fromiter(found.values(), np.int64, len(found)), len(col))
                n_words.append(len(words))
                n_features.append(found.total())
                columns.append(col)
                counts.append(per.astype(np.int64))
                offsets.append(offsets[-1] + len(col))
            parts = [batch.column(0).to_pylist(), n_words, n_features, np.array(offsets, np.int32), np.concatenate(columns).astype(np.int32), np.concatenate(counts).astype(np.int32)]
            kinds = [pa.int64()] * 3 + [pa.int32()] * 3
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.list_(k)) for p, k in zip(parts, kinds, strict=True)], names=[c.split()[0] for c in BLOCK.split(", ")])

    own = rows.select(F.col(key).cast("long").alias("k"), F.col("text").cast("string").cast("binary").alias("t"))
    return materialize(own.mapInArrow(run, BLOCK), name)


def column_sums(matrix: DataFrame, n: int) -> DataFrame:
    """(bucket, n): what each bucket holds over all blocks; a task sums its blocks before anything moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for col, per in zip(batch.column(0), batch.column(1), strict=True):
                total += np.bincount(col.values.to_numpy(), per.values.to_numpy(), n).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return matrix.select("buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, params: Params = Params()) -> np.ndarray:
    """The gain of every bucket, from the column sums of both matrices; `buckets` numbers."""
    n = params.buckets
    sums = [np.zeros(n), np.zeros(n)]
    for total, matrix in zip(sums, (source, target), strict=True):
        for r in column_sums(matrix, n).collect():
            total[r["bucket"]] = r["n"]
    s, t = sums
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight, the floored mean gain: one sparse product for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, n_words, n_features, offsets, col, per = (batch.column(k)[i].values for k in range(6))
                gained = np.append(0, np.cumsum(per.to_numpy().astype(np.int64) * gain[col.to_numpy()]))
                edge, n = offsets.to_numpy(), n_features.to_numpy()
                weight = (gained[edge[1:]] - gained[edge[:-1]]) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([ids, n_words, n_features, pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return matrix.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the head of a sha256 of seed and id."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    h = F.conv(head, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; the rank (from 1) is null where it is not drawn."""
    matrix = count_matrix(docs, params)
    gain = gains(matrix, count_matrix(target.withColumn("doc_id", F.lit(None).cast("long")), params, name="target"), params)
    scored = weights(matrix, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), params.seed))
    scored = materialize(scored, "scored")
    able = F.col("n_words") >= params.min_words
    per = scored.where(able).groupBy("score").agg(F.count("*").alias("n"))
    # one row a distinct score: scores are thousandths of logarithms, some ten thousand values
    # whatever the number of documents
    below = per.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("score")))).withColumn("before", F.col("upto") - F.col("n"))
    draw = per.agg(F.expr(f"coalesce(sum(n), 0) * {params.share[0]} div {params.share[1]}").alias("draw")).first()["draw"]
    open_ = below.where(F.col("before") < draw).select("score", "before")
    drawn = scored.where(able).join(F.broadcast(open_), "score")
    place = F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight"))
    ranked = drawn.withColumn("rank", F.when(place <= draw, place).cast("long"))
    rest = scored.join(F.broadcast(open_.select("score")), "score", "left_anti").unionByName(scored.where(~able).join(F.broadcast(open_.select("score")), "score", "left_semi"))
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, "rank").unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank")))
